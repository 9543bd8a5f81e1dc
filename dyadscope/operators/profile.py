"""Profile of any table, and ranked 'Y ~ X' question seeds from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadscope.functions.names import any_token
from dyadscope.functions.numeric import as_number

# Column-name vocabularies of the risk and exclusion rules.
TECHNICAL_TOKENS = (
    "run_id", "candidate_id", "bootstrap_seed", "seed", "hash", "signature", "timestamp", "created_at", "updated_at",
    "returncode", "stdout", "stderr", "command", "artifact", "cli_summary",
)
LEAKAGE_TOKENS = (
    "p_boot", "p_value", "q_value", "candidate_tier", "status_validation", "validated", "support_candidate", "top_model",
    "model_score", "validation_score", "scan_score", "candidate_rank", "effect_size", "coef", "stderr", "loglik", "aic", "bic",
)
OUTCOME_TOKENS = (
    "policy_cited", "policy_cite_count", "policy_citation", "policy_impact", "outcome", "target", "label", "dependent",
    "response", "time_to_first", "time_to_", "citation_", "cited_",
)
POST_TREATMENT_TOKENS = (
    "post_", "_post", "after_", "_after", "future", "lead", "delta", "change", "growth", "next_",
)


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime_like"
    return "string"


def _number(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    return as_number(col.cast("int")) if isinstance(field.dataType, T.BooleanType) else as_number(col)


def _time(col: Column) -> Column:
    """Microseconds since the epoch as a double; null where the value is no time."""
    stamp = F.coalesce(
        F.try_to_timestamp(col.cast("string")), F.try_to_timestamp(F.replace(col.cast("string"), F.lit("/"), F.lit("-")))
    )
    return F.unix_micros(stamp.cast("timestamp")).cast("double")


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: fill, distinct values, kind, and for numbers range, moments and flags.

    One aggregate over the whole table, and one over (column, value) for the exact distinct counts;
    values repeated within a task are combined before they are shuffled.
    """
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
    cells: list[Column] = []
    for i, f in enumerate(fields):
        col = F.col(f"`{f.name}`")
        kind = _kind(f.dataType)
        known = F.when(~F.isnan(col), col) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else col
        aggs.append(F.count(known).alias(f"k{i}"))
        cells.append(F.struct(F.lit(i).alias("i"), F.when(known == 0, F.lit("0")).otherwise(known.cast("string")).alias("v") if kind == "numeric" else known.cast("string").alias("v")))
        if kind in ("numeric", "bool"):
            x = _number(f)
            aggs += [
                F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_pop(x).alias(f"sd{i}"),
                F.avg((x == 0).cast("double")).alias(f"zero{i}"),
                F.min(x.isin(0.0, 1.0).cast("int")).alias(f"bin{i}"),
                F.min(((x >= 0) & (F.abs(F.bround(x, 0) - x) < 1e-12)).cast("int")).alias(f"nn{i}"),
            ]
        elif kind == "string":
            dated = col.rlike(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}") | (F.contains(col, F.lit("T")) & F.contains(col, F.lit(":")))
            aggs += [F.count(F.when(dated, _time(col))).alias(f"time{i}")]
    values = df.select(F.inline(F.array(*cells))).where("v is not null").groupBy("i", "v").agg(F.lit(1).alias("_"))
    distinct = values.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    unique_of = distinct.agg(F.map_from_entries(F.collect_list(F.struct("i", "n")))).scalar()  # one entry per column
    wide = df.agg(*aggs).withColumn("uniques", unique_of)

    def entry(i: int, f: T.StructField) -> Column:
        kind = _kind(f.dataType)
        known = F.col(f"k{i}")
        unique = F.coalesce(F.try_element_at("uniques", F.lit(i)), F.lit(0).cast("bigint"))
        group = F.lit(kind)
        if kind == "string":
            group = F.when((known > 0) & (F.col(f"time{i}") / known >= 0.95), "datetime_like").otherwise("string")
        number = kind in ("numeric", "bool")

        def stat(prefix: str, cast: str = "double") -> Column:
            return F.col(f"{prefix}{i}").cast(cast) if number else F.lit(None).cast(cast)

        binary = F.coalesce((stat("bin", "int") == 1) & (unique <= 2) & (known > 0), F.lit(False))
        return F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("name"), group.alias("dtype_group"), F.col("n_rows").alias("n_rows"),
            known.alias("nonmissing_count"),
            F.when(F.col("n_rows") > 0, known / F.col("n_rows")).otherwise(F.lit(0.0)).alias("nonmissing_share"),
            unique.alias("unique_count"),
            F.when(known > 0, unique / known).otherwise(F.lit(0.0)).alias("unique_share"),
            stat("lo").alias("min_value"), stat("hi").alias("max_value"), stat("mean").alias("mean_value"),
            stat("sd").alias("std_value"), stat("zero").alias("zero_share"),
            binary.cast("int").alias("is_binary_numeric"),
            F.coalesce(((stat("nn", "int") == 1) & (known > 0)).cast("int"), F.lit(0)).alias("is_nonnegative_integer"),
            F.when(binary, stat("mean")).alias("positive_share"),
        )

    rows = F.array(*[entry(i, f) for i, f in enumerate(fields)])
    return wide.select(F.inline(rows))


def sample_values(df: DataFrame, n: int = 3) -> dict[str, list[str]]:
    """A few known values per column, from the head of the table, for display."""
    head = df.limit(50 * max(n, 1)).collect()
    return {c: [str(r[c]) for r in head if r[c] is not None][:n] for c in df.columns}


def _norm(name: Column) -> Column:
    return F.lower(F.trim(name))


def is_technical(name: Column) -> Column:
    n = _norm(name)
    return F.endswith(n, F.lit("_path")) | any_token(n, TECHNICAL_TOKENS)


def is_id_like(name: Column, unique_share: Column) -> Column:
    n = _norm(name)
    return ((unique_share >= 0.98) & any_token(n, ("id", "uuid", "doi", "key"))) | F.endswith(n, F.lit("_id")) | F.startswith(n, F.lit("id_"))


def target_candidates(profile: DataFrame, n: int | None = None) -> DataFrame:
    """Columns that can be an outcome: binary first, then counts, then continuous."""
    number = F.col("dtype_group").isin("numeric", "bool")
    kind = (
        F.when(number & (F.col("is_binary_numeric") == 1), "binary")
        .when(number & (F.col("is_nonnegative_integer") == 1) & (F.col("unique_count") >= 4), "count")
        .when(number & (F.col("std_value") > 0), "continuous")
    )
    base = F.when(kind == "binary", 3.0).when(kind == "count", 2.0).otherwise(1.0)
    name = F.col("name")
    rows = profile.where(
        ~is_technical(name) & (F.col("nonmissing_share") >= 0.60) & ~is_id_like(name, F.col("unique_share")) & kind.isNotNull()
    ).select("position", "name", kind.alias("y_type"), "nonmissing_share", "unique_count", (base + F.col("nonmissing_share")).alias("priority"))
    found = rows.orderBy(F.desc("priority"), F.desc("unique_count"), "position")
    return found if n is None else found.limit(n)


def regressor_candidates(
    profile: DataFrame, *, targets: Sequence[str] = (), exclude: Sequence[str] = (), research_mode: bool = True, n: int | None = None
) -> DataFrame:
    """Columns that can explain: numbers that vary, times, and texts with few levels."""
    name = F.col("name")
    hidden = [x.strip().lower() for x in (*targets, *exclude) if x.strip()]
    levels = F.greatest(F.lit(10), F.least(F.lit(40), F.floor(F.col("n_rows") * 0.20).cast("int")))
    kind = (
        F.when(F.col("dtype_group").isin("numeric", "bool"), F.when(F.col("std_value") > 0, "numeric"))
        .when(F.col("dtype_group") == "datetime_like", "time")
        .when(F.col("unique_count").between(2, levels), "categorical")
    )
    base = F.when(kind == "numeric", 2.0).when(kind == "time", 1.7).otherwise(1.4)
    keep = ~is_technical(name) & (F.col("nonmissing_share") >= 0.60) & ~is_id_like(name, F.col("unique_share")) & kind.isNotNull()
    if hidden:
        keep = keep & ~_norm(name).isin(hidden)
    if research_mode:
        keep = keep & ~any_token(_norm(name), OUTCOME_TOKENS) & ~any_token(_norm(name), LEAKAGE_TOKENS)
    rows = profile.where(keep).select(
        "position", "name", kind.alias("x_type"), "nonmissing_share", "unique_count", (base + F.col("nonmissing_share")).alias("priority")
    )
    found = rows.orderBy(F.desc("priority"), "unique_count", "position")
    return found if n is None else found.limit(n)


def seed_risk(y: Column, x: Column, y_type: Column, x_type: Column) -> Column:
    """Flags, level and penalty of a question seed."""
    yn, xn = _norm(y), _norm(x)
    high = any_token(xn, OUTCOME_TOKENS) | any_token(xn, LEAKAGE_TOKENS)
    flags = F.array_compact(
        F.array(
            F.when(any_token(xn, OUTCOME_TOKENS), "x_outcome_like"),
            F.when(any_token(xn, LEAKAGE_TOKENS), "x_model_output_like"),
            F.when(any_token(xn, POST_TREATMENT_TOKENS), "x_post_treatment_hint"),
            F.when(F.contains(xn, yn) | F.contains(yn, xn), "x_name_overlaps_y"),
            F.when((y_type == "binary") & (x_type == "categorical"), "x_categorical_binary_screen_only"),
        )
    )
    some = F.size(flags) > 0
    return F.struct(
        flags.alias("risk_flags"),
        F.when(high, "high").when(some, "medium").otherwise("low").alias("risk_level"),
        F.when(high, 0.30).when(some, 0.12).otherwise(0.0).alias("risk_penalty"),
    )


def min_support(n_rows: Column) -> Column:
    return F.least(F.lit(30), F.greatest(F.lit(12), F.floor(n_rows * 0.50).cast("int")))


def pair_scores(df: DataFrame, targets: Sequence[tuple[str, str]], regressors: Sequence[tuple[str, str]]) -> DataFrame:
    """Score of every (Y, X) pair, from one wide aggregate per target and one grouping-sets pass.

    Targets and regressors are (name, type) lists capped by the profile. Numeric and time pairs
    need group means or a correlation; categorical pairs compare level means. Rows are never
    multiplied by pairs.
    """
    fields = {f.name: f for f in df.schema.fields}
    names = [x for x, _ in regressors]
    pairs_of = {y: [(x, t) for x, t in regressors if x not in {n for n, _ in targets}] for y, _ in targets}

    def y_value(y: str, y_type: str) -> Column:
        v = _number(fields[y])
        return F.when(v.isin(0.0, 1.0), v) if y_type == "binary" else v

    def x_value(x: str, x_type: str) -> Column:
        return _time(F.col(f"`{x}`")) if x_type == "time" else _number(fields[x])

    cells = df.select(
        *[y_value(y, t).alias(f"y{i}") for i, (y, t) in enumerate(targets)],
        *[(F.col(f"`{x}`").cast("string") if t == "categorical" else x_value(x, t)).alias(f"x{j}") for j, (x, t) in enumerate(regressors)],
    )
    place = {x: j for j, x in enumerate(names)}
    parts: list[DataFrame] = []
    for i, (y, y_type) in enumerate(targets):
        yv = F.col(f"y{i}")
        aggs, entries = [F.count(F.lit(1)).alias("n_rows")], []
        for x, x_type in pairs_of[y]:
            j = place[x]
            both = yv.isNotNull() & F.col(f"x{j}").isNotNull()
            aggs.append(F.count_if(both).alias(f"n{j}"))
            if x_type == "categorical":
                aggs.append(F.stddev_pop(F.when(both, yv)).alias(f"sd{j}"))
                continue
            xv = F.col(f"x{j}")
            if y_type == "binary":
                aggs += [F.avg(F.when(yv == v, xv)).alias(f"m{v}_{j}") for v in (0, 1)]
                aggs.append(F.stddev_pop(F.when(both, xv)).alias(f"sd{j}"))
                score = F.abs(F.col(f"m1_{j}") - F.col(f"m0_{j}")) / (F.col(f"sd{j}") + F.lit(1e-12))
                a, b = F.col(f"m0_{j}"), F.col(f"m1_{j}")
            else:
                # Rows with one side missing do not enter a correlation.
                aggs.append(F.corr(yv, xv).alias(f"r{j}"))
                score = F.abs(F.nanvl(F.col(f"r{j}"), F.lit(None).cast("double")))
                a, b = F.col(f"r{j}"), F.lit(None).cast("double")
            entries.append((x, x_type, F.col(f"n{j}"), score, a, b))
        wide = cells.agg(*aggs)
        if entries:
            parts.append(
                wide.select(
                    "n_rows",
                    F.inline(
                        F.array(
                            *[
                                F.struct(
                                    F.lit(y).alias("y_col"), F.lit(y_type).alias("y_type"), F.lit(x).alias("x_col"), F.lit(t).alias("x_type"),
                                    n.alias("support_rows"), s.alias("score"), a.alias("low_value"), b.alias("high_value"),
                                )
                                for x, t, n, s, a, b in entries
                            ]
                        )
                    ),
                )
            )
        cats = [(x, place[x]) for x, t in pairs_of[y] if t == "categorical"]
        if cats:
            levels = cells.where(yv.isNotNull()).groupingSets([(f"x{j}",) for _, j in cats], *[f"x{j}" for _, j in cats]).agg(
                F.coalesce(*[F.when(F.grouping(f"x{j}") == 0, F.lit(x)) for x, j in cats]).alias("x_col"),
                F.coalesce(*[F.col(f"x{j}") for _, j in cats]).alias("level"),
                F.avg(yv).alias("m"),
            ).where("level is not null")
            spread = levels.groupBy("x_col").agg(F.count(F.lit(1)).alias("n_levels"), F.min("m").alias("lo"), F.max("m").alias("hi")).where("n_levels >= 2")
            totals = wide.select(
                "n_rows",
                F.inline(F.array(*[F.struct(F.lit(x).alias("x_col"), F.col(f"n{j}").alias("support_rows"), F.col(f"sd{j}").alias("sd")) for x, j in cats])),
            )
            score = F.abs(F.col("hi") - F.col("lo"))
            score = score if y_type == "binary" else score / (F.col("sd") + F.lit(1e-12))
            parts.append(
                totals.join(spread, "x_col").select(
                    "n_rows", F.lit(y).alias("y_col"), F.lit(y_type).alias("y_type"), "x_col", F.lit("categorical").alias("x_type"),
                    "support_rows", score.alias("score"), F.col("lo").alias("low_value"), F.col("hi").alias("high_value"),
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    scored = out.where(F.col("score").isNotNull() & (F.col("support_rows") >= min_support(F.col("n_rows"))))
    risk = seed_risk(F.col("y_col"), F.col("x_col"), F.col("y_type"), F.col("x_type"))
    return scored.withColumn("_risk", risk).select(
        "y_col", "y_type", "x_col", "x_type", "score",
        (F.col("score") * (F.lit(1.0) - F.col("_risk.risk_penalty"))).alias("score_adjusted"),
        "support_rows",
        (F.col("support_rows") / F.col("n_rows")).alias("pair_nonmissing_share"),
        signal_text(F.col("y_type"), F.col("x_type"), F.col("low_value"), F.col("high_value"), F.col("score")).alias("signal_summary"),
        F.col("_risk.risk_level").alias("risk_level"),
        F.array_join("_risk.risk_flags", "|").alias("risk_flags"),
        F.concat_ws(" ~ ", "y_col", "x_col").alias("label"),
    )


def three_digits(x: Column) -> Column:
    """Three significant digits, trailing zeros removed, exponent form outside 1e-4..1e3."""
    text = F.format_string("%.2e", x)
    power = F.regexp_extract(text, r"e([+-]\d+)$", 1).cast("int")

    def trimmed(t: Column) -> Column:
        return F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)

    out = F.concat(trimmed(F.regexp_extract(text, r"^(.*)e", 1)), F.regexp_extract(text, r"(e[+-]\d+)$", 1))
    for p in range(-4, 3):
        out = F.when(power == p, trimmed(F.format_string(f"%.{2 - p}f", x))).otherwise(out)
    return F.when(x == 0, "0").otherwise(out)


def signal_text(y_type: Column, x_type: Column, low: Column, high: Column, score: Column) -> Column:
    binary, level = y_type == "binary", x_type == "categorical"
    return (
        F.when(binary & level, F.concat(F.lit("group positive-rate spread ("), three_digits(low), F.lit(".."), three_digits(high), F.lit(")")))
        .when(binary, F.concat(F.lit("group-mean gap (y=1:"), three_digits(high), F.lit(", y=0:"), three_digits(low), F.lit(")")))
        .when(level, F.concat(F.lit("group mean spread/std = "), three_digits(score)))
        .otherwise(F.concat(F.lit("abs corr = "), three_digits(low)))
    )


def question_seeds(scores: DataFrame, top_n: int = 20) -> DataFrame:
    """The best pairs, ranked; pairs are capped at targets x regressors, so the window is small."""
    order = (F.desc("score_adjusted"), F.desc("score"), F.desc("pair_nonmissing_share"), "y_col", "x_col")
    best = scores.orderBy(*order).limit(max(1, int(top_n)))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def profile_table(
    df: DataFrame, *, top_n: int = 20, research_mode: bool = True, fixed_y: str = "", exclude: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Profile, candidates and seeds of a whole table."""
    profile = column_profile(df)
    profile = df.sparkSession.createDataFrame(profile.collect(), profile.schema)  # one row per column
    targets = target_candidates(profile)
    if fixed_y.strip():
        wanted = profile.where(_norm(F.col("name")) == fixed_y.strip().lower())
        if wanted.isEmpty():
            raise ValueError(f"fixed_y not found in dataset columns: {fixed_y}")
        targets = target_candidates(wanted)
        if targets.isEmpty():
            raise ValueError(f"fixed_y is not a valid numeric or binary target: {fixed_y}")
    ys = [(r["name"], r["y_type"]) for r in targets.collect()]
    regressors = regressor_candidates(profile, targets=[y for y, _ in ys], exclude=exclude, research_mode=research_mode)
    xs = [(r["name"], r["x_type"]) for r in regressors.collect()]
    out = {"columns": profile, "targets": targets, "regressors": regressors}
    if ys and xs:
        out["question_seeds"] = question_seeds(pair_scores(df, ys, xs), top_n)
    return out


def profile_highlights(profile: DataFrame, seeds: DataFrame, n: int = 12) -> DataFrame:
    """Emptiest columns, most distinct columns and best seeds, as (list, place, label, value)."""

    def head(df: DataFrame, name: str, label: str, value: Column) -> DataFrame:
        best = df.select(F.col(label).alias("label"), value.alias("value")).orderBy(F.desc("value"), "label").limit(n)
        place = F.row_number().over(Window.orderBy(F.desc("value"), "label"))
        return best.select(F.lit(name).alias("list"), place.alias("place"), "label", "value")

    return (
        head(profile, "missing_share_top", "name", F.lit(1.0) - F.col("nonmissing_share"))
        .unionByName(head(profile, "unique_share_top", "name", F.col("unique_share")))
        .unionByName(head(seeds, "seed_score_top", "label", F.col("score")))
    )
