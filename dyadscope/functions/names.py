"""Rules on feature names: lineage atoms, timing and source labels, expression and level names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Column-name vocabulary of the input contract.
OUTCOME_TOKENS = (
    "reference_",
    "policy_cited",
    "policy_cite_count",
    "time_to_first_policy_citation",
    "ctx_n_evidence_use",
    "ctx_share_evidence_use",
    "first_policy_lag",
    "y_all",
    "y_evidence",
    "count_all",
    "count_evidence",
)
IDENTIFIER_COLUMNS = (
    "track",
    "pair_id",
    "policy_document_id",
    "event_id",
    "openalex_work_id",
    "paper_title",
    "affiliation_label",
    "corresponding_institutions_actual",
    "first_author_institutions_actual",
    "pub_date",
    "policy_published_on",
    "primary_domain",
)
CONTROL_COLUMNS = ("pub_year_alt", "recency_years_alt", "pa__author_count", "pa__log1p_author_count")
BASE_PRETREATMENT = ("pub_year_alt", "recency_years_alt", "is_academia_origin")
COVARIATE_PRETREATMENT = (
    "pub_year",
    "author_count",
    "log1p_author_count",
    "countries_distinct_count",
    "institutions_distinct_count",
    "corresponding_authors_count",
    "is_pair_complete_openalex",
    "is_pair_discordant_openalex",
    "pair_match_count_openalex",
    "include_in_primary",
    "include_in_sensitivity",
)
EXTENSION_PRETREATMENT: tuple[str, ...] = ()


def any_token(name: Column, tokens: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for token in tokens:
        found = found | F.contains(name, F.lit(token))
    return found


def is_outcome_like(name: Column) -> Column:
    return any_token(F.lower(name), OUTCOME_TOKENS)


def data_source(name: Column) -> Column:
    return (
        F.when(F.startswith(name, F.lit("ext__")), "metadata_extension")
        .when(F.startswith(name, F.lit("pa__")), "phase_a_model_input")
        .otherwise("dyad_base")
    )


def timing_label(
    name: Column,
    *,
    base: tuple[str, ...] = BASE_PRETREATMENT,
    covariates: tuple[str, ...] = COVARIATE_PRETREATMENT,
    extension: tuple[str, ...] = EXTENSION_PRETREATMENT,
) -> Column:
    """pre_treatment only for names on the audited lists; the lists are parameters."""
    known = (
        [*base] + [f"pa__{c}" for c in covariates] + [f"ext__{c}" for c in extension]
    )
    return (
        F.when(is_outcome_like(name), "post_treatment_or_outcome_proxy")
        .when(name.isin(known), "pre_treatment")
        .otherwise("unknown")
    )


def variation_label(share: Column) -> Column:
    return F.when(share >= 0.60, "high").when(share >= 0.30, "medium").otherwise("low")


def _named_or_self(atoms: Column, feature: Column) -> Column:
    """Fall back to base columns named inside the feature, then to the feature itself."""
    named = F.filter(
        F.array(*[F.lit(c) for c in ("is_academia_origin", "pub_year_alt", "recency_years_alt")]),
        lambda c: F.contains(feature, c),
    )
    return (
        F.when(feature == "", F.array().cast("array<string>"))
        .when(F.size(atoms) > 0, atoms)
        .when(F.size(named) > 0, named)
        .otherwise(F.array(feature))
    )


def shortlist_atoms(feature: Column) -> Column:
    """Each 'pa' or 'ext' segment joined to the segment after it."""
    name = F.trim(F.coalesce(feature, F.lit("")))
    parts = F.split(name, "__")
    pairs = F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p, i: F.when(p.isin("pa", "ext"), F.concat(p, F.lit("__"), F.element_at(parts, i + 2))),
    )
    return _named_or_self(F.array_distinct(F.array_compact(pairs)), name)


def lineage_atoms(feature: Column) -> Column:
    """Source column of a one-hot level, else every maximal pa__/ext__ token."""
    name = F.trim(F.coalesce(feature, F.lit("")))
    parts = F.split(name, "__")
    tokens = F.array_distinct(F.regexp_extract_all(name, F.lit("((?:pa|ext)__[a-zA-Z0-9_]+)"), F.lit(1)))
    level = F.startswith(name, F.lit("cat__")) & (F.size(parts) >= 3)
    return F.when(level, F.array(F.element_at(parts, 2))).otherwise(_named_or_self(tokens, name))


def contribution_atoms(factor: Column) -> Column:
    """Operands of an expression feature, source of a one-hot level, else the name itself."""
    name = F.trim(F.coalesce(factor, F.lit("")))

    def operands(prefix: str, separator: str | None) -> Column:
        rest = F.substring(name, len(prefix) + 1, 1_000_000)
        if separator is None:
            parts = F.array(rest)
        else:
            at = F.locate(separator, rest)
            parts = F.when(
                at > 0,
                F.array(
                    F.substr(rest, F.lit(1), at - 1),
                    F.substr(rest, at + len(separator)),
                ),
            ).otherwise(F.array().cast("array<string>"))
        kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
        return F.when(F.size(kept) > 0, kept).otherwise(F.array(name))

    level_source = F.trim(F.regexp_extract(name, r"^cat__(.*)__.*$", 1))
    return (
        F.when(name.isin("", "(base_controls)"), F.array().cast("array<string>"))
        .when(
            F.startswith(name, F.lit("cat__")),
            F.when(level_source != "", F.array(level_source)).otherwise(F.array(name)),
        )
        .when(F.startswith(name, F.lit("expr__slog1p__")), operands("expr__slog1p__", None))
        .when(F.startswith(name, F.lit("expr__sq__")), operands("expr__sq__", None))
        .when(F.startswith(name, F.lit("expr__ratio__")), operands("expr__ratio__", "__over__"))
        .when(F.startswith(name, F.lit("expr__diff__")), operands("expr__diff__", "__minus__"))
        .when(F.startswith(name, F.lit("expr__mul__")), operands("expr__mul__", "__x__"))
        .otherwise(F.array(name))
    )


def signature(atoms: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(atoms)), "|")


def slug(text: Column, empty: str) -> Column:
    """Lower case, runs of other characters become one underscore, no underscore at the ends."""
    body = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(body == "", empty).otherwise(body)


def level_token(level: Column, max_len: int = 48) -> Column:
    """Readable slug of a level plus eight hash digits, at most max_len characters."""
    body = slug(level, "empty")
    body = F.when(body.rlike("^[0-9]"), F.concat(F.lit("v_"), body)).otherwise(body)
    suffix = F.concat(F.lit("_h"), F.substring(F.sha2(level, 256), 1, 8))
    return F.concat(F.substring(body, 1, max(8, max_len - 10)), suffix)


def clean_level(col: Column) -> Column:
    """Trimmed text; blanks and the usual spellings of missing become null."""
    text = F.trim(col.cast("string"))
    return F.when(F.lower(text).isin("", "na", "nan", "none", "null"), None).otherwise(text)


def tier_order(tier: Column) -> Column:
    """0 validated, 1 support, 2 exploratory, 9 anything else."""
    return (
        F.when(tier == "validated_candidate", 0)
        .when(tier == "support_candidate", 1)
        .when(tier == "exploratory", 2)
        .otherwise(9)
    )
