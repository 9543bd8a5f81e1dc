"""Reading inputs: dyad tables, feature tables, assignments, registries, contexts, run outputs."""

from __future__ import annotations

import csv
import hashlib
import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadscope.functions.names import slug
from dyadscope.operators.prepare import GROUP_MODES, REQUIRED_COLUMNS, require_columns
from dyadscope.operators.runs import first_timestamp, infer_mode, infer_state, latest_per_run
from dyadscope.session import ship_package

ORDER_COLUMNS = ("_file", "_block", "_line")


def read_table(spark: SparkSession, path: str | Sequence[str], *, in_order: bool = False) -> DataFrame:
    """CSV with a header (every column as text) or Parquet, by suffix.

    Text columns are coerced where they are used, so one odd value never changes a column's type.
    With `in_order`, three columns give the input position of each row.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if all(p.rstrip("/").endswith((".parquet", ".pq")) for p in paths):
        df = spark.read.parquet(*paths)
    else:
        df = spark.read.csv(paths, header=True, inferSchema=False, multiLine=False, escape='"')
    return with_order(df) if in_order else df


def with_order(df: DataFrame) -> DataFrame:
    """Input position of file rows: file, block start, and a number rising inside the block."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def input_order() -> list[Column]:
    return [F.col(c) for c in ORDER_COLUMNS]


def read_dyads(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Dyad base table; every required column must be there, others come along as text."""
    df = read_table(spark, path)
    require_columns(df)
    return df


def dyad_schema(extra: Sequence[str] = ()) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in (*REQUIRED_COLUMNS, *extra)])


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Feature registry from a JSON list, or from a document holding one under feature_registry."""
    raw = spark.read.json(path, multiLine=True)
    if "feature_registry" in raw.columns:
        raw = raw.select(F.explode("feature_registry").alias("r")).select("r.*")
    if "feature_name" not in raw.columns:
        raise ValueError(f"feature registry must be a JSON list or hold feature_registry: {path}")
    return raw.where(F.col("feature_name").isNotNull())


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Outcome contexts from a JSON list or {contexts: [...]}, in file order.

    Result: position, context_scope, y_col, source_cols, group_mode, threshold. A context with
    source columns derives its outcome; one without must name a y_col.
    """
    shape = "struct<context_scope string, context_name string, name string, y_col string, source_cols array<string>, group_mode string, threshold int>"
    text = spark.read.text(path, wholetext=True)
    listed = F.when(
        F.substring(F.ltrim("value"), 1, 1) == "{", F.from_json("value", f"struct<contexts: array<{shape}>>")["contexts"]
    ).otherwise(F.from_json("value", f"array<{shape}>"))
    rows = text.select(F.posexplode(listed).alias("position", "c"))
    filled = [F.when(F.trim(f"c.{n}") != "", F.col(f"c.{n}")) for n in ("context_scope", "context_name", "name")]
    scope = slug(F.coalesce(*filled, F.lit("")), "unnamed_context")
    sources = F.filter(F.coalesce("c.source_cols", F.array().cast("array<string>")), lambda c: F.trim(c) != "")
    y = F.trim(F.coalesce("c.y_col", F.lit("")))
    return rows.select(
        "position",
        scope.alias("context_scope"),
        F.when(y != "", y).when(F.size(sources) > 0, F.concat(F.lit("y_group__"), scope)).otherwise("").alias("y_col"),
        sources.alias("source_cols"),
        F.lower(F.trim(F.coalesce("c.group_mode", F.lit("any_positive")))).alias("group_mode"),
        F.col("c.threshold").alias("threshold"),
    )


def merge_contexts(defaults: DataFrame, given: DataFrame, mode: str = "append") -> DataFrame:
    """Default contexts then given ones (or given ones only), the first of equal pairs kept."""
    if mode not in ("append", "replace"):
        raise ValueError("merge mode must be append or replace")
    given = given.select((F.col("position") + 1_000_000).alias("position"), "context_scope", "y_col")
    rows = given if mode == "replace" else defaults.select("position", "context_scope", "y_col").unionByName(given)
    return rows.groupBy("context_scope", "y_col").agg(F.min("position").alias("position"))


def check_contexts(contexts: DataFrame, available: Sequence[str]) -> list[dict]:
    """Contexts as configuration rows, with the errors a run must stop on."""
    rows = [r.asDict() for r in contexts.orderBy("position").collect()]
    for r in rows:
        sources = r.get("source_cols") or []
        missing = [c for c in sources if c not in available]
        if missing:
            raise ValueError(f"y-contexts[{r['position']}] missing source columns: {missing}")
        if sources and r["group_mode"] not in GROUP_MODES:
            raise ValueError(f"y-contexts[{r['position']}] unsupported group_mode={r['group_mode']}")
        if not sources and not r["y_col"]:
            raise ValueError(f"y-contexts[{r['position']}] must provide y_col or source_cols")
        if not sources and r["y_col"] not in available:
            raise ValueError(f"y-contexts[{r['position']}] y_col not found in data: {r['y_col']}")
    return rows


RUN_DOCUMENT = (
    "run_id string, mode string, status string, timestamp_utc_finished string, timestamp_utc string, timestamp string, "
    "generated_at_utc string, outputs map<string,string>, counts map<string,string>, search_governance string, "
    "validation_used_for_search string, candidate_pool_locked_pre_validation string"
)


def read_run_history(spark: SparkSession, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """Latest document per run over (source kind, glob) pairs; later kinds and files win ties."""
    parts = []
    for i, (kind, pattern) in enumerate(patterns):
        docs = spark.read.schema(RUN_DOCUMENT).json(pattern, multiLine=True)
        parts.append(
            docs.select(
                F.trim("run_id").alias("run_id"),
                F.when(F.trim(F.coalesce("mode", F.lit(""))) != "", F.trim("mode")).otherwise(infer_mode(F.col("run_id"))).alias("mode"),
                infer_state(F.col("status")).alias("state"),
                first_timestamp(F.col("timestamp_utc_finished"), F.col("timestamp_utc"), F.col("timestamp"), F.col("generated_at_utc")).alias("updated_at"),
                F.lit(kind).alias("source_kind"),
                "outputs",
                F.map_filter(F.transform_values("counts", lambda _, v: v.try_cast("bigint")), lambda _, v: v >= 0).alias("counts"),
                "search_governance",
                "validation_used_for_search",
                "candidate_pool_locked_pre_validation",
                F.struct(F.lit(i).alias("kind"), F.col("_metadata.file_path").alias("path")).alias("source_order"),
            )
        )
    entries = parts[0]
    for part in parts[1:]:
        entries = entries.unionByName(part)
    return latest_per_run(entries)


INFERENCE_COLUMNS = (
    "candidate_id", "track", "context_scope", "y_col", "spec_id", "key_factor", "status_validation", "candidate_tier",
    "p_boot_validation", "q_value_validation", "validated_rate_restart",
)
# Old outputs use other names for p and q.
OLD_NAMES = {"p_boot_validation": "p_value_validation", "q_value_validation": "q_value"}


def _path_part(path: str) -> str:
    """A path without scheme and host, decoded: file paths in Spark's metadata are URIs."""
    return unquote(urlparse(path).path) if "://" in path or path.startswith("file:") else path


def first_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, value) of the first line of every text file; a file begins with the block at 0.

    The number of a file's first line is found first: a minimum of numbers is a hash aggregate, of texts it would
    sort all lines of a block.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("at")
    )
    heads = lines.where("start = 0").groupBy("file").agg(F.min("at").alias("at"))  # a row a file
    return lines.join(F.broadcast(heads), ["file", "at"]).select("file", "value")


def read_inference(spark: SparkSession, runs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Inference rows of many runs, tagged (run_id, mode), from (run_id, mode, path); lacking columns are null.

    Columns go by the name in each file's own header: files are read in groups of equal headers.
    Rows belong to the run whose full path is theirs, or a folder above it.
    """
    owners: dict[str, list[tuple[str, str]]] = {}
    for run_id, mode, path in runs:
        owners.setdefault(_path_part(path).rstrip("/"), []).append((run_id, mode))
    paths = list(dict.fromkeys(p for _, _, p in runs))
    columnar = [p for p in paths if p.rstrip("/").endswith((".parquet", ".pq"))]
    groups: dict[str, list[str]] = {}
    for file, header in first_lines(spark, [p for p in paths if p not in columnar]).collect() if len(columnar) < len(paths) else []:
        groups.setdefault(header, []).append(file)
    tables = [spark.read.parquet(p) for p in columnar]
    for header, files in groups.items():
        names = next(csv.reader([header.lstrip("\ufeff")]), [])
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        tables.append(spark.read.csv([unquote(f) for f in files], header=True, schema=schema, multiLine=False, escape='"', enforceSchema=True))
    parts = []
    for df in tables:
        columns = []
        for c in INFERENCE_COLUMNS:
            source = c if c in df.columns else OLD_NAMES.get(c, "")
            columns.append((F.col(source).cast("string") if source in df.columns else F.lit(None).cast("string")).alias(c))
        parts.append(df.select(F.col("_metadata.file_path").alias("_file"), *columns))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in ("run_id", "mode", *INFERENCE_COLUMNS)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    # One row a file: its path names the run, itself or by a folder above it.
    tags = []
    for (file,) in rows.select("_file").distinct().collect():
        at = _path_part(file)
        while at and at not in owners:
            at = at.rpartition("/")[0]
        tags += [(file, *owner) for owner in owners.get(at, [])]
    named = rows.join(F.broadcast(spark.createDataFrame(tags, "_file string, run_id string, mode string")), "_file")
    return named.select("run_id", "mode", *INFERENCE_COLUMNS)


def head_rows(df: DataFrame, n: int | None, order: Sequence[str] = ()) -> DataFrame:
    """First n rows for a quick profile, by the order columns if given; the whole table when n is not given."""
    if n is None:
        return df
    return (df.orderBy(*order) if order else df).limit(max(1, int(n)))


def file_listing(spark: SparkSession, pattern: str) -> DataFrame:
    """Path, size and modification time of matching files; contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("n_bytes"), "modificationTime")


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    row = file_listing(spark, pattern).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
    return row["path"] if row else None


def resolve_input(spark: SparkSession, locked: str, pattern: str) -> tuple[str, str]:
    """The locked default when it exists, else the newest match, else the default marked missing."""
    from pyspark.errors import AnalysisException

    for candidate, provenance in ((locked, "default_locked"), (pattern, "fallback_latest_glob")):
        try:
            found = latest_file(spark, candidate)
        except AnalysisException:
            found = None
        if found:
            return found, provenance
    return locked, "missing_default_no_fallback"


def file_manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """Path, size and sha256 per file.

    Files of up to `WHOLE_FILE` bytes are hashed by Spark where they are read. A task holds such a file
    several times over, so larger ones are listed only, and streamed piece by piece inside a task from
    the file system that their path names. Where Spark alone can open that, files of up to
    `WHOLE_ONLY` bytes are whole values too.
    """
    ship_package(spark)
    listed = file_listing(spark, pattern).select("path", "n_bytes")
    tried = listed.where(F.col("n_bytes") > WHOLE_FILE).limit(1).mapInPandas(_try_stream, "opens boolean").first()
    most = WHOLE_FILE if tried is None or tried["opens"] else WHOLE_ONLY
    small = spark.read.format("binaryFile").load(pattern).where(F.col("length") <= most)
    large = listed.where(F.col("n_bytes") > most)
    hashed = small.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
    return hashed.unionByName(large.mapInPandas(_stream_hashes, "path string, n_bytes bigint, sha256 string"))


#: Largest file that is read as one value; the same where pyarrow does not open the file system.
WHOLE_FILE, WHOLE_ONLY = 1 << 24, 1 << 30


def _open_stream(path: str):
    """Bytes of a file by the path Spark gives it, as they are stored."""
    from pyarrow import fs

    uri = re.sub("^file:/+", "file:///", path)
    store, name = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
    return store.open_input_stream(name, compression=None)


def _try_stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whether pyarrow opens a file inside a task; Spark knows more file systems."""
    import pyarrow as pa

    for batch in batches:
        found = []
        for path in batch["path"]:
            try:
                _open_stream(path).close()
                found.append(True)
            except (OSError, pa.ArrowException):
                found.append(False)
        yield pd.DataFrame({"opens": found})


def _stream_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for path in batch["path"]:
            digest = hashlib.sha256()
            with _open_stream(path) as stream:
                while piece := stream.read(1 << 22):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield batch.assign(sha256=found)
