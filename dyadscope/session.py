"""Session defaults and the shared folder for materialised intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyarrow import dataset, fs
from pyarrow.dataset import Expression
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "dyadscope", master: str | None = None, **conf: str) -> SparkSession:
    """Session for tests and the bench; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is set."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        local = spark.sparkContext.master.startswith("local")
        if not local:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = os.path.join(tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_owners: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Owner of the tables that `cut_lineage` writes inside the block: they are deleted at its end.

    Whatever reads them must have been written out by then.
    """
    owned: list[str] = []
    _owners.append(owned)
    try:
        yield
    finally:
        _owners.remove(owned)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in owned:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write once into the shared folder and go on from the files.

    Lost executors cost no recomputation, and later steps read only the columns they use.
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession) -> str:
    """Path for a new table in the shared folder; the owners of scratch tables delete it."""
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    for owned in _owners:
        owned.append(path)
    return path


def read_in_task(path: str, columns: list[str], where: Expression | None = None) -> pa.Table:
    """Columns of a written table, read inside a task: as small as what it would be sent, and not sent by the driver."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return dataset.dataset(root, filesystem=store, format="parquet").to_table(columns=columns, filter=where)


_shipped: set[str] = set()
#: Bytes of an Arrow batch for Python workers; rows can be long texts.
ARROW_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application; bound their batches where the session does not."""
    app = spark.sparkContext.applicationId
    if spark.sparkContext.getConf().get(ARROW_BYTES[0]) is None:
        spark.conf.set(*ARROW_BYTES)
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-pkg-", dir="/tmp"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
