"""Session, tables and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders written by ``cut``, deleted when Python ends.
_WRITTEN: list[tuple[SparkSession, str]] = []


def session(cpus: int = 8, memory: str = "8g", name: str = "pointloom") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("FATAL")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settings(spark: SparkSession, folder: str) -> dict[str, float]:
    """The table ``settings`` (a fixed, small number of rows) as a dictionary."""
    return {r["setting"]: r["setting_value"] for r in table(spark, folder, "settings").collect()}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of this machine where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = f"file://{tempfile.gettempdir()}/pointloom-checkpoints"
        spark.conf.set("pointloom.local.folder", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and lost executors cost nothing.

    Parquet rather than ``checkpoint()``, as columns are compressed and later readers prune them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for this very frame: nothing that is still to be computed may read it."""
    path = getattr(df, "_cut_path", None)
    entry = (df.sparkSession, path)
    if path and entry in _WRITTEN and _delete(*entry):
        _WRITTEN.remove(entry)


def _delete(spark: SparkSession, path: str) -> bool:
    if path.startswith("file:"):
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
        return True
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))
    except Exception:  # noqa: BLE001 - the session may be gone; nothing else depends on these folders
        return False


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        if not _delete(spark, path):
            return


def finite(*columns: str | Column) -> Column:
    """True where every column is neither NULL, NaN nor infinite."""
    test = F.lit(True)
    for c in columns:
        c = F.col(c) if isinstance(c, str) else c
        test = test & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return test


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, whatever else the table holds; a missing one is a clear error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


