"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_verbaloom_shipped", False):
        return
    here = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="verbaloom-"))
    shutil.copytree(here, to / "src" / here.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(to / here.name), "zip", to / "src"))
    sc._verbaloom_shipped = True


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One of the test tables, as a lazy scan."""
    ship(spark)
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the master is
    local (tests), a temporary folder of this machine takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.gettempdir()}/verbaloom-{spark.sparkContext.applicationId}"
    Path(own[7:]).mkdir(parents=True, exist_ok=True)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; what is in it goes when the session's process ends, or by ``release``."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _remember(spark, path)
    return path


def _remember(spark: SparkSession, path: str) -> None:
    made = spark.sparkContext.__dict__.setdefault("_verbaloom_scratch", [])
    if not made:
        atexit.register(release, spark)
    made.append(path)


def release(spark: SparkSession) -> None:
    """Delete this session's checkpoints and stored tables. Results not yet read may depend on them."""
    made = spark.sparkContext.__dict__.get("_verbaloom_scratch", [])
    while made:
        path = made.pop()
        with contextlib.suppress(Exception):  # the JVM may be gone
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage by a table in columns in the shared folder: for wide rows of which later steps read a part."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def weighed(spark: SparkSession) -> SparkSession:
    """A session with this one's settings for tables of few, large texts that begin alike; its own settings reach no other query.

    Parquet's writers weigh what they hold after every row: by default they hold 100 rows whatever their size, too much for
    an executor at megabytes a row. A text is stored as what differs from the one before it, if both are in one page of
    the file, so a page may grow. A reader makes whole texts of a group of rows at once, so a group has few.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for k, v in WEIGHED.items():
        own.conf.set(k, v)
    return own


#: Version 2 stores texts by what they share with the one before, where no dictionary is tried first; a page's size counts what is stored then,
#: else whole texts. The least and greatest text are too long for the file's foot, so they aren't looked for.
WEIGHED = {
    "parquet.page.size.row.check.min": "1",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.page.size": str(64 << 20),
    "parquet.block.row.count.limit": "64",
    "parquet.enable.dictionary#html": "false",
    "parquet.column.statistics.enabled#html": "false",
    "spark.sql.parquet.compression.codec": "zstd",
}


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    own = sc._jsc.sc().getCheckpointDir().get()
    if own not in sc.__dict__.setdefault("_verbaloom_checkpoints", set()):
        sc._verbaloom_checkpoints.add(own)
        _remember(df.sparkSession, own)
    return df.checkpoint(eager=True)
