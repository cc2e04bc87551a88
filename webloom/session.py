"""Session helpers: settings for tests and benches, and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: set[str] = set()


def local_session(cores: str = "*", app: str = "webloom", memory: str = "6g", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where that setting is absent on a local master is a temporary folder chosen; on a cluster a
    missing setting is an error, since a machine-local folder would lose data with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    own = os.path.join(tempfile.gettempdir(), f"webloom-{os.getpid()}")
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(shutil.rmtree, own, True)
    return own


_STAGED: list[str] = []


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and return it read back: cuts lineage, survives executors.

    Results read such tables as long as they are used; drop_staged removes them when a caller is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_mark() -> int:
    """How many tables were staged so far, to drop only later ones."""
    return len(_STAGED)


def drop_staged(spark: SparkSession, since: int = 0) -> int:
    """Remove the tables this process staged (after the mark `since`); frames that read them are of no use then."""
    gone = _STAGED[since:]
    del _STAGED[since:]
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(gone)
