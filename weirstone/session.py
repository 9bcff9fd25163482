"""Session defaults and the shared folder for lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "weirstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution. Other settings are the cluster's business."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    It is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset, a session on one machine (as in tests) gets a folder of
    its own; on a cluster it is an error, since other hosts couldn't read what a host keeps to itself.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all hosts share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weirstone-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder, with its lineage cut."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table into the shared folder and read back, for results that several branches read.

    Columnar and compressed, it takes less room than a checkpoint. The tables of a session stand in one folder below ``spark.checkpoint.dir``;
    :func:`drop_written` removes them.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside leave no shuffle files behind, so the disk holds those of one query at a time.

    For steps whose results are written or collected at once; a DataFrame that is run a second time would shuffle again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def shared_path(spark: SparkSession, name: str = "table") -> str:
    """A path of its own in the shared folder."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_written(spark: SparkSession) -> int:
    """Removes the tables that :func:`written` left in this session's folder, once their results have been used; gives their number."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    old = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("table-")]
    return sum(fs.delete(p, True) for p in old)
