"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def get_session(app: str = "ontoloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (AQE, UTC)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local is a temporary folder used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="ontoloom-")
    return _OWN[app]


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table into the shared folder and read it back.

    The table survives the loss of executors; it is removed when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ontoloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # taken now: the session may have stopped when the process ends, the JVM hasn't
    atexit.register(_remove, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the JVM has ended before
        pass


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast if a count proves it has at most ``max_rows`` rows; else leave the choice to Spark.

    ``df`` should be a stored table, whose count is read from Parquet footers.
    """
    return F.broadcast(df) if df.count() <= max_rows else df
