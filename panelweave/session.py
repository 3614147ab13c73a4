"""Session settings and fault-tolerant materialisation."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Off by default in Spark: split a hot join partition even when that costs one more exchange.
# Adaptive execution and its skew join are on by default and left as the session has them.
ADAPTIVE = {"spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}


def tune(spark: SparkSession) -> SparkSession:
    """Let the adaptive skew join act everywhere unless the caller configured it."""
    chosen = spark.sparkContext.getConf()
    for key, value in ADAPTIVE.items():
        if not chosen.contains(key):
            spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  name: str = "panelweave", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    # checkpoints go when nothing refers to them any more
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir. A local session that names none, as in tests, gets a
    temporary one, which goes with the driver; a cluster must name one that all executors share."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="panelweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)


def durable(df: DataFrame) -> DataFrame:
    """Materialise to the shared checkpoint folder: survives lost executors and
    freezes the partition layout."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
