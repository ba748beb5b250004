"""Session settings, bounds of Arrow batches and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks. On a cluster, bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("slipstream")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Small files, so that small data still spreads over all cores. The
        # defaults (64 MB and up) are right for a cluster.
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.files.openCostInBytes", "256k")
        .getOrCreate()
    )


def bound_batches(spark: SparkSession) -> None:
    """Rows reach Python in Arrow batches of about BATCH_BYTES, unless the cluster was set up with a bound of its own.

    Spark's own bound is 64 MB; executor and Python worker both hold a batch, for every core and every operator of a
    task, and the executor holds it twice while its buffer grows.
    """
    if not spark.sparkContext.getConf().contains(_BATCH_CONF):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see, as the cluster names it.

    Only where the session names none (a plain local run) is one made up.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named
    made = spark.sparkContext.getCheckpointDir()
    if made is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="slipstream-"))
        made = spark.sparkContext.getCheckpointDir()
    return made


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/{app}-{uuid.uuid4().hex[:12]}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    What follows starts from the written table: it survives the loss of any
    executor, and reads only the columns it needs.
    """
    path = scratch_table(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
