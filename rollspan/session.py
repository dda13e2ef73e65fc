"""Session defaults and the shared checkpoint folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(cpus="*", partitions=8, app="rollspan", master=None):
    """A session with the settings the operators are written for.

    A running session is taken as it is. `master` names a cluster; without one the
    session is local. A window plan turns each shuffled byte into many output rows, so
    small shuffle partitions are kept apart instead of being merged into one task.
    """
    running = SparkSession.getActiveSession()
    if running is not None:
        return running
    return (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark):
    """Point reliable checkpoints at the folder the session names.

    A private folder is created only for a local master, where one machine holds
    every task; a cluster without a configured shared folder is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def cut(df):
    """Cut lineage: write a table to the shared checkpoint folder and read it back.

    Unlike an RDD checkpoint the copy keeps column pruning, filter pushdown and a
    size Spark can plan with. It survives lost executors.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CLEARED = []


def when_cleared(forget):
    """Call `forget(spark)` whenever a session's scratch tables are deleted."""
    _CLEARED.append(forget)
    return forget


def clear_scratch(spark):
    """Delete the tables that this session wrote to its folder of the shared one.

    Their DataFrames cannot be read afterwards; call it when a run is over.
    """
    for forget in _CLEARED:
        forget(spark)
    folder = spark.sparkContext.getCheckpointDir()
    if folder is not None:
        delete(spark, folder)


def delete(spark, name):
    """Delete a file or folder of any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df):
    """Deal out rows that each become many: a scan would pack their few bytes into few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def scratch(spark):
    """A fresh path in the shared checkpoint folder for a written table."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
