"""Session helpers: one place for configuration and for cutting lineage.

Long iterative plans are cut by writing a table to the shared folder that the
cluster names in ``spark.checkpoint.dir``; every executor can read it again
after a loss.  Only in local mode, where that setting may be absent, a private
folder is chosen; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_roots: dict[str, str] = {}


def get_spark(app: str = "skein", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects of a cluster."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """Folder of this application below the shared checkpoint folder."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError(f"set {_KEY} to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="skein-")
            spark.conf.set(_KEY, base)
        root = f"{base.rstrip('/')}/skein-{app}"
        _roots[app] = root
        atexit.register(_quiet_remove, spark, root)
    return _roots[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._skein_path = path
    return back


def discard(df: DataFrame | None) -> None:
    """Delete the files of a staged frame that no later plan reads."""
    path = getattr(df, "_skein_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _quiet_remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the context may already be gone
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch, so that batches of long texts fit a Python worker.
BATCH_BYTES = 16 << 20


def text_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound the bytes per Arrow batch of the session; rows per batch stay as they are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per key without sending all rows through a shuffle.

    Only the keys are counted; rows of a key that comes once pass as they are, and
    the others alone are gathered by key.  Beyond a size of keys that come again
    which can be broadcast, the rows are shuffled after all.
    """
    again = broadcast_if_small(stage(df.groupBy(key).count().filter("count > 1").select(key), "again"))
    return df.join(again, key, "left_anti").unionByName(df.join(again, key, "left_semi").dropDuplicates([key]))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """Mark ``df`` for broadcasting only when its estimated size is below ``limit``.

    Beyond the limit the frame comes back unchanged and Spark shuffles the join.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if estimated_bytes(df) <= limit else df
