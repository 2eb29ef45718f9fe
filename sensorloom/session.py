"""Session helpers.

The library never creates its own scratch space on a machine-local path:
``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the session (the
shared folder the cluster names) and only falls back to a scratch folder
when the setting is missing, which is the case in unit tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale.  AQE re-plans joins and coalesces
# shuffle partitions from runtime statistics; skew-join splits hot keys.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "sensorloom", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session (set one if unset)."""
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # One machine (unit tests): its own folder will do.
        path = tempfile.mkdtemp(prefix="sensorloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    try:  # classic sessions: RDD checkpoints (DataFrame.checkpoint) use the same folder
        jsc = spark.sparkContext._jsc
        if jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(path)
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext; the server's setting applies
        pass
    return path


def commit_folder(spark: SparkSession, staged: str, final: str) -> None:
    """Make a written folder visible under its final name in one step; an error if that name exists."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    hadoop = jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = hadoop.FileContext.getFileContext(hadoop.Path(final).toUri(), conf) if "://" in final else hadoop.FileContext.getFileContext(conf)
    context.mkdir(hadoop.Path(os.path.dirname(final)), hadoop.permission.FsPermission.getDirDefault(), True)
    options = gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.NONE
    context.rename(hadoop.Path(staged), hadoop.Path(final), options)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder for sinks and stream state."""
    return os.path.join(checkpoint_dir(spark), "sensorloom", *parts)
