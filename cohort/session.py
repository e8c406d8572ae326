"""Session helpers: a configured local session for tests/bench, and the
checkpoint folder read from the session (``spark.checkpoint.dir``)."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale; all are plain Spark configuration.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "cohort") -> SparkSession:
    """Local session used by tests and bench (UI off, AQE on)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g"))
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the session.

    On a cluster the folder must be shared storage named in
    ``spark.checkpoint.dir``; only a local-mode session without that setting
    (tests) gets a fresh scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; name a shared folder for it")
    path = tempfile.mkdtemp(prefix="cohort-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: materialise to the shared checkpoint folder so a
    lost executor does not force recomputation of a long lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if (kept := _PASSING.get()) is not None:
        kept.append(out)
    return out


_PASSING: ContextVar[list | None] = ContextVar("passing", default=None)


@contextmanager
def passing_checkpoints(spark: SparkSession):
    """The checkpoints that this thread writes inside are deleted at the end: for
    one of many jobs whose result is written elsewhere."""
    token = _PASSING.set([])
    try:
        yield
    finally:
        made = _PASSING.get()
        _PASSING.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for df in made:
            at = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
            if at.isDefined():
                path = spark._jvm.org.apache.hadoop.fs.Path(at.get())
                path.getFileSystem(conf).delete(path, True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint location for written intermediate
    tables (shared storage on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "cohort-scratch", name)
