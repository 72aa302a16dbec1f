"""Session set-up shared by tests, the bench and ad-hoc runs.

On a cluster the session comes from the platform; only the semantic settings (time zone, ANSI arithmetic off for
provider data) matter to results and everything else is left to the cluster's own configuration.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "pathloom") -> SparkSession:
    """A local session for tests and benches."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for lineage cuts: the one the cluster names, else a fresh one for local runs only.

    ``spark.checkpoint.dir`` has to be on storage every executor can reach, so that a lost executor costs a re-read
    and not the job. A session on a cluster that names none is an error rather than a silent local folder.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="pathloom-checkpoint-")
    context.setCheckpointDir(configured)
    return context._jsc.sc().getCheckpointDir().get()
