"""Session helpers: building a session for tests/bench and finding the shared scratch folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def _half_memory() -> str:
    """Half of this machine's memory, for the one JVM of a local session."""
    return f"{max(1024, os.sysconf('SC_PAGE_SIZE') * os.sysconf('SC_PHYS_PAGES') // (2 << 20))}m"


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "veritab") -> SparkSession:
    """Local session used by tests and the bench. On a cluster, pass your own session instead."""
    master = master or os.environ.get("VERITAB_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("VERITAB_DRIVER_MEMORY") or _half_memory())
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by whoever runs the job (a shared file system path).
    Only a local session may do without: it gets a temporary folder. Any other master raises.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        conf_dir = tempfile.mkdtemp(prefix="veritab-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def collect_garbage(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files and checkpoints of frames that are gone: it does so when the driver collects its
    garbage, which a driver with memory to spare may not do during a whole job."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for derived files (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/veritab-{name}-{uuid.uuid4().hex[:12]}"


def ship_sources(spark: SparkSession) -> None:
    """Give the executors this package's sources, as ``--py-files`` does, once for each Spark context."""
    sc = spark.sparkContext
    if not getattr(sc, "_veritab_shipped", False):
        root = Path(__file__).resolve().parent
        file = Path(tempfile.mkdtemp(prefix="veritab-")) / "veritab.zip"
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(file))
        sc._veritab_shipped = True
