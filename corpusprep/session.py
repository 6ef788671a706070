"""Session helpers: building a local session for tests/bench and locating the
shared checkpoint folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Rows a side may have to be broadcast. Everything we broadcast is bounded by a
# parameter (vocabulary size, partition count, holdout size) and is checked
# against this before a broadcast hint is given.
BROADCAST_ROW_LIMIT = 2_000_000


def build_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "corpusprep", extra: dict | None = None) -> SparkSession:
    """A local session configured the way the tests and the bench run."""
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("CORPUSPREP_DRIVER_MEM", "16g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Taken from the context or from ``spark.checkpoint.dir``. Only a local-mode
    session (tests, bench) without one gets a fresh temporary folder; on a
    cluster a missing setting is an error, never a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            conf_dir = None
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if sc.master.startswith("local"):
        d = tempfile.mkdtemp(prefix="corpusprep-ckpt-")
        sc.setCheckpointDir(d)
        return d
    raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")


def reliable_checkpoint(df):
    """Materialise ``df`` in the shared checkpoint folder (survives executor loss,
    fixes partition borders for later passes)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if(df, rows: int, limit: int = BROADCAST_ROW_LIMIT):
    """``df`` with a broadcast hint when its known number of rows allows it."""
    from pyspark.sql import functions as F
    return F.broadcast(df) if rows <= limit else df


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in the Python workers wherever the driver was
    started: once per context, a zip of its sources goes out with the job files."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusprep_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="corpusprep-src-"), "corpusprep-src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("corpusprep", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._corpusprep_shipped = True
