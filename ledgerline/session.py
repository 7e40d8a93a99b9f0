"""A session with the settings this library expects."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "ledgerline", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew joins, UTC, Arrow; a cluster's own settings for memory and shuffles stay."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


_SHIPPING = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that their Python workers can import it; threads may call it at once."""
    sc = spark.sparkContext
    with _SHIPPING:
        if getattr(sc, "_ledgerline_shipped", False):
            return
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="ledgerline-")) / "ledgerline.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"ledgerline/{p.relative_to(root)}")
        sc.addPyFile(str(target))
        sc._ledgerline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: spark.checkpoint.dir, or where that is unset a folder of this machine for local runs."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "ledgerline-checkpoints")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: lost executors can't lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a folder has been written to, in whatever store Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(at)) and any(f.isDirectory() and not f.getPath().getName().startswith(("_", ".")) or f.getPath().getName().startswith("part-") for f in fs.listStatus(at))


def empty_files(spark: SparkSession, path: str, ending: str) -> list[str]:
    """The files of no bytes below a path, in whatever store Spark reads; no scan reports them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    found = []
    while listed.hasNext():
        f = listed.next()
        if not f.getLen() and f.getPath().getName().endswith(ending):
            found.append(f.getPath().toString())
    return found
