"""What a cluster needs: the folder that all share, rows on all cores, and the package on executors that don't have it."""

from __future__ import annotations

import hashlib
import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Inputs up to so many bytes are dealt out anew where much work is done on each row.
SMALL_INPUT = 32 << 20
_shipped: set[str] = set()
#: Used only where the session names no shared folder and all of Spark is on this machine (tests).
LOCAL_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset on one machine.

    RuntimeError on a cluster without the setting: executors would not see one another's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = LOCAL_DIR
    return base.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its input is a few small files, which are few tasks otherwise. No result depends on it, and larger inputs are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL_INPUT and len(df.inputFiles()) < cores else df


def ship(spark: SparkSession) -> None:
    """Send the package's source to this application's Python workers, once.

    The archive is written to the folder in spark.checkpoint.dir, which all executors share; where that is unset (one machine),
    to a temporary folder. Installed packages need no shipping, but it does no harm.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId in _shipped or not root.is_dir():
        return
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(Path(root.name) / p.relative_to(root))), p.read_bytes())
    name = f"{root.name}-{hashlib.sha256(raw.getvalue()).hexdigest()[:12]}.zip"
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = f"{base.rstrip('/')}/{sc.applicationId}-{name}"
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        stream = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
        try:
            stream.write(bytearray(raw.getvalue()))
        finally:
            stream.close()
    else:
        path = str(Path(tempfile.mkdtemp()) / name)
        Path(path).write_bytes(raw.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
