"""Cutting lineage through the folder that driver and executors share, and sending this package to the workers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; where it is unset on a local master, as in tests, a temporary one. On a cluster that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _OWN:
        _OWN.append(f"file://{tempfile.mkdtemp(prefix='treeline-')}")
    return _OWN[0]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder, unless the session has a folder for them."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its rows in the shared folder and no lineage: lost executors lose nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again; the table goes when the driver's process ends.

    Unlike a checkpoint's, its plan carries none of the constraints that were inferred before, so loops that join their
    own results plan as fast in the last round as in the first.
    """
    path = scratch_folder(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new name in the shared folder; what is put there goes when the driver's process ends."""
    path = f"{shared_folder(spark)}/treeline-{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        return


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once a session: their Python workers import it by name."""
    sc = spark.sparkContext
    if getattr(sc, "_treeline_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="treeline-src-")) / "treeline_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(target))
    sc._treeline_shipped = True
