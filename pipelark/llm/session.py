"""What the operators need of a Spark session besides its tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]

#: The applications whose workers have been sent this package.
_sent: set[str] = set()


def on_one_machine(sc: SparkContext) -> bool:
    """Whether driver and workers see the same folders."""
    return sc.master.startswith("local") and not sc.master.startswith("local-cluster")


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package, and give checkpoints a folder.

    Workers on other machines are sent the package.  The checkpoint folder is the
    cluster's ``spark.checkpoint.dir``; a folder of our own is made only where that
    is unset and all run on one machine (tests), and elsewhere refused, as other
    machines would not see it.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        if on_one_machine(sc):
            known = sc.environment.get("PYTHONPATH", "")
            sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in (str(ROOT), known) if p)
        else:
            sc.addPyFile(_packed())
        _sent.add(sc.applicationId)
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not on_one_machine(sc):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="pipelark-checkpoint-"))
    return spark


def _packed() -> str:
    """This package as an archive, which Spark hands to the workers."""
    path = f"{tempfile.mkdtemp(prefix='pipelark-')}/pipelark.zip"
    package = Path(__file__).resolve().parents[1]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(ROOT))
    return path


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    Lost executors don't matter afterwards, and what reads the result twice
    sees the same rows in the same partitions.  Files go as
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` says.
    """
    ready(df.sparkSession)
    return df.checkpoint(eager=True)
