"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared checkpoint folder the cluster names.

    `spark.checkpoint.dir` is read from the session. Only where it is unset
    (local tests) a temporary folder of this machine is used.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="frameloom-ckpt-"))
    else:
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per application.

    A zip of the package is handed to the executors, so neither a PYTHONPATH nor
    an installation is needed there.
    """
    sc = spark.sparkContext
    if getattr(sc, "_frameloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="frameloom-zip-")) / "frameloom_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._frameloom_shipped = True
