"""Makes this package importable on executors, wherever the driver runs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def own_folder() -> str:
    """A folder of the driver's for files that are sent with the job; it goes when the driver ends."""
    path = tempfile.mkdtemp(prefix="netloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    if _ROOT.is_dir():
        target = Path(own_folder()) / "netloom_pkg.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(_ROOT.rglob("*.py")):
                z.write(p, p.relative_to(_ROOT.parent))
        sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where Spark itself is local, as in tests."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + own_folder()
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def apply_groups(df: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """applyInPandas over groups (one group without keys), with this package on the executors' path."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(function, schema)


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInPandas, likewise."""
    ship(df.sparkSession)
    return df.mapInPandas(function, schema)
