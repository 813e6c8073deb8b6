"""Session factory and the settings the operators read from a session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once per context, so that they need no copy of the repository."""
    sc = spark.sparkContext
    if getattr(sc, "_tideline_shipped", False):
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tideline-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/tideline_code.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f"tideline/{f.relative_to(home).as_posix()}")
    sc.addPyFile(f"{folder}/tideline_code.zip")
    sc._tideline_shipped = True


def get_session(app: str = "tideline", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests use; a cluster brings its own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
