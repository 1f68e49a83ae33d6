"""Spark session with the settings that the operators count on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Spark 4.1 lets a union keep its children's partitioning; with adaptive execution the children may
#: then be coalesced unalike, and an aggregate above it returns a key twice. So it is turned off.
UNION = "spark.sql.unionOutputPartitioning"


def settle(spark: SparkSession) -> None:
    """Make a session that was built elsewhere fit for the operators: safe unions, and the package on the executors."""
    if spark.conf.get(UNION, None) != "false":
        spark.conf.set(UNION, "false")
    context = spark.sparkContext
    if not getattr(context, "lumenframe_shipped", False):
        context.lumenframe_shipped = True
        context.addPyFile(_archive())


def _archive() -> str:
    """The package as a ZIP in a folder of the driver's own; Spark hands it to the executors."""
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="lumenframe-")) / "lumenframe.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    return str(path)


def build_session(app: str = "lumenframe", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` (dots as ``__``) overrides the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        UNION: "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.appName(app).config(map=settings).getOrCreate()
    settle(spark)
    return spark
