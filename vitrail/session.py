"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "vitrail", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; `conf` keys use __ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application; on a local
    master only if the driver's own path doesn't show it to the workers."""
    import os
    import tempfile
    import zipfile
    from pathlib import Path

    package = Path(__file__).resolve().parent
    root = str(package.parent)
    sc = spark.sparkContext
    here = os.getcwd() == root or root in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if getattr(sc, "_vitrail_shipped", False) or here and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="vitrail-"), "vitrail.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(path)
    sc._vitrail_shipped = True
