"""Sessions, and how a session's workers get this package."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: dict[str, str] = {}


def session(app: str = "ratingmill", **conf: str) -> SparkSession:
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return ship(SparkSession.builder.appName(app).config(map=base | conf).getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's modules to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SENT:
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="ratingmill-")), "ratingmill.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("ratingmill", os.path.relpath(full, top)))
        spark.sparkContext.addPyFile(path)
        _SENT[app] = path
    return spark
