"""Spark session with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that change results; the others only change speed.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(app: str = "metaladder", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on, UTC and last-wins map keys. ``conf`` overrides any setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = SEMANTICS | {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package from where it lies."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark
