"""Session settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Reports can be long; keep the batches sent to Python small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # A second copy of a labelling task would pay for its calls again.
    "spark.speculation": "false",
}


def session(app: str = "tallymark", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings above; ``extra`` adds or overrides (a__b means a.b)."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
