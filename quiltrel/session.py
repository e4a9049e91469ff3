"""Session settings that the engine's semantics rely on."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", **more: str) -> SparkSession:
    return SparkSession.builder.master(master).config(map=SETTINGS | more).getOrCreate()
