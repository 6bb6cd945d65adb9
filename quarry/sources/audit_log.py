"""An append-only log of tool invocations as JSON lines, a folder a day, without secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluation import redact

SCHEMA = "at timestamp, tool string, arguments map<string, string>, took_ms double, status string, summary string"


def append(rows: DataFrame, path: str) -> None:
    """Adds rows (at, tool, arguments, took_ms, status, summary); values of arguments that look like credentials are redacted first, and earlier lines stay as they are."""
    safe = rows.withColumns({"at": F.col("at").cast("timestamp"), "arguments": F.transform_values("arguments", lambda _, v: redact(v)), "summary": redact(F.col("summary")), "took_ms": F.round("took_ms", 2)})
    line = F.to_json(F.struct(*[x.split()[0] for x in SCHEMA.replace("map<string, string>", "map").split(", ")]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    safe.select(line.alias("value"), F.to_date("at").alias("day")).write.mode("append").partitionBy("day").text(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """The log as rows, with the day of each; a filter on it reads that day's folder."""
    lines = spark.read.text(path)
    parsed = F.from_json("value", SCHEMA, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return lines.select(parsed.alias("r"), "day").select("r.*", "day")
