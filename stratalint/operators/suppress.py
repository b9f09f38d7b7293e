"""Suppression markers: of an issue's line and the line before it, the first that has a marker decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalint.functions.config import ScanConfig


def marks(config: ScanConfig) -> str:
    """SQL over hashes, the lines with a number sign: those that have a marker, each with rules and reason."""
    pattern = r"(?U)#\\s*" + config.marker.replace("\\", "\\\\") + r"(?:\\[([^\\]]*)\\])?(?:\\s*:\\s*(.*))?"
    rules = f"filter(transform(split(regexp_extract(h.text, '{pattern}', 1), ','), q -> trim(q)), q -> q <> '')"
    reason = f"nullif(regexp_replace(regexp_extract(h.text, '{pattern}', 2), '(?U)^\\\\s+|\\\\s+$', ''), '')"
    return f"filter(transform(hashes, h -> if(h.text rlike '{pattern}', named_struct('key', h.line, 'value', named_struct('rules', {rules}, 'reason', {reason})), null)), m -> m is not null)"


def markers(facts: DataFrame, config: ScanConfig) -> DataFrame:
    """package, path, marks: line -> (rules, reason) of the lines that have a marker; files without any are left out."""
    return marked(facts.select("package", "path", F.expr(marks(config)).alias("marks")))


def marked(kept: DataFrame) -> DataFrame:
    """package, path, marks of the files that have any, as a map."""
    return kept.filter("size(marks) > 0").select("package", "path", F.map_from_entries("marks").alias("marks"))


def suppress(issues: DataFrame, facts: DataFrame, config: ScanConfig) -> DataFrame:
    """issues with suppressed and reason. Files with markers are few and small beside the issues, and AQE may broadcast them."""
    return decide(issues.join(markers(facts, config), ["package", "path"], "left"))


def decide(x: DataFrame) -> DataFrame:
    """Issues with marks, which may be null: suppressed and reason in their place."""
    mark = F.coalesce(F.try_element_at("marks", F.col("line")), F.try_element_at("marks", F.col("line") - 1))
    x = x.withColumn("mark", F.when(F.col("marks").isNotNull() & (F.col("line") > 0), mark)).drop("marks")
    hit = F.col("mark").isNotNull() & ((F.size("mark.rules") == 0) | F.array_contains("mark.rules", F.col("rule")))
    return x.withColumn("suppressed", F.coalesce(hit, F.lit(False))).withColumn("reason", F.when(F.col("suppressed"), F.col("mark.reason"))).drop("mark")
