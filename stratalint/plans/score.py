"""Health score and remediation plan, over issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalint.functions.config import EFFORT

WEIGHTS = {"error": 6.0, "warning": 1.5, "info": 0.3}
RANKS = {"info": 0, "warning": 1, "error": 2}
LEVELS = [(12, "P0"), (7, "P1"), (3, "P2")]


def weight(severity: Column) -> Column:
    return F.when(severity == "error", 6.0).when(severity == "warning", 1.5).otherwise(0.3)


def rank(severity: Column) -> Column:
    """Of unknown severities: that of errors."""
    return F.when(severity == "info", 0).when(severity == "warning", 1).otherwise(2)


def effort(rule: Column) -> Column:
    out = F.lit(1.0)
    for e, rules in EFFORT.items():
        out = F.when(rule.isin(rules.split()), e).otherwise(out)
    return out


def issue_score(severity: Column, rule: Column) -> Column:
    """The priority score of a finding: its severity's weight times its rule's effort."""
    return F.bround(weight(severity) * effort(rule), 6)


def effort_label(e: Column) -> Column:
    return F.when(e >= 4, "major").when(e >= 2.5, "moderate").when(e >= 1, "minor").otherwise("trivial")


def priority(score: Column) -> Column:
    out = F.lit("P3")
    for least, level in reversed(LEVELS):
        out = F.when(score >= least, level).otherwise(out)
    return out


def health(issues: DataFrame, stats: DataFrame) -> DataFrame:
    """score, grade: 100 less the weight of issues for each 1000 lines; no lines: 100, A. stats: a row with n_lines."""
    total = issues.agg(F.coalesce(F.sum(weight(F.col("severity"))), F.lit(0.0)).alias("penalty"))
    s = F.when(F.col("n_lines") == 0, 100.0).otherwise(F.greatest(F.lit(0.0), 100 - F.col("penalty") / (F.greatest("n_lines", F.lit(1)) / 1000)))
    x = total.crossJoin(stats.select("n_lines")).select(s.alias("score"))  # a row each
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").when(F.col("score") >= 40, "D").otherwise("F")
    return x.withColumn("grade", grade)


def remediation(issues: DataFrame) -> DataFrame:
    """priority, rule, severity, effort, n_files, first_file, n_issues, description, score; a row for each rule, best first."""
    first = F.struct(rank(F.col("severity")).alias("r"), "severity")
    g = issues.groupBy("rule").agg(F.max(first)["severity"].alias("severity"), F.countDistinct("path").alias("n_files"), F.min("path").alias("first_file"), F.count("*").alias("n_issues"), F.min_by("message", F.struct("package", "path", "line", "pos")).alias("description"))
    g = g.withColumn("score", issue_score(F.col("severity"), F.col("rule"))).withColumn("effort", effort_label(effort(F.col("rule")))).withColumn("priority", priority(F.col("score")))
    return g.orderBy(F.desc("score"), F.desc("n_issues"), "rule")


def plan_files(issues: DataFrame) -> DataFrame:
    """rule, path, n: the files of each step, counted."""
    return issues.groupBy("rule", "path").agg(F.count("*").alias("n"))


def breakdown(plan: DataFrame) -> DataFrame:
    return plan.groupBy("priority").agg(F.count("*").alias("n_rules"))
