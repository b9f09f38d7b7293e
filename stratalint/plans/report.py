"""Reports: text, JSON, remediation plan, exit codes.

text_lines and json_parts stream a report to the driver, to be printed. text_table and json_table are the same report as a
table whose rows are ordered, numbered and written out by the tasks; the driver sees a number for each partition.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalint.plans import score
from stratalint.plans.api import ScanResult, in_scan_order

KEYS = ["line", "severity", "rule", "message", "package"]

WIDTH = 72
HINT = "suppress a finding with  # <word>-ignore[rule, ...]: reason  on its line or the line before"


def shown(path: str, root: str | None) -> str:
    return os.path.relpath(path, root) if root and path.startswith(root.rstrip("/") + "/") else path


def _ignored_line(x: dict, root: str | None) -> str:
    return f"ignored {shown(x['path'], root)}:{x['line']} {x['rule']}" + (f": {x['reason']}" if x["reason"] else "")


def _line(x: dict, root: str | None) -> str:
    return f"{shown(x['path'], root)}:{x['line']}: {x['severity']} [{x['rule']}] {x['message']} ({x['package']})"


def _json(x: dict, root: str | None, more: list[str]) -> str:
    return json.dumps({"file": shown(x["path"], root)} | {k: x[k] for k in [*KEYS, *more]}, indent=2, ensure_ascii=False)


def _ignored(r: ScanResult) -> DataFrame:
    return r.ignored.orderBy("path", "line", "rule", "pos")


def numbered(ordered: DataFrame) -> tuple[DataFrame, int]:
    """The rows of an ordered DataFrame, persisted, with their places as at, from 0, and their number."""
    x = ordered.withColumn("at", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    part = F.shiftright("at", 33)
    before, n = [], 0
    for p in x.groupBy(part.alias("p")).count().orderBy("p").toPandas().itertuples(index=False):
        before.append((p[0], n - (p[0] << 33)))
        n += p[1]
    offsets = F.broadcast(x.sparkSession.createDataFrame([(int(a), int(b)) for a, b in before], "p long, more long"))  # a row a partition
    return x.withColumn("p", part).join(offsets, "p").withColumn("at", F.col("at") + F.col("more")).drop("p", "more"), int(n)


def _told(x: DataFrame, write: Callable[[dict], str]) -> DataFrame:
    """at and text of numbered rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("at").cast(pa.int32()), pa.array([write(y) for y in b.to_pylist()], pa.string())], names=["at", "text"])

    return x.mapInArrow(run, "at int, text string")


def text_table(r: ScanResult, severity: str = "info", root: str | None = None) -> DataFrame:
    """at, text: the lines of text_lines and their places."""
    ignored, n = numbered(_ignored(r))
    found, _ = numbered(in_scan_order(r.at_least(severity)))
    head = _head(r, n)
    top = r.all.sparkSession.createDataFrame(list(enumerate(head)), "at int, text string")
    before = len(head)
    ignored, found = ignored.withColumn("at", F.col("at") + before), found.withColumn("at", F.col("at") + before + n)
    return top.union(_told(ignored, lambda x: _ignored_line(x, root))).union(_told(found, lambda x: _line(x, root)))


def json_table(r: ScanResult, severity: str = "info", root: str | None = None) -> DataFrame:
    """part, at, text: the objects of the JSON report's lists, and the number of suppressed ones as suppressed, at."""
    issues, _ = numbered(in_scan_order(r.at_least(severity)))
    ignored, n = numbered(in_scan_order(r.ignored))
    out = _told(issues, lambda x: _json(x, root, [])).select(F.lit("issues").alias("part"), "at", "text")
    out = out.union(_told(ignored, lambda x: _json(x, root, ["reason"])).select(F.lit("ignored"), "at", "text"))
    return out.union(r.all.sparkSession.createDataFrame([("suppressed", n, None)], "part string, at int, text string"))


def text_lines(r: ScanResult, severity: str = "info", root: str | None = None) -> Iterator[str]:
    """The report line by line; findings stream from the cluster, a partition at a time."""
    yield from _head(r, r.ignored.count())
    for x in _ignored(r).toLocalIterator():
        yield _ignored_line(x, root)
    for x in in_scan_order(r.at_least(severity)).toLocalIterator():
        yield _line(x, root)


def _head(r: ScanResult, suppressed: int) -> list[str]:
    n = {x["severity"]: x["n"] for x in r.counts().collect()}
    stats, health = r.stats.first(), r.health().first()
    counts = ", ".join(f"{n.get(s, 0)} {s}" for s in ("error", "warning", "info"))
    files = f"{stats['n_files']} files, {stats['n_functions']} functions, {stats['n_lines']} lines"
    return ["=" * WIDTH, files, counts, f"{suppressed} suppressed", HINT, f"health {health['score']:.1f} ({health['grade']})", "=" * WIDTH]


def text_report(r: ScanResult, severity: str = "info", root: str | None = None) -> str:
    return "\n".join(text_lines(r, severity, root)) + "\n"


def json_parts(r: ScanResult, severity: str = "info", root: str | None = None) -> Iterator[str]:
    """The report in parts; issues are filtered by severity, ignored ones aren't."""
    def rows(df: DataFrame, more: list[str]) -> Iterator[str]:
        before = "\n    "
        for x in in_scan_order(df).toLocalIterator():
            yield before + _json(x, root, more).replace("\n", "\n    ")
            before = ",\n    "
        yield "" if before == "\n    " else "\n  "

    yield '{\n  "issues": ['
    yield from rows(r.at_least(severity), [])
    yield f'],\n  "suppressed": {r.ignored.count()},\n  "suppression_help": {json.dumps(HINT, ensure_ascii=False)},\n  "ignored": ['
    yield from rows(r.ignored, ["reason"])
    yield "]\n}"


def json_report(r: ScanResult, severity: str = "info", root: str | None = None) -> str:
    return "".join(json_parts(r, severity, root))


def plan_report(r: ScanResult, severity: str = "info", top: int = 5, root: str | None = None) -> str:
    steps = score.remediation(r.at_least(severity)).collect()  # a row for each rule
    if not steps:
        return "All clean: nothing to fix.\n"
    level = {"P0": "critical", "P1": "high", "P2": "medium", "P3": "low"}
    out = ["=" * WIDTH, "Remediation plan", "=" * WIDTH]
    out += [f"{p} {level[p]}: {sum(s['priority'] == p for s in steps)} rules" for p in level if any(s["priority"] == p for s in steps)]
    for i, s in enumerate(steps[:top], 1):
        more = f" +{s['n_files'] - 1}" if s["n_files"] > 1 else ""
        out.append(f"{i:2}. {s['priority']} {s['rule']} ({s['severity']}, {s['effort']}) x{s['n_issues']} in {shown(s['first_file'], root)}{more}: {s['description']}")
    out += [f"{p}: " + ", ".join(s["rule"] for s in steps if s["priority"] == p) for p in level if any(s["priority"] == p for s in steps)]
    return "\n".join(out) + "\n"


def exit_code(r: ScanResult) -> int:
    """2 if any error is left, 1 if any warning, else 0; by all unsuppressed issues, whatever is shown."""
    n = {x["severity"] for x in r.counts().collect()}
    return 2 if "error" in n else 1 if "warning" in n else 0
