"""python -m stratalint [NAME=PATH ...] [--config FILE] [--packages a,b] [--json | --plan] [--severity S] [--top N] ..."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from stratalint.functions.config import ScanConfig
from stratalint.plans import api, report
from stratalint.sources import files


def registry_of(a: argparse.Namespace, cwd: str) -> tuple[dict[str, tuple[str, bool]], list[str]]:
    excludes = [x for x in (a.exclude or "").split(",") if x]
    if not a.paths and not a.config:
        return files.discover(cwd), excludes + files.DEFAULT_EXCLUDES
    found = files.read_registry(a.config) if a.config else {}
    return dict(sorted((found | files.named(a.paths, cwd)).items())), excludes


def main(argv: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="stratalint")
    p.add_argument("paths", nargs="*", metavar="NAME=PATH")
    p.add_argument("--config", help="a YAML registry: packages, and what is known of them: stems, layers, libraries, transports")
    p.add_argument("--packages", help="names, comma-separated")
    p.add_argument("--severity", default="info")
    p.add_argument("--json", action="store_true")
    p.add_argument("--plan", action="store_true")
    p.add_argument("--top", type=int, default=5)
    p.add_argument("--exclude", help="parts of paths, comma-separated")
    p.add_argument("--min-duplicate-lines", type=int, default=5)
    p.add_argument("--twin-similarity", type=float, default=0.6)
    a = p.parse_args(argv)
    cwd = os.getcwd()
    registry, excludes = registry_of(a, cwd)
    if not registry:
        print("no packages: nothing here holds Python files", file=sys.stderr)
        return 2
    if a.packages:
        names = list(dict.fromkeys(x.strip() for x in a.packages.split(",") if x.strip()))
        if unknown := [x for x in names if x not in registry]:
            print(f"unknown packages: {', '.join(unknown)}", file=sys.stderr)
            return 2
        registry = {x: registry[x] for x in names}
    if missing := [root for root, _ in registry.values() if not os.path.exists(root)]:
        print(f"missing paths: {', '.join(missing)}", file=sys.stderr)  # no files would score 100
        return 2
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("stratalint").getOrCreate()
    config = replace(files.read_settings(a.config) if a.config else ScanConfig(), duplicate_lines=a.min_duplicate_lines, twin_ratio=a.twin_similarity)
    r, root = api.scan(spark, registry, config, excludes), files.workspace_root(cwd)
    if a.plan:
        print(report.plan_report(r, a.severity, a.top, root), end="")
    elif a.json:
        for part in report.json_parts(r, a.severity, root):
            print(part, end="")
        print()
    else:
        for line in report.text_lines(r, a.severity, root):
            print(line)
    code = report.exit_code(r)
    r.release()
    return code


if __name__ == "__main__":
    sys.exit(main())
