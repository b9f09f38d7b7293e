"""Rules over whole packages: import graphs, duplicate bodies, synchronous and asynchronous twins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalint.functions.config import ScanConfig

#: What the rules over graphs, bodies and twins need of the facts.
GRAPH, BODIES, TWINS = frozenset(["edges"]), frozenset(["functions", "body_hash"]), frozenset(["functions", "twins"])
COLUMNS = ["package", "path", "line", "severity", "rule", "message", "rule_no", "pos"]


def _issue(df: DataFrame, line, severity: str, rule: str, message, no: int) -> DataFrame:
    return df.select("package", "path", line.cast("int").alias("line"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), message.alias("message"), F.lit(no).alias("rule_no"), F.lit(0).alias("pos"))


def _with_stem(facts: DataFrame, config: ScanConfig) -> DataFrame:
    """The files that parse, of packages that have a stem, with it."""
    stem = F.lit(None).cast("string")
    for package, s in config.stems.items():
        stem = F.when(F.col("package") == package, s.rstrip(".")).otherwise(stem)
    return facts.filter("parse_error is null").withColumn("stem", stem).filter("stem is not null")


def _below(dst: Column) -> Column:
    return (dst == F.col("stem")) | dst.startswith(F.concat("stem", F.lit(".")))


def import_edges(facts: DataFrame, config: ScanConfig) -> DataFrame:
    """package, src, dst: distinct imports, when modules are imported, of modules below the package's stem."""
    e = _with_stem(facts, config).select("package", "stem", F.col("module").alias("src"), F.explode("edges").alias("dst"))
    return e.filter(_below(F.col("dst"))).select("package", "src", "dst").distinct()


def cycles_of(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Back edges of a depth-first search, roots ascending and neighbours descending; each set of modules once."""
    graph: dict[str, list[str]] = {}
    for a, b in edges:
        graph.setdefault(a, []).append(b)
    visited, seen, out = set(), set(), []
    for start in sorted(graph):
        if start in visited:
            continue
        visited.add(start)
        path, on_path, todo = [start], {start}, [sorted(graph[start])]
        while todo:
            if not todo[-1]:
                todo.pop()
                on_path.discard(path.pop())
                continue
            n = todo[-1].pop()
            if n in on_path:
                cycle = path[path.index(n) :]
                if (key := frozenset(cycle)) not in seen:
                    seen.add(key)
                    out.append(cycle)
            elif n not in visited:
                visited.add(n)
                path.append(n)
                on_path.add(n)
                todo.append(sorted(graph.get(n, [])))
    return out


def import_cycles(facts: DataFrame, config: ScanConfig) -> DataFrame:
    """A depth-first search is sequential, so a package's graph, a few edges for each of its modules, is one group."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        found = cycles_of(list(zip(pdf["src"], pdf["dst"])))
        return pd.DataFrame({"package": [pdf["package"].iloc[0]] * len(found), "module": [c[0] for c in found], "cycle": [" -> ".join([*c, c[0]]) for c in found]}, columns=["package", "module", "cycle"])

    found = import_edges(facts, config).groupBy("package").applyInPandas(search, "package string, module string, cycle string")
    modules = facts.filter("parse_error is null").groupBy("package", "module").agg(F.max("path").alias("path"))  # the last file of a module's name counts
    return _issue(found.join(modules, ["package", "module"]), F.lit(1), "error", "import-cycle", F.concat(F.lit("circular import: "), F.col("cycle")), 40)


def high_coupling(facts: DataFrame, config: ScanConfig) -> DataFrame:
    """The facts are read once. A module's files meet with what they import, an array each; then a row for each import, by whom it is imported not told, meets the importing module's own row: counts add up before they are sent."""
    file = F.struct("path", F.coalesce(F.filter("edges", _below), F.array().cast("array<string>")).alias("edges"))
    m = _with_stem(facts, config).groupBy("package", "module").agg(F.collect_list(file).alias("files"))
    m = m.select("package", "module", F.array_max("files.path").alias("last"), F.array_distinct(F.flatten("files.edges")).alias("outs"))  # the last file of a module's name counts
    x = m.select("package", "last", F.size("outs").alias("n"), F.posexplode(F.concat(F.array("module"), "outs")).alias("i", "module"))
    own = F.col("i") == 0
    x = x.filter(~own | (F.col("n") > config.fan_out)).select("package", "module", F.when(own, F.col("last")).alias("path"), F.when(own, 0).otherwise(1).alias("into"), F.when(own, F.col("n")).alias("fan_out"))
    # an own row has its path for a key, so that no text is an aggregate, which would have every import sorted
    g = x.groupBy("package", "module", "path").agg(F.sum("into").alias("fan_in"), F.max("fan_out").alias("fan_out")).filter((F.col("fan_in") > config.fan_in) | F.col("path").isNotNull())
    g = g.groupBy("package", "module").agg(F.max("path").alias("path"), F.max("fan_in").alias("fan_in"), F.max("fan_out").alias("fan_out")).filter((F.col("fan_in") > config.fan_in) & F.col("path").isNotNull())
    message = F.concat("module", F.lit(" has fan-in "), "fan_in", F.lit(" and fan-out "), "fan_out", F.lit(f" (max {config.fan_in}/{config.fan_out})"))
    return _issue(g, F.lit(1), "warning", "high-coupling", message, 41)


def function_bodies(facts: DataFrame, config: ScanConfig) -> DataFrame:
    f = facts.select("package", "path", F.explode("functions").alias("f")).select("package", "path", "f.name", "f.line", "f.span", "f.trivial", "f.body_hash")
    return f.filter((F.col("span") >= config.duplicate_lines) & ~F.col("trivial"))


def duplicate_members(facts: DataFrame, config: ScanConfig) -> DataFrame:
    """package, body_hash, path, line, name of every function whose body occurs more than once."""
    f = function_bodies(facts, config)
    again = f.groupBy("package", "body_hash").count().filter("count > 1").select("package", "body_hash")
    return f.join(again, ["package", "body_hash"], "left_semi").select("package", "body_hash", "path", "line", "name")


def duplicate_functions(facts: DataFrame, config: ScanConfig) -> DataFrame:
    """One issue at the first place of each repeated body. Groups are counted, not collected; duplicate_members lists them."""
    at = F.struct("path", "line", "name")
    g = function_bodies(facts, config).groupBy("package", "body_hash").agg(F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("z")).filter("n > 1")
    g = g.select("package", F.col("a.path").alias("path"), "a.line", "a.name", "n", "z")
    message = F.concat(F.lit("the body of "), "name", F.lit("() occurs "), "n", F.lit(" times, last as "), "z.name", F.lit("() in "), "z.path", F.lit(":"), "z.line")
    return _issue(g, F.col("line"), "warning", "duplicate-function-body", message, 42)


def twins(facts: DataFrame, config: ScanConfig) -> DataFrame:
    """The first place of each pair of names, per class, whose texts are alike in the order asked."""
    t = facts.select("package", "path", F.split("path", "/").alias("walk"), F.explode("twins").alias("t")).filter(F.col("t.ratio") >= config.twin_ratio)
    cls = F.coalesce("t.class_name", F.lit(""))
    key = F.array_join(F.array_sort(F.array(F.col("t.name"), F.col("t.other"))), "|")
    first = t.groupBy("package", key.alias("pair"), cls.alias("cls")).agg(F.min(F.struct("walk", "t.place", "path", "t.name", "t.other", "t.line", "t.ratio")).alias("m"))
    first = first.select("package", "m.path", "m.name", "m.other", "m.line", "m.ratio")
    message = F.concat("name", F.lit("() and "), "other", F.lit("() are "), F.bround(F.col("ratio") * 100).cast("int"), F.lit("% alike; share a helper"))
    return _issue(first, F.col("line"), "warning", "sync-async-duplication", message, 43)


def package_issues(facts: DataFrame, config: ScanConfig) -> DataFrame:
    out = duplicate_functions(facts, config).union(twins(facts, config))
    if config.stems:
        out = out.union(import_cycles(facts, config)).union(high_coupling(facts, config))
    return out
