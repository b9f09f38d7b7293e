"""scan(): sources to issues. Files are parsed once, by file, into facts; all else is relational.

    sources -> mapInArrow(shred) -> facts -> per-file rules and markers (no shuffle), persisted -> package rules -> suppression
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stratalint.functions.config import ScanConfig
from stratalint.functions.schema import FACTS, FAMILIES
from stratalint.operators import packages, rules, suppress
from stratalint.plans import score
from stratalint.sources.files import read_packages

#: Characters of source in a batch of parsed files.
_BATCH = 1 << 20
#: What a file counts for besides its characters: its row has many fields, however short it is.
_FILE = 500


def shred_sources(sources: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """The facts of package, root, path, source; a row for each file. wanted: the families and fields that are needed; others may be left empty."""
    schema = to_arrow_schema(T.StructType.fromDDL(FACTS))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        from stratalint.functions.shred import CONTENT, Memo, places

        kept, memo = gc.get_threshold(), Memo(wanted)
        gc.set_threshold(100_000, 20, 100)  # trees hold no cycles, and are many small objects
        empty = {f for f in CONTENT if wanted is not None and f not in wanted and f not in ("n_lines", "parse_error")}

        def batch(told: list[dict], at: list[int], placed: list[dict]) -> pa.RecordBatch:
            """placed: a row a file; told: the different texts' contents, of which at has each file's."""
            cols, take = [], None if len(told) == len(at) else pa.array(at, pa.int32())
            for f in schema:
                if f.name in empty or f.name == "edges" and wanted is not None and "edges" not in wanted:
                    cols.append(pa.nulls(len(at), f.type))
                elif f.name in FAMILIES:  # files that are alike share their lists
                    values, place = {}, []
                    for x in told:
                        v = x.get(f.name)
                        place.append(values.setdefault(id(v) if v else v is None, (len(values), v))[0])
                    col = pa.array([v for _, v in values.values()], f.type)
                    cols.append(col if take is None and len(values) == len(told) else col.take(pa.array([place[i] for i in at], pa.int32())))
                elif f.name in CONTENT:
                    col = pa.array([x.get(f.name) for x in told], f.type)
                    cols.append(col if take is None else col.take(take))
                else:
                    cols.append(pa.array([x.get(f.name) for x in placed], f.type))
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        try:
            told, at, placed, index, size = [], [], [], {}, 0
            for b in it:
                for package, root, path, source in zip(*(b.column(c).to_pylist() for c in ("package", "root", "path", "source"))):
                    if (i := index.get(source)) is None:
                        i = index[source] = len(told)
                        told.append(memo.get(source))
                    at.append(i)
                    placed.append(places(package, root, path, told[i]))
                    size += len(source or "") + _FILE
                    if size > _BATCH:
                        yield batch(told, at, placed)
                        told, at, placed, index, size = [], [], [], {}, 0
            if at:
                yield batch(told, at, placed)
        finally:
            gc.set_threshold(*kept)

    return sources.select("package", "root", "path", "source").mapInArrow(run, FACTS)


def unparse_functions(sources: DataFrame) -> DataFrame:
    """path, name, line, text: every function's canonical text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalint.functions.shred import unparsed

        for b in it:
            rows = [(path, *x) for path, source in zip(b.column("path").to_pylist(), b.column("source").to_pylist()) for x in unparsed(source)]
            cols = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string()))], names=["path", "name", "line", "text"])

    return sources.select("path", "source").mapInArrow(run, "path string, name string, line int, text string")


@dataclass
class ScanResult:
    """all: every issue with suppressed and reason; stats: one row of n_files, n_lines, n_functions; facts: what is kept of the facts, a row a file. In a with block, the facts are given up at its end."""

    all: DataFrame
    stats: DataFrame
    facts: DataFrame
    kept: tuple[DataFrame, ...] = ()

    def __enter__(self) -> ScanResult:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()

    def release(self) -> None:
        for x in (self.facts, *self.kept):
            if not x.sparkSession._jsparkSession.sparkContext().isStopped():  # else it went with its session
                x.unpersist()

    @property
    def issues(self) -> DataFrame:
        return self.all.filter(~F.col("suppressed")).drop("suppressed", "reason")

    @property
    def ignored(self) -> DataFrame:
        return self.all.filter("suppressed").drop("suppressed")

    def at_least(self, severity: str) -> DataFrame:
        """The issues of a severity or worse."""
        return self.issues.filter(score.rank(F.col("severity")) >= score.RANKS.get(severity, 2))

    def counts(self) -> DataFrame:
        return self.issues.groupBy("severity").agg(F.count("*").alias("n"))

    def health(self) -> DataFrame:
        return score.health(self.issues, self.stats)

    def merge(self, other: ScanResult) -> ScanResult:
        both = self.stats.union(other.stats)
        return ScanResult(self.all.unionByName(other.all), both.agg(*[F.sum(c).alias(c) for c in both.columns]), self.facts.unionByName(other.facts), (self.facts, other.facts, *self.kept, *other.kept))


def scan_sources(sources: DataFrame, config: ScanConfig = ScanConfig(), persist: bool = True) -> ScanResult:
    """Scan a DataFrame of package, root, path, source."""
    facts = kept_facts(shred_sources(sources, needed(config)), config)
    if persist:  # several branches read the facts; the parse is what costs
        facts = facts.persist(StorageLevel.MEMORY_AND_DISK)
    own = facts.filter("size(issues) > 0").select("package", "path", F.map_from_entries(F.when(F.size("marks") > 0, F.col("marks"))).alias("marks"), F.explode("issues").alias("issue"))
    own = suppress.decide(own.select("package", "path", "issue.*", "marks"))
    whole = suppress.decide(packages.package_issues(facts, config).join(suppress.marked(facts), ["package", "path"], "left"))
    if persist:  # as each count and list reads them anew, and the rules shuffle
        whole = whole.persist(StorageLevel.MEMORY_AND_DISK)
    stats = facts.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"), F.coalesce(F.sum("n_functions"), F.lit(0)).alias("n_functions"))
    return ScanResult(own.unionByName(whole), stats, facts, (whole,) if persist else ())


def needed(config: ScanConfig) -> frozenset[str]:
    """The families and fields that a scan's rules and markers read."""
    graph = packages.GRAPH if config.stems else frozenset()
    return rules.needs(config, frozenset()) | packages.BODIES | packages.TWINS | graph | {"hashes"}


_held: list[ScanResult] = []


def hold(scan: Callable[[], ScanResult]) -> ScanResult:
    """For results that are read after their caller has returned: what they keep is given up when the next one is held, so no more than one is kept. It is given up before the next scan is told to persist: Spark knows what is kept by its plan, so of two equal scans the elder's end would be the younger's."""
    while _held:
        _held.pop().release()
    _held.append(scan())
    return _held[-1]


def kept_facts(facts: DataFrame, config: ScanConfig) -> DataFrame:
    """What a scan reads more than once, a row a file: its issues by the per-file rules, markers and counts, and what package rules ask for. The lines and most families end here."""
    bodies = f"transform(filter(functions, f -> f.span >= {config.duplicate_lines} and not f.trivial), f -> struct(f.name, f.line, f.span, f.trivial, f.body_hash))"
    alike = f"filter(twins, t -> t.ratio >= {config.twin_ratio}D)"
    return facts.select(
        "package", "path", "module", "parse_error", "edges", "n_lines", F.expr("coalesce(size(functions), 0)").alias("n_functions"), F.expr(rules.issues_of(config)).alias("issues"),
        F.expr(suppress.marks(config)).alias("marks"), F.expr(bodies).alias("functions"), F.expr(alike).alias("twins"),
    )


def scan(spark: SparkSession, registry: dict[str, tuple[str, bool]], config: ScanConfig = ScanConfig(), excludes: list[str] = ()) -> ScanResult:
    """Scan the packages of a registry: name -> (root, recursive)."""
    return scan_sources(read_packages(spark, registry, list(excludes)), config)


def in_scan_order(issues: DataFrame) -> DataFrame:
    """Package, file in walk order, rule and place: a total order, equal from run to run."""
    return issues.orderBy("package", F.split("path", "/"), "rule_no", "pos", "line", "message")
