"""URL filters (9): ordered host and path rules, then a Bloom filter cascade over a list of hosts.

Level 1 of the cascade encodes the listed keys, level 2 those other keys of the corpus that level 1 takes for listed,
level 3 the listed keys that level 2 takes for unlisted, and so on until a level errs no more. For every key of the
corpus, the universe it is built over, the answer is exact, and rows are judged as they are read: no join. A level has
BITS bits for each key that it encodes. Filters of up to BROADCAST_BYTES in all are broadcast; a larger cascade is cut
into segments by key, and rows meet their segment in a salted cogroup.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there up to "?", "#" or the end.
Null url, or no "://": both empty, no rule, and the empty host is never listed. Null page_id and repeated rows: judged
like others. Empty table: empty result. Only the url is read; `judge_urls` carries all other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, small_join, spread_row, stage, table, whole_row

#: Bits for each key of a level, probes of each key, the filters' bytes up to which they are broadcast, and beyond them the rows that meet a segment at once.
BITS, PROBES, BROADCAST_BYTES, SEGMENT_ROWS = 12, 6, 32 << 20, 100_000
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Words in a host's label by which the corpus's own hosts come on the list.
TERMS = ["spam", "pills", "casino", "malware", "phish", "adult", "free-bets", "ads-track"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its action, or nulls. rules: a short configured list."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, action = F.when(fits, r).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64((level * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(a: np.ndarray, b: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The probed bits of keys with the hashes a and b, a row for each probe."""
    x, y = _mix(a, level), _mix(b, level) | np.uint64(1)
    return (x + np.arange(PROBES, dtype=np.uint64)[:, None] * y) % np.uint64(bits)


def holds(words: np.ndarray, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Whether a level's filter, in 64-bit words, takes the keys."""
    p = places(a, b, level, len(words) * 64)
    return ((words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool).all(0)


def listed(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cascade's answers."""
    answer, open_ = np.zeros(len(a), bool), np.arange(len(a))
    for i, words in enumerate(levels):
        inside = holds(words, a[open_], b[open_], i)
        answer[open_] = inside if i % 2 == 0 else ~inside  # a key outside an even level is decided; so is one outside an odd level
        open_ = open_[inside]
    return answer


def _filter(keys: DataFrame, level: int, n: int, segments: int) -> DataFrame:
    """segment, word, bits: the filter of the keys (a, b, segment) of a level; n: the keys of the largest segment."""
    words = max(1, -(-n * BITS // 64))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b, s = (batch.column(c).to_numpy() for c in ("a", "b", "segment"))
            p = places(a, b, level, words * 64)
            at, inv = np.unique((np.broadcast_to(s, p.shape) * words + (p >> np.uint64(6)).astype(np.int64)).ravel(), return_inverse=True)
            bits = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(bits, inv, np.uint64(1) << (p & np.uint64(63)).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view(np.int64))], names=["word", "bits"])

    found = keys.select("a", "b", "segment").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return found.select(F.lit(level).alias("level"), F.expr(f"word div {words}").alias("segment"), F.expr(f"word % {words}").alias("word"), "bits", F.lit(words).alias("words"))


def _arrays(rows: pa.Table) -> list[np.ndarray]:
    """The levels of one segment's filter rows."""
    out: list[np.ndarray] = []
    level, word, bits, words = (rows.column(c).to_numpy() for c in ("level", "word", "bits", "words"))
    for i in range(int(level.max(initial=-1)) + 1):
        own = level == i
        # a segment that has no key at a level has no rows: an empty filter of the level's size
        out.append(x := np.zeros(int(words[own].max(initial=1)), np.uint64))
        x[word[own]] = bits[own].view(np.uint64)
    return out


class Cascade:
    """Exact membership in `keys` for every value of `universe`, both DataFrames of one string column."""

    def __init__(self, keys: DataFrame, universe: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> None:
        name, lists = universe.columns[0], keys.columns[0]
        flags = universe.select(F.col(name).alias("key"), F.lit(0).alias("x")).union(keys.select(F.col(lists).alias("key"), F.lit(1).alias("x"))).filter("key is not null")
        hashed = flags.groupBy("key").agg(F.max("x").alias("x")).select("x", *hashes(F.col("key")))
        self.keys = stage(hashed)
        total = self.keys.filter("x = 1").count()
        self.segments = max(1, -(-2 * total * BITS // 8 // broadcast_bytes))  # later levels need far less than the first
        tagged = self.keys.withColumn("segment", F.pmod("a", F.lit(self.segments)))
        self.levels = 0
        parts, level, encode, other = [], 0, tagged.filter("x = 1"), tagged.filter("x = 0")
        while (n := encode.groupBy("segment").count().agg(F.max("count")).first()[0]) is not None:
            parts.append(stage(_filter(encode, level, n, self.segments)))
            taken = self._taken(other, parts[-1], level)
            encode, other, level = stage(taken), encode, level + 1
        self.levels = level
        self.filters = parts[0] if parts else None
        for p in parts[1:]:
            self.filters = self.filters.union(p)

    def _taken(self, rows: DataFrame, part: DataFrame, level: int) -> DataFrame:
        if self.segments == 1:
            words = _arrays(part.select(F.lit(0).alias("level"), "word", "bits", "words").toArrow())[0]

            def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in it:
                    yield b.filter(pa.array(holds(words, b.column("a").to_numpy(), b.column("b").to_numpy(), level)))

            return rows.select("x", "a", "b", "segment").mapInArrow(run, "x int, a long, b long, segment long")

        def of_segment(left: pa.Table, right: pa.Table) -> pa.Table:
            words = np.zeros(int(right.column("words")[0].as_py()), np.uint64) if right.num_rows else None
            if words is None:
                return left.slice(0, 0)
            words[right.column("word").to_numpy()] = right.column("bits").to_numpy().view(np.uint64)
            return left.filter(pa.array(holds(words, left.column("a").to_numpy(), left.column("b").to_numpy(), level)))

        x = rows.select("x", "a", "b", "segment")
        return x.groupBy("segment").cogroup(part.groupBy("segment")).applyInArrow(of_segment, x.schema)

    def mark(self, df: DataFrame, key: Column, out: str) -> DataFrame:
        """df with a boolean column: whether the key is listed (null: false)."""
        if self.filters is None:
            return df.withColumn(out, F.lit(False))
        if self.segments == 1:
            levels = _arrays(self.filters.toArrow())  # at most BROADCAST_BYTES or so

            @F.pandas_udf("boolean")
            def test(a: pd.Series, b: pd.Series) -> pd.Series:
                return pd.Series(listed(levels, a.to_numpy(), b.to_numpy()))

            return df.withColumn(out, key.isNotNull() & test(*hashes(F.coalesce(key, F.lit("")))))
        row = df.select(whole_row(df), *hashes(F.coalesce(key, F.lit(""))), key.isNotNull().alias("_is")).withColumn("segment", F.pmod("a", F.lit(self.segments)))
        # a row for each segment, of which there is one for some millions of listed keys
        salts = row.groupBy("segment").agg(F.ceil(F.count("*") / SEGMENT_ROWS).cast("int").alias("salts"))
        row, parts = small_join(row, salts, ["segment"], self.segments), small_join(self.filters, salts, ["segment"], self.segments, "inner")
        row = row.withColumn("salt", F.pmod(F.xxhash64("_row"), F.col("salts")).cast("int")).drop("salts")
        parts = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

        def of_rows(left: pa.Table, right: pa.Table) -> pa.Table:
            yes = listed(_arrays(right), left.column("a").to_numpy(), left.column("b").to_numpy())
            return left.select(["_row"]).append_column("_yes", pa.array(yes & left.column("_is").to_numpy(zero_copy_only=False)))

        schema = T.StructType([row.schema["_row"], T.StructField("_yes", T.BooleanType())])
        found = row.groupBy("segment", "salt").cogroup(parts.groupBy("segment", "salt")).applyInArrow(of_rows, schema)
        return found.select(*spread_row(found, df.columns), F.col("_yes").alias(out))


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key, F.lit(1)).alias("a"), F.xxhash64(key, F.lit(2)).alias("b")


def judge_urls(pages: DataFrame, keys: DataFrame, rules: list[tuple[str, str]], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pages with host, path, rule and verdict. keys: a DataFrame of one column, the listed hosts."""
    kept = pages.drop("host", "path", "rule", "verdict")
    x = kept.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    cascade = Cascade(keys, x.select("host"), broadcast_bytes)
    x = cascade.mark(x, F.when(F.col("host") != "", F.col("host")), "_listed")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return x.select(*[named(c) for c in kept.columns], "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"))


def suspicious_hosts(pages: DataFrame, terms: list[str] = TERMS) -> DataFrame:
    """The list of the query: the corpus's hosts that have a term in a label."""
    host = host_of(F.col("url"))
    return pages.select(host.alias("host")).filter(F.col("host").rlike("|".join(terms))).distinct()


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url")
    return judge_urls(pages, suspicious_hosts(pages), RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '{"|".join(TERMS)}') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
