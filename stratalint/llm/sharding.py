"""Sharding (10): a uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Every input partition p must send M[p, f] rows to target f so that all ways to place the rows are equally likely: M is
drawn from the multivariate hypergeometric law with the partitions' counts as its row sums and the targets' sizes as its
column sums. It is drawn by halving the range of partitions; each half's counts come from a generator seeded by the range
alone, so a task finds its own row in O(targets * log partitions) without the matrix being held or sent. A task permutes
its labels (permute locally), rows move once (exchange), and each target sorts by random 64-bit keys (permute again). A
shard is made of as many targets as keep one near ROWS rows or BYTES bytes, and has a fixed range of slots for each, so no task holds a
shard, and slots need no counting.

Law: `rows`, shard sizes at most one apart, for any key, source or text that is hot: nothing is grouped, so equal texts
may part. Null text: size 1, the empty text. Null doc_id and repeated rows: rows like others. Empty table: empty result.
The input must be a scan of files (or staged): its partitions have to hold the same rows when they are read again, and
each task checks its count. Columns of the input named shard or slot are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_row, table, whole_row

#: Rows that a target, a task's part of a shard, has at most, and bytes of files behind them.
ROWS, BYTES = 20_000, 64 << 20


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn are good. Beyond numpy's limit, by inversion over the mode's neighbourhood, all but 1e-30 of the mass."""
    total = good + bad
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if good and n else 0
    lo, hi = max(0, n - bad), min(good, n)
    mean = n * good / total
    sd = math.sqrt(max(1.0, mean * (1 - good / total) * (total - n) / max(1, total - 1)))
    k = np.arange(max(lo, int(mean - 12 * sd) - 1), min(hi, int(mean + 12 * sd) + 1) + 1, dtype=np.float64)
    ratio = np.log((good - k[:-1]) * (n - k[:-1])) - np.log((k[1:]) * (bad - n + k[1:])) if len(k) > 1 else np.empty(0)
    p = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.exp(p - p.max()).cumsum()
    return int(k[min(len(k) - 1, int(np.searchsorted(p, rng.random() * p[-1], side="right")))])


def draw(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric: how many of n drawn are of each kind."""
    left = int(sizes.sum())
    if left < 10**9:
        return rng.multivariate_hypergeometric(sizes, n, method="marginals")
    out = np.zeros(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        out[i] = hypergeometric(rng, s, left - s, n)
        n, left = n - int(out[i]), left - s
    return out


def matrix_row(counts: np.ndarray, sizes: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row p of the matrix whose row sums are counts and whose column sums are sizes."""
    upto = np.concatenate([[0], np.cumsum(counts)])
    lo, hi, v = 0, len(counts), np.asarray(sizes, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = draw(np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, lo, hi]))), v, int(upto[mid] - upto[lo]))
        v, lo, hi = (left, lo, mid) if p < mid else (v - left, mid, hi)
    return v


def target_sizes(total: int, shards: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each target its size, its shard and its first slot."""
    sizes, of, first = [], [], []
    for s in range(shards):
        n = total // shards + (s < total % shards)
        parts = max(1, -(-n // rows))
        own = [n // parts + (i < n % parts) for i in range(parts)]
        sizes += own
        of += [s] * parts
        first += np.concatenate([[0], np.cumsum(own)[:-1]]).tolist()
    return np.array(sizes, np.int64), np.array(of, np.int32), np.array(first, np.int64)


def rows_of(docs: DataFrame, total: int) -> int:
    """Rows for a target: ROWS, or fewer where the planner's size of the input, of its files, makes them over BYTES."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return ROWS if not total or size >= 1 << 60 else max(1, min(ROWS, BYTES * total // max(1, size)))


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 17, rows: int | None = None) -> DataFrame:
    """docs with shard, 0 to shards - 1, and slot, gapless from 0 in each shard. rows: what a target has at most."""
    kept = docs.drop("shard", "slot")
    per = {r["p"]: r["n"] for r in kept.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}  # a number for each partition
    counts = np.zeros(max(per, default=-1) + 1, np.int64)
    for p, n in per.items():
        counts[p] = n
    sizes, of, first = target_sizes(int(counts.sum()), shards, rows or rows_of(kept, int(counts.sum())))
    sc = kept.sparkSession.sparkContext
    known = sc.broadcast((counts, sizes))  # 8 bytes for each partition and target

    @F.pandas_udf("target int, key long")
    def label(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labels, rng, at = None, None, 0
        for ids in it:
            if labels is None:
                if not len(ids):
                    continue
                counts, sizes = known.value
                p = int(ids.iloc[0])
                rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, p])))
                labels = rng.permutation(np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(counts, sizes, p, seed))) if p < len(counts) else np.empty(0, np.int32)
            own = labels[at : at + len(ids)]
            if len(own) < len(ids):
                raise RuntimeError("a partition has more rows than when it was counted: stage the input first")
            at += len(ids)
            yield pd.DataFrame({"target": own, "key": rng.integers(-(2**63), 2**63, len(ids), dtype=np.int64)})
        if labels is not None and at < len(labels):
            raise RuntimeError("a partition has fewer rows than when it was counted: stage the input first")

    x = kept.select(whole_row(kept), label.asNondeterministic()(F.spark_partition_id()).alias("_to"))
    x = x.repartitionById(len(sizes), F.col("_to.target")).sortWithinPartitions("_to.key")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    of_, first_ = F.lit(of.tolist()), F.lit(first.tolist())
    x = x.withColumn("_n", place)
    t = F.col("_to.target") + 1
    return x.select(*spread_row(x, kept.columns), F.element_at(of_, t).cast("int").alias("shard"), (F.element_at(first_, t) + F.col("_n")).cast("long").alias("slot"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return shuffle_into_shards(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
