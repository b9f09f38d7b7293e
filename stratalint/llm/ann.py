"""Approximate nearest neighbours (1) by largest inner product, with randomly rotated one-bit codes.

Every vector goes to the cell of its nearest centroid; its residual, randomly rotated into SPREAD times its dimensions,
leaves one bit for each of those, its length, and the inner product of its direction with its code. From these a query's
inner product is estimated with a bound on the error. A query has a floor from the start: the k-th best inner product with
the sample, whose k nearest are found already. In a cell, if many are left, it rises to the k-th best exact one of those
that the estimates put first. Only vectors whose upper bound reaches the floor are reranked with the original vectors, in
double precision: a few in a hundred.

Centroids, the number of cells to probe and the floors come from a sample of at most SAMPLE rows, those of least hash; the
number is the least whose recall is RECALL on sample rows that the centroids weren't fitted to. Every row is indexed. Cells
are cut into blocks of about BLOCK rows, the queries of a cell likewise, so a cell that holds a third of all rows is many
tasks. Originals travel with their codes, once, as they are (a float is four bytes): in so few dimensions they weigh less
than the pairs that would have to come back for them.

Vectors that are null, zero, hold null or non-finite components, or aren't of the most frequent length take no part,
as queries or candidates; nor do rows with a null id. Rows that repeat an id are that id's own row to its query, and as
candidates one, that of greatest score. Ties go to the smaller id. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .common import stage, table

SAMPLE, SAMPLE_BYTES, CELL, BLOCK, RECALL, EPSILON, SPREAD = 20_000, 16 << 20, 4_096, 16_384, 0.97, 1.9, 2


def _matrix(blobs: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors from their bytes, four or eight for a component."""
    raw = b"".join(blobs.to_pylist())
    kind = np.float32 if len(blobs) and len(raw) == 4 * dims * len(blobs) else np.float64
    return np.frombuffer(raw, kind).reshape(-1, dims).astype(np.float64)


def usable(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """id and vec (components as they are, floats or doubles, as binary) of the vectors that take part, staged; and their length."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).filter("id is not null and vec is not null and size(vec) > 0")
    # lengths are few; the most frequent counts, the smaller of two
    best = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = best["d"] if best else 1
    kind = np.float32 if isinstance(rows.schema["vec"].dataType.elementType, T.FloatType) else np.float64

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            v = b.column("vec")
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            ok = np.isfinite(flat).all(1) & (flat != 0).any(1)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(ok)), pa.array([x.tobytes() for x in flat[ok].astype(kind)], pa.binary())], names=["id", "vec"])

    return stage(rows.filter(F.size("vec") == dims).mapInArrow(run, "id long, vec binary")), dims


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds if k > 1 else 1):
        a = nearest(x, c)
        n = np.bincount(a, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, 1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def probes(x: np.ndarray, c: np.ndarray, k: int) -> int:
    """The least number of cells, by the centroids' inner product, that holds RECALL of the neighbours of some of the rows x among them all."""
    q = x[:256]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(c)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    place = np.empty((len(q), len(c)), np.int64)
    np.put_along_axis(place, np.argsort(-(q @ c.T), 1), np.arange(len(c))[None, :], 1)
    at = np.sort(np.take_along_axis(place, nearest(x, c)[top], 1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(RECALL * len(at))))]) + 1


def in_sample(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the places and scores of its k nearest in x, vectors of distinct ids, but its own; none if there are fewer."""
    if len(x) <= k:
        return np.empty((len(q), 0), np.int64), np.empty((len(q), 0))
    at, score = np.empty((len(q), k), np.int64), np.empty((len(q), k))
    for i in range(0, len(q), 256):
        s = q[i : i + 256] @ x.T
        s[own[i : i + 256, None] == ids[None, :]] = -np.inf
        at[i : i + 256] = np.argpartition(-s, k - 1, axis=1)[:, :k]
        score[i : i + 256] = np.einsum("ac,abc->ab", q[i : i + 256], x[at[i : i + 256]])
    return at, score


class Codes:
    """Rotation and centroids; encodes vectors and estimates inner products."""

    def __init__(self, centroids: np.ndarray, seed: int = 23) -> None:
        self.centroids, d = centroids, centroids.shape[1]
        self.bits = -(-SPREAD * d // 64) * 64
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((self.bits, self.bits)))
        self.rotation = (q * np.sign(np.diag(r)))[:d]  # of vectors that zeros fill up to `bits` dimensions

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, packed bits, length of the residual, and its direction's inner product with its code."""
        cell = nearest(x, self.centroids)
        r = (x - self.centroids[cell]) @ self.rotation
        length = np.sqrt((r * r).sum(1))
        along = np.abs(r).sum(1) / np.sqrt(self.bits) / np.where(length > 0, length, 1)
        return cell, np.packbits(r > 0, axis=1), length, np.where(length > 0, along, 1.0)

    def estimate(self, q: np.ndarray, cell: int, bits: np.ndarray, length: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates, a row for each query, and bounds on their errors."""
        d = self.bits
        sign = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
        turned = (q @ self.rotation).astype(np.float32)
        scale = (length / along / np.sqrt(d)).astype(np.float32)
        about = (q @ self.centroids[cell]).astype(np.float32)[:, None] + turned @ sign.T * scale
        wide = EPSILON * length * np.sqrt(np.maximum(0, 1 - along**2)) / along / np.sqrt(d - 1)
        norm = np.sqrt((q * q).sum(1))
        return about, norm[:, None].astype(np.float32) * (wide + 1e-5 * (length + 1)).astype(np.float32)


def _exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("ab,ab->a", q[i[k : k + 65_536]], x[j[k : k + 65_536]]) for k in range(0, len(i), 65_536)]) if len(i) else np.empty(0)


def search_block(codes: Codes, cell: int, ids: np.ndarray, x: np.ndarray, bits: np.ndarray, length: np.ndarray, along: np.ndarray, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For batches of queries: query ids, ids and scores of at most k for each query that may be among its nearest, and how many vectors were reranked."""
    single = len(np.unique(ids)) == len(ids)
    for at in range(0, len(q), 128):
        own, y, low = qid[at : at + 128], q[at : at + 128], floor[at : at + 128].copy()
        about, wide = codes.estimate(y, cell, bits, length, along)
        about[own[:, None] == ids[None, :]] = -np.inf
        top, reranked = about + wide, 0
        least = 2 * k
        # queries whose floor leaves many: raise it to the k-th best of the first by estimate
        many = np.flatnonzero((top >= low[:, None].astype(np.float32) - np.float32(1e-6)).sum(1) > 8 * least) if single and len(ids) > least else []
        if len(many):
            first = np.argpartition(-about[many], least - 1, axis=1)[:, :least]
            score = np.einsum("ac,abc->ab", y[many], x[first])
            low[many] = np.maximum(low[many], np.partition(score, least - k, axis=1)[:, least - k] - 1e-9)
            reranked += score.size
        i, j = np.nonzero((top >= low[:, None].astype(np.float32) - np.float32(1e-6)) & (about > -np.inf))
        score = _exact(y, x, i, j)
        reranked += len(i)
        good = score >= low[i]
        i, j, score = i[good], j[good], score[good]
        order = np.lexsort((ids[j], -score, i))
        i, found, score = i[order], ids[j[order]], score[order]
        if not single:  # of rows that repeat an id, the best
            _, once = np.unique(np.stack([i, found]), axis=1, return_index=True)
            once = np.sort(once)
            i, found, score = i[once], found[once], score[once]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        yield own[i[rank < k]], found[rank < k], score[rank < k], reranked


def search(df: DataFrame, queries: str, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, the rows for which the condition on `id` holds, among all rows but its own."""
    spark = df.sparkSession
    rows, dims = usable(df, id_col, vec_col)
    total = rows.count()
    most = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
    sample = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(most).toArrow()
    x = _matrix(sample.column("vec"), dims) if total else np.zeros((1, dims))
    held = len(x) // 4  # of the sample, for the number of probes
    cells = int(np.clip(total // CELL, 1, max(1, len(x) // 8)))
    codes = Codes(k_means(x[held:], cells))
    probe = probes(x[:held], codes.centroids, k) if cells > 1 else 1
    known, once = np.unique(sample.column("id").to_numpy(), return_index=True)
    known = spark.sparkContext.broadcast((x[once] if total else x[:0], known))  # at most SAMPLE_BYTES or so

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                cell, bits, length, along = codes.encode(_matrix(b.column("vec"), dims))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(cell, pa.int32()), pa.array([z.tobytes() for z in bits], pa.binary()), pa.array(length), pa.array(along)], names=["id", "vec", "cell", "bits", "length", "along"])

    index = stage(rows.mapInArrow(encode, "id long, vec binary, cell int, bits binary, length double, along double"))
    asked = rows.filter(queries).dropDuplicates(["id"])

    def choose(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                q = _matrix(b.column("vec"), dims)
                s = q @ codes.centroids.T
                near, score = in_sample(q, b.column("id").to_numpy(), *known.value, k)
                low = score.min(1) - 1e-9 if score.shape[1] else np.full(len(q), -np.inf)
                at = np.argpartition(-s, probe - 1, axis=1)[:, :probe] if probe < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(list(at.astype(np.int32)), pa.list_(pa.int32())), pa.array(low), pa.array(list(known.value[1][near]), pa.list_(pa.int64())), pa.array(list(score), pa.list_(pa.float64()))], names=["qid", "qvec", "cells", "low", "ids", "scores"])

    chosen = stage(asked.mapInArrow(choose, "qid long, qvec binary, cells array<int>, low double, ids array<long>, scores array<double>"))
    of_sample = chosen.select("qid", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select(F.col("qid").alias("query_id"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    asked = chosen.select("qid", "qvec", "low", F.explode("cells").alias("cell"))
    # cells are at most SAMPLE / 8; both numbers decide how finely a cell is cut
    cut = index.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("subs"))
    n = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    cut = F.broadcast(stage(cut.join(n, "cell")))
    part = lambda key, m: F.pmod(F.xxhash64(key), F.col(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = index.join(cut, "cell").withColumn("sub", part("id", "subs")).withColumn("part", each("parts")).drop("subs", "parts")
    right = asked.join(cut, "cell").withColumn("part", part("qid", "parts")).withColumn("sub", each("subs")).drop("subs", "parts")

    def judge(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if a.num_rows and b.num_rows:
            bits = np.frombuffer(b"".join(a.column("bits").to_pylist()), np.uint8).reshape(a.num_rows, -1)
            found = search_block(codes, key[0].as_py(), a.column("id").to_numpy(), _matrix(a.column("vec"), dims), bits, a.column("length").to_numpy(), a.column("along").to_numpy(), b.column("qid").to_numpy(), _matrix(b.column("qvec"), dims), b.column("low").to_numpy(), k)
            for me, ids, score, _ in found:
                out[0].append(me)
                out[1].append(ids)
                out[2].append(score)
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    keys = ["cell", "sub", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(judge, "query_id long, vec_id long, score double")
    best = found.union(of_sample).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "id % 20 = 0")
