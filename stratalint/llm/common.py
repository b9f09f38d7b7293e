"""Helpers that the operators share: staged tables, skew-proof joins, Arrow batching and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted table may be broadcast: a few MB, whatever the corpus's size.
BROADCAST_ROWS = 50_000
#: A key with more than this share of the rows is hot; there are at most HOT_SHARE such keys.
HOT_SHARE = 1000
#: Words of the largest bitmap that is broadcast (some 24 MB as Spark's hashed relation).
BITMAP_WORDS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir. Where it is unset, a local session gets a temporary one, as in tests; a cluster has no folder that all its machines see, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="stratalint-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stage(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, and keeps columns prunable."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths of the staged tables that this driver has written and not dropped.
STAGED: list[str] = []


def drop_between(spark: SparkSession, start: int, last: int = 1) -> None:
    """Delete the staged tables from the given place in STAGED on, but for the last ones; for operators that have staged what was derived from them."""
    gone = STAGED[start : len(STAGED) - last]
    del STAGED[start : len(STAGED) - last]
    for path in gone:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_staged(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables staged since the given length of STAGED; for callers that have written what was derived from them."""
    while len(STAGED) > since:
        _delete(spark, STAGED.pop())


def named(name: str, df: DataFrame | None = None) -> Column:
    """A column by its name, whatever the name holds; of df, if one is given."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(quoted) if df is None else df[quoted]


def whole_row(df: DataFrame, alias: str = "_row") -> Column:
    """All columns of df as one."""
    return F.struct(*[named(c) for c in df.columns]).alias(alias)


def spread_row(df: DataFrame, names: list[str], put: dict[str, Column] | None = None) -> list[Column]:
    """The columns of df's whole row (`_row`) again, those in `put` replaced."""
    return [put[c].alias(c) if put and c in put else F.col("_row").getField(c).alias(c) for c in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches(it: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the named string column has about `most` bytes in each, but at least one row."""
    for batch in it:
        n, i = batch.num_rows, 0
        if not n:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64).cumsum()
        while i < n:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, side="right")))
            yield batch.slice(i, j - i)
            i = j


def parts_of(texts: pa.Array, most: int = 8 << 20) -> Iterator[list[str | None]]:
    """The values of a string array, about `most` bytes at once."""
    for b in batches(iter([pa.RecordBatch.from_arrays([texts], names=["x"])]), "x", most):
        yield b.column("x").to_pylist()


def small_join(df: DataFrame, small: DataFrame, on: list[str], rows: int, how: str = "left", salts: int = 32) -> DataFrame:
    """Join with a table of `rows` counted rows: broadcast it up to BROADCAST_ROWS; beyond, salt both sides, so that a hot key spreads over `salts` tasks."""
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # by hash and not at random: a task that is run again must send its rows the same way
    return df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")


def hot_join(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Left join with a table that has one row for each key and in `count` the left rows of that key. Keys of over total / HOT_SHARE rows, of which there are at most HOT_SHARE, are broadcast; rows of all others are shuffled."""
    values = [c for c in right.columns if c not in on]
    is_hot = F.col(count) * HOT_SHARE > F.lit(max(total, HOT_SHARE * 1000))
    hot = right.filter(is_hot).select(*on, F.struct(*values).alias("_hot"))
    rest = right.filter(~is_hot).select(*[F.col(c).alias(f"_{c}") for c in on], F.struct(*values).alias("_rest"))
    df = left.join(F.broadcast(hot), on, "left")
    # a row that has found its hot key gets a scattered key that matches nothing; a hash, so that a task run again sends it the same way
    scatter = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.lit(1 << 40))).otherwise(F.lit(-1).cast("long"))
    df = df.withColumn("_scatter", scatter)
    rest = rest.withColumn("_scatter", F.lit(-1).cast("long"))
    cond: Column = df["_scatter"] == rest["_scatter"]
    for c in on:
        cond = cond & (df[c] == rest[f"_{c}"])
    df = df.join(rest, cond, "left").drop(rest["_scatter"]).drop(df["_scatter"])
    return df.select(*left.columns, *[F.coalesce(F.col("_hot")[v], F.col("_rest")[v]).alias(v) for v in values])


def release() -> None:
    """Give memory that a worker has freed back to the system: workers are reused, and the next stage's peak would come on top."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of df whose 64-bit hash may be one of keys (column `key`, non-null), by a broadcast bitmap; with inside=False the rows whose hash surely isn't. The bitmap has at most BITMAP_WORDS words of 64 bits, whatever the number of keys: with more keys it only clears fewer rows."""
    n = keys.count()
    words = int(np.clip(1 << (max(1, n // 4) - 1).bit_length(), 1 << 10, BITMAP_WORDS))
    word = lambda k: F.pmod(k, F.lit(words))
    bit = lambda k: F.pmod(F.shiftrightunsigned(k, 32), F.lit(64)).cast("int")
    map_ = keys.groupBy(word(F.col("key")).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("key")))).alias("_bits"))
    x = df.withColumn("_word", word(key)).withColumn("_bit", bit(key)).join(F.broadcast(map_), "_word", "left")
    held = F.coalesce(F.call_function("shiftright", F.col("_bits"), F.col("_bit")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return x.filter(held if inside else ~held).drop("_word", "_bit", "_bits")


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), ascending, and the smallest node of each one's component."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = lo != hi
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(root, hi[open_], lo[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return nodes, nodes[root]


def _contract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition to stars of its own components."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in it:
        a, b = union_find(np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()]))
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame, at_once: int = 4_000_000) -> DataFrame:
    """Connected components of the edges (a, b), two non-null longs: node, root (smallest node of the component); staged.

    Every round contracts each partition to stars, then joins larger neighbours to the least one (large star, then
    small star). Once at most `at_once` edges are left, a bound on memory and not on the graph, one task ends the work.
    """
    edges = stage(edges.select("a", "b").mapInArrow(_contract, "a long, b long"))
    while (n := edges.count()) > at_once:
        # large star: all larger neighbours of a node go to its least neighbour, or itself
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: the smaller neighbours of a node, and itself, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        new = stage(small.filter("a <> b").distinct().mapInArrow(_contract, "a long, b long"))
        left = new.count()
        if left == n and edges.exceptAll(new).isEmpty():
            break
        edges = new
    if n <= at_once:
        edges = edges.coalesce(1).mapInArrow(_contract, "a long, b long")
    return stage(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root")))
