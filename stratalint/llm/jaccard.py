"""N-gram Jaccard join (8): all pairs of documents whose word 2-shingle sets have a Jaccard similarity of at least 60 %.

1. Sign: each whole text becomes its set of 64-bit shingle hashes, in numpy; equal sets are one class, joined no further.
2. Order: shingles are ranked by how many texts hold them, rarest first. Their hashes, shortened to 28 bits or more (two
   that fall together only look more frequent), go in blobs to the task of their range, which counts the classes that
   have each and returns those of more than one, with a code. Shingles that over a fiftieth of the texts have are found
   first, batch by batch, and known to all tasks: they rank last and aren't sent there, so no task gathers a hot one.
3. Filter: of n shingles in that order, two sets that are alike share one of the first n - ceil(0.6 n) + 1. Shingles of
   one text alone need no partner. The place of the first shingle that two sets share bounds their sizes: each prefix
   shingle goes, in blobs, to its range's task with the largest size that a partner may have (its reach), and only texts
   with a partner within both reaches stay. Groups of tokens over HOT_TEXTS aren't gathered there, but cut in step 4.
4. Blocks: of texts that share such a shingle those are united, by stars and not pairs, into components, whose sizes and
   parities of all shared shingles, which bound a pair's differences, leave room for the threshold. A component of bounded
   size is a block; a larger one is cut into pairs of its parts or, if that is less to send, into the groups of single
   shingles, of which those over the bound are cut likewise; there a pair is judged only with the least shingle that both
   have sent.
5. Join: texts of the blocks, and no others, are moved. A block's sets, by global frequency in the block, form a prefix tree with one node for each shared run. One
   traversal carries all sets as queries: overlaps so far are shared by a subtree, and a query leaves it when the sizes or
   the lengths that remain can't reach the threshold. Links leave a block as sums and stars.

Nothing is dropped: filters only skip pairs that can't be alike. Exact up to collisions of 64-bit hashes (128-bit for
equal sets). Null or wordless text: no shingles, no links, its own component. A class, by its signature, is a node of a
component; ids only name components, by the least one, which is null where all are. Repeated rows are documents, each
alike to the others, and so are rows of null ids. Empty table: empty result. Other columns are ignored; `keep_one`
carries them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STAGED, batches, components, drop_between, hot_join, maybe_in, release, spread_row, stage, table, union_find, whole_row

#: Shingles of a counting task, texts of a shingle beyond which its group is cut before it is gathered, and texts and shingles of a block, beyond which it is divided.
RANGE, HOT_TEXTS, BLOCK_TEXTS, BLOCK_SHINGLES = 2_000_000, 100_000, 2_000, 2_000_000
#: Frequent shingles: texts of a batch that have one, at least and as a share; and how many are known to all tasks.
LEAST, SHARE, FREQUENT = 16, 250, 200_000
#: Bits of a text's parities.
PARITIES = 1 << 16
#: Bytes of a window of text, and of a block's table of queries by shingle.
_WINDOW, _TABLE = 1 << 20, 32 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P, _A, _B = 0x9E3779B97F4A7C15 | 5, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, _WINDOW) - 1, x, np.uint64)])) for x in (_P, pow(_P, -1, 1 << 64))]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a window; new: where a text starts."""
    n, space = len(data), _SPACE[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = space[:-1] | new[1:]
    after[:-1] = space[1:] | new[1:]
    start, stop = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    up, down = _power(n)
    total = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n])])
    return start, mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * _B)


def sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return []
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    new = np.zeros(len(data) + 1, bool)
    new[at[:-1]] = True
    starts, hashes, i = [], [], 0
    while i < len(data):
        j = min(len(data), i + _WINDOW)
        if j < len(data):  # end a window after white space or before a text
            ends = np.flatnonzero(_SPACE[data[i:j]] | new[i + 1 : j + 1])
            while not len(ends) and j < len(data):
                k = min(len(data), j + _WINDOW)
                ends, j = np.flatnonzero(_SPACE[data[j:k]] | new[j + 1 : k + 1]) + (j - i), k
            j = i + int(ends[-1]) + 1 if len(ends) else len(data)
        s, h = _words(data[i:j], new[i:j])
        starts.append(s + i)
        hashes.append(h)
        i = j
    start, word = (np.concatenate(x) if x else np.empty(0, k) for x, k in ((starts, np.int64), (hashes, np.uint64)))
    pair = mix(word[:-1] * _A + (word[1:] ^ (word[1:] >> np.uint64(29))) * _B) if len(word) > 1 else np.empty(0, np.uint64)
    first = np.searchsorted(start, at)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a < 2:
            out.append(word[a:b])
        else:
            x = np.sort(pair[a : b - 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
    return out


def _signature(x: np.ndarray) -> tuple[int, int] | None:
    if not len(x):
        return None
    h = xxhash.xxh3_128_intdigest(x.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


_SIGNED = "doc_id long, h long, n long, s1 long, s2 long, frequent boolean"


def _sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and signature of each text; and for shingles (h) that many of a batch's distinct texts have, how many (n)."""
    names, seen, tally = [x.split()[0] for x in _SIGNED.split(", ")], set(), Counter()
    for b in batches(it, "text", 4 << 20):
        found = sets(b.column("text"))
        sig = [_signature(x) or (None, None) for x in found]
        cols = [pa.array([len(x) for x in found], pa.int64()), *[pa.array([s[i] for s in sig], pa.int64()) for i in (0, 1)]]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), *cols, pa.array([False] * len(found))], names=names)
        own = {s[0]: x for s, x in zip(sig, found) if s[0] is not None and s[0] not in seen}
        seen.update(own)
        if len(own) >= LEAST:
            h, n = np.unique(np.concatenate(list(own.values())), return_counts=True)
            many = n >= max(LEAST, len(own) // SHARE)
            tally.update(dict(zip(h[many].view(np.int64).tolist(), n[many].tolist())))
    none = pa.nulls(len(tally), pa.int64())
    yield pa.RecordBatch.from_arrays([none, pa.array(list(tally), pa.int64()), pa.array(list(tally.values()), pa.int64()), none, none, pa.array([True] * len(tally), pa.bool_())], names=names)
    release()


def frequent(signed: DataFrame, texts: int) -> np.ndarray:
    """The shingles, ascending, that a good part of the texts have, FREQUENT at most: every one of a fiftieth of all is found, as it has that share of many batches. They are ranked last without being gathered or counted by task."""
    found = signed.filter("frequent").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(LEAST, texts // (2 * SHARE)))
    return np.sort(found.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").toArrow().column("h").to_numpy().view(np.uint64))


_BLOB = "bucket int, chunk long, docs binary, at binary, times binary, ids binary, codes binary"
_BLOB_NAMES = ["bucket", "chunk", "docs", "at", "times", "ids", "codes"]
_BLOB_KINDS = (pa.int32(), pa.int64(), *[pa.binary()] * 5)


def _planes(x: np.ndarray) -> bytes:
    """Numbers under 2^32 by planes of bytes: the upper ones are mostly zero, so a shuffle's compression takes them."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _whole(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _three(x: np.ndarray) -> bytes:
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _of_three(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(x, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def _runs(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of runs and their lengths."""
    edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else np.zeros(1, np.int64)
    return doc[edge[:-1]], np.diff(edge)


def _gaps(at: np.ndarray) -> bytes:
    return _planes(np.diff(at, prepend=0))


def _blobs(bits: int, known: np.ndarray):
    """Blobs of 24-bit ids for each bucket and chunk: a bucket is a hash's leading bits, an id the next 24; `at` tells the texts' places in the chunk. A chunk's texts come as signatures and sizes in bucket -1, with those shingles that are known to be frequent, by their number, in ids and their times in codes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, seen = TaskContext.get().partitionId() << 32, set()
        for b in batches(it, "text", 4 << 20):
            own = []
            for x in sets(b.column("text")):
                if (s := _signature(x)) and s[0] not in seen:
                    seen.add(s[0])
                    own.append((s[0], x))
            if not own:
                continue
            size = np.array([len(x) for _, x in own], np.int64)
            h = np.concatenate([x for _, x in own])
            doc = np.repeat(np.arange(len(own)), size)
            number = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            often = known[number] == h if len(known) else np.zeros(len(h), bool)
            place, k = _runs(doc[often])
            of = np.array([s for s, _ in own], np.int64)
            rows = [(-1, chunk, of.tobytes(), _gaps(place), size.tobytes(), _three(number[often]), _planes(k))]
            h, doc = h[~often], doc[~often]
            bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, doc, ids = bucket[order], doc[order], ((h[order] << np.uint64(bits)) >> np.uint64(40)).astype(np.uint32)
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
                at, times = _runs(doc[a:z])
                rows.append((int(bucket[a]), chunk, of[at].tobytes(), _gaps(at), _planes(times), _three(ids[a:z]), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _BLOB_KINDS)], names=_BLOB_NAMES)
            chunk += 1
        release()

    return run


def _code(n: np.ndarray) -> np.ndarray:
    """A count of at least 2 as a byte that rises with it."""
    return np.where(n < 128, n, np.minimum(255, 128 + 4 * np.log2(np.maximum(n, 128) / 128)).astype(np.int64)).astype(np.uint8)


def _count(rows: pa.Table) -> pa.Table:
    """For a bucket: the ids that more than one class has, with their codes and their texts' places in the chunk. Bucket -1 passes through."""
    if rows.column("bucket")[0].as_py() < 0:
        return rows
    parts = [_of_three(x) for x in rows.column("ids").to_pylist()]
    runs = [_whole(x) for x in rows.column("times").to_pylist()]
    ids, s1 = np.concatenate(parts), np.concatenate([np.frombuffer(x, np.int64) for x in rows.column("docs").to_pylist()])
    run = np.repeat(np.arange(len(s1), dtype=np.int32), np.concatenate(runs))
    code = np.zeros(len(ids), np.uint8)  # 0: of one class alone
    for part in range(8):  # by leading bits, for a smaller peak of memory
        at = np.flatnonzero(ids >> np.uint32(21) == part)
        if not len(at):
            continue
        i, c = ids[at], s1[run[at]]
        order = np.lexsort((c, i))
        i, c, at = i[order], c[order], at[order]
        new = np.concatenate([[True], i[1:] != i[:-1]])
        # copies of a text in several chunks are one class: count each class of an id once
        n = np.add.reduceat((new | np.concatenate([[True], c[1:] != c[:-1]])).astype(np.int32), np.flatnonzero(new))
        code[at] = np.where(n > 1, _code(n), 0)[np.cumsum(new) - 1]
    done, out = 0, []
    for bucket, chunk, ids, at, times in zip(rows.column("bucket").to_pylist(), rows.column("chunk").to_pylist(), parts, rows.column("at").to_pylist(), runs):
        own = code[done : done + len(ids)]
        done += len(ids)
        many = own > 0
        if many.any():
            place, k = _runs(np.repeat(np.cumsum(_whole(at)), times)[many])
            out.append((bucket, chunk, None, _gaps(place), _planes(k), _three(ids[many]), own[many].tobytes()))
    release()
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, _BLOB_KINDS)], names=_BLOB_NAMES)


_FOUND = "bucket int, s1 long, n long, shared long, bits binary, docs binary, sizes binary, times binary, ids binary, reach binary"
_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
_FOUND_KINDS = (pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 6)
#: Buckets of the rows that tell a class, and of the tokens too frequent for their bucket's task.
_CLASS, _HOT = -1, -2


def _prefixes(rows: pa.Table, hot: int) -> pa.Table:
    """For a chunk, by bucket, the prefix shingles that other texts may have, each with its reach: the most shingles that a text may have which is alike to this one and shares this shingle as the first in order. For each class that sends any, a row with its shared shingles, their number and their parities."""
    doc, token, code, info = [], [], [], None
    for bucket, docs, at, times, ids, codes in zip(*(rows.column(c).to_pylist() for c in ("bucket", "docs", "at", "times", "ids", "codes"))):
        if bucket < 0:
            info = np.frombuffer(docs, np.int64), np.frombuffer(times, np.int64)
            if ids:
                doc.append(np.repeat(np.cumsum(_whole(at)), _whole(codes)))
                token.append(_of_three(ids).astype(np.int64) | 1 << 50)
                code.append(np.full(len(token[-1]), 255, np.uint8))
            continue
        doc.append(np.repeat(np.cumsum(_whole(at)), _whole(times)))
        token.append(_of_three(ids).astype(np.int64) | bucket << 24)
        code.append(np.frombuffer(codes, np.uint8))
    if not doc:
        return pa.table([pa.array([], k) for k in _FOUND_KINDS], names=_FOUND_NAMES)
    s1, size = info
    doc, token, code = np.concatenate(doc), np.concatenate(token), np.concatenate(code)
    order = np.lexsort((token, code, doc))
    doc, token, code = doc[order], token[order], code[order]
    many = np.bincount(doc, minlength=len(size))
    cut = np.concatenate([[0], np.cumsum(many)])
    place = np.arange(len(doc)) - cut[doc] + (size - many)[doc]  # after the shingles of one text alone
    n = size[doc]
    # alike: 8 * overlap >= 3 * (n + the other's n); the overlap is at most what follows, and at most what is shared
    reach = (8 * np.minimum(n - place, many[doc]) - 3 * n) // 3
    take = (place <= n - (60 * n + 99) // 100) & (5 * reach >= 3 * n)
    out = [(_CLASS, int(s1[k]), int(size[k]), int(many[k]), _parities(token[cut[k] : cut[k + 1]]), *[None] * 5) for k in np.unique(doc[take]).tolist()]
    doc, token, reach = doc[take], token[take], reach[take]
    bucket = np.where(code[take] > _code(np.array([hot]))[0], _HOT, token >> 24)
    order = np.argsort(bucket, kind="stable")
    doc, token, reach, bucket = doc[order], token[order], reach[order], bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(doc) else np.zeros(1, np.int64)
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
        k, times = _runs(doc[a:z])
        ids = _three(token[a:z]) if bucket[a] >= 0 else token[a:z].tobytes()
        out.append((int(bucket[a]), *[None] * 4, s1[k].tobytes(), _planes(np.minimum(size[k], 2**32 - 1)), _planes(times), ids, _planes(np.minimum(reach[a:z], 2**32 - 1))))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 10, _FOUND_KINDS)], names=_FOUND_NAMES)


def _parities(token: np.ndarray) -> bytes:
    """Parities of a set's shingles by hash, in twice to four times as many bits, a power of two, but PARITIES at most: two sets differ in at least as many shingles as their parities in bits, also when the longer ones are folded. They travel with each of a text's tokens, so without a bound a very long text would send the square of its length; beyond it the filter is only weaker."""
    n = min(PARITIES, max(64, 1 << (2 * len(token) - 1).bit_length()))
    return np.packbits(np.bincount((mix(token.astype(np.uint64)) % np.uint64(n)).astype(np.int64), minlength=n) & 1).tobytes()


class _Parities:
    """The parities of rows, by length."""

    def __init__(self, bits: list[bytes]) -> None:
        size = np.array([len(x) for x in bits], np.int64)
        self.size, self.level, self.row, self.of = size, np.frexp(size)[1], np.empty(len(bits), np.int64), {}
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            self.row[own] = np.arange(len(own))
            self.of[n] = np.frombuffer(b"".join([bits[k] for k in own.tolist()]), np.uint64).reshape(-1, n // 8)

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For pairs, a lower bound on how many shingles one of the two has and the other has not."""
        out = np.zeros(len(x), np.int64)
        lo, hi = np.where(self.size[x] <= self.size[y], x, y), np.where(self.size[x] <= self.size[y], y, x)
        both = self.level[lo] * 64 + self.level[hi]
        for pair in np.unique(both).tolist():
            own = np.flatnonzero(both == pair)
            a, b = int(self.size[lo[own[0]]]), int(self.size[hi[own[0]]])
            for k in range(0, len(own), step := max(1, (1 << 22) // b)):
                at = own[k : k + step]
                p, q = self.of[a][self.row[lo[at]]], self.of[b][self.row[hi[at]]]
                while q.shape[1] > p.shape[1]:
                    half = q.shape[1] // 2
                    q = q[:, :half] ^ q[:, half:]
                out[at] = np.bitwise_count(p ^ q).sum(1, dtype=np.int64)
        return out


def prefixes(docs: DataFrame, total: int, known: np.ndarray, hot: int = HOT_TEXTS) -> DataFrame:
    """Blobs of prefix shingles by bucket, and a row for each class that sends any; staged. total: shingles in all; known: frequent ones."""
    bits = int(np.clip(np.ceil(np.log2(max(1, total) / RANGE)), 4, 24))
    blobs = docs.select("text").mapInArrow(_blobs(bits, known), _BLOB)
    # a chunk's signatures wait for it under a key of their own
    key = F.when(F.col("bucket") < 0, -1 - F.col("chunk")).otherwise(F.col("bucket").cast("long"))
    counted = blobs.groupBy(key.alias("_key")).applyInArrow(_count, _BLOB)
    return stage(counted.groupBy("chunk").applyInArrow(lambda rows: _prefixes(rows, hot), _FOUND))


def _range_max(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The largest of x[lo:hi] for each range, -1 for empty ones."""
    out, size = np.full(len(lo), -1, np.int64), np.maximum(hi - lo, 0)
    level = np.frexp(size)[1] - 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.maximum(x[lo[at]], x[hi[at] - (1 << k)])
        x = np.maximum(x[: -(1 << k)], x[1 << k :]) if len(x) > 1 << k else x
    return out


def _partnered(group: np.ndarray, n: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which rows, in order of group and n, have another one in their group so that each one's n is in the other's reach."""
    first = np.searchsorted(group, group)
    end = np.searchsorted(group << 33 | n, group << 33 | np.minimum(reach, (1 << 33) - 1), side="right")
    here = np.arange(len(n))
    return (_range_max(reach, here + 1, end) >= n) | (_range_max(reach, first, np.minimum(end, here)) >= n)


_GROUP = "x long, y long, token long, every long, members binary"


def _meet(rows: pa.Table) -> pa.Table:
    """For a bucket, the classes that share a token and have a partner there, a row for each token, but one for tokens that the same classes share."""
    token, s1, n, reach = [], [], [], []
    for bucket, docs, sizes, times, ids, own in zip(*(rows.column(c).to_pylist() for c in ("bucket", "docs", "sizes", "times", "ids", "reach"))):
        t = _whole(times)
        token.append(_of_three(ids).astype(np.int64) | bucket << 24)
        s1.append(np.repeat(np.frombuffer(docs, np.int64), t))
        n.append(np.repeat(_whole(sizes), t))
        reach.append(_whole(own))
    token, s1, n, reach = (np.concatenate(x) for x in (token, s1, n, reach))
    order = np.lexsort((s1, n, token))
    token, s1, n, reach = token[order], s1[order], n[order], reach[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (s1[1:] != s1[:-1])])  # else a copy from another chunk
    token, s1, n, reach = token[new], s1[new], n[new], reach[new]
    group = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
    good = _partnered(group, n, reach)
    token, s1, n = token[good], s1[good], n[good]
    names = [x.split()[0] for x in _GROUP.split(", ")]
    if not len(token):
        return pa.table([*[pa.array([], pa.int64())] * 4, pa.array([], pa.binary())], names=names)
    edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    h = s1.view(np.uint64)
    x, y = np.bitwise_xor.reduceat(mix(h), edge), np.add.reduceat(mix(h ^ _A), edge)
    once = np.lexsort((token[edge], y, x))
    once = once[np.concatenate([[True], (x[once][1:] != x[once][:-1]) | (y[once][1:] != y[once][:-1])])]
    stop = np.append(edge[1:], len(token))
    members = [s1[edge[k] : stop[k]].tobytes() for k in once.tolist()]
    every = np.add.reduceat(n, edge)[once]
    return pa.table([pa.array(x[once].view(np.int64)), pa.array(y[once].view(np.int64)), pa.array(token[edge[once]]), pa.array(every), pa.array(members, pa.binary())], names=names)


def _members(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        own = [np.frombuffer(x, np.int64) for x in b.column("members").to_pylist()]
        k = np.array([len(x) for x in own], np.int64)
        for i in range(0, len(own), 4096):
            s = slice(i, i + 4096)
            cols = [np.repeat(x[s], k[s]) for x in (b.column("token").to_numpy(), b.column("every").to_numpy(), k)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*cols, np.concatenate(own[s]))], names=["token", "every", "k", "s1"])


def _hot(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for docs, sizes, times, ids in zip(*(b.column(c).to_pylist() for c in ("docs", "sizes", "times", "ids"))):
            t = _whole(times)
            cols = np.frombuffer(ids, np.int64), np.repeat(np.frombuffer(docs, np.int64), t), np.repeat(_whole(sizes), t)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["token", "s1", "n"])


def partners(found: DataFrame) -> DataFrame:
    """token, every, k, s1: the classes that share a token with a possible partner, with the token's number of classes and of their shingles in all; staged."""
    groups = found.filter("bucket >= 0").select("bucket", "docs", "sizes", "times", "ids", "reach").groupBy("bucket").applyInArrow(_meet, _GROUP)
    # tokens that the same classes share, as near copies have many, count once
    once = groups.groupBy("x", "y").agg(F.min(F.struct("token", "every", "members")).alias("g")).select("g.*")
    met = once.mapInArrow(_members, "token long, every long, k long, s1 long")
    hot = found.filter(F.col("bucket") == _HOT).select("docs", "sizes", "times", "ids")
    if hot.isEmpty():
        return stage(met)
    hot = stage(hot.mapInArrow(_hot, "token long, s1 long, n long").distinct())
    sizes = stage(hot.groupBy("token").agg(F.sum("n").alias("every"), F.count("*").alias("k")))
    return stage(met.unionByName(hot_join(hot, sizes, ["token"], "k", hot.count()).drop("n")))


def _unite(rows: pa.Table) -> pa.Table:
    """Stars of the classes that share a token and whose sizes and parities leave room for the threshold, from all groups of one task."""
    rows = rows.sort_by([(c, "ascending") for c in ("token", "i", "j", "n", "s1")])
    token, i, j, mine, s1, n, shared = (rows.column(c).to_numpy() for c in ("token", "i", "j", "mine", "s1", "n", "shared"))
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    left = np.append(np.flatnonzero(new)[1:], len(token))[np.cumsum(new) - 1] - np.arange(len(token)) - 1  # members after each in its group
    nodes, at = np.unique(s1, return_inverse=True)
    label = np.arange(len(nodes))
    parities = _Parities(rows.column("bits").to_pylist())
    x, d = np.flatnonzero(left > 0), 0
    while len(x):  # each with the member d places on, whose size is no less
        d += 1
        x = x[3 * n[x + d] <= 5 * n[x]]
        y = x + d
        may = (np.minimum(shared[x], shared[y]) * 8 >= 3 * (n[x] + n[y])) & ((i[x] == j[x]) | (mine[x] != mine[y])) & (label[at[x]] != label[at[y]])
        p, q = x[may], y[may]
        near = 4 * (shared[p] + shared[q] - parities.differ(p, q)) >= 3 * (n[p] + n[q])
        a, b = label[at[p[near]]], label[at[q[near]]]
        if len(a):
            known, root = union_find(a, b)
            to = np.arange(len(nodes))
            to[known] = root
            label = to[label]
        x = x[left[x] > d]
    far = label != np.arange(len(nodes))
    release()
    return pa.table([pa.array(nodes[far]), pa.array(nodes[label[far]])], names=["a", "b"])


def _parts(k: str, most: int) -> Column:
    """Into how many parts a group of k is cut, so that two parts make at most `most`."""
    return F.when(F.col(k) <= most, 1).otherwise(F.ceil(F.col(k) * 2 / most)).cast("int")


def _places(token: str, g: str, mine: str) -> Column:
    """The pairs of parts of a group that a member of part `mine` meets others in."""
    meet = lambda j: F.struct(F.col(token).alias("block"), F.least(F.col(mine), j).alias("i"), F.greatest(F.col(mine), j).alias("j"), F.col(mine).alias("mine"))
    return F.transform(F.sequence(F.lit(0), F.col(g) - 1), meet)


def blocks(found: DataFrame, max_texts: int = BLOCK_TEXTS, max_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """s1, at (array of block, i, j, mine) and tokens (empty in a component's block): where each class with a possible partner is judged."""
    classes = found.filter(F.col("bucket") == _CLASS).groupBy("s1").agg(*[F.first(c).alias(c) for c in ("n", "shared", "bits")])
    shared = partners(found).withColumn("g", _parts("k", max_texts)).withColumn("mine", F.pmod(F.xxhash64("s1"), F.col("g")).cast("int"))
    total = shared.count()
    met = shared.select("token", "g", "mine", "s1").join(classes.hint("shuffle_hash"), "s1")
    met = met.select(F.explode(_places("token", "g", "mine")).alias("p"), "s1", "n", "shared", "bits").select(F.col("p.block").alias("token"), "p.i", "p.j", "p.mine", "s1", "n", "shared", "bits")
    united = components(met.groupBy(F.pmod(F.xxhash64("token", "i", "j"), F.lit(max(8, -(-total // 100_000)))).alias("_bin")).applyInArrow(_unite, "a long, b long"))
    sizes = stage(classes.select("s1", "n").join(united, F.col("s1") == F.col("node")).groupBy("root").agg(F.count("*").alias("texts"), F.sum("n").alias("all")))
    small = (F.col("texts") <= max_texts) & (F.col("all") <= max_shingles)
    placed = stage(hot_join(united, sizes, ["root"], "texts", united.count()).withColumn("small", small))
    alone = F.array(F.struct(F.col("root").alias("block"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("mine")))
    whole = placed.filter("small").select(F.col("node").alias("s1"), alone.alias("at"), F.expr("cast(array() as array<bigint>)").alias("tokens"))
    large = placed.filter("not small").select(F.col("node").alias("s1"), "root", "texts", "all")
    if large.isEmpty():
        return whole
    # a large component is cut into pairs of its parts, or, if its texts have sent fewer shingles each than that has parts, by shingle
    cut = F.greatest(_parts("texts", max_texts), _parts("all", max_shingles))
    x = shared.join(large.select("s1", "root", cut.alias("cut")), "s1")
    denser = x.groupBy("root").agg((F.sum("g") >= F.first("cut") * F.countDistinct("s1")).alias("dense"))
    x = hot_join(x.drop("mine"), stage(denser.join(sizes.select("root", "texts"), "root")), ["root"], "texts", total)
    x = x.withColumn("g", F.when(F.col("dense"), F.col("cut")).otherwise(F.greatest(F.col("g"), _parts("every", max_shingles)))).withColumn("mine", F.pmod(F.xxhash64("s1"), F.col("g")).cast("int"))
    parts = x.filter("dense").select("s1", "root", "g", "mine").distinct().select("s1", _places("root", "g", "mine").alias("at"), F.expr("cast(array() as array<bigint>)").alias("tokens"))
    split = x.filter("not dense").groupBy("s1").agg(F.flatten(F.collect_list(_places("token", "g", "mine"))).alias("at"), F.collect_list("token").alias("tokens"))
    return whole.union(parts).union(split)


def _lcp(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    d = np.flatnonzero(a[:n] != b[:n])
    return int(d[0]) if len(d) else n


def tree_join(found: list[np.ndarray]) -> Iterator[tuple[np.ndarray, int]]:
    """For each set that has any, the indexes of the sets alike to it, itself included, and its index."""
    m, size = len(found), np.array([len(x) for x in found], np.int64)
    _, inv, n = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 1]  # a shingle that one set alone has adds to no overlap
    rank = np.full(len(n), -1, np.int64)
    rank[order] = np.arange(len(order))
    cut = np.cumsum(size) - size
    seqs = []
    for a, k in zip(cut.tolist(), size.tolist()):
        r = rank[inv[a : a + k]]
        seqs.append(np.sort(r[r >= 0]))
    by = sorted(range(m), key=lambda i: seqs[i].astype(">u4").tobytes())
    path, own = [seqs[i] for i in by], size[by]
    held = np.array([len(p) for p in path], np.int64)
    lcp = np.array([0, *[_lcp(a, b) for a, b in zip(path, path[1:])]], np.int64)
    step = max(1, _TABLE // max(1, len(order)))
    for q0 in range(0, m, step):
        ask = by[q0 : q0 + step]
        has = np.zeros((len(order), len(ask)), np.uint8)
        for c, i in enumerate(ask):
            has[seqs[i], c] = 1
        nq, kept = size[ask], np.array([len(seqs[i]) for i in ask], np.int64)
        stack = [(0, m, 0, np.arange(len(ask)), np.zeros(len(ask), np.int64))]
        while stack:
            lo, hi, depth, live, part = stack.pop()
            end = int(held[lo]) if hi - lo == 1 else int(lcp[lo + 1 : hi].min())
            if end > depth:
                seg = path[lo][depth:end]
                part = part + (has[seg].sum(0, dtype=np.int64) if len(live) == len(ask) else has[np.ix_(seg, live)].sum(0, dtype=np.int64))
            if hi - lo == 1:
                good = 8 * part >= 3 * (nq[live] + own[lo])
                if good.any():
                    yield by[lo], np.array(ask)[live[good]]
                continue
            # lengths that remain, and sizes, bound what the subtree can reach
            rest = np.minimum(int(held[lo:hi].max()) - end, kept[live] - part)
            least, most = int(own[lo:hi].min()), int(own[lo:hi].max())
            may = (8 * (part + rest) >= 3 * (nq[live] + least)) & (5 * nq[live] >= 3 * least) & (5 * most >= 3 * nq[live])
            if not may.any():
                continue
            live, part = live[may], part[may]
            ends = np.flatnonzero(lcp[lo + 1 : hi] == end) + lo + 1
            for a, b in zip([lo, *ends.tolist()], [*ends.tolist(), hi]):
                stack.append((a, b, end, live, part))


_LINKS = "s1 long, s2 long, links long, root long"


def _judge(rows: pa.Table) -> pa.Table:
    """All blocks of one task: for each class with links, their number in documents, and the least class that it reaches in its block."""
    rows = rows.sort_by([(c, "ascending") for c in ("block", "i", "j", "s1", "s2")])
    col = {c: rows.column(c).to_numpy() for c in ("block", "i", "j", "mine", "s1", "s2", "size")}
    tokens = rows.column("tokens").to_pylist()
    new = np.ones(len(tokens) + 1, bool)
    new[1:-1] = (col["block"][1:] != col["block"][:-1]) | (col["i"][1:] != col["i"][:-1]) | (col["j"][1:] != col["j"][:-1])
    edge, out = np.flatnonzero(new).tolist(), []
    for a, z in zip(edge, edge[1:]):
        own = [k for k in range(a, z) if k == a or (col["s1"][k], col["s2"][k]) != (col["s1"][k - 1], col["s2"][k - 1])]
        if len(own) < 2:
            continue
        by_token, i, j, block = len(tokens[a]) > 0, col["i"][a], col["j"][a], int(col["block"][a])
        links, label = np.zeros(len(own), np.int64), np.arange(len(own))
        size, mine = col["size"][own], col["mine"][own]
        sent = [frozenset(tokens[k]) for k in own] if by_token else []
        for x, like in tree_join(sets(rows.column("text").take(own).combine_chunks())):
            like = like[like != x]
            if i != j:
                like = like[mine[like] != mine[x]]
            if by_token:
                # the pair's block is that of the least shingle that both have sent
                like = np.array([y for y in like.tolist() if min(sent[x] & sent[y], default=None) == block], np.int64)
            if len(like):
                links[x] += size[like].sum()
                joined = np.unique(np.append(label[like], label[x]))
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]
        s1 = col["s1"][own]
        least = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(least, label, s1)
        for k in np.flatnonzero(links).tolist():
            out.append((s1[k], col["s2"][own[k]], links[k], least[label[k]]))
    release()
    names = ["s1", "s2", "links", "root"]
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], names=names)


_KEY = ["_id", "_no", "_h"]


def _row_key(doc_id: Column, h: Column) -> list[Column]:
    """An id and its text's hash, as a key without nulls."""
    return [F.coalesce(doc_id, F.lit(0)).cast("long").alias("_id"), doc_id.isNull().alias("_no"), h.alias("_h")]


def _linked(docs: DataFrame, max_texts: int = BLOCK_TEXTS, max_shingles: int = BLOCK_SHINGLES, hot: int = HOT_TEXTS) -> DataFrame:
    """doc_id, h (a hash of the text), n, n_similar and first (the component's least id, nulls last, and h with it; null without shingles); one row per document."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    both = stage(docs.mapInArrow(_sign, _SIGNED))
    signed = both.filter("not frequent").drop("frequent")
    own = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), "h"))
    classes = stage(signed.filter("s1 is not null").groupBy("s1", "s2").agg(own.alias("own"), F.count("*").alias("size"), F.first("n").alias("n")))
    count = signed.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    spark, own_tables = docs.sparkSession, len(STAGED)
    at = blocks(prefixes(docs, count["n"] or 0, frequent(both, count["rows"]), hot), max_texts, max_shingles)
    needed = stage(classes.join(at, "s1").select(*_row_key(F.col("own.id"), F.col("own.h")), "s1", "s2", "size", "n", "at", "tokens"))
    drop_between(spark, own_tables)  # blobs, shingles and parities have served
    # texts of other rows don't move; of rows with the same id and text, one does
    rows = docs.select("text", *_row_key(F.col("doc_id"), F.col("h")))
    rows = maybe_in(rows, F.xxhash64(*_KEY), needed.select(F.xxhash64(*_KEY).alias("key"))).groupBy(*_KEY).agg(F.first("text").alias("text"))
    loaded = rows.join(needed.drop("n").hint("shuffle_hash"), _KEY).withColumn("at", F.explode("at")).select("at.*", "s1", "s2", "size", "tokens", "text")
    spread = needed.agg(F.sum(F.col("n") * F.size("at")).alias("n")).first()["n"] or 0
    bins = max(8, -(-spread // (BLOCK_SHINGLES // 2)))
    links = stage(loaded.groupBy(F.pmod(F.xxhash64("block", "i", "j"), F.lit(bins)).alias("_bin")).applyInArrow(_judge, _LINKS))
    drop_between(spark, own_tables)
    united = components(links.filter("s1 <> root").select(F.col("s1").alias("a"), F.col("root").alias("b")))
    of_class = links.groupBy("s1", "s2").agg(F.sum("links").alias("links"))
    classes = stage(classes.join(of_class, ["s1", "s2"], "left").join(united, F.col("s1") == F.col("node"), "left").drop("node"))
    least = stage(classes.filter("root is not null").groupBy("root").agg(F.min("own").alias("least"), F.count("*").alias("k")))
    classes = hot_join(classes, least, ["root"], "k", classes.count())
    known = classes.select("s1", "s2", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_similar"), F.coalesce("least", "own").alias("first"))
    return hot_join(signed, known, ["s1", "s2"], "size", count["rows"]).select("doc_id", "h", "n", "n_similar", "first")


def similar(docs: DataFrame, max_texts: int = BLOCK_TEXTS, max_shingles: int = BLOCK_SHINGLES, hot: int = HOT_TEXTS) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id; one row per document."""
    x = _linked(docs, max_texts, max_shingles, hot)
    return x.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).alias("n_similar"), F.coalesce("first.id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, but of each component only one, of the smallest id (nulls last). Rows without shingles all stay."""
    marked = stage(_linked(docs).filter("first is not null"))
    mine = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    key = _row_key(F.col("doc_id"), F.col("h"))
    drop = marked.filter(~mine).select(*key).withColumn("_all", F.lit(True)).distinct()
    again = marked.filter(mine).groupBy(*key).count().filter("count > 1").select(*_KEY, F.lit(False).alias("_all"))
    out = stage(drop.unionByName(again))
    rows = docs.select(whole_row(docs), *_row_key(F.col("doc_id").cast("long"), F.xxhash64("text")))
    at = out.select(F.xxhash64(*_KEY).alias("key"))
    # rows that the bitmap clears stay where they are; the others are few
    clear = maybe_in(rows, F.xxhash64(*_KEY), at, False)
    met = maybe_in(rows, F.xxhash64(*_KEY), at).join(out.hint("shuffle_hash"), _KEY, "left")
    one = met.filter("not _all").groupBy(*_KEY).agg(F.first("_row").alias("_row"))
    stay = clear.select("_row").union(met.filter("_all is null").select("_row")).union(one.select("_row"))
    return stay.select(*spread_row(stay, docs.columns))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
w AS (SELECT r, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM d),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) < 2 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS g FROM w),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.r <> b.r GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 60 * (x.n + y.n - c)),
k AS (SELECT a, count(*) AS k FROM l GROUP BY a),
z(a, b) AS (SELECT a, b FROM l UNION SELECT z.a, l.b FROM z JOIN l ON l.a = z.b),
m AS (SELECT z.a, min(doc_id) AS m FROM z JOIN d ON d.r = z.b GROUP BY z.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(k, 0) AS n_similar, coalesce(least(m, doc_id), doc_id) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN k ON k.a = d.r LEFT JOIN m ON m.a = d.r
"""
