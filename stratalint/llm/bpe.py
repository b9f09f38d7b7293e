"""Byte-level BPE (6): encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is itself an entry. Tier two: all other
pre-tokens start as linked bytes, and a heap of (rank, place) merges the adjacent pair of least rank, leftmost first,
until none is in the vocabulary. A bounded memo of pre-tokens keeps frequent words from being merged again.

Texts are encoded whole, in Arrow batches, one pass and no shuffle. Null text: the empty text, no tokens. Special
tokens' strings are ordinary text. Repeated rows: each is encoded. Empty table: empty result. The input's own columns
pass through `encode_documents` as they are; a column named ids is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, spread_row, table, whole_row

#: Entries of a generation of the memo of pre-tokens, and of the table of pairs, in each worker.
MEMO, PAIRS = 400_000, 1_000_000
_M, _STEP, _STIR = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


class PerfectHash:
    """Minimal perfect hash, hash-and-displace: n keys in n slots. Its only table is one displacement for every four keys or so; a key of a bucket of its own has its slot there, negative. Small sets may need several seeds."""

    def __init__(self, keys: list[bytes]) -> None:
        n = len(keys)
        for seed in range(1, 1000):
            self.n, self.seed, self.buckets = n, seed, max(1, n // 4)
            h = np.array([xxhash.xxh3_64_intdigest(k, seed) for k in keys], dtype=np.uint64)
            if self._place(h):
                return
        raise ValueError("the keys aren't distinct")

    def _place(self, h: np.ndarray) -> bool:
        n, bucket = self.n, (h % np.uint64(self.buckets)).astype(np.int64)
        self.displace, self.key_of = [0] * self.buckets, np.full(n, -1, np.int64)
        free, order = np.ones(n, bool), np.argsort(bucket, kind="stable")
        count = np.bincount(bucket, minlength=self.buckets)
        start, tries = np.concatenate([[0], np.cumsum(count)]), np.arange(256, dtype=np.uint64)[:, None]
        for q in np.argsort(-count, kind="stable"):
            own = order[start[q] : start[q + 1]]
            if len(own) < 2:
                break
            for first in range(0, 1 << 16, 256):
                x = h[own] + (tries + np.uint64(first)) * np.uint64(_STEP)
                x = (x ^ (x >> np.uint64(32))) * np.uint64(_STIR)
                slots = ((x ^ (x >> np.uint64(29))) % np.uint64(n)).astype(np.int64)
                fits = free[slots].all(1)
                for i in np.flatnonzero(fits):
                    if len(np.unique(slots[i])) == len(own):
                        self.displace[q], free[slots[i]], self.key_of[slots[i]] = first + int(i), False, own
                        break
                else:
                    continue
                break
            else:
                return False
        for q, slot in zip(np.flatnonzero(count == 1), np.flatnonzero(free)):
            self.displace[q], self.key_of[slot] = -int(slot) - 1, order[start[q]]
        return bool((np.sort(self.key_of) == np.arange(n)).all())

    def slot(self, key: bytes) -> int:
        """The key's slot in 0..n-1; for other bytes, any slot."""
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        d = self.displace[h % self.buckets]
        if d < 0:
            return -d - 1
        x = h + d * _STEP & _M
        x = (x ^ x >> 32) * _STIR & _M
        return (x ^ x >> 29) % self.n


_CONTRACTED = r"'s|'t|'re|'ve|'m|'ll|'d"
#: Python's \w, \d and \s are not the tokenizer's classes for these characters; texts with any take the exact pattern.
_UNUSUAL = re.compile("[\x1c-\x1f²³¹¼-¾ɐ-\U0010ffff]")
_USUAL = re.compile(rf"{_CONTRACTED}| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_exact: list[re.Pattern] = []


def _exact_pattern() -> re.Pattern:
    """The pattern with character classes as the reference encoder's regex engine has them, found by asking it."""
    if not _exact:
        import tiktoken

        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))

        def members(p: str) -> str:
            e = tiktoken.Encoding("class", pat_str=p, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            at = sorted(map(ord, bytes(e.encode_ordinary(every)).decode()))
            cuts = [0, *[i for i in range(1, len(at)) if at[i] != at[i - 1] + 1], len(at)]
            return "".join(f"\\U{at[i]:08x}-\\U{at[j - 1]:08x}" for i, j in zip(cuts, cuts[1:]))

        letter, number, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
        _exact.append(re.compile(rf"{_CONTRACTED}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"))
    return _exact[0]


def pre_tokens(text: str) -> list[str]:
    return (_exact_pattern() if _UNUSUAL.search(text) else _USUAL).findall(text)


class Codec:
    """Encoder and decoder for a file of ranks: a line has an entry in base64 and its rank, which is its id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(x): int(r) for x, r in map(bytes.split, f)}
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.entry = [keys[i] for i in self.hash.key_of]
        self.id = [ranks[k] for k in self.entry]
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for k, r in ranks.items():
            self.bytes_of[r] = k
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.of_byte = [ranks[bytes([i])] for i in range(256)]
        self.memo, self.pairs = _Memo(self), {}

    def find(self, key: bytes) -> int:
        """The id of an entry, or -1."""
        s = self.hash.slot(key)
        return self.id[s] if self.entry[s] == key else -1

    def _pair(self, a: int, b: int) -> int:
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        r = self.pairs[a << 32 | b] = self.find(self.bytes_of[a] + self.bytes_of[b])
        return r

    def merge(self, word: bytes) -> list[int]:
        """Tier two. ids and the links are by place; a merged pair lives on at its left place."""
        n, pairs, pair = len(word), self.pairs, self._pair
        ids = [self.of_byte[c] for c in word]
        heap = []
        for i in range(n - 1):
            k = ids[i] << 32 | ids[i + 1]
            r = pairs[k] if k in pairs else pair(ids[i], ids[i + 1])
            if r >= 0:
                heap.append(r << 40 | i)
        heapify(heap)
        after, before, low = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << 40) - 1
        while heap:
            x = heappop(heap)
            i, r = x & low, x >> 40
            a, j = ids[i], after[i]
            if a < 0 or j >= n or pairs.get(a << 32 | ids[j], pair) is pair and pair(a, ids[j]) != r or pairs[a << 32 | ids[j]] != r:
                continue  # one of the two has been merged since
            ids[i], ids[j], k = r, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                t = r << 32 | ids[k]
                q = pairs[t] if t in pairs else pair(r, ids[k])
                if q >= 0:
                    heappush(heap, q << 40 | i)
            h = before[i]
            if h >= 0:
                t = ids[h] << 32 | r
                q = pairs[t] if t in pairs else pair(ids[h], r)
                if q >= 0:
                    heappush(heap, q << 40 | h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, pre_tokens(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Memo(dict):
    """Ids of the pre-tokens met lately, in two generations of at most MEMO: those still in use when the younger one is full are taken over as they come."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.old = codec, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        v = self.old.get(word)
        if v is None:
            b = word.encode()
            r = self.codec.find(b)
            v = (r,) if r >= 0 else tuple(self.codec.merge(b))
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[word] = v
        return v


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker process and path."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs with ids, array<int>."""
    kept = docs.drop("ids")
    rows = kept.select(whole_row(kept), F.col("text").alias("_text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches(it, "_text"):
            ids = pa.array([c.encode(x or "") for x in b.column("_text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("_row"), ids], names=["_row", "_ids"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("_ids", T.ArrayType(T.IntegerType()))]))
    return out.select(*spread_row(out, kept.columns), F.col("_ids").alias("ids"))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with decoded, the bytes of ids (null: none)."""
    kept = encoded.drop("decoded")
    rows = kept.select(whole_row(kept), F.col("ids").alias("_ids"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in it:
            out = pa.array([c.decode(x or []) for x in b.column("_ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("_row"), out], names=["_row", "_bytes"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("_bytes", T.BinaryType())]))
    return out.select(*spread_row(out, kept.columns), F.col("_bytes").alias("decoded"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text and decodes its ids again, in one pass."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches(it, "text"):
            n, of_ids, of_bytes = [], [], []
            for text in b.column("text").to_pylist():
                ids = c.encode(text or "")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
