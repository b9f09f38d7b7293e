"""Best-fit packing (2): documents into sequences of CAPACITY tokens, by a configuration linear program.

One pass tokenises whole texts and writes the pieces; a piece knows its task and its rank among the task's pieces of the
same length. The histogram of lengths, at most CAPACITY numbers whatever the corpus, is all that planning needs:

1. Multiplicative weights solve the program "least number of bins, each filled by some configuration of lengths, that
   covers the histogram". A length's price falls as it gets covered. Each round prices by a knapsack dynamic program,
   whose table also gives the best configuration that holds each length; all those near the optimum get a share.
2. Rounding: the program's support is taken from the fullest configurations on, each a whole number of times while its
   pieces last. Most lengths are rare, so most uses are fractions; rounding all down would place next to nothing.
3. What is left goes best fit, longest first, into the open room of those bins and then new ones, by groups of equal
   bins, so that this too depends on the histogram and not on the number of pieces.

If plain best fit needs fewer bins than the rounded program, its plan is used. The plan gives each length's ranks their
places; a piece's rank is its task's offset plus its own, so a length that a third of all pieces share needs no sort.

Null text: empty, one token (the id that ends a document). Null doc_id and repeated rows: pieces like others. Empty
table: empty result. Other columns of the pieces pass through `pack`.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import batches, named, release, stage, table

CAPACITY, END = 2048, 0
#: Rounds of multiplicative weights, the rate at which weights fall, and how near the optimum a configuration must price.
ROUNDS, RATE, NEAR = 100, 2.0, 0.02
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids as the tokenizers library gives them for its file. A plain byte-level BPE file without options is run by the tiktoken library, which is several times as fast; texts that hold an added token's string, and all other files, by tokenizers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        self.fast = None
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        plain = plain and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if plain:
            self.fast = self._tiktoken(model)

    @staticmethod
    def _tiktoken(model: dict):
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(sorted(set(range(256)) - set(shown)))}
        try:
            ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items()}
        except KeyError:
            return None
        merged = [ranks.get(bytes(of[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))) for m in model["merges"]]
        if None in merged or any(a >= b for a, b in zip(merged, merged[1:])) or len(ranks) != 256 + len(merged):
            return None  # ids aren't in the order of the merges
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(x in text for x in self.added):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Where the pieces of a document of n tokens start; the first piece takes the remainder."""
    return [0, *range(n % capacity or capacity, n, capacity)]


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), part, rank: whole texts, then the id that ends a document, in pieces."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches(it, "text", 4 << 20):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.array([*e.ids(text or ""), end], "<u4")
                at = cuts(len(ids), capacity)
                for i, (x, y) in enumerate(zip(at, [*at[1:], len(ids)])):
                    rows.append((doc, i, x, y - x, ids[x:y].tobytes(), part, int(seen[y - x])))
                    seen[y - x] += 1
            cols = list(zip(*rows))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids", "part", "rank"])
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, part int, rank long")


class _Bins:
    """Bins by configuration: (length, times) pairs, longest first -> how many bins."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.by_room = capacity, defaultdict(Counter)

    def add(self, config: tuple, n: int) -> None:
        self.by_room[self.capacity - sum(a * k for a, k in config)][config] += n

    def total(self) -> int:
        return sum(sum(x.values()) for x in self.by_room.values())

    def best_fit(self, left: dict[int, int]) -> None:
        """Place the lengths' pieces, longest first, each in the bin with least room that takes it."""
        for size in sorted(left, reverse=True):
            n, room = left[size], size
            while n:
                while room <= self.capacity and not self.by_room.get(room):
                    room += 1
                if room > self.capacity:
                    k = min(n, self.capacity // size)
                    self.add(((size, k),), n // k)
                    n %= k
                    if n:
                        self.add(((size, n),), 1)
                    break
                config, bins = next(iter(self.by_room[room].items()))
                k = min(room // size, n)  # a bin that was best stays so while it takes more
                take = min(bins, n // k)
                del self.by_room[room][config]
                if bins > take:
                    self.by_room[room][config] = bins - take
                merged = Counter(dict(config))
                merged[size] += k
                self.add(tuple(sorted(merged.items(), reverse=True)), take)
                n -= take * k
                if n and not self.by_room[room]:
                    room += 1


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> dict[tuple, float]:
    """A fractional cover of the histogram: configuration -> how many bins."""
    sizes = np.array(sorted(x for x, n in histogram.items() if n and x < capacity))
    if not len(sizes):
        return {}
    need = np.array([histogram[x] for x in sizes.tolist()], np.float64)
    price, used = sizes / capacity, defaultdict(float)
    bins = float((sizes * need).sum() / capacity)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    covered = np.zeros(len(sizes))
    for t in range(rounds):
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes[0]), capacity + 1):
            n = upto[c]
            v = price[:n] + best[c - sizes[:n]]
            i = int(v.argmax())
            if v[i] > best[c - 1]:
                best[c], choice[c] = v[i], i
            else:
                best[c], choice[c] = best[c - 1], -2  # leave one unit of room
        value = price + best[capacity - sizes]
        near = np.flatnonzero(value >= (1 - NEAR) * best[capacity])
        share = need[near] * price[near]
        share *= bins / rounds / share.sum()
        got = np.zeros(len(sizes))
        for i, s in zip(near.tolist(), share.tolist()):
            config, c = [i], capacity - int(sizes[i])
            while c > 0 and choice[c] != -1:
                if choice[c] == -2:
                    c -= 1
                else:
                    config.append(int(choice[c]))
                    c -= int(sizes[choice[c]])
            np.add.at(got, config, s)
            used[tuple(sorted(config))] += s
        covered += got
        # weights fall with what has been covered so far, against what a cover at an even pace would have
        behind = (t + 1) / rounds - covered / need
        price = sizes / capacity * np.exp(np.clip(RATE * behind, -40, 40))
    return {tuple((int(sizes[i]), k) for i, k in sorted(Counter(x).items(), reverse=True)): n for x, n in used.items()}


def rounded(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[_Bins, dict[int, int]]:
    """Bins of the program's configurations, and what they leave of the histogram. Fullest first, then most used, each is taken its number of times, rounded, but once at least, while all its pieces last."""
    left, out = dict(histogram), _Bins(capacity)
    if full := left.pop(capacity, 0):
        out.add(((capacity, 1),), full)
    room = lambda config: capacity - sum(a * k for a, k in config)
    for config, x in sorted(configurations(left, capacity).items(), key=lambda y: (room(y[0]), -y[1], y[0])):
        n = min([max(1, round(x)), *[left[a] // k for a, k in config]])
        if n:
            out.add(config, n)
            for a, k in config:
                left[a] -= n * k
    return out, {a: n for a, n in left.items() if n}


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """Configurations and how many bins of each; every piece of the histogram has one place."""
    plain = _Bins(capacity)
    plain.best_fit(dict(histogram))
    of_program, left = rounded(histogram, capacity)
    of_program.best_fit(left)
    best = min(of_program, plain, key=_Bins.total)
    return [(c, n) for room in sorted(best.by_room) for c, n in sorted(best.by_room[room].items()) if n]


def places(bins: list[tuple[tuple, int]]) -> dict[str, np.ndarray]:
    """For ranges of ranks of a length, ascending by length and rank: the first rank, the first sequence, pieces of this length in a sequence, and where the first one starts."""
    taken, rows, sequence = Counter(), [], 0
    for config, n in bins:
        offset = 0
        for size, k in config:
            rows.append((size, taken[size], sequence, k, offset))
            taken[size] += n * k
            offset += size * k
        sequence += n
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "times", "offset"), np.array(rows, np.int64).reshape(-1, 5).T.copy()))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (staged: length, part, rank and any others) with sequence_id and offset, without part and rank."""
    counts = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    at = places(plan(histogram, capacity))  # grows with the lengths, not with the pieces
    before = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    offsets = counts.select("part", "length", before.alias("_before"))
    shared = pieces.sparkSession.sparkContext.broadcast(at)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        x = shared.value
        size, r = length.to_numpy(), rank.to_numpy()
        key = x["length"] << 48 | x["rank"]
        i = np.searchsorted(key, size << 48 | r, side="right") - 1
        k = r - x["rank"][i]
        return pd.DataFrame({"sequence_id": x["sequence"][i] + k // x["times"][i], "offset": x["offset"][i] + k % x["times"][i] * size})

    out = pieces.join(offsets, ["part", "length"]).withColumn("_at", place(F.col("length"), F.col("_before") + F.col("rank")))
    keep = [c for c in pieces.columns if c not in ("part", "rank", "sequence_id", "offset")]
    return out.select(*[named(c) for c in keep], "_at.sequence_id", "_at.offset")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """The query's columns for any documents."""
    import public_tokenizers

    pieces = stage(tokenise(docs, public_tokenizers.path("byte_bpe_50k.json")))
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
