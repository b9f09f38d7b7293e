"""Chat formatting (3): a hidden Markov model recovers who speaks in a transcript, and turns are rendered anew.

A line's hidden state is a role and whether the line opens a turn. What is seen of it is one of a few hundred symbols: the
kind of speaker marker, if any, and whether the line is blank, asks, and how long it is. Transition, emission and initial
counts are sums over all labelled pages, gathered before the shuffle; the model has a fixed size. Viterbi decodes each
whole transcript; markers are cut off and turns are rendered in one canonical form.

`pages` makes transcripts of turns: a conversation is cut into pages of PAGE turns, so one that holds a third of all rows
is many rows and tasks. Where PAGE turn numbers have more rows than that, as repeats and null keys make, these are sorted
over all tasks and numbered, and further pages of PAGE rows follow; later pages of the conversation move up. Null text: an empty turn. Null role: unlabelled, counted as "user" in training and lost in noisy
marks. Null conversation ids form conversations of their own page. Ties in turn are ordered by role, then text. An empty
or null transcript gives no turns; an empty table an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_join, named, spread_row, stage, table

ROLES = ["user", "assistant", "system"]
PAGE = 256
_MARKS = {
    1: r"user|human|customer|client|question|q|me|you", 2: r"assistant|bot|ai|agent|answer|a|model|gpt", 3: r"system|instructions?|context",
}
_KNOWN = re.compile(r"^\s*(?:#{1,4}\s*|\[|<\|?|\*\*)?(?:" + "|".join(f"(?P<r{k}>{v})" for k, v in _MARKS.items()) + r")(?:\]|\|?>|\*\*)?\s*(?P<end>[:>\]-]+|$)\s*", re.I)
_NAMED = re.compile(r"^\s*[A-Z][\w .'-]{0,24}:\s")
SYMBOLS = 5 * 2 * 2 * 3


def mark(line: str) -> tuple[int, int]:
    """The kind of marker that a line starts with (0: none, 1 to 3: of a role, 4: another name) and where it ends."""
    if m := _KNOWN.match(line):
        bare = not m["end"] and not line.lstrip()[:1] in "#[<*"
        if not bare:
            return next(k for k in _MARKS if m[f"r{k}"]), m.end()
    return (4, 0) if _NAMED.match(line) else (0, 0)


def symbol(line: str) -> int:
    kind, _ = mark(line)
    rest = line.strip()
    size = 0 if len(rest) < 40 else 1 if len(rest) < 160 else 2
    return ((kind * 2 + (not rest)) * 2 + rest.endswith("?")) * 3 + size


class Model:
    """States: role * 2 + (0: opens a turn, 1: goes on)."""

    def __init__(self, first: np.ndarray, step: np.ndarray, seen: np.ndarray) -> None:
        log = lambda x, a: np.log((x + a) / (x + a).sum(-1, keepdims=True))
        self.first, self.step, self.seen = log(first, 0.1), log(step, 0.1), log(seen, 0.05)

    def decode(self, lines: list[str]) -> list[int]:
        """The most probable states."""
        if not lines:
            return []
        seen = self.seen[:, [symbol(x) for x in lines]].T
        score, back = self.first + seen[0], np.empty((len(lines), len(self.first)), np.int64)
        for i in range(1, len(lines)):
            way = score[:, None] + self.step
            back[i] = way.argmax(0)
            score = way.max(0) + seen[i]
        out = [int(score.argmax())]
        for i in range(len(lines) - 1, 0, -1):
            out.append(int(back[i, out[-1]]))
        return out[::-1]

    def turns(self, transcript: str | None) -> list[tuple[str, str]]:
        """Role and text of each turn, markers cut off."""
        lines = (transcript or "").split("\n") if (transcript or "").strip() else []
        out: list[tuple[str, list[str]]] = []
        for line, s in zip(lines, self.decode(lines)):
            role = ROLES[s // 2]
            kind, end = mark(line)
            text = line[end:] if kind in (1, 2, 3) else line
            if s % 2 == 0 or not out or out[-1][0] != role:
                out.append((role, [text]))
            else:
                out[-1][1].append(text)
        return [(r, "\n".join(x).strip()) for r, x in out]


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>\n"


def _noisy(role: Column, text: Column, style: Column, lost: Column) -> Column:
    """A turn as some chat log might have it. lost: the mark is missing, a blank line tells the turn."""
    who = lambda a, b, c: F.when(role == "assistant", b).when(role == "system", c).otherwise(a)
    marks = [who("User: ", "Assistant: ", "System: "), who("### Human\n", "### Assistant\n", "### System\n"), who("Q: ", "A: ", "Context: "), who("[user] ", "[bot] ", "[system] "), who("USER> ", "AI> ", "SYSTEM> ")]
    put = marks[-1]
    for i, m in enumerate(marks[:-1]):
        put = F.when(style == i, m).otherwise(put)
    return F.concat(F.when(lost, F.lit("\n")).otherwise(put), text)


def _over(rows: DataFrame) -> DataFrame:
    """Rows of _conv, bucket, turn, role, text, _row and others, numbered in pos within each conversation's bucket, in order of turn, role and text."""
    order = ["_conv", "bucket", "turn", "role", "text", "_row"]
    # _row parts equal rows; staged, so that numbers are those of rows as written
    rows = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    parts = rows.groupBy("_conv", "bucket", "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_conv", "bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_conv", "bucket", "_part", (F.col("_first") - before).alias("_first"))
    return rows.join(parts, ["_conv", "bucket", "_part"]).withColumn("pos", F.col("_id") - F.col("_first")).drop("_id", "_part", "_first")


def pages(conversations: DataFrame) -> DataFrame:
    """conv_id, page, transcript, states: noisy transcripts of conversations and the true state of each of their lines."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("-"))
    text, role, turn = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit("user")), F.coalesce("turn", F.lit(0)).cast("long")
    x = conversations.select("conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("_conv"), F.floor(turn / PAGE).cast("long").alias("bucket"), turn.alias("turn"), role.alias("role"), text.alias("text"), F.pmod(F.xxhash64(key), F.lit(5)).alias("style"), (F.pmod(F.xxhash64(key, turn), F.lit(8)) == 0).alias("lost"))
    counts = stage(x.groupBy("_conv", "bucket").agg(F.count("*").alias("k")))
    if counts.filter(F.col("k") > PAGE).isEmpty():
        x = x.withColumn("page", F.col("bucket")).withColumn("opens", F.col("turn") % PAGE == 0)
    else:
        more = F.coalesce(F.sum(F.ceil(F.col("k") / PAGE) - 1).over(Window.partitionBy("_conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = stage(counts.withColumn("page", (F.col("bucket") + more).cast("long")))
        # a row's number in its file, which a task that is run again repeats
        x = hot_join(x.withColumn("_row", F.monotonically_increasing_id()), counts, ["_conv", "bucket"], "k", counts.agg(F.sum("k")).first()[0])
        large = _over(x.filter(F.col("k") > PAGE)).withColumn("opens", F.col("pos") % PAGE == 0).withColumn("page", F.col("page") + F.floor(F.col("pos") / PAGE))
        small = x.filter(F.col("k") <= PAGE).withColumn("opens", F.col("turn") % PAGE == 0)
        x = small.unionByName(large.drop("pos"))
    x = x.withColumn("said", _noisy(F.col("role"), F.col("text"), F.col("style"), F.col("lost") & ~F.col("opens")))
    index = F.when(F.col("role") == "assistant", 1).when(F.col("role") == "system", 2).otherwise(0)
    n = F.size(F.split("said", "\n", -1))
    # a lost mark's blank line opens the turn
    state = F.concat(F.array(index * 2), F.when(n > 1, F.array_repeat(index * 2 + 1, n - 1)).otherwise(F.expr("cast(array() as array<int>)")))
    x = x.select("conv_id", "page", F.struct("turn", "role", (~F.col("opens")).alias("later"), "said", state.alias("state")).alias("t"))
    return x.groupBy("conv_id", "page").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", "page", F.concat_ws("\n", "t.said").alias("transcript"), F.flatten("t.state").alias("states"))


def _tally(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = 2 * len(ROLES)
    first, step, seen = np.zeros(s, np.int64), np.zeros((s, s), np.int64), np.zeros((s, SYMBOLS), np.int64)
    for b in it:
        for text, states in zip(b.column("transcript").to_pylist(), b.column("states").to_pylist()):
            lines = text.split("\n")
            first[states[0]] += 1
            np.add.at(step, (states[:-1], states[1:]), 1)
            np.add.at(seen, (states, [symbol(x) for x in lines]), 1)
    rows = [(k, i, n) for k, x in enumerate((first, step, seen)) for i, n in enumerate(x.ravel().tolist()) if n]
    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["kind", "at", "n"])


def fit(labelled: DataFrame) -> Model:
    """The model of all labelled transcripts (transcript, states)."""
    s = 2 * len(ROLES)
    out = np.zeros(s), np.zeros(s * s), np.zeros(s * SYMBOLS)
    for r in labelled.select("transcript", "states").mapInArrow(_tally, "kind long, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():  # the model's parameters
        out[r["kind"]][r["at"]] = r["n"]
    return Model(out[0], out[1].reshape(s, s), out[2].reshape(s, SYMBOLS))


def parse_transcripts(df: DataFrame, model: Model, keys: list[str], text: str = "transcript") -> DataFrame:
    """The keys, turn (from 0), role, text and rendered, a row for each turn found."""
    own = df.select(*[named(c) for c in keys])
    kept = df.select(F.struct(*[named(c) for c in keys]).alias("_row"), named(text).alias("_text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, rows = [], []
            for i, x in enumerate(b.column("_text").to_pylist()):
                for j, (role, said) in enumerate(model.turns(x)):
                    at.append(i)
                    rows.append((j, role, said, render(role, said)))
            cols = list(zip(*rows)) if rows else [[]] * 4
            row = b.column("_row").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([row, *[pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.string(), pa.string(), pa.string()))]], names=["_row", "turn", "role", "text", "rendered"])

    more = [T.StructField("turn", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("role", "text", "rendered")]]
    out = kept.mapInArrow(run, T.StructType([kept.schema["_row"], *more]))
    return out.select(*spread_row(out, own.columns), "turn", "role", "text", "rendered")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = stage(pages(table(spark, sf_dir, "conversations")))
    return parse_transcripts(written, fit(written), ["conv_id", "page"])
