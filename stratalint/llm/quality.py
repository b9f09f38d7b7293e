"""Quality rules (5) with thresholds that adapt to each language and source, from mergeable quantile sketches.

One pass over the texts gives each document's measures. Documents that pass the base rule feed a sketch for each
(lang, source) and measure: a log-linear histogram whose cell keeps the leading six bits of an integer, hence a relative
error of at most 1/32 for any quantile. Such sketches merge by adding counts, in any order, so Spark's partial
aggregation builds them before the shuffle, a hot source included. A group's quantiles are drawn towards those of its
language, and a language's towards those of all, as if PRIOR documents more had had them: every group has thresholds of its
own, and no size switches. A measure's fence is median + K * max(median - lower quartile, FLOOR): its
spread comes from the lower half, so junk, which is in the upper half, can't raise its own threshold.

Null text: no words, base_failed. Null lang or source: the group "". Null doc_id: kept as it is. Repeated rows: each is
a row of the result. Empty table: empty result. `filter_documents` carries all other columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .common import batches, parts_of, release, small_join, spread_row, stage, table, whole_row

#: Measure -> (K, FLOOR): per mille of words, of word length or of lines.
FENCES = {"symbols": (4, 50), "length": (30, 100), "lines": (4, 100), "repeats": (4, 50)}
#: Documents by whose weight a group's parent counts; words from which the mean word length tells anything.
PRIOR, MIN_WORDS = 200, 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the number of lines that have a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes.split() splits at exactly \x20 and \x09-\x0D
    n, count = len(words), text.count
    chars = len(text) - count(" ") - count("\n") - count("\t") - count("\r") - count("\x0b") - count("\x0c")
    symbols = count("#") + count("*") + count("$") + count("%") + count("&") + count("|") + count("<") + count(">")
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    repeats = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) < n - 4:
            first: dict[tuple, int] = {}
            twice = [False] * (n - 4)
            for i, x in enumerate(windows):
                j = first.setdefault(x, i)
                if j != i:
                    twice[i] = twice[j] = True
            end = 0
            for i, x in enumerate(twice):
                if x:
                    repeats += i + 5 - max(i, end)
                    end = i + 5
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, len(lines)


def _measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it, "text"):
        found = list(zip(*map(measures, batch.column("text").to_pylist())))
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(x, pa.int64()) for x in found], names=[*rest, *COUNTS, "n_lines"])
    release()


def _counted(texts: pa.Array) -> pa.Array:
    found = list(zip(*(measures(x) for some in parts_of(texts) for x in some))) or [()] * (len(COUNTS) + 1)
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], names=[*COUNTS, "n_lines"])


def _keys() -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source (null: ""), the counts, the measures in per mille and base_failed; one row per document."""
    kept = docs.select(F.col("doc_id").cast("long"), *_keys(), "text")
    schema = T.StructType([*[f for f in kept.schema if f.name != "text"], *[T.StructField(c, T.LongType()) for c in [*COUNTS, "n_lines"]]])
    return _rated(kept.mapInArrow(_measure, schema))


def _rated(counted: DataFrame) -> DataFrame:
    """counted, with the measures in per mille and base_failed."""
    per = lambda a, b: F.when(F.col(b) > 0, F.expr(f"(1000 * {a}) div {b}")).otherwise(F.lit(0)).cast("long")
    return counted.select(
        "*", per("n_symbols", "n_words").alias("symbols"), per("word_chars", "n_words").alias("length"),
        per("n_dup_lines", "n_lines").alias("lines"), per("n_repeat_words", "n_words").alias("repeats"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
    )


def cell(v: Column) -> Column:
    """The sketch's cell of a non-negative integer: its leading six bits, the others zero."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, cell, n: the sketches of the documents that pass the base rule. Merge them by adding n."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in FENCES])).alias("x")
    rows = measured.filter(~F.col("base_failed")).select("lang", "source", each).select("lang", "source", "x.measure", cell(F.col("x.v")).alias("cell"))
    return rows.groupBy("lang", "source", "measure", "cell").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The number of documents, lower quartile and median of each key and measure, from merged sketches."""
    merged = sketch.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*keys, "measure")
    rank = merged.select("*", F.sum("n").over(by.orderBy("cell")).alias("upto"), F.sum("n").over(by).alias("docs"))
    at = lambda a, b: F.min(F.when(F.col("upto") * b >= F.col("docs") * a, F.col("cell")))
    return rank.groupBy(*keys, "measure").agg(F.first("docs").alias("docs"), at(1, 4).alias("q1"), at(1, 2).alias("q2"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, then for each measure <measure>_hi and for the word length also length_lo."""
    own, lang, every = quantiles(sketch, ["lang", "source"]), quantiles(sketch, ["lang"]), quantiles(sketch, [])
    pack = lambda df, name: df.select(*[c for c in df.columns if c not in ("docs", "q1", "q2")], F.struct("docs", "q1", "q2").alias(name))
    x = pack(own, "own").join(pack(lang, "of_lang"), ["lang", "measure"]).join(F.broadcast(pack(every, "of_all")), "measure")  # of_all: four rows
    blend = lambda docs, own, parent: F.expr(f"({docs} * {own} + {PRIOR} * {parent}) div ({docs} + {PRIOR})")
    for q in ("q1", "q2"):
        x = x.withColumn(f"_{q}", blend("of_lang.docs", f"of_lang.{q}", f"of_all.{q}")).withColumn(q, blend("own.docs", f"own.{q}", f"_{q}"))
    x = x.select("lang", "source", "measure", F.struct("q1", "q2").alias("q"))
    out = []
    for m, (k, floor) in FENCES.items():
        width = k * F.greatest(F.col("q.q2") - F.col("q.q1"), F.lit(floor))
        out.append(F.max(F.when(F.col("measure") == m, F.col("q.q2") + width)).alias(f"{m}_hi"))
        if m == "length":
            out.append(F.max(F.when(F.col("measure") == m, F.col("q.q2") - width)).alias(f"{m}_lo"))
    return x.groupBy("lang", "source").agg(*out)


def _verdicts(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured, with kept; limits: staged thresholds."""
    x = small_join(measured, limits, ["lang", "source"], limits.count())
    long = F.col("n_words") >= MIN_WORDS
    bad = (F.col("symbols") > F.col("symbols_hi")) | (F.col("lines") > F.col("lines_hi")) | (F.col("repeats") > F.col("repeats_hi"))
    bad = bad | (long & ((F.col("length") > F.col("length_hi")) | (F.col("length") < F.col("length_lo"))))
    return x.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(bad, F.lit(False))).drop(*[f"{m}_hi" for m in FENCES], "length_lo")


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, source, the counts and measures, base_failed, kept."""
    measured = stage(measure(docs))
    return _verdicts(measured, stage(thresholds(sketches(measured))))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep. Texts are measured twice, once for the sketches and once for the verdicts; no text is shuffled, and of a row its text alone goes to a worker, and none comes back."""
    limits = stage(thresholds(sketches(measure(docs))))
    counted = F.arrow_udf(_counted, ", ".join(f"{c} long" for c in [*COUNTS, "n_lines"])).asNondeterministic()  # so that no filter has it called again
    rows = docs.select(whole_row(docs), *_keys(), counted("text").alias("_counted")).select("_row", "lang", "source", "_counted.*")
    return _verdicts(_rated(rows), limits).filter("kept").select(*spread_row(docs, docs.columns))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def _sql() -> str:
    """The query in DuckDB's SQL."""

    def level(name: str, keys: str) -> str:
        by = f"{keys}, measure" if keys else "measure"
        return f"""{name} AS (SELECT {by}, any_value(docs) AS docs, min(cell) FILTER (upto * 4 >= docs) AS q1, min(cell) FILTER (upto * 2 >= docs) AS q2
  FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY {by}) AS docs
    FROM (SELECT {by}, cell, sum(n) AS n FROM sketch GROUP BY {by}, cell)) GROUP BY {by})"""

    width = "CASE measure " + " ".join(f"WHEN '{m}' THEN {k} * greatest(q2 - q1, {floor})" for m, (k, floor) in FENCES.items()) + " END"
    limit = ", ".join(f"max(q2 + {width}) FILTER (measure = '{m}') AS {m}_hi" for m in FENCES)
    cells = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM m WHERE NOT base_failed" for m in FENCES)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
p AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (SELECT r, [x FOR x IN regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS words FROM d)),
k AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS key FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, count(DISTINCT i + o.o) AS n_repeat_words FROM (SELECT r, i, count(*) OVER (PARTITION BY r, key) AS c FROM k WHERE key IS NOT NULL), (SELECT unnest(range(5)) AS o) AS o WHERE c > 1 GROUP BY r),
w AS (SELECT r, count(*) AS n_words, sum(len(word)) AS word_chars FROM p GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
c AS (SELECT doc_id, lang, source, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN w USING (r) LEFT JOIN l USING (r) LEFT JOIN t USING (r)),
m AS (SELECT *, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbols, CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS length,
  CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS lines, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
sketch AS (SELECT lang, source, measure, (v >> s) << s AS cell, count(*) AS n FROM (SELECT *, greatest(len(bin(v)) - 6, 0) AS s FROM ({cells})) GROUP BY ALL),
{level("own", "lang, source")}, {level("of_lang", "lang")}, {level("of_all", "")},
g AS (SELECT lang, measure, {", ".join(f"(g.docs * g.{q} + {PRIOR} * a.{q}) // (g.docs + {PRIOR}) AS {q}" for q in ("q1", "q2"))} FROM of_lang g JOIN of_all a USING (measure)),
q AS (SELECT o.lang, o.source, measure, {", ".join(f"(o.docs * o.{q} + {PRIOR} * g.{q}) // (o.docs + {PRIOR}) AS {q}" for q in ("q1", "q2"))} FROM own o JOIN g USING (lang, measure)),
h AS (SELECT lang, source, {limit}, max(q2 - {width}) FILTER (measure = 'length') AS length_lo FROM q GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(symbols > symbols_hi OR lines > lines_hi OR repeats > repeats_hi
  OR (n_words >= {MIN_WORDS} AND (length > length_hi OR length < length_lo)), false) AS kept FROM m LEFT JOIN h USING (lang, source)
"""


ORACLE_SQL = _sql()
