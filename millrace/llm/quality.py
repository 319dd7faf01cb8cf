"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document's measures are kept as small integers. They are such that few documents have 0:
characters of a word, punctuation and capitals among the characters, the share of the most frequent word.
For each (lang, source) group and measure a log-linear histogram (exact below 2**(BITS + 1), then
2**BITS buckets for each power of two, so relative error is at most 2**-BITS) is built with plain
sums: it merges exactly, its result does not depend on partitions, and its size is bounded.

The thresholds are read from the sketches alone. With the quartiles q1, q2, q3 of a group, its spread is
``min(q3 - q2, q2 - q1)`` and its fences lie SPREAD spreads over the median q2, and for word length
under it too. Junk of one kind that makes up less than half of a group lies on one side of the median and
moves the other side's quartile little, so it can't widen the fence that is to keep it out; what
most of a group does is right there. The quartiles of a group are weighted means: its own count as many
as it has documents, those of its language as PRIOR, which in turn lean on those of all documents in
the same way. So a small group borrows smoothly and no size switches the rule. A spread is never under
its LEAST, the grain of the measure, for groups whose quartiles agree.

The thresholds are joined to the measures and a document outside of any fence is rejected.

Defined results: a null or empty text has no words, fails the base rule and is rejected;
null lang or source is a group of its own; repeated rows are measured alike, and rows that agree in id and text but
not in lang or source are judged each by its own group; any length is read whole. Documents that fail the base
rule are not measured for the sketches.
"""

from __future__ import annotations

import string
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Measures: name, numerator, denominator, least spread, whether small values are out of place too.
MEASURES = (
    ("word_length", "word_chars * 100", "n_words", 10, True),
    ("punctuation", "n_punctuation * 1000", "word_chars", 5, False),
    ("capitals", "n_capitals * 1000", "word_chars", 5, False),
    ("top_word", "n_top_word * 1000", "n_words", 5, False),
)
SPREAD, BITS, PRIOR = 12, 8, 20
QUARTILES = (25, 50, 75)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_punctuation", "n_capitals", "n_top_word")
#: Fences by column name: measure, and on which side of the median.
FENCES = {f"f_{m[0]}{side}": (i, sign) for i, m in enumerate(MEASURES) for side, sign in (("", 1), ("_low", -1)) if sign > 0 or m[4]}
PUNCTUATION, CAPITALS = string.punctuation.encode(), string.ascii_uppercase.encode()


def counted(data: bytes) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    words = data.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = sum(map(joined.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    repeats = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            first: dict[tuple, int] = {}
            hit = bytearray(n)
            for i, w in enumerate(windows):
                j = first.setdefault(w, i)
                if j != i:
                    hit[i : i + 3] = b"\1\1\1"
                    hit[j : j + 3] = b"\1\1\1"
            repeats = hit.count(1)
    without = lambda which: len(joined) - len(joined.translate(None, which))
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, without(PUNCTUATION), without(CAPITALS), max(Counter(words).values())


def measure(rows: DataFrame, text_of=lambda batch: batch.column(batch.num_columns - 1), keep: int = -1) -> DataFrame:
    """The first `keep` columns of rows (all but the last, which is the text) and COUNTS; the only scan of the texts."""
    keep = keep if keep >= 0 else len(rows.columns) - 1
    fields = [pa.field(c, pa.int64()) for c in COUNTS]

    def run(batches):
        for batch in common.slices(batches):
            found = np.array([counted(t) for t in common.bytes_of(text_of(batch))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(batch.columns[:keep] + [pa.array(found[:, i]) for i in range(len(COUNTS))], schema=pa.schema(list(batch.schema)[:keep] + fields))

    return rows.mapInArrow(run, T.StructType(rows.schema.fields[:keep] + [T.StructField(c, T.LongType()) for c in COUNTS]))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def value(measure: tuple) -> str:
    """A measure as SQL that Spark and DuckDB understand but for the integer division."""
    return f"CASE WHEN {measure[2]} > 0 THEN {measure[1]} DIV {measure[2]} ELSE 0 END"


def bucket(v: Column) -> Column:
    """The lower edge of v's log-linear bucket."""
    shift = F.greatest(F.length(F.bin(v)) - (BITS + 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, m, bucket, n): the sketch of each group and measure. Sketches merge by adding n."""
    each = F.array(*[F.struct(F.lit(i).alias("m"), bucket(F.expr(value(m))).alias("bucket")) for i, m in enumerate(MEASURES)])
    return measured.where(~base_failed()).select("lang", "source", F.explode(each).alias("x")).groupBy("lang", "source", "x.m", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and FENCES; one row for each group that occurs."""
    merged = (
        sketch.select("lang", "source", "m", "bucket", "n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("level"))
        .select(F.when(F.col("level") < 2, F.col("lang")).alias("lang"), F.when(F.col("level") < 1, F.col("source")).alias("source"), "level", "m", "bucket", "n")
        .groupBy("level", "lang", "source", "m", "bucket").agg(F.sum("n").alias("n"))
    )
    lists = merged.groupBy("level", "lang", "source", "m").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("s"), F.sum("n").alias("total"))
    # the first bucket at which the running count reaches the wanted share
    at = lambda share: F.expr(f"aggregate(s, named_struct('c', 0L, 'v', -1L), (a, x) -> if(a.v >= 0, a, named_struct('c', a.c + x.n, 'v', if((a.c + x.n) * 100 >= total * {share}, x.bucket, -1L))), a -> a.v)")
    q = common.stored(lists.select("level", "lang", "source", "m", "total", *[at(x).alias(f"q{x}") for x in QUARTILES]), "quartiles")
    own = q.where("level = 0").select("lang", "source", "m", F.col("total").alias("n0"), *[F.col(f"q{x}").alias(f"a{x}") for x in QUARTILES])
    by_lang = q.where("level = 1").select(F.col("lang").alias("lang1"), F.col("m").alias("m1"), F.col("total").alias("n1"), *[F.col(f"q{x}").alias(f"b{x}") for x in QUARTILES])
    overall = q.where("level = 2").select(F.col("m").alias("m2"), *[F.col(f"q{x}").alias(f"c{x}") for x in QUARTILES])
    joined = own.join(by_lang, own.lang.eqNullSafe(by_lang.lang1) & (own.m == by_lang.m1)).join(overall, own.m == overall.m2)
    blended = joined.select("lang", "source", "m", *[F.expr(f"(n0 * a{x} + {PRIOR} * ((n1 * b{x} + {PRIOR} * c{x}) div (n1 + {PRIOR}))) div (n0 + {PRIOR})").alias(f"q{x}") for x in QUARTILES])
    least = F.element_at(F.array(*[F.lit(m[3]) for m in MEASURES]), F.col("m") + 1)
    wide = blended.withColumn("spread", SPREAD * F.greatest(least, F.least(F.col("q75") - F.col("q50"), F.col("q50") - F.col("q25"))))
    return wide.groupBy("lang", "source").agg(*[F.max(F.when(F.col("m") == i, F.col("q50") + sign * F.col("spread"))).alias(c) for c, (i, sign) in FENCES.items()])


def judged(measured: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """rows (measured ones, by default the same) with their group's fences, base_failed and kept. The sketches are those of measured."""
    rows = measured if rows is None else rows
    limits = common.stored(thresholds(sketches(measured)), "thresholds").select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *FENCES)
    # The planner broadcasts the thresholds while their files are small; beyond that it sorts, and splits a hot group.
    out = rows.join(limits, rows.lang.eqNullSafe(limits.t_lang) & rows.source.eqNullSafe(limits.t_source), "left")
    within = reduce(lambda a, b: a & b, [(F.expr(value(MEASURES[i])) - F.col(c)) * sign <= 0 for c, (i, sign) in FENCES.items()])
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False))).drop("t_lang", "t_source")


def grouped_by(docs: DataFrame) -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in ("lang", "source")]


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of docs, with its counts, its group's fences, base_failed and kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *grouped_by(docs), "text")
    return judged(common.stored(measure(rows), "measures"))


def keep(docs: DataFrame) -> DataFrame:
    """docs without the rejected rows; all columns stay. The sketches come from a first scan. A second one measures each row again
    and carries its verdict with it, so no key joins them and nothing but the thresholds is exchanged."""
    n, place = len(docs.columns), docs.columns.index("text")
    measured = common.stored(measure(docs.select(*grouped_by(docs), "text")), "measures")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], *grouped_by(docs))
    return judged(measured, measure(rows, lambda batch: batch.column(place), n + 2)).where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def sql() -> str:
    """judge() in DuckDB's SQL, with the columns of the query."""
    word = "[^\\x20\\x09-\\x0D]+"
    of = lambda m: value(m).replace(" DIV ", " // ")
    measures = "\n    UNION ALL ".join(f"SELECT lang, source, {i} AS m, {of(m)} AS v FROM good" for i, m in enumerate(MEASURES))
    quartiles = ", ".join(f"min(bucket) FILTER (cum * 100 >= total * {x}) AS q{x}" for x in QUARTILES)
    blended = ", ".join(f"(o.total * o.q{x} + {PRIOR} * ((l.total * l.q{x} + {PRIOR} * a.q{x}) // (l.total + {PRIOR}))) // (o.total + {PRIOR}) AS q{x}" for x in QUARTILES)
    least = " ".join(f"WHEN {i} THEN {m[3]}" for i, m in enumerate(MEASURES))
    wide = ", ".join(f"max(q50 {'+' if sign > 0 else '-'} spread) FILTER (m = {i}) AS {c}" for c, (i, sign) in FENCES.items())
    within = " AND ".join(f"{of(MEASURES[i])} {'<=' if sign > 0 else '>='} {c}" for c, (i, sign) in FENCES.items())
    return f"""
    WITH d AS (SELECT row_number() OVER () AS i, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
    windows AS (SELECT i, s, count(*) OVER (PARTITION BY i, w[s], w[s + 1], w[s + 2]) AS n FROM (SELECT i, w, unnest(range(1, len(w) - 1)) AS s FROM d)),
    hit AS (SELECT i, count(DISTINCT j) AS n_repeat_words FROM (SELECT i, unnest([s, s + 1, s + 2]) AS j FROM windows WHERE n > 1) GROUP BY i),
    top AS (SELECT i, max(n) AS n_top_word FROM (SELECT i, word, count(*) AS n FROM (SELECT i, unnest(w) AS word FROM d) GROUP BY ALL) GROUP BY i),
    c AS (SELECT d.i, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(t, '[^\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]', '', 'g')) AS n_punctuation,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, coalesce(n_top_word, 0) AS n_top_word FROM d LEFT JOIN hit ON hit.i = d.i LEFT JOIN top ON top.i = d.i),
    counts AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM c),
    good AS (SELECT * FROM counts WHERE NOT base_failed), measured AS ({measures}),
    sketch AS (SELECT lang, source, m, (v >> greatest(length(bin(v)) - {BITS + 1}, 0)) << greatest(length(bin(v)) - {BITS + 1}, 0) AS bucket, count(*) AS n FROM measured GROUP BY ALL),
    merged AS (SELECT 0 AS level, lang, source, m, bucket, n FROM sketch UNION ALL SELECT 1, lang, NULL, m, bucket, sum(n) FROM sketch GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, m, bucket, sum(n) FROM sketch GROUP BY ALL),
    running AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, m ORDER BY bucket)::BIGINT AS cum, sum(n) OVER (PARTITION BY level, lang, source, m)::BIGINT AS total FROM merged),
    quart AS (SELECT level, lang, source, m, any_value(total) AS total, {quartiles} FROM running GROUP BY ALL),
    blended AS (SELECT o.lang, o.source, o.m, {blended} FROM (SELECT * FROM quart WHERE level = 0) o JOIN (SELECT * FROM quart WHERE level = 1) l ON o.lang IS NOT DISTINCT FROM l.lang AND o.m = l.m JOIN (SELECT * FROM quart WHERE level = 2) a ON a.m = o.m),
    spreads AS (SELECT *, {SPREAD} * greatest(CASE m {least} END, least(q75 - q50, q50 - q25)) AS spread FROM blended),
    limits AS (SELECT lang, source, {wide} FROM spreads GROUP BY ALL)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({within}, false) AS kept, {", ".join(FENCES)}
    FROM counts LEFT JOIN limits ON counts.lang IS NOT DISTINCT FROM limits.lang AND counts.source IS NOT DISTINCT FROM limits.source"""
