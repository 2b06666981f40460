"""Operator 4: quality rules by repetition coverage.

Words, lines and word n-grams of several lengths are found and hashed with numpy for many documents at once
(prefix sums give each stretch's rolling hash), and the code points inside repeated n-grams and lines are
measured against all code points in words.

Defined results: null or empty text has 0 words and fails the base rule.  Rows are judged one by one, so
repeated rows, ties, null doc_ids and other columns pass through unchanged, but for columns named as a measure, which
are replaced.  A long text is measured whole.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHARS, ITEMS, bounded_batches, chunks, documents, mix, prefix, stretch, utf8, words_of

#: n-gram lengths in words, and the share (percent) of code points inside repeated ones above which a text goes.  Words
#: inside a repeated long n-gram are inside repeated shorter ones too, and the base rule lets 20 % of words pass: a limit
#: decides something only where it is below that and below the limits of the shorter lengths.
COVERAGE_LIMITS = {5: 15, 10: 10, 20: 5}
#: The same for code points in lines that equal an earlier line of the text (n-grams miss lines of under five words).
LINE_LIMIT = 20
MIN_WORDS, REPEAT_LIMIT = 10, 20
SYMBOLS = b"#*$%&|<>"
CHUNK_BYTES = 1 << 20

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", *(f"gram{n}_chars" for n in COVERAGE_LIMITS)]


def again(row: np.ndarray, key: np.ndarray, later: bool = False) -> np.ndarray:
    """Which items share row and key with another one (``later``: with an earlier one)."""
    out = np.zeros(len(key), bool)
    if len(key) > 1:
        whole = mix(key + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(whole, kind="stable" if later else None)
        same = whole[order[1:]] == whole[order[:-1]]
        out[order[1:][same]] = True
        if not later:
            out[order[:-1][same]] = True
    return out


def measure(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of texts that stand one after the other in ``raw``."""
    n = len(offsets) - 1
    total = lambda flags: np.add.reduceat(np.append(flags, 0), offsets[:-1], dtype=np.int64) * (offsets[1:] > offsets[:-1]) if n else np.zeros(0, np.int64)
    by_row = lambda rows, weights: np.bincount(rows, weights, n).astype(np.int64)
    start, end, row, ink = words_of(raw, offsets)
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(((raw & 0xC0) != 0x80) & ink, out=points[1:])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    sums = prefix(raw, CHARS)
    out = {"n_words": np.bincount(row, minlength=n), "word_chars": points[offsets[1:]] - points[offsets[:-1]], "n_symbols": total(symbol[raw])}

    marks = np.unique(np.concatenate([offsets, np.flatnonzero(raw == 10) + 1]))
    head, tail = marks[:-1], marks[1:]
    tail = tail - (raw[tail - 1] == 10)
    chars = points[tail] - points[head]
    head, tail, chars = head[chars > 0], tail[chars > 0], chars[chars > 0]
    of = np.searchsorted(offsets, head, "right") - 1
    dup = again(of, stretch(sums, head, tail, CHARS), later=True)
    out["n_dup_lines"], out["line_chars"] = by_row(of[dup], None), by_row(of[dup], chars[dup])

    grams = prefix(stretch(sums, start, end, CHARS), ITEMS)
    size = points[end] - points[start]
    for k in COVERAGE_LIMITS:
        at = np.arange(max(0, len(start) - k + 1))
        at = at[row[at] == row[at + k - 1]] if len(at) else at
        at = at[again(row[at], stretch(grams, at, at + k, ITEMS))]
        cover = np.zeros(len(start) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + k, -1)
        inside = np.cumsum(cover[:-1]) > 0
        if k == 5:
            out["n_repeat_words"] = by_row(row[inside], None)
        out[f"gram{k}_chars"] = by_row(row[inside], size[inside])
    return out


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures of ``text`` as further columns (long); columns of those names are replaced."""
    kept = [c for c in docs.columns if c not in MEASURES]
    place = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(place))
            for i, j in chunks(offsets, CHUNK_BYTES):
                found = measure(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], [*kept, *MEASURES])

    bounded_batches(docs.sparkSession)
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(m, T.LongType()) for m in MEASURES)])
    return docs.select(*kept).mapInArrow(run, schema)


def judged(measured: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_LIMIT * F.col("n_words"))
    bad = 100 * F.col("line_chars") > LINE_LIMIT * F.col("word_chars")
    for k, limit in COVERAGE_LIMITS.items():
        bad |= 100 * F.col(f"gram{k}_chars") > limit * F.col("word_chars")
    return measured.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~bad)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(measures(documents(spark, sf_dir).select("doc_id", "text")))
    return rows.drop("text")


def _grams_sql(k: int) -> str:
    gram = ", ".join(f"lead(word, {o}) OVER v" for o in range(1, k))
    return f"""
g{k} AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n
  FROM (SELECT doc_id, i, concat_ws(' ', word, {gram}) AS gram, size FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY i)) WHERE i + {k - 1} <= size),
c{k} AS (
  SELECT doc_id, count(*) AS words, sum(len(word)) AS chars FROM x
  JOIN (SELECT DISTINCT doc_id, i + o AS i FROM g{k}, range({k}) AS q(o) WHERE n > 1) p USING (doc_id, i) GROUP BY doc_id)"""


_SQL_LIMITS = " OR ".join([f"100 * line_chars > {LINE_LIMIT} * word_chars", *(f"100 * gram{k}_chars > {limit} * word_chars" for k, limit in COVERAGE_LIMITS.items())])
#: The same rows where doc_id is unique.
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS size FROM d),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
e AS (
  SELECT doc_id, count(*) AS lines, sum(len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) WHERE k > 1 GROUP BY doc_id),
{",".join(map(_grams_sql, COVERAGE_LIMITS))},
m AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(e.lines, 0) AS n_dup_lines, coalesce(c5.words, 0) AS n_repeat_words,
    CAST(coalesce(e.chars, 0) AS BIGINT) AS line_chars, {", ".join(f"CAST(coalesce(c{k}.chars, 0) AS BIGINT) AS gram{k}_chars" for k in COVERAGE_LIMITS)}
  FROM d LEFT JOIN e USING (doc_id) {" ".join(f"LEFT JOIN c{k} USING (doc_id)" for k in COVERAGE_LIMITS)}),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_LIMIT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT ({_SQL_LIMITS}) AS kept FROM b
"""
