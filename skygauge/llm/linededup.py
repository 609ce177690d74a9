"""Removal of units of text (sentences of lines, lines or paragraphs) that occur before.

A text is cut into units without a gap: each unit has the characters that end it, and all
units together are the text.

* lines end after a line break;
* paragraphs end after a line break and the blank lines that follow it;
* sentences end with their line, or within it after `.`, `!` or `?` and white space; one of under
  FOLD words is one unit with the sentence that follows it in the line (the last ones with the one
  before), since two or three words alone repeat by chance. A line of short sentences alone
  is one unit.

Units are normalised: A-Z lower-cased, white-space runs made one space, ends trimmed. Digests
of 128 bits of all units that aren't blank, of whatever length, are grouped over the whole
table; of equal units the earliest stays and all others go, also within a document. The order
is that of document ids, null ones last; rows that share an id come in the order of a hash of their texts, and
then as read; in a document units come in order. So of repeated rows only one keeps its text.

The input is read once and stored with the digests, so it may be any frame. Digests are
shuffled twice, once grouped (partly before the shuffle, so a very common unit is one row a
task) and once joined back, where Spark splits a common digest. A text moves once, to
meet the numbers of its removed units.

A null or empty text has no units and keeps an empty text. A very long text is held whole
by one task, and so are its units. Only the named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import give_back, materialize, schema, text_batches, utf8

FOLD = 5
#: What ends a unit. The six white-space characters are ASCII ones; only a line break ends a line.
ENDS = {"lines": re.compile(r"\n"), "paragraphs": re.compile(r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"), "sentences": re.compile(r"[.!?][\x20\x09\x0B-\x0D]+|\n")}


def cut_up(text: str, unit: str = "sentences") -> tuple[list[int], np.ndarray]:
    """Where each unit of a text ends, and its digest as two 64-bit numbers, zeros for a blank unit."""
    found = [m.end() for m in ENDS[unit].finditer(text)]
    if text and (not found or found[-1] < len(text)):
        found.append(len(text))
    fold, ends, units = FOLD if unit == "sentences" else 0, [], []
    start, held, later, long_end = 0, [], [], 0  # words up to the unit's long sentence, words after it, that sentence's end
    for end in found:
        words = utf8(text[start:end]).lower().split()  # of bytes: A-Z alone, and the six white-space characters
        if fold and len(words) >= fold:
            if long_end:
                ends.append(long_end)
                units.append(held)
                held, later = later, []
            held, long_end = held + words, end
        elif long_end:
            later += words
        else:
            held = held + words
        if not fold or text[end - 1] == "\n" or end == len(text):
            ends.append(end)
            units.append(held + later)
            held, later, long_end = [], [], 0
        start = end
    data = b"".join(xxhash.xxh3_128_digest(b" ".join(words)) if words else bytes(16) for words in units)
    return ends, np.frombuffer(data, np.int64).reshape(-1, 2)


UNITS = schema("ends int[], high long[], low long[]")
CUT = schema("n_units long, n_bytes long, n_kept long, n_removed long, starts long[], ends long[], kept string")


def _units(unit: str):  # noqa: ANN202
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            ends, parts = cut_up(text or "", unit)
            out.append((np.array(ends, np.int32), parts[:, 0].copy(), parts[:, 1].copy()))
        give_back()
        return pd.DataFrame(out, columns=UNITS.names)

    return F.pandas_udf(run, UNITS)


@F.pandas_udf(CUT)
def _cut(texts: pd.Series, ends: pd.Series, removed: pd.Series) -> pd.DataFrame:
    """Each text without its removed units, which are given in order."""
    out = []
    for text, stops, gone in zip(texts, ends, removed, strict=True):
        text, at, kept = text or "", 0, []
        gone = [] if gone is None else list(gone)
        starts, ends_ = [0 if i == 0 else int(stops[i - 1]) for i in gone], [int(stops[i]) for i in gone]
        for a, b in zip(starts, ends_, strict=True):
            kept.append(text[at:a])
            at = b
        left = "".join([*kept, text[at:]])
        size, n = len(utf8(text)), len(utf8(left))
        out.append((len(stops), size, n, size - n, starts, ends_, left))
    return pd.DataFrame(out, columns=CUT.names)


def remove_repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentences") -> DataFrame:
    """doc_id, n_units, n_bytes, n_kept and n_removed (bytes), starts and ends (code points) of removed units, and the kept text of each document."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("u", _units(unit)("text"))
    rank = (F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("version"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows.select(F.struct(*rank).alias("rank"), "text", "u.*"))
    parts = rows.select("rank", F.posexplode(F.arrays_zip("high", "low")).alias("unit", "x"))
    units = parts.select(F.struct("rank", "unit").alias("place"), "x.high", "x.low").where("high <> 0 OR low <> 0")
    first = units.groupBy("high", "low").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = units.join(materialize(first), ["high", "low"]).where("place > first").select(F.col("place.rank.row").alias("r"), "place.unit")
    listed = gone.groupBy("r").agg(F.sort_array(F.collect_list("unit")).alias("removed"))
    joined = rows.join(listed, F.col("rank.row") == F.col("r"), "left")
    return joined.select(F.col("rank.doc_id").alias("doc_id"), _cut("text", "ends", "removed").alias("x")).select("doc_id", "x.*")


#: The same in DuckDB, over documents, with sentences.
SQL = r"""
WITH t AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS row, doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT row, doc_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), 1) AS line_no
  FROM t),
s AS (
  SELECT row, doc_id, line_no, unnest(regexp_extract_all(line, '(?s).*?[.!?][\x20\x09\x0B-\x0D]+|(?s).+')) AS sentence,
    generate_subscripts(regexp_extract_all(line, '(?s).*?[.!?][\x20\x09\x0B-\x0D]+|(?s).+'), 1) AS no
  FROM l),
w AS (SELECT *, (len(regexp_extract_all(sentence, '[^\x20\x09-\x0D]+')) >= 5)::INT AS long_ FROM s),
g AS (
  SELECT *, least(coalesce(sum(long_) OVER (PARTITION BY row, line_no ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0),
    greatest(sum(long_) OVER (PARTITION BY row, line_no) - 1, 0)) AS part
  FROM w),
u AS (
  SELECT row, any_value(doc_id) AS doc_id, row_number() OVER (PARTITION BY row ORDER BY line_no, part) AS unit, string_agg(sentence, '' ORDER BY no) AS body
  FROM g GROUP BY row, line_no, part),
n AS (
  SELECT *, trim(regexp_replace(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm,
    coalesce(sum(length(body)) OVER (PARTITION BY row ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM u),
r AS (SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY row, unit) > 1 AS gone FROM n),
d AS (
  SELECT row, count(*) AS n_units, count(*) FILTER (WHERE gone) AS n_spans, coalesce(sum(strlen(body)) FILTER (WHERE gone), 0)::BIGINT AS n_removed,
    coalesce(string_agg(start || ':' || (start + length(body)), ',' ORDER BY unit) FILTER (WHERE gone), '') AS spans,
    coalesce(string_agg(body, '' ORDER BY unit) FILTER (WHERE NOT gone), '') AS kept
  FROM r GROUP BY row)
SELECT t.doc_id, strlen(t.text) - coalesce(n_removed, 0) AS n_kept, coalesce(n_removed, 0) AS n_removed, coalesce(n_units, 0) AS n_units,
  coalesce(n_spans, 0) AS n_spans, coalesce(spans, '') AS spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN d ON t.row = d.row
"""
