"""Drop lines that many documents share.

Method: explode the normalised lines, hash them, count the distinct documents
of each hash, drop the lines over the threshold, and reassemble by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import SPACE, UPPER, by_id, lower_ascii, query, table

MIN_CHARS = 40
MIN_DOCS = 5


def _key(line: Column, min_chars: int) -> Column:
    """Two 64-bit hashes of a line's key, or null where the key is too short to count.

    With different seeds the two make one hash of 128 bits.
    """
    key = F.btrim(line, F.lit(SPACE))
    low = lower_ascii(key)
    return F.when(
        F.char_length(key) >= min_chars, F.struct(F.xxhash64(low).alias("h1"), F.xxhash64(F.lit(1), low).alias("h2"))
    )


def _lines() -> Column:
    return F.split("text", "\n", -1)


def _marks(rows: DataFrame, min_chars: int) -> DataFrame:
    """One row for each document and line key; a document that repeats a line counts once."""
    keys = F.array_distinct(F.filter(F.transform(_lines(), lambda line: _key(line, min_chars)), lambda k: k.isNotNull()))
    marks = rows.where("doc_id is not null").select("doc_id", F.explode(keys).alias("key"))
    return marks.select("doc_id", "key.h1", "key.h2").distinct()


def _common(marks: DataFrame, min_docs: int) -> DataFrame:
    """``(h1, h2, keep_id)`` of the lines found in ``min_docs`` documents or more."""
    # Both aggregations combine on the map side, so a line of every document is one row a task.
    counted = marks.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keep_id"))
    return counted.where(F.col("docs") >= min_docs).select("h1", "h2", "keep_id")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Return ``(doc_id, text, kept_text, n_lines, n_dropped)`` and the ``carry`` columns for every row.

    A line's key is the line without ASCII white space at its ends and with
    A-Z lower-cased. All lines of a key with at least ``min_chars`` code points
    that is found in at least ``min_docs`` documents go, but for those in the
    largest id that holds it.

    Null or empty text: one empty line, kept. A null id: the row neither counts
    nor loses lines. Rows that share an id count as one document and are each
    returned. No rows give no rows. Other columns of the input are ignored.
    """
    rows = by_id(docs, id_col, text_col, carry)
    marks = _marks(rows, min_chars)
    dropped = (
        marks.join(_common(marks, min_docs), ["h1", "h2"])
        .where("doc_id <> keep_id")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("h1", "h2")).alias("dropped"))  # at most the document's own lines
    )
    joined = rows.join(dropped, "doc_id", "left")
    kept = F.filter(
        _lines(), lambda line: ~F.coalesce(F.array_contains("dropped", _key(line, min_chars)), F.lit(False))
    )
    lines = joined.withColumn("kept", F.when(F.col("dropped").isNotNull(), kept))
    return lines.select(
        "doc_id",
        "text",
        F.coalesce(F.array_join("kept", "\n"), "text").alias("kept_text"),
        F.size(_lines()).cast("long").alias("n_lines"),
        F.coalesce(F.size(_lines()) - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
        *carry,
    )


ORACLE = f"""
WITH rows AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM rows
),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{UPPER}', '{UPPER.lower()}') AS k FROM lines
),
common AS (
  SELECT k, max(doc_id) AS keep_id FROM keyed WHERE length(k) >= {MIN_CHARS}
  GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
),
marked AS (
  SELECT l.doc_id, l.line, l.pos, c.k IS NOT NULL AND c.keep_id <> l.doc_id AS gone
  FROM keyed l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query(ORACLE)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left in each document, as a digest."""
    lines = dedup_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
