"""Draw the documents that look most like a target.

Method: importance resampling of hashed n-gram features. Every feature has one
of a fixed number of buckets; the gain of a bucket is the logarithm of its
smoothed share in the target over that in the corpus. An array of gains scores
each document, a Gumbel number of its id is added, and the k best scores are
the draw. They are found by distributed quickselect: random pivot keys, exact
counts of the rows on either side and at each pivot, and the next round only
looks between the two pivots that enclose the k-th key. Only the winners are
sorted.
"""

from __future__ import annotations

import functools
import math
import operator
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import UPPER, by_id, keep, query, ranked, table

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
SHARE = (5, 100)
SEED = "42"
#: Pivots of a round; each round leaves about one part in so many of the rows.
PIVOTS = 15
#: Bytes of a text that are looked at together; a text may be much longer.
SLICE = 1 << 20
#: Words of the UTF-8 form: digits, small letters and everything above ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def _slices(text: bytes) -> Iterator[bytes]:
    """Cut a text between words into parts of about ``SLICE`` bytes."""
    start = 0
    while len(text) - start > SLICE:
        word = WORD.match(text, start + SLICE)
        stop = word.end() if word else start + SLICE
        yield text[start:stop]
        start = stop
    yield text[start:]


def features(text: bytes, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """Yield ``(words, buckets of the features that end in them)`` for each slice of a text.

    A feature is a run of one to three words joined by a space. Its checksum
    goes on from that of the run without its last word.
    """
    before: list[bytes] = []
    for part in _slices(text.translate(LOWER)):
        words = WORD.findall(part)
        line, seen = before + words, len(before)
        spaced = [b" " + word for word in line[1:]]
        one = list(map(zlib.crc32, line))
        two = list(map(zlib.crc32, spaced, one))
        three = list(map(zlib.crc32, spaced[1:], two))
        ended = one[seen:] + two[max(0, seen - 1) :] + three[max(0, seen - 2) :]
        yield len(words), np.array(ended, np.uint32) % buckets
        before = line[1 - LONGEST :]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Count the features of all ``texts(text)`` by bucket.

    Each task adds its texts up in one array, so what is shuffled and what
    comes to the driver depends on ``buckets`` and not on the texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in features(text.as_buffer().to_pybytes(), buckets):
                    held += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(held[met], pa.int64())], names=["bucket", "n"])

    found = texts.select(F.col("text").cast("binary")).mapInArrow(count, "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():  # at most ``buckets`` rows
        counts[bucket] = n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Return each bucket's gain in thousandths: how much more of the target's features it has, smoothed by one."""
    size = len(corpus)
    s_all, t_all = float(corpus.sum() + size), float(target.sum() + size)
    ratios = ((t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(ratio)) for ratio in ratios], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """Return ``(doc_id, n_words, n_features, weight)`` of ``docs(doc_id, text)``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((3, batch.num_rows), np.int64)
            for row, text in enumerate(batch.column("text")):
                for words, ended in features(text.as_buffer().to_pybytes(), len(gain)):
                    found[:, row] += (words, len(ended), gain[ended].sum())
            columns = [batch.column("doc_id"), *(pa.array(c) for c in found)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """A number in thousandths that depends on the id and the seed alone; a null id counts as an empty one."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _point(values: Sequence[int]) -> Column:
    return F.struct(*(F.lit(v).cast("long") for v in values))


def quickselect(rows: DataFrame, key: Sequence[str], k: int, pivots: int = PIVOTS) -> tuple[int, ...]:
    """Find the k-th smallest key (k from 1) of a table whose ``key`` columns are longs and differ in every row.

    A round draws random rows as pivots, counts exactly how many rows lie
    before, at and after each, and goes on with the rows between the two
    pivots around the k-th. What comes to the driver is the pivots and their
    counts. Needs about log(rows) / log(pivots) rounds, each over a smaller
    written table.
    """
    here = F.struct(*key)
    left = rows.select(*key)
    while True:
        drawn = sorted(map(tuple, left.orderBy(F.rand()).limit(pivots).collect()))
        places = [(here >= _point(p)).cast("int") + (here > _point(p)).cast("int") for p in drawn]
        zone = functools.reduce(operator.add, places)  # even: between two pivots; odd: at one
        sizes = dict(left.groupBy(zone.alias("zone")).agg(F.count("*")).collect())
        for at in range(2 * len(drawn) + 1):
            if k <= sizes.get(at, 0):
                break
            k -= sizes.get(at, 0)
        else:
            raise ValueError(f"there are {k} rows too few")
        if at % 2:
            return drawn[at // 2]
        if at > 0:
            left = left.where(here > _point(drawn[at // 2 - 1]))
        if at < 2 * len(drawn):
            left = left.where(here < _point(drawn[at // 2]))
        left = keep(left, "resample-left")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    share: tuple[int, int] = SHARE,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: str = SEED,
) -> DataFrame:
    """Return ``(doc_id, n_words, n_features, weight, score, rank)`` for every row of ``docs``.

    Words are runs of characters other than the ASCII ones that are no digit or
    letter, A-Z lower-cased; features are all runs of one to three of them.
    ``rank`` counts from 1 in the order of the draw and is null for what is not
    drawn. Of the rows with ``min_words`` words or more, the ``share``, rounded
    down, is drawn: highest score first, ties to the smaller id.

    A null or empty text has no features and weight 0. A null id scores like an
    empty one and comes after all others in a tie. Rows that repeat an id are
    each weighed, drawn and returned; equal ones in any order. No rows give no
    rows; a target without texts is smoothed to the same share for every
    bucket. Other columns are ignored.
    """
    rows = by_id(docs, id_col, text_col)
    wanted = target.select(F.coalesce(target_col, F.lit("")).alias("text"))
    gain = gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets))
    scored = weigh(rows, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    key = ["_score", "_none", "_id", "_row"]
    scored = keep(
        scored.withColumns(
            {
                "_score": -F.col("score"),
                "_none": F.col("doc_id").isNull().cast("long"),
                "_id": F.coalesce("doc_id", F.lit(0).cast("long")),
                "_row": F.monotonically_increasing_id(),
            }
        ),
        "resample-scored",
    )
    fit = F.col("n_words") >= min_words
    k = scored.where(fit).count() * share[0] // share[1]
    kept = ["doc_id", "n_words", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*kept, unranked)
    last = _point(quickselect(scored.where(fit), key, k))
    won = fit & (F.struct(*key) <= last)
    winners = ranked(scored.where(won), key, "resample-winners").select(*kept, F.col("rank").cast("long"))
    return winners.union(scored.where(~won).select(*kept, unranked))


def drawn_documents(docs: DataFrame, resampled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Return the rows of ``docs`` that were drawn, with their ``rank``; ids have to be unique and not null."""
    ranks = resampled.where("rank is not null").select(F.col("doc_id").alias("_drawn"), "rank")
    return docs.drop("rank").join(ranks, docs[id_col].cast("long") == F.col("_drawn")).drop("_drawn")


@query()
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark, and the twentieth of them that is drawn."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
