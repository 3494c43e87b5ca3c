"""Find documents that hold benchmark items, also reworded ones.

Method: latent semantic retrieval. A distributed randomised singular value
decomposition of the TF-IDF passages of corpus and items gives a latent space;
passages near an item there are candidates, and a candidate is decided by the
longest common subsequence of words and a check for the item's answer.

The items together weigh a few times as much in the decomposition as the whole
corpus. Else its leading directions would be those of the frequent terms, and
an item of rare terms would have next to no place in the space.

Items are the different texts and answers of the benchmark, whatever their ids.
They are cut into passages and taken in blocks of no more passages than the
space has dimensions, so that each finds its place in it; a long item may be in
several blocks. So the vocabulary, which is that of the passages, and all
matrices over it are bounded at any size of the benchmark. The corpus is read once as text for each block; the passes after
that read the written word numbers. No document is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import by_id, keep, query, table
from eventloom.llm.shingles import LETTERS, word_hashes

#: Items that are read at a time, and passages in a block: fewer than the rank.
BLOCK_ITEMS, BLOCK_PASSAGES = 250, 250
#: Words in a passage of the decomposition, its rank, and the additional random directions.
PASSAGE, RANK, MORE = 64, 256, 16
#: How much the items weigh against the corpus.
ITEM_WEIGHT = 8.0
#: A term in a larger share of the passages says nothing about one.
COMMON = 0.02
#: Sizes of the windows that are compared, in words, and the unit their sums are made of; windows begin half a size
#: apart. Units of no words after each document, so that no window holds two documents.
WINDOWS, UNIT = (32, 64), 16
BETWEEN = WINDOWS[-1] // UNIT - 1
#: The least cosine of a candidate; the least share of an item's words in order that decides alone, and with the answer.
NEAR, SURE, LIKELY, ANSWER = 0.35, 0.8, 0.6, 0.8
#: Words that pass through a matrix at a time, and rows of one that travel together.
TOGETHER, ROWS = 1 << 15, 512
NO_WORD = -1


class Items:
    """A block of passages of at most the largest window, their words by number, and the answers of their items."""

    def __init__(self, ids: list[int], passages: list[tuple[int, np.ndarray]], answers: list[np.ndarray]) -> None:
        """``passages`` are those of the item in a place of ``ids``, as hashes of words."""
        self.ids = ids
        self.hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for _, w in passages), *answers]))
        self.passages = [(k, self.number(w)) for k, w in passages]
        self.answers = [self.number(w) for w in answers]

    @classmethod
    def blocks(cls, rows: Iterator[tuple[int, str, str | None]]) -> Iterator[Items]:
        """Fill blocks with the passages of ``(id, text, answer)``; those of a long item go on in the next block."""
        ids: list[int] = []
        passages: list[tuple[int, np.ndarray]] = []
        answers: list[np.ndarray] = []
        for item, text, answer in rows:
            if answer is None:  # without one, the last sentence stands for it
                answer = max((s for s in text.replace("\n", ". ").split(". ") if s.strip()), key=lambda s: text.rfind(s), default="")
            words, own = cls._words([text])[0], cls._words([answer])[0]
            for at in range(0, len(words), WINDOWS[-1]):
                if len(passages) == BLOCK_PASSAGES:
                    yield cls(ids, passages, answers)
                    ids, passages, answers = [], [], []
                if not at or not ids:
                    ids.append(item)
                    answers.append(own)
                passages.append((len(ids) - 1, words[at : at + WINDOWS[-1]]))
        if passages:
            yield cls(ids, passages, answers)

    @staticmethod
    def _words(texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, hashes, counts in word_hashes(pa.array(texts, pa.string()), word=LETTERS):
            out.extend(np.split(hashes, np.cumsum(counts)[:-1]))
        return out

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), NO_WORD, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, NO_WORD).astype(np.int32)


def number_words(rows: DataFrame, items: Items) -> DataFrame:
    """Return ``(doc_id, words)``: the number of each word of a text in the items' vocabulary, as 32-bit integers."""
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for i, hashes, counts in word_hashes(batch.column("text"), word=LETTERS):
                data = vocabulary.number(hashes).tobytes()
                stops = 4 * np.cumsum(counts)
                words = [data[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, len(words)), pa.array(words, pa.binary())], names=["doc_id", "words"]
                )

    return rows.select("doc_id", "text").mapInArrow(number, "doc_id long, words binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Yield ids, the words of some documents, and how many each has."""
    for batch in batches:
        ids, words = batch.column("doc_id").to_pylist(), batch.column("words").to_pylist()
        at = 0
        while at < len(ids):
            stop, size = at, 0
            while stop < len(ids) and (stop == at or size + len(words[stop]) <= 32 * TOGETHER):
                size += len(words[stop])
                stop += 1
            yield ids[at:stop], np.frombuffer(b"".join(words[at:stop]), np.int32), np.array([len(w) // 4 for w in words[at:stop]])
            at = stop


def _parts(counts: np.ndarray, size: int, between: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Number the parts of ``size`` words of each document, leaving some out between two documents.

    Returns the part of each word, and the first part of each document and of one after the last.
    """
    parts = -(-counts // size) + between
    first = np.concatenate(([0], np.cumsum(parts)))
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    at = np.arange(int(counts.sum())) - np.repeat(begin, counts)
    return at // size + np.repeat(first[:-1], counts), first


def _runs(places: np.ndarray, parts: np.ndarray) -> Iterator[np.ndarray]:
    """Take some places at a time, and all of a part together."""
    heads = np.flatnonzero(np.diff(parts, prepend=-1))
    at = 0
    while at < len(places):
        later = np.searchsorted(heads, at + TOGETHER)
        stop = int(heads[later]) if later < len(heads) else len(places)
        yield places[at:stop]
        at = stop


def _add_rows(out: np.ndarray, where: np.ndarray, source: np.ndarray, rows: np.ndarray) -> None:
    """Add ``source[rows]`` to ``out[where]``, also where a place comes up more than once.

    First the first row of every place, then the second, and so on. That is an
    order of magnitude faster than the library's own ways over wide rows.
    """
    order = np.argsort(where, kind="stable")
    sorted_ = where[order]
    heads = np.flatnonzero(np.diff(sorted_, prepend=-1))
    turn = np.arange(len(where)) - np.repeat(heads, np.diff(heads, append=len(where)))
    by_turn = order[np.argsort(turn, kind="stable")]
    at = 0
    for size in np.bincount(turn).tolist():
        some = by_turn[at : at + size]
        out[where[some]] += source[rows[some]]
        at += size


def _summed(numbered: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Add up the matrices that ``work`` makes of the partitions; rows of zeros do not travel."""
    columns = shape[1]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = work(batches)
        rows = np.flatnonzero(made.any(axis=1))
        for k in np.unique(rows // ROWS).tolist():
            mine = rows[rows // ROWS == k]
            data = mine.astype("<i4").tobytes() + made[mine].astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["part", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                n = len(data) // (4 + 8 * columns)
                rows = np.frombuffer(data, "<i4", n) - k * ROWS
                sums.setdefault(k, np.zeros((ROWS, columns)))[rows] += np.frombuffer(data, "<f8", -1, 4 * n).reshape(n, columns)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "data"]
        )

    total = np.zeros((-(-shape[0] // ROWS) * ROWS, columns))
    schema = "part int, data binary"
    for k, data in numbered.mapInArrow(make, schema).repartition("part").mapInArrow(add, schema).collect():
        total[k * ROWS : (k + 1) * ROWS] = np.frombuffer(data).reshape(ROWS, columns)
    return total[: shape[0]]


def _document_frequencies(numbered: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """In how many passages each term is, and how many passages there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((terms + 1, 1))
        for _, words, counts in _read(batches):
            passage, first = _parts(counts, PASSAGE)
            known = words != NO_WORD
            pairs = np.unique(passage[known] * terms + words[known])
            out[:terms, 0] += np.bincount(pairs % terms, minlength=terms)
            out[terms, 0] += first[-1]
        return out

    found = _summed(numbered, count, (terms + 1, 1))[:, 0]
    return found[:terms], int(found[terms])


def _gram_times(numbered: DataFrame, weights: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A' A B for the TF-IDF matrix A of all passages, which is never made."""
    shared = numbered.sparkSession.sparkContext.broadcast((weights, (weights[:, None] * block).astype(np.float32)))

    def multiply(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        weight, weighted = shared.value
        out = np.zeros(weighted.shape, np.float32)
        for _, words, counts in _read(batches):
            passage, _ = _parts(counts, PASSAGE)
            useful = np.flatnonzero((words != NO_WORD) & (weight[words] > 0))
            for some in _runs(useful, passage[useful]):
                term, where = words[some], passage[some]
                projected = np.zeros((where[-1] - where[0] + 1, weighted.shape[1]), np.float32)
                _add_rows(projected, where - where[0], weighted, term)
                _add_rows(out, term, projected, where - where[0])
        return out * weight[:, None]

    return _summed(numbered, multiply, block.shape)


def latent_space(numbered: DataFrame, items: Items, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Return the IDF weight of each term, and its vector: the weight times the leading right singular vectors.

    Randomised range finder with one power step, then Rayleigh-Ritz on the
    small matrix. Common terms have weight zero.
    """
    terms = len(items.hashes)
    df, passages = _document_frequencies(numbered, terms)
    weights = np.where(df <= max(1.0, COMMON * passages), np.log((1.0 + passages) / (1.0 + df)), 0.0)
    width = min(rank + MORE, terms)
    own = np.zeros((len(items.passages), terms))
    for q, (_, passage) in enumerate(items.passages):
        if not weights[passage].any():  # nothing but common terms, which then have to do
            weights[passage] = np.log((1.0 + passages) / (1.0 + df[passage]))
    for q, (_, passage) in enumerate(items.passages):
        np.add.at(own[q], passage, weights[passage])
    if not own.any():
        return weights, np.zeros((terms, 1), np.float32)
    # The energy of the corpus is at most that of its terms, each passage with the term once.
    share = ITEM_WEIGHT * (df * weights**2).sum() / (own**2).sum()

    def times(block: np.ndarray) -> np.ndarray:
        return _gram_times(numbered, weights, block) + share * (own.T @ (own @ block))

    basis, _ = np.linalg.qr(times(np.random.default_rng(7).standard_normal((terms, width))))
    image = times(basis)
    values, vectors = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
    return weights, (weights[:, None] * (basis @ vectors[:, np.argsort(-values)[:rank]])).astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence, a column of the table at a time as the bits of a number."""
    where: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << k
    where.pop(NO_WORD, None)
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        hit = row & where.get(y, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _matches(
    ids: list[int], words: np.ndarray, counts: np.ndarray, weights: np.ndarray, space: np.ndarray, items: Items, queries: list
) -> Iterator[tuple[int, int, float, float]]:
    """Candidates by cosine in the latent space, then those that the words bear out."""
    unit, first = _parts(counts, UNIT, BETWEEN)
    useful = np.flatnonzero((words != NO_WORD) & (weights[words] > 0))
    if not len(useful):
        return
    begin = np.concatenate(([0], np.cumsum(counts)))
    units = int(first[-1])
    sums = np.zeros((units + BETWEEN, space.shape[1]), np.float32)
    for some in _runs(useful, unit[useful]):
        _add_rows(sums, unit[some], space, words[some])
    # The length of a window's whole vector, not only of its shadow in the space: a single shared term is not near.
    energy = np.bincount(unit[useful], weights[words[useful]] ** 2, units + BETWEEN)
    best: dict[tuple[int, int], tuple[float, float]] = {}
    for size, (numbers, vectors) in queries:
        if not len(numbers):
            continue
        wide, step = size // UNIT, size // UNIT // 2
        for at in range(0, units, TOGETHER):
            stop = min(units, at + TOGETHER)
            window = sum(sums[at + k : stop + k : step] for k in range(wide))
            length = np.sqrt(sum(energy[at + k : stop + k : step] for k in range(wide)))
            near = window @ vectors.T >= (NEAR * np.maximum(length, 1e-6))[:, None].astype(np.float32)
            for w, q in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                start = at + step * w
                doc = int(np.searchsorted(first, start, side="right")) - 1
                if start >= first[doc + 1] - BETWEEN:  # begins behind a document and reaches into the next
                    doc += 1
                begins = int(begin[doc]) + (start - int(first[doc])) * UNIT
                region = words[max(int(begin[doc]), begins - size // 2) : min(int(begin[doc + 1]), begins + size + size // 2)]
                k, passage = items.passages[numbers[q]]
                share = common_subsequence(passage, region) / len(passage)
                if share < LIKELY or share <= best.get((doc, k), (0.0, 0.0))[0]:
                    continue
                answer = items.answers[k]
                said = common_subsequence(answer, region) / len(answer) if len(answer) else 0.0
                if share >= SURE or said >= ANSWER:
                    best[doc, k] = (share, said)
    for (doc, k), (share, said) in best.items():
        yield ids[doc], items.ids[k], share, said


def search(numbered: DataFrame, items: Items, weights: np.ndarray, space: np.ndarray) -> DataFrame:
    """Compare windows of all documents with all items of a block; ``(doc_id, item_id, share, answer_share)``."""
    queries = []
    for size, least in zip(WINDOWS, (0, *WINDOWS[:-1]), strict=True):
        numbers, vectors = [], []
        for q, (_, passage) in enumerate(items.passages):
            vector = space[passage].sum(axis=0) if len(passage) else np.zeros(space.shape[1])
            if least < len(passage) <= size:
                length = float(np.linalg.norm(vector))
                numbers.append(q)
                vectors.append(vector / length if length > 0 else vector)
        queries.append((size, (numbers, np.array(vectors, np.float32).reshape(len(numbers), space.shape[1]))))
    shared = numbered.sparkSession.sparkContext.broadcast((weights, space, items, queries))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, space, items, queries = shared.value
        for ids, words, counts in _read(batches):
            found = list(_matches(ids, words, counts, weights, space, items, queries))
            columns = zip(*found, strict=True) if found else ([], [], [], [])
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)],
                names=["doc_id", "item_id", "share", "answer_share"],
            )

    return numbered.mapInArrow(find, "doc_id long, item_id long, share double, answer_share double")


def _by_key(known: DataFrame, at_a_time: int) -> Iterator[tuple[int, str, str | None]]:
    """Read ``known(key, item_id, text, answer)`` in the order of the keys, some rows at a time."""
    after = None
    while True:
        rest = known if after is None else known.where(F.col("key") > after)
        rows = rest.orderBy("key").limit(at_a_time).collect()
        for r in rows:
            yield r["item_id"], r["text"], r["answer"]
        if len(rows) < at_a_time:
            return
        after = rows[-1]["key"]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    answer_col: str | None = None,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Return ``(doc_id, item_id, share, answer_share)`` of documents and the items they hold.

    ``share`` is the share of an item's words (of a long item: of a passage)
    that the document has in their order close together, ``answer_share`` that
    of its answer; without an answer column, the item's last sentence stands
    for it.

    Words are lower-cased and parted by white space and ASCII
    punctuation. Null or empty text, of documents or items: no words, no rows.
    Documents without an id are left out, as nothing can refer to them; rows
    that share one are one document. Every different text and answer of the
    benchmark is searched, also several under one id, which make one row, and
    those without an id, whose ``item_id`` is null. An empty table gives no
    rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = by_id(docs, id_col, text_col).where("doc_id is not null").withColumn("text", F.lower("text"))
    answer = F.lit(None).cast("string") if answer_col is None else F.col(answer_col)
    known = benchmark.where("text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text"), F.lower(answer).alias("answer")
    )
    known = keep(known.distinct().withColumn("key", F.sha2(F.to_json(F.struct("item_id", "text", "answer")), 256)), "decontamination-items")
    schema = "doc_id long, item_id long, share double, answer_share double"
    out = spark.createDataFrame([], schema)
    for items in Items.blocks(_by_key(known, block_items)):
        numbered = keep(number_words(rows, items), "decontamination-words")
        out = out.union(search(numbered, items, *latent_space(numbered, items)))
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("answer_share").alias("answer_share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return the rows of ``docs``, all columns, without those that hold an item, with or without an id. Rows without an id stay."""
    found = keep(contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_held")).distinct(), "contaminated")
    return docs.join(found, F.col(id_col).cast("long") == F.col("_held"), "left_anti")


@query()
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they hold."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
