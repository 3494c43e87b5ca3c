"""Link documents by the Jaccard similarity of their word n-grams.

Method: adaptive multi-match prefixes. The n-grams of a document are put in
one order for all documents, the rare ones first. Two sets that share at least
t elements share at least l of their first ``size - t + l``. Each document
chooses its l by the estimated cost of its candidates: a longer prefix is more
to look through, but demands l shared elements before a pair is verified.

Copies and groups of near copies are not expanded into pairs. Documents of one
set are one class. Where very many classes share an n-gram, all are verified
against one that is central there; what that joins is one component, and pairs
are then only sought between components. Whatever is still apart is verified
pair by pair, so no link between two components is lost.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import by_id, keep, query, smallest_labels, table
from eventloom.llm.shingles import mix, shingle_hashes, word_hashes

#: The n-gram frequencies are estimated by 2**SKETCH_BITS counters, 4 MB at any size of the corpus.
SKETCH_BITS = 22
BLOCK_BITS = 16
#: Bits of the filter that says which documents' whole sets are wanted.
FILTER_BITS = 24
#: The largest number of shared prefix elements that a document may demand.
MOST = 5
#: What verifying a pair costs, in looked-at postings.
VERIFY = 8
#: Classes at an n-gram from which on it gets a central one, and rounds of that at most.
CROWD, ROUNDS = 32, 2


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i, hashes, counts in word_hashes(batch.column("text")):
            yield batch, i, *shingle_hashes(hashes, counts, words)


def frequency_sketch(rows: DataFrame, words: int) -> np.ndarray:
    """Count all n-grams into a fixed number of counters, kept as rounded logarithms.

    Only an order is taken from it, so what it mixes up costs time and no links.
    """
    size, block = 1 << SKETCH_BITS, 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_ = np.zeros(size, np.uint32), False
        for _, _, grams, _ in _sets(batches, words):
            np.add.at(counts, (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
            any_ = True
        if any_:
            found = np.flatnonzero(counts)
            cuts = np.searchsorted(found, np.arange(0, size + 1, block))
            blocks = [b for b in range(size // block) if cuts[b] < cuts[b + 1]]
            packed = []
            for b in blocks:
                at = found[cuts[b] : cuts[b + 1]]
                packed.append(zlib.compress((at - b * block).astype("<u2").tobytes() + counts[at].astype("<u4").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, packed in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                data = zlib.decompress(packed)
                n = len(data) // 6
                sums.setdefault(b, np.zeros(block, np.uint64))[np.frombuffer(data, "<u2", n)] += np.frombuffer(data, "<u4", n, 2 * n)
        levels = [np.minimum(255, np.round(8 * np.log2(1.0 + s))).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    parts = rows.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    sketch = np.zeros(size, np.uint8)
    for b, levels in parts.collect():  # ``size`` bytes
        sketch[b * block : (b + 1) * block] = np.frombuffer(levels, np.uint8)
    return sketch


def _shortest(n: Column, num: int, den: int) -> Column:
    """The least size of a set that can be similar to one of n elements, which is also their least overlap."""
    return F.floor((n * num + (den - 1)) / den)


def prefixes(rows: DataFrame, words: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """Return ``(doc_id, n, print, prefix)``: set size, fingerprint of the set, and its first elements in the common order."""
    shared = rows.sparkSession.sparkContext.broadcast(sketch)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch, i, grams, many in _sets(batches, words):
            sizes, prints, found = [], [], []
            stop = 0
            for count in many.tolist():
                start, stop = stop, stop + count
                one = np.unique(grams[start:stop])
                n = len(one)
                sizes.append(n)
                prints.append(hashlib.blake2b(one.tobytes(), digest_size=16).digest())
                order = np.lexsort((one, levels[one >> np.uint64(64 - SKETCH_BITS)]))
                found.append(one[order[: n - -(-n * num // den) + MOST]])
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found])))
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(i, len(many)),
                    pa.array(sizes, pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64))),
                ],
                names=["doc_id", "n", "print", "prefix"],
            )

    return rows.select("doc_id", "text").mapInArrow(made, "doc_id long, n long, print binary, prefix array<long>")


def _place(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bit for each hashed id; 2 MB at any number of ids."""
    size = 1 << FILTER_BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[_place(batch.column("id").to_numpy())] = True
        packed = np.packbits(bits).reshape(1 << 6, -1)
        some = np.flatnonzero(packed.any(axis=1))
        data = [zlib.compress(packed[k].tobytes(), 1) for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary())], names=["block", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                blocks[k] = blocks.get(k, 0) | np.frombuffer(zlib.decompress(data), np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], names=["block", "bits"]
        )

    schema = "block int, bits binary"
    out = np.zeros((1 << 6, size >> 9), np.uint8)
    for k, data in ids.select("id").mapInArrow(mark, schema).repartition("block").mapInArrow(join, schema).collect():
        out[k] = np.frombuffer(data, np.uint8)
    return out.reshape(-1)


def _elements(rows: DataFrame, words: int, ids: np.ndarray) -> DataFrame:
    """The whole sets of the documents that the filter lets through, ``(doc_id, elements)``.

    The filter may let others through, which is of no harm; so the texts need no shuffle.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ids)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).view(bool)
        wanted = (b.filter(pa.array(bits[_place(b.column("doc_id").to_numpy())])) for b in batches)
        for batch, i, grams, many in _sets(wanted, words):
            parts = np.split(grams, np.cumsum(many)[:-1])
            found = [np.unique(part).view(np.int64) for part in parts]
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found])))
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(many)), lists], names=["doc_id", "elements"])

    return rows.select("doc_id", "text").mapInArrow(made, "doc_id long, elements array<long>")


def _postings(index: DataFrame, num: int, den: int) -> DataFrame:
    """Prefix elements that two classes or more have, cut to the l that each document chooses.

    ``(gram, id, n, at, l, weight)``; ``at`` is the element's place in the
    order of its set, ``weight`` how many shared elements its prefix has.
    """
    all_ = index.select(F.col("doc_id").alias("id"), "n", F.posexplode("prefix").alias("at", "gram"))
    common = all_.groupBy("gram").agg(F.count("*").alias("df"), F.min("n").alias("least")).where("df > 1")
    n, at = F.col("n"), F.col("at")
    # A partner is no smaller than the smallest here, which bounds from below the overlap it takes.
    partner = F.greatest(F.col("least"), _shortest(n, num, den))
    overlap = _overlap(n, partner, num, den)
    shared = keep(all_.join(common, "gram").where(at < n - overlap + MOST).drop("least"), "jaccard-shared")
    # The cost of each l: postings looked at, and candidates at most, each of which takes l of them.
    prefix = n - _shortest(n, num, den)
    looked = [F.sum(F.when(at < prefix + l, F.col("df") - 1).otherwise(0)) for l in range(1, MOST + 1)]
    cheapest = F.least(*(F.struct((look * (1 + VERIFY / l)).alias("cost"), F.lit(l).alias("l")) for l, look in enumerate(looked, 1)))
    chosen = shared.groupBy("id").agg(cheapest["l"].alias("l"), F.count("*").alias("weight"))
    return keep(shared.join(chosen, "id").where(at < prefix + F.col("l")).drop("df"), "jaccard-postings")


def _overlap(a: Column, b: Column, num: int, den: int) -> Column:
    """The least overlap of similar sets of sizes a and b: the least whole number o with den * o >= num * (a + b - o)."""
    return F.floor(((a + b) * num + (num + den - 1)) / (num + den))


def _similar_sizes(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _verified(rows: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Keep the pairs ``(a, b)`` whose whole sets are similar; only the sets of documents in pairs are made."""
    pairs = keep(pairs, "jaccard-pairs")
    ids = _id_filter(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))))
    sets = keep(_elements(rows, words, ids), "jaccard-sets")
    right = sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("eb"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("ea"))
    both = F.size(F.array_intersect("ea", "eb")).cast("long")
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", both.alias("both"), (F.size("ea") + F.size("eb")).cast("long").alias("sum"))
    similar = joined.where(F.col("both") * den >= (F.col("sum") - F.col("both")) * num)
    return keep(similar.select("a", "b"), "jaccard-links")


def _with_labels(postings: DataFrame, edges: DataFrame | None) -> DataFrame:
    if edges is None:
        return postings.withColumn("label", F.col("id"))
    labels = smallest_labels(edges, "jaccard-labels")
    return postings.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _open(labelled: DataFrame) -> DataFrame:
    """Drop the n-grams that only one component has; add the largest component of each, and how many pairs are open."""
    parts = labelled.groupBy("gram", "label").agg(F.count("*").alias("k"))
    grams = parts.groupBy("gram").agg(
        F.max(F.struct("k", "label"))["label"].alias("main"),
        F.sum("k").alias("size"),
        ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("open"),
    )
    return labelled.join(keep(grams.where("open > 0"), "jaccard-open"), "gram")


def _multi_match(pairs: DataFrame, postings: DataFrame, num: int, den: int) -> DataFrame:
    """Keep the pairs that share as many elements of their longer prefixes as the lesser l of the two demands."""
    own = keep(
        postings.groupBy("id", "n", "l").agg(F.collect_list(F.struct("at", "gram")).alias("prefix")),  # at most its own prefix
        "jaccard-own",
    )
    a = own.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("l").alias("al"), F.col("prefix").alias("ap"))
    b = own.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("l").alias("bl"), F.col("prefix").alias("bp"))
    least, need = F.least("al", "bl"), _overlap(F.col("an"), F.col("bn"), num, den)

    def first(prefix: str, n: str) -> Column:
        return F.transform(F.filter(prefix, lambda e: e["at"] < F.col(n) - need + least), lambda e: e["gram"])

    both = F.size(F.array_intersect(first("ap", "an"), first("bp", "bn")))
    return pairs.join(a, "a").join(b, "b").where(both >= least).select("a", "b").distinct()


def links(rows: DataFrame, index: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Return links ``(a, b)`` between classes, enough of them to connect all that are linked."""
    postings = _postings(index, num, den)
    edges = None
    for turn in range(ROUNDS + 1):
        now = keep(_open(_with_labels(postings, edges)), "jaccard-round")
        total = now.agg(F.count("*").alias("rows"), F.count(F.when(F.col("size") >= CROWD, 1)).alias("crowded")).first()
        if turn == ROUNDS or not total["crowded"]:
            break
        # The one with the most shared elements in its prefix has the fewest of its own, so it is central; later any.
        rank = F.col("weight") if turn == 0 else F.xxhash64("id", F.lit(turn))
        crowded = now.where(F.col("size") >= CROWD)
        centre = crowded.groupBy("gram").agg(F.max(F.struct(rank.alias("rank"), F.col("id").alias("c"), F.col("n").alias("cn"), F.col("label").alias("cl"))).alias("best"))
        pairs = (
            crowded.join(keep(centre.select("gram", "best.c", "best.cn", "best.cl"), "jaccard-centres"), "gram")
            .where((F.col("label") != F.col("cl")) & _similar_sizes(F.col("n"), F.col("cn"), num, den))
            .select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"))
            .distinct()
        )
        found = _verified(rows, pairs, words, num, den)
        if not found.limit(1).count():
            break
        edges = found if edges is None else edges.union(found)
    # All pairs of components that are still apart: one side is not of the n-gram's largest component. The first
    # element that a similar pair shares is within the prefixes for l = 1, so only those are joined.
    x, y = now.where("label <> main").alias("x"), now.alias("y")
    need = _overlap(F.col("x.n"), F.col("y.n"), num, den)
    met = x.join(
        y,
        (F.col("x.gram") == F.col("y.gram"))
        & (F.col("x.label") != F.col("y.label"))
        & ((F.col("y.label") == F.col("y.main")) | (F.col("x.id") < F.col("y.id")))
        & _similar_sizes(F.col("x.n"), F.col("y.n"), num, den)
        & (F.col("x.at") <= F.col("x.n") - need)
        & (F.col("y.at") <= F.col("y.n") - need),
    )
    pairs = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    candidates = _multi_match(pairs, postings, num, den)
    last = _verified(rows, candidates, words, num, den)
    return last if edges is None else edges.union(last)


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    num: int = 80,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Return ``(doc_id, n_shingles, class_id, component_id)`` for every row.

    Texts are lower-cased (A-Z) and split at ASCII white space. A document's
    set is that of its sequences of ``words`` words; with fewer words, the
    whole sequence. Two are linked when ``den * intersection >= num * union``.
    ``class_id`` is the smallest id with the same set, ``component_id`` the
    smallest id that links lead to, itself included.

    Null or empty text: an empty set, linked with nothing, its own component.
    A null id: null class and component, and no part in any link. Rows that
    share an id are one document with the links of all of them. Other columns
    are ignored. No rows give no rows.
    """
    rows = by_id(docs, id_col, text_col)
    features = keep(prefixes(rows, words, num, den, frequency_sketch(rows, words)), "jaccard-prefixes")
    full = features.where("n > 0 and doc_id is not null")
    classes = keep(full.groupBy("print", "n").agg(F.min("doc_id").alias("class_id")), "jaccard-classes")
    firsts = classes.select(F.col("class_id").alias("doc_id"), "print")
    index = full.join(firsts, ["doc_id", "print"], "left_semi").dropDuplicates(["doc_id", "print"])
    found = links(rows.where("doc_id is not null"), index, words, num, den)
    # A document with several texts joins their classes.
    several = full.select("doc_id", "print").distinct().groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1")
    twice = full.join(several.select("doc_id"), "doc_id", "left_semi").join(classes, ["print", "n"])
    labels = smallest_labels(found.union(twice.select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))), "jaccard-last")
    named = keep(
        classes.join(labels, F.col("class_id") == F.col("id"), "left").select(
            "print", "n", "class_id", F.coalesce("label", "class_id").alias("component_id")
        ),
        "jaccard-named",
    )
    # Written tables on both sides: the class of very many copies is split.
    grouped = full.select("doc_id", "n", "print").join(named, ["print", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    alone = features.where("n = 0 or doc_id is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")
    )
    return grouped.union(alone)


@query()
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under sequences of four words and a similarity of 0.85."""
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "class_id")
