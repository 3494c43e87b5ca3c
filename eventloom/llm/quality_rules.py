"""Quality rules: counts over words and lines, and the perplexity under a model of the corpus.

Method: modified Kneser-Ney n-gram models for each language, counted by Spark
over all documents; upper and lower bands of perplexity for each language
reject documents. There are two models, each with bands of its own.

The model of words has n-grams of one to three words, every one that the corpus
holds. Texts are packed some thousands together. A pack sends its different
n-grams, as sorted arrays of words, to the shards that the hashes of their
middle words name; a shard counts them and answers each pack in the order in
which it asked, so no n-gram goes back. What a word would bring too much of to
one shard is dealt out by the last word, and the answers are added up. Nothing
of the counts is sent to the executors as a whole. A text is scored with its
own counts taken out of all of them: else each text that nothing resembles
would be foretold by itself. Equal texts count once.

The model of spelling has n-grams of three character classes of 6 bits. It
tells noise from words that are only rare, and the language of a passage.

A document may quote another language. So spelling is scored in windows, each
under the language that it suits best relative to that language's usual score;
the words of a window that suits another language far better are counted and
looked up in that one. The bands are on the means over the document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import SPACE, keep, ordered, query, scratch, table
from eventloom.llm.shingles import BETWEEN_SPACE, TOGETHER, _hash_words, groups, mix, word_hashes

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
ORDER, BITS = 3, 6
CODES = 1 << ORDER * BITS
#: Bytes that are scored under one language.
WINDOW = 64
#: Bits by which a window has to suit another language better for its words to be counted in that one.
FOREIGN = 32.0
#: Bytes of texts that are counted and measured together.
GROUP = 1 << 19
#: Rows of word n-grams that are scored together; the words before a text's first.
SCORED, NO_WORD = 1 << 16, 0
#: Rows of word n-grams in a pack of texts, and in a shard; those with the same middle word that one shard may get.
PACK_ROWS, SHARD_ROWS, HOT_ROWS = 1 << 19, 1 << 20, 1 << 19
#: The shards are asked, and the packs scored, in so many jobs one after the other; what one has shuffled is gone before the next.
SLICES = 4
#: Bytes of messages that a task hands on together; it is handed four times as much at a time.
SENT = 1 << 20
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 * SENT)}
#: Words are looked up in shards of their own, one for so many of the others. A pack names words of more than this share.
WORD_SHARE, COMMON = 4, 1 / 2000
#: Labelled documents of each kind that the bands are fitted on at least; the band without them, in median absolute
#: deviations; and how much a lost good document weighs against a kept bad one.
LABELLED_LEAST, USUAL, GOOD_WEIGHT = 20, 8.0, 10.0


def _classes() -> np.ndarray:
    """The class of each byte; 0 stands for the beginning of a text.

    Lower-case letters, upper-case ones together, digits together, blanks, the
    common punctuation and the symbols each; the rest by kind and low bits.
    """
    out = np.zeros(256, np.int64)
    alone = [bytes([b]) for b in range(ord("a"), ord("z") + 1)]
    upper, digits = bytes(range(ord("A"), ord("Z") + 1)), b"0123456789"
    kinds = [*alone, upper, digits, b" \t\r\x0b\x0c", b"\n", *(bytes([b]) for b in b".,;:!?'\"-()/"), *(bytes([b]) for b in SYMBOLS)]
    kinds += [bytes(range(0x80 + k, 0xC0, 8)) for k in range(8)]
    kinds += [bytes(range(0xC0, 0xE0)), bytes(range(0xE0, 0x100))]
    out[:] = len(kinds) + 1
    for number, kind in enumerate(kinds, 1):
        out[list(kind)] = number
    return out


CLASS = _classes()


def _codes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash of the n-gram that ends at each byte; none reaches over a text's beginning."""
    classes = CLASS[data]
    out = classes.copy()
    for back in range(1, ORDER):
        before = np.zeros(len(data), np.int64)
        before[back:] = classes[:-back]
        for k in range(back):
            at = starts + k
            before[at[at < len(data)]] = 0
        out += before << (BITS * back)
    return out


def _slices(part: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The codes of a group of texts and where the texts begin; those of one long text come in parts."""
    for at in range(0, max(1, len(part)), TOGETHER):
        lead = min(at, ORDER - 1)
        piece = part[at - lead : at + TOGETHER]
        inside = np.unique(offsets[:-1][(offsets[:-1] >= at) & (offsets[:-1] < at + TOGETHER)]) - at + lead
        yield _codes(piece, inside)[lead:], offsets


def ngram_counts(rows: DataFrame) -> DataFrame:
    """Count the n-grams of all texts: ``(lang, gram, many)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for i, part, offsets in groups(batch.column("text"), GROUP):
                # A long text comes alone, in several slices; else the one slice is the whole group.
                alone = len(offsets) == 2
                for codes, _ in _slices(part, offsets):
                    if alone:
                        counts.setdefault(langs[i], np.zeros(CODES, np.int64))[:] += np.bincount(codes, minlength=CODES)
                        continue
                    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                    here = langs[i : i + len(offsets) - 1]
                    for lang in set(here):
                        mine = codes[(here == lang)[owner]]
                        counts.setdefault(lang, np.zeros(CODES, np.int64))[:] += np.bincount(mine, minlength=CODES)
        for lang, many in counts.items():
            grams = np.flatnonzero(many)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int32)), pa.array(many[grams])],
                names=["lang", "gram", "many"],
            )

    parts = rows.select("lang", "text").mapInArrow(count, "lang string, gram int, many long")
    return parts.groupBy("lang", "gram").agg(F.sum("many").alias("many"))


def _discounts(many: Sequence[int]) -> np.ndarray:
    """What is taken off counts of 0, 1, 2, and 3 or more, by how many n-grams are found 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (max(1, k) for k in many)
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.01, [1, 0.99, 1.99, 2.99])


class Model:
    """A modified Kneser-Ney model: for each order the sorted hashes, and the log probability of each n-gram seen."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(grams)
        hashes, many = grams[order].astype(np.int64), counts[order].astype(np.float64)
        tables = [(hashes, many)]
        for k in range(ORDER - 1, 0, -1):  # lower orders count how many different characters stand before
            hashes, many = np.unique(hashes & (1 << k * BITS) - 1, return_counts=True)
            tables.append((hashes, many.astype(np.float64)))
        self.arrays = [self._discounted(hashes, many) for hashes, many in reversed(tables)]
        # Relative to what the language usually scores, texts of different languages can be compared.
        self.usual = float((self.expand()[grams] * counts).sum() / max(1, counts.sum()))

    @staticmethod
    def _discounted(hashes: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Return sorted hashes with their discounted share, and sorted contexts with what they leave to the lower order."""
        rule = _discounts([int((many == k).sum()) for k in (1, 2, 3, 4)])
        cut = rule[np.minimum(many, 3).astype(int)]
        contexts, back = np.unique(hashes >> BITS, return_inverse=True)
        total, left = np.bincount(back, many), np.bincount(back, cut)
        return hashes, (many - cut) / total[back], contexts, left / total

    def expand(self) -> np.ndarray:
        """Log probabilities of all n-grams in the order of their hashes, seen or not."""
        lower = np.full(1, 1.0 / (1 << BITS))
        for k, (hashes, share, contexts, left) in enumerate(self.arrays, 1):
            codes = np.arange(1 << k * BITS)
            at = np.minimum(np.searchsorted(contexts, codes >> BITS), max(0, len(contexts) - 1))
            known = contexts[at] == codes >> BITS if len(contexts) else np.zeros(len(codes), bool)
            weight = np.where(known, left[at], 1.0) if len(contexts) else 1.0
            lower = weight * lower[codes & (1 << (k - 1) * BITS) - 1]
            lower[hashes] += share
        return np.log2(lower)


def fit_models(rows: DataFrame) -> dict[str, Model]:
    """Count over all documents and build a model for each language; at most 2**18 rows a language come to the driver."""
    with _settings(rows.sparkSession, SMALL_BATCHES):
        found = ngram_counts(rows).toPandas()
    return {lang: Model(part["gram"].to_numpy(), part["many"].to_numpy()) for lang, part in found.groupby("lang")}


def measures(rows: DataFrame, models: dict[str, Model], carry: Sequence[str] = ()) -> DataFrame:
    """Return the counts and the score of each ``(doc_id, lang, text)``, after the ``carry`` columns.

    The score is bits a byte above the usual perplexity of the language that
    each window suits best; null for a text without bytes or a corpus without text.
    """
    kinds = rows.select("doc_id", "lang", *carry).dtypes
    schema = ", ".join(f"`{name}` {kind}" for name, kind in kinds)
    schema += ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
    carried = [name for name, _ in kinds]
    tables = np.stack([m.usual - m.expand() for m in models.values()]).astype(np.float32) if models else np.zeros((0, CODES))
    shared = rows.sparkSession.sparkContext.broadcast(tables)  # a megabyte a language

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            column = batch.column("text")
            lines = [_dup_lines(text) for text in column.to_pylist()]
            words, repeats, chars, symbols, scores = [], [], [], [], []
            for _, hashes, counts in word_hashes(column, lower=False, together=GROUP):
                words.extend(counts.tolist())
                repeats.extend(_repeated(hashes, counts).tolist())
            for _, part, offsets in groups(column, GROUP):
                chars.extend(_sums(_IS_CHAR[part], offsets).tolist())
                symbols.extend(_sums(_IS_SYMBOL[part], offsets).tolist())
                scores.extend(_scores(part, offsets, bits).tolist())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            made = [
                pa.array(values, kind, from_pandas=True)
                for values, kind in zip((words, chars, symbols, lines, repeats, scores), kinds, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, carried), *made],
                names=[*carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"],
            )

    return rows.select("doc_id", "lang", "text", *(name for name in carry if name != "text")).mapInArrow(measure, schema)


_IS_CHAR = np.ones(256, np.int64)  # of a word: counts the first byte of each code point
_IS_CHAR[0x80:0xC0] = 0
_IS_CHAR[[ord(c) for c in SPACE]] = 0
_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _scores(part: np.ndarray, offsets: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Mean over each text of what its windows score under the language that suits them best."""
    sums, sizes = np.zeros(len(offsets) - 1), np.diff(offsets)
    if not len(bits):
        return np.full(len(sums), np.nan)
    if len(part) <= TOGETHER:
        codes = next(_slices(part, offsets))[0]
        windows = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), windows)
        first = np.concatenate(([0], np.cumsum(windows)[:-1]))
        at = offsets[:-1][owner] + WINDOW * (np.arange(len(owner)) - first[owner])
        if len(at):
            sums += np.bincount(owner, _best(codes, at, bits), len(sizes))
    else:
        for codes, _ in _slices(part, offsets):
            sums[0] += _best(codes, np.arange(0, len(codes), WINDOW), bits).sum()
    return np.where(sizes > 0, sums / np.maximum(sizes, 1), np.nan)


def _best(codes: np.ndarray, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return np.min([np.add.reduceat(table[codes].astype(np.float64), at) for table in bits], axis=0)


GRAM = ("tongue", "a", "b", "c")


def word_ngrams(rows: DataFrame, models: dict[str, Model]) -> DataFrame:
    """Return ``(key, tongue, a, b, c, own)``: how often each text has the word ``c`` after ``a`` and ``b``.

    A text is named by its key, and equal texts are one. ``tongue`` is the
    language that the words are counted in. A text's rows stand together, in
    the order in which the text first has them.
    """
    return _once(rows).mapInArrow(_ngram_counter(rows.sparkSession, models), "key long, tongue string, a long, b long, c long, own long")


def _once(rows: DataFrame) -> DataFrame:
    """The ``(key, lang, text)`` of different texts; only texts that are found twice or more are moved."""
    texts = rows.select("key", "lang", "text")
    twice = keep(texts.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key"), "quality-equal")
    return texts.join(twice, "key", "left_anti").union(texts.join(twice, "key", "left_semi").dropDuplicates(["key"]))


def _ngram_counter(spark: SparkSession, models: dict[str, Model]) -> Callable:
    names = list(models)
    tables = np.stack([m.usual - m.expand() for m in models.values()]).astype(np.float32) if models else np.zeros((0, CODES), np.float32)
    shared = spark.sparkContext.broadcast((names, tables))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bits = shared.value
        number = {name: k for k, name in enumerate(names)}
        for batch in batches:
            keys = batch.column("key").to_numpy()
            langs = np.array([number.get(lang, 0) for lang in batch.column("lang").to_pylist()], np.int64)
            for i, part, offsets in groups(batch.column("text"), GROUP):
                hashes, tongues, owner = _tongues(part, offsets, langs[i : i + len(offsets) - 1], bits)
                if not len(hashes):
                    continue
                before = [np.full(len(hashes), NO_WORD, np.uint64) for _ in range(2)]
                for k, array in enumerate(before, 1):
                    array[k:] = np.where(owner[k:] == owner[:-k], hashes[:-k], np.uint64(NO_WORD))
                one = _key(owner.astype(np.uint64), tongues.astype(np.uint64), before[1], before[0], hashes)
                order = np.argsort(one)
                new = _run_starts(one[order])
                at, many = np.minimum.reduceat(order, new), np.diff(np.append(new, len(one)))
                order = np.argsort(at)
                at, many = at[order], many[order]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[i + owner[at]]),
                        pa.DictionaryArray.from_arrays(pa.array(tongues[at].astype(np.int32)), pa.array(names, pa.string())).cast(pa.string()),
                        *(pa.array(array[at].view(np.int64)) for array in (before[1], before[0], hashes)),
                        pa.array(many.astype(np.int64)),
                    ],
                    names=["key", *GRAM, "own"],
                )

    return count


def _narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers in four bytes each, if all fit."""
    return values.astype(np.int64 if len(values) and values.max() >= 1 << 31 else np.int32, copy=False)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and the number of each value among them."""
    order = np.argsort(values)
    sorted_ = values[order]
    new = np.ones(len(values), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    kind = np.int32 if len(values) < 1 << 31 else np.int64
    back = np.empty(len(values), kind)
    back[order] = np.cumsum(new, dtype=kind) - 1
    return sorted_[new], back


def _alike(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different value, and the number of each value among them."""
    order = np.argsort(values)
    sorted_ = values[order]
    new = np.ones(len(values), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    back = np.empty(len(values), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def _key(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + part.view(np.uint64) + np.uint64(1))
    return out


def _tongues(part: np.ndarray, offsets: np.ndarray, langs: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word, the language it is counted in, and the text it is of; a long text is read in parts."""
    found: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(part):
        stop = min(len(part), at + TOGETHER)
        if len(part) <= TOGETHER:
            begins = offsets
        else:  # one long text, cut at white space
            if stop < len(part):
                space = np.flatnonzero(~BETWEEN_SPACE[part[at:stop]])
                later = space if len(space) else np.flatnonzero(~BETWEEN_SPACE[part[stop:]]) + stop - at
                stop = at + int(later[-1 if len(space) else 0]) + 1 if len(later) else len(part)
            begins = np.array([0, stop - at])
        piece = part[at:stop]
        hashes, start = _hash_words(piece, begins[:-1])
        owner = np.searchsorted(begins, start, side="right") - 1
        codes = _codes(piece, np.unique(begins[:-1][begins[:-1] < len(piece)]))
        windows = -(-np.diff(begins) // WINDOW)
        first = np.concatenate(([0], np.cumsum(windows)[:-1]))
        of = np.repeat(np.arange(len(windows)), windows)
        heads = begins[:-1][of] + WINDOW * (np.arange(len(of)) - first[of])
        scores = np.stack([np.add.reduceat(table[codes].astype(np.float64), heads) for table in bits])
        scores[langs[of], np.arange(len(of))] -= FOREIGN
        tongues = scores.argmin(axis=0)[first[owner] + (start - begins[owner]) // WINDOW]
        found.append((hashes, tongues, owner))
        at = stop
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(arrays) for arrays in zip(*found, strict=True))


PACKS = "pack long, n long, common array<struct<tongue: long, word: long, many: long>>, blob binary"
MESSAGES = "place long, kind int, source long, blob binary"
#: What a message holds: a pack, its n-grams or the answer to them, how many words stand before each word, a pack's words or
#: the answer to them, and the counts of counts of an order (its place) in a language (its source).
TEXTS, ASK, ANSWER, BEFORE, ASK_WORDS, WORDS, FEW = range(7)


def _dump(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as bytes: the lowest bytes of all numbers together, then the next ones."""
    head, body = [len(arrays)], []
    for values in arrays:
        values = np.ascontiguousarray(values).astype(np.uint64, copy=False)
        used = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
        planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :used].T)
        packed = pa.compress(planes.tobytes(), "zstd", asbytes=True) if used else b""
        head += [len(values), used, len(packed)]
        body.append(packed)
    return np.array(head, np.int64).tobytes() + b"".join(body)


def _sizes(blob: bytes) -> np.ndarray:
    """How many numbers each array has, in how many bytes each, and the bytes of them all."""
    many = int(np.frombuffer(blob, np.int64, 1)[0])
    return np.frombuffer(blob, np.int64, 3 * many, 8).reshape(many, 3)


def _load(blob: bytes, first: int = 0, stop: int | None = None) -> list[np.ndarray]:
    """The arrays from the ``first`` up to before ``stop``, in four bytes a number where three are enough."""
    sizes = _sizes(blob)
    out, at = [], 8 + 24 * len(sizes) + int(sizes[:first, 2].sum())
    for size, used, packed in sizes[first:stop].tolist():
        kind = np.dtype(np.int32 if used < 4 else np.int64)
        values = np.zeros((size, kind.itemsize), np.uint8)
        if used:
            planes = pa.decompress(blob[at : at + packed], size * used, "zstd", asbytes=True)
            values[:, :used] = np.frombuffer(planes, np.uint8).reshape(used, size).T
        out.append(values.view(kind).ravel())
        at += packed
    return out


def _hashes(blob: bytes, at: int) -> np.ndarray:
    return _load(blob, at, at + 1)[0].astype(np.int64, copy=False).view(np.uint64)


def _messages(found: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(zip(*found, strict=True), kinds, strict=True)], names=["place", "kind", "source", "blob"]
    )


def _sent(messages: Iterable[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Messages in batches of about ``SENT`` bytes, as many small ones cost more one by one."""
    held, size = [], 0
    for message in messages:
        held.append(message)
        size += len(message[3]) + 64
        if size >= SENT:
            yield _messages(held)
            held, size = [], 0
    if held:
        yield _messages(held)


def _by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """The messages ``(kind, source, blob)`` of each place, of batches sorted by it."""
    place, held = None, []
    for batch in batches:
        for at, *message in zip(*(batch.column(name).to_pylist() for name in ("place", "kind", "source", "blob")), strict=True):
            if at != place and held:
                yield place, held
                held = []
            place = at
            held.append(tuple(message))
    if held:
        yield place, held


def _delivered(messages: DataFrame, places: int) -> DataFrame:
    return messages.repartition(places, "place").sortWithinPartitions("place", "kind", "source")


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack the rows of ``word_ngrams``; all those of a text go into one pack."""
    held: list[pa.RecordBatch] = []
    size, enough, number = 0, PACK_ROWS, TaskContext.get().partitionId() << 32
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        while size >= enough:
            whole = pa.Table.from_batches(held)
            keys = whole.column("key").to_numpy()
            ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1  # of all texts but the last, which may go on
            if not len(ends):
                enough = 2 * size
                break
            stop = int(ends[max(0, int(np.searchsorted(ends, PACK_ROWS, side="right")) - 1)])
            yield _pack(number, whole.slice(0, stop))
            held, size, enough, number = whole.slice(stop).to_batches(), size - stop, PACK_ROWS, number + 1
    if size:
        yield _pack(number, pa.Table.from_batches(held))


def _pack(number: int, rows: pa.Table) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    keys, own = rows.column("key").to_numpy(), rows.column("own").to_numpy()
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    tongue = rows.column("tongue").chunk(0).dictionary_encode()
    names, t = tongue.dictionary.to_pylist(), tongue.indices.to_numpy()
    tongues = np.array([int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") for name in names], np.uint64)
    a, b, c = (rows.column(name).to_numpy() for name in "abc")
    # The words before are mostly those of the row before.
    odd = np.concatenate(([0], np.flatnonzero((b[1:] != c[:-1]) | (a[1:] != b[:-1])) + 1))
    words, at = _numbered(np.concatenate((c, a[odd], b[odd])))
    order = np.argsort(-np.bincount(at), kind="stable")  # common words get small numbers
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    words = words[order].view(np.uint64)
    c, a, b = np.split(rank[at], [len(c), len(c) + len(odd)])
    blob = _dump(keys[starts], np.diff(np.append(starts, len(keys))), tongues, t, words, c, own, np.diff(odd, prepend=0), a, b)
    middle = _shifted(c, odd, b)
    many = np.bincount(t.astype(np.int64) * len(words) + middle)
    often = np.flatnonzero(many > len(keys) * COMMON)
    which, many = np.divmod(often, len(words)), many[often]
    common = [
        {"tongue": tongue, "word": word, "many": n}
        for tongue, word, n in zip(tongues[which[0]].view(np.int64).tolist(), words[which[1]].view(np.int64).tolist(), many.tolist(), strict=True)
    ]
    kind = pa.list_(pa.struct([("tongue", pa.int64()), ("word", pa.int64()), ("many", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([common], kind), pa.array([blob], pa.binary())],
        names=["pack", "n", "common", "blob"],
    )


def _shifted(after: np.ndarray, odd: np.ndarray, values: np.ndarray) -> np.ndarray:
    """What stands in the row before, but for the ``values`` in the ``odd`` rows."""
    out = np.zeros_like(after)
    out[1:] = after[:-1]
    out[odd] = values
    return out


class Pack:
    """The rows of some texts, their different n-grams, and in which order the shards are asked for them.

    Words and languages are numbers within the pack: ``words`` and ``tongues`` hold their hashes.
    """

    def __init__(self, blob: bytes) -> None:
        self.keys, self.sizes = (array.astype(np.int64) for array in _load(blob, 0, 2))
        self.tongues, self.words = _hashes(blob, 2), _hashes(blob, 4)
        (self.t,), (self.c, self.own, odd, a, b) = _load(blob, 3, 4), _load(blob, 5)
        odd = np.cumsum(odd, dtype=np.int64)
        self.b = _shifted(self.c, odd, b)
        self.a = _shifted(self.b, odd, a)

    def deal(self, hot: tuple[np.ndarray, np.ndarray], shards: int) -> Pack:
        """Find the different n-grams and their shards; ``hot`` are words and among how many shards each is dealt out."""
        n = len(self.words)
        pairs, pair = _numbered((self.t.astype(np.int64) * n + self.b) * n + self.a)
        grams, self.gram = _numbered(pair.astype(np.int64) * n + self.c)
        self.pair, c = (_narrow(array) for array in np.divmod(grams, n))
        del pair, grams
        self.pair_tb, a = np.divmod(pairs, n)
        self.pair_a = _narrow(a)
        del pairs, a
        middles, self.middle = _numbered(self.pair_tb)
        middle = _key(self.tongues[middles // n], self.words[middles % n])
        # A word that is too common for a shard is dealt out by the last word; each of its shards is asked for each context.
        parts = np.ones(len(middle), np.uint64)
        if len(hot[0]):
            found = np.minimum(np.searchsorted(hot[0], middle), len(hot[0]) - 1)
            parts = np.where(hot[0][found] == middle, hot[1][found], parts)
        of = self.middle[self.pair]
        shard = _narrow((mix(middle[of] + self.words[c] % parts[of]) % np.uint64(shards)).astype(np.int64))
        del of
        asked = np.flatnonzero(parts[self.middle] > 1)
        many = parts[self.middle[asked]].astype(np.int64)
        part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        asked = np.repeat(asked, many)
        more = mix(middle[self.middle[asked]] + part.view(np.uint64)) % np.uint64(shards)
        shard = np.concatenate((shard, _narrow(more.astype(np.int64))))
        asked_pair = np.concatenate((self.pair, _narrow(asked)))
        order = np.lexsort((asked_pair, shard)) if len(asked) else np.argsort(shard, kind="stable")
        self.shard, self.asked_pair = shard[order], asked_pair[order]
        none = np.zeros(len(asked), np.int32)
        self.asked_gram = np.concatenate((np.arange(len(c), dtype=self.gram.dtype), none - 1))[order]  # -1: only its context
        self.asked_c = np.concatenate((c, none))[order]
        own = np.bincount(self.gram, self.own, len(c)).astype(np.int64)
        self.asked_own = np.concatenate((_narrow(own), none))[order]
        return self

    def deal_words(self, word_shards: int) -> Pack:
        """Find the different words, for how many others stand before them, and their shards."""
        n = len(self.words)
        there = np.zeros(len(self.tongues) * n, bool)
        at = self.t.astype(np.int64) * n + self.c
        there[at] = True
        ends = np.flatnonzero(there)
        self.end = (np.cumsum(there, dtype=np.int32) - 1)[at]
        place = _word_place(self.tongues[ends // n], self.words[ends % n], word_shards)
        self.end_order = np.argsort(place, kind="stable")
        self.end_place, self.ends = place[self.end_order], ends[self.end_order]
        return self

    def asks(self, part: int, slices: int) -> Iterator[tuple[int, bytes]]:
        """The n-grams that each shard of a slice is asked for: sorted by language, middle word and first word."""
        n = len(self.words)
        for shard, here in _runs(self.shard):
            if shard % slices != part:
                continue
            pair = self.asked_pair[here]
            t, b = np.divmod(self.pair_tb[pair], n)
            used, at = np.unique(np.concatenate((self.pair_a[pair], b, self.asked_c[here])), return_inverse=True)
            a, b, c = at.reshape(3, -1)
            yield shard, _dump(self.tongues, self.words[used], np.diff(t * len(used) + b, prepend=0), a, c, self.asked_own[here])

    def word_asks(self) -> Iterator[tuple[int, bytes]]:
        n = len(self.words)
        for place, here in _runs(self.end_place):
            yield place, _dump(_key(self.tongues[self.ends[here] // n], self.words[self.ends[here] % n]))

    def take(self, answers: list[bytes], words: list[bytes]) -> Pack:
        """Take in all that the shards have answered, in the order of the shards."""

        def told(number: int) -> np.ndarray:
            return np.concatenate([_load(blob, number, number + 1)[0] for blob in answers])

        real = self.asked_gram >= 0
        gram = self.asked_gram[real]
        three, two = np.add(told(0), self.asked_own, dtype=np.int64)[real], told(1)[real]
        self.three, self.two = (np.zeros(len(self.pair), many.dtype) for many in (three, two))
        self.three[gram], self.two[gram] = three, two
        pair = self.asked_pair[_run_starts(self.shard, self.asked_pair)]
        self.after_pair = [_narrow(np.bincount(pair, told(k), len(self.middle)).astype(np.int64)) for k in range(2, 6)]
        middle = self.middle[self.asked_pair]
        middle = middle[_run_starts(self.shard, middle)]
        self.after_middle = [_narrow(np.bincount(middle, told(k)).astype(np.int64)) for k in range(6, 10)]
        one = np.concatenate([_load(blob)[0] for blob in words])
        self.one = np.zeros(len(self.ends), one.dtype)
        self.one[self.end_order] = one
        return self

    def columns(self) -> Iterator[dict[str, np.ndarray]]:
        """The rows with all that the shards have answered, those of some texts at a time."""
        ends = np.cumsum(self.sizes)
        first = at = 0
        while at < len(self.c):
            last = min(int(np.searchsorted(ends, at + SCORED)), len(ends) - 1)
            here = slice(at, int(ends[last]))
            gram = self.gram[here]
            pair = self.pair[gram]
            middle = self.middle[pair]
            found = {"tongue": self.t[here], "a": self.a[here], "b": self.b[here], "c": self.c[here], "own": self.own[here]}
            found |= {"n_three": self.three[gram], "n_two": self.two[gram], "n_one": self.one[self.end[here]]}
            found |= {f"t{k}": many[pair] for k, many in enumerate(self.after_pair)}
            found |= {f"u{k}": many[middle] for k, many in enumerate(self.after_middle)}
            keys = np.repeat(self.keys[first : last + 1], self.sizes[first : last + 1])
            yield {"key": keys} | {name: values.astype(np.int64) for name, values in found.items()}
            first, at = last + 1, here.stop


def _word_place(tongues: np.ndarray, words: np.ndarray, word_shards: int) -> np.ndarray:
    return (mix(_key(words, tongues)) % np.uint64(word_shards)).astype(np.int64)


def _run_starts(*sorted_: np.ndarray) -> np.ndarray:
    """Where any of the arrays has another value than before."""
    new = np.ones(len(sorted_[0]), bool)
    new[1:] = np.any([array[1:] != array[:-1] for array in sorted_], axis=0)
    return np.flatnonzero(new)


def _runs(sorted_: np.ndarray) -> Iterator[tuple[int, slice]]:
    starts = _run_starts(sorted_)
    for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(sorted_)], strict=True):
        yield int(sorted_[at]), slice(at, end)


def _counts_of(many: np.ndarray, of: np.ndarray, size: int) -> list[np.ndarray]:
    """For each owner, the sum of the counts and how many are 1, 2, 3 or more."""
    sums = [np.bincount(of, many, size)] + [np.bincount(of, (many == k) if k < 3 else (many >= 3), size) for k in (1, 2, 3)]
    return [array.astype(np.int64) for array in sums]


def _few(order: int, many: np.ndarray, tongue: np.ndarray, tongues: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """For each language the counts of counts: how many are 1, 2, 3 and 4, their sum, and how many there are."""
    for k in np.unique(tongue).tolist():
        mine = many[tongue == k]
        yield order, FEW, int(tongues[k : k + 1].view(np.int64)[0]), _dump(np.array([*((mine == j).sum() for j in (1, 2, 3, 4)), mine.sum(), len(mine)]))


def _count_shard(asks: list[tuple[int, int, bytes]], word_shards: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Count a shard's n-grams over all packs; answer each pack, and tell the words' shards how many words stand before theirs."""
    tongues, tongue_at = _numbered(np.concatenate([_hashes(blob, 0) for _, _, blob in asks]))
    words, word_at = _numbered(np.concatenate([_hashes(blob, 1) for _, _, blob in asks]))
    n = len(words)
    sizes = [int(_sizes(blob)[3, 0]) for _, _, blob in asks]
    ends = np.cumsum(sizes)
    key, last, own = np.empty(sum(sizes), np.int64), np.empty(sum(sizes), np.int32), np.empty(sum(sizes), np.int64)
    for (_, _, blob), size, end in zip(asks, sizes, ends.tolist(), strict=True):
        here = slice(end - size, end)
        n_tongues, n_words = _sizes(blob)[:2, 0].tolist()
        my_tongues, tongue_at = tongue_at[:n_tongues].astype(np.int64), tongue_at[n_tongues:]
        my_words, word_at = word_at[:n_words], word_at[n_words:]
        steps, first, c, own[here] = _load(blob, 2)
        t, b = np.divmod(np.cumsum(steps, dtype=np.int64), n_words)
        key[here] = (my_tongues[t] * n + my_words[b]) * n + my_words[first]
        last[here] = my_words[c]
    own = _narrow(own)
    pairs, pair = _numbered(key)
    del key
    grams, gram = _numbered(pair.astype(np.int64) * n + last)
    del last
    three = np.bincount(gram, own, len(grams)).astype(np.int64)
    of_pair, last = (_narrow(array) for array in np.divmod(grams, n))
    del grams
    after_pair = [_narrow(many) for many in _counts_of(three, of_pair, len(pairs))]
    few = [*_few(3, three[three > 0], (pairs // n // n)[of_pair[three > 0]], tongues)]
    ends_, end = _numbered((pairs // n)[of_pair] * n + last)
    del of_pair, last
    two = np.bincount(end, three > 0, len(ends_)).astype(np.int64)
    three, end = _narrow(three), _narrow(end)
    middles, middle = _numbered(ends_ // n)
    after_middle = [_narrow(many) for many in _counts_of(two, middle, len(middles))]
    middle = np.searchsorted(middles, pairs // n).astype(np.int32)  # of each context
    del pairs
    for (_, pack, _), size, stop in zip(asks, sizes, ends.tolist(), strict=True):
        here = slice(stop - size, stop)
        new_pair, new_middle = (of[_run_starts(of)] for of in (pair[here], middle[pair[here]]))
        yield (
            pack,
            ANSWER,
            0,
            _dump(three[gram[here]] - own[here], two[end[gram[here]]], *(many[new_pair] for many in after_pair), *(many[new_middle] for many in after_middle)),
        )
    yield from few
    found = two > 0
    yield from _few(2, two[found], (ends_ // n // n)[found], tongues)
    last, many = np.unique((ends_[found] // n // n) * n + ends_[found] % n, return_counts=True)
    place = _word_place(tongues[last // n], words[last % n], word_shards)
    order = np.argsort(place, kind="stable")
    last, many = last[order], many[order]
    for to, here in _runs(place[order]):
        yield to, BEFORE, 0, _dump(_key(tongues[last[here] // n], words[last[here] % n]), tongues[last[here] // n], many[here])


def _count_words(messages: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int, bytes]]:
    """Add up how many different words stand before each word, and answer the packs."""
    told = [blob for kind, _, blob in messages if kind == BEFORE]
    words, first, at = np.unique(np.concatenate([_hashes(blob, 0) for blob in told]), return_index=True, return_inverse=True)
    one = np.bincount(at, np.concatenate([_load(blob, 2)[0] for blob in told]), len(words)).astype(np.int64)
    tongues, tongue = np.unique(np.concatenate([_hashes(blob, 1) for blob in told])[first], return_inverse=True)
    yield from _few(1, one, tongue, tongues)
    for kind, pack, blob in messages:
        if kind == ASK_WORDS:
            yield pack, WORDS, 0, _dump(one[np.searchsorted(words, _hashes(blob, 0))])


def word_scores(grams: DataFrame) -> DataFrame:
    """Return ``(key, word_score)``: bits a word of each text, under what all other texts hold.

    ``grams`` is that of ``word_ngrams``, with a text's rows together. Shorter
    n-grams count how many different words stand before them.
    """
    return _scores_of_packs(grams.mapInArrow(_packs, PACKS))


def _scores_of_packs(packs: DataFrame) -> DataFrame:
    spark = packs.sparkSession
    packs = _keep(packs, "quality-packs")
    many, rows = packs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = -(-rows // SHARD_ROWS) or 1
    slices = min(SLICES, shards)
    word_shards = -(-shards // WORD_SHARE)
    common = packs.select(F.explode("common").alias("g")).groupBy("g.tongue", "g.word").agg(F.sum("g.many").alias("many"))
    hot = common.where(F.col("many") > HOT_ROWS).collect()  # at most one for so many rows
    names = _key(*(np.array([r[name] for r in hot], np.int64) for name in ("tongue", "word")))
    parts = np.array([-(-r["many"] // HOT_ROWS) for r in hot], np.uint64)
    order = np.argsort(names)
    shared = spark.sparkContext.broadcast((names[order], parts[order]))

    def ask(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            for number, blob in zip(batch.column("pack").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                yield from _sent((shard, ASK, number, asked) for shard, asked in Pack(blob).deal(hot, shards).asks(part, slices))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, asks in _by_place(batches):
            counted = _count_shard(asks, word_shards)
            yield from _sent((place, kind, shard if kind == ANSWER else source, blob) for place, kind, source, blob in counted)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("pack").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                yield from _sent((place, ASK_WORDS, number, asked) for place, asked in Pack(blob).deal_words(word_shards).word_asks())

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, messages in _by_place(batches):
            yield from _sent((place, kind, at if kind == WORDS else source, blob) for place, kind, source, blob in _count_words(messages))

    texts = packs.select("pack", "blob")
    tables = []
    for part in range(slices):
        asks = texts.mapInArrow(partial(ask, part), MESSAGES)
        tables.append(_keep(_delivered(asks, -(-shards // slices)).mapInArrow(count, MESSAGES), "quality-counts"))
    counted = reduce(DataFrame.union, tables)
    words = _delivered(texts.mapInArrow(ask_words, MESSAGES).union(counted.where(F.col("kind") == BEFORE)), word_shards)
    words = _keep(words.mapInArrow(count_words, MESSAGES), "quality-words")
    sums: dict[int, dict[int, np.ndarray]] = {}
    for r in counted.union(words).where(F.col("kind") == FEW).collect():  # one a language, order and shard
        mine = sums.setdefault(r["source"] % (1 << 64), {})
        mine[r["place"]] = mine.get(r["place"], 0) + _load(bytes(r["blob"]))[0].astype(np.int64)
    constants: dict[int, dict[str, np.ndarray]] = {}
    for tongue, orders in sums.items():
        mine = constants[tongue] = {f"rule{k}": _discounts(found[:4].tolist()) for k, found in orders.items()}
        n1, n2, _, _, total, kinds = orders[1].tolist()
        mine["all"] = np.array([total, n1, n2, kinds - n1 - n2], np.float64)
        mine["none"] = np.array([1.0 / (kinds + 1)])
    known = spark.sparkContext.broadcast(constants)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, messages in _by_place(batches):
            pack = Pack(messages[0][2]).deal(shared.value, shards).deal_words(word_shards)
            pack.take(*([blob for kind, _, blob in messages if kind == wanted] for wanted in (ANSWER, WORDS)))
            constants = [known.value[tongue] for tongue in pack.tongues.tolist()]
            for columns in pack.columns():
                keys, scores = _word_bits(columns, constants)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(scores)], names=["key", "word_score"])

    asked = texts.select(F.col("pack").alias("place"), F.lit(TEXTS).alias("kind"), F.lit(0).cast("long").alias("source"), "blob")
    answers = counted.where(F.col("kind") == ANSWER).union(words.where(F.col("kind") == WORDS))
    scores = []
    for part in range(slices):
        here = asked.union(answers).where(F.pmod(F.xxhash64("place"), F.lit(slices)) == part)
        scored = _delivered(here, -(-many // slices) or 1).mapInArrow(score, "key long, word_score double")
        scores.append(_keep(scored, "quality-scores"))
    return reduce(DataFrame.union, scores)


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _keep(df: DataFrame, name: str) -> DataFrame:
    """``keep``, with little memory for what is handed to Python.

    After it nothing is left of the shuffles that made the table: it is read, never computed again.
    """
    with _settings(df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | SMALL_BATCHES):
        return keep(df, name)


def _word_bits(columns: dict[str, np.ndarray], constants: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Mean bits a word of each text in some rows, with the text's own n-grams taken out of every count."""
    column = columns.__getitem__
    keys, text = np.unique(column("key"), return_inverse=True)
    tongue, a, b, c, own = (column(name) for name in ("tongue", "a", "b", "c", "own"))
    base = _key(text.astype(np.uint64), tongue.astype(np.uint64))
    constant = lambda name: np.stack([mine[name] for mine in constants])

    def lower(many: np.ndarray, context: np.ndarray, totals: np.ndarray, lost: np.ndarray, rule: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of kinds of n-grams: the counts without the text, the share they get, and what their context leaves."""
        left = many - lost
        at, back = _alike(context)
        sums = totals[at].astype(np.float64)
        sums[:, 0] -= np.bincount(back, lost, len(at))
        for k in (1, 2, 3):
            sums[:, k] += np.bincount(back, (np.minimum(left, 3) == k) * 1.0 - (np.minimum(many, 3) == k), len(at))
        sums = sums[back]
        total = np.maximum(sums[:, 0], 1)
        share = np.where(left > 0, left - rule[np.arange(len(left)), np.minimum(left, 3)], 0.0) / total
        return left, share, np.where(sums[:, 0] > 0, (sums[:, 1:] * rule[:, 1:]).sum(1) / total, 1.0)

    left, share3, rest3 = lower(column("n_three"), _key(base, a, b), np.stack([column(f"t{k}") for k in range(4)], 1), own, constant("rule3")[tongue])
    at2, back2 = _alike(_key(base, b, c))
    gone = np.bincount(back2, left == 0, len(at2)).astype(np.int64)
    left, share2, rest2 = lower(
        column("n_two")[at2], _key(base[at2], b[at2]), np.stack([column(f"u{k}") for k in range(4)], 1)[at2], gone, constant("rule2")[tongue[at2]]
    )
    at1, back1 = _alike(_key(base[at2], c[at2]))
    gone = np.bincount(back1, left == 0, len(at1)).astype(np.int64)
    at1 = at2[at1]
    _, share1, rest1 = lower(column("n_one")[at1], base[at1], constant("all")[tongue[at1]], gone, constant("rule1")[tongue[at1]])
    p = share1 + rest1 * constant("none")[tongue[at1], 0]
    p = share2 + rest2 * p[back1]
    p = share3 + rest3 * p[back2]
    return keys, np.bincount(text, -np.log2(p) * own) / np.bincount(text, own)


def _dup_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return len(lines) - len(set(lines))


def _repeated(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many words of each text stand in a window of three that the text has twice or more."""
    owner = np.repeat(np.arange(len(counts)), counts)
    hit = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        same = owner[:-2] == owner[2:]
        at = np.flatnonzero(same)
        windows = mix(mix(mix(hashes[at]) + hashes[at + 1]) + hashes[at + 2])
        windows = mix(windows + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, back, many = np.unique(windows, return_inverse=True, return_counts=True)
        twice = at[many[back] > 1]
        for k in range(3):
            hit[twice + k] = True
    return np.bincount(owner, hit, len(counts)).astype(np.int64)


def bands(measured: DataFrame, labels: DataFrame | None, score: str = "score", least: float = USUAL) -> DataFrame:
    """Return ``(lang, low, high)``: the scores that a language's documents may have.

    The median and the median absolute deviation are those of all documents
    that pass the counts. Both ends are fitted on all of these that
    ``labels(doc_id, quality)`` names; a language with too few of them gets the
    usual band, of which the lower end is ``least`` deviations away.
    """
    passed = measured.where("not base_failed").select("doc_id", "lang", F.col(score).alias("score")).where("score is not null")
    middle = passed.groupBy("lang").agg(F.percentile_approx("score", 0.5, 10_000).alias("middle"))
    away = F.col("score") - F.col("middle")
    spread = F.greatest(F.percentile_approx(F.abs(away), 0.5, 10_000), F.lit(1e-6))
    around = passed.join(F.broadcast(middle), "lang").groupBy("lang").agg(F.first("middle").alias("middle"), spread.alias("spread"))
    usual = keep(around.withColumn("low", F.col("spread") * least).withColumn("high", F.col("spread") * USUAL), "quality-usual")  # one row a language
    ends = usual
    if labels is not None:
        known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
        labelled = passed.join(known, "doc_id").join(F.broadcast(usual), "lang").withColumn("away", away)
        found = _cuts(labelled.select("lang", "away", (F.col("quality") > 0).alias("good"), "low", "high"))
        ends = usual.join(found.select("lang", F.col("low").alias("_low"), F.col("high").alias("_high")), "lang", "left")
        ends = ends.withColumn("low", F.coalesce("_low", "low")).withColumn("high", F.coalesce("_high", "high"))
    return keep(ends.select("lang", (F.col("middle") - F.col("low")).alias("low"), (F.col("middle") + F.col("high")).alias("high")), "quality-bands")


def _cuts(labelled: DataFrame) -> DataFrame:
    """Return ``(lang, low, high)``: how far from a language's middle to reject, null where too few documents are labelled.

    ``labelled(lang, away, good, low, high)`` has the usual ends beside each
    document. Of the cuts between two values, and one above all, those are
    meant that lose the fewest, a lost good one weighing more than a kept bad
    one. The different values are sorted over all partitions, with one row for
    each partition and language to carry on the counts.
    """
    values = labelled.groupBy("lang", "away", "low", "high").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    here = F.col("away")

    def end(name: str, at: Column, beyond: Column) -> Column:
        bad = F.when(beyond, F.col("bad")).otherwise(F.lit(0).cast("long"))
        return F.struct(F.lit(name).alias("end"), at.alias("at"), F.col("good").alias("good"), bad.alias("bad"), F.col(name).alias("usual"))

    sides = values.select("lang", F.explode(F.array(end("high", here, here > 0), end("low", -here, here <= 0))).alias("s")).select("lang", "s.*")
    group = ["lang", "end"]
    placed = ordered(sides.where("good + bad > 0"), [*group, "at"], "quality-values")
    parts = placed.groupBy(*group, "_part").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.min("at").alias("first"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum(name).over(whole).alias(f"all_{name}") for name in "gb"]
    sums += [F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"before_{name}") for name in "gb"]
    parts = parts.select(*group, "_part", *sums, F.lead("first").over(whole.orderBy("_part")).alias("then"))
    enough = parts.where((F.col("all_g") >= LABELLED_LEAST) & (F.col("all_b") >= LABELLED_LEAST))
    inside = Window.partitionBy(*group, "_part").orderBy("_at")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    next_ = F.coalesce(F.lead("at").over(inside), "then")
    counted = placed.join(F.broadcast(enough), [*group, "_part"]).select(  # one row a partition of the sort, and a language
        *group,
        "at",
        "good",
        "all_g",
        (F.col("before_g") + F.sum("good").over(so_far)).alias("g"),
        F.when(next_.isNull(), F.greatest("at", "usual")).otherwise((F.col("at") + next_) / 2).alias("cut"),
        ((F.col("before_b") + F.sum("bad").over(so_far)) / F.col("all_b")).alias("kept_bad"),
    )
    counted = keep(counted, "quality-cuts")
    # The median is the mean of two good ones, those with these numbers from 0.
    two = (F.floor((F.col("all_g") - 1) / 2), F.floor(F.col("all_g") / 2))
    found = [F.max(F.when((F.col("g") - F.col("good") <= number) & (number < F.col("g")), F.col("at"))) for number in two]
    median = counted.groupBy(*group).agg(((found[0] + found[1]) / 2).alias("median"))
    lost = (F.col("all_g") - F.col("g")) / F.col("all_g") * GOOD_WEIGHT + F.col("kept_bad")
    above = counted.join(F.broadcast(median), group).where("cut > median").select(*group, "cut", lost.alias("lost"))
    fewest = above.groupBy(*group).agg(F.min("lost").alias("fewest"))
    best = above.join(F.broadcast(fewest), group).where(F.col("lost") <= F.col("fewest") + 1e-12)
    return best.groupBy("lang").agg(*(F.avg(F.when(F.col("end") == name, F.col("cut"))).alias(name) for name in ("low", "high")))


def _inputs(id_col: str, text_col: str, lang_col: str) -> list[Column]:
    return [
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    ]


def _base_failed() -> Column:
    repeats = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    return (F.col("n_words") < MIN_WORDS) | repeats


def _with_verdict(measured: DataFrame, limits: DataFrame, word_limits: DataFrame) -> DataFrame:
    inside = F.coalesce(F.col("score").between(F.col("low"), F.col("high")), F.lit(True))
    usual = F.coalesce(F.col("word_score").between(F.col("word_low"), F.col("word_high")), F.lit(True))
    word_limits = word_limits.select("lang", F.col("low").alias("word_low"), F.col("high").alias("word_high"))
    joined = measured.join(F.broadcast(limits), "lang", "left").join(F.broadcast(word_limits), "lang", "left")  # one row a language
    return joined.select(*measured.columns, (~F.col("base_failed") & inside & usual).alias("kept"))


def _judged(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Measure and judge rows of ``(doc_id, lang, text, key)``; all columns but the text, and the verdict."""
    models = fit_models(rows)
    measured = measures(rows, models, carry=["key"]).withColumn("base_failed", _base_failed())
    count = _ngram_counter(rows.sparkSession, models)
    scores = _scores_of_packs(_once(rows).mapInArrow(lambda batches: _packs(count(batches)), PACKS))
    measured = _keep(measured.join(scores, "key", "left"), "quality")
    # A text that others resemble is foretold well, and no worse for it: without labels the words have no lower end.
    return _with_verdict(measured, bands(measured, labels), bands(measured, labels, "word_score", float("inf")))


def judge(
    docs: DataFrame,
    labels: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Return ``(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, word_score, base_failed, kept)``.

    Null text: no words. A null language is the language "". A null id stays
    null and is never labelled. Repeated rows are each judged; the words of
    equal texts count once. A document that passes the counts is kept if both
    its scores lie in the bands of its language. No rows give no rows. Other
    columns are ignored.
    """
    return _judged(_with_key(docs.select(*_inputs(id_col, text_col, lang_col))), labels).drop("key")


def _with_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.xxhash64("lang", "text"))


def keep_good(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Return the rows of ``docs(doc_id, text, lang, ...)`` that ``judge`` keeps, with all columns."""
    with scratch(docs.sparkSession) as kept:
        good = _judged(_with_key(docs.select(*_inputs("doc_id", "text", "lang"))), labels).where("kept").select("key").distinct()
        good = keep(good, "quality-kept")
        kept.pop()  # the only one that is still read
    whole = _with_key(docs.select(F.struct(*docs.columns).alias("_row"), *_inputs("doc_id", "text", "lang")))
    return whole.select("_row", "key").join(good, "key", "left_semi").select("_row.*")


@query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "word_score"
    )
