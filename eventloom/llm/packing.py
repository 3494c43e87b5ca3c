"""Pack tokenised documents into sequences of a fixed room.

Method: best-two-fit. Sequences are filled greedily, the longest piece that
fits first; then the smallest piece of a sequence is replaced by two unpacked
ones that fit the gap it leaves more tightly.

Pieces of equal length are interchangeable, so the plan is made over the
number of pieces of each length, which is at most as many numbers as a
sequence has tokens. It says which pieces, by their rank among those of their
length, go where. Ranks, look-ups and everything else over documents is done
by Spark.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import by_id, keep, query, table

ROOM = 1024
END_ID = 2
#: Words a worker remembers, and the longest word it does.
KEPT, LONGEST = 400_000, 64
#: Texts that are encoded together.
TOGETHER = 256
#: Pieces that are ranked by one window, on average and at most so many windows at few rows.
RANKED, RANKERS = 1 << 16, 256


class Words(dict):
    """Ids of words after a space, as little-endian 32-bit numbers; encodes a word that it does not remember."""

    def __init__(self, vocabulary: str, ranks: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(vocabulary)
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.sizes = np.zeros(1 + max(merges.values()), np.int64)
        for token, number in merges.items():
            self.sizes[number] = len(token)

    def encode(self, text: str) -> bytes:
        """Encode a text. Below U+0250 the faster library, on the same vocabulary, gives the same ids."""
        if text and max(text) >= "ɐ":
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.plain.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        return self.encode(f" {word}")

    def learn(self, words: set[str]) -> None:
        """Remember words, encoding those not met before together, which is faster than one by one."""
        if len(self) >= KEPT:
            self.clear()
        new = [word for word in words - self.keys() if len(word) <= LONGEST and (word.isascii() or max(word) < "ɐ")]
        if not new:
            return
        ids = np.array(self.plain.encode_ordinary(f" {' '.join(new)}"), "<u4")
        ends = np.cumsum(self.sizes[ids])
        stops = np.searchsorted(ends, np.cumsum([len(word.encode()) + 1 for word in new]), side="left") + 1
        data, start = ids.tobytes(), 0
        for word, stop in zip(new, (4 * stops).tolist(), strict=True):
            self[word] = data[start:stop]
            start = stop


#: A space with no word right after it: there the text is not cut.
NO_CUT = re.compile(r" (?=\s|\Z)")


def cut(text: str) -> list[str]:
    """Split a text at spaces where the vocabulary's rule always starts a new unit.

    It does at a space before a character that is not white space, whatever
    stands before it. So the ids of a text are those of its parts.
    """
    parts = text.split(" ")
    if not NO_CUT.search(text):
        return parts
    joined = [parts[0]]
    for part in parts[1:]:
        if not part or part[0].isspace():
            joined[-1] += f" {part}"
        else:
            joined.append(part)
    return joined


def encode(words: Words, texts: list[str]) -> Iterator[bytes]:
    """Yield the ids of each text, some texts at a time."""
    for at in range(0, len(texts), TOGETHER):
        group = texts[at : at + TOGETHER]
        parts = [None if any(special in text for special in words.specials) else cut(text) for text in group]
        met: set[str] = set()
        for part in parts:
            met.update((part or [])[1:])
        words.learn(met)
        for text, part in zip(group, parts, strict=True):
            if part is None:  # the library's rule for special strings in a text
                yield np.array(words.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield words.encode(part[0]) + b"".join(map(words.__getitem__, part[1:]))


@cache
def vocabulary(tokenizer_path: str | None, ranks_path: str | None) -> Words:
    """Load a vocabulary once in each worker."""
    import public_tokenizers as public

    return Words(tokenizer_path or public.path("byte_bpe_50k.json"), ranks_path or public.path("byte_bpe_50k.tiktoken"))


def tokenise(
    docs: DataFrame,
    room: int = ROOM,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    tokenizer_path: str | None = None,
    ranks_path: str | None = None,
) -> DataFrame:
    """Return the pieces of every document: ``(doc_id, piece, start, length, ids_crc32, ids)``.

    A document's ids are those of its text and an end id. Only a document of
    more than ``room`` ids is cut; its first piece takes the remainder, so the
    others are full. ``ids`` is null unless asked for.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    end = np.array([END_ID], "<u4").tobytes()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(tokenizer_path, ranks_path)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            texts = encode(words, batch.column("text").to_pylist())
            for doc_id, encoded in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = memoryview(encoded + end)
                total = len(ids) // 4
                stops = range(total % room or room, total + 1, room) if total > room else [total]
                start = 0
                for piece, stop in enumerate(stops):
                    part = ids[4 * start : 4 * stop]
                    row = (doc_id, piece, start, stop - start, zlib.crc32(part), bytes(part) if with_ids else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    start = stop
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(out, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
            )

    return by_id(docs, id_col, text_col).mapInArrow(split, schema)


def plan(counts: np.ndarray, room: int) -> list[tuple[list[int], int]]:
    """Pack ``counts[n]`` pieces of each length ``n``; return (lengths in a sequence, number of such sequences).

    A pattern is repeated until one of its lengths runs out, so there are
    about as many patterns as lengths, whatever the number of pieces.
    """
    left = counts.astype(np.int64).copy()
    patterns: list[tuple[list[int], int]] = []
    while left.any():
        uses: dict[int, int] = {}
        gap = room
        while gap:
            fits = np.flatnonzero(left[: gap + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            take = min(int(left[n]), gap // n)
            uses[n] = uses.get(n, 0) + take
            left[n] -= take
            gap -= n * take
        if gap:
            smallest = min(uses)
            a, b = _two(left, gap + smallest)
            if a + b > smallest:
                uses[smallest] -= 1
                left[smallest] += 1
                for n in (a, b):
                    uses[n] = uses.get(n, 0) + 1
                    left[n] -= 1
        uses = {n: k for n, k in uses.items() if k}
        more = min(int(left[n]) // k for n, k in uses.items())
        for n, k in uses.items():
            left[n] -= more * k
        patterns.append(([n for n, k in sorted(uses.items(), reverse=True) for _ in range(k)], more + 1))
    return patterns


def _two(left: np.ndarray, room: int) -> tuple[int, int]:
    """The two unpacked pieces with the largest sum within ``room``; (0, 0) if there are none."""
    lengths = np.flatnonzero(left[: room + 1])
    if not len(lengths):
        return 0, 0
    # For each length the longest other one that still fits, which is itself only if there are two of it.
    at = np.searchsorted(lengths, room - lengths, side="right") - 1
    alone = (at >= 0) & (lengths[at] == lengths) & (left[lengths] < 2)
    at = np.where(alone, at - 1, at)
    sums = np.where(at >= 0, lengths + lengths[at], 0)
    best = int(sums.argmax())
    return (int(lengths[best]), int(lengths[at[best]])) if sums[best] else (0, 0)


def _places(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs of ranks: the first rank, first sequence, first offset, and pieces of the length in a sequence."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for n in dict.fromkeys(lengths):
            many = lengths.count(n)
            runs.setdefault(n, []).append((used.get(n, 0), sequence, offset, many))
            used[n] = used.get(n, 0) + many * times
            offset += n * many
        sequence += times
    return {n: tuple(np.array(column, np.int64) for column in zip(*rows, strict=True)) for n, rows in runs.items()}


def pack(pieces: DataFrame, room: int = ROOM) -> DataFrame:
    """Give every piece ``(doc_id, piece, length, ...)`` a ``sequence_id`` and an ``offset``.

    ``pieces`` should be a written table, as it is read three times.
    """
    counts = np.zeros(room + 1, np.int64)
    for length, count in pieces.groupBy("length").count().collect():  # at most ``room`` rows
        counts[length] = count
    places = _places(plan(counts, room))
    salts = max(RANKERS, int(counts.sum()) // RANKED)
    # Ranks within a length: by salt, so that a length that very many pieces have is many windows.
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("n", F.row_number().over(within)).join(bases, ["length", "salt"])
    names = pieces.columns
    ranked = ranked.select(*names, (F.col("base") + F.col("n") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for n in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == n)
                first, base, start, many = places[n]
                run = np.searchsorted(first, ranks[rows], side="right") - 1
                past = ranks[rows] - first[run]
                sequence[rows] = base[run] + past // many[run]
                offset[rows] = start[run] + past % many[run] * n
            columns = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    fields = ", ".join(f"`{name}` {kind}" for name, kind in pieces.dtypes)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, room: int = ROOM, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Tokenise and pack: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, and ``ids`` if asked for.

    Null or empty text: one piece with the end id alone. A null id stays null.
    Repeated rows are each packed. No rows: no sequences. Other columns of the
    input are ignored. The order within a sequence is by length.
    """
    pieces = tokenise(docs, room, id_col, text_col, with_ids)
    if not with_ids:
        pieces = pieces.drop("ids")
    return pack(keep(pieces, "pieces"), room)


@query()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return pack_documents(table(spark, sf_dir, "documents"))
