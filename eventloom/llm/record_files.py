"""Token ids in files of length-delimited binary records, with an index of offsets.

Format of a data file (that of TFRecord): for each record the length of its
data as 64 bits, the masked CRC-32C of these, the data, and the masked CRC-32C
of the data, all little-endian. The data is one serialised sequence: the
document's id as 64 bits, a flag that is 1 where there is an id, the bytes of
a token id (2 or 4), six bytes of zero, and the token ids.

Format of an index file, apart from the data: 32 bytes a record, its offset in
the data file, its whole length there, the number of token ids before it in
that file, and its number of token ids. So a reader can take records in any
order, and knows where each lies without reading data.

Documents are sorted by id over all partitions, each task writes what it holds
to files of its own, and only the files that finished tasks report are ever
read. What a lost executor or a second attempt leaves behind does no harm.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import by_id, keep, new_folder, query, table

FILE_BYTES = 64 << 20
READ_BYTES = 4 << 20
#: Bytes of text that are encoded together, or one document.
TOGETHER = 8 << 20
#: Tasks of one read at most; each takes several files then.
READERS = 20_000
END_ID = 1
#: Fixed values of the format: the reversed polynomial of CRC-32C, and what masks a checksum.
CASTAGNOLI, MASK = 0x82F63B78, 0xA282EAD8
LENGTH, CHECK, HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qBB6x")
FRAME = LENGTH.size + 2 * CHECK.size
ENTRY = np.dtype([("offset", "<u8"), ("size", "<u8"), ("before", "<u8"), ("tokens", "<u8")])
#: Bytes whose checksum is taken step by step; longer data are blocks of so many, put together by shifts.
STRIDE = 64


@cache
def _steps() -> np.ndarray:
    """Tables of the checksum: row k takes a byte in with k bytes of zero after it."""
    rows = np.zeros((8, 256), np.uint32)
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(CASTAGNOLI), byte >> 1)
    rows[0] = byte
    for k in range(1, 8):
        rows[k] = rows[0][rows[k - 1] & 255] ^ (rows[k - 1] >> 8)
    return rows


def _apply(shift: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return shift[0][crc & 255] ^ shift[1][crc >> 8 & 255] ^ shift[2][crc >> 16 & 255] ^ shift[3][crc >> 24]


@cache
def _shift(power: int) -> np.ndarray:
    """Tables that take a checksum past 2 ** ``power`` bytes of zero."""
    if power:
        half = _shift(power - 1)
        return np.stack([_apply(half, row) for row in half])
    step, byte = _steps()[0], np.arange(256, dtype=np.uint32)
    return np.stack([step[byte], *(byte << 8 * (k - 1) for k in (1, 2, 3))])


def _past(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Take each checksum past its own number of bytes of zero."""
    crc = crc.copy()
    for power in range(int(n_bytes.max(initial=0)).bit_length()):
        some = np.flatnonzero(n_bytes >> power & 1)
        crc[some] = _apply(_shift(power), crc[some])
    return crc


def checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Return the masked CRC-32C of many parts of a byte array at once.

    The checksum is linear: each part is cut into blocks, the blocks of all
    parts go through the tables together, and a block's checksum is then
    shifted past what follows it in its part.
    """
    if not len(starts):
        return np.zeros(0, np.uint32)
    blocks = np.maximum(1, -(-sizes // STRIDE))
    owner = np.repeat(np.arange(len(starts)), blocks)
    first = np.cumsum(blocks) - blocks
    after = (blocks[owner] - 1 - (np.arange(len(owner)) - first[owner])) * STRIDE  # bytes of the part behind a block
    stop = (starts + sizes)[owner] - after
    # Zeros before the first byte do not change a checksum that starts from zero.
    at = stop[:, None] + np.arange(-STRIDE, 0)
    bytes_of = np.where(at >= starts[owner][:, None], data[np.maximum(at, 0)] if len(data) else np.uint8(0), np.uint8(0))
    steps, crc = _steps(), np.zeros(len(owner), np.uint32)
    words = bytes_of.view("<u4").reshape(len(owner), -1)
    for k in range(0, words.shape[1], 2):
        low, high = words[:, k] ^ crc, words[:, k + 1]
        crc = steps[7][low & 255] ^ steps[6][low >> 8 & 255] ^ steps[5][low >> 16 & 255] ^ steps[4][low >> 24]
        crc ^= steps[3][high & 255] ^ steps[2][high >> 8 & 255] ^ steps[1][high >> 16 & 255] ^ steps[0][high >> 24]
    whole = np.bitwise_xor.reduceat(_past(crc, after), first)
    ones = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    crc = whole ^ _past(ones, sizes) ^ ones
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK)


class Words:
    """The word vocabulary: ids of texts, many at a time.

    A text's ids are those of the parts between its ASCII white space, as the
    vocabulary drops white space and joins nothing over it. So a batch of
    texts is its distinct parts, encoded once each, and their places.
    """

    #: Parts that are lower-cased and cut alike by the library and by UNIT below.
    PLAIN = "^[!-~À-ÖØ-öø-ÿ]{1,200}$"
    #: How the vocabulary cuts a part; the line end keeps parts apart.
    UNIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+|\n")

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.width = 2 if max(vocabulary.values()) < 1 << 16 and self.whole.get_vocab_size() <= 1 << 16 else 4
        # The vocabulary lists single bytes, single bytes that end a word, and then merges in order, so an id is a rank.
        # A zero byte stands for a word's end; plain parts hold none.
        letters = _byte_letters()
        ranks = {}
        for token, number in vocabulary.items():
            body = token.removesuffix("</w>")
            ranks[bytes(letters[c] for c in body) + b"\0" * (body != token)] = number
        self.line_end = ranks[b"\n\0"]
        self.plain = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Return the ids of the parts, one after another, and where each part's begin (and the last ends)."""
        easy = pc.match_substring_regex(parts, self.PLAIN)
        for special in self.specials:
            easy = pc.and_not(easy, pc.match_substring(parts, special))
        easy = easy.to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(parts), np.int64)
        line = "\n".join(parts.filter(pa.array(easy)).to_pylist()).lower() + "\n"
        ids = np.array(self.plain.encode_ordinary("\0".join(self.UNIT.findall(line)) + "\0"), np.uint32)
        ends = np.flatnonzero(ids == self.line_end)
        sizes[easy] = (np.diff(ends, prepend=-1) - 1)[: easy.sum()]
        hard = parts.filter(pa.array(~easy)).to_pylist()
        other = [encoded.ids for encoded in self.whole.encode_batch(hard, add_special_tokens=False)]
        sizes[~easy] = [len(found) for found in other]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        whole = np.zeros(starts[-1], np.uint32)
        from_easy = np.repeat(easy, sizes)
        whole[from_easy] = ids[ids != self.line_end]
        whole[~from_easy] = np.array([n for found in other for n in found], np.uint32)
        return whole, starts

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Return the ids of all texts, each with ``end_id`` after it, and where each text's begin (and the last ends)."""
        cut = pc.ascii_split_whitespace(texts)
        places = cut.flatten().dictionary_encode()
        ids, starts = self.encode_parts(places.dictionary)
        codes = places.indices.to_numpy(zero_copy_only=False)
        per_text = np.diff(cut.offsets.to_numpy())
        # An end mark after the parts of each text: one more part, which has the end id alone.
        marks = np.cumsum(per_text + 1) - 1
        order = np.full(len(codes) + len(texts), len(starts) - 1, np.int64)
        order[np.delete(np.arange(len(order)), marks)] = codes
        ids = np.append(ids, np.uint32(end_id))
        starts = np.append(starts, len(ids))
        sizes = np.diff(starts)[order]
        ends = np.cumsum(sizes)
        out = ids[np.repeat(starts[order] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.concatenate([[0], ends[marks]])


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable in Latin-1, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def vocabulary(path: str | None) -> Words:
    """Load a vocabulary once in each worker."""
    import public_tokenizers as public

    return Words(path or public.path("word_bpe_49k.json"))


class _Files:
    """The data file and the index that a task has open."""

    def __init__(self, folder: str, file_bytes: int, part: int) -> None:
        from pyarrow import fs

        self.folder, self.file_bytes, self.part = folder, file_bytes, part
        self.system, self.base = fs.FileSystem.from_uri(folder)
        self.done: list[tuple] = []
        self.data = None

    def write(self, frames: bytes, offsets: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> None:
        """Append framed records; they stay in one file."""
        if self.data is None:
            self.name = uuid.uuid4().hex
            self.data = self.system.open_output_stream(f"{self.base}/{self.name}.rec", compression=None)
            self.index = self.system.open_output_stream(f"{self.base}/{self.name}.idx", compression=None)
            self.at = self.records = self.tokens = 0
        entries = np.zeros(len(sizes), ENTRY)
        entries["offset"], entries["size"], entries["tokens"] = self.at + offsets, sizes, tokens
        entries["before"] = self.tokens + np.cumsum(tokens) - tokens
        self.data.write(frames)
        self.index.write(entries.tobytes())
        self.at, self.records, self.tokens = self.at + len(frames), self.records + len(sizes), self.tokens + int(tokens.sum())
        if self.at >= self.file_bytes:
            self.close()

    def close(self) -> None:
        if self.data is not None:
            self.data.close()
            self.index.close()
            self.done.append((f"{self.folder}/{self.name}", self.part, len(self.done), self.records, self.tokens, self.at))
            self.data = None


MANIFEST = "path string, part int, number int, records long, tokens long, bytes long"


def write_records(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the token ids of every row, in ascending order of id; return ``(path, part, number, records, tokens, bytes, first)`` of the files.

    The files are in order by (part, number); ``path`` without a suffix names
    the data (``.rec``) and the index (``.idx``), ``first`` counts the token
    ids in the files before. Token ids take two bytes each where the whole
    vocabulary fits.

    A null text is empty: a record with the end id alone. A null id comes
    first and is written as one without an id. Rows that share an id are each
    written, next to each other in any order. No rows: no files. Other columns
    are ignored. ``folder`` must be one that all executors share.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = vocabulary(tokenizer_path)
        files = _Files(folder, file_bytes, TaskContext.get().partitionId())
        kind = f"<u{words.width}"
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff((np.cumsum(sizes, dtype=np.int64) + 1) // TOGETHER)) + 1
            for at, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                some = batch.slice(at, stop - at)
                ids, starts = words.encode(some.column("text").cast(pa.large_string()), end_id)
                raw, doc_ids = ids.astype(kind).tobytes(), some.column("doc_id").to_pylist()
                bodies = [
                    serialise(doc, words.width, raw[a:z])
                    for doc, a, z in zip(doc_ids, (starts[:-1] * words.width).tolist(), (starts[1:] * words.width).tolist(), strict=True)
                ]
                files.write(*framed(bodies), np.diff(starts))
        files.close()
        columns = [list(c) for c in zip(*files.done, strict=True)] or [[]] * 6
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = [field.split()[0] for field in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    spark = docs.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    rows = by_id(docs, id_col, text_col).withColumn("_tie", F.monotonically_increasing_id())
    in_order = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    files = keep(in_order.mapInArrow(write, MANIFEST), "record-files")
    # One row a file, and one total for each partition of the sort.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("part").agg(F.sum("tokens").alias("held"))
    bases = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("base") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    return keep(files.join(bases, F.col("part") == F.col("p")).withColumn("first", first).drop("p", "base"), "record-manifest")


def framed(bodies: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Frame records with lengths and masked checksums; return the bytes, and each frame's offset and size."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    lengths = sizes.astype("<u8")
    head_checks = checksums(lengths.view(np.uint8), np.arange(len(bodies)) * 8, np.full(len(bodies), 8))
    data = np.frombuffer(b"".join(bodies), np.uint8)
    checks = checksums(data, np.cumsum(sizes) - sizes, sizes)
    out = []
    for body, head_check, check in zip(bodies, head_checks.tolist(), checks.tolist(), strict=True):
        out += (LENGTH.pack(len(body)), CHECK.pack(head_check), body, CHECK.pack(check))
    return b"".join(out), np.cumsum(sizes + FRAME) - sizes - FRAME, sizes + FRAME


def unframed(held: bytes, whole: bool = True) -> tuple[list[bytes], int]:
    """Return the data of the whole records at the start of ``held``, checked, and the bytes they took.

    With ``whole``, nothing may be left over.
    """
    spans, at = [], 0
    while at + LENGTH.size + CHECK.size <= len(held):
        size = LENGTH.unpack_from(held, at)[0]
        if size > 1 << 40:
            raise ValueError(f"the length at byte {at} is broken")
        if at + size + FRAME > len(held):
            break
        spans.append((at, size))
        at += size + FRAME
    if whole and at != len(held):
        raise ValueError("the records end within one")
    if spans:
        starts, sizes = np.array(spans, np.int64).T
        data = np.frombuffer(held, np.uint8)
        for name, begin, length in (("length", starts, np.full(len(starts), LENGTH.size)), ("data", starts + LENGTH.size + CHECK.size, sizes)):
            stored = data[(begin + length)[:, None] + np.arange(CHECK.size)].copy().view("<u4").ravel()
            wrong = np.flatnonzero(stored != checksums(data, begin, length))
            if len(wrong):
                raise ValueError(f"the checksum of the {name} of the record at byte {begin[wrong[0]]} differs")
    lead = LENGTH.size + CHECK.size
    return [held[start + lead : start + lead + size] for start, size in spans], at


def serialise(doc_id: int | None, width: int, ids: bytes) -> bytes:
    """Return a record's data from its document's id and its token ids of ``width`` bytes each."""
    return HEAD.pack(doc_id or 0, doc_id is not None, width) + ids


def parse(body: bytes) -> tuple[int | None, np.ndarray]:
    """Return the document id and the token ids of a record's data."""
    doc_id, known, width = HEAD.unpack_from(body)
    return doc_id if known else None, np.frombuffer(body, f"<u{width}", offset=HEAD.size).astype("<u4")


RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def _records(rows: list[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_records(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read the files of ``write_records`` from end to end.

    Returns ``(doc_id, start, n_tokens, ids_crc32, ids)``: ``start`` counts
    the token ids of all records before, ``ids_crc32`` is the CRC-32 of the
    ids as little-endian 32-bit numbers, and ``ids`` are these, null unless
    asked for. Every length and checksum is verified; a broken record ends the
    job. No files: no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(f"{path}.rec")
                held, want = b"", READ_BYTES
                with system.open_input_stream(name, compression=None) as source:
                    while more := source.read(want):
                        held += more
                        bodies, used = unframed(held, whole=False)
                        held = held[used:]
                        # A long record is read on in larger and larger steps, not again from its start each time.
                        want = READ_BYTES if used else max(READ_BYTES, len(held))
                        rows = []
                        for body in bodies:
                            doc_id, ids = parse(body)
                            raw = ids.tobytes()
                            rows.append((doc_id, start, len(ids), zlib.crc32(raw), raw if with_ids else None))
                            start += len(ids)
                        yield _records(rows)
                if held:
                    raise ValueError(f"{path}: the file ends within a record")

    tasks = max(1, min(READERS, files.count()))
    return files.select("path", "first").coalesce(1).repartition(tasks).mapInArrow(read, RECORDS)


def read_index(files: DataFrame) -> DataFrame:
    """Read the indexes of ``files``: ``(path, offset, size, start, n_tokens)`` for every record."""
    schema = "path string, offset long, size long, start long, n_tokens long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(f"{path}.idx")
                with system.open_input_stream(name, compression=None) as source:
                    while data := source.read(ENTRY.itemsize << 16):
                        found = np.frombuffer(data, ENTRY)
                        columns = [found["offset"], found["size"], found["before"] + np.uint64(first), found["tokens"]]
                        arrays = [pa.array([path] * len(found), pa.string()), *(pa.array(c.astype(np.int64)) for c in columns)]
                        yield pa.RecordBatch.from_arrays(arrays, names=["path", "offset", "size", "start", "n_tokens"])

    tasks = max(1, min(READERS, files.count()))
    return files.select("path", "first").coalesce(1).repartition(tasks).mapInArrow(read, schema)


def read_shuffled(entries: DataFrame, seed: int = 0, with_ids: bool = True) -> DataFrame:
    """Read the records that ``entries`` of ``read_index`` name, in an order drawn from ``seed``.

    Each record is sought by its offset; nothing else of its file is read. The
    order is global: entries, not records, are sorted, by a hash of the seed
    and their place. Returns the columns of ``read_records`` and ``draw``, by
    which the rows of each partition ascend.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256).to_pylist()
                rows = []
                for path in sorted({e["path"] for e in some}):
                    system, name = fs.FileSystem.from_uri(f"{path}.rec")
                    with system.open_input_file(name) as source:
                        for e in sorted((e for e in some if e["path"] == path), key=lambda e: e["offset"]):
                            source.seek(e["offset"])
                            (body,), _ = unframed(source.read(e["size"]))
                            doc_id, ids = parse(body)
                            raw = ids.tobytes()
                            rows.append((e["draw"], (doc_id, e["start"], len(ids), zlib.crc32(raw), raw if with_ids else None)))
                rows.sort(key=lambda row: row[0])
                found = _records([row for _, row in rows])
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array([draw for draw, _ in rows], pa.int64())], names=[*found.schema.names, "draw"])

    drawn = entries.withColumn("draw", F.xxhash64(F.lit(seed), "path", "offset"))
    return drawn.repartitionByRange("draw").sortWithinPartitions("draw").mapInArrow(read, f"{RECORDS}, draw long")


@query()
def op12_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to record files and read back."""
    files = write_records(table(spark, sf_dir, "documents"), new_folder(spark, "records"))
    return read_records(files).select("doc_id", "start", "n_tokens", "ids_crc32")
