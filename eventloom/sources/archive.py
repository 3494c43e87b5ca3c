"""An archive of watch frames, and a stream of it whose offset is a position per watch.

Frames are archived in Parquet files of one watch and ascending ``seq`` each,
and every append lists its files in an index that appears as a whole once they
are written. So a reader never meets the files of a task that failed.

As a stream, the offset is the last ``seq`` of each watch. Spark keeps it in
the query's offset log, so a restart reads on right behind what was committed,
watch by watch, and a micro-batch that is run again reads the same frames.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from eventloom.schema import RAW_EVENT

FORMAT = "frame_archive"
#: Frames of a file at most.
FILE_ROWS = 500_000
#: Frames that one task of a reader takes from small files.
READ_ROWS = 200_000
_SCHEMA = "watch string, seq long, frame_type string, object string"
_INDEX = "path string, watch string, first long, last long, frames long"


def archive_frames(frames: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> None:
    """Append frames ``watch, seq, frame_type, object`` to an archive.

    Frames are sorted by watch and ``seq`` over all partitions, so a watch with
    most of them is written by several tasks. For streams, the frames of a
    watch have to follow those archived before; a frame without a watch or
    ``seq`` has no position and is refused.
    """
    spark = frames.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/frames")
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(f"{folder}/frames" if "://" in folder or folder.startswith("file:") else f"file://{folder}/frames")
        open_file, done = None, []

        def close() -> None:
            open_file["writer"].close()
            done.append((open_file["name"], open_file["watch"], open_file["first"], open_file["last"], open_file["rows"]))

        for batch in batches:
            watches = batch.column("watch").dictionary_encode().indices.to_numpy()
            borders = [0, *(np.flatnonzero(watches[1:] != watches[:-1]) + 1).tolist(), batch.num_rows]
            for at, stop in zip(borders, borders[1:]):
                watch = batch.column("watch")[at].as_py() if stop > at else None
                while at < stop:
                    if open_file and (open_file["watch"] != watch or open_file["rows"] >= file_rows):
                        close()
                        open_file = None
                    part = batch.slice(at, min(stop - at, file_rows - (open_file["rows"] if open_file else 0)))
                    part = part.select(["seq", "frame_type", "object"])
                    if open_file is None:
                        name = f"{uuid.uuid4().hex}.parquet"
                        writer = pq.ParquetWriter(f"{base}/{name}", part.schema, filesystem=system, compression="zstd")
                        open_file = {"name": name, "watch": watch, "first": part["seq"][0].as_py(), "rows": 0, "writer": writer}
                    open_file["writer"].write_batch(part)
                    open_file["rows"] += part.num_rows
                    open_file["last"] = part["seq"][-1].as_py()
                    at += part.num_rows
        if open_file:
            close()
        names, kinds = ["path", "watch", "first", "last", "frames"], [pa.string(), pa.string(), *[pa.int64()] * 3]
        columns = [list(column) for column in zip(*done)] or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    checked = F.when(F.col("watch").isNull() | F.col("seq").isNull(), F.raise_error(F.lit("a frame without watch or seq has no position")))
    lines = frames.select(
        F.coalesce("watch", checked.cast("string")).alias("watch"),
        F.coalesce(F.col("seq").cast("bigint"), checked.cast("bigint")).alias("seq"),
        "frame_type",
        "object",
    )
    # Sorting samples the rows first, so their text is made behind it, once.
    in_order = lines.repartitionByRange("watch", "seq").sortWithinPartitions("watch", "seq").withColumn("object", F.to_json("object"))
    in_order.mapInArrow(write, _INDEX).write.json(f"{folder}/index/{uuid.uuid4().hex}")


@dataclass
class FilePart:
    """The frames of a file after one position and up to another."""

    path: str
    watch: str
    after: int | None
    until: int | None


@dataclass
class FileParts(InputPartition):
    """What one task reads, file by file."""

    parts: list[FilePart]


def _grouped(found: list[tuple[int, FilePart]]) -> list[FileParts]:
    """Put small files together, so that the tasks grow with the frames and not with the files."""
    groups: list[FileParts] = []
    room = 0
    for rows, part in found:
        if not groups or rows > room:
            groups.append(FileParts([]))
            room = READ_ROWS
        groups[-1].parts.append(part)
        room -= rows
    return groups


def _frames(file: dict) -> int:
    return file.get("frames", READ_ROWS)  # an older index does not say


class _Index:
    """The files of an archive, read append by append as they come."""

    def __init__(self, folder: str) -> None:
        self.system, self.base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        self.known: dict[str, list[dict]] = {}

    def files(self) -> list[dict]:
        found = self.system.get_file_info(fs.FileSelector(f"{self.base}/index", allow_not_found=True))
        for info in found:
            if info.path in self.known or self.system.get_file_info(f"{info.path}/_SUCCESS").type == fs.FileType.NotFound:
                continue
            rows = []
            for part in self.system.get_file_info(fs.FileSelector(info.path)):
                if part.base_name.startswith("part-"):
                    with self.system.open_input_stream(part.path) as source:
                        rows += [json.loads(line) for line in source.read().decode().splitlines()]
            self.known[info.path] = rows
        return [row for rows in self.known.values() for row in rows]


def _read(options: dict, partition: FileParts) -> Iterator[pa.RecordBatch]:
    index = _Index(options["path"])
    for part in partition.parts:
        with index.system.open_input_file(f"{index.base}/frames/{part.path}") as source:
            for batch in pq.ParquetFile(source).iter_batches():
                keep = pa.array([True] * batch.num_rows)
                if part.after is not None:
                    keep = pc.and_(keep, pc.greater(batch["seq"], part.after))
                if part.until is not None:
                    keep = pc.and_(keep, pc.less_equal(batch["seq"], part.until))
                kept = batch.filter(keep)
                watch = pa.array([part.watch] * kept.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([watch, *kept.columns], names=["watch", *kept.schema.names])


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[FileParts]:
        return _grouped([(_frames(f), FilePart(f["path"], f["watch"], None, None)) for f in _Index(self.options["path"]).files()])

    def read(self, partition: FileParts | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else _read(self.options, partition)


class ArchiveStreamReader(DataSourceStreamReader):
    """Offsets are ``{watch: last seq}``; a watch that is not in one starts with its first frame."""

    def __init__(self, options: dict) -> None:
        self.options, self.index = options, _Index(options["path"])

    def initialOffset(self) -> dict:
        return json.loads(self.options.get("positions", "{}"))

    def latestOffset(self) -> dict:
        positions = self.initialOffset()
        for file in self.index.files():
            positions[file["watch"]] = max(file["last"], positions.get(file["watch"], file["last"]))
        return positions

    def partitions(self, start: dict, end: dict) -> list[FileParts]:
        found = [
            (_frames(f), FilePart(f["path"], f["watch"], start.get(f["watch"]), end[f["watch"]]))
            for f in self.index.files()
            if f["watch"] in end and f["first"] <= end[f["watch"]] and f["last"] > start.get(f["watch"], f["last"] - 1)
        ]
        return _grouped(found)

    def read(self, partition: FileParts) -> Iterator[pa.RecordBatch]:
        return _read(self.options, partition)

    def commit(self, end: dict) -> None:
        pass


class FrameArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def streamReader(self, schema: T.StructType) -> ArchiveStreamReader:
        return ArchiveStreamReader(dict(self.options))


def read_archive(spark: SparkSession, folder: str, streaming: bool = False, positions: dict[str, int] | None = None) -> DataFrame:
    """Read an archive as frames ``watch, seq, frame_type, object``.

    A new stream starts behind ``positions``, the last ``seq`` seen of each
    watch; one that goes on starts where its checkpoint says.
    """
    spark.dataSource.register(FrameArchive)
    reader = (spark.readStream if streaming else spark.read).format(FORMAT)
    lines = reader.option("positions", json.dumps(positions or {})).load(folder)
    return lines.withColumn("object", F.from_json("object", RAW_EVENT))
