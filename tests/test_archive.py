"""Archived frames as a table and as a stream with a position per watch."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from eventloom.schema import FRAME, RAW_EVENT
from eventloom.sources.archive import archive_frames, read_archive


def frames(spark, *seqs, kind="ADDED"):
    """Frames of ``(watch, seq)``."""
    empty = {name: None for name in RAW_EVENT.names}
    rows = [(watch, seq, kind, tuple((empty | {"uid": f"{watch}-{seq}", "note": "é\n\"x\""})[n] for n in RAW_EVENT.names)) for watch, seq in seqs]
    return spark.createDataFrame(rows, FRAME)


def stream(spark, folder, **options):
    arriving = read_archive(spark, f"{folder}/archive", streaming=True, **options).select("watch", "seq", "object.uid", "object.note")
    query = arriving.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c")
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(tuple(row) for row in spark.read.schema(arriving.schema).parquet(f"{folder}/out").select("watch", "seq").collect())


def test_a_table_of_frames(spark, tmp_path):
    pairs = [("a", k) for k in range(50)] + [("b", -3), ("b", 7)]
    archive_frames(frames(spark, *pairs).repartition(3), f"{tmp_path}/archive", file_rows=8)
    assert len(glob.glob(f"{tmp_path}/archive/frames/*.parquet")) >= 8
    got = read_archive(spark, f"{tmp_path}/archive")
    assert got.schema["object"].dataType == RAW_EVENT
    assert sorted((row.watch, row.seq, row.object.uid) for row in got.collect()) == sorted((w, s, f"{w}-{s}") for w, s in pairs)
    assert got.select("object.note").distinct().collect()[0][0] == 'é\n"x"'


def test_a_task_reads_many_small_files(spark, tmp_path):
    pairs = [(watch, k) for watch in "ab" for k in range(60)]
    archive_frames(frames(spark, *pairs), f"{tmp_path}/archive", file_rows=2)
    assert len(glob.glob(f"{tmp_path}/archive/frames/*.parquet")) >= 60
    got = read_archive(spark, f"{tmp_path}/archive")
    assert got.rdd.getNumPartitions() == 1
    assert sorted((row.watch, row.seq) for row in got.collect()) == pairs
    assert stream(spark, str(tmp_path), positions={"a": 50}) == pairs[51:]


def test_a_stream_goes_on_from_its_positions(spark, tmp_path):
    folder = str(tmp_path)
    archive_frames(frames(spark, ("a", 1), ("a", 2), ("b", 10)), f"{folder}/archive")
    assert stream(spark, folder) == [("a", 1), ("a", 2), ("b", 10)]
    assert stream(spark, folder) == [("a", 1), ("a", 2), ("b", 10)]  # nothing new, nothing twice
    archive_frames(frames(spark, ("a", 3), ("c", 0)), f"{folder}/archive")
    archive_frames(frames(spark, ("b", 11), ("a", 4)), f"{folder}/archive", file_rows=1)
    assert stream(spark, folder) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 10), ("b", 11), ("c", 0)]
    logged = [open(path).read().splitlines()[-1] for path in sorted(glob.glob(f"{folder}/c/offsets/[0-9]*"))]
    assert json.loads(logged[-1]) == {"a": 4, "b": 11, "c": 0}


def test_a_new_stream_starts_behind_positions(spark, tmp_path):
    archive_frames(frames(spark, *[("a", k) for k in range(6)], ("b", 1)), f"{tmp_path}/archive", file_rows=4)
    assert stream(spark, str(tmp_path), positions={"a": 2}) == [("a", 3), ("a", 4), ("a", 5), ("b", 1)]


def test_files_without_an_index_are_not_read(spark, tmp_path):
    """What a failed append leaves behind is not in the index."""
    folder = str(tmp_path)
    broken = frames(spark, *[("a", k) for k in range(20)]).repartition(4).withColumn("frame_type", F.when(F.col("seq") == 19, F.raise_error(F.lit("broken"))).otherwise("ADDED"))
    with pytest.raises(Exception, match="broken"):
        archive_frames(broken, f"{folder}/archive", file_rows=1)
    assert read_archive(spark, f"{folder}/archive").count() == 0
    archive_frames(frames(spark, ("a", 1)), f"{folder}/archive")
    assert stream(spark, folder) == [("a", 1)]


def test_frames_without_a_position_are_refused(spark, tmp_path):
    for pair in ((None, 1), ("a", None)):
        with pytest.raises(Exception, match="no position"):
            archive_frames(frames(spark, pair), f"{tmp_path}/archive")


def test_an_empty_archive(spark, tmp_path):
    assert read_archive(spark, f"{tmp_path}/archive").count() == 0
    archive_frames(frames(spark, ("a", 1)).limit(0), f"{tmp_path}/archive")
    assert read_archive(spark, f"{tmp_path}/archive").count() == 0
