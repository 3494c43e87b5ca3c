"""What the steps of the word model hold at once, and that the cuts between them change nothing."""

from __future__ import annotations

import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from eventloom.llm import common, quality_rules

NO_HOT = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


@pytest.fixture(scope="module")
def rows() -> pa.Table:
    """Half a million different n-grams of words, as of 2,000 texts in two languages."""
    r = np.random.default_rng(5)
    n = 1 << 19
    c = (r.zipf(1.3, n) % 100_000).astype(np.int64) * 0x9E3779B97F4A7C1
    b, a = np.concatenate(([0], c[:-1])), np.concatenate(([0, 0], c[:-2]))
    key = np.sort(r.integers(0, 2_000, n))
    names = pa.array(["xx", "yy"])
    tongue = pa.DictionaryArray.from_arrays(pa.array((key % 2).astype(np.int32)), names).cast(pa.string())
    return pa.table({"key": key, "tongue": tongue, "a": a, "b": b, "c": c, "own": np.ones(n, np.int64)})


def peak(work) -> float:
    """The most bytes a step holds beyond what it was given, in bytes a row."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / (1 << 19)
    finally:
        tracemalloc.stop()


def test_steps_hold_few_bytes_a_row(rows):
    held = {"pack": peak(lambda: quality_rules._pack(0, rows))}
    blob = quality_rules._pack(0, rows).column("blob")[0].as_py()

    def ask(shards: int) -> list:
        return [(quality_rules.ASK, 0, asked) for _, asked in quality_rules.Pack(blob).deal(NO_HOT, shards).asks(0, 1)]

    held["ask"] = peak(lambda: ask(16))
    asks = ask(1)
    held["count"] = peak(lambda: sum(len(m[3]) for m in quality_rules._count_shard(asks, 1)))
    assert held["pack"] <= 50 and held["ask"] <= 100 and held["count"] <= 95, held


def test_packs_hold_no_more_than_their_rows(rows, monkeypatch):
    """A large batch is cut between texts, a text never; all rows come back in order."""
    monkeypatch.setattr(quality_rules, "PACK_ROWS", 10_000)
    monkeypatch.setattr(quality_rules, "TaskContext", type("Task", (), {"get": classmethod(lambda cls: cls), "partitionId": classmethod(lambda cls: 3)}))
    few = rows.slice(0, 100_000)
    long_ = few.set_column(0, "key", pa.array(np.where(np.arange(100_000) // 25_000 == 1, -1, few.column("key").to_numpy())))
    for table in (few, long_):
        packs = [p for p in quality_rules._packs(iter(table.to_batches(max_chunksize=40_000)))]
        sizes = [p.column("n")[0].as_py() for p in packs]
        assert sum(sizes) == 100_000 and len({p.column("pack")[0].as_py() for p in packs}) == len(packs)
        read = [quality_rules.Pack(p.column("blob")[0].as_py()) for p in packs]
        assert np.array_equal(np.concatenate([np.repeat(p.keys, p.sizes) for p in read]), table.column("key").to_numpy())
        assert np.array_equal(np.concatenate([p.words[p.c] for p in read]).view(np.int64), table.column("c").to_numpy())
        assert max(sizes) <= 10_000 or table is long_ and sorted(sizes)[-2] <= 10_000


def test_numbers_keep_their_values():
    some = [np.array([], np.int64), np.arange(5), np.array([0, 1 << 24]), np.array([(1 << 31) - 1, 1 << 31]), np.array([1 << 62])]
    blob = quality_rules._dump(*some)
    for got in (quality_rules._load(blob), [quality_rules._load(blob, k, k + 1)[0] for k in range(len(some))]):
        assert [x.tolist() for x in got] == [x.tolist() for x in some]
    assert [x.tolist() for x in quality_rules._load(blob, 3)] == [x.tolist() for x in some[3:]]
    assert [x.tolist() for x in map(quality_rules._narrow, some)] == [x.tolist() for x in some]


def test_jobs_one_after_the_other_change_no_score(spark, monkeypatch):
    """The scores with one job and with four, small messages, and texts that are scored in several parts."""
    r = random.Random(9)
    words = [a + b for a in "bcdfgh" for b in "aeiou"]
    docs = spark.createDataFrame([(k, " ".join(r.choices(words, k=r.randint(1, 90))), "xy"[k % 2]) for k in range(80)], "doc_id long, text string, lang string")
    docs = docs.repartition(3)
    whole = {row.doc_id: row.word_score for row in quality_rules.judge(docs).collect()}
    for name, value in {"PACK_ROWS": 300, "SHARD_ROWS": 150, "HOT_ROWS": 60, "SCORED": 50, "SENT": 200, "GROUP": 400}.items():
        monkeypatch.setattr(quality_rules, name, value)
    assert {row.doc_id: row.word_score for row in quality_rules.judge(docs).collect()} == pytest.approx(whole)


def test_packs_are_scored_some_at_a_time(spark, monkeypatch):
    """No job moves all the packs: what one has shuffled is gone before the next."""
    r = random.Random(10)
    words = [a + b for a in "bcdfgh" for b in "aeiou"]
    docs = spark.createDataFrame([(k, " ".join(r.choices(words, k=60)), "x") for k in range(120)], "doc_id long, text string, lang string")
    monkeypatch.setattr(quality_rules, "PACK_ROWS", 100)
    monkeypatch.setattr(quality_rules, "SHARD_ROWS", 400)
    moved, delivered = [], quality_rules._delivered

    def told(messages, places):
        moved.append(messages.where(f"kind = {quality_rules.TEXTS}").count())
        return delivered(messages, places)

    monkeypatch.setattr(quality_rules, "_delivered", told)
    assert quality_rules.judge(docs).where("word_score is null").count() == 0
    assert 0 < max(moved) < 0.6 * sum(moved), moved


def test_keep_good_leaves_one_table(spark, monkeypatch):
    """What only led to the verdict is deleted; the rows can still be read, and read again."""
    r = random.Random(11)
    words = [a + b for a in "bcdfgh" for b in "aeiou"]
    docs = spark.createDataFrame([(k, " ".join(r.choices(words, k=60)), "x") for k in range(40)], "doc_id long, text string, lang string")
    folders, new_folder = [], common.new_folder
    monkeypatch.setattr(common, "new_folder", lambda spark, name: folders.append(new_folder(spark, name)) or folders[-1])
    good = quality_rules.keep_good(docs, docs.selectExpr("doc_id", "1 AS quality"))
    assert good.count() == good.count() > 0 and good.columns == docs.columns
    left = [folder for folder in folders if Path(re.sub("^file:/*", "/", folder)).exists()]
    assert len(folders) > 5 and len(left) == 1 and "quality-kept" in left[0], left
