"""Every stage of the pipeline on odd rows, and on a table without rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from eventloom.llm.common import new_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, kept boolean, component_id long, h1 int, piece int"
WORDS = [a + b + c for a in "ba co di fu ge hy".split() for b in "la me no pi ru".split() for c in "sa te vi xo zu".split()]


def prose(seed: int, words: int = 120) -> str:
    r = random.Random(seed)
    return ". ".join(" ".join(r.choices(WORDS, k=8)).capitalize() for _ in range(words // 8))


PASSAGE = prose(999, 80)


@pytest.fixture(scope="module")
def folder(spark):
    """A table folder with labels and a benchmark, both with odd rows."""
    path = new_folder(spark, "stages")
    labels = [(k, k % 2, 0) for k in range(20)] + [(None, 1, 0), (3, None, None), (3, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    benchmark = [(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (None, "no id"), (1, "short")]
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(k, prose(k)) for k in range(12)]
    texts += [(3, prose(3)), (100, prose(4)), (None, prose(50)), (None, None), (20, None), (21, ""), (22, " \n\t\n"), (23, "word"), (24, prose(60, 30_000))]
    texts += [(25, f"{prose(61)} {PASSAGE} {prose(62)}"), (26, "=" * 50_000), (5, "another text under the same id")]
    rows = [(k, text, None if k == 7 else "en", None, None, "k", True, 1, 2, 3) for k, text in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows_of(df) -> Counter:
    return Counter((row.doc_id, row.text) for row in df.collect())


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_a_stage_without_rows(spark, folder, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs.limit(0), folder)
    assert got.count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == corpus_pipeline.COLUMNS


def test_quality_rules(spark, folder, docs):
    """Texts with too few words go, also null ones; equal rows share their verdict; a null id is judged like any other."""
    got = corpus_pipeline.quality(spark, docs, folder)
    assert got.columns == corpus_pipeline.COLUMNS
    found, given = rows_of(got), rows_of(docs)
    assert all(found[row] in (0, given[row]) for row in given) and set(found) <= set(given)
    assert not any(len((text or "").split()) < 50 for _, text in found)
    assert found[(3, prose(3))] == 2 and found[(None, prose(50))] == 1


def test_line_dedup(spark, folder, docs):
    """Every row stays; a null text becomes an empty one."""
    got = corpus_pipeline.line_dedup(spark, docs, folder)
    assert got.columns == corpus_pipeline.COLUMNS
    assert Counter(row.doc_id for row in got.collect()) == Counter(row.doc_id for row in docs.collect())
    assert all(row.text is not None and row.n_chars == len(row.text) for row in got.collect())
    assert rows_of(got)[(24, prose(60, 30_000))] == 1


def test_near_duplicates(spark, folder, docs):
    """One document of each group stays; rows without an id, and rows that share an id, are no copies of each other."""
    got = corpus_pipeline.near_dedup(spark, docs, folder)
    assert got.columns == corpus_pipeline.COLUMNS
    given = rows_of(docs)
    assert given - rows_of(got) == Counter({(100, prose(4)): 1})


def test_decontamination(spark, folder, docs):
    """The document that holds the benchmark's passage goes, and no other."""
    got = corpus_pipeline.decontamination(spark, docs, folder)
    assert got.columns == corpus_pipeline.COLUMNS
    lost = rows_of(docs) - rows_of(got)
    assert {doc_id for doc_id, _ in lost} == {25}


def test_packing(spark, folder, docs):
    """Every row is packed, an empty one as its end id alone."""
    got = corpus_pipeline.packing(spark, docs, folder).collect()
    firsts = Counter(row.doc_id for row in got if row.piece == 0)
    assert firsts == Counter(row.doc_id for row in docs.collect())
    assert all(0 < row.length <= 1024 for row in got)
    assert {row.length for row in got if row.doc_id in (20, 21)} == {1}


def test_the_whole_pipeline(spark, folder, docs):
    """The stages one after the other, on odd rows."""
    docs.write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder)
    ids = {row.doc_id for row in got.select("doc_id").distinct().collect()}
    assert not ids & {20, 21, 22, 23, 25, 100} and 3 in ids
