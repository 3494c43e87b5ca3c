"""The pipeline's quality rules learn from every label."""

from __future__ import annotations

import random

import corpus_pipeline
from eventloom.llm.common import new_folder

WORDS = [a + b + c for a in "ba co di fu ge hy".split() for b in "la me no pi ru".split() for c in "sa te vi xo zu".split()]


def test_labels_of_other_documents_change_nothing(spark):
    """All labels fit the bands: 200,000 more, of ids that the documents do not have, leave the kept rows as they are."""
    r = random.Random(31)
    after = {w: r.sample(WORDS, 6) for w in WORDS}

    def text(odd: float) -> str:
        out = [r.choice(WORDS)]
        while len(out) < 120:
            out.append(r.choice(after[out[-1]]))
        return " ".join(w[::-1] if r.random() < odd else w for w in out)

    rows = [(k, text(0.0 if k % 3 else 0.04), "en", "web", 1) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.range(240).selectExpr("id AS doc_id", "int(id % 3 > 0) AS quality", "0 AS toxic")
    more = spark.range(1_000, 201_000).selectExpr("id AS doc_id", "int(id % 2) AS quality", "0 AS toxic")
    kept = []
    for table in (labels, labels.union(more)):
        path = new_folder(spark, "labels")
        table.write.parquet(f"{path}/labels.parquet")
        kept.append({row.doc_id for row in corpus_pipeline.quality(spark, docs, path).collect()})
    assert kept[0] == kept[1], (len(kept[0]), len(kept[1]))
    bad = {k for k in range(240) if k % 3 == 0}
    assert len(kept[0] & bad) < 0.5 * len(bad) and len(kept[0] - bad) > 0.8 * (240 - len(bad))
