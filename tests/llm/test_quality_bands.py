"""The bands of the quality rules, against a plain fit over all labelled documents."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import quality_rules


def plain_cut(good: np.ndarray, bad: np.ndarray, usual: float) -> float:
    if len(good) < quality_rules.LABELLED_LEAST or len(bad) < quality_rules.LABELLED_LEAST:
        return usual
    good, bad = np.sort(good), np.sort(bad)
    values = np.unique(np.concatenate((good, bad)))
    cuts = np.append((values[:-1] + values[1:]) / 2, max(values[-1], usual))
    cuts = cuts[cuts > np.median(good)]
    lost = (len(good) - np.searchsorted(good, cuts, "right")) / len(good) * quality_rules.GOOD_WEIGHT
    lost += np.searchsorted(bad, cuts, "right") / len(bad)
    return float(cuts[lost <= lost.min() + 1e-12].mean()) if len(cuts) else usual


def plain_bands(rows: list, known: dict[int, int], least: float) -> dict[str, tuple[float, float]]:
    out = {}
    for lang in {r.lang for r in rows}:
        scores = np.array([r.score for r in rows if r.lang == lang])
        middle = np.sort(scores)[(len(scores) - 1) // 2]
        deviation = max(np.sort(np.abs(scores - middle))[(len(scores) - 1) // 2], 1e-6)
        pairs = [(known[r.doc_id], r.score - middle) for r in rows if r.lang == lang and r.doc_id in known]
        good, bad = (np.array([s for q, s in pairs if (q > 0) == kind]) for kind in (True, False))
        high = plain_cut(good, bad[bad > 0], quality_rules.USUAL * deviation)
        out[lang] = (middle - plain_cut(-good, -bad[bad <= 0], least * deviation), middle + high)
    return out


def check(got, want: dict[str, tuple[float, float]], tolerance: float) -> None:
    found = {r.lang: (r.low, r.high) for r in got.collect()}
    assert found.keys() == want.keys()
    for lang, ends in want.items():
        assert found[lang] == pytest.approx(ends, rel=tolerance), lang


def test_all_labelled_documents_fit_the_bands(spark):
    """70,000 labelled documents; the bad ones beyond the middle lie so that any left out moves an end."""
    noise = (F.xxhash64("id") % 1_000_000) / 1_000_000.0
    rows = spark.range(70_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 10 < 7, "xx").otherwise("yy").alias("lang"),
        F.when(F.col("id") % 2 == 0, noise).otherwise(3 * noise).alias("score"),
        F.lit(False).alias("base_failed"),
    )
    labels = rows.selectExpr("doc_id", "int(doc_id % 2 = 0) AS quality")
    local = rows.collect()
    # The middle is that of a sketch, so the plain fit is asked around the same one.
    middles = {r.lang: r.m for r in rows.groupBy("lang").agg(F.percentile_approx("score", 0.5, 10_000).alias("m")).collect()}
    got = {r.lang: (r.low, r.high) for r in quality_rules.bands(rows, labels).collect()}
    for lang, middle in middles.items():
        away = np.array([r.score - middle for r in local if r.lang == lang])
        is_good = np.array([r.doc_id % 2 == 0 for r in local if r.lang == lang])
        good, bad = away[is_good], away[~is_good]
        want = middle - plain_cut(-good, -bad[bad <= 0], 1.0), middle + plain_cut(good, bad[bad > 0], 1.0)
        assert got[lang] == pytest.approx(want, rel=1e-9), lang


@pytest.mark.parametrize("seed", [1, 2])
def test_bands_on_odd_rows(spark, seed):
    """Equal scores, an empty language, one with too few labels, null and repeated ids, labels without a quality."""
    r = np.random.default_rng(seed)
    rows = [(k, ["", "xx", "yy"][k % 3], float(np.round(r.normal(0.0 if k % 5 else 4.0), 1)), False) for k in range(600)]
    rows += [(5, "xx", 0.5, False), (None, "xx", 0.25, False), (700, "few", 1.0, False), (701, "few", 2.0, False), (702, "xx", 99.0, True), (703, "xx", None, False)]
    measured = spark.createDataFrame(rows, "doc_id long, lang string, score double, base_failed boolean").repartition(5)
    quality = [(k, int(k % 5 > 0)) for k in range(550)] + [(4, 0), (4, 1), (None, 1), (10, None), (700, 0), (702, 0), (9_999, 1)]
    labels = spark.createDataFrame(quality, "doc_id long, quality int")
    known: dict[int, int] = {}
    for k, q in quality:
        if k is not None and q is not None:
            known[k] = min(q, known.get(k, q))
    passed = [row for row in measured.collect() if not row.base_failed and row.score is not None]
    for least in (quality_rules.USUAL, float("inf")):
        check(quality_rules.bands(measured, labels, "score", least), plain_bands(passed, known, least), 1e-9)
        check(quality_rules.bands(measured, None, "score", least), plain_bands(passed, {}, least), 1e-9)
    assert quality_rules.bands(measured.limit(0), labels).count() == 0
