"""Jaccard join, quality rules, decontamination, licence scan and the pipeline against plain versions of them."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import decontamination, jaccard_join, license_scan, quality_rules
from eventloom.llm.catalogue import ORACLES, QUERIES
from eventloom.llm.common import smallest_labels, table

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki") for b in ("la", "me", "ni", "po", "ru", "sta", "ver", "zon")]
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(ids, linked) -> dict:
    least = {i: i for i in ids}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_components(rows, n: int, num: int, den: int) -> tuple[dict, dict]:
    sets = {}
    for i, text in rows:
        w = words((text or "").translate(LOW))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, components(sets, pairs)


def near_copies(seed: int) -> list[tuple[int, str | None]]:
    """Copies, near copies in chains, shared passages, and single and missing words."""
    r = random.Random(seed)
    passage = r.choices(WORDS, k=20)
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE "), (5, "one two"), (6, "one two")]
    for _ in range(6):
        base = r.choices(WORDS, k=r.choice([8, 40, 90]))
        for _ in range(r.choice([1, 3, 25])):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                text[r.randrange(len(text))] = r.choice(WORDS)
            text = r.choice([text, text, passage + text])
            rows.append((len(rows), r.choice([" ", "\t", "\n "]).join(text)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, crowd", [(1, 32), (2, 3), (3, 3)])
@pytest.mark.parametrize("n, num", [(4, 85), (2, 60)])
def test_near_duplicates(spark, monkeypatch, seed, crowd, n, num):
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    rows = near_copies(seed)
    docs = spark.createDataFrame([(i, text, 1, "x", 2) for i, text in rows], "doc_id long, text string, n int, print string, component_id int").repartition(3)
    sizes, parts = plain_components(rows, n, num, 100)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(docs, n, num, 100).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert {i: r.component_id for i, r in got.items()} == parts


def test_near_duplicates_odd_rows(spark):
    schema = "doc_id long, text string"
    long = " ".join(WORDS)
    rows = [(None, long), (1, long), (1, long), (2, long), (3, "other " * 9), (1, "other " * 9)]
    got = [tuple(r) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, schema)).select("doc_id", "component_id").collect()]
    assert Counter(got) == Counter({(None, None): 1, (1, 1): 3, (2, 1): 1, (3, 1): 1})
    assert jaccard_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_overlap_bounds_are_exact():
    for num, den in ((85, 100), (80, 100), (1, 2)):
        for a in range(1, 60):
            for b in range(1, 60):
                least = next(o for o in range(0, a + b + 1) if den * o >= num * (a + b - o))
                assert (((a + b) * num + num + den - 1) // (num + den)) == least


def test_smallest_labels(spark):
    r = random.Random(9)
    chain = [(k, k + 1) for k in range(100, 160)]
    edges = chain + [(r.randrange(40), r.randrange(40)) for _ in range(25)] + [(7, 7)]
    r.shuffle(edges)
    got = {row.id: row.label for row in smallest_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = {i for edge in edges if edge[0] != edge[1] for i in edge}
    assert got == {i: label for i, label in components(ids, [e for e in edges if e[0] != e[1]]).items()}


# --- quality -------------------------------------------------------------------


def plain_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    w = words(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    many = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if many[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choices(WORDS, k=n)).capitalize() + "."


@pytest.fixture(scope="module")
def judged(spark):
    r = random.Random(11)
    rows = [(k, "\n".join(sentence(r, 12) for _ in range(r.randint(5, 30))), "xx", 1) for k in range(240)]
    rows += [(1000 + k, " ".join(f"{w}{r.choice(['###', '%%%', '&&&'])}" for w in r.choices(WORDS, k=200)), "xx", 0) for k in range(40)]
    rows += [(2000, None, "xx", 0), (2001, "", None, 1), (2002, "a b c " * 30, "xx", 0), (2003, "é A\nA\n\n A\nA |", "yy", 1), (None, sentence(r, 60), "xx", 1)]
    rows += [rows[0]]
    docs = spark.createDataFrame([(*row, 1.5, "m") for row in rows], "doc_id long, text string, lang string, good int, score double, _row string")
    labels = docs.where("doc_id % 2 = 0").selectExpr("doc_id", "good AS quality", "0 AS toxic")
    return rows, docs, labels


def test_counts_and_verdict(judged):
    rows, docs, labels = judged
    got = quality_rules.judge(docs, labels).collect()
    assert len(got) == len(rows)
    texts, good = {row[0]: row[1] for row in rows}, {row[0]: row[3] for row in rows}
    for r in got:
        counts = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 2 * counts[4] > counts[0])
        assert not (r.base_failed and r.kept)
    held_out = [r for r in got if r.doc_id is not None and r.doc_id % 2 and not r.base_failed]
    assert sum(r.kept == (good[r.doc_id] == 1) for r in held_out) / len(held_out) > 0.95
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_quality_without_labels_or_rows(judged, spark):
    _, docs, _ = judged
    assert quality_rules.judge(docs).where("kept").count() > 200
    none = spark.createDataFrame([], docs.schema)
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def test_kneser_ney_sums_to_one_and_is_what_the_formula_gives():
    r = random.Random(12)
    grams = np.array(sorted({r.randrange(1, 5) << 12 | r.randrange(1, 5) << 6 | r.randrange(1, 5) for _ in range(50)}))
    counts = np.array([r.randint(1, 6) for _ in grams])
    model = quality_rules.Model(grams, counts)
    table_ = 2 ** model.expand().reshape(1 << 12, 64)
    assert np.allclose(table_.sum(axis=1), 1)
    # One n-gram by the formula: its discounted share, and what its context leaves times the lower order.
    n = [max(1, int((counts == k).sum())) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    cut = np.clip([0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], 0.01, [1, 0.99, 1.99, 2.99])
    gram = grams[7]
    same = grams >> 6 == gram >> 6
    left = sum(cut[min(c, 3)] for c in counts[same]) / counts[same].sum()
    hashes, share, contexts, rest = model.arrays[1]
    lower = 2 ** np.log2(share[hashes == gram & 4095].sum() + rest[contexts == gram >> 6 & 63][0] * _first_order(model)[gram & 63])
    want = (counts[7] - cut[min(counts[7], 3)]) / counts[same].sum() + left * lower
    assert table_.reshape(-1)[gram] == pytest.approx(want)


def _first_order(model) -> np.ndarray:
    hashes, share, _, rest = model.arrays[0]
    out = np.full(64, rest[0] / 64)
    out[hashes] += share
    return out


def test_a_long_text_scores_as_in_one_piece(monkeypatch):
    r = random.Random(13)
    data = np.frombuffer(" ".join(r.choices(WORDS, k=900)).encode(), np.uint8)
    bits = np.random.default_rng(1).random((2, quality_rules.CODES)).astype(np.float32)
    offsets = np.array([0, len(data)])
    whole = quality_rules._scores(data, offsets, bits)
    monkeypatch.setattr(quality_rules, "TOGETHER", 1024)
    assert quality_rules._scores(data, offsets, bits) == pytest.approx(whole)


def test_word_salad_is_rejected(spark):
    r = random.Random(21)
    after = {w: r.sample(WORDS, 8) for w in WORDS}

    def text(n: int) -> list[str]:
        out = [r.choice(WORDS)]
        while len(out) < n:
            out.append(r.choice(after[out[-1]]))
        return out

    rows = [(k, " ".join(text(150)), "xx", 1) for k in range(200)]
    for k in range(60):  # the same words, in no order
        salad = text(150)
        r.shuffle(salad)
        rows.append((1000 + k, " ".join(salad), "xx", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, good int").repartition(3)
    got = quality_rules.judge(docs, docs.where("doc_id % 2 = 0").selectExpr("doc_id", "good AS quality")).collect()
    assert not any(row.base_failed for row in got) and len(got) == len(rows)
    held_out = [row for row in got if row.doc_id % 2]
    good, salad = [row.kept for row in held_out if row.doc_id < 1000], [row.kept for row in held_out if row.doc_id >= 1000]
    assert sum(good) / len(good) > 0.9 and sum(salad) == 0, (sum(good), len(good), sum(salad))


def test_word_scores_leave_a_text_out(spark):
    """Every score against counts made anew from the other texts."""
    r = random.Random(22)
    texts = sorted({" ".join(r.choices(WORDS[:7], k=r.randint(1, 30))) for _ in range(14)})
    rows = spark.createDataFrame([(k, t, "xx") for k, t in enumerate([*texts, texts[3]])], "doc_id long, text string, lang string")
    rows = rows.withColumn("key", F.xxhash64("lang", "text"))
    by_text = {row.key: row.text for row in rows.collect()}
    grams = quality_rules.word_ngrams(rows, quality_rules.fit_models(rows)).cache()

    def counts(some: list[str]) -> list[Counter]:
        three: Counter = Counter()
        for t in some:
            w = ["", "", *t.split()]
            three.update(zip(w, w[1:], w[2:], strict=False))
        two = Counter(g[1:] for g in three)
        return [Counter(g[1:] for g in two), two, three]

    every = counts(texts)
    rules = [quality_rules._discounts([sum(n == k for n in c.values()) for k in (1, 2, 3, 4)]) for c in every]
    got = quality_rules.word_scores(grams).collect()
    assert len(got) == len(texts)
    for row in got:
        found = counts([t for t in texts if t != by_text[row.key]])
        w, bits = ["", "", *by_text[row.key].split()], 0.0
        for at in range(2, len(w)):
            p = 1 / (len(every[0]) + 1)
            for k in (1, 2, 3):
                gram = tuple(w[at - k + 1 : at + 1])
                inside = {g: n for g, n in found[k - 1].items() if g[:-1] == gram[:-1]}
                if inside:
                    cut = {g: rules[k - 1][min(n, 3)] for g, n in inside.items()}
                    p = (inside.get(gram, 0) - cut.get(gram, 0) + sum(cut.values()) * p) / sum(inside.values())
            bits -= math.log2(p)
        assert row.word_score == pytest.approx(bits / (len(w) - 2))


# --- decontamination -------------------------------------------------------------


def test_decontamination(spark):
    r = random.Random(14)
    items = [(k, sentence(r, r.choice([9, 20, 40, 100]))) for k in range(30)] + [(30, None), (31, ""), (3, "again"), (None, "no id at all")]
    texts = dict(items[:30])
    docs, expected = [], set()
    for k in range(300):
        body = r.choices([w + "x" for w in WORDS], k=r.randint(0, 300))
        if k % 3 == 0:
            item = r.randrange(30)
            quoted = words(texts[item] if item != 3 else min(texts[3], "again"))
            if k % 2 and len(quoted) > 15:  # reworded: some words are others
                for at in r.sample(range(len(quoted)), len(quoted) // 8):
                    quoted[at] = r.choice(WORDS) + "y"
            at = r.randint(0, len(body))
            body[at:at] = [q.upper() for q in quoted] if k % 4 == 0 else quoted
            if item != 3:
                expected.add((k, item))
        docs.append((k, " ".join(body)))
    docs += [(400, None), (401, ""), (None, texts[0]), (0, docs[0][1])]
    table_ = spark.createDataFrame([(*d, 0.5, "w") for d in docs], "doc_id long, text string, share double, words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (250, 7):
        got = {(row.doc_id, row.item_id) for row in decontamination.contaminated(table_, bench, block_items=block).collect()}
        assert {pair for pair in got if pair[1] != 3} == expected
    left = decontamination.decontaminate(table_, bench)
    assert left.columns == table_.columns
    held = {doc for doc, _ in got}
    assert Counter(row.doc_id for row in left.collect()) == Counter(d for d, _ in docs if d not in held)
    none = spark.createDataFrame([], table_.schema)
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(table_, spark.createDataFrame([], bench.schema)).count() == 0


def test_every_text_of_the_benchmark_is_searched(spark):
    """Benchmark sets that each number from 0, and texts without an id."""
    r = random.Random(23)
    vocabulary = [a + b for a in WORDS for b in WORDS]
    items = [(k % 4 if k < 12 else None, " ".join(r.choices(vocabulary, k=30))) for k in range(15)]
    docs = []
    for k in range(120):
        body = r.choices(vocabulary, k=120)
        if k < 15:
            body[40:40] = items[k][1].split()
        docs.append((k, " ".join(body)))
    table_ = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, items[5], items[13]], "item_id long, text string")
    for block in (250, 4):
        got = [(row.doc_id, row.item_id) for row in decontamination.contaminated(table_, bench, block_items=block).collect()]
        assert Counter(got) == Counter((k, items[k][0]) for k in range(15))
    assert sorted(row.doc_id for row in decontamination.decontaminate(table_, bench).collect()) == list(range(15, 120))


def test_passages_of_long_items_are_found(spark, monkeypatch):
    """Every document that quotes a passage of an item of 200 to 1000 words; a space of an eighth of the dimensions."""
    monkeypatch.setattr(decontamination.latent_space, "__defaults__", (32,))
    monkeypatch.setattr(decontamination, "BLOCK_PASSAGES", 31, raising=False)
    r = random.Random(24)
    vocabulary = [a + b for a in WORDS for b in WORDS]
    often = [1 / (k + 20) for k in range(len(vocabulary))]
    items = [(k, r.choices(vocabulary, often, k=r.choice([200, 500, 1000, 1000]))) for k in range(20)]
    docs, quoted = [], set()
    for k in range(400):
        body = r.choices(vocabulary, often, k=r.randint(100, 300))
        if k % 2:
            item, text = r.choice(items)
            at = 64 * r.randrange(len(text) // 64)
            place = r.randint(0, len(body))
            body[place:place] = text[at : at + 64]
            quoted.add((k, item))
        docs.append((k, " ".join(body)))
    table_ = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(text)) for k, text in items], "item_id long, text string")
    found = {(row.doc_id, row.item_id) for row in decontamination.contaminated(table_, bench).collect()}
    assert quoted - found == set()


def test_common_subsequence():
    r = random.Random(15)
    for _ in range(200):
        a, b = (np.array(r.choices([-1, 0, 1, 2], k=r.randint(0, 12)), np.int32) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a.tolist():
            new = [0]
            for k, y in enumerate(b.tolist()):
                new.append(row[k] + 1 if x == y != -1 else max(row[k + 1], new[k]))
            row = new
        assert decontamination.common_subsequence(a, b) == row[-1]


# --- licences --------------------------------------------------------------------


def plain_matches(files: dict[str, str]) -> dict[str, tuple[str, float, bool]]:
    """The best licence of each file by comparing every window with every template."""
    find = lambda text: re.findall(license_scan.WORD, text.lower())
    terms = {t for _, text in license_scan.TEMPLATES for t in find(text)}
    lines = [line for text in files.values() for line in text.split("\n")]
    df = Counter(t for line in lines for t in terms & set(find(line)))
    idf = defaultdict(lambda: math.log(1 + len(lines)) + 1, {t: math.log((1 + len(lines)) / (1 + df[t])) + 1 for t in terms})

    def vector(w):
        return {t: k * idf[t] for t, k in Counter(w).items()}

    out = {}
    for path, text in files.items():
        best, size = None, 0
        for line in text.split("\n"):
            w, found = find(line), []
            for licence, template in license_scan.TEMPLATES:
                t = vector(find(template))
                n = len(find(template))
                for at in range(max(0, len(w) - n) + 1):
                    v = vector(w[at : at + n])
                    length = math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in t.values()))
                    score = round(sum(x * t.get(k, 0) for k, x in v.items()) / length, 6) if length else 0.0
                    if score >= license_scan.NEAR:
                        found.append((-score, licence, -n))
            if found:
                top = min(found)
                size -= top[2]
                best = min(best or top, top)
        if best:
            name = path.rsplit("/", 1)[-1]
            whole = bool(re.match(license_scan.LICENCE_NAME, name)) or size >= license_scan.WHOLE * len(find(text))
            out[path] = (best[1], -best[0], whole)
    return out


def test_license_scan(spark):
    r = random.Random(16)
    statements = [text for _, text in license_scan.TEMPLATES] + ["licensed UNDER the apache license", "license", "free software", "All rights"]
    files = {"LICENSE": "", "a/LICENSE.txt": "Released under the MIT License.", "a/b/c/COPYING": "x\n# Licensed under the Apache License, Version 2.0.", "z": ""}
    for k in range(60):
        lines = [sentence(r, r.randint(1, 9)) for _ in range(r.randint(0, 5))]
        if r.random() < 0.5:
            lines.insert(r.randint(0, len(lines)), r.choice(["", "// ", "see also: "]) + r.choice(statements) + r.choice(["", " etc"]))
        files[r.choice(["", "a/", "a/b/", "a/b/c/d/", "e/f/"]) + f"f{k}"] = "\n".join(lines)
    rows = [(path, text or None, 1, "x") for path, text in files.items()] + [(None, "All rights reserved.", 1, "x"), ("z", None, 1, "x")]
    got = {row.path: row for row in license_scan.scan(spark.createDataFrame(rows, "path string, text string, score int, folder string")).collect()}
    assert set(got) == set(files)
    stated = plain_matches(files)
    holders = {}
    for path, (licence, score, whole) in stated.items():
        if whole:
            folder = path.rpartition("/")[0]
            holders[folder] = min(holders.get(folder, (0, "")), (-score, licence)) if folder in holders else (-score, licence)
    for path, row in got.items():
        if path in stated:
            licence, score, whole = stated[path]
            assert (row.licence, row.origin, row.inherited_from) == (licence, "file" if whole else "header", None)
            assert row.score == pytest.approx(score, abs=2e-6)
            continue
        folder = path.rpartition("/")[0]
        while folder not in holders and folder:
            folder = folder.rpartition("/")[0]
        assert (row.licence, row.inherited_from) == ((holders[folder][1], folder) if folder in holders else (None, None))
    assert license_scan.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_license_scan_runs_no_python(spark):
    plan = QUERIES["op5_license_scans"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


# --- queries and pipeline ----------------------------------------------------------


def test_line_dedup_query_equals_its_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = connection.execute(ORACLES["op6_line_dedup"])
    names = [c[0] for c in found.description]
    rows = QUERIES["op6_line_dedup"](spark, SF).select(*names).collect()
    assert Counter(map(tuple, rows)) == Counter(found.fetchall())


def test_pipeline(spark):
    docs = table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "best_fit_packing"]
    good = stages["quality_rules"](spark, docs, SF)
    judged_ = quality_rules.judge(docs, table(spark, SF, "labels")).where("kept")
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in judged_.collect()}
    lines = stages["line_dedup"](spark, good, SF)
    assert lines.columns == corpus_pipeline.COLUMNS
    single = stages["ngram_jaccard"](spark, lines, SF)
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    _, parts = plain_components(rows, 5, 80, 100)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, part in parts.items() if i == part)
    clean = stages["decontamination"](spark, single, SF)
    held = {r.doc_id for r in decontamination.contaminated(single, table(spark, SF, "benchmark")).collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in single.collect() if r.doc_id not in held)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}
    used = defaultdict(int)
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024 and len(used) <= 1.05 * sum(used.values()) / 1024 + 1


def test_no_stage_crosses_all_pairs(spark):
    docs = spark.createDataFrame([(k, sentence(random.Random(k), 30), "a", "b", 1) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    found = jaccard_join.near_duplicates(docs)
    assert not re.search("CartesianProduct|NestedLoop", found._jdf.queryExecution().executedPlan().toString())
    assert found.where(F.col("component_id") != F.col("doc_id")).count() == 0


def test_equal_texts_merge_before_their_ngrams(spark):
    """Equal texts meet as texts: no n-gram is shuffled to find that another text is the same one."""
    rows = quality_rules._with_key(
        spark.createDataFrame([(1, "x", "a b a b"), (2, "x", "a b a b"), (None, "x", "a b a b"), (3, "y", "a b a b"), (4, "x", "")], "doc_id long, lang string, text string")
    )
    grams = quality_rules.word_ngrams(rows, quality_rules.fit_models(rows))
    plan = grams._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")]
    found = grams.collect()
    assert len(found) == len({(r["key"], r["a"], r["b"], r["c"]) for r in found}) == 8  # four in each of two languages' texts
    assert sum(r["own"] for r in found) == 8


def test_no_ngram_of_words_is_a_row(spark, monkeypatch):
    """Texts meet the counts of their n-grams as arrays: what is written has far fewer rows than there are n-grams."""
    r = random.Random(7)
    docs = spark.createDataFrame([(k, " ".join(r.choices(WORDS, k=200)), "xx") for k in range(60)], "doc_id long, text string, lang string").repartition(2)
    written, keep = [], quality_rules.keep
    monkeypatch.setattr(quality_rules, "keep", lambda df, name: written.append(keep(df, name)) or written[-1])
    assert quality_rules.judge(docs).count() == 60
    assert len(written) > 2 and sum(df.count() for df in written) < 60 * 200 / 10


def test_common_words_are_dealt_out(spark, monkeypatch):
    """The scores are the same when the n-grams around a common word go to several shards."""
    r = random.Random(8)
    texts = [" ".join(w for k in range(r.randint(1, 60)) for w in ("the", r.choice(WORDS))) for _ in range(50)]
    rows = quality_rules._with_key(spark.createDataFrame([(k, "xy"[k % 2], t) for k, t in enumerate(texts)], "doc_id long, lang string, text string")).repartition(3)
    grams = quality_rules.word_ngrams(rows, quality_rules.fit_models(rows)).cache()
    whole = dict(quality_rules.word_scores(grams).collect())
    monkeypatch.setattr(quality_rules, "HOT_ROWS", 40)
    monkeypatch.setattr(quality_rules, "SHARD_ROWS", 200)
    assert dict(quality_rules.word_scores(grams).collect()) == pytest.approx(whole) and len(whole) == len(set(texts))
