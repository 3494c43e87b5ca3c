"""Record files, the prefix trie and importance resampling against plain versions of them."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventloom.llm import importance_resampling, prefix_trie, record_files
from eventloom.llm.common import new_folder, numbered, ranked

DOCS = "doc_id long, text string, rank int, score int, path string, n_tokens int"
ODD = [
    None,
    "",
    " ",
    "a  b\tc\n",
    "don't WE'LL ’s 'S's'T o'clock",
    "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>",
    "a\x0bb\x0cc\x1cd\x85e\xa0f　g",
    "É é e ́ ß ﬁ Ǆ İ Σς",
    "1234 ½ ² _a_b__ a1b2",
    "x" * 5000 + "=" * 3000,
    "中文 字 🙂🙂",
    "`~!@#$%^&*()_+-=[]{}|;:,./<>?",
    "".join(random.Random(2).choices("aB1_'!é É\n\t.,-sS中", k=3000)),
    " ".join(random.Random(3).choices(["one", "two", "three", "FOUR", "5"], k=9000)),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, one row twice, one id with two texts, two rows without an id, and columns with clashing names."""
    rows = [(k, text, 1, 1, "p", 1) for k, text in enumerate(ODD)]
    rows += [(3, ODD[3], 1, 1, "p", 1), (4, "another text", 1, 1, "p", 1), (None, "no id", 1, 1, "p", 1), (None, None, 1, 1, "p", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def plain_rows(odd):
    return [(row.doc_id, row.text or "") for row in odd.collect()]


# Ordering helpers


def test_numbers_go_on_over_partitions(spark):
    """One group holds most rows, many of them equal, so it spans several partitions of the sort."""
    r = random.Random(1)
    rows = [(7, r.choice([None, 1, 2, 3])) for _ in range(3000)] + [(g, r.randrange(50)) for g in range(40) for _ in range(9)]
    table = spark.createDataFrame(rows, "g long, v long").repartition(5)
    got = numbered(table, "g", ["v"], "test-numbered").collect()
    by_group = defaultdict(list)
    for row in got:
        by_group[row.g].append((row.position, row.v))
    assert len(got) == len(rows)
    for group, places in by_group.items():
        places.sort()
        assert [p for p, _ in places] == list(range(1, len(places) + 1))
        assert [v for _, v in places] == sorted((v for g, v in rows if g == group), key=lambda v: (v is not None, v or 0))
    ranks = ranked(table, ["v", "g"], "test-ranked").orderBy("rank").collect()
    assert [row["rank"] for row in ranks] == list(range(1, len(rows) + 1))
    assert [(row.v, row.g) for row in ranks] == sorted(((v, g) for g, v in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


# Prefix trie

TURNS = "conv_id long, turn long, role string, text string, depth int, k1 int"


def plain_trie(built: dict[int, list]) -> list[tuple]:
    nodes = defaultdict(list)
    for conv, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(conv)
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(q != p and q[: len(p)] == p for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(prefix)))
        parent = min(nodes[prefix[:-1]]) if prefix else None
        out.append((min(members), len(prefix), parent, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def plain_openings(rows: list[tuple]) -> dict[int, list]:
    own = defaultdict(list)
    for conv, turn, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


def conversations(r: random.Random) -> list[tuple]:
    rows = []
    for conv in [*range(0, 60), 100, 103, 1000, 2**40]:
        if conv % 10 == 5:
            continue  # some bases are not there
        for turn in range(r.randrange(1, 14)):
            text = r.choice(["", None, "same", "é", f"own {conv}"]) if conv % 3 else f"turn {turn}"
            rows.append((conv, turn or None, r.choice(["user", None]) if conv % 7 == 0 else "user", text, 1, 1))
    return rows + [(None, 1, "user", "in no conversation", 1, 1)]


@pytest.mark.parametrize("block", [4096, 3])
def test_trie_is_that_of_all_prefixes(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = conversations(random.Random(block))
    table = spark.createDataFrame(rows, TURNS).repartition(4)
    turns = prefix_trie.number_turns(table)
    got = prefix_trie.prefix_trie(prefix_trie.share_openings(turns)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_trie(plain_openings(rows)), key=str)


def test_trie_without_openings(spark):
    """The operator alone: copies, proper prefixes, a repeated row, and equal turn numbers in any order of the rows."""
    rows = [(c, t, "user", f"turn {t}", 1, 1) for c in range(1, 9) for t in range(c % 4 + 1)]
    rows += [(20, 0, "user", "twice", 1, 1)] * 2 + [(21, 0, "user", "twice", 1, 1)]
    rows += [(30, 5, "user", "x", 1, 1), (30, 5, "assistant", "y", 1, 1), (31, 5, "assistant", "y", 1, 1), (31, 5, "user", "x", 1, 1)]
    got = prefix_trie.prefix_trie(prefix_trie.number_turns(spark.createDataFrame(rows, TURNS).repartition(3))).collect()
    by_depth = Counter(row.depth for row in got)
    assert by_depth[0] == 1 and len({(row.conv_id, row.depth) for row in got}) == len(got)
    root = next(row for row in got if row.depth == 0)
    assert (root.conv_id, root.parent_conv_id, root.n_convs) == (1, None, 12)
    assert root.n_leaves == sum(1 for row in got if row.n_children == 0)
    twice = {row.depth: row for row in got if row.conv_id == 20}
    assert (twice[1].n_convs, twice[2].n_convs) == (2, 1)
    both = {row.depth: row.n_convs for row in got if row.conv_id == 30}
    assert both == {1: 2, 2: 2}


def test_trie_of_nothing(spark):
    nothing = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(prefix_trie.share_openings(prefix_trie.number_turns(nothing))).count() == 0


def test_trie_of_long_and_empty_texts(spark):
    rows = [(c, t, "user", "é" * 300_000 if t else None, 1, 1) for c in (1, 2) for t in range(3)]
    got = prefix_trie.prefix_trie(prefix_trie.number_turns(spark.createDataFrame(rows, TURNS))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_trie({c: [("user", ""), ("user", "é" * 300_000), ("user", "é" * 300_000)] for c in (1, 2)}), key=str)


def test_trie_sql_has_the_standard_checksum(spark):
    rows = duckdb.sql(
        "SELECT c, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform("
        "string_split(c::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda crc, step: "
        "xor(xor(crc, step) >> 1, CASE WHEN xor(crc, step) & 1 = 1 THEN 3988292384 ELSE 0 END))) FROM range(0, 300, 7) t(c)"
    ).fetchall()
    assert all(zlib.crc32(str(c).encode()) == crc for c, crc in rows)


# Record files


def plain_crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksums_are_crc32c():
    assert plain_crc32c(b"123456789") == 0xE3069283  # the check value of the polynomial
    r = random.Random(3)
    data = r.randbytes(5000)
    parts = [(0, 9), (9, 0), (0, 5000), (17, 64), (17, 65), (100, 63), *((a := r.randrange(4000), r.randrange(5000 - a)) for _ in range(60))]
    starts, sizes = map(np.array, zip(*parts, strict=True))
    got = record_files.checksums(np.frombuffer(data, np.uint8), starts, sizes).tolist()
    assert got == [masked(plain_crc32c(data[a : a + n])) for a, n in parts]
    nothing = record_files.checksums(np.zeros(0, np.uint8), np.array([0, 0]), np.array([0, 0])).tolist()
    assert nothing == [masked(0)] * 2


def test_frames_are_those_of_the_format():
    bodies = [b"", b"a", bytes(range(256)) * 40]
    frames, offsets, sizes = record_files.framed(bodies)
    plain = b"".join(
        len(b).to_bytes(8, "little") + masked(plain_crc32c(len(b).to_bytes(8, "little"))).to_bytes(4, "little") + b + masked(plain_crc32c(b)).to_bytes(4, "little")
        for b in bodies
    )
    assert frames == plain and offsets.tolist() == [0, 16, 33] and sizes.sum() == len(plain)
    assert record_files.unframed(frames) == (bodies, len(frames))
    for at in range(len(frames)):  # any single broken byte is noticed
        if at % 97 == 0 or at < 60:
            broken = bytearray(frames)
            broken[at] ^= 16
            with pytest.raises(ValueError):
                record_files.unframed(bytes(broken))
    with pytest.raises(ValueError):
        record_files.unframed(frames[:-1])


def test_words_are_the_librarys():
    words = record_files.vocabulary(None)
    r = random.Random(4)
    texts = [t or "" for t in ODD] + ["".join(r.choices("aB1_'!é É\n\t.,-sSßÿ", k=r.randrange(200))) for _ in range(300)]
    ids, starts = words.encode(pa.array(texts, pa.large_string()), 1)
    for text, a, z in zip(texts, starts[:-1], starts[1:], strict=True):
        assert ids[a:z].tolist() == [*words.whole.encode(text, add_special_tokens=False).ids, 1]


def test_record_files_round_trip(spark, odd, monkeypatch):
    monkeypatch.setattr(record_files, "TOGETHER", 300)
    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    files = record_files.write_records(odd, new_folder(spark, "records-test"), file_bytes=500)
    assert files.count() > 2
    got = record_files.read_records(files, with_ids=True).orderBy("start").collect()
    rows = plain_rows(odd)
    assert [row.doc_id for row in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    expected = Counter((i, np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows)
    assert Counter((row.doc_id, bytes(row.ids)) for row in got) == expected
    start = 0
    for row in got:
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(row.ids) // 4, zlib.crc32(row.ids))
        start += row.n_tokens
    # By the index, in a drawn order, the same records are found.
    entries = record_files.read_index(files)
    shuffled = record_files.read_shuffled(entries, seed=5)
    assert Counter(tuple(row)[:5] for row in shuffled.collect()) == Counter(map(tuple, got))
    draws = [row.draw for row in shuffled.collect()]
    assert draws == sorted(draws)
    one = entries.where("start > 0").orderBy("start").limit(1)
    assert record_files.read_shuffled(one).first().start == one.first().start


def test_a_long_record_is_read_in_steps(spark, monkeypatch):
    monkeypatch.setattr(record_files, "READ_BYTES", 7)
    table = spark.createDataFrame([(1, "one two three " * 500, 1, 1, "p", 1), (2, "", 1, 1, "p", 1)], DOCS)
    files = record_files.write_records(table, new_folder(spark, "records-long"))
    held = b"".join(open(f"{row.path.removeprefix('file:')}.rec", "rb").read() for row in files.collect())
    assert len(record_files.unframed(held)[0]) == 2
    assert [row.n_tokens for row in record_files.read_records(files).orderBy("doc_id").collect()] == [1501, 1]


def test_broken_files_end_the_job(spark):
    table = spark.createDataFrame([(1, "one two three", 1, 1, "p", 1)], DOCS)
    files = record_files.write_records(table, new_folder(spark, "records-broken"))
    path = f"{files.first().path.removeprefix('file:')}.rec"
    whole = open(path, "rb").read()
    for broken in (whole[:-1], whole[:20] + bytes([whole[20] ^ 1]) + whole[21:]):
        with open(path, "wb") as file:
            file.write(broken)
        crc = path.rpartition("/")
        assert not crc[2].startswith(".")
        with pytest.raises(Exception, match="ends within|differs"):
            record_files.read_records(files).collect()


def test_no_records(spark):
    nothing = spark.createDataFrame([], DOCS)
    files = record_files.write_records(nothing, new_folder(spark, "records-none"))
    assert files.count() == 0 and record_files.read_records(files).count() == 0 and record_files.read_index(files).count() == 0


# Importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text: str) -> tuple[int, list[int]]:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    runs = [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(run.encode()) % 10_000 for run in runs]


@pytest.mark.parametrize("size", [1 << 20, 50])
def test_features_over_slices(monkeypatch, size):
    monkeypatch.setattr(importance_resampling, "SLICE", size)
    for text in ODD:
        n, wanted = plain_features(text or "")
        parts = list(importance_resampling.features((text or "").encode()))
        assert sum(words for words, _ in parts) == n
        assert Counter(np.concatenate([found for _, found in parts]).tolist()) == Counter(wanted)


def plain_draw(rows: list[tuple], texts: list[str], share: tuple[int, int], min_words: int) -> Counter:
    made = [(i, *plain_features(t)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, found in made:
        s.update(found)
    for text in texts:
        t.update(plain_features(text)[1])
    s_all, t_all = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(10_000)]
    out = []
    for i, n, found in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((row for row in out if row[1] >= min_words), key=lambda row: (-row[4], row[0] is None, row[0] or 0))
    for rank, row in enumerate(fit[: len(fit) * share[0] // share[1]], 1):
        row[5] = rank
    return Counter(map(tuple, out))


@pytest.mark.parametrize(("share", "min_words"), [((5, 100), 20), ((1, 2), 1), ((1, 1), 0), ((0, 1), 0)])
def test_draw_is_that_of_a_sort(spark, odd, share, min_words):
    r = random.Random(6)
    pool = ["alpha", "beta", "gamma", "delta", "Éa", "x1"]
    more = [(100 + k, " ".join(r.choices(pool, k=r.randrange(60))), 1, 1, "p", 1) for k in range(200)]
    docs = odd.where("doc_id <> 4 or text <> 'another text'").union(spark.createDataFrame(more, DOCS))
    target = spark.createDataFrame([("alpha beta",), (None,), ("Éa x1 alpha",)], "text string")
    got = importance_resampling.resample(docs, target, share=share, min_words=min_words)
    fields = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    expected = plain_draw([(row.doc_id, row.text or "") for row in docs.collect()], ["alpha beta", "", "Éa x1 alpha"], share, min_words)
    assert Counter(map(tuple, got.select(*fields).collect())) == expected


def test_quickselect_finds_every_place(spark):
    r = random.Random(7)
    keys = sorted({(r.randrange(5), r.randrange(1000)) for _ in range(400)})
    table = spark.createDataFrame(keys, "a long, b long").repartition(3)
    for k in (1, 2, 200, len(keys) - 1, len(keys)):
        assert importance_resampling.quickselect(table, ["a", "b"], k, pivots=3) == keys[k - 1]
    with pytest.raises(ValueError):
        importance_resampling.quickselect(table, ["a", "b"], len(keys) + 1)


def test_draw_from_nothing(spark):
    nothing = spark.createDataFrame([], DOCS)
    assert importance_resampling.resample(nothing, nothing).count() == 0
    docs = spark.createDataFrame([(1, "a b", 1, 1, "p", 1), (2, None, 1, 1, "p", 1)], DOCS)
    got = {row.doc_id: row for row in importance_resampling.resample(docs, nothing, share=(1, 2), min_words=0).collect()}
    assert got[2].n_features == got[2].weight == 0 and got[1].n_features == 3
    assert sorted(row["rank"] or 0 for row in got.values()) == [0, 1]


def test_drawn_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(k, "a b c", 9, 1, "p", 1) for k in range(10)], DOCS)
    drawn = importance_resampling.resample(docs, docs, share=(3, 10), min_words=1)
    found = importance_resampling.drawn_documents(docs, drawn)
    assert sorted(row["rank"] for row in found.collect()) == [1, 2, 3] and set(found.columns) == set(docs.columns)
    assert found.where(F.col("text") == "a b c").count() == 3
