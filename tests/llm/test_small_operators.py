"""Token counts, packing, chat formatting, WARC, line dedup and extraction against plain versions of them."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventloom.llm import chat_format, html_extraction, line_dedup, packing, token_counts, warc
from eventloom.llm.common import new_folder
from eventloom.llm.labelled_pages import labelled_pages

DOCS = "doc_id long, text string, n_tokens int, kept_text string, block int"
ODD = [
    None,
    "",
    " ",
    "a",
    "  two  spaces ",
    "tab\tand\nline\n\n",
    "</s><0x0A> <|endoftext|> x",
    "don't we'll 's 'S",
    "a　b 中文 é\x85",
    "=" * 3000 + "x" * 700,
    "".join(random.Random(1).choices("etaoin ", k=5000)),
    "".join(random.Random(2).choices("ab \n1é中!'\x1c", k=3000)),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, one of them twice and one without an id, and columns whose names clash with the operators' own."""
    rows = [(k, text, k, "x", 1) for k, text in enumerate(ODD)] + [(3, "a", 3, "x", 1), (None, "no id", 0, "x", 1)]
    return spark.createDataFrame(rows, DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def test_token_counts_are_the_librarys(spark, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    rows = token_counts.count_tokens(odd, limit=100).collect()
    assert len(rows) == odd.count()
    texts = dict(enumerate(ODD)) | {None: "no id"}
    for row in rows:
        text = texts[row.doc_id] or ""
        assert (row.n_bytes, row.n_tokens) == (len(text.encode()), len(library.encode(text)))
        assert row.over_limit == (row.n_tokens > 100)
    assert token_counts.count_tokens(none(spark)).count() == 0


def test_transducer_over_pieces_and_chunks(monkeypatch):
    """A text that is taken in pieces and chunks whose start is not foretold counts as in one go."""
    machine = token_counts.transducer()
    library = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    texts = ["a" * 5000, "ab" * 2000, *(t for t in ODD if t)]
    monkeypatch.setattr(token_counts, "CHUNK", 16)
    monkeypatch.setattr(token_counts, "LOOK_BACK", 2)
    monkeypatch.setattr(token_counts, "PIECE", 100)
    assert machine.count(texts).tolist() == [len(library.encode(t)) for t in texts]


def test_packing(spark, odd):
    whole = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    room = 64
    rows = packing.pack_documents(odd, room, with_ids=True).collect()
    pieces = defaultdict(list)
    for row in rows:
        assert zlib.crc32(row.ids) == row.ids_crc32 and len(row.ids) == 4 * row.length <= 4 * room
        pieces[row.doc_id, row.piece].append(row)
    for k, text in [*enumerate(ODD), (None, "no id")]:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        mine = sorted((r for (doc, _), rs in pieces.items() if doc == k for r in rs[:1]), key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in mine) == ids
        assert [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist()
        assert all(r.length == room for r in mine[1:]) and (len(mine) == 1) == (len(ids) <= 4 * room)
    assert len(pieces[3, 0]) == 2
    filled = defaultdict(list)
    for row in rows:
        filled[row.sequence_id].append((row.offset, row.length))
    for places in filled.values():
        assert sum(n for _, n in places) <= room
        assert [at for at, _ in sorted(places)] == np.cumsum([0, *(n for _, n in sorted(places))])[:-1].tolist()
    assert len(filled) <= -(-sum(r.length for r in rows) // room) + 1
    assert packing.pack_documents(none(spark), room).count() == 0


def test_plan_packs_every_piece():
    r = random.Random(4)
    for _ in range(30):
        counts = np.array([0, *(r.choice([0, 0, 1, 5, 1000]) for _ in range(50))])
        used = Counter()
        for lengths, times in packing.plan(counts, 50):
            assert 0 < sum(lengths) <= 50 and times > 0
            used.update({n: k * times for n, k in Counter(lengths).items()})
        assert used == Counter({n: int(k) for n, k in enumerate(counts) if k})


def test_best_two_fit_replaces_the_smallest():
    """6 and 3 leave a gap of 1; the 3 gives way to two pieces that fill 4."""
    counts = np.bincount([6, 3, 2, 2], minlength=11)
    assert sorted(packing.plan(counts, 10)[0][0]) == [2, 2, 6]


CONVERSATIONS = "conv_id long, turn long, role string, text string, block int, segment string"


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK", 2)
    r = random.Random(5)
    rows = []
    for conv in [0, 1, 2, None]:
        for turn in range(r.choice([1, 7])):
            text = r.choice([None, "", chat_format.TRAP, "".join(r.choices("\\#<:/turn>\n é", k=30))])
            rows.append((conv, turn, r.choice(["user", "assistant", None, "a: </turn>\\#"]), text, 1, "x"))
    rows += [(3, None, "assistant", "null turn", 1, "x"), (3, 0, "assistant", "same", 1, "x"), (3, 0, "assistant", "same", 1, "x")]
    rows += [(4, t, "assistant" if t % 2 else "user", f"turn {t}", 1, "x") for t in range(200)]
    stream = chat_format.format_turns(spark.createDataFrame(rows, CONVERSATIONS))
    examples = chat_format.expand_examples(stream)
    got = {row.conv_id: row for row in chat_format.read_back(stream, examples).collect()}
    by_conv = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by_conv[conv].append((turn is not None, turn, role or "", text or ""))
    assert set(got) == set(by_conv)
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for *_, role, text in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    texts = chat_format.example_texts(stream, examples).where("conv_id = 4").collect()
    assert len(texts) == 100
    for row in texts:
        assert row.text[row.loss_start : row.loss_end] == f"turn {row.position}" and row.text.count("###") == row.position + 1
    nothing = chat_format.format_turns(spark.createDataFrame([], CONVERSATIONS))
    assert chat_format.read_back(nothing, chat_format.expand_examples(nothing)).count() == 0


PAGES = "page_id long, url string, html string, size int, digest string"


def test_warc_round_trip(spark):
    same = "<p>é</p>" * 50
    rows = [(k, f"http://x/{k}", text, 1, "d") for k, text in enumerate([same, None, "", same, "a\r\n\r\nb", same, "x" * 300_000])]
    rows += [(None, None, same, 1, "d"), (4, "http://x/\r\nnew", "a\r\n\r\nb", 1, "d")]
    pages = spark.createDataFrame(rows, PAGES)
    files = warc.write_archives(pages, new_folder(spark, "warc-test"), file_bytes=500)
    assert files.count() > 1
    got = warc.read_archives(files, with_payload=True).collect()
    assert len(got) == len(rows)
    most = {}
    for page, _, text, *_ in rows:
        most[text or ""] = max(most.get(text or "", -1), -1 if page is None else page)
    for row in got:
        text = next(t for p, _, t, *_ in rows if p == row.page_id) or ""
        payload = text.encode()
        assert (row.payload_bytes, row.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        refers = None if row.page_id in (None, most[text]) else most[text]
        assert (row.record_type, row.refers_to) == ("response" if refers is None else "revisit", refers)
        assert row.payload == (payload if refers is None else None)
    none_ = warc.write_archives(spark.createDataFrame([], PAGES), new_folder(spark, "warc-test"))
    assert warc.read_archives(none_).count() == 0
    large = warc.write_archives(pages, new_folder(spark, "warc-test"), min_bytes=10**6)
    assert warc.read_archives(large).where("record_type = 'revisit'").count() == 0


def test_warc_ids_with_two_payloads(spark, monkeypatch):
    """An id may come with two payloads, one shared and one of its own, or both shared; several files go to a task."""
    monkeypatch.setattr(warc, "READERS", 2)
    given = [(1, "A"), (1, "B"), (2, "A"), (3, "B"), (5, "only here"), (5, "A"), (6, "A"), (None, "A"), (6, "A")]
    pages = spark.createDataFrame([(k, f"http://x/{k}", text, 1, "d") for k, text in given], PAGES).repartition(3)
    files = warc.write_archives(pages, new_folder(spark, "warc-two"), file_bytes=1)
    assert files.count() == len(given)
    got = Counter((row.page_id, row.payload_digest, row.refers_to, row.payload and row.payload.decode()) for row in warc.read_archives(files, True).collect())
    most = {"A": 6, "B": 3, "only here": 5}
    expected = Counter()
    for page, text in given:
        refers = None if page in (None, most[text]) else most[text]
        expected[page, base64.b32encode(hashlib.sha1(text.encode()).digest()).decode(), refers, None if refers else text] += 1
    assert got == expected


def test_warc_verifies():
    record = warc._record(1, "u", b"payload" * 9, None, "now")
    whole = zlib.compress(record, wbits=31)
    assert [r.page("warc-record-id") for r in warc.read_records(io.BytesIO(whole * 3))] == [1, 1, 1]
    for broken in (zlib.compress(record.replace(b"payload", b"PAYLOAD"), wbits=31), zlib.compress(record[:-1], wbits=31), whole[:-9]):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(broken)))


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_line_dedup(rows: list[tuple], min_chars: int, min_docs: int) -> list[tuple]:
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    docs = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None:
                docs[key(line)].add(doc)
    gone = {k: max(ids) for k, ids in docs.items() if len(k) >= min_chars and len(ids) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if doc is None or gone.get(key(line), doc) == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup(spark):
    r = random.Random(6)
    lines = ["", "short", "é" * 12, " Common LINE of all\t", "common line of ALL", "another common line ", "x" * 13, "\x0bx" + "x" * 12]
    rows = [(k, "\n".join(r.choices(lines, k=r.randint(0, 6)))) for k in range(40)]
    rows += [(None, "common line of all"), (50, None), (7, "common line of all\ncommon line of all"), (7, "another common line")]
    docs = spark.createDataFrame([(*row, 1, "k", 2) for row in rows], "doc_id long, text string, h1 int, kept string, line int")
    got = [tuple(row) for row in line_dedup.dedup_lines(docs, min_chars=12, min_docs=3).select("doc_id", "kept_text", "n_lines", "n_dropped").collect()]
    assert Counter(got) == Counter(plain_line_dedup(rows, 12, 3))
    assert line_dedup.dedup_lines(none(spark)).count() == 0


def test_extraction_on_held_out_pages(spark):
    pages = labelled_pages(150, first=100_000)
    rows = [(k, None, source, 1, "x") for k, (source, _) in enumerate(pages)] + [(900, "u", None, 1, "x"), (901, "u", "", 1, "x"), (None, "u", "<<>&amp;<", 1, "x")]
    got = {row.page_id: row for row in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")).collect()}
    assert len(got) == len(rows)
    assert (got[900].text, got[901].text, got[901].n_chars) == ("", "", 0)
    right = sum(len(main & set(got[k].text.split("\n"))) for k, (_, main) in enumerate(pages))
    found = sum(len(got[k].text.split("\n")) for k in range(len(pages)))
    assert right / sum(len(main) for _, main in pages) > 0.98 and right / found > 0.98
    assert all(row.n_chars == len(row.text) for row in got.values())


def test_leaf_blocks():
    source = (
        "<title>t</title><script>var a='<p>no</p>'</script><p>one &amp; &lt;two&gt;<b>three<br>four<p>five<!-- <p>no</p> -->"
        "<ul><li>a<li>b</ul><div title='x>y'>six\n\n seven</div></div><p>1 < 2</p><style>p{}"
    )
    assert [b.text for b in html_extraction.leaf_blocks(source)] == ["t", "one & <two>three four", "five", "a", "b", "six seven", "1 < 2"]


def test_viterbi_is_the_best_of_all_labellings():
    field = html_extraction.Field({"in:p": 0.3, "words:1": -1.1, "words:2": 0.7}, [[0.2, -0.4], [-0.9, 0.6]], [0.1, -0.2])
    r = random.Random(8)
    for _ in range(30):
        blocks = [html_extraction.Block(r.choice(["a", "a b", "a b c d."]), ("p",), 0.0) for _ in range(r.randint(1, 8))]

        def score(code: int, blocks=blocks) -> float:
            labels = [code >> t & 1 for t in range(len(blocks))]
            total = field.first[labels[0]] + sum(field.after[a][b] for a, b in zip(labels, labels[1:], strict=False))
            return total + sum(field.score(b) for b, label in zip(blocks, labels, strict=True) if label)

        found = field.label(blocks)
        assert score(sum(label << t for t, label in enumerate(found))) == pytest.approx(max(map(score, range(1 << len(blocks)))))


def test_unescape_undoes_escape(spark):
    texts = ["", "\\", "###", "</turn>", "\\\\#:<", chat_format.TRAP, "é\n\\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e")).collect()
    assert all(chat_format.unescape(row.e) == row.t for row in rows)
    assert not any("###" in row.e or "</turn>" in row.e for row in rows)


def test_embedded_elements_keep_their_text():
    """Formulas are text, and an element without an end tag costs nothing."""
    sentence = "The area of the circle grows with the square of its radius, as every reader of this page will know."
    formula = "<math><mi>A</mi><mo>=</mo><mi>r</mi></math>"
    page = f"<html><body><article><h1>Circles</h1><p>{sentence} {formula} holds.</p>{{}}<p>{sentence}</p></article></body></html>"
    texts = [sentence + " A=r holds.", sentence]
    for tag in ("", "<video src=x>", "<object data=x>", "<svg>", "<math>", "<canvas>", "<audio>", "<noscript>", "<template>", "<svg/>"):
        blocks = [b.text for b in html_extraction.leaf_blocks(page.format(tag))]
        assert blocks == ["Circles", *texts], tag
    field = html_extraction.trained()
    for tag in ("", "<video src=x>", "<svg>"):
        blocks = html_extraction.leaf_blocks(page.format(tag))
        kept = [b.text for b, label in zip(blocks, field.label(blocks), strict=True) if label]
        assert kept[-2:] == texts, tag
    hidden = html_extraction.leaf_blocks("<p>one<script>var a = '<p>';</script><style>p {}</style><textarea><p>x</textarea> two</p>")
    assert [b.text for b in hidden] == ["one two"]


def test_extraction_reads_whole_blocks():
    """What a block says at its end counts, however much stands before it; a long block costs no more by the hint."""
    model = html_extraction.trained()
    r = random.Random(1)
    prose = " ".join(" ".join(r.choices("lo men no or pa qui re sa ti un vo wa".split(), k=9)).capitalize() + "." for _ in range(40))
    page = "<html><body><article><h1>A title of it</h1><p>Some words of an article that go on for a while, and then end.</p></article><section>{}</section></body></html>"
    for before in (0, 100, 700, 1400):
        blocks = html_extraction.leaf_blocks(page.format(f"{prose[:before]} Reply to this comment."))
        assert model.label(blocks) == [1, 1, 0], before
    assert model.label(html_extraction.leaf_blocks(page.format(prose))) == [1, 1, 1]
    inside = f"{prose[:700]} Re sa reply un vo wa. {prose[:700]}"
    assert model.label(html_extraction.leaf_blocks(page.format(inside))) == [1, 1, 1]
    long = "share reply " * 100_000
    start = time.perf_counter()
    html_extraction.leaf_blocks(page.format(long))
    model.label(html_extraction.leaf_blocks(page.format(long)))
    assert time.perf_counter() - start < 20
