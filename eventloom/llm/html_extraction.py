"""The main text of web pages.

Method: a linear-chain conditional random field over the leaf blocks of a page,
with features of the ancestor tags and of the text, trained on labelled pages
and decoded by Viterbi. There are two labels, so a feature has one weight: how
much it speaks for main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import query, table
from eventloom.llm.labelled_pages import labelled_pages

#: Labelled pages that the model is fitted on, rounds of fitting, step and penalty.
PAGES, ROUNDS, STEP, PENALTY = 400, 150, 0.3, 1e-3

#: Fixed sets of the markup language.
BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option
    p pre search section select summary table tbody td tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their end tag; and others that are features of the blocks in them.
RAW = frozenset("iframe noembed noframes script style textarea xmp".split())
EMBEDS = frozenset("audio canvas math noscript object svg template video".split())
SECTIONS = frozenset("article aside body dialog fieldset footer form head header main nav section table".split())
#: An opening tag that ends an open element, up to the container that shields it.
ENDS_ITEM = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SHIELDS = frozenset("ul ol dl menu table select body html article aside section main div form".split())
ENDS_P = BLOCKS - {"button", "caption", "html", "body", "head", "title", "option", "optgroup", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}

TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words from either end of a block within which a hint stands at that end.
EDGE = 6
HINTS = re.compile(
    r"\b(cookies?|subscribe|newsletter|advertisement|sponsored|advert|comments?|reply|replies|share|follow|log in|sign up|sign in|"
    r"register|privacy|terms|copyright|all rights reserved|related|read more|menu|search|submit|e-?mail)\b|©",
    re.I,
)


class Block:
    """A leaf block: its text, the tags it stands in, and how much of it is links."""

    __slots__ = ("links", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], links: float) -> None:
        self.text, self.path, self.links = text, path, links


def leaf_blocks(source: str) -> list[Block]:
    """Cut a page into its leaf blocks, in page order.

    Unclosed and misnested elements are closed the way browsers do. Comments
    and the contents of scripts, styles and other raw text are left out, all
    other elements are read, whatever they embed; character references are
    decoded; white space becomes one space. Empty blocks are
    left out.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # name, and the opening tag as written
    parts: list[tuple[str, bool]] = []
    in_link = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(len(t) for t, link in parts if link)
                path = tuple(tag for name, tag in stack if name in BLOCKS or name in EMBEDS or len(tag) > len(name))
                out.append(Block(text, path, linked / sum(len(t) for t, _ in parts)))
            parts.clear()

    def close(position: int) -> None:
        nonlocal in_link
        if any(name in BLOCKS for name, _ in stack[position:]):
            flush()
        in_link -= sum(name == "a" for name, _ in stack[position:])
        del stack[position:]

    at = 0
    while at < len(source):
        found = TAG.search(source, at)
        text = source[at : found.start() if found else len(source)]
        if text:
            parts.append((html.unescape(text) if "&" in text else text, in_link > 0))
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if found[1]:
            position = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if position is not None:
                close(position)
            elif name in BLOCKS:
                flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
            if not found[3].rstrip().endswith("/"):
                at = end.end() if end else len(source)
            parts.append((" ", False))
            continue
        if name == "br":
            parts.append((" ", False))
        if name in BLOCKS:
            flush()
        if name in ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ENDS_ITEM.get(name, ()):
                close(k)
                break
            if stack[k][0] in SHIELDS or name not in ENDS_ITEM:
                break
        if name not in VOID and not (name in EMBEDS and found[3].rstrip().endswith("/")):
            attributes = " ".join(m[0] for m in ATTRIBUTE.finditer(found[3])) if "=" in found[3] else ""
            stack.append((name, f"{name} {attributes}" if attributes else name))
            in_link += name == "a"
    flush()
    return out


@cache
def _path_features(path: tuple[str, ...]) -> tuple[str, ...]:
    """Features of the tags a block stands in, the outermost first."""
    out: set[str] = set()
    section = "none"
    names = [tag.split(" ", 1)[0] for tag in path]
    for name, tag in zip(names, path, strict=True):
        if name in EMBEDS or name in BLOCKS and name not in ("html", "body", "div"):
            out.add(f"in:{name}")
        if name in SECTIONS:
            section = name
        for m in ATTRIBUTE.finditer(tag):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "role":
                out.add(f"role:{value.lower()}")
            else:
                out.update(f"class:{word.lower()}" for word in NAME.findall(value))
    out.add(f"section:{section}")
    out.add(f"tag:{next((n for n in reversed(names) if n in BLOCKS), 'none')}")
    return tuple(sorted(out))


def _text_features(block: Block) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    out = [f"words:{min(6, words.bit_length())}", f"links:{round(2 * block.links)}"]
    out.append("ends:sentence" if text[-1] in ".!?…\"'”’)" else "ends:open")
    # A word that hints at clutter says less the more words stand around it, and most at an end of its block. Within a
    # long block only their share counts.
    around = min(3, (words // 16).bit_length())
    head, tail = len(text), -1
    if words > EDGE:
        head = tail = 0
        for _ in range(EDGE):
            head = text.find(" ", head) + 1
        tail = len(text)
        for _ in range(EDGE):
            tail = text.rfind(" ", 0, tail)
    many = 0
    for m in HINTS.finditer(text):
        hint, many = m[0].lower(), many + 1
        if around < 3:
            out.append(f"hint:{around}:{hint}")
        if m.start() < head:
            out.append(f"first:{hint}")
        if m.end() > tail:
            out.append(f"last:{hint}")
    out.append(f"hints:{min(3, 16 * many // words)}")
    return sorted(set(out))


class Field:
    """Weights of the features, of each label after each, and of the first label. Label 1 is main text."""

    def __init__(self, weights: dict[str, float], after: list[list[float]], first: list[float]) -> None:
        self.weights, self.after, self.first = weights, after, first
        self.paths: dict[tuple[str, ...], float] = {}

    def score(self, block: Block) -> float:
        known = self.paths.get(block.path)
        if known is None:
            if len(self.paths) > 100_000:
                self.paths.clear()
            known = self.paths[block.path] = sum(self.weights.get(f, 0.0) for f in _path_features(block.path))
        return known + sum(self.weights.get(f, 0.0) for f in _text_features(block))

    def label(self, blocks: list[Block]) -> list[int]:
        """The most probable labels of a page's blocks."""
        if not blocks:
            return []
        (a00, a01), (a10, a11) = self.after
        other, main = self.first[0], self.first[1] + self.score(blocks[0])
        back = []
        for block in blocks[1:]:
            back.append((other + a00 < main + a10, other + a01 < main + a11))
            other, main = max(other + a00, main + a10), max(other + a01, main + a11) + self.score(block)
        labels = [int(main > other)]
        for from_main in reversed(back):
            labels.append(int(from_main[labels[-1]]))
        return labels[::-1]


def fit(pages: list[list[tuple[Block, int]]], rounds: int = ROUNDS, step: float = STEP, penalty: float = PENALTY) -> Field:
    """Maximise the likelihood of labelled pages, by gradient steps of a size of its own for each weight."""
    features = [[[*_path_features(b.path), *_text_features(b)] for b, _ in page] for page in pages]
    names = {f: k for k, f in enumerate(sorted({f for page in features for fs in page for f in fs}))}
    size = max(map(len, pages))
    x = np.zeros((len(pages), size, len(names)), np.float32)
    gold, real = np.zeros((len(pages), size), int), np.zeros((len(pages), size), bool)
    for i, page in enumerate(pages):
        for t, (_, label) in enumerate(page):
            x[i, t, [names[f] for f in features[i][t]]] = 1
            gold[i, t], real[i, t] = label, True
    onehot = np.eye(2)[gold] * real[..., None]
    pairs = real[:, 1:, None, None] * onehot[:, :-1, :, None] * onehot[:, 1:, None, :]
    w, after, first = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    moments = [np.zeros_like(p) for p in (w, after, first)]
    for _ in range(rounds):
        unary = np.zeros((len(pages), size, 2))
        unary[..., 1] = x @ w
        ahead = np.zeros((len(pages), size, 2))
        ahead[:, 0] = first + unary[:, 0]
        for t in range(1, size):
            new = np.logaddexp.reduce(ahead[:, t - 1, :, None] + after, axis=1) + unary[:, t]
            ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
        behind = np.zeros((len(pages), size, 2))
        for t in range(size - 2, -1, -1):
            new = np.logaddexp.reduce(after + (unary[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(real[:, t + 1, None], new, 0.0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        single = np.exp(ahead + behind - total[:, None, None]) * real[..., None]
        joint = ahead[:, :-1, :, None] + after + (unary[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        double = np.exp(joint) * real[:, 1:, None, None]
        n = len(pages)
        slopes = [
            np.einsum("itf,it->f", x, (onehot - single)[..., 1]) / n - penalty * w,
            (pairs - double).sum((0, 1)) / n - penalty * after,
            (onehot - single)[:, 0].sum(0) / n - penalty * first,
        ]
        for k, (value, slope) in enumerate(zip((w, after, first), slopes, strict=True)):
            moments[k] = moments[k] + slope**2
            value += step * slope / (np.sqrt(moments[k]) + 1e-8)
    return Field({f: float(w[k]) for f, k in names.items()}, after.tolist(), first.tolist())


def trained(pages: int = PAGES) -> Field:
    """Fit on labelled pages."""
    rows = []
    for source, main in labelled_pages(pages):
        blocks = leaf_blocks(source)
        rows.append([(block, int(block.text in main)) for block in blocks])
    return fit(rows)


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    model: Field | None = None,
) -> DataFrame:
    """Return ``(page_id, url, text, n_chars)`` for every row.

    ``text`` is that of the main blocks in page order, joined by one newline,
    ``n_chars`` its code points. Null or empty html, or a page without main
    text: the empty text. Null ids and urls stay null; repeated rows are each
    read; other columns are ignored. Markup of any length is read whole.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())  # a weight for each feature of the labelled pages
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(html_col, F.lit("")).alias("html"),
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            texts = []
            for source in batch.column("html").to_pylist():
                blocks = leaf_blocks(source)
                texts.append("\n".join(b.text for b, label in zip(blocks, field.label(blocks), strict=True) if label))
            sizes = pa.array([len(text) for text in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")


@query()
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
