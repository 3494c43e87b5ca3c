"""Count tokens with a tokenizer compiled to a finite-state transducer.

Method: a byte-pair vocabulary becomes a deterministic transducer whose
transitions carry the number of tokens they add. A text is cut into chunks.
All chunks are run at once, each from the state that the characters before it
foretell; those entered in another state are run again until all agree.

Why this is exact. Let T(p) be the last token of the encoding of a prefix p.
In byte-pair encoding, tokens that are each their own encoding make up the
encoding of their text if and only if every adjacent pair is the encoding of
its own text. So T(p) is the one vocabulary entry t that ends p with T(p minus
t) and t such a pair. To go on after p it is enough to know, for every suffix
of p that a longer token may still begin with, the token before that suffix
and how many tokens were there. That is a finite state. A token before a
suffix is forgotten where no vocabulary entry holds both characters at the
border, so states meet again at the start of every word.

States are compiled when a text first reaches them, and kept by the worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import by_id, query, table

#: Characters in a chunk, and of the chunk before it that foretell the state it starts in.
CHUNK, LOOK_BACK = 256, 32
#: Characters taken into memory at once; a longer text goes through piece by piece.
PIECE = 1 << 22
#: Compiled transitions a worker keeps before it starts afresh.
KEPT = 1 << 22
#: Classes of characters outside the vocabulary, by their length in UTF-8, and padding.
UNKNOWN, PAD, FIRST = 4, 4, 5
SPACE_MARK = "▁"


class Transducer:
    """The transducer of a sentencepiece byte-pair model with byte fallback."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        special = (sp.is_byte, sp.is_control, sp.is_unknown, sp.is_unused)
        ids = [i for i in range(sp.get_piece_size()) if not any(test(i) for test in special)]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
        self.borders = {a + b for piece in self.score for a, b in zip(piece, piece[1:], strict=False)}
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.made_of: dict[str, tuple[str, str]] = {}
        for piece in self.score:
            last = self._encode(piece, 2)
            if len(piece) == 1 or len(last) == 2 and last[0] + last[1] in self.score:
                self._add(piece)
                self.made_of[piece] = (last[0], last[-1])
        self.char_class = np.zeros(0x110000, np.int32)
        for length, start in enumerate((0, 0x80, 0x800, 0x10000)):
            self.char_class[start:] = length
        self.chars = sorted(self.child[0])
        for k, char in enumerate(self.chars):
            self.char_class[ord(char)] = FIRST + k
        self.classes = FIRST + len(self.chars)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.clear()
        for probe in ("", " ", "a", "  two  spaces ", "tab\tand\nline", "</s><0x0A>", "ﬁ①　Å\U0001f600", "naïve 12"):
            if self.count([probe])[0] != len(sp.encode(probe)):
                raise ValueError(f"{model_path} is not a byte-pair model of the kind this transducer stands for: {probe!r}")

    def _add(self, piece: str) -> None:
        node = 0
        for char in piece:
            if char not in self.child[node]:
                self.child[node][char] = len(self.child)
                self.child.append({})
                self.ends.append(None)
            node = self.child[node][char]
        self.ends[node] = piece

    def _encode(self, text: str, least: int = 1) -> list[str]:
        """Merge the best-scored pair, the leftmost of equals, until none or ``least`` parts are left."""
        parts = list(text)
        while True:
            if len(parts) <= least:
                return parts
            found = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _fit(self, a: str, b: str) -> bool:
        """Tell whether a and b stay apart when their joined text is encoded.

        The merges that made both are undone, the last one first. The border
        held if at no time a merge across it came before the one undone last.
        """
        known = self.pairs.get((a, b))
        if known is None:
            known = self.pairs[a, b] = a[-1] + b[0] not in self.borders or self._apart(a, b)
        return known

    def _apart(self, a: str, b: str) -> bool:
        undone, right = -np.inf, False
        while True:
            across = self.score.get(a + b)
            if across is not None and (across > undone or across == undone and right):  # of equals the leftmost merges first
                return False
            if len(a) == 1 and len(b) == 1:
                return True
            right = len(a) == 1 or len(b) > 1 and self.score[b] <= self.score[a]
            if right:
                undone, b = self.score[b], self.made_of[b][0]
            else:
                undone, a = self.score[a], self.made_of[a][1]

    def clear(self) -> None:
        """Forget what is compiled. A state is the tuple of (trie node of a suffix, token before it, tokens there less tokens now)."""
        self.states = [((0, None, 0),)]
        self.number = {self.states[0]: 0}
        self._room(1 << 16)
        self.used = 0

    def _room(self, size: int) -> None:
        self.keys = np.full(size, -1, np.int64)
        self.values = np.zeros(size, np.int64)
        self.shift = np.uint64(65 - size.bit_length())

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        if 4 * (self.used + len(keys)) > len(self.keys):
            old = self.keys >= 0
            old_keys, old_values = self.keys[old], self.values[old]
            self._room(4 * len(self.keys))
            self.used = 0
            self._insert(old_keys, old_values)
        mask = len(self.keys) - 1
        for key, value, slot in zip(keys.tolist(), values.tolist(), self._slots(keys).tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & mask
            self.keys[slot], self.values[slot] = key, value
        self.used += len(keys)

    def _compile(self, key: int) -> int:
        """Return the next state and the added tokens of one transition, in one number."""
        state, char = self.states[key // self.classes], self.chars[key % self.classes - FIRST]
        token, tokens, open_ = None, 0, []
        for node, before, less in state:
            child = self.child[node].get(char)
            if child is None:
                continue
            if node == 0 and before is not None and before[-1] + char not in self.borders:
                before = None
            end = self.ends[child]
            if end is not None and (before is None or self._fit(before, end)):
                token, tokens = end, less + 1
            if self.child[child]:
                open_.append((child, before, less))
        new = ((0, token, 0), *((node, before, less - tokens) for node, before, less in open_))
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
        return self.number[new] << 8 | tokens + 128

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Look transitions up, compiling those not met before."""
        mask = len(self.keys) - 1
        slot = self._slots(keys)
        out = self.values[slot]
        open_ = np.flatnonzero(self.keys[slot] != keys)
        new = []
        while len(open_):
            at = slot[open_]
            empty = self.keys[at] < 0
            if empty.any():
                new.append(open_[empty])
                open_ = open_[~empty]
                at = at[~empty]
            at = (at + 1) & mask
            slot[open_] = at
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit]
        if new:
            lanes = np.concatenate(new)
            unique, back = np.unique(keys[lanes], return_inverse=True)
            values = np.array([self._compile(key) for key in unique.tolist()], np.int64)
            self._insert(unique, values)
            out[lanes] = values[back]
        return out

    def _run(self, states: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run every lane through its column of ``classes``; return where each ends and the tokens on the way."""
        states, counts = states.copy(), np.zeros(len(states), np.int64)
        for row in classes:
            value = self._find(np.where(row >= FIRST, states * self.classes + row, FIRST))
            known = row >= FIRST
            counts += np.where(known, (value & 255) - 128, np.where(row < UNKNOWN, row + 1, 0))
            states = np.where(known, value >> 8, np.where(row < UNKNOWN, 0, states))
        return states, counts

    def _pass(self, texts: list[str], entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Return the last state and the tokens of each text, given the state it is entered in."""
        lengths = np.array([len(text) for text in texts], np.int64)
        chunks = np.maximum(1, -(-lengths // CHUNK))
        first = np.concatenate(([0], np.cumsum(chunks)[:-1]))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        grid = np.full((int(chunks.sum()), CHUNK), PAD, np.int32)
        place = np.arange(len(codes)) + np.repeat(first * CHUNK - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        grid.reshape(-1)[place] = self.char_class[codes]
        # A chunk is first run from the state that the last characters before it lead to.
        ahead, _ = self._run(np.zeros(len(grid), np.int64), np.ascontiguousarray(grid[:, -LOOK_BACK:].T))
        starts = np.concatenate(([0], ahead[:-1]))
        starts[first] = entry
        inner = np.ones(len(grid), bool)
        inner[first] = False
        columns = np.ascontiguousarray(grid.T)
        ends, counts = self._run(starts, columns)
        # A chunk stands where the one before ends in the state it was run from; the others are run again.
        while True:
            reach = np.concatenate(([0], ends[:-1]))
            broken = np.flatnonzero(inner & (reach != starts))
            if not len(broken):
                break
            starts[broken] = reach[broken]
            ends[broken], counts[broken] = self._run(starts[broken], np.ascontiguousarray(grid[broken].T))
        return ends[first + chunks - 1], np.add.reduceat(counts, first)

    def count(self, texts: list[str]) -> np.ndarray:
        """Return the number of tokens of each text."""
        if self.used > KEPT:
            self.clear()
        total = np.zeros(len(texts), np.int64)
        batch: list[int] = []
        marked: list[str] = []
        size = 0

        def flush() -> None:
            if batch:
                total[batch] = self._pass(marked, np.zeros(len(batch), np.int64))[1]
                batch.clear()
                marked.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            text = SPACE_MARK + text.replace(" ", SPACE_MARK)
            if len(text) > PIECE:
                state = np.zeros(1, np.int64)
                for at in range(0, len(text), PIECE):
                    state, tokens = self._pass([text[at : at + PIECE]], state)
                    total[i] += tokens[0]
                continue
            if size + len(text) > PIECE:
                flush()
                size = 0
            batch.append(i)
            marked.append(text)
            size += len(text)
        flush()
        return total


@cache
def transducer(model_path: str | None = None) -> Transducer:
    """Compile a model once in each worker."""
    import public_tokenizers

    return Transducer(model_path or public_tokenizers.path("piece_bpe_32k.model"))


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, model_path: str | None = None
) -> DataFrame:
    """Return ``(doc_id, n_bytes, n_tokens, over_limit)`` for every row.

    Counts what sentencepiece gives for the whole text, without begin, end or
    added special tokens. ``model_path`` has to be readable on every executor;
    without one the public 32,000-piece model is taken.

    Null or empty text: 0 bytes and 0 tokens. A null id stays null; repeated
    rows are each counted; further columns are ignored. A text of any length
    goes through in bounded memory beside the text itself.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path)
        for batch in batches:
            tokens = pa.array(machine.count(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), tokens], names=["doc_id", "n_bytes", "n_tokens"]
            )

    rows = by_id(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))
