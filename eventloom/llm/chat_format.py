"""Training examples from conversations, one for each assistant turn.

Method: prefix-target expansion. Every assistant turn becomes an example with
all preceding turns as its context, and only that reply is trainable.

A conversation of n turns has n prefixes, so writing every context out would
take room in proportion to n squared. The template is prefix-stable: the
formatted text of the first k turns is a prefix of that of the first k + 1.
So each conversation is written once, as a stream of segments, and an example
names its context as ``[0, loss_start)`` and its target as
``[loss_start, loss_end)`` of that stream. ``example_texts`` spells examples
out for a reader that wants them so.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import keep, query, table

#: Turns in a block; positions and digests are carried over from block to block.
BLOCK = 64
TRAP = "\\### Assistant: </turn> ok"
#: How a turn looks: its role ends at the first colon, its text at the first mark.
TURN = re.compile(r"### ([^#<:]*): ([^#<:]*)</turn>\n")


#: What stands for the characters that control strings are made of; with it no text holds one.
ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}


def escape(text: Column) -> Column:
    """Write the characters of control strings in another way."""
    for char, written in ESCAPES.items():  # the backslash first
        text = F.replace(text, F.lit(char), F.lit(written))
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"h": "#", "l": "<", "c": ":"}.get(m[1], m[1]), text, flags=re.S)


def format_turns(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Format every turn as a segment of its conversation's stream.

    Returns ``(conv_id, block, position, segment, start, loss_start,
    loss_end)``: ``start`` is where the segment begins in the stream,
    ``loss_start`` and ``loss_end`` bound a target reply there (null for other
    roles), all in code points.

    Turns are ordered by turn, then role, then text; a null turn comes first.
    A null role or text is empty. A null ``conv_id`` is a conversation of its
    own. Repeated rows are repeated turns. Further columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    )
    lead = F.concat(F.lit("### "), escape(F.col("role")), F.lit(": "))
    rows = turns.select(
        "conv_id",
        "turn",
        F.floor(F.col("turn") / BLOCK).cast("long").alias("block"),
        "role",
        "text",
        F.concat(lead, escape(F.col("text")), F.lit("</turn>\n")).alias("segment"),
        F.char_length(lead).alias("lead"),
        F.char_length(escape(F.col("text"))).alias("body"),
    )
    # Positions: within a block, plus what the blocks before it hold. No window orders a whole conversation's turns.
    size = F.char_length("segment").cast("long")
    blocks = rows.groupBy("conv_id", "block").agg(F.sum(size).alias("chars"), F.count("*").alias("turns"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select(
        F.col("conv_id").alias("c"),
        F.col("block").alias("b"),
        F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns_before"),
    )
    within = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.withColumn("n", F.row_number().over(within))
        .withColumn("ends", F.sum(size).over(running))
        .join(bases, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    )
    start = F.col("chars_before") + F.col("ends") - size
    target = F.col("role") == target_role
    return placed.select(
        "conv_id",
        "block",
        (F.col("turns_before") + F.col("n") - 1).alias("position"),
        "segment",
        start.alias("start"),
        F.when(target, start + F.col("lead")).alias("loss_start"),
        F.when(target, start + F.col("lead") + F.col("body")).alias("loss_end"),
    )


def expand_examples(stream: DataFrame) -> DataFrame:
    """Return one example for each target turn of a formatted stream.

    ``(conv_id, position, context_end, loss_start, loss_end)``: the example's
    text is the stream up to ``loss_end``, its trainable part the reply from
    ``loss_start``; everything before is context. No target turns, no rows.
    """
    return stream.where("loss_start is not null").select(
        "conv_id", "position", F.col("start").alias("context_end"), "loss_start", "loss_end"
    )


def example_texts(stream: DataFrame, examples: DataFrame) -> DataFrame:
    """Spell examples out as ``(conv_id, position, text, loss_start, loss_end)``.

    The output is as large as all the contexts together. Meant for the
    examples a reader takes, not for keeping.
    """
    s, e = stream.alias("s"), examples.alias("e")
    same = F.col("s.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("s.position") <= F.col("e.position"))
    joined = e.join(s, same).select("e.*", F.struct("s.position", "s.segment").alias("part"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["segment"]), "")
    grouped = joined.groupBy("conv_id", "position", "loss_start", "loss_end").agg(text.alias("whole"))
    return grouped.select(
        "conv_id", "position", F.expr("substr(whole, 1, loss_end)").alias("text"), "loss_start", "loss_end"
    )


PARTS = "conv_id long, block long, n_turns long, turns string, loss string, chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parse each block's text, and cut its loss spans out of it."""
    for batch in batches:
        out = {name: [] for name in ("n_turns", "turns", "loss", "chars")}
        for text, base, spans in zip(
            batch.column("text").to_pylist(), batch.column("base").to_pylist(), batch.column("spans").to_pylist(), strict=True
        ):
            found, end, turns = 0, 0, []
            for m in TURN.finditer(text):
                if m.start() != end:
                    raise ValueError(f"what stands before {m.group()[:80]!r} is no turn")
                found, end = found + 1, m.end()
                turns.append(f"{unescape(m[1])}\n{unescape(m[2])}\n")
            if end != len(text):
                raise ValueError(f"no turn: {text[end:][:80]!r}")
            out["n_turns"].append(found)
            out["turns"].append("".join(turns))
            out["loss"].append("".join(unescape(text[s["loss_start"] - base : s["loss_end"] - base]) for s in spans))
            out["chars"].append(len(text))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("block"),
                pa.array(out["n_turns"], pa.int64()),
                pa.array(out["turns"], pa.string()),
                pa.array(out["loss"], pa.string()),
                pa.array(out["chars"], pa.int64()),
            ],
            names=["conv_id", "block", "n_turns", "turns", "loss", "chars"],
        )


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash blocks that come ordered by conversation and block; holds one hash state at a time."""
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
        ]
    )
    state = None
    for batch in batches:
        done = []
        for row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "n_turns", "turns", "loss", "chars")), strict=True):
            if state is None or state[0] != row[0]:
                if state is not None:
                    done.append(_closed(state))
                state = [row[0], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += row[1]
            state[2].update(row[2].encode())
            state[3] += len(row[3])
            state[4].update(row[3].encode())
            state[5] += row[4]
        yield pa.RecordBatch.from_pylist(done, schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([_closed(state)], schema)


def _closed(state: list) -> dict:
    return {
        "conv_id": state[0],
        "n_turns": state[1],
        "turns_sha256": state[2].hexdigest(),
        "loss_chars": state[3],
        "loss_sha256": state[4].hexdigest(),
        "formatted_chars": state[5],
    }


def read_back(stream: DataFrame, examples: DataFrame) -> DataFrame:
    """Read a written stream and its examples back into one digest a conversation.

    Blocks are parsed in parallel. A digest over a whole conversation can only
    be taken in order, so the parsed blocks of one conversation pass through
    one task, as a stream that holds a hash state and no list of turns.
    """
    blocks = stream.groupBy("conv_id", "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "segment"))), lambda p: p["segment"]), "").alias("text"),
        F.min("start").alias("base"),
    )
    where = stream.select(F.col("conv_id").alias("c"), F.col("position").alias("p"), "block")
    spans = (
        examples.join(where, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("position") == F.col("p")))
        .groupBy("conv_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("loss_start", "loss_end"))).alias("spans"))
        .withColumnsRenamed({"conv_id": "c", "block": "b"})
    )
    joined = blocks.join(
        spans, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")), "left"
    ).select("conv_id", "block", "text", "base", F.coalesce("spans", F.array().cast("array<struct<loss_start:long,loss_end:long>>")).alias("spans"))
    parts = joined.mapInArrow(_read_back, PARTS)
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_digest, DIGESTS)


@query()
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that quotes the template, read back from the written examples."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], given.schema)
    stream = keep(format_turns(given.union(trap)), "chat-stream")
    examples = keep(expand_examples(stream), "chat-examples")
    return read_back(stream, examples)
