"""The trie of the prefixes that conversations share.

Method: whole-sequence collapse. Identical conversations become one weighted
sequence with the list of those that end there; the sequences that are proper
prefixes of others are dropped by an anti-join, which leaves the leaves; then
the weighted prefixes are aggregated into nodes.

A prefix is known by its length and by 128 bits over its turns, the exclusive
or of a hash of each turn with its position. So the keys of all prefixes of a
conversation are a running fold, which goes on from block to block and never
needs a conversation in one task. Texts are read once, for their digests.

What a node says of its subtree is summed over sequences, not over the tree:
a sequence of weight w adds w times the bytes from a node on to that node and
to every other on its way, and each node's own bytes are taken off once, by
the sequence that owns it, which is the one with the smallest conversation. A
sequence owns its nodes from some depth on, so one number tells them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import keep, numbered, query, table

#: Turns of a conversation whose keys are folded together; a longer one has several blocks.
BLOCK = 4096
#: How the query rebuilds conversations: neighbours that share an opening, and the turns it may have.
SHARING, OPENING = 5, 9
KEY = ["depth", "k1", "k2"]


def number_turns(conversations: DataFrame) -> DataFrame:
    """Return ``(conv_id, position, t1, t2, n_bytes)`` for every turn.

    Positions count from 1 by turn, null first; turns of equal number are
    ordered by a digest of role and text, so that equal tables give equal
    sequences. ``t1`` and ``t2`` are 128 bits of that digest, ``n_bytes`` the
    UTF-8 bytes of the text. A null role or text is empty. Rows without a
    ``conv_id`` belong to no conversation and are left out. Repeated rows are
    repeated turns. Other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)

    def bits(start: int):
        return F.conv(F.substring(digest, start, 16), 16, -10).cast("long")

    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        bits(1).alias("t1"),
        bits(17).alias("t2"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    return keep(numbered(turns, "conv_id", ["turn", "t1", "t2"], "trie-sorted").drop("turn"), "trie-turns")


def share_openings(turns: DataFrame, sharing: int = SHARING, opening: int = OPENING) -> DataFrame:
    """Give conversations the opening of the first of their ``sharing`` neighbours.

    Conversation c takes the first h turns of c - c mod ``sharing`` and then
    its own turns after its first h, where h is the CRC-32 of its decimal id
    modulo ``opening``. A base with fewer turns gives all it has; one that is
    not there gives none. Returns the columns of ``turns``, and a row with
    position 0 and no turn for every conversation.
    """
    lengths = keep(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "trie-lengths")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(opening))
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(sharing))
    convs = lengths.select("conv_id", "own", base.alias("base"), h.alias("h"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    taken = F.least("h", F.coalesce("base_turns", F.lit(0)))
    convs = keep(convs.join(bases, "base", "left").withColumn("taken", taken).drop("base_turns"), "trie-openings")
    heads = turns.where(F.col("position") < opening).withColumnRenamed("conv_id", "base")
    opened = heads.join(convs, "base").where("position <= h").select("conv_id", "position", "t1", "t2", "n_bytes")
    # The shift of a conversation is met block by block, so that a long one does not meet it in one task.
    block = F.floor(F.col("position") / BLOCK).cast("long")
    shifts = convs.select(
        F.col("conv_id").alias("c"), F.explode(F.sequence(F.lit(0), F.floor(F.col("own") / BLOCK))).alias("b"), (F.col("taken") - F.col("h")).alias("shift")
    )
    kept = turns.where(F.col("position") > h).withColumn("block", block)
    shifted = kept.join(shifts, (F.col("conv_id") == F.col("c")) & (F.col("block") == F.col("b")))
    none = F.lit(0).cast("long")
    return (
        opened.union(shifted.select("conv_id", F.col("position") + F.col("shift"), "t1", "t2", "n_bytes"))
        .union(lengths.select("conv_id", *[none.alias(c) for c in ("position", "t1", "t2", "n_bytes")]))
        .select("conv_id", F.col("position").cast("long").alias("position"), "t1", "t2", "n_bytes")
    )


ENDS = "depth long, k1 long, k2 long, ends_sha256 string"


def _end_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest the id lists of sequences that come in order; holds one hash state, never a list."""
    names = [*KEY, "ends_sha256"]
    open_key, state = None, None

    def closed(keys: list[tuple], digests: list[str]) -> pa.RecordBatch:
        columns = zip(*keys, strict=True) if keys else ([], [], [])
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string())], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in KEY])
        ids = batch.column("conv_id").to_pylist()
        borders = np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1
        keys, digests = [], []
        for start, stop in zip([0, *borders.tolist()], [*borders.tolist(), len(ids)], strict=True):
            key = tuple(columns[:, start].tolist())
            listed = ",".join(map(str, ids[start:stop])).encode()
            if key == open_key:
                state.update(b"," + listed)
                continue
            if open_key is not None:
                keys.append(open_key)
                digests.append(state.hexdigest())
            open_key, state = key, hashlib.sha256(listed)
        yield closed(keys, digests)
    if open_key is not None:
        yield closed([open_key], [state.hexdigest()])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Return one row for every node of the trie of ``turns(conv_id, position, t1, t2, n_bytes)``.

    ``position`` counts from 1; a row with position 0 stands for its
    conversation and no turn, and is needed only where a conversation has no
    other. The columns are

    * ``conv_id`` and ``depth``: the smallest conversation through the node and
      the number of its turns; its last turn is that one of that conversation,
    * ``parent_conv_id``: the parent's ``conv_id``, null for the root,
    * ``n_convs``, ``n_children``, ``n_leaves``: conversations through it, its
      children, and the childless nodes of its subtree, itself included,
    * ``saved_tokens``: bytes of text that the subtree's nodes save, each
      (n_convs - 1) times its own,
    * ``ends_sha256``: SHA-256 of the ids of the conversations that end there,
      ascending, joined by commas.

    No rows, no nodes. The id list of one node goes through one task as a
    stream, as its digest can only be taken in order; nothing else gathers a
    group.
    """
    block = F.floor(F.col("position") / BLOCK).cast("long")
    mixed = [F.when(F.col("position") > 0, F.xxhash64(F.lit(seed), "position", "t1", "t2")).otherwise(F.lit(0)) for seed in (1, 2)]
    rows = keep(turns.select("conv_id", "position", block.alias("block"), mixed[0].alias("e1"), mixed[1].alias("e2"), "n_bytes"), "trie-rebuilt")
    blocks = keep(
        rows.groupBy("conv_id", "block").agg(
            F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"), F.sum("n_bytes").alias("bytes"), F.max("position").alias("last")
        ),
        "trie-blocks",
    )

    # Whole-sequence collapse: identical conversations become one sequence with a weight.
    convs = keep(
        blocks.groupBy("conv_id").agg(F.max("last").alias("depth"), F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2"), F.sum("bytes").alias("total")),
        "trie-conversations",
    )
    sequences = keep(
        convs.groupBy(*KEY).agg(F.min("conv_id").alias("first"), F.count("*").alias("weight"), F.max("total").alias("total")), "trie-sequences"
    )
    in_order = convs.select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    ends = in_order.mapInArrow(_end_lists, ENDS)

    # The prefixes of each sequence, spelled by its smallest conversation; keys go on from block to block.
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select(
        F.col("conv_id").alias("first"),
        F.col("block").alias("b"),
        F.coalesce(F.bit_xor("x1").over(earlier), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("x2").over(earlier), F.lit(0)).alias("b2"),
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
    ).join(sequences.select("first", "weight", "total", F.col("depth").alias("whole")), "first")
    running = Window.partitionBy("first", "b").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.where("position > 0").join(bases, (F.col("conv_id") == F.col("first")) & (F.col("block") == F.col("b")))
    up_to = F.col("bytes_before") + F.sum("n_bytes").over(running)
    fold = [F.col(b).bitwiseXOR(F.bit_xor(e).over(running)) for b, e in (("b1", "e1"), ("b2", "e2"))]
    below_root = own.select(
        "first", "b", F.col("position").alias("depth"), fold[0].alias("k1"), fold[1].alias("k2"), "e1", "e2", "n_bytes", up_to.alias("up_to"), "weight", "total", "whole"
    )
    zero = F.lit(0).cast("long")
    root = sequences.select("first", *[zero.alias(c) for c in ("b", *KEY, "e1", "e2", "n_bytes", "up_to")], "weight", "total", F.col("depth").alias("whole"))
    prefixes = keep(below_root.union(root), "trie-prefixes")

    nodes = keep(
        prefixes.groupBy(*KEY).agg(
            F.min("first").alias("conv_id"),
            F.sum("weight").alias("n_convs"),
            F.max(F.col("k1").bitwiseXOR(F.col("e1"))).alias("p1"),
            F.max(F.col("k2").bitwiseXOR(F.col("e2"))).alias("p2"),
            F.max(F.col("up_to") - F.col("n_bytes")).alias("before"),
            F.max("whole").alias("longest"),
            F.sum(F.col("weight") * (F.col("total") - F.col("up_to") + F.col("n_bytes"))).alias("through"),
        ),
        "trie-nodes",
    )
    # Leaves: the sequences that are no proper prefix of another.
    proper = nodes.where("longest > depth").select(*KEY)
    leaves = sequences.join(proper, KEY, "left_anti").select(F.col("first").alias("conv_id"), F.lit(1).alias("leaf"))
    owned = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "before")).alias("own"))
    known = sequences.select(F.col("first").alias("conv_id"), "total").join(owned, "conv_id", "left").join(leaves, "conv_id", "left")
    per_block = blocks.select("conv_id", "block").union(sequences.select("first", zero)).distinct()
    facts = known.join(per_block, "conv_id").select(
        F.col("conv_id").alias("s"),
        F.col("block").alias("at"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"),
        F.col("own.depth").alias("from_depth"),
        F.coalesce("own.before", "total").alias("from_byte"),
    )
    told = prefixes.join(facts, (F.col("first") == F.col("s")) & (F.col("b") == F.col("at")))
    own_bytes = F.col("total") - F.greatest(F.col("up_to") - F.col("n_bytes"), F.col("from_byte"))
    nothing = F.lit(None)
    # Everything that is said of a node, by whatever key it is found, meets in one aggregation.
    parts = [
        told.select(*KEY, "leaf", own_bytes.alias("own_bytes"), zero.alias("child"), (F.col("depth") == F.col("from_depth")).alias("top"), nothing.cast("string").alias("ends")),
        nodes.where("depth > 0").select(F.col("depth") - 1, "p1", "p2", zero, zero, F.lit(1), nothing.cast("boolean"), nothing.cast("string")),
        ends.select(*KEY, zero, zero, zero, nothing.cast("boolean"), "ends_sha256"),
    ]
    said = parts[0].union(parts[1]).union(parts[2]).groupBy(*KEY).agg(
        F.sum("leaf").alias("n_leaves"),
        F.sum("own_bytes").alias("own_bytes"),
        F.sum("child").alias("n_children"),
        F.max("top").alias("top"),
        F.max("ends").alias("ends"),
    )
    whole = keep(nodes.join(said, KEY), "trie-said")
    # A node that does not open its owner's part has a parent of the same owner; the others, one for each sequence, look theirs up.
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    tops = whole.where("top and depth > 0").join(parents, ["depth", "p1", "p2"])
    rest = whole.where("not top or depth = 0").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    empty = hashlib.sha256().hexdigest()
    return tops.unionByName(rest).select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.col("n_children").cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"),
        (F.col("through") - F.col("own_bytes")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(empty)).alias("ends_sha256"),
    )


#: The CRC-32 of an id's decimal digits, by the polynomial's own definition, eight steps a digit.
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn
  FROM conversations WHERE conv_id IS NOT NULL
),
own AS (SELECT conv_id, list(turn ORDER BY pos) AS turns FROM rows GROUP BY conv_id),
hashed AS (
  SELECT conv_id, turns, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda crc, step: xor(xor(crc, step) >> 1, CASE WHEN xor(crc, step) & 1 = 1 THEN 3988292384 ELSE 0 END)
  )) % {OPENING} AS h
  FROM own
),
built AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:o.h], o.turns[o.h + 1:]) AS turns
  FROM hashed o LEFT JOIN own b ON b.conv_id = o.conv_id - ((o.conv_id % {SHARING}) + {SHARING}) % {SHARING}
),
prefixes AS (SELECT conv_id, turns, d AS depth, turns[1:d] AS prefix FROM built, unnest(range(0, len(turns) + 1)) AS u(d)),
nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '')) AS ends_sha256,
         coalesce(octet_length(encode(prefix[depth].text)), 0) * (count(*) - 1) AS saved
  FROM prefixes GROUP BY depth, prefix
),
kids AS (SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
family AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.prefix = n.prefix
  LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
),
above AS (SELECT d AS depth, prefix[1:d] AS prefix, saved, n_children FROM family, unnest(range(0, depth + 1)) AS u(d)),
subtree AS (
  SELECT depth, prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY depth, prefix
)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM family f JOIN subtree s ON s.depth = f.depth AND s.prefix = f.prefix
"""


@query(ORACLE)
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt with the opening of a neighbour."""
    return prefix_trie(share_openings(number_turns(table(spark, sf_dir, "conversations"))))
