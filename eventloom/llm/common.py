"""Reading the tables and keeping intermediate ones where every executor can read them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.session import shared_folder

#: The white space of the word rules: space, and the codes 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEPT: ContextVar[list[str] | None] = ContextVar("kept", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a table folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """Name a new folder in the shared one; it is deleted when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage: what was computed is read, never computed again,
    also after an executor is lost.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    kept = _KEPT.get()
    if kept is not None:
        kept.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the tables kept within the block when it ends, but for those that it takes out of the list."""
    kept: list[str] = []
    token = _KEPT.set(kept)
    try:
        yield kept
    finally:
        _KEPT.reset(token)
        for path in kept:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def by_id(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """Reduce a table to its id, its text and the columns to carry along; a null text becomes the empty one."""
    id_and_text = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    return docs.select(*id_and_text, *carry)


def smallest_labels(edges: DataFrame, name: str = "components") -> DataFrame:
    """Label every end of ``edges(a, b)`` with the smallest id that it can reach.

    Alternates hooking every vertex onto the smallest label around it with
    jumping to the label's own label, so the rounds grow with the logarithm
    of the longest chain. Every round is a written table; nothing but the
    number of changed labels comes to the driver. Returns ``(id, label)``.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = keep(both.where("a <> b").distinct(), f"{name}-edges")
    labels = keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), name)
    while True:
        around = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("label").alias("seen"))
        )
        hooked = labels.join(around, "id").select("id", "label", F.least("label", "seen").alias("low"))
        # The vertex that carries an old label follows to the smallest label that its carriers have seen.
        roots = hooked.groupBy(F.col("label").alias("id")).agg(F.min("low").alias("root"))
        moved = hooked.join(roots, "id", "left").select(
            "id", F.col("label").alias("old"), F.least("low", F.coalesce("root", "low")).alias("label")
        )
        jump = moved.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = moved.join(jump, "label", "left").select(
            "id", "old", F.least("label", F.coalesce("next", "label")).alias("label")
        )
        new = keep(new, name)
        labels = new.select("id", "label")
        if not new.where("old <> label").limit(1).count():
            return labels


def ordered(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Write a table in order over all its partitions, with the place of each row.

    Adds ``_part``, the number of the partition, and ``_at``, the row's place
    in it from 0; both follow the order. Rows that are equal in ``order`` may
    stand in any order, also in two partitions, so no group of them has to fit
    in one task.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    number = F.monotonically_increasing_id()
    low = F.lit((1 << 33) - 1)
    return keep(
        placed.withColumn("_tie", number)
        .withColumn("_part", F.shiftright("_tie", 33).cast("int"))
        .withColumn("_at", F.col("_tie").bitwiseAND(low))
        .drop("_tie"),
        name,
    )


def ranked(rows: DataFrame, order: Sequence[Column | str], name: str, rank: str = "rank") -> DataFrame:
    """Number all rows from 1 in order.

    The rows are sorted over all partitions; besides them only one number for
    each partition is summed up.
    """
    placed = ordered(rows, order, name)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(bases), "_part")  # one row a partition of the sort
    return numbered.withColumn(rank, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def numbered(rows: DataFrame, group: str, order: Sequence[Column | str], name: str, number: str = "position") -> DataFrame:
    """Number the rows of each group from 1 in order; a group may be larger than a task.

    The groups' rows lie in ranges of the sorted table. A group that several
    partitions share, at most one at each of their borders, is carried on from
    what the partitions before hold of it.
    """
    placed = ordered(rows, [group, *order], name)
    parts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        F.col(group).alias("_group"), F.col("_part").alias("_in"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), "_first"
    )
    same = (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_in"))
    joined = placed.join(starts, same).withColumn(number, F.col("_before") + F.col("_at") - F.col("_first") + 1)
    return joined.drop("_group", "_in", "_part", "_at", "_before", "_first")


def registry() -> tuple[dict, dict, Callable]:
    """Return the queries, their SQL and the decorator that registers a query under its function name."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(oracle: str | None = None) -> Callable:
        def register(function: Callable) -> Callable:
            queries[function.__name__] = function
            if oracle is not None:
                oracles[function.__name__] = oracle
            return function

        return register

    return queries, oracles, query


QUERIES, ORACLES, query = registry()
