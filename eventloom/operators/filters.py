"""Boolean rules in which an evaluation error differs from no match.

A rule is a Spark SQL text or a Column over the canonical event. A rule that
evaluates to NULL stands for an error (a missing map key, a field of an absent
object), and so does one whose evaluation fails (a bad cast, a division by
zero, an overflow, an index beyond the end): see :mod:`eventloom.operators.guard`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.operators.guard import Rule, as_column, dear, guarded, once
from eventloom.schema import EVENT

MATCHED = "matched"
UNMATCHED = "unmatched"
EVAL_ERROR = "eval_error"


class RuleError(ValueError):
    """A rule does not analyse, or does not yield a boolean."""


def check_rules(spark: SparkSession, rules: Sequence[Rule], schema: T.StructType = EVENT) -> None:
    """Refuse rules that name unknown fields, mix types, or are not boolean."""
    empty = spark.createDataFrame([], schema)
    for rule in rules:
        if isinstance(rule, str) and not rule.strip():
            raise RuleError("a rule must not be empty")
        try:
            found = empty.select(as_column(rule).alias("rule")).schema["rule"].dataType
        except (AnalysisException, ParseException) as error:
            raise RuleError(f"rule {rule!s} is refused: {error}") from error
        if not isinstance(found, T.BooleanType):
            raise RuleError(f"rule {rule!s} has to yield a boolean, not {found.simpleString()}")


def verdict(rules: Sequence[Rule], schema: T.StructType = EVENT) -> Column:
    """Return ``matched``, ``unmatched`` or ``eval_error``; the first rule that does not hold decides.

    A rule that fails does so for its event only and never ends the job.
    """
    decided = F.lit(MATCHED)
    for held in reversed(guarded(rules, schema)):
        decided = once(held, _judge(decided)) if dear(held) else _judge(decided)(held)
    return decided


def _judge(decided: Column) -> Callable[[Column], Column]:
    """Return what a rule makes of a verdict that the rules after it reach."""
    return lambda held: F.when(held.isNull(), F.lit(EVAL_ERROR)).when(~held, F.lit(UNMATCHED)).otherwise(decided)


def matches(rules: Sequence[Rule], schema: T.StructType = EVENT) -> Column:
    """Return whether every rule holds, so that plain predicates reach the scan.

    Where only matched events are wanted, an error and a non-match are both
    left out, and a conjunction keeps the predicates visible to pushdown.
    """
    held = F.lit(True)
    for rule in guarded(rules, schema):
        held = held & rule
    return held


def choose(condition: Column, then: Column, otherwise: Column) -> Column:
    """Return a conditional whose unknown condition is an error rather than false."""
    return F.when(condition, then).when(~condition, otherwise)


def exists_one(array: Column, predicate) -> Column:
    """Return whether exactly one element satisfies the predicate; any unknown element is an error."""
    verdicts = F.transform(array, predicate)
    unknown = F.exists(verdicts, lambda held: held.isNull())
    return F.when(~unknown, F.size(F.filter(verdicts, lambda held: held)) == 1)
