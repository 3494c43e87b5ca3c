"""Evaluation errors of a rule as NULL, on their rows only.

Spark ends a job where a cast, a sum or an index fails. A rule is not to end
a job: its failure is the verdict ``eval_error`` of one event. So the tree
that Spark's own parser makes of a rule is rewritten before it is analysed:

* casts and arithmetic that are compared take their ``try_`` forms, overflow
  included, and stay within generated code;
* the operands of AND, OR and NOT, and the conditions inside ``exists`` and
  ``forall``, are looked at one by one, so that ``false AND error`` is still
  false and ``true OR error`` still true;
* an operand that holds nothing which can fail is left as it is, so that plain
  predicates reach the scan; any other is evaluated by itself and is NULL
  where that fails, whatever function it was.

What can fail is decided on the analysed tree, after Spark has put in the
casts that mixed types need.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rule = str | Column

#: Expressions that never fail, whatever the row; a cast is looked at more closely.
PLAIN = frozenset(
    """
    Alias And ArrayContains ArrayDistinct ArrayExists ArrayForAll ArrayFilter AttributeReference CaseWhen Coalesce Concat
    Contains EndsWith EqualNullSafe EqualTo GetMapValue GetStructField GreaterThan GreaterThanOrEqual If In InSet IsNaN
    IsNotNull IsNull LambdaFunction Length LessThan LessThanOrEqual Literal Lower MapContainsKey MapEntries MapKeys
    MapValues NamedLambdaVariable Not NullIf Or Size StartsWith StringTrim StringTrimLeft StringTrimRight Substring Upper
    TryAdd TryDivide TryMod TryMultiply TrySubtract
    """.split()
)
#: Functions that are casts by another name, and functions that have a form which does not fail.
CASTS = frozenset(["boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp"])
TRIED = {"element_at": "try_element_at", "to_timestamp": "try_to_timestamp", "to_number": "try_to_number", "to_binary": "try_to_binary", "parse_url": "try_parse_url"}
ARITHMETIC = {"Add": "try_add", "Subtract": "try_subtract", "Multiply": "try_multiply", "Divide": "try_divide", "Remainder": "try_mod"}
#: Expressions that are NULL where an operand is.
STRICT = frozenset("And Cast EqualTo GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual Not Or".split())
#: Functions whose condition may fail on one element and yet be decided by another.
ABSORBING = frozenset(["exists", "any", "forall", "every"])


def as_column(rule: Rule) -> Column:
    """Return the rule as a Column."""
    return F.expr(rule) if isinstance(rule, str) else rule


class _Trees:
    """Parsed expressions of one session."""

    def __init__(self, spark: SparkSession, schema: T.StructType) -> None:
        self.spark, self.schema = spark, schema
        self.jvm = spark.sparkContext._jvm
        self.catalyst = self.jvm.org.apache.spark.sql.catalyst.expressions
        self.utils = self.jvm.org.apache.spark.sql.classic.ExpressionUtils

    @functools.cached_property
    def empty(self):
        return self.spark.createDataFrame([], self.schema)

    def parse(self, column: Column):
        return self.spark._jsparkSession.expression(column._jc)

    def column(self, tree) -> Column:
        from pyspark.sql.classic.column import Column as Classic

        return Classic(self.utils.column(tree))

    @staticmethod
    def kind(tree) -> str:
        return tree.getClass().getSimpleName()

    @staticmethod
    def children(tree) -> list:
        found = tree.children()
        return [found.apply(k) for k in range(found.size())]

    def with_children(self, tree, children: Sequence):
        as_seq = self.jvm.scala.jdk.javaapi.CollectionConverters.asScala(list_of(self.jvm, children)).toSeq()
        return tree.withNewChildren(as_seq)

    def is_list(self, tree) -> bool:
        """Return whether an expression over the schema is a list."""
        try:
            return isinstance(self.empty.select(self.column(tree)).schema[0].dataType, T.ArrayType)
        except AnalysisException:
            return False

    def call(self, name: str, *children):
        """Return an unresolved call of a function."""
        made = self.parse(F.expr(f"{name}({', '.join('null' for _ in children)})"))
        return self.with_children(made, children)

    def function(self, tree) -> str:
        """Return the name of an unresolved function in lower case, '' for any other expression."""
        return tree.nameParts().mkString(".").lower() if self.kind(tree) == "UnresolvedFunction" else ""

    # The rewrite

    def tried(self, tree):
        """Return the tree with casts, arithmetic and the like in the forms that yield NULL instead of failing.

        Only as far down as everything above is NULL where an operand is:
        beyond, as below ``coalesce`` or ``IS NULL`` or within a function over
        elements, the NULL would not be known for a failure any more.
        """
        kind, name = self.kind(tree), self.function(tree)
        if kind == "UnresolvedExtractValue":
            held, place = self.children(tree)
            return self.call("get", self.tried(held), self.tried(place)) if self.is_list(held) else tree
        if kind not in STRICT and kind not in ARITHMETIC and name not in CASTS and name not in TRIED:
            return tree
        old = self.children(tree)
        new = [self.tried(child) for child in old]
        if kind in ARITHMETIC:
            return self.call(ARITHMETIC[kind], *new)
        if kind == "Cast":
            return self.try_cast(new[0], tree.dataType().sql())
        if name in CASTS and len(new) == 1:
            return self.try_cast(new[0], "decimal(10,0)" if name == "decimal" else name)
        if name in TRIED:
            return self.call(TRIED[name], *new)
        return self.with_children(tree, new) if new else tree

    def try_cast(self, child, type_name: str):
        return self.with_children(self.parse(F.expr(f"try_cast(null AS {type_name})")), [child])

    def guarded(self, tree):
        """Guard the operands of a condition one by one."""
        if self.kind(tree) in ("And", "Or", "Not"):
            return self.with_children(tree, [self.guarded(child) for child in self.children(tree)])
        return tree if self.is_plain(tree) else self.alone(tree)

    def alone(self, tree):
        """Evaluate a condition by itself: NULL where it fails.

        It runs as the body of a function over an array, as generated code
        would otherwise work out what several conditions share ahead of all
        of them, and fail there.
        """
        held = self.column(self.catalyst.TryEval(self.inner(tree)))
        return self.parse(F.transform(F.array(F.lit(True)), lambda _: held).getItem(0))

    def inner(self, tree):
        """Guard the conditions on elements inside ``exists`` and ``forall``."""
        children = self.children(tree)
        if self.kind(tree) == "LambdaFunction":
            return tree
        if self.function(tree) in ABSORBING and len(children) == 2 and self.kind(children[1]) == "LambdaFunction":
            body, *names = self.children(children[1])
            children[1] = self.with_children(children[1], [self.element(body), *names])
            children[0] = self.inner(children[0])
            return self.with_children(tree, children)
        return self.with_children(tree, [self.inner(child) for child in children]) if children else tree

    def element(self, tree):
        if self.kind(tree) in ("And", "Or", "Not"):
            return self.with_children(tree, [self.element(child) for child in self.children(tree)])
        # A form that yields NULL costs far less than one that fails, element by element.
        return self.catalyst.TryEval(self.inner(self.tried(tree)))

    # What can fail

    def is_plain(self, tree) -> bool:
        """Return whether nothing in a condition can fail, once analysed over the schema."""
        try:
            analysed = self.empty.select(self.column(tree))._jdf.queryExecution().analyzed().expressions().apply(0)
        except AnalysisException:
            return False  # columns beyond the schema, perhaps; the caller's analysis tells
        nodes = json.loads(analysed.toJSON())
        names = {node["class"].rpartition(".")[2] for node in nodes}
        if "Cast" not in names:
            return names <= PLAIN | {"Add", "Subtract", "Multiply", "Divide", "Remainder"} if self.has_tried(names) else names <= PLAIN
        arithmetic = {"Add", "Subtract", "Multiply", "Divide", "Remainder"} if self.has_tried(names) else set()
        return names <= PLAIN | arithmetic | {"Cast"} and self.casts_hold(analysed)

    @staticmethod
    def has_tried(names: set[str]) -> bool:
        # Sums stand below the try_ form that they came from; the rewrite has left no others.
        return any(name.startswith("Try") for name in names)

    def casts_hold(self, tree) -> bool:
        if self.kind(tree) == "Cast" and tree.evalMode().toString() == "ANSI":
            source, target = tree.child().dataType(), tree.dataType()
            if not self.catalyst.Cast.canUpCast(source, target):
                return False
        return all(self.casts_hold(child) for child in self.children(tree))


def list_of(jvm, items: Sequence):
    found = jvm.java.util.ArrayList()
    for item in items:
        found.add(item)
    return found


def once(condition: Column, then: Callable[[Column], Column]) -> Column:
    """Use a condition several times in an expression and evaluate it once."""
    return F.transform(F.array(condition), lambda held: then(held)).getItem(0)


def dear(condition: Column) -> bool:
    """Return whether a condition goes through the elements of a list, or is evaluated by itself."""
    return "lambda" in str(SparkSession.active()._jsparkSession.expression(condition._jc).toString())


def guarded(rules: Sequence[Rule], schema: T.StructType) -> list[Column]:
    """Return the rules as conditions that are NULL where their evaluation fails."""
    trees = _Trees(SparkSession.active(), schema)
    found = []
    for rule in rules:
        tree = trees.parse(as_column(rule))
        if trees.is_plain(tree):
            found.append(as_column(rule))
        else:
            found.append(trees.column(trees.guarded(trees.tried(tree))))  # AND, OR and NOT keep what each operand says
    return found
