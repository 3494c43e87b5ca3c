"""Matching thousands of flows in one pass.

One expression a flow does not scale: a plan of thousands of rules is too large
for generated code, and each event evaluates all of them. Flows are mostly
alike, though. So:

* a comparison of a field with a text, ``field = 'x'`` or ``field IN (...)``,
  in the first rule of a flow is its key. The keys of all flows are a table,
  and an event looks up its own value of each field that occurs in one, which
  yields the few flows that can match;
* what else the rules say is grouped by its form, with the constants that are
  compared taken out as parameters. There are as many expressions as forms,
  and an event evaluates them for the flows that it found only.

A false operand makes a conjunction false whatever the others are, errors
included, so an event that does not have the key of a flow is no match of it
and no error. Only fields that are never NULL can be keys.
"""

from __future__ import annotations

import functools
import json
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.fields import TOP_LEVEL_STRINGS
from eventloom.operators.filters import EVAL_ERROR, MATCHED, UNMATCHED, RuleError, check_rules
from eventloom.operators.guard import _Trees, as_column
from eventloom.plans.spec import Flow
from eventloom.schema import REFERENCE_FIELDS

#: Fields that a canonical event always has.
KEY_FIELDS = {*TOP_LEVEL_STRINGS, *(f"regarding.{name}" for name in REFERENCE_FIELDS)}
#: Comparisons whose constants are parameters.
_COMPARED = frozenset("EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual".split())

_WRITTEN = frozenset("string byte short integer long double boolean".split())

_ENTRY = T.StructType(
    [
        T.StructField("flow", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("sinks", T.ArrayType(T.StringType())),
        T.StructField("watches", T.ArrayType(T.StringType())),
        T.StructField("form", T.IntegerType()),
        T.StructField("params", T.ArrayType(T.StringType())),
    ]
)


@dataclass
class _Node:
    """An expression as Spark's parser wrote it down, with its place in the order of the text."""

    kind: str
    facts: dict
    children: list[_Node] = field(default_factory=list)
    place: int = 0

    @staticmethod
    def read(tree) -> _Node:
        nodes = json.loads(tree.toJSON())
        at = iter(range(len(nodes)))

        def one() -> _Node:
            place = next(at)
            facts = nodes[place]
            node = _Node(facts["class"].rpartition(".")[2], facts, place=place)
            node.children = [one() for _ in range(facts["num-children"])]
            return node

        return one()

    def path(self) -> str:
        """The dotted name of a field, '' for any other expression."""
        if self.kind != "UnresolvedAttribute":
            return ""
        parts = self.facts["nameParts"]
        return ".".join(parts if isinstance(parts, list) else parts.strip("[]").split(", "))

    def text(self) -> str | None:
        return self.facts["value"] if self.kind == "Literal" and self.facts["dataType"] == "string" else None

    def key(self) -> tuple[str, list[str]] | None:
        """The field and the texts of a comparison that can be looked up."""
        if self.kind not in ("EqualTo", "In") or not self.children:
            return None
        name, *values = self.children
        if self.kind == "EqualTo" and name.kind == "Literal":
            name, values = values[0], [name]
        texts = [value.text() for value in values]
        return (name.path(), texts) if name.path() in KEY_FIELDS and texts and None not in texts else None

    def conjuncts(self) -> list[_Node]:
        return [part for child in self.children for part in child.conjuncts()] if self.kind == "And" else [self]

    def plain_constant(self) -> bool:
        """Whether it is a constant that its text gives back."""
        return self.kind == "Literal" and self.facts["value"] is not None and self.facts["dataType"] in _WRITTEN

    def parameters(self, keyed: int | None) -> list[_Node]:
        """The constants that are compared, without those of the key."""
        if self.place == keyed:
            return []
        own = [child for child in self.children if child.plain_constant()] if self.kind in _COMPARED and len(self.children) == 2 else []
        if len(own) == 2:
            own = []  # two constants are left for Spark to fold
        return own + [found for child in self.children for found in child.parameters(keyed)]

    def form(self, keyed: int | None, free: frozenset[int]) -> object:
        """What the expression is without its key and parameters."""
        if self.place == keyed:
            return "key"
        if self.place in free:
            return ["parameter", self.facts["dataType"]]
        facts = {name: value for name, value in sorted(self.facts.items()) if name != "origin"}
        return [self.kind, json.dumps(facts, sort_keys=True), [child.form(keyed, free) for child in self.children]]


@dataclass
class _Form:
    """Rules that differ in parameters only; ``rules`` are those of the first flow that has them."""

    rules: Sequence
    keyed: int | None
    free: list[frozenset[int]]


class FlowIndex:
    """Flows by their keys and forms, for events of one schema."""

    def __init__(self, spark: SparkSession, flows: Sequence[Flow], schema: T.StructType) -> None:
        self.trees = _Trees(spark, schema)
        self.forms: list[_Form] = []
        self.keys: dict[str, dict[str, list[dict]]] = defaultdict(lambda: defaultdict(list))
        self.unkeyed: list[dict] = []
        known: dict[str, int] = {}
        for number, flow in enumerate(sorted(flows, key=lambda flow: flow.name)):
            nodes = [_Node.read(self.trees.parse(as_column(rule))) for rule in flow.filters]
            keyed = next(((node.place, node.key()) for node in (nodes[0].conjuncts() if nodes else []) if node.key()), (None, None))
            found = [node.parameters(keyed[0] if k == 0 else None) for k, node in enumerate(nodes)]
            free = [frozenset(literal.place for literal in literals) for literals in found]
            form = json.dumps([node.form(keyed[0] if k == 0 else None, free[k]) for k, node in enumerate(nodes)])
            if form not in known:
                check_rules(spark, flow.filters, schema)
                known[form] = len(self.forms)
                self.forms.append(_Form(flow.filters, keyed[0], free))
            params = [literal.facts["value"] for literals in found for literal in sorted(literals, key=lambda node: node.place)]
            watches = None if flow.watches is None else list(flow.watches)
            entry = {"flow": number, "name": flow.name, "sinks": list(flow.sinks), "watches": watches, "form": known[form], "params": params}
            if keyed[1] is None:
                self.unkeyed.append(entry)
            for value in set(keyed[1][1]) if keyed[1] else ():
                self.keys[keyed[1][0]][value].append(entry)

    def _verdict(self, form: _Form, entry: Column) -> Column:
        """The verdict of a form's rules with an entry's parameters."""
        trees, taken = self.trees, 0

        def filled(tree, keyed: int | None, free: frozenset[int]):
            nonlocal taken
            order = iter(range(1 << 30))

            def walk(node):
                nonlocal taken
                place = next(order)
                if place == keyed:
                    for _ in range(_size(node) - 1):
                        next(order)
                    return trees.parse(F.lit(True))
                if place in free:
                    taken += 1
                    return trees.parse(entry["params"].getItem(taken - 1).cast(node.dataType().sql()))
                children = trees.children(node)
                return trees.with_children(node, [walk(child) for child in children]) if children else node

            def _size(node) -> int:
                return 1 + sum(_size(child) for child in trees.children(node))

            return walk(tree)

        conditions = []
        for k, rule in enumerate(form.rules):
            tree = filled(trees.parse(as_column(rule)), form.keyed if k == 0 else None, form.free[k])
            conditions.append(trees.column(trees.guarded(trees.tried(tree))))
        decided = F.lit(MATCHED)
        for held in reversed(conditions):
            decided = F.when(held.isNull(), F.lit(EVAL_ERROR)).when(~held, F.lit(UNMATCHED)).otherwise(decided)
        return decided

    def match(self, events: DataFrame) -> DataFrame:
        """Add ``verdicts``, of the flows that match or fail to evaluate, and ``sinks``, as :func:`match_many` says."""
        spark, found = events.sparkSession, events
        lists = []
        for number, (path, values) in enumerate(sorted(self.keys.items())):
            # One row for each value that a rule names: definitions, not data.
            table = spark.createDataFrame(list(values.items()), T.StructType([T.StructField(f"_key{number}", T.StringType()), T.StructField(f"_flows{number}", T.ArrayType(_ENTRY))]))
            found = found.join(F.broadcast(table), F.col(path) == F.col(f"_key{number}"), "left")
            lists.append(F.coalesce(f"_flows{number}", F.array().cast(T.ArrayType(_ENTRY))))
        if self.unkeyed or not lists:
            lists.append(F.from_json(F.lit(json.dumps(self.unkeyed)), T.ArrayType(_ENTRY)))
        watch = F.col("watch") if "watch" in events.columns else F.lit(None).cast("string")
        bound = F.filter(F.concat(*lists), lambda e: e["watches"].isNull() | F.coalesce(F.array_contains(e["watches"], watch), F.lit(False)))

        def judged(entry: Column) -> Column:
            cases = functools.reduce(
                lambda rest, k: F.when(entry["form"] == k, self._verdict(self.forms[k], entry)).otherwise(rest),
                reversed(range(len(self.forms))),
                F.lit(UNMATCHED),
            )
            return F.struct(entry["flow"].alias("number"), entry["name"].alias("flow"), cases.alias("verdict"), entry["sinks"].alias("sinks"))

        said = F.sort_array(F.filter(F.transform(bound, judged), lambda v: v["verdict"] != UNMATCHED))
        verdicts = F.transform("_said", lambda v: F.struct(v["flow"].alias("flow"), v["verdict"].alias("verdict")))
        reached = F.flatten(F.transform(F.filter("_said", lambda v: v["verdict"] == MATCHED), lambda v: v["sinks"]))
        return found.withColumn("_said", said).select(*(events[name] for name in events.columns), verdicts.alias("verdicts"), F.array_distinct(reached).alias("sinks"))


def match_many(events: DataFrame, flows: Sequence[Flow]) -> DataFrame:
    """Evaluate every flow like :func:`~eventloom.operators.routing.match`, for many flows.

    The sinks are the same. ``verdicts`` holds entries only for the flows that
    match and for those whose evaluation fails, in name order, which is what
    :func:`~eventloom.operators.routing.verdict_counts` counts.
    """
    names = [flow.name for flow in flows]
    if len(set(names)) != len(names):
        raise RuleError("a flow name is given twice")
    return FlowIndex(events.sparkSession, flows, events.schema).match(events)
