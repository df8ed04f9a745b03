"""Tree patterns over a node table, as chains of equi-joins.

A pattern is a Python value. Each nested node becomes a join of children to
parents on (file, parent id), each predicate a filter below its join, each
capture a row. A child that may be missing is an outer join, one that must be
missing an anti join. A repeated child is a run of adjacent siblings: the rank
of a sibling less its rank among those that fit is the same all along a run, so
runs are groups, and tests of their texts are tests of arrays.

Nothing is broadcast by hint; a parent that holds a large share of all nodes as
children is a skewed join key, which adaptive execution splits (see
``srcatlas.session``). A run is one row, and its siblings are ranked in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from srcatlas.operators.structural import limited


@dataclass(frozen=True)
class Node:
    """One node of a pattern.

    ``type`` may be a list of alternatives. ``eq``, ``not_eq``, ``match``,
    ``not_match``, ``any_of`` and ``none_of`` test the text of the node.

    ``repeated`` stands for a run of one or more adjacent siblings of the given
    type and field, as long as possible; the tests of text must hold for all of
    them, those with ``some_`` for one at least. ``optional`` lets a match do
    without the child where there is none (with ``repeated``: zero or more).
    ``absent`` asks that the parent has no such child, wherever it might stand.
    A repeated node has no children of its own, an absent one no captures.
    """

    type: str | Sequence[str] | None = None
    field: str | None = None
    eq: str | None = None
    not_eq: str | None = None
    match: str | None = None
    not_match: str | None = None
    any_of: Sequence[str] | None = None
    none_of: Sequence[str] | None = None
    some_eq: str | None = None
    some_not_eq: str | None = None
    some_match: str | None = None
    some_not_match: str | None = None
    capture: str | None = None
    children: Sequence["Node | AnyOf"] = ()
    optional: bool = False
    repeated: bool = False
    absent: bool = False

    def place(self) -> Column:
        """Whether type and field fit."""
        out = F.lit(True)
        if isinstance(self.type, str):
            out = out & (F.col("type") == self.type)
        elif self.type is not None:
            out = out & F.col("type").isin(list(self.type))
        if self.field is not None:
            out = out & (F.col("field") == self.field)
        return out

    def says(self, text: Column) -> Column:
        """Whether one text passes the tests that every text must pass."""
        out = F.lit(True)
        if self.eq is not None:
            out = out & (text == self.eq)
        if self.not_eq is not None:
            out = out & (text != self.not_eq)
        if self.match is not None:
            out = out & text.rlike(self.match)
        if self.not_match is not None:
            out = out & ~text.rlike(self.not_match)
        if self.any_of is not None:
            out = out & text.isin(list(self.any_of))
        if self.none_of is not None:
            out = out & ~text.isin(list(self.none_of))
        return out

    def some(self) -> list:
        """Tests that one text of a run must pass."""
        tests = ((self.some_eq, lambda t: t == self.some_eq), (self.some_not_eq, lambda t: t != self.some_not_eq),
                 (self.some_match, lambda t: t.rlike(self.some_match)), (self.some_not_match, lambda t: ~t.rlike(self.some_not_match)))
        return [test for value, test in tests if value is not None]

    def test(self) -> Column:
        """Whether a single node fits."""
        text = F.coalesce(F.col("text"), F.lit(""))
        out = self.place() & self.says(text)
        for test in self.some():
            out = out & test(text)
        return out

    def selective(self) -> int:
        tests = (self.eq, self.any_of, self.match, self.field, self.not_eq, self.not_match, self.none_of)
        return sum(t is not None for t in tests)


@dataclass(frozen=True)
class AnyOf:
    """Alternatives for one place of a pattern."""

    options: Sequence[Node]


def variants(pattern: Node | AnyOf) -> list[Node]:
    """The patterns without alternatives that a pattern stands for."""
    if isinstance(pattern, AnyOf):
        return [v for option in pattern.options for v in variants(option)]
    out = [replace(pattern, children=())]
    for child in pattern.children:
        out = [replace(v, children=(*v.children, c)) for v in out for c in variants(child)]
    return out


_CAPTURED = "array<struct<pos:bigint,node_id:bigint,text:string,start_line:bigint,end_line:bigint>>"


def _checked(pattern: Node, top: bool = True) -> None:
    if top and (pattern.optional or pattern.repeated or pattern.absent):
        raise ValueError("only a child can be optional, repeated or absent")
    if pattern.repeated and pattern.children:
        raise ValueError("a repeated node has no children of its own")
    if pattern.absent and (pattern.optional or pattern.repeated or _captures(pattern, "n")):
        raise ValueError("an absent node is neither optional nor repeated and has no captures")
    for child in pattern.children:
        _checked(child, top=False)


def _runs(nodes: DataFrame, pattern: Node, name: str) -> DataFrame:
    """The longest runs of adjacent siblings that fit, keyed by their parent."""
    siblings = Window.partitionBy("file", "parent_id").orderBy("pos", "node_id")
    ranked = nodes.where("parent_id IS NOT NULL").select(
        "file", "parent_id", "pos", pattern.place().alias("fits"),
        F.struct("pos", "node_id", F.coalesce("text", F.lit("")).alias("text"), "start_line", "end_line").alias("node"),
        F.row_number().over(siblings).alias("nth"))
    among = Window.partitionBy("file", "parent_id", "fits").orderBy("nth")
    runs = ranked.select("*", (F.col("nth") - F.row_number().over(among)).alias("run")).where("fits").groupBy("file", "parent_id", "run").agg(
        F.array_sort(F.collect_list("node")).alias("nodes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    runs = runs.where(F.forall("nodes", lambda n: pattern.says(n["text"])))
    for test in pattern.some():
        runs = runs.where(F.exists(F.transform("nodes", lambda n: n["text"]), test))
    return runs.select("file", F.col("parent_id").alias(f"{name}_parent"), F.col("first").alias(f"{name}_pos"),
                       F.col("last").alias(f"{name}_last"), F.col("nodes").alias(f"{name}_nodes"))


def _rows(nodes: DataFrame, pattern: Node, name: str) -> DataFrame:
    """Matches of ``pattern``, keyed by its own node: columns prefixed.

    ``<name>_nodes`` holds what the node captures, more than one in a run.
    """
    if pattern.repeated:
        return _runs(nodes, pattern, name)
    here = [F.col("file"), F.col("node_id").alias(f"{name}_id"), F.col("parent_id").alias(f"{name}_parent"),
            F.col("pos").alias(f"{name}_pos"), F.col("pos").alias(f"{name}_last")]
    if pattern.capture:
        here.append(F.array(F.struct("pos", "node_id", F.coalesce("text", F.lit("")).alias("text"), "start_line", "end_line")).alias(f"{name}_nodes"))
    out = nodes.where(pattern.test()).select(*here)
    # What must be there comes first, the most selective child ahead: later joins then see fewer rows.
    # Optional children follow in their own order, each after what is found of those before it.
    order = sorted(range(len(pattern.children)), key=lambda i: (
        pattern.children[i].absent, pattern.children[i].optional, i if pattern.children[i].optional else -pattern.children[i].selective()))
    joined = []
    for i in order:
        inner_pattern, child = pattern.children[i], f"{name}{i}"
        inner = _rows(nodes, inner_pattern, child).withColumnsRenamed({"file": f"{child}_file"})
        on = (F.col("file") == F.col(f"{child}_file")) & (F.col(f"{name}_id") == F.col(f"{child}_parent"))
        if inner_pattern.absent:
            out = out.join(inner, on, "left_anti")
            continue
        # Children match distinct siblings in source order.
        for j in joined:
            first, second = (j, i) if j < i else (i, j)
            ahead = F.col(f"{name}{first}_last") < F.col(f"{name}{second}_pos")
            on = on & (ahead | F.col(f"{name}{j}_pos").isNull() if pattern.children[j].optional else ahead)
        joined.append(i)
        out = out.join(inner, on, "left" if inner_pattern.optional else "inner").drop(f"{child}_file", f"{child}_parent")
    return out


def _captures(pattern: Node, name: str) -> list[tuple[str, str]]:
    own = [(pattern.capture, name)] if pattern.capture else []
    return own + [c for i, child in enumerate(pattern.children) for c in _captures(child, f"{name}{i}")]


def _single(nodes: DataFrame, pattern: Node, same: Sequence[tuple[str, str]], different: Sequence[tuple[str, str]]) -> DataFrame:
    rows, at = _rows(nodes, pattern, "n"), dict(_captures(pattern, "n"))

    def held(capture: str) -> Column:
        return F.coalesce(f"{at[capture]}_nodes", F.array().cast(_CAPTURED))

    def pairs(left: str, right: str, test) -> Column:
        return F.forall(held(left), lambda a: F.forall(held(right), lambda b: test(a["text"], b["text"])))

    def labelled(capture: str) -> Column:
        return F.transform(held(capture), lambda n: F.struct(
            F.lit(f"@{capture}").alias("capture"), n["text"].alias("text"), n["start_line"].alias("start_line"), n["end_line"].alias("end_line")))

    for left, right in same:
        rows = rows.where(pairs(left, right, lambda a, b: a == b))
    for left, right in different:
        rows = rows.where(pairs(left, right, lambda a, b: a != b))
    captures = F.concat(*[labelled(capture) for capture, _ in _captures(pattern, "n")])
    return rows.select("file", F.col("n_pos").alias("pos"), F.posexplode(captures).alias("capture_ix", "c")).select("file", "pos", "capture_ix", "c.*")


def match_nodes(nodes: DataFrame, *patterns: Node | AnyOf, same: Sequence[tuple[str, str]] = (),
                different: Sequence[tuple[str, str]] = (), limit: int | None = None) -> DataFrame:
    """Captures of one or more tree patterns, one row per capture of a match.

    ``same`` and ``different`` compare the texts of two captures, each with each
    where one is a run; a missing child passes. The children of a pattern match
    distinct children of a node, in the order of ``pos``; others may lie between
    them. Captures of a missing child give no rows.
    """
    out = None
    for pattern in patterns:
        for variant in variants(pattern):
            if not _captures(variant, "n"):
                raise ValueError("a tree pattern needs at least one capture")
            _checked(variant)
            rows = _single(nodes, variant, same, different)
            out = rows if out is None else out.unionByName(rows)
    return limited(out, limit)
