"""Tree patterns against brute force, with one parent holding most nodes."""

from collections import Counter

import pytest

from srcatlas.operators.tree import AnyOf, Node, match_nodes
from srcatlas.schema import NODES


def _nodes():
    rows = [("f", 0, None, None, "root", "r", 1, 1, 0)]
    for p in range(1, 6):
        rows.append(("f", p, 0, None, "call", f"c{p}", p, p, p))
        for i in range(300 if p == 1 else 3):
            n = 1000 * p + i
            rows.append(("f", n, p, "arg" if i % 2 else None, "leaf" if i % 3 else "name", f"t{i % 4}", p, p, n))
    return rows


def test_against_brute_force(spark):
    rows = _nodes()
    pattern = Node("call", capture="c", children=[Node("name", eq="t0", capture="n"), Node("leaf", field="arg", capture="l")])
    got = Counter((r.capture, r.text) for r in match_nodes(spark.createDataFrame(rows, NODES), pattern, limit=None).collect())
    want = Counter()
    for c in (r for r in rows if r[4] == "call"):
        kids = [r for r in rows if r[2] == c[1]]
        for n in (k for k in kids if k[4] == "name" and k[5] == "t0"):
            for leaf in (k for k in kids if k[4] == "leaf" and k[3] == "arg" and k[8] > n[8]):
                want.update([("@c", c[5]), ("@n", n[5]), ("@l", leaf[5])])
    assert got == want and want


def test_siblings_are_distinct_and_in_order(spark):
    rows = [("f", 0, None, None, "call", "c", 1, 1, 0)] + [("f", i, 0, None, "num", str(i), 1, 1, i) for i in (1, 2, 3)]
    three = Node("call", children=[Node("num", capture="a"), Node("num", capture="b", not_eq="9"), Node("num", capture="c")])
    pair = Node("call", children=[Node("num", capture="a"), Node("num", capture="b")])
    nodes = spark.createDataFrame(rows, NODES)
    assert sorted((r.capture, r.text) for r in match_nodes(nodes, three).collect()) == [("@a", "1"), ("@b", "2"), ("@c", "3")]
    assert Counter((r.capture, r.text) for r in match_nodes(nodes, pair).collect()) == {
        ("@a", "1"): 2, ("@a", "2"): 1, ("@b", "2"): 1, ("@b", "3"): 2}


def test_same_different_and_limit(spark):
    nodes = spark.createDataFrame(_nodes(), NODES)
    pair = Node("call", children=[Node("name", capture="a"), Node("leaf", capture="b")])
    every = match_nodes(nodes, pair, limit=None).count()
    same = match_nodes(nodes, pair, same=[("a", "b")], limit=None).count()
    assert 0 < same < every == same + match_nodes(nodes, pair, different=[("a", "b")], limit=None).count()
    assert match_nodes(nodes, AnyOf([pair, Node("name", capture="x")]), limit=500).count() == 500


def _tree(children):
    """One parent a file; a child is (type, text)."""
    rows = []
    for f, kids in children.items():
        rows.append((f, 0, None, None, "call", "c", 1, 1, 0))
        rows += [(f, i, 0, None, kind, text, i, i, i) for i, (kind, text) in enumerate(kids, 1)]
    return rows


KIDS = {"a": [("x", "1"), ("x", "2"), ("y", "3"), ("x", "4")], "b": [("y", "1"), ("y", None)], "c": [("x", "1"), ("x", "1")], "d": [], "e": [("z", "9"), ("x", "7")]}


def _found(spark, *patterns, **options):
    got = match_nodes(spark.createDataFrame(_tree(KIDS), NODES), *patterns, **options).collect()
    return sorted((r.file, r.capture, r.text) for r in got)


def test_runs_of_siblings(spark):
    runs = {f: [] for f in KIDS}
    for f, kids in KIDS.items():
        for i, (kind, text) in enumerate(kids):
            if kind == "x":
                runs[f] = runs[f] if i and kids[i - 1][0] == "x" else [*runs[f], []]
                runs[f][-1].append(text)

    def want(test):
        return sorted((f, c, t) for f in runs for run in runs[f] if test(run) for c, t in [("@c", "c"), *[("@x", t) for t in run]])

    def found(**tests):
        return _found(spark, Node("call", capture="c", children=[Node("x", repeated=True, capture="x", **tests)]))

    assert found() == want(lambda r: True) and len(found()) > 8
    assert found(eq="1") == want(lambda r: all(t == "1" for t in r))
    assert found(none_of=["4"]) == want(lambda r: "4" not in r)
    assert found(some_eq="2") == want(lambda r: "2" in r)
    assert found(some_not_eq="1") == want(lambda r: any(t != "1" for t in r))
    assert found(some_match="[47]") == want(lambda r: any(t in "47" for t in r))
    assert found(some_not_match="[1]", match="[12]") == want(lambda r: any(t != "1" for t in r) and all(t in "12" for t in r))


def test_optional_and_absent_children(spark):
    y = Node("y", optional=True, capture="y")
    assert _found(spark, Node("call", capture="c", children=[y])) == sorted(
        [("a", "@c", "c"), ("a", "@y", "3"), ("b", "@c", "c"), ("b", "@c", "c"), ("b", "@y", ""), ("b", "@y", "1"), ("c", "@c", "c"), ("d", "@c", "c"), ("e", "@c", "c")])
    # zero or more x, then a y behind them if there is one
    pattern = Node("call", capture="c", children=[Node("x", repeated=True, optional=True, capture="x"), Node("y", eq="3", optional=True, capture="y")])
    assert [r for r in _found(spark, pattern) if r[0] in "bd"] == [("b", "@c", "c"), ("d", "@c", "c")]
    assert [r for r in _found(spark, pattern) if r[0] == "a"].count(("a", "@c", "c")) == 2
    assert _found(spark, Node("call", capture="c", children=[Node("y", absent=True)])) == [(f, "@c", "c") for f in "cde"]
    assert _found(spark, Node("call", capture="c", children=[Node("x", eq="1"), Node("y", absent=True)])) == [("c", "@c", "c")] * 2


def test_a_missing_child_passes_comparisons(spark):
    pattern = Node("call", children=[Node("x", capture="x"), Node("z", optional=True, capture="z")])
    every = _found(spark, pattern, different=[("x", "z")])
    assert ("c", "@x", "1") in every and not any(r[1] == "@z" for r in every)  # the z stands before the x


@pytest.mark.parametrize("pattern", [
    Node("call", optional=True, capture="c"), Node("call", capture="c", children=[Node("x", repeated=True, children=[Node("y")])]),
    Node("call", capture="c", children=[Node("x", absent=True, capture="x")])])
def test_patterns_that_make_no_sense(spark, pattern):
    with pytest.raises(ValueError):
        match_nodes(spark.createDataFrame(_tree(KIDS), NODES), pattern)


def test_a_pattern_needs_a_capture(spark):
    with pytest.raises(ValueError):
        match_nodes(spark.createDataFrame(_nodes(), NODES), Node("call"))
