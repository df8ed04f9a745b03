"""Node tables from source: trees that hold together, and what lies in what."""

import pytest

from corpora import spark as cs
from helpers import corpus
from srcatlas.operators.nodes import nodes_from_source
from srcatlas.operators.tokens import positioned
from srcatlas.operators.tree import Node, match_nodes

NESTING = {
    "rust": "mod a {\n  pub(crate) fn b<T: X>(c: [T; 3]) -> i32 { d(1, e(2)); self.f(g!(3)); if h(4) { return 5; } }\n  struct S(u8);\n}\nfn i() {}\n",
    "javascript": "export class A {\n  b(c) { return d(c)(e); }\n  static async f() { [1, (2)].map((x) => g(x)); }\n}\nfunction h() { }\n",
    "typescript": "interface A { b: string }\nexport function c(d: number): void { e(d); }\n",
    "go": "package p\nfunc (r R) M(a int) { f(a) }\nfunc g() int {\n\treturn h(1)\n}\n",
    "c": "struct s { int a; };\nint f(struct s x) {\n  g(h(1));\n}\n",
    "cpp": "namespace n {\nclass C { int a; };\nint C::m(int b) { return k(b); }\n}\n",
    "swift": "class A {\n  func b(c: Int) -> Int { d(c) }\n}\n",
}


def _corpus(spark):
    return spark.createDataFrame([(f"t/{lang}", lang, text.encode()) for lang, text in NESTING.items()], "path string, lang string, content binary")


@pytest.mark.parametrize("lang", list(NESTING))
def test_trees_hold_together(spark, lang):
    files = _corpus(spark).unionByName(cs.part_files(spark, "/root/testdata/sf0.001", lang).select("path", "lang", "content").limit(5))
    texts = {r.path: bytes(r.content).decode() for r in files.where(files.lang == lang).collect()}
    nodes = nodes_from_source(files, lang).collect()
    assert len({(r.file, r.node_id) for r in nodes}) == len(nodes)
    by = {(r.file, r.node_id): r for r in nodes}
    for r in nodes:
        if r.parent_id is None:
            assert r.type == "file"
            continue
        up = by[r.file, r.parent_id]
        assert up.type == "file" or up.pos <= r.pos < r.until <= up.until, (r, up)
        assert r.text == texts[r.file][r.pos:r.until], r
        assert r.start_line == 1 + texts[r.file][:r.pos].count("\n") and r.end_line == 1 + texts[r.file][:r.until].count("\n"), r
    siblings = {}
    for r in nodes:
        siblings.setdefault((r.file, r.parent_id), []).append((r.pos, r.until or 0))
    assert all(a[1] <= b[0] for kids in siblings.values() for a, b in zip(sorted(kids), sorted(kids)[1:]))
    # every token is there, a pair of brackets once
    tokens = positioned(files, [lang]).where("cls <> 'comment' AND text NOT IN (')', ']', '}')").count()
    assert tokens == sum(r.node_id % 4 == 0 and r.type != "file" for r in nodes)



def _around(spark, lang):
    nodes = nodes_from_source(_corpus(spark), lang).collect()
    by = {r.node_id: r for r in nodes}
    name = {r.parent_id: r.text for r in nodes if r.field in ("name", "function")}

    def owner(r):
        while r.parent_id is not None:
            r = by[r.parent_id]
            if r.node_id in name:
                return name[r.node_id]
        return None

    return {(r.type, name[r.node_id], owner(r)) for r in nodes if r.node_id in name}


def test_what_lies_in_what(spark):
    assert _around(spark, "rust") == {
        ("mod", "a", None), ("fn", "b", "a"), ("call", "d", "b"), ("call", "e", "d"), ("call", "f", "b"), ("call", "h", "b"), ("struct", "S", "a"), ("fn", "i", None)}
    assert _around(spark, "javascript") == {
        ("class", "A", None), ("method", "b", "A"), ("call", "d", "b"), ("method", "f", "A"), ("call", "map", "f"), ("call", "g", "map"), ("fn", "h", None)}
    assert _around(spark, "go") == {("method", "M", None), ("call", "f", "M"), ("fn", "g", None), ("call", "h", "g")}
    assert _around(spark, "cpp") == {("namespace", "n", None), ("class", "C", "n"), ("fn", "C::m", "n"), ("call", "k", "C::m")}


def test_patterns_over_source(spark):
    nodes = nodes_from_source(_corpus(spark), "rust", texts=True)
    nested = Node("call", capture="outer", children=[Node("parens", field="arguments", children=[
        Node("call", children=[Node("ident", field="function", capture="inner")])])])
    assert sorted((r.capture, r.text, r.start_line) for r in match_nodes(nodes, nested).collect()) == [("@inner", "e", 2), ("@outer", "d(1, e(2))", 2)]
    arguments = Node("call", children=[Node("ident", field="function", eq="e"), Node("parens", children=[Node("number", repeated=True, capture="n")])])
    assert [(r.capture, r.text) for r in match_nodes(nodes, arguments).collect()] == [("@n", "2")]


def test_without_texts_nothing_is_joined(spark):
    nodes = nodes_from_source(_corpus(spark), "go", texts=False)
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and nodes.where("type = 'call' AND text IS NULL").count() == 2
    with pytest.raises(ValueError):
        nodes_from_source(_corpus(spark), "py")


def test_holes_of_strings_are_nodes(spark):
    rows = nodes_from_source(corpus(spark, {"h.js": "function a() { return `x ${f(1)} z`; }\n"}), "javascript").collect()
    assert {r.text for r in rows if r.type == "braces"} == {"{ return `x ${f(1)} z`; }", "{f(1)}"}
    assert [r.text for r in rows if r.type == "call"] == ["f(1)"]
