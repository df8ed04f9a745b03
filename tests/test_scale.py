"""What grows with a corpus is spread: joins by path, rendering, partitions, the node table."""

import importlib

import pytest
from pyspark.sql import functions as F

from corpora import spark as cs
from helpers import corpus
from srcatlas import configure
from srcatlas.functions import lexers
from srcatlas.operators import structural
from srcatlas.operators.declarations import extract_symbols
from srcatlas.operators.nodes import nodes_from_source
from srcatlas.operators.tokens import tokenize
from srcatlas.plans import index as plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def parts(spark, folder, n=40):
    spark.range(1, n + 1).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "'Brand#1' AS p_brand", "'A' AS p_type").coalesce(1).write.parquet(
        f"{folder}/part.parquet")
    return str(folder)


@pytest.fixture
def unset(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_paths_are_not_broadcast(spark):
    files = corpus(spark, {"a.py": "def f(): pass\n", "b.py": "def g(): pass\n"})
    index = plans.rebuild_index(files)
    for out in (plans.prune_deleted(index, files.where("path = 'a.py'")), plans.refresh_index(index, files), plans.upsert_files(index, files, index.symbols)):
        assert "Broadcast" not in plan(out.files) and "Broadcast" not in plan(out.symbols)
    assert [r.name for r in plans.prune_deleted(index, files.where("path = 'a.py'")).symbols.collect()] == ["f"]


def test_sources_are_not_broadcast(spark):
    files = corpus(spark, {"a.js": "f(1);\nfunction g() { h(2); }\n"})
    calls = structural.find_calls(files, None, "javascript")
    assert "Broadcast" not in plan(calls) and "Broadcast" not in plan(nodes_from_source(files, "javascript"))
    assert sorted(r.text for r in calls.where("capture = '@call'").collect()) == ["f(1)", "h(2)"]


def test_nodes_are_stored_once(spark, tmp_path, unset):
    entry, folder = importlib.import_module("__spark_entry__"), parts(spark, tmp_path, 6)
    out = entry.match_code(spark, folder)
    assert "Window" not in plan(out) and "Generate posexplode(regexp" not in plan(out)
    assert sorted({r.text for r in out.where("capture = '@callee'").collect()}) == sorted(f"{n}_{k}" for k in range(1, 7) for n in ("helper", "go"))


def test_partitions_follow_the_text(spark, tmp_path, unset):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    configure(spark, 30 << 20)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "31"
    configure(spark, 100 << 40)
    assert spark.conf.get("spark.sql.shuffle.partitions") == str((100 << 40) // (64 << 20) + 1)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    template = {"go": ["package p // {k} {n} " + "x" * (1 << 16)]}
    files = cs.part_files(spark, parts(spark, tmp_path), "go", template)
    text = files.agg(F.sum(F.octet_length("content"))).first()[0]
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) == (text >> 20) + 1 > 2
    assert "hashpartitioning(p_partkey" in plan(files)


def test_files_of_one_hash_prefix_stay_apart(spark):
    texts = {f"proj/long/common/prefix/f{i}.py": f"def f{i}():\n    g{i}()\n" for i in range(50)}
    rows = tokenize(corpus(spark, texts)).where("cls = 'ident'").collect()
    assert sorted((r.file, r.line, r.text) for r in rows) == sorted(
        (p, line, t) for i, p in enumerate(texts) for line, t in ((1, "def"), (1, f"f{i}"), (2, f"g{i}")))


def test_arms_of_directives_are_windows_over_directives(spark):
    text = "#if A\nint f(int a) {\n#else\nint f(long a) {\n#endif\n  g();\n}\nint h(int b) { return b; }\n"
    found = extract_symbols(corpus(spark, {"a.c": text, "b.cpp": text, "c.c": text.replace("#", "// #"), "d.py": "def f(): pass\n"}), ordered=False)
    tokens = plan(found).split("Generate posexplode")
    # Files are read and exchanged once; their tokens are sorted by position, by level, and for Rust's macros.
    assert len(tokens) == 2 and "Union" not in plan(found) and plan(found).count("REPARTITION_BY_NUM") == 1
    assert tokens[0].count("Sort [") == 3
    assert sorted((r.file, r.name, r.line) for r in found.collect() if r.file < "c") == sorted(
        (file, *row) for file in ("a.c", "b.cpp") for row in (("f", 2), ("f", 4), ("h", 8)))


def test_files_are_cut_once_for_nodes(spark):
    files = corpus(spark, {"a.rs": "fn f() { g(h[1]); }\n", "b.rs": "fn i() {}\n"})
    nodes = nodes_from_source(files, "rust")
    assert plan(nodes).count("posexplode(") == plan(tokenize(files, "rust")).count("posexplode(")
    assert sorted(r.text for r in nodes.where("type IN ('fn', 'call', 'square')").collect()) == ["[1]", "fn f() { g(h[1]); }", "fn i() {}", "g(h[1])"]
    twice = nodes_from_source(files.unionByName(files.where("path = 'b.rs'")), "rust")
    assert twice.where("file = 'b.rs' AND text = 'i'").count() == 2


def test_calls_take_one_sort_by_level(spark):
    text = "def f(a):\n    match g(1):\n        case P(x) | Q(h(y)) if ok(x):\n            z(k[0](2))\n"
    calls = structural.find_calls(corpus(spark, {"a.py": text}), None, "python")
    assert plan(calls).count("Sort [fid") == 4 and "DESC" not in plan(calls)
    assert sorted(r.text for r in calls.where("capture = '@call'").collect()) == ["g(1)", "ok(x)", "z(k[0](2))"]


def test_long_files_are_cut_in_steps(spark, monkeypatch):
    texts = {"a.py": "x = f'a {f(1)} b' + \"c\"\n'''d\n''' \\\n" * 9 + "def e(): pass\n", "b.rs": "fn a<'b>() { 'c'; r#\"d\"# } /* e /* f */ */\n" * 9 + "'", "c.go": "", "d.js": "/a/; b / c\n"}
    files = corpus(spark, texts)
    langs = ("python", "rust", "go", "javascript")
    whole = {lang: sorted(map(tuple, tokenize(files, lang).collect())) for lang in langs}
    monkeypatch.setattr(lexers, "LONG", 10)
    monkeypatch.setattr(lexers, "STEP", 7)
    for lang in langs:
        rows = tokenize(files, lang)
        assert sorted(map(tuple, rows.collect())) == whole[lang]
        # Steps come out of a sort, one by one: rows that one row is exploded into are all held.
        assert ("{1,7}" in plan(rows)) == (lang != "javascript") and "Sort [" in plan(rows).split("Generate posexplode")[1]
