"""Directory trees, ignore rules, project roots and JSON rows."""

import json
import os

from pyspark.sql import functions as F

from helpers import corpus
from srcatlas.functions.paths import ancestors
from srcatlas.operators import scope
from srcatlas.operators.declarations import extract_symbols
from srcatlas.sources import store, tree


def write(root, files):
    for path, data in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)


def test_tree_keeps_what_spark_would_skip(spark, tmp_path):
    write(tmp_path, {"pkg/__init__.py": b"def init(): pass\n", "_priv/m.py": b"def m(): pass\n",
                     ".hid/h.py": b"def h(): pass\n", "bad.py": b"def ok(): pass\n# \xff\n", "note.txt": b"n"})
    os.utime(tmp_path / "bad.py", ns=(5, 1_700_000_000_123_456_789))
    os.symlink(tmp_path / "pkg", tmp_path / "link")
    rows = {r.path: r for r in tree.scan_corpus(spark, str(tmp_path), shards=2).collect()}
    assert set(rows) == {"pkg/__init__.py", "_priv/m.py", ".hid/h.py", "bad.py", "note.txt"}
    assert (rows["bad.py"].mtime_secs, rows["bad.py"].mtime_nanos) == (1_700_000_000, 123_456_789)
    assert rows["note.txt"].lang is None and rows["bad.py"].content == b"def ok(): pass\n# \xff\n"
    listing = tree.list_corpus(spark, str(tmp_path))
    kept = scope.filter_ignored(listing, spark.createDataFrame([], "dir string, rank bigint, regex string, negated boolean, dir_only boolean"))
    found = extract_symbols(tree.read_contents(kept, str(tmp_path))).collect()
    assert sorted(r.name for r in found) == ["init", "m", "ok"]


def test_ignore_rules(spark):
    lines = [("", 1, "*.log.py"), ("", 2, "/build"), ("", 3, "docs/**/gen.py"), ("", 4, "# note"), ("", 5, "tmp/"),
             ("", 6, "!tmp/keep.py"), ("sub", 1, "!x.log.py"), ("sub", 2, "a?.py"), ("", 7, "[cd]1.py")]
    rules = scope.parse_ignore_lines(spark.createDataFrame(lines, "dir string, rank int, line string"))
    paths = {"x.log.py": False, "sub/x.log.py": True, "build/a.py": False, "sub/build/a.py": True,
             "docs/gen.py": False, "docs/a/b/gen.py": False, "gen.py": True, "tmp/keep.py": False, "a/tmp/z.py": False,
             "sub/ab.py": False, "ab.py": True, "c1.py": False, "sub/e1.py": True, ".git/x.py": False}
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path for r in scope.filter_ignored(files, rules).collect()} == {p for p, keep in paths.items() if keep}


def test_project_root(spark):
    paths = spark.createDataFrame([("a/b/c.py", False), ("a/b", True), ("z/q.py", False), ("top.py", False)], "path string, is_dir boolean")
    for marks, want in (([("a",)], ["a", "a", "z", ""]), ([("a",), ("a/b",), ("",)], ["a/b", "a/b", "", ""])):
        rows = scope.project_root(paths, spark.createDataFrame(marks, "dir string")).collect()
        assert {r.path: r.root for r in rows} == dict(zip(["a/b/c.py", "a/b", "z/q.py", "top.py"], want))


def test_ancestors(spark):
    row = spark.range(1).select(ancestors(F.lit("a/b")).alias("x"), ancestors(F.lit("")).alias("y")).first()
    assert (row.x, row.y) == (["", "a", "a/b"], [""])


def test_json_rows(spark):
    rows = extract_symbols(corpus(spark, {"a.py": 'def q(): pass\n'})).select("name", "kind", "file", "line")
    assert [json.loads(r.value) for r in tree.to_json_rows(rows).collect()] == [{"name": "q", "kind": "fn", "file": "a.py", "line": 1}]


TREE = {
    ".gitignore": "*.log\n!keep.log\n/out/\n# note\n", "a.py": "", "x.log": "", "keep.log": "", "out/o.py": "", "src/out/o.py": "",
    "src/.gitignore": "gen/\n*.tmp.[!p]y\n!x.log\n", "src/gen/g.py": "", "src/deep/gen/h.py": "", "src/b.tmp.cy": "", "src/b.tmp.py": "", "src/x.log": "",
    "src/deep/x.log": "", ".hid/h.py": "", "src/.git/HEAD": "", "src/deep/.env": "", "src/deep/n?.py": "", "lib/.ignore": "*.py", "lib/l.py": "", "lib/l.rs": "",
}


def _write_tree(root):
    for name, text in TREE.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def _listed(spark, root, **options):
    return sorted(r.path for r in tree.list_corpus(spark, root, **options).collect())


def test_the_walk_leaves_out_what_is_ignored(spark, tmp_path):
    root = _write_tree(tmp_path / "t")
    visible = ["a.py", "keep.log", "lib/l.py", "lib/l.rs", "src/b.tmp.py", "src/deep/n?.py", "src/deep/x.log", "src/out/o.py", "src/x.log"]
    assert _listed(spark, root, ignore=[".gitignore"]) == visible
    assert _listed(spark, root, ignore=[".gitignore"], shards=1) == visible
    assert _listed(spark, root, ignore=[".gitignore", ".ignore"]) == [p for p in visible if p != "lib/l.py"]
    assert _listed(spark, root) == sorted(TREE)
    assert _listed(spark, root, ignore=[".gitignore"], below="src") == [p for p in visible if p.startswith("src/")]
    assert _listed(spark, root, ignore=[".gitignore"], below="out") == _listed(spark, root, below="nowhere") == []
    # the same rules as rows of a table
    rules = scope.parse_ignore_lines(tree.ignore_lines(spark, root, [".gitignore"]))
    assert sorted(r.path for r in scope.filter_ignored(tree.list_corpus(spark, root), rules).collect()) == visible
    assert [r.dir for r in scope.root_markers(tree.list_corpus(spark, root)).collect()] == ["src"]


def test_ignored_directories_are_never_opened(tmp_path, monkeypatch):
    root = _write_tree(tmp_path / "t")
    opened, scandir = [], os.scandir
    monkeypatch.setattr(tree.os, "scandir", lambda p: opened.append(os.path.relpath(p, root)) or scandir(p))
    reader = tree.TreeReader({"path": root, "ignore": ".gitignore", "shards": "2"})
    assert sum(1 for part in reader.partitions() for top in part.tops for _ in reader.walk(*top)) == 9
    assert set(opened) == {".", "src", "src/out", "src/deep", "lib"}
    opened.clear()
    reader = tree.PrunedTreeReader({"path": root, "ignore": ""})
    pushed = list(reader.pushFilters([tree.StringStartsWith(("path",), "src/deep/x")]))
    assert len(pushed) == 1 and {name for part in reader.partitions() for name, _, _ in part.tops} == {f"{root}/src/deep", f"{root}/src/deep/gen"}


def test_a_prefix_filter_reaches_the_walk(spark, tmp_path):
    root = _write_tree(tmp_path / "t")
    listed = tree.list_corpus(spark, root).where(F.col("path").startswith("src/deep/x"))
    assert [r.path for r in listed.collect()] == ["src/deep/x.log"]
    assert spark.conf.get("spark.sql.python.filterPushdown.enabled") == "true"


def test_refresh_drops_what_has_come_to_be_ignored(spark, tmp_path):
    root, where = _write_tree(tmp_path / "t"), str(tmp_path / "index")
    (tmp_path / "t" / "lib" / "l.rs").write_text("fn f() {}\n")
    store.refresh_tree(spark, where, root, ignore=[".gitignore"], buckets=2)
    assert [r.name for r in store.read_index(spark, where).symbols.collect()] == ["f"]
    (tmp_path / "t" / ".gitignore").write_text("lib\n")
    store.refresh_tree(spark, where, root, ignore=[".gitignore"])
    assert store.read_index(spark, where).symbols.count() == 0
