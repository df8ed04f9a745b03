"""Index maintenance: states, scopes, storage, edits and the change feed."""

import itertools
import os

import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings, strategies as st

from helpers import corpus
from srcatlas.plans import index as plans
from srcatlas.sources import store
from srcatlas.streaming import feed
from srcatlas.schema import FEED

RUST = "fn a{0}() {{}}\nstruct S{0};\n"


def content(index):
    files = sorted(tuple(r) for r in index.files.select(*plans.FILE_COLUMNS).collect())
    symbols = sorted(tuple(r) for r in index.symbols.select(*plans.SYMBOL_COLUMNS).collect())
    return files, symbols


def test_empty_corpus(spark):
    index = plans.refresh_index(plans.empty_index(spark), corpus(spark, {"readme.txt": "x"}))
    assert content(index) == ([], [])
    assert content(plans.rebuild_index(corpus(spark, {"readme.txt": "x"}))) == ([], [])


def test_unreadable_file_stays_listed(spark):
    index = plans.rebuild_index(corpus(spark, {"a.rs": None}))
    files, symbols = content(index)
    assert [f[0] for f in files] == ["a.rs"] and symbols == []


def test_old_times_are_clamped(spark):
    index = plans.rebuild_index(corpus(spark, {"a.rs": "fn a() {}"}, secs=-5))
    assert content(index)[0] == [("a.rs", "rust", 0, 0)]
    status = plans.scan_changes(corpus(spark, {"a.rs": ""}, secs=-9), index).collect()
    assert [r.status for r in status] == ["unchanged"]


def test_narrow_refresh_keeps_the_rest(spark):
    before = plans.rebuild_index(corpus(spark, {"x/a.rs": RUST.format(1), "x/b.py": "def b(): pass", "y/c.rs": RUST.format(2)}))
    after = plans.refresh_index(before, corpus(spark, {"x/d.rs": RUST.format(3)}), scope="x", lang="rust")
    assert [f[0] for f in content(after)[0]] == ["x/b.py", "x/d.rs", "y/c.rs"]
    names = [r.name for r in plans.list_symbols(after, path="x", lang="rust").collect()]
    assert names == ["a3", "S3"]


def test_prefix_is_a_pattern(spark):
    index = plans.rebuild_index(corpus(spark, {"src/ab.rs": RUST.format(1), "src/a/x.rs": RUST.format(2), "SRC/az.rs": RUST.format(3)}))
    assert {r.path for r in plans.cached_mtimes(index, "src/a").collect()} == {"src/ab.rs", "src/a/x.rs", "SRC/az.rs"}
    assert {r.file for r in plans.symbols_for_prefix(index, "src/_b").collect()} == {"src/ab.rs"}


edits = st.lists(st.dictionaries(st.sampled_from(["a.rs", "d/b.rs", "d/c.py"]), st.integers(0, 3), max_size=3), min_size=2, max_size=3)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(states=edits)
def test_refreshes_equal_a_rebuild(spark, states):
    def files(state):
        rows = {p: f"fn f{v}() {{}}\n" * (v + 1) if p.endswith("rs") else f"def f{v}(): pass\n" for p, v in state.items()}
        made = corpus(spark, rows) if rows else corpus(spark, {"none.txt": ""})
        return made.withColumn("mtime_secs", _version(state))
    index = plans.empty_index(spark)
    for state in states:
        index = plans.refresh_index(index, files(state))
        index = plans.Index(*(_fixed(spark, df) for df in (index.files, index.symbols)))
    want = content(plans.rebuild_index(files(states[-1])))
    assert content(index) == want
    assert content(plans.refresh_index(index, files(states[-1]))) == want


def _version(state):
    from pyspark.sql import functions as F
    out = F.lit(0).cast("bigint")
    for path, v in state.items():
        out = F.when(F.col("path") == path, F.lit(v).cast("bigint")).otherwise(out)
    return out


def _fixed(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


def test_versions(spark, tmp_path):
    where = str(tmp_path / "index")
    assert content(store.read_index(spark, where)) == ([], [])
    one, two = (plans.rebuild_index(corpus(spark, {f"a{i}.rs": RUST.format(i)})) for i in (1, 2))
    assert store.write_index(one, where, buckets=2) == 1
    assert store.write_index(two, where, buckets=2) == 2
    assert content(store.read_index(spark, where)) == content(two)
    assert content(store.read_index(spark, where, version=1)) == content(one)
    with pytest.raises(ValueError):
        store.read_index(spark, where, version=9)


def _half_a_version(where, number):
    """What a job leaves that dies while it writes a version: nothing in it, or a part."""
    os.makedirs(f"{where}/versions", exist_ok=True)
    with open(store._version_file(where, number), "w") as f:
        f.write('{"bucket": 0, "home": "x", "buckets": 2}\n{"buck' if number % 2 else "")


def test_a_dead_writer_stops_no_one(spark, tmp_path):
    where = str(tmp_path / "index")
    for number in (1, 2):
        _half_a_version(where, number)
    assert store.current_version(spark, where) == 0 and content(store.read_index(spark, where)) == ([], [])
    one, two = (plans.rebuild_index(corpus(spark, {p: "def f(): pass\n"}).selectExpr("*")) for p in ("a.py", "b.py"))
    assert store.write_index(one, where, buckets=2) == 3
    _half_a_version(where, 4)
    _half_a_version(where, 5)
    assert content(store.read_index(spark, where)) == content(one)
    with pytest.raises(ValueError):
        store.read_index(spark, where, version=5)
    assert store.write_index(two, where, buckets=2) == 6
    assert content(store.read_index(spark, where)) == content(two)
    store.forget_versions(spark, where)
    assert store.versions(spark, where) == [6] and content(store.read_index(spark, where)) == content(two)
    assert all(len(os.listdir(f"{where}/{name}")) == 1 for name in ("files", "symbols"))


def test_of_two_writers_one_fails(spark, tmp_path):
    where = str(tmp_path / "index")
    text = {f"d/f{i}.py": f"def g{i}(): pass\n" for i in range(6)}
    store.write_index(plans.rebuild_index(corpus(spark, text)), where, buckets=4)
    mine, other = (corpus(spark, text | {name: "def n(): pass\n"}) for name in ("d/mine.py", "d/other.py"))

    def meanwhile(part):
        store.refresh_stored(spark, where, other)
        return part

    with pytest.raises(store.VersionConflict):
        store.update_index(spark, where, mine.select("path"), meanwhile)
    assert content(store.read_index(spark, where)) == content(plans.rebuild_index(other))
    assert store.refresh_stored(spark, where, mine) == 3  # tried again, on what the other job has made
    assert content(store.read_index(spark, where)) == content(plans.rebuild_index(mine))


def test_many_versions_are_one_read(spark, tmp_path):
    where = str(tmp_path / "index")
    one = plans.rebuild_index(corpus(spark, {"a.py": "def f(): pass\n"}))
    store.write_index(one, where, buckets=2)
    last = open(store._version_file(where, 1)).read()
    for number in range(2, 1001):
        with open(store._version_file(where, number), "w") as f:
            f.write(last)
    assert store.current_version(spark, where) == 1000
    assert content(store.read_index(spark, where)) == content(one)


def test_only_touched_buckets_are_written(spark, tmp_path):
    where = str(tmp_path / "index")
    text = {f"d/f{i}.rs": RUST.format(i) for i in range(12)}
    store.write_index(plans.rebuild_index(corpus(spark, text)), where, buckets=8)
    homes = {r.bucket: r.home for r in store.published(spark, where)[1]}
    changed = corpus(spark, text | {"d/f3.rs": "fn other() {}"}).withColumn("mtime_secs", F.when(F.col("path") == "d/f3.rs", F.lit(9)).otherwise(F.col("mtime_secs")))
    assert store.refresh_stored(spark, where, changed) == 2
    later = {r.bucket: r.home for r in store.published(spark, where)[1]}
    assert sum(later[b] != homes[b] for b in homes) == 1 and set(later) == set(homes)
    assert content(store.read_index(spark, where)) == content(plans.rebuild_index(changed))
    assert store.refresh_stored(spark, where, changed) == 2  # nothing differs, nothing is written
    gone = changed.where("path <> 'd/f5.rs'")
    store.refresh_stored(spark, where, gone)
    assert content(store.read_index(spark, where)) == content(plans.rebuild_index(gone))


def test_an_empty_feed_batch_writes_nothing(spark, tmp_path):
    where = str(tmp_path / "index")
    none = spark.createDataFrame([], FEED)
    assert store.update_index(spark, where, none.select("path"), lambda index: feed.apply_changes(index, none)) == 0
    assert not os.path.exists(where)


def test_feed_batches_and_replay(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame([(p, s, 0, op, text.encode()) for p, s, op, text in rows], FEED)

    first = batch(("a.py", 1, "upsert", "def old(): pass"), ("a.py", 3, "upsert", "def new(): pass"),
                  ("b.py", 2, "upsert", "def b(): pass"), ("b.py", 4, "delete", ""))
    second = batch(("a.py", 2, "upsert", "def late(): pass"), ("c.rs", 9, "upsert", "fn c() {}"))
    index = feed.apply_changes(plans.empty_index(spark), first)
    assert [s[0] for s in content(index)[1]] == ["new"]
    assert content(feed.apply_changes(index, first)) == content(index)
    assert sorted(s[0] for s in content(feed.apply_changes(index, second))[1]) == ["c", "new"]


def test_an_older_change_after_a_deletion_has_no_effect(spark, tmp_path):
    where = str(tmp_path / "index")
    batches = [[("a.py", 5, "delete"), ("b.py", 5, "upsert"), ("c.py", 7, "upsert")],
               [("a.py", 4, "upsert"), ("b.py", 6, "delete"), ("c.py", 6, "delete"), ("d.py", 1, "delete")],
               [("a.py", 5, "upsert"), ("b.py", 5, "upsert"), ("c.py", 7, "delete"), ("d.py", 2, "upsert")]]
    left = []
    for rows in batches:
        batch = spark.createDataFrame([(p, s, 0, op, f"def {p[0]}{s}(): pass".encode()) for p, s, op in rows], FEED)
        for _ in range(2):  # the second time is a replay
            store.update_index(spark, where, batch.select("path"), lambda index: feed.apply_changes(index, batch), 4)
        left.append(sorted(s[0] for s in content(store.read_index(spark, where))[1]))
    assert left == [["b5", "c7"], ["c7"], ["d2"]]
    assert sorted(tuple(r)[:2] for r in store.read_index(spark, where).deleted.collect()) == [("a.py", 5), ("b.py", 6), ("c.py", 7)]
    store.refresh_stored(spark, where, corpus(spark, {"d.py": "def e(): pass"}, secs=9))  # a listing forgets no deletion
    assert store.read_index(spark, where).deleted.count() == 3


def test_deletions_are_forgotten_after_their_time(spark):
    def batch(*rows):
        return spark.createDataFrame([(p, s, 0, op, b"") for p, s, op in rows], FEED)

    index = feed.apply_changes(plans.empty_index(spark), batch(("a.py", 10, "delete"), ("b.py", 60, "delete")), keep_secs=50)
    assert {r.path for r in index.deleted.collect()} == {"a.py", "b.py"}
    index = feed.apply_changes(index, batch(("c.py", 61, "upsert")), keep_secs=50)
    assert {r.path for r in index.deleted.collect()} == {"b.py"}
    assert {r.path for r in feed.apply_changes(index, batch(), keep_secs=50).deleted.collect()} == {"b.py"}


def test_prefix_reads_skip_and_do_not_join(spark, tmp_path, capsys):
    where = str(tmp_path / "index")
    text = {"src/ab.rs": RUST.format(1), "src/a/x.rs": RUST.format(2), "SRC/az.rs": RUST.format(3), "s%/q.rs": RUST.format(4), "Ärc.rs": RUST.format(5)}
    index = plans.rebuild_index(corpus(spark, text))
    store.write_index(index, where, buckets=4)
    for prefix in ("src/a", "SRC/A", "src/_b", "s%", "%z", "", "ä", "Ä", "none"):
        assert content(store.read_index(spark, where, prefix=prefix))[0] == sorted(
            f for f in content(index)[0] if f[0] in {r.path for r in plans.cached_mtimes(index, prefix).collect()})
        wanted = [tuple(r) for r in plans.symbols_for_prefix(index, prefix).collect()]
        assert [tuple(r) for r in store.stored_symbols(spark, where, prefix).collect()] == wanted
    store.stored_symbols(spark, where, "Src/A_b", ordered=False).explain("formatted")
    plan = capsys.readouterr().out
    assert "StringStartsWith(folded,src/a)" in plan and "Exchange" not in plan and "Join" not in plan
