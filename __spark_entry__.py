"""

The corpora are rendered by Spark from the given tables (``corpora.spark``);
the SQL states what was planted in them (``corpora.sql``) and never parses
source text.
"""

from __future__ import annotations

import importlib.util
import os
import re
import sys
import tempfile
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpora import spark as cs, sql as cq
from corpora.templates import (
    BRANCH_SYMBOLS, BRANCH_TEMPLATES, CALL_TEMPLATES, CALLS, CODE_MATCHES, COMMENT_SYMBOLS, COMMENT_TEMPLATES, FIXED_NAMES, LANG_ORDER, MENTIONS, NESTED,
    STRING_CALLS, STRING_SYMBOLS, STRING_TEMPLATES, TOKENS,
)
from srcatlas import configure
from srcatlas.functions import langs, paths
from srcatlas.operators import declarations as decl, scope, structural, tokens
from srcatlas.operators.nodes import nodes_from_source
from srcatlas.operators.structural import Tok
from srcatlas.operators.tree import AnyOf, Node, match_nodes
from srcatlas.plans import index as plans
from srcatlas.sources import store, tree
from srcatlas.streaming import feed

# The training-text operators may be taken out of the library.
llm = None
if importlib.util.find_spec("srcatlas.llm") and importlib.util.find_spec("corpus_pipeline"):
    import corpus_pipeline
    from srcatlas.llm import queries as llm

SYMBOL = ["name", "kind", "file", "line"]
SMALLEST = "/root/testdata/sf0.001"


def _scratch(spark: SparkSession) -> str:
    """A new folder below the shared one of the cluster; local only when unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        name = spark.range(1).select(F.expr("uuid()")).first()[0]
        return f"{shared}/srcatlas-{name}"
    return tempfile.mkdtemp(prefix="srcatlas-")


# ---------------------------------------------------------------- predicates

ALIASES = ["bash", "SH", "c", "Cpp", "c++", "CXX", "go", "Golang", "js", "JavaScript", "py", "PYTHON", "rs", "Rust",
           "Swift", "ts", "TSX", "typescript", "zsh", "jsx", ""]
ALIAS_LANGS = ["bash", "bash", "c", "cpp", "cpp", "cpp", "go", "go", "javascript", "javascript", "python", "python",
               "rust", "rust", "swift", "typescript", "typescript", "typescript", None, None, None]
LABELS = ["@fn.name", "@@type.x", "@weird", "", "@namespace.name", "struct", "@Fn.name", "@method.name.extra"]
LABEL_KINDS = ["fn", "type", "unknown", "unknown", "namespace", "struct", "unknown", "method"]
PREFIXES = ["proj/brand1", "PROJ/Brand1/", "proj/b_and2", "proj/%/promo/s", "proj/brand\\", "proj/É"]
SCOPES = ["proj/brand1", "proj/brand2/promo/", "proj/brand"]


def _sql_list(values) -> str:
    quoted = ["null" if v is None else "'" + v + "'" for v in values]
    return "[" + ", ".join(quoted) + "]"


def detect_lang(spark, sf):
    return cs.part_files(spark, sf).select("path", langs.detect_lang(F.col("path")).alias("lang"))


def normalize_lang(spark, sf):
    rows = cs.table(spark, sf, "part").select("p_partkey", cs._pick(ALIASES, F.col("p_partkey") % len(ALIASES)).alias("alias"))
    return rows.select("p_partkey", "alias", langs.normalize_lang(F.col("alias")).alias("lang"))


def symbol_kind(spark, sf):
    rows = cs.table(spark, sf, "part").select("p_partkey", cs._pick(LABELS, F.col("p_partkey") % len(LABELS)).alias("label"))
    return rows.select("p_partkey", "label", langs.symbol_kind(F.col("label")).alias("kind"))


def decode_text(spark, sf):
    rows = cs.table(spark, sf, "part").selectExpr("p_partkey", """CASE p_partkey % 4
        WHEN 0 THEN concat(unhex('FFFE'), encode(p_name, 'UTF-8')) WHEN 1 THEN encode(p_name, 'UTF-8')
        WHEN 2 THEN encode('', 'UTF-8') ELSE encode(concat('é', p_name), 'UTF-8') END AS content""")
    return rows.select("p_partkey", paths.decode_text(F.col("content")).alias("text"))


def filter_lang(spark, sf):
    files = cs.part_files(spark, sf)
    return tree.of_language(files, "ts").unionByName(tree.of_language(files, "C++")).select("path", "lang")


def path_prefix(spark, sf):
    rows = cs.part_files(spark, sf).select("path", F.explode(F.lit(PREFIXES)).alias("prefix"))
    return rows.where(paths.path_prefix(F.col("path"), F.col("prefix"))).select("prefix", "path")


def path_scope(spark, sf):
    files, out = cs.part_files(spark, sf).select("path"), None
    for s in SCOPES:
        part = scope.in_scope(files, s).select(F.lit(s).alias("scope"), "path")
        out = part if out is None else out.unionByName(part)
    return out


def project_root(spark, sf):
    return scope.project_root(*cs.supplier_paths(spark, sf))


def filter_ignored(spark, sf):
    files, lines = cs.supplier_tree(spark, sf)
    return scope.filter_ignored(files, scope.parse_ignore_lines(lines)).select("path")


# ------------------------------------------------------- tokens and symbols

def tokenize(spark, sf):
    rows = tokens.tokenize(cs.part_files(spark, sf)).where(F.col("cls").isin("ident", "qualified"))
    key = F.regexp_extract("file", r"_(\d+)\.[a-z]+$", 1)
    name = F.regexp_replace("text", r"::m$", "")
    return rows.where(name.endswith(key) & ~F.col("text").isin(FIXED_NAMES)).select("file", "text", "line")


def extract_symbols(spark, sf):
    return decl.extract_symbols(cs.part_files(spark, sf)).select(*SYMBOL)


def symbols_of(lang):
    def query(spark, sf):
        return decl.extract_symbols(cs.part_files(spark, sf, lang), lang, ordered=False).select(*SYMBOL)
    return query


def symbols_in(lang, templates):
    def query(spark, sf):
        return decl.extract_symbols(cs.part_files(spark, sf, lang, templates), lang, ordered=False).select(*SYMBOL)
    return query


def _by_language(names, query):
    """One table of what ``query`` finds for each language; file names tell them apart."""
    out = None
    for lang in names:
        out = query(lang) if out is None else out.unionByName(query(lang))
    return out


def tokens_exact(spark, sf):
    """Every token and column of three languages."""
    return _by_language(TOKENS, lambda lang: tokens.tokenize(cs.part_files(spark, sf, lang), lang))


def symbols_in_strings(spark, sf):
    return _by_language(STRING_TEMPLATES, lambda lang: symbols_in(lang, STRING_TEMPLATES)(spark, sf))


def symbols_in_comments(spark, sf):
    return _by_language(COMMENT_TEMPLATES, lambda lang: symbols_in(lang, COMMENT_TEMPLATES)(spark, sf))


def symbols_capped(spark, sf):
    return decl.extract_symbols(cs.nation_files(spark, sf), "python", cap=500, ordered=False).select(*SYMBOL)


def symbols_in_documents(spark, sf):
    return decl.extract_symbols(cs.document_files(spark, sf), "python", ordered=False).select(*SYMBOL)


def definition_spans(spark, sf):
    return decl.definition_spans(cs.part_files(spark, sf)).select(*SYMBOL, "start_line", "end_line")


def symbols_json(spark, sf):
    rows = decl.extract_symbols(cs.part_files(spark, sf), ordered=False).select(*SYMBOL)
    return tree.to_json_rows(rows)


# ------------------------------------------------------ structural questions

def find_function(spark, sf):
    return structural.find_function(cs.part_files(spark, sf, "rust"), "sig_77", "rust")


def find_type(spark, sf):
    return structural.find_type(cs.part_files(spark, sf, "rust"), "T77", "rs")


def find_impls(spark, sf):
    return structural.find_impls(cs.part_files(spark, sf, "rust"), None, limit=None)


def find_calls(spark, sf):
    return structural.find_calls(cs.call_files(spark, sf), None, "python", limit=None)


def calls_of(lang):
    def query(spark, sf):
        return structural.find_calls(cs.part_files(spark, sf, lang, CALL_TEMPLATES), None, lang)
    return query


def find_calls_in_strings(spark, sf):
    return _by_language(STRING_TEMPLATES, lambda lang: structural.find_calls(cs.part_files(spark, sf, lang, STRING_TEMPLATES), None, lang))


def find_calls_by_name(spark, sf):
    return structural.find_calls(cs.call_files(spark, sf), "part_77", "python", limit=None)


def find_method_calls(spark, sf):
    return structural.find_method_calls(cs.call_files(spark, sf), None, "python", limit=None)


METHOD_CALL = [Tok("self", capture="receiver"), Tok("."), Tok(cls="ident", regex="^part_", capture="method"),
               Tok("("), Tok(")")]


def match_tokens(spark, sf):
    return structural.match_tokens(cs.call_files(spark, sf), "python", METHOD_CALL, limit=None)


def match_limit(spark, sf):
    return structural.match_tokens(cs.call_files(spark, sf), "python", METHOD_CALL, limit=500)


# --------------------------------------------------------------- tree patterns

def _tree_query(*patterns, **options):
    def query(spark, sf):
        return match_nodes(cs.node_table(spark, sf), *patterns, limit=None, **options)
    return query


TREE_QUERIES = {
    "match_nodes": _tree_query(Node("customer", capture="c", children=[Node("segment", field="segment"), Node("order")])),
    "match_captures": _tree_query(Node("customer", capture="c", children=[
        Node("segment", field="segment", capture="s"), Node("order", capture="o")])),
    "match_predicates": _tree_query(
        Node("order", capture="eq", children=[Node("status", eq="F")]),
        Node("order", capture="not_eq", children=[Node("status", not_eq="O")]),
        Node("order", capture="any_of", children=[Node("status", any_of=["F", "P"])]),
        Node("order", capture="none_of", children=[Node("status", none_of=["F", "P"])]),
        Node("order", capture="match", children=[Node("status", match="^[FP]$")]),
        Node("order", capture="not_match", children=[Node("status", not_match="^[FP]$")])),
    "match_alternation": _tree_query(Node(["customer", "order"], children=[
        AnyOf([Node("segment", capture="x"), Node("status", capture="x")])])),
    "match_multi": _tree_query(
        Node("nation", capture="n", children=[Node("customer", capture="c")]),
        Node("order", capture="o", children=[Node("item", capture="i")])),
    "match_same_text": _tree_query(
        Node("order", capture="o", children=[Node("item", capture="a"), Node("status", capture="s")]),
        different=[("a", "o")]),
    "match_same": _tree_query(
        Node("order", capture="o", children=[Node("item", capture="a"), Node("status", capture="s")]),
        same=[("a", "o")]),
    "match_optional": _tree_query(Node("customer", capture="c", children=[
        Node("segment", capture="s"), Node("order", optional=True, capture="o", children=[Node("status", eq="P")])])),
    "match_repeated": _tree_query(Node("order", capture="o", children=[
        Node("item", repeated=True, capture="i"), Node("status", eq="F", capture="s")])),
    "match_absent": _tree_query(Node("customer", capture="c", children=[
        Node("segment", any_of=["BUILDING", "MACHINERY"]), Node("order", absent=True, children=[Node("status", eq="F")])])),
    "match_any": _tree_query(
        Node("order", capture="some", children=[Node("item", repeated=True, some_match="7$", capture="i")]),
        Node("order", capture="every", children=[Node("item", repeated=True, not_match="7$")])),
    "match_siblings": _tree_query(Node("order", capture="o", children=[Node("item", capture="a"), Node("item", capture="b")])),
}


NODE_LANGS = ["rust", "javascript", "go"]


def _code_nodes(spark, sf):
    """Nodes of a part corpus for each of three languages; file names tell them apart."""
    out = None
    for lang in NODE_LANGS:
        nodes = nodes_from_source(cs.part_files(spark, sf, lang), lang)
        out = nodes if out is None else out.unionByName(nodes)
    # Patterns and joins read it many times; it is worked out once.
    where = f"{_scratch(spark)}/nodes"
    out.write.parquet(where)
    return spark.read.schema(out.schema).parquet(where)


def nodes_from_tokens(spark, sf):
    """Declarations and calls with the node that they are in."""
    nodes = _code_nodes(spark, sf)
    kinds = ["fn", "method", "struct", "enum", "trait", "mod", "class", "call"]
    inner = nodes.where(F.col("type").isin(kinds)).select("file", "node_id", "parent_id", "type", "start_line", "end_line")
    names = nodes.where("field IN ('name', 'function')").selectExpr("file AS f", "parent_id AS owner", "text AS name")
    outer = nodes.selectExpr("file AS g", "node_id AS parent", "type AS inside", "field AS place")
    found = inner.join(names, (F.col("file") == F.col("f")) & (F.col("node_id") == F.col("owner")))
    return found.join(outer, (F.col("file") == F.col("g")) & (F.col("parent_id") == F.col("parent"))).select(
        "file", "type", "name", "start_line", "end_line", "inside", "place")


def match_code(spark, sf):
    """Functions with each call that stands in their body, and functions without any."""
    calls = Node("call", children=[Node("ident", field="function", capture="callee")])
    body = Node("braces", field="body", children=[calls])
    return match_nodes(
        _code_nodes(spark, sf), Node("fn", children=[Node("ident", field="name", capture="fn"), body]),
        Node("fn", children=[Node("ident", field="name", capture="without"), Node("braces", field="body", children=[Node("call", absent=True)])]))


# ------------------------------------------------------------------- the index

def _snapshots(spark, sf):
    before, after = cs.part_snapshots(spark, sf)
    return plans.rebuild_index(before), after


def _writer(root):
    def write(rows):
        made = set()
        for row in rows:
            target = os.path.join(root, row.path)
            folder = os.path.dirname(target)
            if folder not in made:
                os.makedirs(folder, exist_ok=True)
                made.add(folder)
            with open(target, "wb") as f:
                f.write(row.content)
    return write


def ignore_from_files(spark, sf):
    """The supplier tree on disk, its rules in ignore files that the walk reads."""
    root = _scratch(spark)
    files, lines = cs.supplier_tree(spark, sf)
    text = lines.groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"))
    rules = text.selectExpr("concat(dir, '/.gitignore') AS path", "encode(array_join(lines.line, '\n'), 'UTF-8') AS content")
    files.selectExpr("path", "encode('x = 1', 'UTF-8') AS content").unionByName(rules).foreachPartition(_writer(root))
    return tree.list_corpus(spark, root, ignore=[".gitignore"]).select("path")


def roots_from_listing(spark, sf):
    """Project roots by the markers among the listed paths."""
    paths, markers = cs.supplier_paths(spark, sf)
    listed = paths.unionByName(markers.selectExpr("concat(dir, '/.git/HEAD') AS path"))
    return scope.project_root(paths, scope.root_markers(listed))


def scan_corpus(spark, sf):
    root = _scratch(spark)

    files = cs.part_files(spark, sf)
    hidden_from_spark = files.selectExpr(
        "concat(substring_index(path, '/', 3), '/_k', k, '/__init__.py') AS path", "content")
    files.select("path", "content").unionByName(hidden_from_spark).foreachPartition(_writer(root))
    return tree.scan_corpus(spark, root).select("path", "lang", "length")


def index_roundtrip(spark, sf):
    where = _scratch(spark)
    store.write_index(plans.rebuild_index(cs.part_files(spark, sf)), where, buckets=8)
    return _with_files(store.read_index(spark, where))


def refresh_stored(spark, sf):
    before, after = cs.part_snapshots(spark, sf)
    where = _scratch(spark)
    store.write_index(plans.rebuild_index(before), where, buckets=8)
    store.refresh_stored(spark, where, after)
    return _with_files(store.read_index(spark, where))


def index_after_conflict(spark, sf):
    """One job refreshes while another, that has read the index before, tries to; the other starts again."""
    before, after = cs.part_snapshots(spark, sf)
    where = _scratch(spark)
    store.write_index(plans.rebuild_index(before.where("k % 3 <> 0")), where, buckets=8)

    def meanwhile(part):
        store.refresh_stored(spark, where, before)
        return plans.drop_files(part, before)

    try:
        store.update_index(spark, where, before.select("path"), meanwhile)
    except store.VersionConflict:
        store.refresh_stored(spark, where, after)
    store.forget_versions(spark, where)
    return _with_files(store.read_index(spark, where))


def upsert_touched(spark, sf):
    before, after = cs.part_snapshots(spark, sf)
    where = _scratch(spark)
    store.write_index(plans.rebuild_index(before), where, buckets=8)
    fresh = decl.extract_symbols(after, ordered=False)
    store.update_index(spark, where, after.select("path"), lambda part: plans.upsert_files(part, after, fresh))
    return _with_files(store.read_index(spark, where))


def symbols_for_prefix(spark, sf):
    index = plans.rebuild_index(cs.part_files(spark, sf))
    return plans.symbols_for_prefix(index, "proj/Brand1", ordered=False).select(*SYMBOL)


def cached_mtimes(spark, sf):
    index, _ = _snapshots(spark, sf)
    return plans.cached_mtimes(index, "proj/brand2")


def scan_changes(spark, sf):
    index, after = _snapshots(spark, sf)
    return plans.scan_changes(after, index)


def _with_files(index):
    """Index contents as one relation: a row per file and symbol."""
    symbols = index.symbols.select("file", "name", "kind", "line")
    return index.files.join(symbols.hint("merge"), F.col("path") == F.col("file"), "left").select(
        "path", "lang", "mtime_secs", "mtime_nanos", "name", "kind", "line")


def upsert_files(spark, sf):
    index, after = _snapshots(spark, sf)
    return _with_files(plans.upsert_files(index, after, decl.extract_symbols(after, ordered=False)))


def prune_deleted(spark, sf):
    index, after = _snapshots(spark, sf)
    return _with_files(plans.prune_deleted(index, after))


def refresh_index(spark, sf):
    index, after = _snapshots(spark, sf)
    return _with_files(plans.refresh_index(index, after))


def refresh_scope(spark, sf):
    index, after = _snapshots(spark, sf)
    return _with_files(plans.refresh_index(index, after, scope="proj/brand1", lang="rust"))


def rebuild_index(spark, sf):
    return _with_files(plans.rebuild_index(cs.part_snapshots(spark, sf)[1]))


def list_symbols(spark, sf):
    index, after = _snapshots(spark, sf)
    return plans.list_symbols(index, after, "proj/brand1", "rust", ordered=False).select(*SYMBOL)


def stored_symbols(spark, sf):
    where = _scratch(spark)
    store.write_index(plans.rebuild_index(cs.part_files(spark, sf)), where, buckets=8)
    return store.stored_symbols(spark, where, "proj/Brand1", ordered=False).select(*SYMBOL)


def list_symbols_alias(spark, sf):
    index, after = _snapshots(spark, sf)
    return plans.list_symbols(index, after, "proj/brand1", "RS", ordered=False).select(*SYMBOL)


def list_symbols_unknown(spark, sf):
    index, after = _snapshots(spark, sf)
    return plans.list_symbols(index, after, "proj/brand1", "cobol", ordered=False).select(*SYMBOL)


def apply_change_feed(spark, sf):
    base = _scratch(spark)
    rows = cs.change_feed(spark, sf)
    rows.write.parquet(f"{base}/feed")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/feed")
    feed.apply_change_feed(stream, f"{base}/index", f"{base}/progress", buckets=8).awaitTermination()
    return store.read_index(spark, f"{base}/index").symbols.select(*SYMBOL)


def apply_late_changes(spark, sf):
    """The feed in three runs, the newest changes first."""
    base = _scratch(spark)
    rows = cs.change_feed(spark, sf)
    early, late = rows.approxQuantile("mtime_secs", [1 / 3, 2 / 3], 0.01)
    secs = F.col("mtime_secs")
    for part in (secs > late, (secs > early) & (secs <= late), secs <= early):
        rows.where(part).write.mode("append").parquet(f"{base}/feed")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/feed")
        feed.apply_change_feed(stream, f"{base}/index", f"{base}/progress", buckets=8).awaitTermination()
    return store.read_index(spark, f"{base}/index").symbols.select(*SYMBOL)


def entry(spark: SparkSession) -> DataFrame:
    """Symbols of a corpus at one path, from a freshly built index."""
    configure(spark)
    index = plans.rebuild_index(cs.part_files(spark, SMALLEST))
    return plans.symbols_for_prefix(index, "proj/").select(*SYMBOL)


_QUERIES = {f.__name__: f for f in (
    detect_lang, normalize_lang, symbol_kind, decode_text, filter_lang, path_prefix, path_scope, project_root,
    filter_ignored, tokenize, extract_symbols, symbols_capped, symbols_in_documents, definition_spans, symbols_json,
    find_function, find_type, find_impls, find_calls, find_calls_by_name, find_method_calls, match_tokens, match_limit,
    scan_corpus, index_roundtrip, symbols_for_prefix, cached_mtimes, scan_changes, upsert_files, prune_deleted,
    refresh_index, refresh_scope, rebuild_index, list_symbols, list_symbols_alias,
    list_symbols_unknown, apply_change_feed, apply_late_changes, stored_symbols, refresh_stored, upsert_touched, index_after_conflict, ignore_from_files, roots_from_listing, nodes_from_tokens, match_code,
    tokens_exact, symbols_in_strings, symbols_in_comments, find_calls_in_strings,
)} | {f"symbols_{lang}": symbols_of(lang) for lang in LANG_ORDER} | {
    f"find_calls_{lang}": calls_of(lang) for lang in LANG_ORDER} | {
    f"symbols_{lang}_branches": symbols_in(lang, BRANCH_TEMPLATES) for lang in BRANCH_TEMPLATES} | TREE_QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; each callable takes (spark, sf_dir)."""
    def configured(query):
        return lambda spark, sf: query(configure(spark), sf)
    out = {name: configured(query) for name, query in _QUERIES.items()}
    if llm:
        out |= llm.QUERIES | {"pipeline": corpus_pipeline.run}
    return out


# --------------------------------------------------------------------- oracles

_FILES = cq.part_files()
_PLANTED = cq.planted()
_SYMBOLS = f"SELECT name, kind, file, line FROM ({_PLANTED})"

# State of a file between the two snapshots, and where its lines moved.
_STATUS = ("CASE WHEN k % 10 = 7 THEN 'deleted' WHEN k % 10 = 3 THEN 'new' "
           "WHEN k % 4 = 0 THEN 'changed' ELSE 'unchanged' END")
_STEP = "CASE WHEN k % 8 = 0 THEN 1 WHEN k % 8 = 4 THEN -1 ELSE 0 END"


def _indexed(found: str, rows: str) -> str:
    """Files with their symbols; ``found`` says which have the second state."""
    return (f"SELECT f.path, f.lang, (f.mtime_secs + CASE WHEN {found} THEN {_STEP.replace('k %', 'f.k %')} ELSE 0 END)"
            f"::BIGINT AS mtime_secs, f.mtime_nanos, p.name, p.kind, "
            f"(p.line + CASE WHEN {found} AND f.k % 10 <> 3 AND f.k % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS line "
            f"FROM ({_FILES}) f LEFT JOIN ({_PLANTED}) p ON p.file = f.path WHERE {rows}")


def _call_rows(odd: bool, methods: bool = False) -> str:
    test = "l_linenumber % 2 = 1" if odd else "l_linenumber % 2 = 0"
    return f"SELECT *, 'calls/o' || l_orderkey || '.py' AS file FROM ({cq.order_lines()}) WHERE {test}"


_CALLS = (f"SELECT c.capture, 'part_' || l_partkey || c.tail AS text, file, (i + 1)::BIGINT AS start_line, "
          f"(i + 1)::BIGINT AS end_line FROM ({_call_rows(True)}) CROSS JOIN (VALUES ('@fn', ''), ('@call', '()')) c(capture, tail)")
_RECEIVER_CALLS = (
    f"SELECT c.ix, c.capture, CASE WHEN c.ix = 0 THEN 'self' ELSE 'part_' || l_partkey END AS text, file, i, "
    f"(i + 1)::BIGINT AS start_line, (i + 1)::BIGINT AS end_line FROM ({_call_rows(False)}) "
    f"CROSS JOIN (VALUES (0, '@receiver'), (1, '@method')) c(ix, capture)")
_MATCH = "capture, text, file, start_line, end_line"

_RUST_FILES = cq.part_files("rust")


def _rust_item(k: str, name: str, text: str, capture: str, start: int, end: int) -> str:
    where = f" WHERE k = {k}" if k else ""
    return (f"SELECT '@{name}' AS capture, {text} AS text, path AS file, {start}::BIGINT AS start_line, "
            f"{end}::BIGINT AS end_line FROM ({_RUST_FILES}){where}")


_CUSTOMERS = "customer JOIN nation ON c_nationkey = n_nationkey"
_ORDERS = f"orders JOIN {_CUSTOMERS} ON o_custkey = c_custkey"
_ITEMS = f"lineitem JOIN ({_ORDERS}) ON l_orderkey = o_orderkey"
_NUMBERED = (f"SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i "
             f"FROM {_ITEMS}")
_ITEM_PAIRS = (f"SELECT a.n_regionkey, a.o_orderkey, a.l_partkey, b.l_partkey AS other FROM ({_NUMBERED}) a "
               f"JOIN ({_NUMBERED}) b ON a.l_orderkey = b.l_orderkey AND a.i < b.i")


_PARTIAL_ORDERS = f"{_CUSTOMERS} LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey"
_HAS_ITEMS = "EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o_orderkey)"
_ITEM_ENDS_IN_7 = "EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o_orderkey AND x.l_partkey % 10 = 7)"


def _nodes(capture: str, text: str, rows: str) -> str:
    return (f"SELECT '@{capture}' AS capture, ({text})::VARCHAR AS text, 'region_' || n_regionkey AS file, "
            f"1::BIGINT AS start_line, 1::BIGINT AS end_line FROM {rows}")


def _union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


def _planted_calls(lang: str, calls: list[tuple[str, int]]) -> str:
    found = [(capture, text, line, line) for call, line in calls
             for capture, text in (("@call", call), ("@fn", re.split("[(<]| {", call)[0]))]
    return cq.rendered(lang, found, "capture text start_line end_line")


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for every key of ``queries()``."""
    out = {
        "detect_lang": f"SELECT path, lang FROM ({_FILES})",
        "normalize_lang": f"SELECT p_partkey, {_sql_list(ALIASES)}[p_partkey % {len(ALIASES)} + 1] AS alias, "
                          f"{_sql_list(ALIAS_LANGS)}[p_partkey % {len(ALIASES)} + 1] AS lang FROM part",
        "symbol_kind": f"SELECT p_partkey, {_sql_list(LABELS)}[p_partkey % {len(LABELS)} + 1] AS label, "
                       f"{_sql_list(LABEL_KINDS)}[p_partkey % {len(LABELS)} + 1] AS kind FROM part",
        "decode_text": "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN p_name WHEN 3 THEN 'é' || p_name ELSE '' END "
                       "AS text FROM part",
        "filter_lang": f"SELECT path, lang FROM ({_FILES}) WHERE lang IN ('typescript', 'cpp')",
        "path_prefix": f"SELECT prefix, path FROM ({_FILES}), (SELECT unnest({_sql_list(PREFIXES)}) AS prefix) "
                       "WHERE lower(path) LIKE lower(prefix) || '%'",
        "path_scope": f"SELECT scope, path FROM ({_FILES}), (SELECT unnest({_sql_list(SCOPES)}) AS scope) "
                      "WHERE starts_with(path, rtrim(scope, '/') || '/')",
        "project_root": "SELECT 'ws/n' || s_nationkey || '/s' || s_suppkey || '/src/f.py' AS path, "
                        "CASE WHEN s_suppkey % 5 = 0 THEN 'ws/n' || s_nationkey || '/s' || s_suppkey "
                        "WHEN s_nationkey % 3 = 0 THEN 'ws/n' || s_nationkey "
                        "ELSE 'ws/n' || s_nationkey || '/s' || s_suppkey || '/src' END AS root FROM supplier",
        "filter_ignored": "SELECT 'ws/n' || s_nationkey || '/s' || s_suppkey || '/' || name AS path FROM supplier, "
                          "(VALUES ('src/f.py'), ('build/o.py'), ('keep.gen.py')) t(name) "
                          "WHERE NOT (name = 'build/o.py' AND s_nationkey % 2 = 0)",
        "extract_symbols": _SYMBOLS,
        "symbols_json": "SELECT '{\"name\":\"' || name || '\",\"kind\":\"' || kind || '\",\"file\":\"' || file || "
                        f"'\",\"line\":' || line || '}}' AS value FROM ({_SYMBOLS})",
        "symbols_capped": "SELECT name, 'fn' AS kind, file, line FROM (SELECT 'order_' || o_orderkey AS name, "
                          "'nations/n' || c_nationkey || '.py' AS file, row_number() OVER (PARTITION BY c_nationkey "
                          "ORDER BY o_orderkey)::BIGINT AS line FROM orders JOIN customer ON o_custkey = c_custkey) "
                          "WHERE line <= 500",
        "symbols_in_documents": "SELECT t.p || doc_id AS name, 'fn' AS kind, 'docs/' || source || '/d' || doc_id || '.py' "
                                "AS file, (CASE WHEN t.p = 'before_' THEN 1 ELSE 3 + length(text) - "
                                "length(replace(text, chr(10), '')) END)::BIGINT AS line FROM documents, "
                                "(VALUES ('before_'), ('after_')) t(p)",
        "definition_spans": f"SELECT name, kind, file, line, line AS start_line, end_line FROM ({_PLANTED})",
        "find_function": _union(
            _rust_item("77", "name", "'sig_77'", "name", 6, 6),
            _rust_item("77", "fn", "'fn sig_77(&self) { helper_77(\"struct D77 {\"); self.go_77(); }'", "fn", 6, 6)),
        "find_type": _union(
            _rust_item("77", "name", "'T77'", "name", 2, 2),
            _rust_item("77", "type", "'pub struct T77 { x: i32 }'", "type", 2, 2)),
        "find_impls": _union(
            _rust_item("", "trait", "'R' || k", "trait", 5, 5),
            _rust_item("", "impl", "'impl R' || k || ' for T' || k || ' {' || chr(10) || '    fn sig_' || k || "
                       "'(&self) { helper_' || k || '(\"struct D' || k || ' {\"); self.go_' || k || '(); }' || chr(10) "
                       "|| '}'", "impl", 5, 7)),
        "find_calls": f"SELECT {_MATCH} FROM ({_CALLS})",
        "find_calls_by_name": f"SELECT {_MATCH} FROM ({_CALLS}) WHERE text IN ('part_77', 'part_77()')",
        "find_method_calls": f"SELECT {_MATCH} FROM ({_RECEIVER_CALLS}) WHERE ix = 1 UNION ALL SELECT '@call' AS capture, "
                             f"'self.' || text || '()' AS text, file, start_line, end_line FROM ({_RECEIVER_CALLS}) WHERE ix = 1",
        "match_tokens": f"SELECT {_MATCH} FROM ({_RECEIVER_CALLS})",
        "match_limit": f"SELECT {_MATCH} FROM ({_RECEIVER_CALLS} ORDER BY file, i, ix LIMIT 500)",
        "match_nodes": _nodes("c", "c_name", f"({_ORDERS})"),
        "match_captures": _union(_nodes("c", "c_name", f"({_ORDERS})"), _nodes("s", "c_mktsegment", f"({_ORDERS})"),
                                 _nodes("o", "o_orderkey", f"({_ORDERS})")),
        "match_predicates": _union(*[
            _nodes(capture, "o_orderkey", f"({_ORDERS}) WHERE {test}") for capture, test in [
                ("eq", "o_orderstatus = 'F'"), ("not_eq", "o_orderstatus <> 'O'"),
                ("any_of", "o_orderstatus IN ('F', 'P')"), ("none_of", "o_orderstatus NOT IN ('F', 'P')"),
                ("match", "o_orderstatus IN ('F', 'P')"), ("not_match", "o_orderstatus NOT IN ('F', 'P')")]]),
        "match_alternation": _union(_nodes("x", "c_mktsegment", f"({_CUSTOMERS})"),
                                    _nodes("x", "o_orderstatus", f"({_ORDERS})")),
        "match_multi": _union(_nodes("n", "n_name", f"({_CUSTOMERS})"), _nodes("c", "c_name", f"({_CUSTOMERS})"),
                              _nodes("o", "o_orderkey", f"({_ITEMS})"), _nodes("i", "l_partkey", f"({_ITEMS})")),
        "match_same_text": _union(*[
            _nodes(capture, text, f"({_ITEMS}) WHERE l_partkey <> o_orderkey") for capture, text in [
                ("o", "o_orderkey"), ("a", "l_partkey"), ("s", "o_orderstatus")]]),
        "match_same": _union(*[
            _nodes(capture, text, f"({_ITEMS}) WHERE l_partkey = o_orderkey") for capture, text in [
                ("o", "o_orderkey"), ("a", "l_partkey"), ("s", "o_orderstatus")]]),
        "match_optional": _union(*[
            _nodes(capture, text, f"({_PARTIAL_ORDERS}){rest}") for capture, text, rest in [
                ("c", "c_name", ""), ("s", "c_mktsegment", ""), ("o", "o_orderkey", " WHERE o_orderkey IS NOT NULL")]]),
        "match_repeated": _union(
            _nodes("o", "o_orderkey", f"({_ORDERS}) WHERE o_orderstatus = 'F' AND {_HAS_ITEMS}"),
            _nodes("i", "l_partkey", f"({_ITEMS}) WHERE o_orderstatus = 'F'"),
            _nodes("s", "o_orderstatus", f"({_ORDERS}) WHERE o_orderstatus = 'F' AND {_HAS_ITEMS}")),
        "match_absent": _nodes("c", "c_name", f"({_CUSTOMERS}) WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT EXISTS "
                               "(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
        "match_any": _union(
            _nodes("some", "o_orderkey", f"({_ORDERS}) WHERE {_ITEM_ENDS_IN_7}"),
            _nodes("i", "l_partkey", f"({_ITEMS}) WHERE {_ITEM_ENDS_IN_7}"),
            _nodes("every", "o_orderkey", f"({_ORDERS}) WHERE {_HAS_ITEMS} AND NOT {_ITEM_ENDS_IN_7}")),
        "match_siblings": _union(*[_nodes(capture, text, f"({_ITEM_PAIRS})") for capture, text in [
            ("o", "o_orderkey"), ("a", "l_partkey"), ("b", "other")]]),
        "index_roundtrip": _indexed("false", "true"),
        "symbols_for_prefix": f"{_SYMBOLS} WHERE file LIKE 'proj/brand1%'",
        "cached_mtimes": f"SELECT path, mtime_secs, mtime_nanos FROM ({_FILES}) WHERE k % 10 <> 3 "
                         "AND path LIKE 'proj/brand2%'",
        "scan_changes": f"SELECT path, lang, (mtime_secs + CASE WHEN k % 10 = 7 THEN 0 ELSE {_STEP} END)::BIGINT "
                        f"AS mtime_secs, mtime_nanos, {_STATUS} AS status FROM ({_FILES})",
        "upsert_files": _indexed("f.k % 10 <> 7", "true"),
        "prune_deleted": _indexed("false", "f.k % 10 NOT IN (3, 7)"),
        "refresh_index": _indexed("f.k % 10 <> 7", "f.k % 10 <> 7"),
        "refresh_scope": _indexed(
            "(f.lang = 'rust' AND f.path LIKE 'proj/brand1/%')",
            "CASE WHEN f.lang = 'rust' AND f.path LIKE 'proj/brand1/%' THEN f.k % 10 <> 7 ELSE f.k % 10 <> 3 END"),
        "rebuild_index": _indexed("f.k % 10 <> 7", "f.k % 10 <> 7"),
        "list_symbols": "SELECT name, kind, file, (line + CASE WHEN k % 10 <> 3 AND k % 4 = 0 THEN 1 ELSE 0 END)::BIGINT "
                        f"AS line FROM ({_PLANTED}) WHERE lang = 'rust' AND file LIKE 'proj/brand1/%' AND k % 10 <> 7",
        "apply_change_feed": "SELECT 'ev_' || event_id AS name, 'fn' AS kind, path AS file, 1::BIGINT AS line FROM ("
                             "SELECT *, 'u' || user_id || '/f' || (event_id % 7) || '.py' AS path, row_number() OVER "
                             "(PARTITION BY user_id, event_id % 7 ORDER BY ts DESC, event_id DESC) AS newest FROM events) "
                             "WHERE newest = 1 AND event_type <> 'error'",
        "scan_corpus": None,
        "tokenize": None,
    }
    out["refresh_stored"] = out["refresh_index"]
    out["apply_late_changes"] = out["apply_change_feed"]
    out["stored_symbols"] = out["symbols_for_prefix"]
    out["ignore_from_files"] = out["filter_ignored"]
    out["roots_from_listing"] = out["project_root"]
    out["index_after_conflict"] = out["refresh_index"]
    out["upsert_touched"] = out["upsert_files"]
    out["list_symbols_alias"] = out["list_symbols"]
    out["list_symbols_unknown"] = out["list_symbols"].replace("lang = 'rust' AND ", "")
    mentions = ", ".join(f"('{lang}', '{name}', {line})" for lang, names in MENTIONS.items()
                         for name, lines in names for line in lines)
    out["tokenize"] = (
        "SELECT f.path AS file, replace(replace(t.name, '{k}', f.k::VARCHAR), '{n}', f.n) AS text, "
        f"t.line::BIGINT AS line FROM ({_FILES}) f JOIN (VALUES {mentions}) AS t(lang, name, line) ON f.lang = t.lang")
    out["scan_corpus"] = cq.written_files()
    out["nodes_from_tokens"] = _union(*[cq.rendered(lang, NESTED[lang], "type name start_line end_line inside place") for lang in NODE_LANGS])
    out["match_code"] = _union(*[cq.rendered(lang, CODE_MATCHES[lang], "capture text start_line end_line") for lang in NODE_LANGS])
    for lang in BRANCH_TEMPLATES:
        out[f"symbols_{lang}_branches"] = cq.rendered(lang, BRANCH_SYMBOLS, "name kind line")
    out["tokens_exact"] = _union(*[cq.tokens(lang) for lang in TOKENS])
    out["symbols_in_strings"] = _union(*[cq.rendered(lang, rows, "name kind line") for lang, rows in STRING_SYMBOLS.items()])
    out["symbols_in_comments"] = _union(*[cq.rendered(lang, COMMENT_SYMBOLS, "name kind line") for lang in COMMENT_TEMPLATES])
    out["find_calls_in_strings"] = _union(*[_planted_calls(lang, rows) for lang, rows in STRING_CALLS.items()])
    for lang in LANG_ORDER:
        out[f"find_calls_{lang}"] = _planted_calls(lang, CALLS[lang])
        out[f"symbols_{lang}"] = f"SELECT name, kind, file, line FROM ({cq.planted(lang)})"
    return out | llm.SQL if llm else out
