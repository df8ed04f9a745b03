"""Corpora rendered by Spark expressions from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpora.templates import LANG_ORDER, TEMPLATES
from srcatlas import configure
from srcatlas.functions.langs import EXTENSIONS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.lit(values), (index + 1).cast("int"))


def _measured(spark: SparkSession, texts: DataFrame, size: Column) -> None:
    """Tells the session how many bytes of text there are."""
    configure(spark, texts.agg(F.sum(size)).first()[0])


def part_files(spark: SparkSession, sf_dir: str, lang: str | None = None, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """One source file per part: in ``lang``, or spread over all nine."""
    k, count = F.col("k"), len(LANG_ORDER)
    # A few bytes of a part become a whole file: spread them first, or one task writes all files.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type").repartition("p_partkey").selectExpr(
        "p_partkey AS k", "replace(p_name, ' ', '_') AS n",
        "concat_ws('/', 'proj', lower(replace(p_brand, '#', '')), lower(p_type)) AS dir")
    chosen = _pick(LANG_ORDER, k % count) if lang is None else F.lit(lang)
    nth = F.floor(k / count) if lang is None else k
    langs = [lang] if lang else LANG_ORDER
    bodies = {name: "\n".join(templates[name]) + "\n" for name in langs}
    texts = F.create_map(*[F.lit(x) for name, body in bodies.items() for x in (name, body)])
    exts = F.create_map(*[F.lit(x) for name in langs for x in (name, EXTENSIONS[name])])
    parts = parts.select("*", chosen.alias("lang"), nth.alias("nth"))
    sizes = F.create_map(*[F.lit(x) for name, body in bodies.items() for x in (name, [len(body.encode()), body.count("{k}"), body.count("{n}")])])
    size = F.element_at(sizes, F.col("lang"))
    _measured(spark, parts, size[0] + size[1] * (F.length(k.cast("string")) - 3) + size[2] * (F.octet_length("n") - 3))
    parts = parts.select("*", F.element_at(texts, F.col("lang")).alias("template"),
                         F.element_at(exts, F.col("lang")).alias("exts"))
    return parts.selectExpr(
        "concat(dir, '/', n, '_', k, '.', element_at(exts, CAST(nth % size(exts) + 1 AS INT))) AS path", "lang",
        "encode(replace(replace(template, '{k}', CAST(k AS STRING)), '{n}', n), 'UTF-8') AS content",
        "CAST(1700000000 + k AS BIGINT) AS mtime_secs", "CAST(k * 7919 % 1000000000 AS BIGINT) AS mtime_nanos", "k")


def part_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(indexed, found): two states of the part corpus.

    Between them a tenth of the files is deleted and a tenth is new; of the
    rest a quarter has another time (half of those an older one) and one more
    blank line at the top.
    """
    k = F.col("k")
    files = part_files(spark, sf_dir)
    step = F.when(k % 8 == 0, 1).when(k % 8 == 4, -1).otherwise(0)
    touched = (k % 10 != 3) & (k % 4 == 0)
    blank = F.encode(F.lit("\n"), "UTF-8")
    found = files.where(k % 10 != 7).withColumns({
        "mtime_secs": F.col("mtime_secs") + step,
        "content": F.when(touched, F.concat(blank, F.col("content"))).otherwise(F.col("content")),
    })
    return files.where(k % 10 != 3), found


def call_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python file per order; each order line is a call or a method call."""
    lines = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    call = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("    part_"), F.col("l_partkey"), F.lit("()"))) \
        .otherwise(F.concat(F.lit("    self.part_"), F.col("l_partkey"), F.lit("()")))
    _measured(spark, lines, F.octet_length(call) + 1)
    numbered = lines.select("l_orderkey", F.row_number().over(order).alias("i"), call.alias("call"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "call"))), lambda s: s["call"]), "\n")
    files = numbered.groupBy("l_orderkey").agg(body.alias("body"))
    key = F.col("l_orderkey")
    return files.select(
        F.concat(F.lit("calls/o"), key, F.lit(".py")).alias("path"), F.lit("python").alias("lang"),
        F.encode(F.concat(F.lit("def order_"), key, F.lit("(self):\n"), F.col("body"), F.lit("\n")), "UTF-8")
        .alias("content"))


def nation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python file per nation with a function per order: long files."""
    orders = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    body = F.transform(F.array_sort(F.collect_list("o_orderkey")),
                       lambda o: F.concat(F.lit("def order_"), o, F.lit("(): pass")))
    files = orders.groupBy("c_nationkey").agg(F.array_join(body, "\n").alias("body"))
    return files.select(
        F.concat(F.lit("nations/n"), F.col("c_nationkey"), F.lit(".py")).alias("path"),
        F.lit("python").alias("lang"), F.encode("body", "UTF-8").alias("content"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python file per document: the whole text is a doc string between
    two functions, so the second one's line depends on every line break."""
    doc = F.col("doc_id")
    safe = F.replace(F.replace("text", F.lit("\\"), F.lit("/")), F.lit('"'), F.lit("'"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/"), F.col("source"), F.lit("/d"), doc, F.lit(".py")).alias("path"),
        F.lit("python").alias("lang"),
        F.encode(F.concat(
            F.lit("def before_"), doc, F.lit('():\n    """'), safe, F.lit('"""\ndef after_'), doc,
            F.lit("(): pass\n")), "UTF-8").alias("content"))


def supplier_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(paths, markers): one source file per supplier; some suppliers and some
    nations are project roots."""
    rows = table(spark, sf_dir, "supplier").selectExpr(
        "concat('ws/n', s_nationkey) AS nation", "concat('ws/n', s_nationkey, '/s', s_suppkey) AS home",
        "s_nationkey", "s_suppkey")
    marked = rows.where("s_nationkey % 3 = 0").selectExpr("nation AS dir").unionByName(
        rows.where("s_suppkey % 5 = 0").selectExpr("home AS dir")).distinct()
    return rows.selectExpr("concat(home, '/src/f.py') AS path"), marked


SUPPLIER_FILES = ["src/f.py", "build/o.py", "a.gen.py", "keep.gen.py", ".hid/h.py"]


def supplier_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files, ignore lines): five files per supplier; generated files are
    ignored everywhere but one, ``build/`` in nations with even numbers."""
    rows = table(spark, sf_dir, "supplier")
    names = F.explode(F.lit(SUPPLIER_FILES)).alias("name")
    files = rows.select("s_nationkey", "s_suppkey", names).selectExpr(
        "concat('ws/n', s_nationkey, '/s', s_suppkey, '/', name) AS path", "'python' AS lang")
    top = rows.selectExpr("inline(array(struct('ws' AS dir, 1L AS rank, '*.gen.py' AS line),"
                          " struct('ws' AS dir, 2L AS rank, '!keep.gen.py' AS line)))")
    even = rows.where("s_nationkey % 2 = 0").selectExpr(
        "concat('ws/n', s_nationkey) AS dir", "1L AS rank", "'build/' AS line")
    return files, top.unionByName(even).distinct()


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change per event: an error deletes the file, all else rewrites it."""
    # Times without a zone: read as UTC whatever the session says.
    micros = "unix_micros(CAST(concat(CAST(ts AS STRING), 'Z') AS TIMESTAMP))"
    return table(spark, sf_dir, "events").selectExpr(
        "concat('u', user_id, '/f', event_id % 7, '.py') AS path",
        f"{micros} DIV 1000000 AS mtime_secs", f"{micros} % 1000000 * 1000 AS mtime_nanos",
        "CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op",
        "encode(concat('def ev_', event_id, '(): pass\n'), 'UTF-8') AS content")


def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region hierarchy as a table of tree nodes, one file per region."""
    region, nation, customer, orders, lineitem = (
        table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "lineitem"))
    nations = nation.selectExpr("n_nationkey", "n_name", "n_regionkey AS region")
    customers = customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    items = lineitem.withColumn("i", F.row_number().over(order)).join(placed, F.col("l_orderkey") == F.col("o_orderkey"))

    # Twice the id is a position that leaves room for a segment right after its customer.
    def nodes(rows, file, node_id, parent_id, field, kind, text, pos=None):
        return rows.selectExpr(
            f"concat('region_', {file}) AS file", f"CAST({node_id} AS BIGINT) AS node_id",
            f"CAST({parent_id} AS BIGINT) AS parent_id", f"CAST({field} AS STRING) AS field", f"'{kind}' AS type",
            f"CAST({text} AS STRING) AS text", "1L AS start_line", "1L AS end_line", f"CAST({pos or f'2 * ({node_id})'} AS BIGINT) AS pos")

    out = nodes(region, "r_regionkey", "0", "null", "null", "region", "r_name")
    for part in (
        nodes(nations, "region", "1 + n_nationkey", "0", "null", "nation", "n_name"),
        nodes(customers, "region", "1000 + c_custkey", "1 + n_nationkey", "null", "customer", "c_name"),
        nodes(customers, "region", "1000000000000 + 1000 + c_custkey", "1000 + c_custkey", "'segment'", "segment",
              "c_mktsegment", "2 * (1000 + c_custkey) + 1"),
        nodes(placed, "region", "10000000 + o_orderkey", "1000 + c_custkey", "null", "order", "o_orderkey"),
        nodes(placed, "region", "1000000000000 + 10000000 + o_orderkey", "10000000 + o_orderkey", "'status'", "status",
              "o_orderstatus"),
        nodes(items, "region", "1000000000 + l_orderkey * 1000 + i", "10000000 + o_orderkey", "null", "item",
              "l_partkey"),
    ):
        out = out.unionByName(part)
    return out
