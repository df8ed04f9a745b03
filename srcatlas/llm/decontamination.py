"""Benchmark decontamination with DataFrame functions only.

The benchmark's word windows are hashed into a set that is broadcast; every
window of every document is looked up in it, and a hit counts only if the words
themselves agree. The hash join, the check of the words and the filter are one
pass over the documents; what is shuffled are the hits and one row per document.

The set is broadcast in blocks of at most ``BLOCK_BYTES`` (measured before), so
a large benchmark means more passes, not a larger broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import lower_ascii, packed, private, stored, table

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_BYTES = 64 << 20


def words(text: Column) -> Column:
    """Words of a text: runs of digits, letters a-z and all beyond ASCII, after lower-casing A-Z; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: words, n, h, items (distinct ids). An item of fewer words than ``window`` is one window.

    Items without words have no window. A null item_id marks words but is in no list of ids.
    """
    items = private(benchmark, "item_id", "text").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    each = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item_id").alias("items")).select(
        "words", F.size("words").alias("n"), F.xxhash64("words").alias("h"), "items")


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, n_hit, items, spans.

    ``spans`` are the hit words as disjoint (start, end) word positions in
    order, ``items`` the distinct item_ids with an occurring window. Null and
    empty texts have no words. Rows that repeat id and text get a row each.
    An empty benchmark hits nothing.
    """
    known = stored(item_windows(benchmark, window), "windows")
    facts = known.agg(F.sum(F.size("words") * 40 + F.size("items") * 8 + F.octet_length(F.array_join("words", " "))).alias("bytes"),
                      F.collect_set("n").alias("lengths")).first()
    lengths = sorted(facts["lengths"])  # at most ``window`` numbers
    blocks = (facts["bytes"] or 0) // BLOCK_BYTES + 1
    passes = [(n, block) for n in (lengths or [window]) for block in range(blocks)]
    found = None
    for n, block in passes:
        part = known.where((F.col("n") == n) & (F.pmod("h", F.lit(blocks)) == block))
        part = _look_up(docs, part, n, first=(n, block) == passes[0])
        found = part if found is None else found.unionByName(part)
    found = stored(found, "hits")
    per_doc = found.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    spans = _spans(found.where("start IS NOT NULL"))
    both = per_doc.join(spans, per_doc["doc_id"].eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "items",
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))


def _spans(hits: DataFrame) -> DataFrame:
    """Overlapping and touching hits of a document joined to spans; one row per document with hits."""
    each = hits.groupBy("doc_id", "text_hash", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = each.withColumn("opens", F.when(before >= F.col("start"), 0).otherwise(1))
    numbered = opened.withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("doc_id", "text_hash", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _look_up(docs: DataFrame, known: DataFrame, n: int, first: bool) -> DataFrame:
    """Hits of windows of ``n`` words, and for the first pass a row with n_words for each document.

    One stage of generated code: the word array is held while its positions are
    exploded, and never copied into a row of its own. Position 0 stands for the document.
    """
    rows = private(docs, "doc_id", "text").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n + 1, F.lit(0)))
    each = rows.select("doc_id", "text_hash", "w", F.explode(starts).alias("start"))
    h = F.when(F.col("start") > 0, F.xxhash64(*[F.get("w", F.col("start") + (i - 1)) for i in range(n)]))
    each = each.select("doc_id", "text_hash", "w", "start", h.alias("h"))
    known = known.select(F.col("h").alias("_h"), F.col("words").alias("_words"), "n", "items")
    joined = each.join(F.broadcast(known), F.col("h") == F.col("_h"), "left")
    # the words of a hit are compared only where the hashes met
    checked = F.col("_h").isNotNull() & (F.slice("w", F.greatest("start", F.lit(1)), F.lit(n)) == F.col("_words"))
    wanted = (F.col("start") == 0) | checked if first else checked
    return joined.where(wanted).select(
        "doc_id", "text_hash", F.when(F.col("start") == 0, F.size("w")).alias("n_words"),
        F.when(F.col("start") > 0, F.col("start") - 1).alias("start"), "n", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents, or with the words of the spans removed; the same columns.

    With ``remove="spans"`` a hit document's text becomes its remaining words
    (lower-cased, one blank between them); others stay as they are.
    """
    hits = contaminated_words(docs, benchmark, window).where("n_hit > 0").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans").dropDuplicates(["_id", "_hash"])
    rows = packed(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("text_hash"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    if remove == "documents":
        return rows.join(hits, on, "left_anti").select("row.*")
    inside = F.sequence(F.lit(0), F.size("w") - 1)
    rest = F.filter(F.arrays_zip("w", inside.alias("at")), lambda x: ~F.exists("spans", lambda s: (s["start"] <= x["at"]) & (x["at"] < s["end"])))
    cut = rows.join(hits, on, "left").withColumn("w", words(F.col("row.text")))
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(rest, lambda x: x["w"]), " "))
    return cut.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op1_decontamination(spark, sf_dir):
    found = contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", F.col("n_words").cast("long"), "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP1_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS words FROM (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
doc_windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, d.n FROM doc_windows d JOIN item_windows USING (n, words)),
hit_words AS (SELECT doc_id, count(*) AS n_hit FROM (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
  SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
