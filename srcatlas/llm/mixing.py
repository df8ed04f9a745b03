"""Mixing sources to target weights.

Every document gets a hash-random key; documents are range-sorted by source and
key, distributed prefix sums of their sizes are taken (``common.prefix_sums``),
and each source is cut at its exact budget. A budget above the source's size
takes whole epochs first and cuts the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import NOT_BLANKS, packed, prefix_sums, private, table, word_count

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Words to take from each source: source, source_size, target.

    ``sizes`` has one row per source. Sources by code point, null last, weigh
    ``weights`` in turn and share the sum of all sizes; a target stops at
    ``most`` times its source's size and the excess is shared again by weight
    until none is above. That is target = least(cap, weight * level): with
    sources in the order of cap / weight, the level follows from prefix sums
    over those that stop. The windows here run over one row per source.
    """
    ranked = sizes.select("source", "source_size", F.row_number().over(
        Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))).alias("n"))
    weighed = ranked.select("source", "source_size", F.element_at(F.lit(list(weights)), (F.col("n") - 1) % len(weights) + 1)
                            .cast("long").alias("weight"), (F.col("source_size") * most).alias("cap"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").isNull(), "source")
    ahead, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    steps = weighed.withColumns({
        "left_words": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(ahead), F.lit(0)),
        "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0))})
    level = F.col("left_words") / F.col("left_weight")
    # the first source that does not stop sets the level for itself and all after it
    steps = steps.withColumn("level", F.first(F.when(level <= F.col("cap") / F.col("weight"), level), True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    wanted = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce("level", F.lit(float("inf"))))
    return steps.select("source", "source_size", wanted.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 9) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, source, size, source_size, target, taken.

    Size is the number of words (null text: 0). ``taken`` counts repeats and
    may end within a document, so that each source gives exactly its rounded
    target. The order within a source depends on id, text and seed only, so
    reruns agree; rows that repeat both are interchangeable. Null ids and null
    sources take part like any other. No rows give no rows.
    """
    sized = private(docs, "doc_id", "text", "source").select(
        "doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("text_hash"), word_count(F.col("text")).alias("size"))
    sized = sized.withColumn("key", F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_hash")))
    ordered = prefix_sums(sized, ["key", "doc_id", "text_hash"], ["size"], ["source"], "mixing")
    totals = ordered.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(totals, weights, most).withColumnRenamed("source", "_source")
    rows = ordered.join(wanted, ordered["source"].eqNullSafe(F.col("_source")))
    return rows.select("doc_id", "text_hash", "source", "size", "source_size", "target", _taken().alias("taken"))


def _taken() -> Column:
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("size_before")
    return (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once for each time, the last one cut where the budget ends.

    The columns are those of ``docs``. A cut text holds its first words with
    single blanks between them, and n_chars, where that is a column, follows.
    Documents without words are in no budget and go. Rows that repeat id, text
    and source are told apart by a running number.
    """
    plan = mix(docs, **options).where("taken > 0")
    key = ["doc_id", "text_hash", "source"]
    plan = plan.select(*[F.col(k).alias(f"_{k}") for k in key], "size", "taken",
                       F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("taken"))).alias("_nth"))
    rows = packed(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.md5(F.coalesce("row.text", F.lit(""))).alias("text_hash"),
                               F.col("row.source").alias("source"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))
    on = (F.col("nth") == F.col("_nth")) & F.col("text_hash").eqNullSafe(F.col("_text_hash"))
    both = rows.join(plan, on & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")))
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    copies = both.select("row", "size", F.explode(F.sequence(F.lit(1), times)).alias("copy"), "taken")
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(NOT_BLANKS), F.lit(0)), F.lit(1), left.cast("int")), " ")
    text = F.when(left < F.col("size"), cut).otherwise(F.col("row.text"))
    out = copies.withColumns({"text": text, "is_cut": left < F.col("size")})
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("is_cut"), F.length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op9_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('9/' || coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))) AS key, md5(coalesce(text, '')) AS h FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS n FROM sized GROUP BY source),
weighed AS (SELECT *, (n - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM sources),
steps AS (SELECT *, ((SELECT sum(source_size) FROM weighed) - coalesce(sum(cap) OVER ahead, 0))
    / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER ahead, 0)) AS level, row_number() OVER o AS k FROM weighed
    WINDOW o AS (ORDER BY cap / weight, source IS NULL, source), ahead AS (ORDER BY cap / weight, source IS NULL, source
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM steps WHERE level <= cap / weight ORDER BY k LIMIT 1)) AS target FROM steps),
ordered AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM sized),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs
    FROM ordered o JOIN targets t ON o.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
       (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - ahead)))::BIGINT AS taken FROM cut
"""
