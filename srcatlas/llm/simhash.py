"""SimHash near-dedup by covering locality-sensitive hashing.

Masks. Bit i of a fingerprint gets a nonzero vector of ``radius + 1`` bits; the
table of a nonzero vector v keeps the bits whose vector has odd overlap with v.
If two fingerprints differ in at most ``radius`` bits, fewer vectors than
dimensions are involved, so some v has even overlap with all of them, and the
pair agrees in that table's key. For radius 4 that is 31 tables of 32 to 34
bits, and no pair within the radius is missed.

Buckets. Only distinct fingerprints go into the tables; copies are members of
their fingerprint. Buckets of one are dropped, buckets of two are compared by
column functions, larger ones in Arrow batches. There a breadth-first search
emits a spanning forest of the links within the radius, never all pairs; a
bucket above ``BLOCK`` fingerprints is dealt to pairs of blocks, so that no task
holds more than two blocks of it. The comparisons within one bucket grow with
the square of its distinct fingerprints, its rows with square / BLOCK.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import by_class, packed, private, small_batches, stored, table
from .components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
BLOCK = 2000
ROWS_PER_TASK = 200_000
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z lower-cased, as a signed integer; 0 without words.

    With fewer words than ``shingle`` all of them are the one shingle. A bit is
    set if it is set in more than half of the shingles' XXH64.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist())
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in spans]), np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(hashes[at:at + CHUNK], axis=1).sum(0, dtype=np.int64) for at in range(0, len(hashes), CHUNK))
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) of each row of ``docs``; null texts have no words."""
    small_batches(docs.sparkSession)
    rows = private(docs, "doc_id", "text").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches):
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), fps], ["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(each, f"doc_id {kind}, text_hash long, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """Signed 64-bit masks of the covering tables."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(64)]
    out = []
    for v in range(1, 2 ** (radius + 1)):
        kept = sum(1 << i for i, own in enumerate(vectors) if (own & v).bit_count() % 2)
        out.append(kept - (1 << 64) if kept >> 63 else kept)
    return out


def close_links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``: enough of those within the radius to connect all of them."""
    entries = distinct.select("fp", F.posexplode(F.lit(masks(radius))).alias("t", "mask")).select(
        "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    buckets = stored(entries.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                     .where("n > 1"), "buckets")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = buckets.where((F.col("n") == 2) & near).select("a", "b")

    large = buckets.where("n > 2").select(F.col("t").alias("_t"), F.col("key").alias("_key"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = entries.join(large, (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key")))
    members = members.withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = members.select("t", "key", "fp", "own", "blocks", other.alias("other")).where("blocks = 1 OR own <> other")
    group = F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = stored(dealt.select(group.alias("bucket"), "fp"), "members")
    tasks = dealt.count() // ROWS_PER_TASK + 1
    by_task = dealt.groupBy(F.pmod("bucket", F.lit(tasks)).alias("task"))
    return pairs.unionByName(by_task.applyInArrow(lambda t: _forests(t, radius), "a long, b long")).distinct()


def _forests(members: pa.Table, radius: int) -> pa.Table:
    """Links that connect what is within the radius, for each bucket of a task."""
    bucket, fp = (members.column(c).to_numpy() for c in ("bucket", "fp"))
    fp = fp.astype(np.int64).view(np.uint64)
    order = np.argsort(bucket, kind="stable")
    bucket, fp = bucket[order], fp[order]
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.append(starts, len(bucket)))
    a, b = [], []
    small = np.repeat(np.where(sizes <= 8, sizes, 0), sizes)
    place = np.arange(len(bucket)) - np.repeat(starts, sizes)
    for step in range(1, 8):  # small buckets: each member with the one ``step`` ahead
        i = np.flatnonzero(place + step < small)
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= radius]
        a.append(fp[i]), b.append(fp[i + step])
    for start, size in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
        rest = fp[start:start + size]
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                at = queue.pop()
                close = np.bitwise_count(rest ^ at) <= radius
                found = rest[close]
                if len(found):
                    rest = rest[~close]
                    queue.extend(found)
                    a.append(np.full(len(found), at)), b.append(found)
    columns = [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (a, b)]
    return pa.table({"a": columns[0], "b": columns[1]})


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, fp, component_id, root.

    Documents are linked at ``radius`` or fewer differing bits; component_id is
    the smallest doc_id reachable over links. Texts without words have
    fingerprint 0 and are linked like any other. Rows that repeat an id get a
    row each. Null ids take part and never are the smallest; a component of null
    ids has a null component_id. ``root`` is one fingerprint of the component,
    the same for all its rows. No rows give no rows.
    """
    found = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members")), "distinct")
    roots = connected_components(stored(close_links(distinct.select("fp", "first"), radius), "close"))
    classes = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "members", F.coalesce("root", "fp").alias("root"))
    classes = stored(classes, "classes")
    components = stored(classes.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members")), "components")
    named = by_class(classes.select("fp", "root", F.col("members").alias("copies")), components, "root", heavy=200, most=100_000)
    names = stored(named.select("fp", "component_id", "root", F.col("copies").alias("members")), "names")
    return by_class(found, names, "fp", heavy=200, most=100_000).select("doc_id", "text_hash", "fp", "component_id", "root")


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id; the same columns.

    Of rows that repeat that id one stays, that of the smallest text hash; of a
    component without ids as well.
    """
    found = near_duplicates(docs, shingle, radius)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")).alias("first")).select(
        F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    rows = packed(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("text_hash"))
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.lit(1)))
    return kept.withColumn("_nth", nth).where("_nth = 1").select("row.*")


def op4_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
