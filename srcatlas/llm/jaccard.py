"""N-gram Jaccard join by blocked sparse products of the document by n-gram incidence.

Classes. Documents with one and the same set of word n-grams are one class; a
row of the incidence matrix is a class. N-grams and classes are named by 64-bit
hashes.

Columns. An n-gram of one class only adds to no overlap. So the n-grams are
dealt to parts by hash, each part counts the classes of each, and what a single
class has is left out of its row; only its number stays. Two sets of sizes a
and b link at an overlap of at least ``least`` percent of their union, so of at
least that share of the larger set. A class that shares fewer of its n-grams
with anyone can link with nobody and is discarded. So is every pair that has no
n-gram in common among the rarest ones of both rows, as many as the bound
allows to differ, and every pair whose sizes are too far apart.

Families. Rows that share one of those rare n-grams, over any chain, form a
family. A family above ``BLOCK`` rows is split by size (rows that may link are
in the same or the next size class) and by hash into blocks; each pair of blocks
is one product of two sparse matrices, whose common columns are multiplied in
slices and whose overlap counts are accumulated. Each pair of rows meets in one
product. A product emits, for each of its rows, the number of its links and one
link to the smallest row that it reaches in it, never all pairs. No task holds
more than two blocks of a family; the products grow with the square of a family.

N-grams that a sample finds in a large share of the classes are not dealt to
parts, since one part would get a row of every class: they count as shared by
all and come last in the order by frequency. Which ones these are changes the
plan, not the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import by_class, private, small_batches, stored, table
from .components import connected_components

SHINGLE = 4
LEAST = 85
PART = 3_000_000
BLOCK = 256
SAMPLE = 2000
COLUMNS = 4096
TASK_BYTES = 32 << 20
BROADCAST_CLASSES = 2_000_000
CID = "cid long, n int"


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word n-grams of a text, A-Z lower-cased.

    With fewer words than ``shingle`` all of them are the one n-gram; without words the set is empty.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - width + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(joined[s:e]) for s, e in zip(starts, ends[width - 1:].tolist())], np.uint64))


def _class_id(x: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes()))))


def _flat(column, kind=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, one after the other, and how many each row has."""
    values, counts = [np.empty(0, kind)], [np.empty(0, np.int64)]
    for array in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        at = np.frombuffer(array.buffers()[1], np.int32)[array.offset:array.offset + len(array) + 1]
        if len(array) and array.buffers()[2] is not None:
            values.append(np.frombuffer(np.frombuffer(array.buffers()[2], np.uint8)[at[0]:at[-1]].tobytes(), kind))
        counts.append(np.diff(at).astype(np.int64) // np.dtype(kind).itemsize)
    return np.concatenate(values), np.concatenate(counts)


def _ragged(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: ``counts[i]`` of the values in row i."""
    at = np.concatenate(([0], np.cumsum(counts * values.itemsize))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])


def _named(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, cid, n) of each row; without words n is 0 and cid null."""
    rows = private(docs, "doc_id", "text")

    def each(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([_class_id(x) if len(x) else None for x in sets], pa.int64()),
                pa.array([len(x) for x in sets], pa.int32())], ["doc_id", "cid", "n"])

    return rows.mapInArrow(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {CID}")


def _new_classes(batches, shingle: int):
    """(cids, sets) of each batch, without classes that the task has met before."""
    met: set[int] = set()
    for batch in batches:
        cids, sets = [], []
        for text in batch.column("text"):
            x = shingle_set(text.as_py(), shingle)
            if len(x) and (cid := _class_id(x)) not in met:
                met.add(cid)
                cids.append(cid)
                sets.append(x)
        if cids:
            yield np.array(cids, np.int64), sets


def _frequent(texts: DataFrame, shingle: int, classes: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that many of a sample of the classes have, sorted, and in how many.

    The sample grows with the number of classes, so that no part gets an n-gram
    of more than about a sixth of ``PART`` classes.
    """
    wanted = max(sample, 60 * classes // PART)
    span = 1 << 30
    share = min(1.0, wanted / max(1, classes))
    drawn = texts.where(F.pmod(F.xxhash64("text"), F.lit(span)) < int(share * span))

    def each(batches):
        for cids, sets in _new_classes(batches, shingle):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(cids, [len(x) for x in sets]))], ["s", "cid"])

    counts = drawn.mapInArrow(each, "s long, cid long").distinct().groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c >= 10")
    # at most a tenth of the sample's n-grams, 16 bytes each
    rows = sorted((r.s & 0xFFFFFFFFFFFFFFFF, r.c) for r in counts.toLocalIterator())
    return np.array([s for s, _ in rows], np.uint64), np.array([c for _, c in rows], np.int64)


def _shared_rows(texts: DataFrame, shingle: int, parts: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(cid, n, x, df): the n-grams of a class that other classes have as well, and how many classes have each."""
    hot = texts.sparkSession.sparkContext.broadcast(frequent)

    def deal(batches):
        often = hot.value[0]
        for cids, sets in _new_classes(batches, shingle):
            x, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            part = (x >> np.uint64(17)) % np.uint64(parts)
            if len(often):  # parts from ``parts`` on hold the frequent ones, by class
                found = often[np.minimum(np.searchsorted(often, x), len(often) - 1)] == x
                part = np.where(found, np.uint64(parts) + cids.view(np.uint64)[row] % np.uint64(parts), part)
            order = np.lexsort((row, part))
            x, row, part = x[order], row[order], part[order]
            pieces = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (part[1:] != part[:-1]))))
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            held = np.diff(np.append(np.searchsorted(pieces, starts), len(pieces)))  # classes in each part
            sizes = np.array([len(s) for s in sets], np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(part[starts].astype(np.int64)), _ragged(cids[row[pieces]], held), _ragged(sizes[row[pieces]], held),
                _ragged(np.diff(np.append(pieces, len(x))).astype(np.int32), held), _ragged(x, np.diff(np.append(starts, len(x))))],
                ["part", "cid", "n", "k", "x"])

    def count(rows: pa.Table) -> pa.Table:
        x, each = _flat(rows.column("x"))[0], _flat(rows.column("k"), np.int32)[0]
        cid, n = (np.repeat(_flat(rows.column(c), kind)[0], each) for c, kind in (("cid", np.int64), ("n", np.int32)))
        frequent = rows.column("part")[0].as_py() >= parts
        if not frequent:  # most have one row only
            order = np.argsort(x, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], x[order][1:] != x[order][:-1])))
            runs = np.diff(np.append(starts, len(x)))
            order = order[np.repeat(runs > 1, runs)]
            x, cid, n = x[order], cid[order], n[order]
        order = np.lexsort((cid, x))  # a class may come from several tasks
        x, cid, n = x[order], cid[order], n[order]
        new = np.concatenate(([True], (x[1:] != x[:-1]) | (cid[1:] != cid[:-1])))[:len(x)]
        x, cid, n = x[new], cid[new], n[new]
        if frequent:
            often, times = hot.value
            df = times[np.searchsorted(often, x)] + (1 << 40)
        else:
            starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))[:len(x)])
            runs = np.diff(np.append(starts, len(x)))
            df = np.repeat(runs, runs)
        kept = df > 1
        return pa.table({"cid": cid[kept], "n": n[kept], "x": x[kept].view(np.int64), "df": df[kept]})

    dealt = texts.mapInArrow(deal, "part long, cid binary, n binary, k binary, x binary")
    return dealt.groupBy("part").applyInArrow(count, f"{CID}, x long, df long")


def _least_overlap(n: int, least: int) -> int:
    return -(-least * n // 100)


def _live_rows(shared: DataFrame, least: int) -> DataFrame:
    """(cid, n, x, rare): rows that share enough to link, with their shared n-grams sorted,
    and those of them among which a linked row must have one as well."""
    able = shared.groupBy("cid").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k")).where(f"k * 100 >= n * {least}")
    able = stored(able.select("cid"), "able")
    if able.count() <= BROADCAST_CLASSES:  # 8 bytes each; beyond, shared n-grams are shuffled to their classes
        able = F.broadcast(able)
    whole = shared.join(able, "cid", "left_semi").groupBy("cid").agg(F.max("n").alias("n"), F.collect_list(F.struct("x", "df")).alias("grams"))

    def each(batches):
        for batch in batches:
            rest, rare = [], []
            grams = batch.column("grams")
            values, at = grams.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(grams).to_numpy(zero_copy_only=False))))
            every, times = values.field("x").to_numpy().view(np.uint64), values.field("df").to_numpy()
            for i, n in enumerate(batch.column("n").to_pylist()):
                x, df = every[at[i]:at[i + 1]], times[at[i]:at[i + 1]]
                order = np.lexsort((x, df))
                differing = n - _least_overlap(n, least)  # so many may be in no linked row
                rare.append(x[order][:differing + 1 - (n - len(x))].view(np.int64))
                rest.append(np.sort(x).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("n"), pa.array(rest, pa.binary()), pa.array(rare, pa.list_(pa.int64()))],
                                             ["cid", "n", "x", "rare"])

    return whole.mapInArrow(each, f"{CID}, x binary, rare array<long>")


def _families(live: DataFrame) -> DataFrame:
    """(cid, family): rows that share a rare n-gram over any chain, at least two of them."""
    rare = live.select("cid", F.explode("rare").alias("s"))
    hubs = rare.groupBy("s").agg(F.min("cid").alias("a"), F.max("cid").alias("b"), F.count(F.lit(1)).alias("members")).where("a < b")
    links = by_class(rare, hubs, "s").select(F.col("cid").alias("a"), F.col("a").alias("b")).distinct()
    return connected_components(stored(links, "chains")).select(F.col("node").alias("cid"), F.col("root").alias("family"))


def _size_class(n, least: int):
    """Sizes that can link are in the same class or in neighbouring ones."""
    return F.floor(F.log(n) / (float(np.log(100 / least)) + 1e-9)).cast("int")


def _dealt(rows: DataFrame, least: int, block: int) -> DataFrame:
    """(unit, side, cid, n, members, x): each row to every product that it takes part in."""
    kept = ["cid", "n", "members", "x"]
    sizes = rows.groupBy("family").agg(F.count(F.lit(1)).alias("rows"))
    large = stored(sizes.where(F.col("rows") > block), "large")
    few = large.count() <= 1_000_000  # 16 bytes each
    large = F.broadcast(large) if few else large
    small = rows.join(large, "family", "left_anti").select(F.xxhash64("family").alias("unit"), F.lit(2).alias("side"), *kept)
    split = rows.join(large, "family").select("family", _size_class(F.col("n"), least).alias("c"), *kept)
    blocks = stored(split.groupBy("family", "c").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "blocks")
    if few and blocks.count() <= 1_000_000:
        blocks = F.broadcast(blocks)
    above, below = (blocks.select("family", (F.col("c") + d).alias("c"), F.col("blocks").alias(name)) for d, name in ((-1, "up"), (1, "down")))
    split = split.join(blocks, ["family", "c"]).join(above, ["family", "c"], "left").join(below, ["family", "c"], "left")
    split = split.withColumn("h", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))

    def numbers(count):
        return F.sequence(F.lit(0), F.coalesce(F.col(count), F.lit(0)) - 1) if count == "blocks" else F.when(
            F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))

    c, h = F.col("c"), F.col("h")
    places = F.concat(
        F.transform(numbers("blocks"), lambda o: F.struct(c.alias("c1"), F.least(h, o).alias("h1"), c.alias("c2"), F.greatest(h, o).alias("h2"),
                                                          F.when(h == o, 2).when(h < o, 0).otherwise(1).alias("side"))),
        F.transform(numbers("up"), lambda o: F.struct(c.alias("c1"), h.alias("h1"), (c + 1).alias("c2"), o.alias("h2"), F.lit(0).alias("side"))),
        F.transform(numbers("down"), lambda o: F.struct((c - 1).alias("c1"), o.alias("h1"), c.alias("c2"), h.alias("h2"), F.lit(1).alias("side"))))
    split = split.select("family", F.explode(places).alias("p"), *kept).select(
        F.xxhash64("family", "p.c1", "p.h1", "p.c2", "p.h2").alias("unit"), "p.side", *kept)
    return small.unionByName(split)


def _overlaps(x: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Overlap counts of all pairs of rows: the incidence matrix times its transpose, in slices of columns."""
    order = np.argsort(x, kind="stable")
    x, row = x[order], row[order]
    new = np.concatenate(([True], x[1:] != x[:-1]))
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1
    _, column = np.unique(column[common], return_inverse=True)
    row = row[common]
    out = np.zeros((rows, rows), np.int64)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + COLUMNS + 1, COLUMNS))
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            part = np.zeros((rows, COLUMNS), np.float32)
            part[row[a:b], column[a:b] - i * COLUMNS] = 1
            out += (part @ part.T).astype(np.int64)
    return out


def _products(rows: pa.Table, least: int) -> pa.Table:
    """(a, b, links): for each row of a product with links, the smallest row that it reaches there and its number of links."""
    unit, side, cid, n, members = (rows.column(c).to_numpy() for c in ("unit", "side", "cid", "n", "members"))
    x, counts = _flat(rows.column("x"))
    ends = np.cumsum(counts)
    order = np.argsort(unit, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], unit[order][1:] != unit[order][:-1])))
    a, b, links = [], [], []
    for at in np.split(order, starts[1:]):
        if len(at) < 2:
            continue
        sets = [x[ends[i] - counts[i]:ends[i]] for i in at]
        overlap = _overlaps(np.concatenate(sets), np.repeat(np.arange(len(at)), counts[at]), len(at))
        size = n[at].astype(np.int64)
        linked = (100 + least) * overlap >= least * (size[:, None] + size[None, :])
        mine = side[at]
        linked &= (mine[:, None] != mine[None, :]) | (mine[:, None] == 2)
        np.fill_diagonal(linked, False)
        some = np.flatnonzero(linked.any(1))
        left, name = set(some.tolist()), cid[at]
        while left:
            seen = queue = np.array([left.pop()])
            while len(queue):
                near = np.flatnonzero(linked[queue].any(0))
                queue = np.array([i for i in near.tolist() if i in left], np.int64)
                left.difference_update(queue.tolist())
                seen = np.concatenate((seen, queue))
            a.append(name[seen])
            b.append(np.full(len(seen), name[seen].min()))
            links.append(linked[seen] @ members[at])
    empty = np.empty(0, np.int64)
    return pa.table({k: np.concatenate(v) if v else empty for k, v in (("a", a), ("b", b), ("links", links))})


def jaccard_links(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST, block: int = BLOCK, part: int = PART,
                  sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, n_links.

    Two rows link when their sets overlap in at least ``least`` percent of their
    union. component_id is the smallest doc_id reachable over links, the row's
    own included; n_links is the number of other rows that it links with, equal
    sets among them. Null texts and texts without words have an empty set and
    link with nothing. Rows that repeat an id get a row each and are documents of
    their own. Null ids take part and never are the smallest; where only null
    ids are reachable, component_id is null. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    texts = private(docs, "text")
    names = stored(_named(docs, shingle), "sets")
    classes = stored(names.where("n > 0").groupBy("cid").agg(
        F.max("n").alias("n"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members")), "classes")
    facts = classes.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("n").cast("long")).alias("n")).first()
    parts = (facts["n"] or 0) // part + 1
    frequent = _frequent(texts, shingle, facts["rows"], sample)
    shared = stored(_shared_rows(texts, shingle, parts, frequent), "shared")
    live = stored(_live_rows(shared, least), "live")
    places = _families(live).join(classes.select("cid", "members"), "cid")
    rows = stored(live.select("cid", "n", "x").join(places, "cid"), "families")
    dealt = stored(_dealt(rows, least, block), "products")
    tasks = (dealt.agg(F.sum(F.octet_length("x") + 64).alias("b")).first()["b"] or 0) // TASK_BYTES + 1
    found = dealt.groupBy(F.pmod("unit", F.lit(tasks)).alias("task")).applyInArrow(lambda t: _products(t, least), "a long, b long, links long")
    found = stored(found, "links")
    roots = connected_components(found.select("a", "b"))
    counted = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    linked = classes.join(roots, F.col("cid") == F.col("node"), "left").select("cid", "first", "members", F.coalesce("root", "cid").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = linked.join(smallest, "root").join(counted, "cid", "left").select(
        "cid", "members", "component_id", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    worded = by_class(names.where("n > 0"), stored(facts, "found"), "cid").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links")
    return worded.unionByName(names.where("n = 0").select(
        "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


OP11_SQL = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM docs),
sized AS (SELECT r, doc_id, s, len(s) AS n FROM sets),
texts AS (SELECT list_sort(s) AS k, min(r) AS c, any_value(n) AS n, min(doc_id) AS first, count(*) AS members FROM sized WHERE n > 0 GROUP BY 1),
grams AS (SELECT c, n, unnest(k) AS g FROM texts),
links AS (SELECT a.c AS a, b.c AS b FROM grams a JOIN grams b ON a.g = b.g AND a.c <> b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
smallest AS (SELECT a, min(first) AS first FROM reach JOIN texts ON texts.c = reach.b GROUP BY a),
partners AS (SELECT a, sum(members) AS linked FROM links JOIN texts ON texts.c = links.b GROUP BY a)
SELECT sized.doc_id AS doc_id, sized.n::BIGINT AS n_shingles,
    CASE WHEN sized.n = 0 THEN sized.doc_id ELSE least(texts.first, coalesce(smallest.first, texts.first)) END AS component_id,
    CASE WHEN sized.n = 0 THEN 0 ELSE coalesce(linked, 0) + members - 1 END::BIGINT AS n_links
FROM sized LEFT JOIN texts ON sized.n > 0 AND list_sort(sized.s) = texts.k LEFT JOIN smallest ON smallest.a = texts.c LEFT JOIN partners ON partners.a = texts.c
"""


def op11_jaccard_join(spark, sf_dir):
    return jaccard_links(table(spark, sf_dir, "documents"))
