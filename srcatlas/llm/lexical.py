"""Ranked lexical search over K2-treaps of the term by document grid.

The grid has a row for each term that a query has, a column for each document,
and in a cell the term's impact on the document's score. A shard of the columns
is kept as a quadtree of empty and non-empty squares: a level is a string of
4-bit masks, the place of a child follows from the number of set bits before it,
and each square holds the largest impact in it, so that maxima never grow on the
way down.

A query descends along the rows of all its terms at once. A state is a range of
documents with the squares that the query's rows meet there; the sum of their
maxima bounds the score of every document in the range. States are taken best
first, a batch at a time, and split in halves of their range, until no bound
reaches the last place of the list. At a single document the bound is the score.
The list of a query is kept over the shards of a task, so that later shards are
cut by what earlier ones found.

Rows are ordered by weight and columns by their heaviest term: squares then hold
like impacts, and bounds are closer.

Documents stay in the partitions they are read in. Queries go to all of them, in
blocks of bounded bytes; what leaves a partition is a list of places a query,
combined by a top-k over all partitions.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import lower_ascii, private, small_batches, stored, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
PLACES = 10
BLOCK_BYTES = 4 << 20
COLUMNS = 1 << 14
CELLS = 1 << 19
BATCH = 64
BITS = np.array([bin(m).count("1") for m in range(16)], np.int64)


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def _spread(v: np.ndarray) -> np.ndarray:
    """The bits of 31-bit numbers, at every second place."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


class Treap:
    """Squares of a sparse grid, by level: child masks, place of the first child, largest value.

    After the last square of each level comes an empty one, which stands for all squares that are not there.
    """

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int):
        self.height = max(1, int(max(rows, columns) - 1).bit_length())
        code = (_spread(row) << np.uint64(1)) | _spread(column)
        order = np.argsort(code)
        code, top = code[order], value[order]
        self.top, self.mask, self.first = [np.append(top, 0)], [], []
        for _ in range(self.height):
            parent = code >> np.uint64(2)
            starts = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
            mask = np.bitwise_or.reduceat(np.left_shift(1, (code & np.uint64(3)).astype(np.int64)), starts).astype(np.uint8)
            top = np.maximum.reduceat(top, starts)
            self.mask.insert(0, np.append(mask, 0).astype(np.uint8))
            self.first.insert(0, np.append(starts, 0).astype(np.int32))
            self.top.insert(0, np.append(top, 0))
            code = parent[starts]

    def best(self, terms: np.ndarray, places: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, columns) of all columns that can be among the ``places`` best, none below ``floor`` or 0, in no order.

        ``terms`` are row numbers. Columns whose score equals the last place's are all there.
        """
        floor, last = max(floor, 1), [0] * places  # ``last`` is a heap of the best scores
        scores, columns = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        root = np.array([self.top[0][0] * len(terms)])
        queue = [(-int(root[0]), 0, 0, np.zeros(1, np.int64), np.zeros((1, len(terms)), np.int32), root)]
        ticket = 0
        while queue and -queue[0][0] >= floor:
            _, depth, _, column, cells, bound = heapq.heappop(queue)
            level, going = -depth, bound >= floor
            column, cells = column[going], cells[going]
            mask, first, top = self.mask[level][cells], self.first[level][cells], self.top[level + 1]
            halves = []
            for half in (0, 1):
                quadrant = 2 * ((terms >> (self.height - 1 - level)) & 1) + half
                child = np.where((mask >> quadrant) & 1, first + BITS[mask & ((1 << quadrant) - 1)], len(top) - 1).astype(np.int32)
                halves.append((2 * column + half, child, top[child].sum(1)))
            column, cells, bound = (np.concatenate(part) for part in zip(*halves))
            going = np.flatnonzero(bound >= floor)
            if level + 1 == self.height:
                scores.append(bound[going])
                columns.append(column[going])
                for score in np.sort(bound[going])[::-1][:places].tolist():
                    heapq.heappushpop(last, score)
                floor = max(floor, last[0])
                continue
            going = going[np.argsort(-bound[going], kind="stable")]
            for start in range(0, len(going), BATCH):
                part = going[start:start + BATCH]
                ticket += 1
                heapq.heappush(queue, (-int(bound[part[0]]), -(level + 1), ticket, column[part], cells[part], bound[part]))
        score, column = np.concatenate(scores), np.concatenate(columns)
        return score[score >= floor], column[score >= floor]


class Shard:
    """The grid of some documents: a treap, with what its rows and columns stand for."""

    def __init__(self, doc: list, n: np.ndarray, counts: np.ndarray, term: np.ndarray, tf: np.ndarray, facts: dict):
        m = np.array([10 + 90 * k * facts["N"] // facts["L"] for k in n.tolist()], np.int64)
        at = np.repeat(np.arange(len(doc)), counts)
        value = facts["weight"][term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at]))
        at, row, value = at[value > 0], facts["row"][term][value > 0], value[value > 0]
        heaviest = np.lexsort((-value, at))
        starts = np.flatnonzero(np.concatenate(([True], at[heaviest][1:] != at[heaviest][:-1]))) if len(at) else np.empty(0, np.int64)
        lead = heaviest[starts]
        self.doc = [doc[i] for i in at[lead][np.lexsort((-value[lead], row[lead]))].tolist()]
        place = np.empty(len(doc), np.int64)
        place[at[lead][np.lexsort((-value[lead], row[lead]))]] = np.arange(len(lead))
        self.treap = Treap(row, place[at], value, len(facts["row"]), len(lead)) if len(at) else None

    def best(self, terms: np.ndarray, places: int, floor: int) -> list[tuple]:
        """(-score, id is null, id): sorts as the list of a query does."""
        if self.treap is None:
            return []
        score, column = self.treap.best(terms, places, floor)
        return [(-s, self.doc[c] is None, self.doc[c]) for s, c in zip(score.tolist(), column.tolist())]


def queries(items: DataFrame) -> DataFrame:
    """(item, item_id, terms): the distinct terms of each item id; rows that share an id are one item."""
    rows = private(items, "item_id", "text")
    terms = rows.select("item_id", F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0))).alias("term")).distinct()
    return terms.groupBy("item_id").agg(F.collect_list("term").alias("terms")).withColumn("item", F.monotonically_increasing_id())


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, term, tf): of each document with terms, how many it has, and which of ``vocabulary`` how often."""
    number = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(vocabulary)})
    rows = private(docs, "doc_id", "text")

    def each(batches):
        known = number.value
        for batch in batches:
            kept, n, term, tf = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                found = TERM_BYTES.findall((text.as_py() or "").encode().lower())
                if found:
                    hits = [(known[t], c) for t, c in Counter(found).items() if t in known]
                    kept.append(i)
                    n.append(len(found))
                    term.append([t for t, _ in hits])
                    tf.append([c for _, c in hits])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(n, pa.int64()),
                pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["doc_id", "n", "term", "tf"])

    return rows.mapInArrow(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, term array<int>, tf array<int>")


def _places(found: DataFrame, asked: list[tuple[int, np.ndarray]], facts: dict, places: int, columns: int, cells: int) -> DataFrame:
    """(item, doc_id, score): the best places of each query in each partition."""
    shared = found.sparkSession.sparkContext.broadcast((asked, facts))
    kind = found.schema["doc_id"].dataType.simpleString()

    def each(batches):
        asked, facts = shared.value
        lists: list[list[tuple]] = [[] for _ in asked]
        kind, held, size = None, [], 0

        def answer():
            table = pa.Table.from_batches(held)
            term, tf = (table.column(c).combine_chunks() for c in ("term", "tf"))
            counts = pc.list_value_length(term).to_numpy(zero_copy_only=False)
            shard = Shard(table.column("doc_id").to_pylist(), table.column("n").to_numpy(), counts,
                          term.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64), facts)
            for i, (_, terms) in enumerate(asked):
                floor = -lists[i][-1][0] if len(lists[i]) == places else 1
                lists[i] = heapq.nsmallest(places, lists[i] + shard.best(terms, places, floor))

        for batch in batches:
            kind = batch.column("doc_id").type
            held.append(batch)
            size += len(batch.column("term").flatten())
            if size >= cells or sum(map(len, held)) >= columns:
                answer()
                held, size = [], 0
        if held:
            answer()
        rows = [(asked[i][0], doc, -score) for i, best in enumerate(lists) for score, _, doc in best]
        if rows:
            item, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, kind), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return found.mapInArrow(each, f"item long, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, places: int = PLACES, block_bytes: int = BLOCK_BYTES, columns: int = COLUMNS,
           cells: int = CELLS) -> DataFrame:
    """The ``places`` best documents of each item: item_id, rank, doc_id, score.

    Equal scores go by ascending doc_id, null ids last. Rows that repeat a
    doc_id are documents of their own; rows that share an item_id are one item
    with all their terms, null ids too. Null texts and texts without terms are no
    documents and no items. Items that no document scores above 0 for have no
    rows; no documents or no items give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = stored(queries(items), "items")
    total = asked.agg(F.sum(F.expr("aggregate(terms, 0L, (s, t) -> s + octet_length(t) + 16)")).alias("b")).first()["b"] or 0
    blocks, out = total // block_bytes + 1, None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "terms").collect()  # about ``block_bytes``
        vocabulary = sorted({t for r in rows for t in r.terms})
        found = stored(postings(docs, vocabulary), "postings")
        facts = found.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in found.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).toLocalIterator():
            df[r.t] = r.c
        weight = weights(df, facts["N"])
        row = np.empty(len(weight), np.int64)
        row[np.lexsort((np.arange(len(weight)), -weight))] = np.arange(len(weight))
        number = {t: i for i, t in enumerate(vocabulary)}
        of_item = [(r.item, row[[number[t] for t in r.terms]]) for r in rows]
        part = _places(found, of_item, {"N": facts["N"], "L": facts["L"], "weight": weight, "row": row}, places, columns, cells)
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= places)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents WHERE text IS NOT NULL),
sized AS (SELECT r, doc_id, w, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0),
facts AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM sized),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM sized) GROUP BY r, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
weight AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, facts),
scored AS (SELECT item_id, tf.r, doc_id, sum(weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l))))::BIGINT AS score
    FROM items JOIN tf USING (term) JOIN weight USING (term) JOIN sized ON sized.r = tf.r, facts GROUP BY item_id, tf.r, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def op13_lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
