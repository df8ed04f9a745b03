"""Jaccard join, whitening and lexical search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from oracle import compare
from srcatlas.llm import jaccard, lexical, queries, whitening
from .test_operators import BENCH, BLANK, LOWER, ROWS, docs, none  # noqa: F401


@pytest.mark.parametrize("key", list(queries.SQL))
def test_query_equals_its_sql(spark, key):
    equal, rows, _, difference = compare(spark, "/root/testdata/sf0.001", key)
    assert equal, difference
    assert rows > 0


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} == set(entry.queries()) - set(entry._QUERIES)


# ---------------------------------------------------------------- Jaccard join

def _shingles(text):
    words = BLANK.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3)))


def _links_by_hand(rows, least=85):
    sets = [_shingles(t) for _, t in rows]
    linked = [[j for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= least * len(a | b)] for i, a in enumerate(sets)]
    out = []
    for i, (own, _) in enumerate(rows):
        seen, queue = {i}, [i]
        while queue:
            new = [j for j in linked[queue.pop()] if j not in seen]
            seen.update(new)
            queue.extend(new)
        out.append((own, len(sets[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None), len(linked[i])))
    return Counter(out)


# one plan for all, then small blocks, many parts, and n-grams that the sample finds frequent
@pytest.mark.parametrize("options", [{}, {"block": 5, "part": 400, "sample": 100_000}])
def test_jaccard_join(docs, none, options):  # noqa: F811
    got = Counter(map(tuple, jaccard.jaccard_links(docs, **options).collect()))
    assert got == _links_by_hand([(r[0], r[1]) for r in ROWS])
    assert jaccard.jaccard_links(none, **options).count() == 0


def test_jaccard_join_at_the_bound(spark):
    """Overlaps of exactly 85 of 100, and one less; sizes on both sides of a size class."""
    word = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(word[:103])), (2, " ".join(word[:88])), (3, " ".join(word[:87])), (4, " ".join(word[15:103])), (5, None), (6, "a b"), (7, "A  B")]
    rows += [(10 + i, " ".join(word[:103] + [f"x{i}"])) for i in range(40)]
    got = Counter(map(tuple, jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"), block=4).collect()))
    assert got == _links_by_hand(rows)


def test_a_product_gets_two_blocks_at_most(spark):
    word = [f"w{i}" for i in range(60)]
    rows = spark.createDataFrame([(1, i, 57, 1, bytes(range(8)) + bytes([i, 1, 1, 1, 1, 1, 1, 1])) for i in range(120)],
                                 "family long, cid long, n int, members long, x binary")
    dealt = jaccard._dealt(rows, 85, 10)
    sizes = [r["count"] for r in dealt.groupBy("unit").count().collect()]
    assert max(sizes) <= 2 * 25 and len(sizes) >= 12 * 13 / 2  # blocks are dealt by hash, about 10 rows each
    pairs = Counter()
    for unit in {r.unit for r in dealt.select("unit").collect()}:
        members = [(r.cid, r.side) for r in dealt.where(dealt.unit == unit).collect()] if unit % 16 == 0 else []
        pairs.update(frozenset((a, b)) for a, s in members for b, t in members if a < b and (s != t or s == 2))
    assert all(c == 1 for c in pairs.values()) and word


# ------------------------------------------------------------------- whitening

def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.2
    rows = [(i, v.tolist(), "x", 5) for i, v in enumerate(base)]
    rows += [(1000 + i, base[7].tolist(), "x", 5) for i in range(200)]
    rows += [(1, base[3].tolist(), "x", 5), (None, base[4].tolist(), "x", 5), (2000, None, "x", 5), (2001, [], "x", 5), (2002, [None] * 12, "x", 5),
             (2003, [math.nan] * 12, "x", 5), (2004, [math.inf] + [0.0] * 11, "x", 5), (2005, [0.5] * 11, "x", 5), (2006, [1e300] + [0.0] * 11, "x", 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, n int").repartition(4)
    got = whitening.whiten(table).toPandas()

    kept = [r for r in rows if r[1] and len(r[1]) == 12 and all(c is not None and abs(c) < 1e200 for c in r[1])]
    x = [[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in kept]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * c - t for c, t in zip(r, s)] for r in fit], float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 12 * len(kept) and set(got.n) == {n}
    assert abs(got.identity_error.max()) < 1e-9
    explained = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(explained, e / e.sum(), rtol=1e-9)
    want = ((n * np.array(x) - np.array(s)) / n) @ (u / np.sqrt(e))
    ids = [-1 if r[0] is None else r[0] for r in kept]
    far = [sum((n * c - t) ** 2 for c, t in zip(r, s)) for r in x]
    order = sorted(range(len(kept)), key=lambda i: (ids[i], x[i]))
    got = got.fillna({"vec_id": -1}).sort_values(["vec_id", "deviation", "component"])
    sign = None
    expected = Counter()
    for i in order:
        expected[(ids[i], far[i])] += 12
    assert Counter(zip(got.vec_id.astype(int), got.deviation)) == expected
    for i in order:
        rows_of = got[(got.vec_id == ids[i]) & (got.deviation == far[i])].whitened.to_numpy()[:12]
        if ids[i] not in (1, -1):
            sign = np.sign(rows_of * want[i]) if sign is None else sign
            assert np.allclose(rows_of, want[i] * sign, atol=1e-7)


def test_exact_sums():
    rng = random.Random(1)
    for bits in (20, 40, 51, 60, 80):
        p = np.array([[rng.randrange(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(50)], object)
        small = p.astype(np.int64) if bits < 63 else p
        assert whitening.square_sums(small) == [sum(v * v for v in column) for column in p.T]
    x = np.array([[2 ** 61, -5], [3, 2 ** 60]], np.int64)
    assert whitening.centred(x, 9, [7, 8]).tolist() == [[9 * 2 ** 61 - 7, -53], [20, 9 * 2 ** 60 - 8]]


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 9, [None, []]])
def test_whitening_without_variance(spark, vectors):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = whitening.whiten(table)
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_in_fewer_dimensions(spark):
    """A third dimension that follows from the others adds no component; most vectors decide the space."""
    rows = [(i, [i / 8, (i * i % 17) / 4, 3.0]) for i in range(60)] + [(100 + i, [float(i)]) for i in range(5)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    assert sorted(set(got.component)) == [1, 2] and len(got) == 120 and got.identity_error.max() < 1e-9


# -------------------------------------------------------------- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _search_by_hand(rows, items, places=10):
    terms = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    terms = [(i, c) for i, c in terms if c]
    n, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = {}
    for item, query in wanted.items():
        scored = []
        for doc, c in terms:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in query if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, gone, doc) in enumerate(sorted(scored)[:places], 1):
            out[(item, rank)] = (None if gone else doc, -score)
    return out


@pytest.mark.parametrize("options", [{}, {"columns": 20, "cells": 300, "block_bytes": 600}])
def test_lexical_search(spark, docs, none, options):  # noqa: F811
    rng = random.Random(9)
    items = [(i, " ".join(rng.sample(BLANK.findall(rng.choice(ROWS[:40])[1]), 5))) for i in range(12)]
    items += [(20, ROWS[3][1]), (21, "unknownword"), (22, None), (23, " ,. "), (24, "NA one"), (None, "b b ONE"), (None, "a"), (25, ROWS[0][1]), (25, ROWS[1][1])]
    bench = spark.createDataFrame([(i, t, "h", "w") for i, t in items], BENCH)
    got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in lexical.search(docs, bench, **options).collect()}
    assert got == _search_by_hand([(r[0], r[1]) for r in ROWS], items)
    assert lexical.search(none, bench, **options).count() == 0
    assert lexical.search(docs, bench.limit(0), **options).count() == 0


def test_treap_against_the_whole_grid():
    rng = np.random.default_rng(8)
    for rows, columns, cells in ((1, 1, 1), (3, 200, 150), (64, 64, 900), (90, 5, 60)):
        place = rng.choice(rows * columns, size=min(cells, rows * columns), replace=False)
        row, column = place // columns, place % columns
        value = rng.integers(1, 30, len(place))
        grid = np.zeros((rows, columns), np.int64)
        grid[row, column] = value
        treap = lexical.Treap(row, column, value, rows, columns)
        for level in range(treap.height):  # maxima never grow on the way down
            assert treap.top[level].max() == value.max()
        for places in (1, 4):
            terms = np.unique(rng.integers(0, rows, 6))
            scores = grid[terms].sum(0)
            least = max(1, np.sort(scores)[::-1][:places][-1])
            score, at = treap.best(terms, places, 0)
            assert sorted(zip(score.tolist(), at.tolist())) == sorted((s, c) for c, s in enumerate(scores.tolist()) if s >= least)
