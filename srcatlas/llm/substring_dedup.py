"""Substring dedup: an FM-index per shard, and matching statistics of streamed segments above a threshold.

A window is ``WINDOW`` consecutive words. Its anchor is the smallest hash among
its runs of ``RUN`` words, so equal windows have equal anchors. Each document is
cut into segments, maximal runs of windows with one anchor (about one in twenty
words starts a new one). Everything that may be equal thus meets under its
anchor, whatever documents it lies in, and anchors that only one document has
are out after one grouped count.

Equal segments are one: its owner is the smallest document that has it, and in
all later ones the whole segment goes. Where one anchor has several segments,
these are dealt to shards by anchor. A shard builds a compressed FM-index over
its segments (wavelet matrix over the last column, ``fm_index``), streams the
segments through backward search and reports the windows that also occur in a
segment of a smaller owner.

An anchor with more than ``BLOCK`` segments is dealt to pairs of blocks, so that
no task holds more than two blocks of it; the visits of that anchor grow with
square / BLOCK.

Words are compared by 64-bit hashes and segments by 64-bit hashes below their
anchor's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import private, small_batches, stored, table
from .fm_index import FMIndex, matching_windows

WINDOW = 50
RUN = 12
LONGEST = 64
BLOCK = 20_000
SHARD_WORDS = 1_000_000
BROADCAST_ANCHORS = 2_000_000
BASE = 0x9E3779B97F4A7C15


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), ">u8").astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of any runs of words, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.inverse = self._powers(pow(BASE, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(words) * self._powers(BASE, n), out=self.sums[1:])

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out) if n else out

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def segments(text: str | None, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, ...]:
    """(anchor, seg, start, windows) arrays: the segments of a text; none with fewer words than a window."""
    words = word_hashes((text or "").encode().split())
    n = len(words)
    if n < window:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    rolling = Rolling(words)
    at = np.arange(n - run + 1)
    anchors = _sliding_min(rolling.of(at, at + run), window - run + 1)
    opens = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    sizes = np.diff(np.append(opens, len(anchors)))
    pieces = -(-sizes // LONGEST)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(opens, pieces) + nth * LONGEST
    count = np.minimum(LONGEST, np.repeat(opens + sizes, pieces) - start)
    seg = rolling.of(start, start + count + window - 1)
    return anchors[start].view(np.int64), seg.view(np.int64), start, count


def _cut(docs: DataFrame, window: int) -> DataFrame:
    def each(batches):
        for batch in batches:
            parts, rows = [], []
            for i, t in enumerate(batch.column("text")):
                got = segments(t.as_py(), window)
                parts.append(got)
                rows.append(np.full(len(got[0]), i))
            of = pa.array(np.concatenate(rows) if rows else [], pa.int64())
            columns = [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(of), batch.column("text_hash").take(of), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2].astype(np.int32)), pa.array(columns[3].astype(np.int32))],
                ["doc_id", "text_hash", "anchor", "seg", "start", "windows"])

    return docs.mapInArrow(each, "doc_id long, text_hash long, anchor long, seg long, start int, windows int")


def _with_words(found: DataFrame, window: int) -> DataFrame:
    """Segments (list of structs ``need``) of each text with their words' hashes as bytes."""
    schema = "anchor long, seg long, owner long, first long, n long, words binary"

    def each(batches):
        for batch in batches:
            rows = []
            for text, owner, need in zip(batch.column("text"), batch.column("owner"), batch.column("need")):
                words = word_hashes((text.as_py() or "").encode().split())
                for s in need.as_py():
                    part = words[s["start"]:s["start"] + s["windows"] + window - 1]
                    rows.append((s["anchor"], s["seg"], owner.as_py(), s["first"], s["n"], part.tobytes()))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [c.split()[0] for c in schema.split(", ")])

    return found.mapInArrow(each, schema)


def _search(shard: pa.Table, window: int) -> pa.Table:
    """Windows of the shard's queries that occur in a segment of a smaller owner."""
    anchor, seg, owner = (shard.column(c).to_numpy() for c in ("anchor", "seg", "owner"))
    words = [np.frombuffer(w.as_py(), np.uint64) for w in shard.column("words")]
    indexed = np.flatnonzero(shard.column("as_index").to_numpy(zero_copy_only=False))
    asked = np.flatnonzero(shard.column("as_query").to_numpy(zero_copy_only=False))
    got = []
    if len(indexed) and len(asked):
        index = FMIndex([words[i] for i in indexed], owner[indexed])
        got = matching_windows(index, [words[i] for i in asked], owner[asked], window)
    found = np.concatenate(got) if got else np.empty((0, 3), np.int64)
    row = asked[found[:, 0]] if len(asked) else np.empty(0, np.int64)
    return pa.table({"anchor": pa.array(anchor[row], pa.int64()), "seg": pa.array(seg[row], pa.int64()),
                     "lo": pa.array(found[:, 1].astype(np.int32)), "hi": pa.array(found[:, 2].astype(np.int32))})


def repeated_spans(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, spans): documents with words to remove; ``spans`` are (start, end) word positions, in any order.

    A window goes where its words also start in a document with a smaller id.
    Rows without an id are neither compared nor cut: no id is smaller than none.
    """
    small_batches(docs.sparkSession)
    rows = private(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    rows = rows.where("doc_id IS NOT NULL")
    cut = stored(_cut(rows, window), "segments")
    shared = stored(cut.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"), "anchors")
    if shared.count() <= BROADCAST_ANCHORS:  # 8 bytes each
        shared = F.broadcast(shared)
    members = stored(cut.join(shared, "anchor", "left_semi"), "members")
    owned = stored(members.groupBy("anchor", "seg").agg(
        F.min("doc_id").alias("owner"), F.min_by("text_hash", "doc_id").alias("owner_hash"), F.min_by("start", "doc_id").alias("start"),
        F.max("windows").alias("windows")), "owned")

    # anchors with several segments go through the index
    several = owned.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("first")).where("n > 1")
    need = owned.join(several, "anchor").groupBy("owner", "owner_hash").agg(
        F.collect_list(F.struct("anchor", "seg", "start", "windows", "n", "first")).alias("need"))
    with_need = rows.join(need, (F.col("doc_id") == F.col("owner")) & (F.col("text_hash") == F.col("owner_hash"))).select("text", "owner", "need")
    words = stored(_with_words(with_need, window), "words")
    found = _dealt(words, block).groupBy("shard").applyInArrow(lambda t: _search(t, window), "anchor long, seg long, lo int, hi int")
    found = stored(found, "matches")

    every = members.join(owned.select("anchor", "seg", "owner"), ["anchor", "seg"])
    whole = every.where("doc_id > owner").select("doc_id", "text_hash", "start", (F.col("start") + F.col("windows") + (window - 1)).alias("end"))
    part = every.where("doc_id = owner").join(found, ["anchor", "seg"]).select(
        "doc_id", "text_hash", (F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi") + window).alias("end"))
    return whole.unionByName(part).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _dealt(words: DataFrame, block: int) -> DataFrame:
    facts = words.agg(F.sum(F.length("words")).alias("bytes")).first()
    shards = (facts["bytes"] or 0) // (8 * SHARD_WORDS) + 1
    # blocks are filled by hash, to four fifths on average
    blocks = F.when(F.col("n") <= block, 1).otherwise(F.ceil(F.col("n") * 1.25 / block)).cast("int")
    rows = words.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("seg"), F.col("blocks")).cast("int"))
    # (index block, query block) pairs; with one block a row is both
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    as_index = rows.withColumn("other", other).select(
        "anchor", "seg", "owner", "words", "blocks", F.col("own").alias("i"), F.col("other").alias("q"), F.lit(True).alias("as_index"),
        ((F.col("own") == F.col("other")) & (F.col("first") < F.col("owner"))).alias("as_query"))
    as_query = rows.where("blocks > 1 AND first < owner").withColumn("other", other).where("own <> other").select(
        "anchor", "seg", "owner", "words", "blocks", F.col("other").alias("i"), F.col("own").alias("q"), F.lit(False).alias("as_index"), F.lit(True).alias("as_query"))
    dealt = as_index.unionByName(as_query)
    # a pair of blocks of a frequent anchor is a shard of its own; other anchors share shards of bounded bytes
    dealt = dealt.withColumn("shard", F.when(F.col("blocks") > 1, F.xxhash64("anchor", "i", "q")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))).drop("blocks")
    return dealt


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept.

    ``kept`` is the remaining words joined by one blank, or its SHA-256 with
    ``digest``. Null texts have no words; texts shorter than a window, and rows
    without an id, lose none. Rows that repeat id and text get a row each. No
    rows give no rows.
    """
    spans = repeated_spans(docs, window).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans")
    rows = private(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    both = rows.join(spans, (F.col("doc_id") == F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select("doc_id", "text", "spans")

    def each(batches):
        for batch in batches:
            total, removed, kept = [], [], []
            for text, own in zip(batch.column("text"), batch.column("spans")):
                words = (text.as_py() or "").encode().split()
                total.append(len(words))
                gone = _merged(own.as_py())
                removed.append(sum(e - s for s, e in gone))
                for s, e in reversed(gone):
                    del words[s:e]
                rest = b" ".join(words)
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(each, "doc_id long, n_words long, n_removed long, kept string")


def op8_substring_dedup(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


OP8_SQL = f"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
windows AS (
    SELECT r, doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win
    FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM texts)),
repeated AS (
    SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY win) AS earliest FROM windows) WHERE earliest < doc_id),
positions AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts),
judged AS (
    SELECT p.r, p.word, p.i,
           coalesce(p.i - max(x.i) OVER (PARTITION BY p.r ORDER BY p.i ROWS UNBOUNDED PRECEDING) < {WINDOW}, false) AS removed
    FROM positions p LEFT JOIN repeated x ON x.r = p.r AND x.i = p.i),
kept AS (
    SELECT r, count(*) FILTER (WHERE removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT removed) AS rest
    FROM judged GROUP BY r)
SELECT t.doc_id, len(t.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.rest, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.r = t.r
"""
