"""Token counts of documents in flat token files, by a separator scan.

A flat file is nothing but token ids of a fixed width, with an end-of-document
id after each document; no index says where documents start. Files are read in
blocks by ranges of bytes, separators are found by one vectorised comparison a
block, and documents over block borders are stitched by a prefix scan over one
row per block: the last separator and the number of separators ahead of it.

``write_flat`` makes such files from a table, as a by-product of Spark tasks:
each attempt writes files of its own, and only those of the attempts whose rows
were stored are ever read, so lost executors and repeated tasks do no harm.
"""

from __future__ import annotations

import base64
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import private, scratch, small_batches, stored, table

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# The public pattern of the byte-level tokenizers that the vocabulary belongs to.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_DOCUMENT = 50256
WIDTH = "<u2"
BLOCK_BYTES = 8 << 20
FLUSH = 1 << 20


@lru_cache(2)
def encoder(vocabulary: str, pattern: str = PATTERN):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_flat(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END_OF_DOCUMENT, width: str = WIDTH) -> DataFrame:
    """Writes the texts of ``docs`` as flat token files below ``folder``; (doc_id, file, nth) says which document is where.

    A null text has no tokens, only its separator. ``folder`` must be shared; any URI that pyarrow knows will do.
    """
    small_batches(docs.sparkSession)
    rows = private(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def each(batches):
        encode = encoder(vocabulary).encode_ordinary
        file = f"{folder}/{uuid.uuid4().hex}.tokens"
        system, path = fs.FileSystem.from_uri(file)
        system.create_dir(path.rpartition("/")[0])
        nth = 0
        with system.open_output_stream(path) as out:
            for batch in batches:
                for text in batch.column("text"):
                    out.write(np.array([*encode(text.as_py() or ""), end], width).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([file] * n, pa.string()), pa.array(range(nth, nth + n), pa.int64())], ["doc_id", "file", "nth"])
                nth += n

    return stored(rows.mapInArrow(each, f"doc_id {kind}, file string, nth long"), "flat")


def _sizes(files: DataFrame) -> DataFrame:
    """(file, bytes) of each file."""
    def each(batches):
        for batch in batches:
            sizes = []
            for file in batch.column("file").to_pylist():
                system, path = fs.FileSystem.from_uri(file)
                sizes.append(system.get_file_info(path).size)
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(sizes, pa.int64())], ["file", "bytes"])

    return files.mapInArrow(each, "file string, bytes long")


def separators(files: DataFrame, end: int = END_OF_DOCUMENT, width: str = WIDTH, block: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, k, at): the k-th separator of a block lies at token ``at`` of its file; k is -1 for a block's first token.

    ``files`` has one row per file. A size that is no multiple of the width is an error.
    """
    size = np.dtype(width).itemsize
    block -= block % size
    ranges = _sizes(files).where("bytes > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / block))))
    ranges = ranges.repartition("file", "block")

    def each(batches):
        for batch in batches:
            for file, total, b in zip(*[batch.column(c).to_pylist() for c in ("file", "bytes", "block")]):
                if total % size:
                    raise ValueError(f"{file}: {total} bytes are no whole number of tokens")
                system, path = fs.FileSystem.from_uri(file)
                with system.open_input_file(path) as f:
                    tokens = np.frombuffer(f.read_at(min(block, total - b * block), b * block), width)
                found = np.flatnonzero(tokens == end) + b * block // size
                at = np.concatenate(([b * block // size], found, [b * block // size + len(tokens)]))
                n = len(at)
                # first token, separators, end of the block
                k = np.concatenate((np.arange(-1, n - 2), [-2]))
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(np.full(n, b)), pa.array(k), pa.array(at)],
                                                 ["file", "block", "k", "at"])

    return ranges.mapInArrow(each, "file string, block long, k long, at long")


def document_lengths(files: DataFrame, end: int = END_OF_DOCUMENT, width: str = WIDTH, block: int = BLOCK_BYTES) -> DataFrame:
    """(file, nth, start, n_tokens) of each document of flat files, in the order of the file; the separator is not counted.

    Tokens behind a file's last separator are one more document. An empty file
    has none; two separators in a row have an empty one between them.
    """
    found = stored(separators(files, end, width, block), "separators")
    blocks = found.groupBy("file", "block").agg(
        F.max(F.when(F.col("k") >= 0, F.col("at"))).alias("last"), F.count_if(F.col("k") >= 0).alias("n"), F.max("at").alias("stop"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    scanned = blocks.select("file", "block", "last", "n", F.coalesce(F.max("last").over(ahead), F.lit(-1)).alias("carried"),
                            F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(whole), F.lit(-1)).alias("final"),
                            F.sum("n").over(whole).alias("all"), F.max("stop").over(whole).alias("total"))
    local = F.lag("at").over(Window.partitionBy("file", "block").orderBy("k"))
    seps = found.where("k >= 0").withColumn("before", local)
    both = seps.join(scanned.select("file", "block", "carried", "base"), ["file", "block"])
    start = F.coalesce("before", "carried") + 1
    ended = both.select("file", (F.col("base") + F.col("k")).alias("nth"), start.alias("start"), (F.col("at") - start).alias("n_tokens"))
    tail = scanned.where("block = 0 AND final + 1 < total").select(
        "file", F.col("all").alias("nth"), (F.col("final") + 1).alias("start"), (F.col("total") - F.col("final") - 1).alias("n_tokens"))
    return ended.unionByName(tail)


def token_counts(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, counted in the flat files alone.

    Null and empty texts have 0 tokens. Repeated rows and null ids get a row each. No rows give no rows.
    """
    placed = write_flat(docs, scratch(spark, "tokens"), vocabulary)
    lengths = document_lengths(placed.select("file").distinct(), block=block)
    return placed.join(lengths, ["file", "nth"]).select("doc_id", "n_tokens")


def op3_token_counts(spark, sf_dir):
    return token_counts(spark, table(spark, sf_dir, "documents"))
