from pyspark.sql import functions as F

from srcatlas.functions.langs import detect_lang
from srcatlas.operators.declarations import extract_symbols


def corpus(spark, files: dict, secs: int = 1):
    """Files given as path -> text or bytes."""
    rows = [(p, c if isinstance(c, (bytes, type(None))) else c.encode(), secs, 5) for p, c in files.items()]
    df = spark.createDataFrame(rows, "path string, content binary, mtime_secs bigint, mtime_nanos bigint")
    return df.withColumn("lang", detect_lang(F.col("path")))


def symbols(spark, path: str, text, **kw):
    rows = extract_symbols(corpus(spark, {path: text}), **kw).collect()
    return [(r.name, r.kind, r.line) for r in rows]
