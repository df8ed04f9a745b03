"""Relations used throughout the package, as explicit Spark schemas.

Modification times are kept as two BIGINT columns because the staleness test
compares nanoseconds and Spark timestamps stop at microseconds.
"""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("lang", T.StringType(), True),
    T.StructField("content", T.BinaryType(), True),
    T.StructField("mtime_secs", T.LongType(), True),
    T.StructField("mtime_nanos", T.LongType(), True),
])

FILES_INDEX = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("lang", T.StringType(), False),
    T.StructField("mtime_secs", T.LongType(), False),
    T.StructField("mtime_nanos", T.LongType(), False),
])

# When a path was deleted, as far as a feed of changes has told.
DELETED = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("mtime_secs", T.LongType(), False),
    T.StructField("mtime_nanos", T.LongType(), False),
])

# ``pos`` is the token position of the name; it breaks ties inside a line.
SYMBOLS = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("file", T.StringType(), False),
    T.StructField("line", T.LongType(), False),
    T.StructField("pos", T.LongType(), False),
])

MATCHES = T.StructType([
    T.StructField("capture", T.StringType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("file", T.StringType(), False),
    T.StructField("start_line", T.LongType(), False),
    T.StructField("end_line", T.LongType(), False),
])

NODES = T.StructType([
    T.StructField("file", T.StringType(), False),
    T.StructField("node_id", T.LongType(), False),
    T.StructField("parent_id", T.LongType(), True),
    T.StructField("field", T.StringType(), True),
    T.StructField("type", T.StringType(), False),
    T.StructField("text", T.StringType(), True),
    T.StructField("start_line", T.LongType(), True),
    T.StructField("end_line", T.LongType(), True),
    T.StructField("pos", T.LongType(), False),
])

# One row per ignore rule; ``rank`` orders the rules of one directory.
IGNORE_RULES = T.StructType([
    T.StructField("dir", T.StringType(), False),
    T.StructField("rank", T.LongType(), False),
    T.StructField("regex", T.StringType(), False),
    T.StructField("negated", T.BooleanType(), False),
    T.StructField("dir_only", T.BooleanType(), False),
])

FEED = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("mtime_secs", T.LongType(), True),
    T.StructField("mtime_nanos", T.LongType(), True),
    T.StructField("op", T.StringType(), False),
    T.StructField("content", T.BinaryType(), True),
])
