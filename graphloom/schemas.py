"""Explicit schemas of every table the library reads or writes."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("folder", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("stem", T.StringType()),
    T.StructField("ext", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("raw", T.StringType()),
])

NODES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("language", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    T.StructField("shape", T.StringType()),
    T.StructField("color", T.StringType()),
])

EDGES = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("weight", T.DoubleType()),
])

C_DECLS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("qualifiers", T.ArrayType(T.StringType())),
    T.StructField("type_str", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("field_count", T.IntegerType()),
    T.StructField("member_count", T.IntegerType()),
    T.StructField("param_count", T.IntegerType()),
    T.StructField("is_definition", T.BooleanType()),
])

LOG_LINES = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line_no", T.LongType()),
])

GRAPH_EVENTS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("event", T.StringType()),
    T.StructField("payload", T.StringType()),
])

GRAPH_RUNS = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("layout", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("size_bytes", T.LongType()),
])

_TOKEN = T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("since", T.StringType()),
])
_GROUP = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("tokens", T.ArrayType(_TOKEN)),
])
_LAYER = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("gloss", T.StringType()),
    T.StructField("groups", T.ArrayType(_GROUP)),
])
_KIND = T.StructType([T.StructField("layers", T.ArrayType(_LAYER))])

LEXICON = T.StructType([
    T.StructField("language", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("standards", T.ArrayType(T.StringType())),
    T.StructField("keywords", _KIND),
    T.StructField("operators", _KIND),
])

COMPILE_COMMANDS = T.StructType([
    T.StructField("directory", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("command", T.StringType()),
    T.StructField("arguments", T.ArrayType(T.StringType())),
])
