"""Schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()

#: One normalised document of any source.
ITEM = T.StructType(
    [T.StructField(n, t) for n, t in (("id", _S), ("source", _S), ("title", _S), ("content", _S), ("preview", _S), ("metadata", T.MapType(_S, _S)), ("created_at", _L), ("updated_at", _L))]
)
#: One searchable piece of an item.
CHUNK = T.StructType(
    [T.StructField(n, t) for n, t in (("row_id", _L), ("chunk_id", _S), ("item_id", _S), ("source", _S), ("title", _S), ("content", _S), ("preview", _S), ("ordinal", _I), ("hash", _S), ("path", _S), ("file_type", _S), ("metadata_json", _S), ("created_at", _L), ("updated_at", _L))]
)
FINGERPRINT = T.StructType([T.StructField(n, t) for n, t in (("path", _S), ("size", _L), ("mod_time_ns", _L), ("content_hash", _S), ("updated_at", _L))])
CANDIDATE = T.StructType([T.StructField(n, t) for n, t in (("path", _S), ("size", _L), ("mod_time_ns", _L), ("is_dir", T.BooleanType()))])
SYNC_STATE = T.StructType([T.StructField(n, t) for n, t in (("adapter_id", _S), ("last_sync_time", _L), ("updated_at", _L))])
WATCHED = T.StructType([T.StructField(n, t) for n, t in (("path", _S), ("added_at", _L))])
#: One hit of a search.
RESULT = T.StructType(
    [T.StructField(n, t) for n, t in (("row_id", _L), ("item_id", _S), ("source", _S), ("title", _S), ("preview", _S), ("path", _S), ("file_type", _S), ("updated_at", _L), ("score", T.DoubleType()), ("metadata_json", _S))]
)
