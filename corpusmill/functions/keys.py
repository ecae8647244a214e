"""Identifiers, hashes and times as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shards of the index; fixed, as it is part of row ids.
SHARDS = 8
#: Seconds from 1601 to 1970.
WEBKIT_OFFSET = 11_644_473_600


def fnv1a32(c: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-8 bytes."""
    code = F.hex(F.encode(c, "UTF-8"))
    at = F.when(F.length(code) > 0, F.sequence(F.lit(1), F.length(code) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("bigint")
    return F.aggregate(at, F.lit(2166136261).cast("bigint"), lambda h, i: ((h.bitwiseXOR(byte(i))) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def shard(source: Column, item_id: Column) -> Column:
    return F.pmod(fnv1a32(F.concat_ws(":", F.coalesce(source, F.lit("")), F.coalesce(item_id, F.lit("")))), F.lit(SHARDS)).cast("int")


def global_rowid(shard_: Column, local: Column) -> Column:
    return F.shiftleft(shard_.cast("bigint"), 56).bitwiseOR(local)


def rowid_shard(row_id: Column) -> Column:
    return F.shiftrightunsigned(row_id, 56).cast("int")


def rowid_local(row_id: Column) -> Column:
    return row_id.bitwiseAND(F.lit((1 << 56) - 1))


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def chunk_id(source: Column, item_id: Column, ordinal: Column, hash_: Column) -> Column:
    return F.format_string("%s:%s:%04d:%s", source, item_id, ordinal, F.substring(hash_, 1, 16))


def file_item_id(path: Column) -> Column:
    return F.sha2(F.lower(path), 256)


def sync_key(path: Column, content: bool = False) -> Column:
    return F.concat(F.lit("file-content:" if content else "file:"), F.substring(F.sha2(F.lower(path), 256), 1, 16))


def webkit_to_unix(c: Column) -> Column:
    """Microseconds since 1601 to seconds since 1970; what isn't after zero is 0."""
    return F.when(c > 0, F.greatest(F.floor(c / 1_000_000).cast("bigint") - WEBKIT_OFFSET, F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def unix_to_webkit(c: Column) -> Column:
    return F.when(c > 0, (c + WEBKIT_OFFSET) * 1_000_000).otherwise(F.lit(0)).cast("bigint")


def content_fingerprint(ordinal: Column, hash_: Column) -> Column:
    """Aggregate: SHA-1 over an item's chunk hashes in order; an item is a file of bounded size, so its hashes fit in one row."""
    ordered = F.sort_array(F.collect_list(F.struct(ordinal.alias("o"), hash_.alias("h"))))
    return F.concat(F.lit("content:"), F.sha1(F.array_join(F.transform(ordered, lambda x: x["h"]), "")))
