"""Incremental maintenance of the index: what is new, what changed, what to write and what to delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import keys, text
from corpusmill.sources import files


def desired_kind(content_only: bool = False, limit: int = files.FOREGROUND_BYTES, rich: bool = False, max_bytes: int = files.MAX_BYTES) -> Column:
    """Kind of record a candidate should have: content:, path: or, for what a content pass doesn't take, null."""
    readable = files.text_type(F.col("path")) | (files.rich_type(F.col("path")) if rich else F.lit(False))
    size = F.coalesce("size", F.lit(0))
    eligible = ~F.col("is_dir") & readable & (size > 0) & (size <= min(limit, max_bytes))
    return F.when(eligible, F.lit("content:")).otherwise(F.lit(None).cast("string") if content_only else F.lit("path:"))


def unchanged(size: Column, time: Column, stored: Column, desired: Column) -> Column:
    """A record with the same size and time that is as good as what is wanted; a content record satisfies path:, not the reverse."""
    good = stored.startswith("content:") | (stored.startswith("path:") & (desired == "path:"))
    return F.coalesce(good & size & time, F.lit(False))


def newest_records(fingerprints: DataFrame) -> DataFrame:
    """One record per normal path: the last written, of equal ones the greatest."""
    f = fingerprints.withColumn("npath", text.normal_path(F.col("path")))
    best = f.groupBy("npath").agg(F.max(F.struct(F.coalesce("updated_at", F.lit(-1)).alias("u"), F.coalesce("content_hash", F.lit("")).alias("c"), "path", "size", "mod_time_ns", "content_hash", "updated_at")).alias("r"))
    return best.select("npath", "r.path", "r.size", "r.mod_time_ns", "r.content_hash", "r.updated_at")


def decisions(candidates: DataFrame, fingerprints: DataFrame, last_sync: int = 0, content_only: bool = False, limit: int = files.FOREGROUND_BYTES, strict: bool = True, rich: bool = False) -> DataFrame:
    """Candidates with `action`: skip, index_content, index_path. Known paths are always looked at, unknown ones if newer than `last_sync`.

    With strict=False an unknown path is looked at whatever its time, so that an old file moved in isn't missed.
    """
    known = newest_records(fingerprints).select("npath", F.col("size").alias("__size"), F.col("mod_time_ns").alias("__time"), F.col("content_hash").alias("__hash"))
    c = candidates.withColumn("npath", text.normal_path(F.col("path"))).join(known, "npath", "left").withColumn("__kind", desired_kind(content_only, limit, rich))
    is_known = F.col("__hash").isNotNull() | F.col("__time").isNotNull()
    fresh = F.floor(F.coalesce("mod_time_ns", F.lit(0)) / 1_000_000_000) > last_sync if strict else F.lit(True)
    same = unchanged(F.col("size").eqNullSafe(F.col("__size")), F.col("mod_time_ns").eqNullSafe(F.col("__time")), F.col("__hash"), F.col("__kind"))
    action = F.when(F.col("__kind").isNull() | same | (~is_known & ~fresh), F.lit("skip")).when(F.col("__kind") == "content:", F.lit("index_content")).otherwise(F.lit("index_path"))
    return c.withColumn("action", action).withColumnRenamed("__kind", "kind").drop("__size", "__time", "__hash", "npath")


def backfill(candidates: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Second pass: files recorded by path only whose content can be read within the larger limit."""
    return decisions(candidates, fingerprints, content_only=True, limit=files.BACKFILL_BYTES, strict=False).where("action = 'index_content'")


def chunk_diff(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(source, item_id, ordinal, action, row_id) with keep, replace, insert or delete, of the items that `fresh` holds.

    A piece is kept if hash and title are equal, and then keeps its stored time and metadata; a replaced one keeps its row_id.
    """
    key = ["source", "item_id", "ordinal"]
    touched = fresh.select("source", "item_id").distinct()
    old = stored.join(touched, ["source", "item_id"], "left_semi").groupBy(*key).agg(F.min(F.struct("row_id", "hash", "title")).alias("o"))
    new = fresh.groupBy(*key).agg(F.min(F.struct("hash", "title")).alias("n"))
    same = F.col("o.hash").eqNullSafe(F.col("n.hash")) & F.col("o.title").eqNullSafe(F.col("n.title"))
    action = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(same, "keep").otherwise("replace")
    return old.join(new, key, "full").select(*key, action.alias("action"), F.col("o.row_id").alias("row_id"))


def diff_rows(stored: DataFrame, fresh: DataFrame, top: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new, gone): the rows to write after `fresh` replaced its items, and the ids (row_id) of the rows that go; new rows are numbered after the greatest of their shard (`top`: shard, top)."""
    key = ["source", "item_id", "ordinal"]
    diff = chunk_diff(stored, fresh)
    gone = diff.where("action in ('replace', 'delete')").select(F.col("row_id"))
    touched = fresh.select("source", "item_id").distinct()
    repeated = stored.join(touched, ["source", "item_id"], "left_semi").join(diff.where("row_id is not null").select("row_id"), "row_id", "left_anti").select("row_id")
    written = fresh.drop("row_id").join(diff.where("action in ('insert', 'replace')").select(*key, "action", "row_id"), key)
    written = written.withColumn("__shard", keys.shard(F.col("source"), F.col("item_id")))
    if top is None:
        top = stored.groupBy(keys.rowid_shard(F.col("row_id")).alias("shard")).agg(F.max(keys.rowid_local(F.col("row_id"))).alias("top"))
    top = top.select(F.col("shard").alias("__shard"), F.col("top").alias("__top"))
    # Numbers need only be unique: hash buckets of a shard are numbered apart and interleaved, so no task holds a shard.
    fresh_rows = written.where("action = 'insert'").withColumn("__b", F.pmod(F.xxhash64(*key), F.lit(256)).cast("bigint"))
    w = Window.partitionBy("__shard", "__b").orderBy(*key)
    numbered = fresh_rows.withColumn("__n", F.row_number().over(w)).join(F.broadcast(top), "__shard", "left")
    local = F.coalesce("__top", F.lit(0)) + (F.col("__n") - 1) * 256 + F.col("__b") + 1
    numbered = numbered.withColumn("row_id", keys.global_rowid(F.col("__shard"), local)).drop("__n", "__b", "__top")
    new = numbered.unionByName(written.where("action = 'replace'")).drop("action", "__shard")
    return new.select(*stored.columns), gone.union(repeated)


def apply_diff(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The chunk table after `fresh` replaced its items."""
    new, gone = diff_rows(stored, fresh)
    return stored.join(gone, "row_id", "left_anti").select(*stored.columns).unionByName(new)


def upsert_records(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fingerprints with one record per path, the fresh one where there is any."""
    both = stored.withColumn("__p", F.lit(0)).unionByName(fresh.withColumn("__p", F.lit(1)))
    cols = [c for c in both.columns if c not in ("path", "__p")]
    best = both.groupBy("path").agg(F.max(F.struct("__p", F.coalesce("updated_at", F.lit(-1)).alias("__u"), *cols)).alias("r"))
    return best.select("path", *[F.col(f"r.{c}").alias(c) for c in cols]).select(*stored.columns)


def in_subtree(path: Column, root: str) -> Column:
    """The path is `root` or below it."""
    r = root.replace("\\", "/").rstrip("/").lower()
    p = text.normal_path(path)
    return (p == r) | p.startswith(r + "/")


def delete_subtree(df: DataFrame, root: str) -> DataFrame:
    """Rows of a table with paths that are left after a path or directory went; rows of other sources stay."""
    own = in_subtree(F.col("path"), root) & (F.col("source") == "file" if "source" in df.columns else F.lit(True))
    return df.where(~F.coalesce(own, F.lit(False)))


def delete_subtrees(df: DataFrame, gone: DataFrame) -> DataFrame:
    """As `delete_subtree`, for many paths (path) at once: the paths of the table are looked up with all that is above them."""
    roots = gone.where("path is not null").select(F.regexp_replace(text.normal_path(F.col("path")), "(?<=.)/+$", "").alias("__up")).distinct()
    own = df.where(F.col("source") == "file") if "source" in df.columns else df
    paths = own.select(text.normal_path(F.col("path")).alias("__p")).where("__p is not null and __p != ''").distinct()
    parts = F.split("__p", "/")
    above = paths.select("__p", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("__up"))
    lost = above.join(roots, "__up", "left_semi").select("__p").distinct()
    mine = (F.col("source") == "file") if "source" in df.columns else F.lit(True)
    keyed = df.withColumn("__p", F.when(F.coalesce(mine, F.lit(False)), text.normal_path(F.col("path"))))
    return keyed.join(lost, "__p", "left_anti").select(*df.columns)


def delete_items(chunks: DataFrame, items: DataFrame) -> DataFrame:
    return chunks.join(items.select("source", "item_id").distinct(), ["source", "item_id"], "left_anti")


def records_under(fingerprints: DataFrame, roots: list[str]) -> DataFrame:
    """Fingerprints of the roots and what is below them; no roots, no rows."""
    test = F.lit(False)
    for r in roots:
        test = test | in_subtree(F.col("path"), r)
    return fingerprints.where(test)


def prune_missing(chunks: DataFrame, candidates: DataFrame, root: str) -> DataFrame:
    """Chunks without those of files below `root` that are no longer listed."""
    listed = candidates.select(text.normal_path(F.col("path")).alias("__p")).distinct()
    rows = chunks.withColumn("__p", text.normal_path(F.col("path")))
    mine = F.coalesce(in_subtree(F.col("path"), root) & (F.col("source") == "file"), F.lit(False))
    return rows.where(~mine).unionByName(rows.where(mine).join(listed, "__p", "left_semi")).drop("__p")


def new_items(items: DataFrame, marks: DataFrame, top: int | None = None) -> DataFrame:
    """Items updated after their source's watermark (source, mark), non-blank; with `top`, the latest so many of each source."""
    rows = items.join(marks, "source", "left").where(F.col("updated_at") > F.coalesce("mark", F.lit(0))).where(text.trim_space(F.coalesce("content", F.lit(""))) != "").drop("mark")
    if top is None:
        return rows
    w = Window.partitionBy("source").orderBy(F.desc("updated_at"), "id")
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= top).drop("__n")


def watermarks(items: DataFrame, marks: DataFrame) -> DataFrame:
    """(source, mark) after the items were taken: the greatest time, kept only if it is above zero."""
    top = items.groupBy("source").agg(F.max("updated_at").alias("top"))
    return marks.join(top, "source", "full").select("source", F.greatest(F.coalesce("mark", F.lit(0)), F.coalesce("top", F.lit(0))).alias("mark")).where("mark > 0")


def summary(decided: DataFrame) -> DataFrame:
    """Counters of a run: scanned, indexed, skipped."""
    return decided.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("action") != "skip").alias("indexed"), F.count_if(F.col("action") == "skip").alias("skipped"), F.count_if(F.col("action") == "index_content").alias("content"))


class Table:
    """A small table replaced as a whole: a new numbered version is written, then readers see it."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _versions(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        done = [s.getPath() for s in fs.listStatus(p)]
        return sorted(int(d.getName()) for d in done if d.getName().isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS")))

    def read(self) -> DataFrame:
        v = self._versions()
        return self.spark.read.parquet(f"{self.path}/{v[-1]}") if v else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> None:
        n = (self._versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/{n}")
