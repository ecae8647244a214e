"""Processing only new or changed records (problem 6).

A table is divided into many partitions by a hash of its key. For each partition a fingerprint is kept: the number of
rows and the sum of their 64-bit row hashes, halves apart, which is independent of order and adds up from partial sums, so that it is combined
on the map side and only one small row per partition and task moves. Two states of a partition with the same fingerprint hold the same records; only partitions whose
fingerprints differ are read again, moved and compared row by row. The number of partitions follows the number of rows, ROWS of them
each, so that a change touches a like share of the table at any size.

`changed_files` and `changed_items` take the two states from the stated tables. `PartitionedState` keeps a derived table between runs: each run writes the partitions that changed
below its own number, by dynamic partition overwrite, and then a manifest that names for every partition the run that holds it. Readers go through
the last manifest, so a run that fails at any point has changed nothing, and repeating it replaces what it left behind: nothing is skipped and nothing comes twice.

Defined results: exact repeats of a row count once; a null content hash is never the same as anything; a null updated_at is
lowest; among fingerprints of a path with equal updated_at any with the same hash counts; an adapter without a successful run, or whose last one has no
read_upto, has read nothing; null keys of items are compared as equal to each other; empty tables give no case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import settle

#: Rows of a partition, about, and words of 64 bits that tell whether its keys differ.
ROWS, WORDS = 8, 8


def normal_path(path: Column) -> Column:
    """Letter case and the kind of slash do not tell paths apart."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def bucket(*keys: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("bigint")


def bits(key: Column) -> list[Column]:
    """One bit of WORDS words for a key; a partition whose bits, put together, are as many as its rows holds no key twice."""
    h = F.xxhash64(F.lit("bit"), key)
    return [F.when(F.pmod(h, F.lit(WORDS)) == i, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(h, 8), F.lit(64)).cast("int"))) for i in range(WORDS)]


def partitions_of(df: DataFrame) -> int:
    """A power of two of partitions with at most ROWS rows each, about; a count that Parquet answers from its footers."""
    return 1 << (df.count() // ROWS).bit_length()


def fingerprint(df: DataFrame, part: str, cols: list[str]) -> DataFrame:
    """Rows (part, rows, low, high): count and additive hash of each partition, combined on the map side."""
    h = F.xxhash64(*[df[c] for c in cols], *[df[c].isNull() for c in cols])
    return (
        df.select(df[part].alias("part"), h.alias("h"))
        .groupBy("part")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned("h", 32)).alias("high"))
    )


def changed_parts(before: DataFrame, after: DataFrame, gone: bool = True) -> DataFrame:
    """Partitions whose fingerprints differ or that only one state has; without `gone`, those that the later state has."""
    b = before.select("part", F.struct("rows", "low", "high").alias("b"))
    a = after.select("part", F.struct("rows", "low", "high").alias("a"))
    return b.join(a, "part", "full" if gone else "right").where(~F.col("a").eqNullSafe(F.col("b"))).select("part")


def newest_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(npath, content_hash) of the newest record of each path; ties keep every hash."""
    f = fingerprints.where(F.col("path").isNotNull()).select(normal_path(F.col("path")).alias("npath"), "content_hash", F.coalesce("updated_at", F.lit(-(1 << 62))).alias("u"))
    best = f.groupBy("npath", "content_hash").agg(F.max("u").alias("u"))
    top = f.groupBy("npath").agg(F.max("u").alias("u"))
    return best.join(top, ["npath", "u"]).select("npath", "content_hash")


def changed_files(candidates: DataFrame, fingerprints: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of `candidates` (path, size, mod_time_ns, content_hash) that are new or changed, each spelling of a path once."""
    n = parts or partitions_of(candidates)
    npath = normal_path(F.col("path"))
    part = bucket(npath, n=n).alias("part")
    files = candidates.where("not is_dir and path is not null")
    # First pass over path and hash alone: a partition is unchanged if its listing and its records are the same rows, each of another path. Records that were
    # superseded or repeated, or whose file is gone, make a partition differ, never the reverse; a null hash does as well.
    cols = ["npath", "content_hash"]
    listed = files.select(npath.alias("npath"), "content_hash", part)
    now = fingerprint(listed, "part", cols)
    unsure = listed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("content_hash").isNull()).alias("nulls"), *[F.bit_or(b).alias(f"b{i}") for i, b in enumerate(bits(F.col("npath")))])
    unsure = unsure.where((F.col("nulls") > 0) | (sum(F.bit_count(F.coalesce(F.col(f"b{i}"), F.lit(0))) for i in range(WORDS)) < F.col("rows"))).select("part")
    was = fingerprint(fingerprints.where("path is not null").select(npath.alias("npath"), "content_hash", part), "part", cols)
    differ = settle(changed_parts(was, now, gone=False).union(unsure).distinct())
    # Second pass: only rows of partitions that differ are moved.
    live = files.select("path", "size", "mod_time_ns", "content_hash", npath.alias("npath"), part).join(differ, "part", "left_semi")
    live = live.groupBy("path", "npath", "content_hash").agg(F.max("size").alias("size"), F.max("mod_time_ns").alias("mod_time_ns"))
    records = newest_fingerprints(fingerprints.where("path is not null").select("path", "content_hash", "updated_at", part).join(differ, "part", "left_semi"))
    return live.join(records, cols, "left_anti").select("path", "size", "mod_time_ns", "content_hash")


def read_marks(runs: DataFrame) -> DataFrame:
    """(adapter_id, mark): read_upto of each adapter's successful run with the greatest started_at."""
    ok = runs.where("status = 'success' and started_at is not null")
    last = ok.groupBy("adapter_id").agg(F.max(F.struct("started_at", F.col("read_upto").alias("mark"))).alias("m"))
    return last.select("adapter_id", "m.mark")


def changed_items(items: DataFrame, runs: DataFrame, parts: int | None = None) -> DataFrame:
    """Newest versions of items (source, id, updated_at, title, content, arrived_at) that the last successful run did not cover."""
    n = parts or partitions_of(items)
    marks = read_marks(runs).withColumnRenamed("adapter_id", "source")
    part = bucket(F.col("source"), F.col("id"), n=n).alias("part")
    late = F.col("arrived_at") > F.coalesce("mark", F.lit(-(1 << 62)))
    # First pass over the keys: the state after the last run is the rows it could read, and is compared with the present one.
    light = items.select("source", "id", "updated_at", "arrived_at", part).join(marks, "source", "left")
    cols = ["source", "id", "updated_at", "arrived_at"]
    differ = settle(changed_parts(fingerprint(light.where(~late), "part", cols), fingerprint(light, "part", cols), gone=False))
    # Second pass: titles and contents of the partitions that gained rows only.
    live = items.select("source", "id", "updated_at", "title", "content", "arrived_at", part).join(differ, "part", "left_semi").join(marks, "source", "left")
    versions = live.groupBy("source", "id", "updated_at", "title", "content").agg(F.min("arrived_at").alias("arrived_at"), F.max("mark").alias("mark"))
    newest = versions.groupBy("source", "id").agg(F.max(F.struct(F.coalesce("updated_at", F.lit(-(1 << 62))).alias("u"), "arrived_at", "title", "content", "updated_at", "mark")).alias("v"))
    case = F.col("v.arrived_at") > F.coalesce(F.col("v.mark"), F.lit(-(1 << 62)))
    return newest.where(case).select("source", "id", "v.updated_at", "v.title", "v.content", "v.arrived_at")


def found_rows(candidates: DataFrame, fingerprints: DataFrame, items: DataFrame, runs: DataFrame) -> DataFrame:
    files = changed_files(candidates, fingerprints).select(F.lit("file").alias("source"), F.col("path").alias("record_id")).distinct()
    return files.union(changed_items(items, runs).select("source", F.col("id").alias("record_id")).distinct())


class PartitionedState:
    """A derived table kept by partition in the shared folder, with a manifest of every successful run: (part, rows, low, high, run)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], partitions: int | None = None):
        self.spark, self.path, self.keys, self.partitions = spark, path.rstrip("/"), keys, partitions

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _runs(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/manifests")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._fs(f"{self.path}/manifests/{n}/_SUCCESS")[1]))

    def manifest(self) -> DataFrame:
        """The last successful run's fingerprints, and the run that wrote each partition."""
        done = self._runs()
        if not done:
            return self.spark.createDataFrame([], "part bigint, rows bigint, low bigint, high bigint, run bigint, of bigint")
        return self.spark.read.parquet(f"{self.path}/manifests/{done[-1]}")

    def read(self) -> DataFrame:
        """The table as of the last successful run; partitions that no manifest names aren't read."""
        if not self._runs():
            raise FileNotFoundError(f"no run has succeeded in {self.path}")
        named = self.manifest().select("run", "part")
        schema = self.spark.read.parquet(f"{self.path}/schema/{self._runs()[-1]}").schema.add("run", "long").add("part", "long")
        fs, data = self._fs(f"{self.path}/data")
        if not fs.exists(data):
            return self.spark.createDataFrame([], schema).drop("run", "part")
        return self.spark.read.schema(schema).parquet(f"{self.path}/data").join(named, ["run", "part"], "left_semi").drop("run", "part")

    def run(self, df: DataFrame, transform) -> DataFrame:
        """Recompute the changed partitions of `df` with `transform` and commit; returns the partitions that changed."""
        known = self.manifest()
        # The number of partitions is kept once chosen; a table that outgrew it fourfold is divided anew, and then computed whole once.
        before, wanted = known.agg(F.max("of")).first()[0], self.partitions or partitions_of(df)
        n = wanted if before is None or self.partitions or wanted > 4 * before else before
        if n != before:
            known = known.limit(0)
        number = (self._runs() or [0])[-1] + 1
        fs, left = self._fs(f"{self.path}/data/run={number}")
        fs.delete(left, True)  # of a run that failed; no manifest names it
        df = df.withColumn("part", bucket(*[F.col(k) for k in self.keys], n=n))
        now = settle(fingerprint(df, "part", [c for c in df.columns if c != "part"]))
        parts = settle(changed_parts(known, now))
        fresh = transform(df.join(parts, "part", "left_semi")).withColumn("run", F.lit(number).cast("bigint"))
        fresh.limit(0).drop("run", "part").write.mode("overwrite").parquet(f"{self.path}/schema/{number}")
        # Rows of a partition meet in one task, so that it has one file.
        fresh.repartition("part").write.partitionBy("run", "part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/data")
        written = parts.withColumn("new", F.lit(True))
        names = now.join(written, "part", "left").join(known.select("part", F.col("run").alias("old")), "part", "left")
        names.select("part", "rows", "low", "high", F.when(F.col("new"), F.lit(number)).otherwise(F.col("old")).cast("bigint").alias("run"), F.lit(n).cast("bigint").alias("of")).write.mode("overwrite").parquet(f"{self.path}/manifests/{number}")
        return parts

    def vacuum(self) -> None:
        """Remove the folders of runs that the last manifest doesn't name at all, and older manifests."""
        live = {r.run for r in self.manifest().select("run").distinct().collect()}  # at most one for each run since the last division
        last = (self._runs() or [0])[-1]
        for folder, keep in ((f"{self.path}/data", {f"run={r}" for r in live}), (f"{self.path}/manifests", {str(last)})):
            fs, p = self._fs(folder)
            for s in fs.listStatus(p) if fs.exists(p) else []:
                name = s.getPath().getName()
                if (name.startswith("run=") or name.isdigit()) and name not in keep:
                    fs.delete(s.getPath(), True)
