"""The inverted index as tables: postings, document statistics and corpus statistics."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import keys, text
from corpusmill.schema import CHUNK


def analyzed(chunks: DataFrame) -> DataFrame:
    """Chunks with their shard, the terms of title and content, and their number of terms."""
    df = chunks.withColumn("shard", keys.rowid_shard(F.col("row_id")))
    df = df.withColumn("title_terms", text.terms(F.col("title"))).withColumn("content_terms", text.terms(F.col("content")))
    return df.withColumn("terms", F.size("title_terms") + F.size("content_terms"))


def postings(chunks: DataFrame) -> DataFrame:
    """(shard, token, row_id, col, tf, positions, terms): where each term stands, and the length of its row; col 0 is the title, 1 the content.

    One Arrow pass over each row's terms, as a row's postings hang on that row alone: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cols, token, tf, positions, terms = [], [], [], [], [], []
            for i, both in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                length = len(both[0]) + len(both[1])
                for col, words in enumerate(both):
                    places: dict[str, list[int]] = {}
                    for k, w in enumerate(words):
                        places.setdefault(w, []).append(k)
                    at += [i] * len(places)
                    cols += [col] * len(places)
                    terms += [length] * len(places)
                    token += places
                    positions += places.values()
                    tf += map(len, places.values())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(token, pa.string()), b.column(1).take(take), *(pa.array(x, t) for x, t in ((cols, pa.int32()), (tf, pa.int32()), (positions, pa.list_(pa.int32())), (terms, pa.int32())))], names=["shard", "token", "row_id", "col", "tf", "positions", "terms"])

    a = analyzed(chunks.select("row_id", "title", "content")).select("shard", "row_id", "title_terms", "content_terms")
    kind = chunks.schema["row_id"].dataType.simpleString()
    return a.mapInArrow(run, f"shard int, token string, row_id {kind}, col int, tf int, positions array<int>, terms int")


def grams_of(chunks: DataFrame) -> DataFrame:
    grams = text.cjk_grams(text.gram_text(F.col("title"), F.col("content"), F.col("preview")))
    return chunks.select(keys.rowid_shard(F.col("row_id")).alias("shard"), "row_id", grams.alias("grams"))


def gram_postings(chunks: DataFrame) -> DataFrame:
    """(shard, token, row_id, terms): the grams of each chunk that has any, and their number."""
    g = grams_of(chunks).withColumn("terms", F.size("grams"))
    return g.select("shard", "row_id", "terms", F.explode("grams").alias("token")).select("shard", "token", "row_id", "terms")


def doc_stats(chunks: DataFrame) -> DataFrame:
    a = analyzed(chunks.select("row_id", "title", "content"))
    return a.select("shard", "row_id", F.size("title_terms").alias("title_len"), F.size("content_terms").alias("content_len"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """(shard, n_docs, avg_len)."""
    return doc_stats(chunks).groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.col("title_len") + F.col("content_len")).alias("avg_len"))


def docs_of(chunks: DataFrame) -> DataFrame:
    """(shard, row_id, terms, grams): the lengths of each row, in one pass."""
    a = analyzed(chunks.select("row_id", "title", "content", "preview"))
    return a.select("shard", "row_id", "terms", F.size(text.cjk_grams(text.gram_text(F.col("title"), F.col("content"), F.col("preview")))).alias("grams"))


def sums_of(docs: DataFrame, sign: int = 1) -> DataFrame:
    """(shard, n, len, gram, top): sums over rows, and the greatest local number; with sign -1 those that go."""
    top = F.max(keys.rowid_local(F.col("row_id"))) if sign > 0 else F.lit(0).cast("bigint")
    return docs.groupBy("shard").agg((sign * F.count(F.lit(1))).alias("n"), (sign * F.sum("terms")).alias("len"), (sign * F.sum("grams")).alias("gram"), top.alias("top"))


#: Schemas of the stored tables, so that an empty index can be read as well.
STORED = {
    "chunks": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHUNK) + ", shard int",
    "postings": "token string, row_id bigint, col int, tf int, positions array<int>, terms int, shard int",
    "grams": "token string, row_id bigint, terms int, shard int",
    "docs": "row_id bigint, terms int, grams int, shard int",
}
SUMS = "shard int, n bigint, len bigint, gram bigint, top bigint"
#: Segments, and share of rows that were superseded, beyond which an update rewrites the index as one segment.
SEGMENTS, DEAD = 12, 0.2


class Index:
    """Chunks, postings and statistics in segments: folders that are written once.

    A version is a small manifest that names its segments, and the sums over its rows; readers see a version when its manifest is there, so never a half-written one. An update
    writes a segment of the new rows only, with the ids of the rows of earlier segments that it supersedes; those are left out when tables are read. `write` and,
    beyond SEGMENTS or DEAD, an update make one segment of everything.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(self._fs(f"{self.path}/{n}/manifest")[1]))

    def current(self) -> str | None:
        v = self.versions()
        return f"{self.path}/v{v[-1]}" if v else None

    def manifest(self, version: int | None = None) -> dict:
        """segments: numbers in order; dead: how many rows of them were superseded."""
        v = version or (self.versions() or [0])[-1]
        if not v:
            return {"segments": [], "dead": 0}
        fs, p = self._fs(f"{self.path}/v{v}/manifest")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, number: int, segments: list[int], dead: int, sums: DataFrame, keep: int) -> str:
        out = f"{self.path}/v{number}"
        sums.coalesce(1).write.mode("overwrite").parquet(f"{out}/sums")
        known = self.versions()
        fs, p = self._fs(f"{out}/manifest.tmp")
        stream = fs.create(p, True)
        stream.write(bytearray(json.dumps({"segments": segments, "dead": dead}).encode()))
        stream.close()
        fs.rename(p, self._fs(f"{out}/manifest")[1])
        old = known[: max(0, len(known) + 1 - keep)]
        live = {n for v in [*known[len(old) :], number] for n in self.manifest(v)["segments"]}
        for v in old:
            gone = self.manifest(v)["segments"]
            fs.delete(self._fs(f"{self.path}/v{v}")[1], True)
            for n in gone:
                if n not in live:
                    fs.delete(self._fs(f"{self.path}/s{n}")[1], True)
        return out

    def _segment(self, number: int, chunks: DataFrame) -> None:
        out = f"{self.path}/s{number}"
        by_shard = chunks.select(*[f.name for f in CHUNK]).withColumn("shard", keys.rowid_shard(F.col("row_id")))
        # Rebalanced, a shard has as many files of the advisory size as it needs, however large it is.
        by_shard.hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(f"{out}/chunks")
        stored = self._read(number, "chunks").drop("shard")
        # Sorted by term, row groups hold few terms and a search reads only those of its own.
        postings(stored).repartitionByRange("shard", "token").sortWithinPartitions("shard", "token", "row_id").write.mode("overwrite").partitionBy("shard").parquet(f"{out}/postings")
        gram_postings(stored).repartitionByRange("shard", "token").sortWithinPartitions("shard", "token", "row_id").write.mode("overwrite").partitionBy("shard").parquet(f"{out}/grams")
        docs_of(stored).write.mode("overwrite").partitionBy("shard").parquet(f"{out}/docs")

    def _read(self, number: int, name: str) -> DataFrame:
        return self.spark.read.schema(STORED[name]).parquet(f"{self.path}/s{number}/{name}")

    def write(self, chunks: DataFrame, keep: int = 2) -> str:
        """Make `chunks` the whole index, as one segment; older versions but `keep` are removed."""
        number = (self.versions() or [0])[-1] + 1
        self._segment(number, chunks)
        return self._commit(number, [number], 0, sums_of(self._read(number, "docs")), keep)

    def update(self, fresh: DataFrame, gone: DataFrame, keep: int = 2) -> str:
        """Add the rows `fresh`, with their ids, and leave out the rows `gone` (row_id), and those of earlier segments that `fresh` replaces."""
        known = self.versions()
        before = self.manifest()
        if not known:
            return self.write(fresh, keep)
        number = known[-1] + 1
        self._segment(number, fresh)
        new = self._read(number, "docs")
        lost = gone.select("row_id").union(new.select("row_id")).distinct().join(self.table("docs"), "row_id")
        lost.select("row_id").write.mode("overwrite").parquet(f"{self.path}/s{number}/dead")
        out = self.spark.read.schema("row_id bigint").parquet(f"{self.path}/s{number}/dead")
        dead = before["dead"] + out.count()
        sums = self.sums().unionByName(sums_of(new)).unionByName(sums_of(self.table("docs").join(out, "row_id", "left_semi"), -1))
        sums = sums.groupBy("shard").agg(F.sum("n").alias("n"), F.sum("len").alias("len"), F.sum("gram").alias("gram"), F.max("top").alias("top"))
        segments = [*before["segments"], number]
        path = self._commit(number, segments, dead, sums, keep)
        rows = sums.agg(F.sum("n")).first()[0] or 0
        return self.write(self.chunks(), keep) if len(segments) > SEGMENTS or dead > DEAD * max(rows, 1) and rows > 1000 else path

    def table(self, name: str) -> DataFrame:
        """A stored table of the current version: its segments without the rows that later ones supersede."""
        v = (self.versions() or [0])[-1]
        if not v:
            raise FileNotFoundError(f"no index in {self.path}")
        if name == "stats":
            s = self.sums().where("n > 0")
            return s.select("shard", F.col("n").alias("n_docs"), (F.col("len") / F.col("n")).alias("avg_len"), (F.col("gram") / F.col("n")).alias("avg_grams"))
        segments = self.manifest(v)["segments"]
        parts = [self._read(n, name).withColumn("__segment", F.lit(n)) for n in segments]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        if len(segments) > 1:
            dead = [self.spark.read.schema("row_id bigint").parquet(f"{self.path}/s{n}/dead").select(F.col("row_id").alias("__row"), F.lit(n).alias("__by")) for n in segments[1:]]
            every = dead[0]
            for d in dead[1:]:
                every = every.unionByName(d)
            last = every.groupBy("__row").agg(F.max("__by").alias("__by"))
            out = out.join(last, (F.col("row_id") == F.col("__row")) & (F.col("__segment") < F.col("__by")), "left_anti")
        return out.drop("__segment")

    def sums(self) -> DataFrame:
        """(shard, n, len, gram, top) of the current version."""
        return self.spark.read.schema(SUMS).parquet(f"{self.current()}/sums")

    def chunks(self) -> DataFrame:
        return self.table("chunks").drop("shard")
