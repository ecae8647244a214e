"""Browser records as items: history, downloads and bookmarks, from tables exported of the browsers' stores."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import keys, text

HISTORY_TOP, DOWNLOAD_TOP = 5000, 2000


def newest(df: DataFrame, time: str, after: int, top: int | None, *ties: str) -> DataFrame:
    """Rows later than `after`, the latest `top` of them; all of them without `top`."""
    late = df.where(F.col(time) > after)
    return late if top is None else late.orderBy(F.desc(time), *ties).limit(top)


def item(source: str, id_: Column, title: Column, content: Column, preview: Column, metadata: Column, at: Column) -> list[Column]:
    return [id_.alias("id"), F.lit(source).alias("source"), title.alias("title"), content.alias("content"), preview.alias("preview"), metadata.alias("metadata_json"), at.alias("created_at"), at.alias("updated_at")]


def _history(df: DataFrame, source: str, at: Column) -> DataFrame:
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", F.col("url")).otherwise(F.col("title"))
    meta = F.to_json(F.struct(F.coalesce("visit_count", F.lit(0)).alias("visit_count"), "url"))
    return df.select(*item(source, F.col("url"), title, F.concat_ws("\n", title, "url"), F.col("url"), meta, at))


def chromium_history(urls: DataFrame, source: str, after: int = 0, top: int | None = HISTORY_TOP) -> DataFrame:
    """Items of `urls` (url, title, last_visit_time in microseconds since 1601, visit_count) visited after unix second `after`."""
    rows = newest(urls, "last_visit_time", (after + keys.WEBKIT_OFFSET) * 1_000_000 if after > 0 else 0, top, "url")
    return _history(rows, source, keys.webkit_to_unix(F.col("last_visit_time")))


def firefox_history(places: DataFrame, after: int = 0, top: int | None = HISTORY_TOP) -> DataFrame:
    """Items of `places` (url, title, last_visit_date in microseconds since 1970, visit_count)."""
    rows = newest(places, "last_visit_date", after * 1_000_000, top, "url")
    return _history(rows, "firefox", F.floor(F.col("last_visit_date") / 1_000_000).cast("bigint"))


def chromium_downloads(downloads: DataFrame, source: str, after: int = 0, top: int | None = DOWNLOAD_TOP) -> DataFrame:
    """Items of `downloads` (target_path, tab_url, start_time in microseconds since 1601, received_bytes, total_bytes)."""
    rows = newest(downloads, "start_time", (after + keys.WEBKIT_OFFSET) * 1_000_000 if after > 0 else 0, top, "target_path")
    name = text.base_name(F.col("target_path"))
    meta = F.to_json(F.struct(F.lit("download").alias("kind"), F.col("target_path").alias("path"), F.col("tab_url").alias("url"), "received_bytes", "total_bytes"))
    content = F.concat_ws("\n", name, "target_path", "tab_url")
    return rows.select(*item(source, F.concat(F.lit("download:"), F.col("target_path")), name, content, F.col("target_path"), meta, keys.webkit_to_unix(F.col("start_time"))))


def _bookmarks(df: DataFrame, source: str) -> DataFrame:
    title = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", F.col("url")).otherwise(F.col("name"))
    meta = F.to_json(F.struct(F.lit("bookmark").alias("kind"), F.col("url")))
    return df.select(*item(source, F.concat(F.lit("bookmark:"), F.col("url")), title, F.concat_ws("\n", title, "url"), F.col("url"), meta, F.col("added")))


def firefox_bookmarks(bookmarks: DataFrame, places: DataFrame, after: int = 0, top: int | None = HISTORY_TOP) -> DataFrame:
    """Bookmarks of type 1 joined to their places; the title is the first of bookmark's, place's and none that isn't null."""
    b = bookmarks.where("type = 1").select(F.col("fk").alias("place"), F.col("title").alias("own"), "dateAdded")
    rows = b.join(places.select(F.col("id").alias("place"), "url", F.col("title").alias("of_place")), "place")
    rows = newest(rows, "dateAdded", after * 1_000_000, top, "url")
    return _bookmarks(rows.select(F.coalesce("own", "of_place", F.lit("")).alias("name"), "url", F.floor(F.col("dateAdded") / 1_000_000).cast("bigint").alias("added")), "firefox")


def _flatten(tree: str | None) -> list[tuple[str, str, int]]:
    """Bookmarks of a tree of folders, in order, without recursion's limit."""
    try:
        roots = json.loads(tree or "{}").get("roots", {})
    except (ValueError, AttributeError):
        return []
    out, todo = [], [r for r in reversed(list(roots.values())) if isinstance(r, dict)] if isinstance(roots, dict) else []
    while todo:
        node = todo.pop()
        if node.get("type") == "url" and node.get("url"):
            try:
                added = int(node.get("date_added") or 0)
            except (TypeError, ValueError):
                added = 0
            out.append((str(node.get("name") or ""), node["url"], max(added // 1_000_000 - keys.WEBKIT_OFFSET, 0) if added > 0 else 0))
        todo += [c for c in reversed(node.get("children") or []) if isinstance(c, dict)]
    return out


def chromium_bookmarks(trees: DataFrame, source: str, column: str = "tree", after: int = 0) -> DataFrame:
    """Items of bookmark trees (JSON with nested folders) added after unix second `after`; broken JSON gives none. Folders nest to any depth, so trees are read in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for t in b.column(0).to_pylist() for r in _flatten(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["name", "url", "added"])

    rows = trees.select(column).mapInArrow(run, "name string, url string, added bigint").where(F.col("added") > after)
    return _bookmarks(rows, source)


def profiles(home: str, roaming: str | None = None) -> dict[str, dict[str, list[str]]]:
    """The stores of the browsers of a user below `home` (local application data) and `roaming`: histories and bookmarks by browser, those that are there."""
    chromium = {"chrome": ("Google", "Chrome"), "edge": ("Microsoft", "Edge")}
    out: dict[str, dict[str, list[str]]] = {"histories": {}, "bookmarks": {}}
    for name, (maker, product) in chromium.items():
        base = os.path.join(home, maker, product, "User Data", "Default")
        for kind, store in (("histories", "History"), ("bookmarks", "Bookmarks")):
            if os.path.isfile(p := os.path.join(base, store)):
                out[kind][name] = [p]
    for p in sorted(glob.glob(os.path.join(roaming or home, "Mozilla", "Firefox", "Profiles", "*", "places.sqlite"))):
        out["histories"].setdefault("firefox", []).append(p)
    return out


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot of a browser's table; the snapshot doesn't change, so no lock is needed."""
    return spark.read.parquet(path)
