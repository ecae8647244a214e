"""The engine: indexing paths, syncing browsers, watching changes and answering search requests."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import schema
from corpusmill.functions import chunking, keys, text
from corpusmill.operators import index, match, query, rank, sync
from corpusmill.session import settle
from corpusmill.sources import browser, files
from corpusmill.streaming import watch


# Seconds a call may take (0: any), others five.
TIMEOUTS = {"search": 120.0, "index_path": 0, "sync_browsers": 0, "index_progress": 0}
#: What ends a call that takes too long.
CANCELS = {"search": "cancel_search"}


@dataclass(frozen=True)
class SearchRequest:
    query: str
    source: str = ""
    file_type: str = ""
    since: int = 0
    until: int = 0
    limit: int = 0
    offset: int = 0


@dataclass
class SearchResponse:
    query: str
    elapsed_ms: int = 0
    total: int = 0
    results: list[dict] = field(default_factory=list)
    has_more: bool = False


@dataclass
class IndexProgress:
    active: bool = False
    kind: str = ""
    phase: str = "idle"
    path: str = ""
    total: int = 0
    scanned: int = 0
    indexed: int = 0
    skipped: int = 0
    started_at: float = 0.0
    updated_at: float = 0.0
    rate: float = 0.0
    eta_ms: int = 0
    last_error: str = ""
    last_completed: float = 0.0


def candidates(chunks: DataFrame, request: SearchRequest, scope: str = "shard") -> DataFrame:
    """Scored candidates of the main index, from the texts: the best of each shard."""
    _, _, k = match.limits(request.limit, request.offset)
    tree = query.parse(query.rewrite(request.query))
    hit = match.filtered(match.scored(chunks, tree, scope), request.source, request.file_type, request.since, request.until)
    return match.shard_top(hit, k)


def stored_top(stored: index.Index, hits: DataFrame, request: SearchRequest) -> DataFrame:
    """The best hits (row_id, shard, score) of each shard with all of their columns but the content; only narrow columns are read of rows that aren't among them."""
    _, _, k = match.limits(request.limit, request.offset)
    narrow = stored.chunks().select("row_id", "source", "file_type", "updated_at")
    top = match.shard_top(match.filtered(hits.join(narrow, "row_id"), request.source, request.file_type, request.since, request.until), k)
    # At most k rows of each shard.
    return stored.chunks().drop("content").join(F.broadcast(top.select("row_id", "shard", "score")), "row_id")


def stored_candidates(stored: index.Index, request: SearchRequest, scope: str = "shard") -> DataFrame:
    """Scored candidates from a stored index; ideographs are looked for in the gram index first, and the main index answers if that gives nothing."""
    grams = query.cjk_query(request.query)
    if grams:
        found = stored_top(stored, match.scored_grams_stored(stored, grams), request).cache()  # bounded, and needed again
        if not found.isEmpty():
            return found
    return stored_top(stored, match.scored_stored(stored, query.parse(query.rewrite(request.query)), scope), request)


def results(found: DataFrame, request: SearchRequest, now: int, more: int = 0) -> DataFrame:
    """Candidates reranked, each document once, noise left out, in pages, with snippets; `more` rows beyond the page tell whether there is another."""
    limit, offset, _ = match.limits(request.limit, request.offset)
    ranked = rank.without_noise(rank.deduped(rank.adjusted(found, request.query, now)), request.query)
    page = rank.page(ranked, limit + more, offset)
    page = page.withColumn("preview", text.snippet(F.col("preview"), request.query))
    return page.select("rank", *[f.name for f in schema.RESULT])


def search(stored: index.Index, request: SearchRequest, now: int, scope: str = "shard") -> DataFrame:
    """One page of results of a stored index as a DataFrame."""
    return results(stored_candidates(stored, request, scope), request, now)


def is_volume_root(path: str) -> bool:
    """A drive or the root of the tree: listed by names first, its contents are read later."""
    p = path.strip().replace("\\", "/")
    return p == "/" or re.fullmatch("[A-Za-z]:/?", p) is not None


class Engine:
    """State lives below `root` in the shared file system; every method is one or a few Spark jobs."""

    def __init__(self, spark: SparkSession, root: str, extractor: Callable[[str, bytes], str | None] | None = None, browsers: dict[str, dict[str, str]] | None = None, complete: bool = True, backfill_delay: float = 2.0):
        self.spark, self.root, self.extractor = spark, root.rstrip("/"), extractor
        #: Whether a browser sync takes every new record, or the newest ones only and forgets the rest.
        self.complete = complete
        self.backfill_delay = backfill_delay
        self.index = index.Index(spark, f"{self.root}/index")
        self.records = sync.Table(spark, f"{self.root}/records", schema.FINGERPRINT)
        self.state = sync.Table(spark, f"{self.root}/state", schema.SYNC_STATE)
        self.watched = sync.Table(spark, f"{self.root}/watched", schema.WATCHED)
        self.progress = IndexProgress()
        self.started = time.time()
        #: Snapshots of the browsers' tables by kind (histories, downloads, bookmarks) and adapter, for calls that name none.
        self.browsers = browsers or {}
        self.paused = False
        self._cancelled = threading.Event()
        self._indexing = threading.RLock()  # one run at a time
        self._running: set[str] = set()
        self._backfills: list[threading.Thread] = []
        #: Counters of the streams that watch.
        self.streams = watch.Progress()
        self._listening = False
        self._closed = threading.Event()
        self._tag = f"corpusmill-{uuid.uuid4().hex[:8]}"

    # -- information

    def health(self) -> dict:
        return {"ok": True, "spark_version": self.spark.version, "uptime_ms": int((time.time() - self.started) * 1000), "local_only": True}

    def index_progress(self) -> dict:
        """The counters of the run, its rate, and the time left if what is listed goes on at that rate."""
        p = asdict(self.progress)
        spent = (time.time() if p["active"] else p["updated_at"]) - p["started_at"] if p["started_at"] else 0
        done = p["indexed"] + p["skipped"]
        rate = done / spent if spent > 0 else 0.0
        left = max(p["total"] - done, 0)
        return p | {"rate": rate, "eta_ms": int(left / rate * 1000) if p["active"] and rate > 0 else 0, "elapsed_ms": int(spent * 1000)}

    def _phase(self, phase: str) -> None:
        self.progress.phase, self.progress.updated_at = phase, time.time()

    # -- search

    def chunks(self) -> DataFrame:
        return self.index.chunks() if self.index.current() else self.spark.createDataFrame([], schema.CHUNK)

    def search(self, request: SearchRequest, now: int | None = None) -> SearchResponse:
        began = time.time()
        out = SearchResponse(request.query)
        limit, _, _ = match.limits(request.limit, request.offset)
        if request.query.strip() and self.index.current():
            self.cancel_search()
            with self._tagged("search"):
                found = stored_candidates(self.index, request)
                rows = [r.asDict() for r in results(found, request, now or int(time.time()), 1).orderBy("rank").collect()]  # one page
                found.unpersist()
            out.results, out.has_more = rows[:limit], len(rows) > limit
        out.total, out.elapsed_ms = len(out.results), int((time.time() - began) * 1000)
        return out

    def cancel_search(self) -> dict:
        return self._cancel("search")

    # -- indexing

    @contextmanager
    def _tagged(self, name: str) -> Iterator[None]:
        """Jobs of the block carry the tag that cancelling interrupts."""
        self.spark.addTag(f"{self._tag}-{name}")
        self._running.add(name)
        try:
            yield
        finally:
            self._running.discard(name)
            self.spark.removeTag(f"{self._tag}-{name}")

    def _cancel(self, name: str) -> dict:
        """Interrupt the jobs of a run; says whether there was one."""
        running = name in self._running
        if running:
            self.spark.interruptTag(f"{self._tag}-{name}")
        return {"ok": True, "canceled": running}

    def _wait_while_paused(self) -> None:
        """Hold a backfill until it is resumed; cancelling ends it."""
        before = self.progress.phase
        while self.paused:
            self.progress.phase = "paused"
            if self._cancelled.wait(0.25):
                raise RuntimeError("cancelled")
        self.progress.phase = before

    def _fresh(self, items: DataFrame, stream: bool = False) -> DataFrame:
        """Items cleaned and cut into rows of the chunk table without ids; files are cut as a stream is."""
        cleaned = text.clean_stream(F.col("content")) if stream else text.clean(F.col("content"))
        clean = items.withColumn("content", cleaned).where(F.col("content") != "")
        fresh = chunking.split_items(clean, stream=stream).withColumnRenamed("id", "item_id")
        cols = [f.name for f in schema.CHUNK if f.name != "row_id"]
        return fresh.select(*cols).withColumn("row_id", F.lit(None).cast("bigint"))

    def _store(self, items: DataFrame, stream: bool = False, gone: DataFrame | None = None) -> DataFrame:
        """Write items, whose earlier chunks are replaced, and leave out what is below the paths `gone`, as one segment of what is new; gives their chunks."""
        fresh = settle(self._fresh(items, stream))
        self._replace(fresh, gone)
        return fresh

    def _replace(self, fresh: DataFrame, gone: DataFrame | None) -> None:
        if not self.index.current():
            self.index.write(sync.apply_diff(self.chunks().select(*[f.name for f in schema.CHUNK]), fresh))
            return
        old = self.index.chunks().select(*[f.name for f in schema.CHUNK])
        kept = old if gone is None else sync.delete_subtrees(old, gone)
        new, dead = sync.diff_rows(kept, fresh, self.index.sums())
        if gone is not None:
            dead = dead.union(old.select("row_id").join(kept.select("row_id"), "row_id", "left_anti"))
        self.index.update(settle(new), dead)

    def _leave_out(self, kept: DataFrame) -> None:
        """A version without the rows of the current one that aren't in `kept`."""
        now = self.index.chunks()
        self.index.update(now.limit(0), now.select("row_id").join(kept.select("row_id"), "row_id", "left_anti"))

    def index_path(self, path: str, max_bytes: int = files.MAX_BYTES, content_only: bool = False, watch_it: bool = True, strict: bool = True) -> dict:
        """Index what is new or changed below `path`; a second call without changes writes nothing. The root of a volume is listed by names, its contents are read by a backfill later."""
        if not path or not path.strip():
            raise ValueError("path is required")
        with self._indexing, self._tagged("index"):
            out = self._index_path(path, max_bytes, content_only, watch_it, strict, is_volume_root(path) and not content_only)
        if is_volume_root(path) and not content_only:
            self.schedule_backfill(path)
        return out

    def _index_path(self, path: str, max_bytes: int, content_only: bool, watch_it: bool, strict: bool, path_only: bool = False) -> dict:
        last_completed = self.progress.last_completed
        self.progress = IndexProgress(True, "content" if content_only else "fast", "starting", path, started_at=time.time(), updated_at=time.time(), last_completed=last_completed)
        error = ""
        try:
            if content_only:
                self._cancelled.clear()
                self._wait_while_paused()
            key = ("file-content:" if content_only else "file:") + path.lower()
            last = max([0, *[r.last_sync_time for r in self.state.read().where(F.col("adapter_id") == key).collect()]])
            self._phase("scanning")
            listed = files.list_files(self.spark, path, max_bytes, prune=True)
            count, top = self._take(listed, last, content_only, strict, path_only, max_bytes)
            if top > last:
                mine = self.spark.createDataFrame([(key, top, int(time.time()))], schema.SYNC_STATE)
                self.state.write(self.state.read().where(F.col("adapter_id") != key).unionByName(mine))
            if watch_it:
                self.add_watched(path)
            return count
        except Exception as e:
            error = str(e).splitlines()[0] if str(e) else type(e).__name__
            raise
        finally:
            p = self.progress
            p.active, p.phase, p.updated_at, p.last_error = False, "idle", time.time(), error
            if not error:
                p.last_completed = time.time()

    def _take(self, listed: DataFrame, last: int, content_only: bool = False, strict: bool = True, path_only: bool = False, max_bytes: int = files.MAX_BYTES, gone: DataFrame | None = None) -> tuple[dict, int]:
        """Index the listed candidates that are new or changed and forget what is below the paths `gone`; gives the counters and the latest time."""
        limit = 0 if path_only else min(max_bytes, files.BACKFILL_BYTES if content_only else files.FOREGROUND_BYTES)
        known = self.records.read() if gone is None else sync.delete_subtrees(self.records.read(), gone)
        decided = sync.decisions(listed, known, last, content_only, limit, strict, rich=self.extractor is not None).cache()
        count = sync.summary(decided).first()
        self.progress.total = self.progress.scanned = count.scanned
        self.progress.skipped = count.skipped
        self._phase("indexing")
        if content_only:
            self._wait_while_paused()
        if count.indexed:
            todo = decided.where("action != 'skip'")
            # Only what is to be indexed is read, once, by the tasks that hold its path.
            texts = files.read_listed(todo.where("action = 'index_content'").select("path", "size", "mod_time_ns"), self.extractor).where(text.trim_space(F.col("content")) != "").cache()
            # What turns out empty, or can't be read, is still found by its name.
            named = files.named_items(todo.join(texts.select("path"), "path", "left_anti"))
            read = texts.select("path").withColumn("__read", F.lit(True))
            self._phase("finalizing")
            fresh = self._store(files.file_items(texts).unionByName(named), stream=True, gone=gone)
            kind = F.when(F.col("__read"), F.lit("content:")).otherwise(F.when(F.col("kind") == "content:", F.lit("content:")).otherwise(F.lit("path:")))
            # A file's fingerprint is that of the hashes of its chunks, in order.
            prints = fresh.groupBy("path").agg(F.substring_index(keys.content_fingerprint(F.col("ordinal"), F.col("hash")), ":", -1).alias("__print"))
            done = todo.join(read, "path", "left").join(prints, "path", "left")
            done = done.select("path", "size", "mod_time_ns", F.concat(kind, F.coalesce("__print", F.sha1(F.lit("")))).alias("content_hash"), F.lit(int(time.time())).cast("bigint").alias("updated_at"))
            self.records.write(sync.upsert_records(known, done))
            self.progress.indexed = count.indexed
            texts.unpersist()
        elif gone is not None:
            if self.index.current():
                self._leave_out(sync.delete_subtrees(self.chunks(), gone))
            self.records.write(known)
        top = decided.agg(F.max(F.floor(F.col("mod_time_ns") / 1_000_000_000))).first()[0] or 0
        decided.unpersist()
        return {"scanned": count.scanned, "indexed": count.indexed, "skipped": count.skipped}, int(top)

    def schedule_backfill(self, path: str) -> threading.Thread:
        """Read the contents below a path that was listed by names only, a little later; a backfill of the engine that still waits goes on."""

        def run() -> None:
            time.sleep(self.backfill_delay)
            try:
                self.backfill(path)
            except Exception as e:  # its outcome stands in the progress
                self.progress.last_error = str(e).splitlines()[0] if str(e) else type(e).__name__

        t = threading.Thread(target=run, daemon=True)
        self._backfills = [x for x in self._backfills if x.is_alive()] + [t]
        t.start()
        return t

    def delete_path(self, path: str) -> None:
        """Forget a path and all below it."""
        if self.index.current():
            self._leave_out(sync.delete_subtree(self.chunks(), path))
        self.records.write(sync.delete_subtree(self.records.read(), path))

    def backfill(self, path: str) -> dict:
        """Read the contents of files that are known by name only."""
        return self.index_path(path, content_only=True, watch_it=False, strict=False)

    def prune_missing(self, path: str) -> None:
        """Forget files below `path` that are no longer there."""
        self._leave_out(sync.prune_missing(self.chunks(), files.list_files(self.spark, path), path))

    def sync_browsers(self, histories: dict[str, DataFrame], downloads: dict[str, DataFrame] | None = None, bookmarks: dict | None = None) -> dict[str, int]:
        """Index what the browsers recorded since their watermarks, and move those on."""
        with self._tagged("sync"):
            return self._sync_browsers(histories, downloads, bookmarks)

    def _sync_browsers(self, histories: dict[str, DataFrame], downloads: dict[str, DataFrame] | None, bookmarks: dict | None) -> dict[str, int]:
        states = {r.adapter_id: r.last_sync_time for r in self.state.read().collect()}  # one row per adapter
        counts, top = {}, None if self.complete else browser.HISTORY_TOP
        for name in dict.fromkeys([*histories, *(downloads or {}), *(bookmarks or {})]):
            after, parts = states.get(name, 0), []
            if name in histories:
                parts.append(browser.firefox_history(histories[name], after, top) if name == "firefox" else browser.chromium_history(histories[name], name, after, top))
            if downloads and name in downloads:
                parts.append(browser.chromium_downloads(downloads[name], name, after, browser.DOWNLOAD_TOP if top else None))
            if bookmarks and name in bookmarks:  # those of Firefox are two tables
                parts.append(browser.firefox_bookmarks(*bookmarks[name], after, top) if name == "firefox" else browser.chromium_bookmarks(bookmarks[name], name, after=after))
            items = parts[0]
            for p in parts[1:]:
                items = items.unionByName(p)
            items = items.withColumn("path", F.lit("")).withColumn("file_type", F.lit("")).cache()
            seen = items.agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("top")).first()
            if seen.n:
                self._store(items)
                mine = self.spark.createDataFrame([(name, int(seen.top), int(time.time()))], schema.SYNC_STATE)
                self.state.write(self.state.read().where(F.col("adapter_id") != name).unionByName(mine))
            counts[name] = seen.n
            items.unpersist()
        return counts

    # -- watching and control

    def add_watched(self, path: str) -> None:
        known = self.watched.read()
        if known.where(F.col("path") == path).isEmpty():
            self.watched.write(known.unionByName(self.spark.createDataFrame([(path, int(time.time()))], schema.WATCHED)))

    def remove_watched(self, path: str) -> None:
        self.watched.write(self.watched.read().where(F.col("path") != path))

    def watched_paths(self) -> list[str]:
        return [r.path for r in self.watched.read().orderBy("added_at", "path").collect()]  # configured by hand

    def resync(self) -> dict[str, dict]:
        """Catch up with every watched path after a restart; a path that is gone is forgotten, the second of the last run is looked at again."""
        out = {}
        for p in self.watched_paths():
            key = "file:" + p.lower()
            self.state.write(self.state.read().withColumn("last_sync_time", F.when(F.col("adapter_id") == key, F.greatest(F.col("last_sync_time") - 1, F.lit(0))).otherwise(F.col("last_sync_time"))))
            if files.exists(p):
                out[p] = self.index_path(p, watch_it=False)
            else:
                self.delete_path(p)
                self.remove_watched(p)
                out[p] = {"scanned": 0, "indexed": 0, "skipped": 0}
        return out

    def apply_changes(self, actions: DataFrame) -> dict:
        """Apply changes of paths (path, action), however many, by one new version of the index: what is gone is forgotten, what is there is indexed anew, folders with all below them."""
        with self._indexing, self._tagged("index"):
            now = files.looked_at(actions.select("path", "action")).cache()
            gone = now.where("mod_time_ns is null or action = 'remove'").select("path")
            here = now.where("mod_time_ns is not null and action != 'remove'").select("path", "size", "mod_time_ns", "is_dir")
            below = files.list_below(self.spark, here.where("is_dir").select("path"))
            listed = files.admitted_names(here.where(f"is_dir or size <= {files.MAX_BYTES}")).unionByName(below).dropDuplicates(["path"])
            count, _ = self._take(listed, 0, strict=False, gone=gone if not gone.isEmpty() else None)
            for p in self.watched_paths():  # few, configured by hand
                if not gone.where(F.col("path") == p).isEmpty():
                    self.remove_watched(p)
            now.unpersist()
        return count

    def watch(self, events: DataFrame, checkpoint: str, once: bool = False):
        """Apply a stream of change events (ts, path, op)."""

        def apply(batch: DataFrame, _: int) -> None:
            if not batch.isEmpty():
                self.apply_changes(batch.select("path", "action"))

        if not self._listening:
            self.spark.streams.addListener(self.streams)
            self._listening = True
        return watch.watch(events, apply, checkpoint, once=once)

    def pause_content_index(self) -> dict:
        """Hold backfills at their next step; search and the indexing of paths go on."""
        self.paused = True
        return {"ok": True, "paused": True}

    def resume_content_index(self) -> dict:
        self.paused = False
        return {"ok": True, "paused": False}

    def cancel_index(self) -> dict:
        self._cancelled.set()
        return self._cancel("index")

    def cancel_sync_browsers(self) -> dict:
        return self._cancel("sync")

    def optimize(self) -> dict:
        """Rewrite the index in well-sized, sorted files."""
        if self.index.current():
            self.index.write(self.index.chunks())
        return {"ok": True}

    def optimize_every(self, seconds: float = 1800.0) -> threading.Thread:
        """Rewrite the index from time to time, when it has more than one segment and nothing else is being indexed."""

        def run() -> None:
            while not self._closed.wait(seconds):
                if len(self.index.manifest()["segments"]) > 1 and self._indexing.acquire(blocking=False):
                    try:
                        self.optimize()
                    finally:
                        self._indexing.release()

        t = threading.Thread(target=run, daemon=True)
        t.start()
        return t

    def warm_up(self) -> int:
        """Read the counts and the vocabulary's first pages, so that the first search finds them cached; gives the number of chunks."""
        if not self.index.current():
            return 0
        self.index.table("postings").where(F.col("token") == "").count()
        return self.index.sums().agg(F.sum("n")).first()[0] or 0

    def close(self) -> None:
        """Stop what runs beside calls."""
        self._closed.set()
        self.cancel_index()
        if self._listening:
            self.spark.streams.removeListener(self.streams)
            self._listening = False

    # -- calls by message

    def call(self, line: str) -> str | None:
        """Answer one JSON message {type: request, id, method, params}; errors come back in the envelope, what is no JSON gets no answer. A call beyond its time is cancelled."""
        try:
            m = json.loads(line)
        except ValueError:
            return None
        number = m.get("id") if isinstance(m, dict) else None
        answer = lambda result=None, error=None: json.dumps({"type": "response", "id": number, "result": result} | ({"error": {"code": "core_error", "message": error}} if error else {}), default=str)
        if not isinstance(m, dict) or m.get("type") != "request" or not number or not m.get("method"):
            return answer(error="invalid request envelope")
        method, params = m["method"], m.get("params") or {}
        handler = {
            "search": lambda: asdict(self.search(SearchRequest(**{k: v for k, v in params.items() if k in SearchRequest.__dataclass_fields__}))),
            "index_path": lambda: self.index_path(params.get("path", ""), params.get("max_bytes") or files.MAX_BYTES),
            "sync_browsers": lambda: self.sync_browsers(**self._snapshots(params or self.browsers)),
        } | {n: getattr(self, n) for n in ("health", "index_progress", "cancel_search", "cancel_index", "pause_content_index", "resume_content_index", "cancel_sync_browsers", "optimize")}
        if method not in handler:
            return answer(error=f"unknown method: {method}")
        late = None
        if (limit := TIMEOUTS.get(method, 5.0)) and method in CANCELS:
            late = threading.Timer(limit, getattr(self, CANCELS[method]))
            late.start()
        try:
            return answer(handler[method]())
        except Exception as e:
            return answer(error=str(e).splitlines()[0] if str(e) else type(e).__name__)
        finally:
            if late:
                late.cancel()

    def _snapshots(self, paths: dict) -> dict:
        """Tables of histories, downloads and bookmarks by browser; the bookmarks of Firefox are a pair of paths."""
        read = lambda p: tuple(map(read, p)) if isinstance(p, (list, tuple)) else browser.from_parquet(self.spark, p)
        return {k: {n: read(p) for n, p in (paths.get(k) or {}).items()} for k in ("histories", "downloads", "bookmarks")}
