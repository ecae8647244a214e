"""File trees as tables: listing, the predicates that decide what is looked at, and plain-text extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import keys, text
from corpusmill.schema import CANDIDATE
from corpusmill.session import settle

# What a walk leaves out and what it reads as text.
SKIPPED_DIRECTORIES = (
    "$recycle.bin", ".idea", ".vscode", "__pycache__", "addons", "assets", "appdata", "bin", "build", "cache", "dist", "dist-electron", "doc", "docs", "documentation", "example", "examples", "font", "fonts", "image", "images", "img", "imgs", "logs", "mui",
    "node_modules", "obj", "office6", "out", "plugin", "plugins", "res", "resource", "resources", "sample", "samples", "skin", "skins", "static", "target", "test", "testdata", "tests", "temp", "tmp", "uxkit", "vendor", "venv", "windows.old", "system volume information",
)
SYSTEM_ROOTS = ("windows", "program files", "program files (x86)", "programdata", "perflogs")
SKIPPED_FILES = (".ds_store", "desktop.ini", "thumbs.db")
SKIPPED_SUFFIXES = (".bak", ".cache", ".crdownload", ".download", ".lock", ".partial", ".part", ".swp", ".swo", ".temp", ".tmp", "~")
NOISY_FRAGMENTS = (
    "/appdata/local/google/chrome/user data/", "/appdata/local/microsoft/windows/inetcache/", "/appdata/local/microsoft/edge/user data/", "/appdata/roaming/code/cacheddata/", "/appdata/roaming/code/cache/", "/appdata/roaming/npm-cache/", "/code cache/", "/cocos2d-x-", "/gpucache/", "/jssdk/",
    "/pip/cache/", "/software/wps office/", "/visual studio packages/", "/software/dingding/", "/software/dingtalk/", "/software/feishu/", "/software/lark/", "/web_content/", "/webcontent/",
)
TEXT_TYPES = (
    "astro", "css", "ejs", "elm", "graphql", "gql", "htm", "html", "js", "jsx", "less", "mdx", "pug", "sass", "scss", "svelte", "ts", "tsx", "vue", "c", "cc", "cpp", "cxx", "h", "hpp", "hxx", "cs", "fs", "fsx", "go", "java", "kt", "kts", "nim", "rs",
    "swift", "zig", "bash", "dart", "ex", "exs", "jl", "lua", "php", "ps1", "py", "r", "rb", "sh", "clj", "cljs", "scala", "cfg", "conf", "csv", "env", "ini", "json", "md", "proto", "sol", "sql", "tf", "toml", "txt", "xml", "yaml", "yml", "prisma",
)
RICH_TYPES = ("docx", "pdf", "pptx", "rtf", "xlsx")
MAX_BYTES, FOREGROUND_BYTES, BACKFILL_BYTES = 100 << 20, 64 << 10, 1 << 20


def _any(tests: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, tests)


def noisy(path: Column) -> Column:
    p = F.concat(text.normal_path(path), F.lit("/"))
    return _any([p.contains(f) for f in NOISY_FRAGMENTS])


def skipped_directory(path: Column) -> Column:
    """A directory the walk doesn't enter, judged by its own name and its whole path."""
    name = F.lower(text.base_name(path))
    root = F.regexp_extract(text.normal_path(path), "^[a-z]:/([^/]*)$", 1)
    return name.startswith(".") | name.startswith("skin_") | name.isin(*SKIPPED_DIRECTORIES) | noisy(path) | root.isin(*SYSTEM_ROOTS)


def below_skipped(path: Column) -> Column:
    """Whether any directory above the path is one the walk doesn't enter."""
    parts = F.split(text.normal_path(path), "/")
    parents = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    by_name = F.exists(parents, lambda d: d.startswith(".") | d.startswith("skin_") | d.isin(*SKIPPED_DIRECTORIES))
    return by_name | noisy(path) | text.normal_path(path).rlike("^[a-z]:/(" + "|".join(r.replace("(", r"\(").replace(")", r"\)") for r in SYSTEM_ROOTS) + ")/")


def skipped_file(path: Column) -> Column:
    name = F.lower(text.base_name(path))
    return (F.trim(name) == "") | name.startswith(".") | name.startswith("~$") | name.isin(*SKIPPED_FILES) | _any([name.endswith(s) for s in SKIPPED_SUFFIXES])


def text_type(path: Column) -> Column:
    return text.extension(path).isin(*TEXT_TYPES)


def rich_type(path: Column) -> Column:
    return text.extension(path).isin(*RICH_TYPES)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What stands in each directory; links are left out, unreadable directories are empty."""
    import os

    for pdf in batches:
        rows = []
        for d in pdf["path"]:
            try:
                with os.scandir(d) as found:
                    for e in found:
                        if e.is_symlink():
                            continue
                        s = e.stat(follow_symlinks=False)
                        folder = e.is_dir(follow_symlinks=False)
                        rows.append((e.path, None if folder else s.st_size, s.st_mtime_ns, folder))
            except OSError:
                continue
        yield pd.DataFrame(rows, columns=["path", "size", "mod_time_ns", "is_dir"]).astype({"size": "Int64", "mod_time_ns": "Int64", "is_dir": bool})


def list_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, prune: bool = False) -> DataFrame:
    """Candidates below `root` (or `root` itself, if it is a file): path, size, mod_time_ns, is_dir.

    Level by level: the directories of a level are listed by all tasks at once. With `prune`, directories that a walk leaves out aren't entered.
    The folder must be one that every executor sees.
    """
    import os

    base = root.removeprefix("file://").rstrip("/") or "/"
    if not os.path.isdir(base):
        rows = []
        if os.path.isfile(base) and not os.path.islink(base):
            s = os.stat(base)
            rows = [(base, s.st_size, s.st_mtime_ns, False)]
        return spark.createDataFrame(rows, CANDIDATE).where(F.col("size") <= max_bytes)
    return list_below(spark, spark.createDataFrame([(base,)], "path string"), max_bytes, base if prune else None)


def list_below(spark: SparkSession, level: DataFrame, max_bytes: int = MAX_BYTES, base: str | None = "") -> DataFrame:
    """Candidates below the folders of `level` (path). Of what is below `base`, whatever a walk leaves out is pruned; None prunes nothing."""
    out = spark.createDataFrame([], CANDIDATE)
    while True:
        spread = level.repartition(F.xxhash64("path"))
        found = settle(spread.mapInPandas(_entries, CANDIDATE))
        if base is not None:
            found = admitted_below(found, base, max_bytes) if base else admitted_names(found.where(F.col("is_dir") | (F.col("size") <= max_bytes)))
        out = out.unionByName(found.where(F.col("is_dir") | (F.col("size") <= max_bytes)))
        level = found.where("is_dir").select("path")
        if level.isEmpty():
            return out


def admitted_names(candidates: DataFrame) -> DataFrame:
    """Candidates whose own names a walk would not leave out; what is above them isn't judged."""
    name = F.concat(F.lit("/"), text.base_name(F.col("path")))
    return candidates.where(F.when(F.col("is_dir"), ~skipped_directory(name)).otherwise(~skipped_file(name)) & ~noisy(F.col("path")))


def exists(path: str) -> bool:
    import os

    return os.path.lexists(path.removeprefix("file://"))


def default_roots(home: str) -> list[str]:
    """The folders of a home that are indexed if none are named, those that are there."""
    import os

    return [p for n in ("Desktop", "Documents", "Downloads") if os.path.isdir(p := os.path.join(home, n))]


def looked_at(paths: DataFrame) -> DataFrame:
    """`paths` (path, ...) with size, mod_time_ns and is_dir as they are now; null where nothing is there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import stat

        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                try:
                    s = os.lstat(p)
                    folder = stat.S_ISDIR(s.st_mode)
                    rows.append((None, None, None) if stat.S_ISLNK(s.st_mode) else (None if folder else s.st_size, s.st_mtime_ns, folder))
                except OSError:
                    rows.append((None, None, None))
            now = pd.DataFrame(rows, columns=["size", "mod_time_ns", "is_dir"], index=pdf.index).astype({"size": "Int64", "mod_time_ns": "Int64", "is_dir": "boolean"})
            yield pd.concat([pdf, now], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema)
    return paths.repartition(F.xxhash64("path")).mapInPandas(run, f"{kinds}, size bigint, mod_time_ns bigint, is_dir boolean")


def admitted(candidates: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Candidates that a walk would visit."""
    own = F.when(F.col("is_dir"), ~skipped_directory(F.col("path"))).otherwise(~skipped_file(F.col("path")) & (F.coalesce("size", F.lit(0)) <= max_bytes))
    return candidates.where(own & ~below_skipped(F.col("path")))


def admitted_below(candidates: DataFrame, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """As `admitted`, for a root given by hand: neither it nor what is above it is judged."""
    base = root.removeprefix("file://").rstrip("/")
    inner = F.when(F.col("path").startswith(base + "/"), F.expr(f"substring(path, {len(base) + 1})")).otherwise(F.concat(F.lit("/"), text.base_name(F.col("path"))))
    return admitted(candidates.withColumn("__whole", F.col("path")).withColumn("path", inner), max_bytes).drop("path").withColumnRenamed("__whole", "path").select(*candidates.columns)


def read_texts(spark: SparkSession, root: str, max_bytes: int = FOREGROUND_BYTES, extractor: Callable[[str, bytes], str | None] | None = None) -> DataFrame:
    """(path, size, mod_time_ns, content) of text files within `max_bytes`; invalid bytes are left out. `extractor` turns rich files into text."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    df = df.withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))
    wanted = text_type(F.col("path")) | (rich_type(F.col("path")) if extractor else F.lit(False))
    df = df.where(wanted & (F.col("length") > 0) & (F.col("length") <= max_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, data in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                rich = path.rsplit(".", 1)[-1].lower() in RICH_TYPES
                out.append(extractor(path, data) if rich and extractor else data.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.string())], names=["path", "size", "mod_time_ns", "content"])

    ns = F.unix_micros("modificationTime") * 1000
    return df.select("path", F.col("length").alias("size"), ns.alias("mod_time_ns"), "content").mapInArrow(run, "path string, size bigint, mod_time_ns bigint, content string")


def read_listed(paths: DataFrame, extractor: Callable[[str, bytes], str | None] | None = None) -> DataFrame:
    """(path, size, mod_time_ns, content) of the listed files (path, size, mod_time_ns), read where their rows are; a file that can't be read or extracted is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, path in enumerate(b.column(0).to_pylist()):  # one file at a time is held
                try:
                    with open(path, "rb") as f:
                        data = f.read()
                    rich = path.rsplit(".", 1)[-1].lower() in RICH_TYPES
                    content = extractor(path, data) if rich and extractor else data.decode("utf-8", "ignore")
                except Exception:
                    continue
                if content is not None:
                    row = b.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.string())], names=["path", "size", "mod_time_ns", "content"])

    spread = paths.select("path", "size", "mod_time_ns").repartition(F.xxhash64("path"))
    return spread.mapInArrow(run, "path string, size bigint, mod_time_ns bigint, content string")


def file_items(texts: DataFrame) -> DataFrame:
    """Items of files: path as identity, base name as title, unix seconds as times."""
    name = text.base_name(F.col("path"))
    kind = F.when(text.extension(F.col("path")) == "", F.lit("file")).otherwise(text.extension(F.col("path")))
    seconds = F.floor(F.col("mod_time_ns") / 1_000_000_000).cast("bigint")
    return texts.select(
        keys.file_item_id(F.col("path")).alias("id"), F.lit("file").alias("source"), name.alias("title"), "content", text.preview(text.clean(F.col("content"))).alias("preview"), "path", kind.alias("file_type"),
        F.to_json(F.struct(F.col("path"), F.col("size"), F.lit("file").alias("entry_type"))).alias("metadata_json"), seconds.alias("created_at"), seconds.alias("updated_at"),
    )


def named_items(candidates: DataFrame) -> DataFrame:
    """Items of folders and of files whose content isn't read: found by their names."""
    name = text.base_name(F.col("path"))
    ext = text.extension(F.col("path"))
    kind = F.when(F.col("is_dir"), F.lit("folder")).when(ext == "", F.lit("file")).otherwise(ext)
    seconds = F.coalesce(F.floor(F.col("mod_time_ns") / 1_000_000_000).cast("bigint"), F.lit(0))
    content = text.path_only_content(name, F.col("path"))
    return candidates.select(
        keys.file_item_id(F.col("path")).alias("id"), F.lit("file").alias("source"), name.alias("title"), content.alias("content"), F.col("path").alias("preview"), "path", kind.alias("file_type"),
        F.to_json(F.struct(F.col("path"), F.col("size"), F.when(F.col("is_dir"), "folder").otherwise("file").alias("entry_type"))).alias("metadata_json"), seconds.alias("created_at"), seconds.alias("updated_at"),
    )
