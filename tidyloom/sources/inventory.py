"""Which files exist under the catalog's entries, and which expected ones do not.

Files are listed by tasks in rounds: a round lists the folders that the one before it found, dealt out anew, until there are none
left, so a large subtree spreads as it unfolds.  On a file system that gives names without sizes, the names of a large folder are
dealt out as well, and tasks ask for their sizes.  File contents are never read.  Existence is decided by exact paths, not by prefixes; a path that does not
exist as it is may be a glob.
"""

from __future__ import annotations

import fnmatch
import functools
import itertools
import os
import re
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import find_entry, join_path, merge_options
from ..workspace import written
from .files import open_filesystem

INVENTORY = {
    "entry": "string",
    "path": "string",
    "name": "string",
    "length": "bigint",
    "modified": "timestamp",
}


def file_inventory(
    spark: SparkSession, catalog: Mapping[str, Mapping], entries: Iterable[str] | None = None
) -> DataFrame:
    """One row per file: ``entry, path, name, length, modified``; empty and hidden files count.

    ``name`` is the path below the entry's path, and empty where the entry is a file itself.  An entry
    whose path does not exist has no rows.  The folders are listed at the call, a written table a level; a folder that goes
    in between has no files.
    """
    names = list(catalog if entries is None else entries)
    roots = [(name, find_entry(catalog, name)["file_path"]) for name in names]
    known = spark.createDataFrame(roots, "entry string, root string")
    found = written(_dealt(known, len(roots), "entry").mapInPandas(_first_level, _FOUND), "inventory")
    levels, unsized = [found], 0
    while True:
        folders, more = found.agg(F.count("folder"), F.count_if(F.expr("folder IS NULL AND length IS NULL"))).head()
        unsized += more
        if not folders:
            break
        below = _dealt(found.filter("folder IS NOT NULL"), folders, "entry", "folder")
        found = written(below.mapInPandas(_next_level, _FOUND), "inventory")
        levels.append(found)
    files = functools.reduce(DataFrame.unionAll, levels).filter("folder IS NULL").select(*INVENTORY, "root")
    if unsized:
        asked = _dealt(files.filter("length IS NULL"), unsized, "path")
        files = files.filter("length IS NOT NULL").unionAll(asked.mapInPandas(_with_sizes, files.schema))
    return files.select(*INVENTORY)


_MOST_TASKS = 1000
_FRAME_ROWS = 10_000
_COLUMNS = ["entry", "root", "folder", "path", "name", "length", "modified"]
_FOUND = "entry string, root string, folder string, path string, name string, length bigint, modified timestamp"


def _dealt(rows: DataFrame, amount: int, *keys: str) -> DataFrame:
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(amount, max(cores, amount // 16), _MOST_TASKS)), *keys)


def _file_row(entry: str, root: str, info: pafs.FileInfo, name: str) -> tuple:
    return entry, root, None, info.path, name, info.size, info.mtime


def _frame(rows: list[tuple], columns: list[str] = _COLUMNS) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    frame["modified"] = pd.to_datetime(frame["modified"], utc=True)
    frame["length"] = frame["length"].astype("Int64")
    return frame


def _frames(rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
    """Frames of a bounded size, so that a folder of any size passes through its task piece by piece."""
    rows = iter(rows)
    while some := list(itertools.islice(rows, _FRAME_ROWS)):
        yield _frame(some)


def _first_level(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files at and right below each root, and a row with ``folder`` for each folder there."""
    for frame in frames:
        for entry, root in zip(frame["entry"], frame["root"]):
            fs, inner = open_filesystem(root)
            inner = inner.rstrip("/") or "/"
            info = fs.get_file_info(inner)
            if info.type == pafs.FileType.File:
                yield _frame([_file_row(entry, root, info, "")])
            elif info.type == pafs.FileType.Directory:
                yield from _frames(_level(fs, entry, root, inner, ""))
            elif re.search(r"[*?\[]", inner):
                yield from _frames(_matches(fs, entry, root, inner))


def _next_level(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for entry, root, folder, name in zip(frame["entry"], frame["root"], frame["folder"], frame["name"]):
            fs, _ = open_filesystem(root)
            yield from _frames(_level(fs, entry, root, folder, f"{name}/"))


def _level(fs: pafs.FileSystem, entry: str, root: str, folder: str, name: str) -> Iterator[tuple]:
    """What lies right in a folder: files, on a local disk without their sizes, and folders; ``name`` leads to the folder."""
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            with os.scandir(folder) as inside:
                for item in inside:
                    kind = item.path if item.is_dir() else None
                    yield entry, root, kind, None if kind else item.path, name + item.name, None, None
        except FileNotFoundError:
            return
        return
    for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=False)):
        if info.type == pafs.FileType.Directory:
            yield entry, root, info.path, None, name + info.base_name, None, None
        else:
            yield _file_row(entry, root, info, name + info.base_name)


def _with_sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for root, some in frame.groupby("root", sort=False):
            fs, _ = open_filesystem(root)
            for info, entry, name in zip(fs.get_file_info(list(some["path"])), some["entry"], some["name"]):
                if info.type != pafs.FileType.NotFound:
                    rows.append((entry, info.path, name, info.size, info.mtime, root))
        yield _frame(rows, [*INVENTORY, "root"])


def _matches(fs: pafs.FileSystem, entry: str, root: str, pattern: str) -> Iterator[tuple]:
    """What a glob stands for, segment by segment: files, and the first level of folders."""
    steps = pattern.strip("/").split("/")
    places = ["/" if pattern.startswith("/") else ""]
    for step in steps:
        found = []
        for place in places:
            if not re.search(r"[*?\[]", step):
                found.append(f"{place.rstrip('/')}/{step}" if place else step)
                continue
            if fs.get_file_info(place).type != pafs.FileType.Directory:
                continue
            inside = fs.get_file_info(pafs.FileSelector(place, recursive=False))
            found += [info.path for info in inside if fnmatch.fnmatchcase(info.base_name, step)]
        places = found
    for info in fs.get_file_info(places):
        if info.type == pafs.FileType.File:
            yield _file_row(entry, root, info, "")
        elif info.type == pafs.FileType.Directory:
            yield from _level(fs, entry, root, info.path, "")


def missing_inputs(required: DataFrame, inventory: DataFrame) -> DataFrame:
    """The rows of ``required (entry, filename)`` that name neither a file nor a folder with files.

    A null or empty file name stands for the entry itself.  Both sides meet on the full name, so no
    task gets an entry as a whole, however many files it has.
    """
    parts = F.split("name", "/")
    # A file proves itself and every folder above it, up to the entry: "a/b/c" -> "", "a", "a/b".
    proofs = F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    found = inventory.select("entry", F.explode(proofs).alias("found")).distinct()
    wanted = F.coalesce(F.regexp_replace("filename", "^/+|/+$", ""), F.lit(""))
    same = (required["entry"] == found["entry"]) & (wanted == found["found"])
    return required.join(found, same, "left_anti")


def entry_summary(
    spark: SparkSession, catalog: Mapping[str, Mapping], entries: Iterable[str] | None = None
) -> DataFrame:
    """Per entry: ``exists``, ``needs_filename`` (null if missing), ``files`` and ``bytes``.

    An entry needs a file name unless its path is a single file.
    """
    names = list(catalog if entries is None else entries)
    known = spark.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, names))).alias("entry"))
    counts = (
        file_inventory(spark, catalog, names)
        .groupBy("entry")
        .agg(
            F.bool_or(F.col("name") != "").alias("needs_filename"),
            F.count("*").alias("files"),
            F.sum("length").alias("bytes"),
        )
    )
    return known.join(counts, "entry", "left").select(
        "entry",
        F.col("files").isNotNull().alias("exists"),
        "needs_filename",
        F.coalesce("files", F.lit(0)).alias("files"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
    )


def is_exists(
    spark: SparkSession,
    catalog: Mapping[str, Mapping] | None = None,
    catalog_entry: str | None = None,
    data_url: str | None = None,
    **options,
) -> bool:
    """Whether ``data_url``, or else an entry or ``suffix`` under it, is a file or a folder.

    One status call; nothing is listed, and the path is taken as it is.
    """
    if data_url is None:
        entry = find_entry(catalog, catalog_entry)
        options = merge_options(entry, "load", options)
        data_url = join_path(entry["file_path"].rstrip("/"), options.get("suffix"))
    return _is_folder(data_url) is not None


def is_require_filename(
    spark: SparkSession,
    catalog: Mapping[str, Mapping] | None = None,
    catalog_entry: str | None = None,
    data_url: str | None = None,
) -> bool:
    """False if the path is a file, True if it is a folder; a missing path is an error."""
    root = find_entry(catalog, catalog_entry)["file_path"] if data_url is None else data_url
    folder = _is_folder(root)
    if folder is None:
        raise FileNotFoundError(f"nothing at {root}")
    return folder


def _is_folder(path: str) -> bool | None:
    """Null where there is nothing."""
    fs, inner = open_filesystem(path)
    kind = fs.get_file_info(inner.rstrip("/") or "/").type
    return None if kind == pafs.FileType.NotFound else kind == pafs.FileType.Directory
