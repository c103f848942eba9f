"""Feather (Arrow IPC) files as a Spark data source, for reading and writing.

Reading: a large file is cut by record batches, only the declared columns are read, and conditions of the option ``where``
are applied before rows leave the task.  Writing: tasks write files of the table's folder under names of their own, and a manifest names
those that count.  It is replaced in one step when all tasks are done, so nothing is moved and readers see the
old files or the new ones.  With partition columns, each task's files lie in folders of their values.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.feather as pafeather
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from .files import PACK_BYTES, Condition, FilesSource, Piece, list_files, open_filesystem, place_of, selected, spark_schema

_IPC_MAGIC = b"ARROW1"
_PARALLEL_REQUESTS = 32


class FeatherSource(FilesSource):
    """``spark.read.format("feather")``; option ``compression`` (lz4, zstd, uncompressed) on write."""

    @classmethod
    def name(cls) -> str:
        return "feather"

    def file_schema(self, fs: pafs.FileSystem, path: str) -> pa.Schema:
        with fs.open_input_file(path) as stream:
            if _is_ipc(stream):
                return pa.ipc.open_file(stream).schema
            return pafeather.read_table(stream).schema

    def schema(self) -> T.StructType:
        """Of the first file; columns of partition folders follow, as the manifest has them."""
        fs, root = open_filesystem(self.path)
        manifest = read_manifest(fs, root)
        if manifest is None:
            return super().schema()
        self.inferred = True
        fields = list(spark_schema(self.file_schema(fs, manifest.paths(root)[0][0])))
        return T.StructType([*fields, *manifest.fields()])

    def listed(self, conditions: list[Condition]) -> list[tuple]:
        fs, root = open_filesystem(self.path)
        manifest = read_manifest(fs, root)
        if manifest is None:
            return super().listed(conditions)
        files = manifest.paths(root)
        if manifest.partitions:
            values = {name: _typed([file[2].get(name) for file in files], kind) for name, kind in manifest.partitions}
            numbered = pa.RecordBatch.from_pydict({**values, "": pa.array(range(len(files)), pa.int64())})
            files = [files[i] for i in selected(numbered, conditions).column("").to_pylist()]
        types = dict(manifest.partitions)
        return [(path, size, {name: (value, types[name]) for name, value in values.items()}) for path, size, values in files]

    def pieces(self, files: list[tuple]) -> Iterable[Piece]:
        """Parts of files as ``(k, n)``, the k-th of n, and the values of the partition columns.

        Nothing is opened here: the task that gets a part finds its record batches in the file's footer.
        """
        for path, size, *values in files:
            parts = max(1, -(-size // PACK_BYTES))
            for part in range(parts):
                yield path, (part, parts, *values), size // parts

    def batches(self, fs, path, part, columns) -> Iterator[pa.RecordBatch]:
        values = part[2] if part and len(part) > 2 else {}
        for batch in self.file_batches(fs, path, part, columns):
            for name, (value, kind) in values.items():
                if name in columns:
                    batch = batch.append_column(name, _typed([value] * batch.num_rows, kind))
            yield batch

    def file_batches(self, fs, path, part, columns) -> Iterator[pa.RecordBatch]:
        with fs.open_input_file(path) as stream:
            if not _is_ipc(stream):
                # The first feather version has no batches: such a file is read in one go, by its first part.
                if not part or part[0] == 0:
                    table = pafeather.read_table(stream)
                    self.refuse_unknown(table.schema.names, path)
                    yield from table.to_batches()
                return
            names = pa.ipc.open_file(stream).schema.names
            self.refuse_unknown(names, path)
            wanted = sorted({place for column in columns if (place := place_of(column, names)) is not None})
            # No wanted column (a count, say) still needs one for the number of rows.
            options = pa.ipc.IpcReadOptions(included_fields=wanted or [0])
            reader = pa.ipc.open_file(stream, options=options)
            k, n = part[:2] if part else (0, 1)
            total = reader.num_record_batches
            for index in range(total * k // n, total * (k + 1) // n):
                yield reader.get_batch(index)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        names = json.loads(self.options.get("partitionColumns", "[]"))
        dynamic = str(self.options.get("partitionOverwriteMode")).lower() == "dynamic"
        return FeatherWriter(self.path, schema, overwrite, self.options.get("compression", "lz4"), names, dynamic)


def _is_ipc(stream: pa.NativeFile) -> bool:
    stream.seek(0)
    magic = stream.read(len(_IPC_MAGIC))
    stream.seek(0)
    return magic == _IPC_MAGIC


MANIFEST = "_manifest.json"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: Types whose text form gives the value back, so that it may name a folder.
FOLDER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BooleanType, T.DateType, T.DecimalType)


@dataclass
class Manifest:
    """``partitions``: names and types of the partition columns; ``files``: path below the folder, bytes, values as text."""

    partitions: list[tuple[str, str]]
    files: list[tuple[str, int, dict]]

    def fields(self) -> list[T.StructField]:
        return [T.StructField(name, folder_type(kind)) for name, kind in self.partitions]

    def paths(self, root: str) -> list[tuple[str, int, dict]]:
        return [(f"{root.rstrip('/')}/{path}", size, values) for path, size, values in self.files]


def read_manifest(fs: pafs.FileSystem, root: str) -> Manifest | None:
    """What counts in a folder that was written by this source; None for other paths."""
    path = f"{root.rstrip('/')}/{MANIFEST}"
    if re.search(r"[*?\[]", root) and fs.get_file_info(root).type == pafs.FileType.NotFound:
        return None
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(path) as stream:
        lines = stream.read().decode().splitlines()
    return Manifest([tuple(x) for x in json.loads(lines[0])], [tuple(json.loads(line)) for line in lines[1:]])


def _write_manifest(fs: pafs.FileSystem, root: str, job: str, manifest: Manifest) -> None:
    lines = [json.dumps(manifest.partitions), *(json.dumps(file) for file in manifest.files)]
    fresh = f"{root.rstrip('/')}/_manifest-{job}"
    with fs.open_output_stream(fresh) as stream:
        stream.write("\n".join(lines).encode())
    fs.move(fresh, f"{root.rstrip('/')}/{MANIFEST}")


def _typed(texts: list[str | None], kind: str) -> pa.Array:
    dtype = to_arrow_schema(T.StructType([T.StructField("x", folder_type(kind))])).field("x").type
    return pa.array(texts, pa.string()).cast(dtype)


def folder_type(kind: str) -> T.DataType:
    """The type of a partition column; there is no session in the worker that could parse it."""
    if decimal := re.fullmatch(r"decimal\((\d+),(\d+)\)", kind):
        return T.DecimalType(*map(int, decimal.groups()))
    return next(one() for one in FOLDER_TYPES if one().simpleString() == kind)


class FilesWritten(WriterCommitMessage):
    """What a task reports: its files below the folder, with their bytes and partition values."""

    def __init__(self, files: list[tuple[str, int, dict]]):
        self.files = files


class FeatherWriter(DataSourceArrowWriter):
    """Tasks write where the files stay; only those that the manifest names at the end count.

    A task that is repeated, or runs twice, leaves a file that no message names; files of this job that the manifest lacks
    go away at its end.
    """

    def __init__(self, path: str, schema: T.StructType, overwrite: bool, compression: str, partitions: list[str], dynamic: bool):
        self.path = path
        self.schema = schema
        self.overwrite = overwrite
        self.compression = None if compression == "uncompressed" else compression
        kinds = {field.name: field.dataType for field in schema}
        self.partitions = [(name, kinds[name].simpleString()) for name in partitions]
        for name in partitions:
            if not isinstance(kinds[name], FOLDER_TYPES):
                raise ValueError(f"{name}: a column of type {kinds[name].simpleString()} cannot name folders")
        self.dynamic = dynamic
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> FilesWritten:
        fs, root = open_filesystem(self.path)
        part, files = TaskContext.get().partitionId(), []
        for values, batches in itertools.groupby(self._runs(iterator), key=lambda run: run[0]):
            folder = "".join(f"{name}={NO_VALUE if value is None else quote(value, safe=' ')}/" for (name, _), value in zip(self.partitions, values))
            below = f"{folder}part-{part:05d}-{self.job}-{uuid.uuid4().hex}.feather"
            target = f"{root.rstrip('/')}/{below}"
            fs.create_dir(target.rpartition("/")[0], recursive=True)
            first = next(batches)[1]
            self._write_file(fs, target, first.schema, [first], (batch for _, batch in batches))
            names = [name for name, _ in self.partitions]
            files.append((below, fs.get_file_info(target).size, dict(zip(names, values))))
        return FilesWritten(files)

    def _runs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        """Partition values as text, and stretches of rows that have them, without these columns."""
        names = [name for name, _ in self.partitions]
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [batch.column(name).cast(pa.string()) for name in names]
            turn = np.zeros(batch.num_rows, bool)
            turn[0] = True
            for text in texts:
                codes = np.asarray(text.dictionary_encode(null_encoding="encode").indices)
                turn[1:] |= codes[1:] != codes[:-1]
            edges = [*np.flatnonzero(turn).tolist(), batch.num_rows]
            rest = batch.drop_columns(names) if names else batch
            for a, b in zip(edges, edges[1:]):
                yield tuple(text[a].as_py() for text in texts), rest.slice(a, b - a)

    def _write_file(self, fs, target, schema, *runs: Iterable[pa.RecordBatch]) -> None:
        options = pa.ipc.IpcWriteOptions(compression=self.compression)
        with fs.open_output_stream(target) as stream:
            with pa.ipc.new_file(stream, schema, options=options) as out:
                for run in runs:
                    for batch in run:
                        out.write_batch(batch)

    def commit(self, messages: list[FilesWritten | None]) -> None:
        fs, root = open_filesystem(self.path)
        base = root.rstrip("/")
        fs.create_dir(base, recursive=True)
        written = [file for message in messages if message for file in message.files]
        old = self._before(fs, base)
        if old.files and not self.overwrite and old.partitions != self.partitions:
            raise ValueError(f"{self.path} has the partition columns {old.partitions}, not {self.partitions}")
        kept = [] if self.overwrite else old.files
        if self.overwrite and self.dynamic and old.partitions == self.partitions:
            changed = {tuple(sorted(values.items(), key=str)) for _, _, values in written}
            kept = [file for file in old.files if tuple(sorted(file[2].items(), key=str)) not in changed]
        if not written and not kept:
            # An empty table still has columns.
            below = f"part-00000-{self.job}-{uuid.uuid4().hex}.feather"
            names = {name for name, _ in self.partitions}
            schema = T.StructType([field for field in self.schema if field.name not in names])
            self._write_file(fs, f"{base}/{below}", to_arrow_schema(schema))
            written = [(below, fs.get_file_info(f"{base}/{below}").size, dict.fromkeys(names))]
        _write_manifest(fs, root, self.job, Manifest(self.partitions, [*kept, *written]))
        counted = {path for path, _, _ in (*kept, *written)}
        self._delete(fs, [f"{base}/{path}" for path, _, _ in old.files if path not in counted])
        self._delete(fs, [path for path in self._own(fs, base) if path[len(base) + 1 :] not in counted])

    def _before(self, fs: pafs.FileSystem, base: str) -> Manifest:
        """The files that counted until now; those of a folder without a manifest are found by listing it."""
        manifest = read_manifest(fs, base)
        if manifest is not None:
            return manifest
        try:
            found = list_files(self.path)
        except FileNotFoundError:
            found = []
        # Not those of this job, which lie there already.
        files = [(path[len(base) + 1 :], size, {}) for path, size in found if f"-{self.job}-" not in path]
        return Manifest([] if files else self.partitions, files)

    def _own(self, fs: pafs.FileSystem, base: str) -> list[str]:
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=True))
        return [item.path for item in found if f"-{self.job}-" in item.base_name]

    def _delete(self, fs: pafs.FileSystem, paths: list[str]) -> None:
        with ThreadPoolExecutor(_PARALLEL_REQUESTS) as pool:
            # list() waits for all, and raises what any of them raised.
            list(pool.map(fs.delete_file, paths))

    def abort(self, messages: list[FilesWritten | None]) -> None:
        fs, root = open_filesystem(self.path)
        self._delete(fs, self._own(fs, root.rstrip("/")))
