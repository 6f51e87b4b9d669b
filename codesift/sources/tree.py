"""A directory tree as a partitioned data source, with a row for whatever cannot
be read.

Spark's own file sources pass over names that begin with ``.`` or ``_`` (in a
source tree these are ``.env``, ``__init__.py`` and the like) and fail on a folder
they may not list.  This one gives every file, and for each path that cannot be
listed or read, or is over the size cap, a row with its ``error``.

The driver expands the upper folders until there are ``width`` of them; each is a
partition that its task lists to the bottom and reads, in batches of bounded
size.  A folder of very many files is dealt to several tasks by name.  Folders
that are links are not followed, so a walk ends.
"""

from __future__ import annotations

import fnmatch
import os
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The reader travels with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREE = "path string, length bigint, content binary, error string"
_ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
# Folders the driver looks for, files of one folder a task reads, bytes and rows of a batch.
WIDTH = 256
FILES_PER_TASK = 5000
BATCH_BYTES = 16 << 20
BATCH_ROWS = 5000


def filesystem(uri: str):
    """File system and path of a qualified address; what Arrow does not know by
    itself is asked of Hadoop's client library."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    try:
        return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    except pa.ArrowInvalid:
        scheme, _, rest = uri.partition("://")
        host, _, path = rest.partition("/")
        return pafs.HadoopFileSystem(f"{scheme}://{host}"), "/" + path


def qualified(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toString()


def _why(error: Exception) -> str:
    return type(error).__name__


def listed(uri: str) -> tuple[list[str], list[tuple[str, int | None]], str | None]:
    """Folders and files (address and size) of a folder, or why it cannot be
    listed; a file without a size cannot be looked at."""
    folders, files = [], []
    try:
        fs, where = filesystem(uri)
        if uri.startswith("file:"):
            entries = [(e.name, *_local(e)) for e in os.scandir(where)]
        else:
            found = fs.get_file_info(pafs.FileSelector(where, recursive=False))
            entries = [(e.base_name, e.type == pafs.FileType.Directory, e.size if e.type == pafs.FileType.File else None) for e in found]
    except (OSError, pa.ArrowException) as e:
        return [], [], _why(e)
    for name, is_folder, size in sorted((e for e in entries if e[1] is not None), key=lambda e: e[0]):
        address = f"{uri.rstrip('/')}/{name}"
        if is_folder:
            folders.append(address)
        else:
            files.append((address, size))
    return folders, files, None


def _local(entry: os.DirEntry) -> tuple[bool | None, int | None]:
    """Whether an entry is a folder (None for a link to one) and its size; a
    link that leads nowhere is a file without a size."""
    if entry.is_symlink() and os.path.isdir(entry.path):
        return None, None
    if entry.is_dir(follow_symlinks=False):
        return True, None
    try:
        return False, entry.stat().st_size
    except OSError:
        return False, None


@dataclass
class Share(InputPartition):
    """A folder with all below it (``deep``), or one of ``ways`` shares of the
    files right in it."""

    uri: str
    deep: bool
    share: int = 0
    ways: int = 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.glob = options.get("glob")
        self.most = int(options["max_bytes"]) if options.get("max_bytes") else None
        self.width = int(options.get("width", WIDTH))
        self.files_per_task = int(options.get("files_per_task", FILES_PER_TASK))

    def partitions(self) -> list[InputPartition]:
        level, out = [self.root], []
        while level and len(level) < self.width:
            below = []
            for uri in level:
                folders, files, error = listed(uri)
                below += folders
                ways = -(-len(files) // self.files_per_task)
                out += [Share(uri, False, i, ways) for i in range(max(ways, 1 if error else 0))]
            level = below
        return out + [Share(uri, True) for uri in level]

    def _entries(self, part: Share) -> Iterator[tuple[str, int | None, str | None]]:
        todo = [part.uri]
        while todo:
            uri = todo.pop()
            folders, files, error = listed(uri)
            if error:
                yield uri, None, error
            for address, size in files:
                name = address.rsplit("/", 1)[1]
                if self.glob and not fnmatch.fnmatchcase(name, self.glob):
                    continue
                if part.ways == 1 or zlib.crc32(name.encode("utf-8", "surrogateescape")) % part.ways == part.share:
                    yield address, size, None
            if part.deep:
                todo += folders

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for address, size, error in self._entries(partition):
            content = None
            if error is None and self.most is not None and size is not None and size > self.most:
                error = "too large"
            elif error is None:
                try:
                    fs, where = filesystem(address)
                    with fs.open_input_stream(where) as f:
                        content = f.read()
                    size = len(content)
                except (OSError, pa.ArrowException) as e:
                    error = _why(e)
            # Names that are not UTF-8 are shown with U+FFFD.
            shown = address.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
            rows.append({"path": shown, "length": size, "content": content, "error": error})
            held += len(content or b"")
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class CorpusTree(DataSource):
    """``spark.read.format("corpus_tree")`` with options ``path`` (qualified),
    ``max_bytes``, ``glob``, ``width`` and ``files_per_task``."""

    @classmethod
    def name(cls) -> str:
        return "corpus_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_tree(spark: SparkSession, path: str, max_bytes: int | None = None, glob: str | None = None, **options) -> DataFrame:
    """``path, length, content, error`` of everything below ``path``."""
    spark.dataSource.register(CorpusTree)
    reader = spark.read.format("corpus_tree")
    chosen = {"path": qualified(spark, path), "max_bytes": max_bytes, "glob": glob, **options}
    for name, value in chosen.items():
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load()


_WRITTEN = "path string, length bigint"


def write_tree(files: DataFrame, folder: str) -> DataFrame:
    """Lay ``files(path, text)`` down below ``folder``, each as a file of its own,
    written by the tasks; gives ``path, length`` of each and writes when read."""
    root = qualified(files.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = filesystem(root)
        made = set()
        for batch in batches:
            lengths = []
            for path, text in zip(batch.column("path"), batch.column("text")):
                target, data = f"{where}/{path.as_py()}", (text.as_py() or "").encode()
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                with fs.open_output_stream(target) as f:
                    f.write(data)
                lengths.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(lengths, pa.int64())], ["path", "length"])

    return files.select("path", "text").mapInArrow(write, _WRITTEN)
