"""ZIP archives as a data source: entries are read by byte range, one archive by many tasks.

    spark.dataSource.register(ZippedSource)
    spark.read.format("zipped").load("file:///incoming")

Planning deals archives to tasks by size, about ``bytesPerPartition`` compressed bytes each, or more where that would make
over ``maxPartitions`` tasks.  Only of an archive larger than that it reads the directory at the end, to cut its entries into
runs; a task opens its archives, reads their directories and then the ranges of its entries only, so an archive may be larger
than any row or memory, and many small archives cost few tasks.  Rows are those of ``files.unzip``: safe names, told apart; what is unsafe, unsupported or over a
guard (``maxEntries``, ``maxEntry``, ``maxTotal``) has a reason and no content, and a file that is no archive is one such row.  With
``head`` an entry's content is its first so many bytes, and no more than these are unpacked.

Paths are a file or a folder (searched for ``.zip``), as a URI of any file system that Arrow opens, or a local path.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioforge.sources import files

SCHEMA = "archive string, entry string, size long, content binary, skipped string"


#: Tasks of a read, unless ``maxPartitions`` says otherwise.
MOST_TASKS = 512


@dataclass
class Run:
    """Entries ``first`` to before ``last`` of an archive; without ``last``, to its end."""

    archive: str
    first: int = 0
    last: int | None = None


@dataclass
class Runs(InputPartition):
    """What one task reads."""

    runs: list[Run]

    def __init__(self, runs: list[Run]):
        super().__init__(len(runs))
        self.runs = runs


def _opened(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    if "://" in path or path.startswith("file:"):
        return FileSystem.from_uri(path)
    return LocalFileSystem(), path


def archives_below(path: str) -> list[tuple[str, int]]:
    """Paths, within their file system, of the archives, and their bytes."""
    from pyarrow.fs import FileSelector, FileType

    fs, at = _opened(path)
    info = fs.get_file_info(at)
    if info.type == FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == FileType.File:
        return [(at, info.size)]
    found = fs.get_file_info(FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == FileType.File and f.path.lower().endswith(".zip"))


def _read(f) -> zipfile.ZipFile:
    if f.size() < 22:  # shorter than the shortest directory
        raise zipfile.BadZipFile("too short")
    # Of so short a file zipfile seeks before the start, which Arrow's files refuse in a way of their own.
    return zipfile.ZipFile(f if f.size() > 64 else io.BytesIO(f.read()))


class ZippedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        number = lambda key, other: int(options.get(key, other))
        self.path = options["path"]
        self.per = number("bytesPerPartition", 64 << 20)
        self.most = max(1, number("maxPartitions", MOST_TASKS))
        self.head = number("head", -1)
        self.guards = number("maxEntries", files.MAX_ENTRIES), number("maxEntry", files.MAX_ENTRY), number("maxTotal", files.MAX_TOTAL)

    def partitions(self) -> list[Runs]:
        fs, _ = _opened(self.path)
        archives = archives_below(self.path)
        per = max(self.per, -(-sum(size for _, size in archives) // self.most))
        tasks, now, full = [], [], 0
        for archive, size in archives:
            for run, held in [(Run(archive), size)] if size <= per else self._cut(fs, archive, per):
                if now and full + held > per:
                    tasks.append(Runs(now))
                    now, full = [], 0
                now.append(run)
                full += held
        return [*tasks, Runs(now)]

    def _cut(self, fs, archive: str, per: int) -> list[tuple[Run, int]]:
        """Runs of an archive's entries with their compressed bytes."""
        runs, first, size, at = [], 0, 0, 0
        try:
            with fs.open_input_file(archive) as f, _read(f) as z:
                for at, (info, _, reason) in enumerate(files.entries_of(z.infolist(), *self.guards), 1):
                    size += info.compress_size if reason is None else 0
                    if size >= per:
                        runs.append((Run(archive, first, at), size))
                        first, size = at, 0
        except zipfile.BadZipFile:
            return [(Run(archive), 0)]
        return [*runs, (Run(archive, first, at), size)] if at > first else runs

    def read(self, task: Runs) -> Iterator[tuple]:
        for run in task.runs:
            yield from self._entries(run)

    def _entries(self, run: Run) -> Iterator[tuple]:
        fs, _ = _opened(self.path)
        name = run.archive.rpartition("/")[2]
        with fs.open_input_file(run.archive) as f:
            try:
                z = _read(f)
            except zipfile.BadZipFile:
                yield name, "", 0, None, "not an archive"
                return
            for at, (info, entry, reason) in enumerate(files.entries_of(z.infolist(), *self.guards)):
                if run.last is not None and at >= run.last:
                    break
                if at < run.first:
                    continue
                content = None
                if reason is None:
                    try:
                        with z.open(info) as e:
                            content = e.read(self.head) if self.head >= 0 else e.read()
                    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError) as e:
                        reason = f"{type(e).__name__}: {e}"  # damaged, enciphered or packed in a way that is not known
                yield name, entry, info.file_size, content, reason


class ZippedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipped"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZippedReader:
        return ZippedReader(self.options)
