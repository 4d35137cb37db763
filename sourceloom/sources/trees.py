"""Source trees read and written by tasks, for trees with more files than a driver can list.

**Reading.** A data source lists folders: the driver opens only the uppermost folders, until there are some thousands, and tasks list
what is below them. Excluded files are dropped by their paths, the rest are dealt over all tasks and opened there. Packed archives
(zip, tar) in a tree are read as folders of their members.

**Writing.** Each task stages its files under a name of its own attempt and reports that name. Only attempts whose report Spark
accepted are published: tasks rename their files to the wanted paths. Renaming again changes nothing, so a lost executor does no
harm, and readers never see a part of a file. The driver handles one name per task.

Both use folders that driver and executors reach by ``pyarrow.fs``. For stores that only Spark reads there is ``files.read_tree``.
"""

from __future__ import annotations

import io
import os
import posixpath
import sys
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import fixed_values as fv
from ..functions.globs import excluded
from ..functions.text import decode_utf8, extension, parser_language
from ..operators.placement import spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Folders that the driver opens at most to make partitions, and bytes of content in a batch.
FOLDERS, BATCH_BYTES = 4000, 8 << 20

_LISTED = "path string, rel_path string, size bigint, mtime timestamp"
_FOUND = "path string, rel_path string, size bigint, mtime timestamp, raw binary, member boolean"
_SCHEMA = "path string, rel_path string, ext string, language string, content string, size bigint, mtime timestamp"
_ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path there."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


# ----- listing ----------------------------------------------------------------------------------------------------


class _Folder(InputPartition):
    """Folders to list: ``shallow`` ones for their files, ``deep`` ones with all that is below."""

    def __init__(self, shallow: list[str], deep: list[str]):
        super().__init__(None)
        self.shallow, self.deep = shallow, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str, folders: int):
        self.root, self.folders = root, folders

    def _entries(self, store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [x for x in found if not (x.type == fs.FileType.Directory and isinstance(store, fs.LocalFileSystem) and os.path.islink(x.path))]

    def partitions(self) -> list[_Folder]:
        store, root = _filesystem(self.root)
        opened: list[str] = []
        level = [root]
        while level and len(opened) + len(level) < self.folders:
            below = [x.path for folder in level for x in self._entries(store, folder) if x.type == fs.FileType.Directory]
            opened += level
            level = below
        return [_Folder([f], []) for f in opened] + [_Folder([], [f]) for f in level] or [_Folder([], [])]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        store, root = _filesystem(self.root)
        todo = [(f, False) for f in partition.shallow] + [(f, True) for f in partition.deep]
        while todo:
            folder, deep = todo.pop()
            for x in self._entries(store, folder):
                if x.type == fs.FileType.Directory:
                    todo += [(x.path, True)] if deep else []
                elif x.type == fs.FileType.File:
                    mtime = x.mtime if x.mtime is not None else datetime.fromtimestamp(0, UTC)
                    yield x.path, posixpath.relpath(x.path, root), x.size, mtime


class FolderListing(DataSource):
    """``spark.read.format("folder_listing").option("root", ...)``: the files of a tree with size and time, listed by tasks."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return _LISTED

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["root"], int(self.options.get("folders", FOLDERS)))


def list_tree(spark: SparkSession, root: str, folders: int = FOLDERS) -> DataFrame:
    """(path, rel_path, size, mtime) of all files below a folder; links to folders are not followed; a missing folder is empty."""
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").option("root", root).option("folders", folders).load()


# ----- contents ---------------------------------------------------------------------------------------------------


def _members(store: fs.FileSystem, path: str) -> Iterator[tuple[str, bytes, datetime]]:
    """Files of an archive; a damaged one ends at the damage."""
    try:
        with store.open_input_file(path) as file:
            if path.lower().endswith(".zip"):
                with zipfile.ZipFile(file) as packed:
                    for item in packed.infolist():
                        if not item.is_dir():
                            yield item.filename, packed.read(item), datetime(*item.date_time, tzinfo=UTC)
            else:
                with tarfile.open(fileobj=file, mode="r:*") as packed:
                    for item in packed:
                        if item.isfile():
                            yield item.name, packed.extractfile(item).read(), datetime.fromtimestamp(item.mtime, UTC)
    except (OSError, zipfile.BadZipFile, tarfile.TarError, EOFError, RuntimeError, ValueError):
        return


def _safe(name: str) -> str:
    """A member's path below its archive."""
    return posixpath.normpath("/" + name).lstrip("/")


def scan_tree(
    spark: SparkSession, root: str, excludes: list[str] | None = None, archives: bool = True, defaults: bool = True, folders: int = FOLDERS
) -> DataFrame:
    """Files below a folder that no exclude glob matches (``defaults``: the usual ones too), as ``files.read_tree`` gives them.

    Members of archives are files too (``archives``), with the archive as their folder; the globs hold for their paths. A file that
    cannot be read has no content. Tasks keep one file, or one member, at a time.
    """
    patterns = (fv.ANALYSIS_EXCLUDES if defaults else []) + (excludes or [])
    listed = spread(list_tree(spark, root, folders).where(~excluded(F.col("rel_path"), patterns)), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(root)
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            names = ("path", "rel_path", "size", "mtime", "raw", "member")
            kinds = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary(), pa.bool_())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, names)

        for path, rel, size, mtime in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            packed = archives and rel.lower().endswith(_ARCHIVES)
            if packed:
                found = ((f"{path}/{_safe(n)}", f"{rel}/{_safe(n)}", len(raw), time, raw, True) for n, raw, time in _members(store, path))
            else:
                try:
                    with store.open_input_stream(path) as file:
                        found = [(path, rel, size, mtime, file.read(), False)]
                except OSError:
                    found = [(path, rel, size, mtime, None, False)]
            for row in found:
                rows.append(row)
                held += len(row[4] or b"")
                if held > BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        yield batch()

    rows = listed.mapInArrow(read, _FOUND)
    rel = F.col("rel_path")
    return rows.where(~F.col("member") | ~excluded(rel, patterns)).select(
        "path", "rel_path", extension(rel).alias("ext"), parser_language(rel).alias("language"), decode_utf8(F.col("raw")).alias("content"), "size", "mtime"
    )


# ----- writing ----------------------------------------------------------------------------------------------------


def write_texts(texts: DataFrame, folder: str, path: str = "out_path", content: str = "out_content", packed: bool = False) -> int:
    """Writes each text as one UTF-8 file at its path below ``folder``, and returns the number of files.

    ``packed``: the texts of a task become members of one zip archive, ``scan_tree`` reads them back as files below it. Very many
    small files cost a block of the disk each, and a driver cannot list them; the number of archives is that of tasks.

    Paths are relative and inside the folder, else the write fails, as it does for a path that comes twice; a null text is an empty
    file, rows without a path are left out. Existing files at the paths are replaced; on failure none is.
    """
    spark = texts.sparkSession
    job = f"{folder.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(job)
        attempt = uuid.uuid4().hex
        store.create_dir(f"{base}/{attempt}")
        seen: set[str] = set()
        lines = io.StringIO()
        archive = zipfile.ZipFile(store.open_output_stream(f"{base}/{attempt}/0"), "w", zipfile.ZIP_DEFLATED) if packed else None
        now = datetime.now(UTC).timetuple()[:6]
        for out, text in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            plain = posixpath.normpath(out)
            if out.startswith("/") or plain.split("/")[0] in ("..", ".") or "\n" in out or "\0" in out:
                raise ValueError(f"not a path below the folder: {out!r}")
            if plain in seen:
                raise ValueError(f"two texts for one path: {out!r}")
            if archive:
                archive.writestr(zipfile.ZipInfo(plain, now), (text or "").encode(), zipfile.ZIP_DEFLATED)
            else:
                with store.open_output_stream(f"{base}/{attempt}/{len(seen)}") as file:
                    file.write((text or "").encode())
                lines.write(plain + "\n")
            seen.add(plain)
        if archive:
            with archive.fp as file:
                archive.close()
            lines.write(f"{attempt}.zip\n")
        with store.open_output_stream(f"{base}/{attempt}/paths") as file:
            file.write(lines.getvalue().encode())
        yield pa.RecordBatch.from_arrays([pa.array([attempt]), pa.array([len(seen)])], ["attempt", "files"])

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(job)
        _, target = _filesystem(folder)
        for attempt in (a for b in batches for a in b.column(0).to_pylist()):
            with store.open_input_stream(f"{base}/{attempt}/paths") as file:
                paths = file.read().decode().split("\n")[:-1]
            for k, out in enumerate(paths):
                staged = f"{base}/{attempt}/{k}"
                if store.get_file_info(staged).type == fs.FileType.File:  # else an earlier attempt has renamed it
                    store.create_dir(posixpath.dirname(f"{target}/{out}"))
                    store.move(staged, f"{target}/{out}")
            yield pa.RecordBatch.from_arrays([pa.array([len(paths)])], ["files"])

    chosen = texts.select(F.col(path).alias("p"), F.col(content).alias("c")).where("p IS NOT NULL")
    store, base = _filesystem(job)
    try:
        # one task sees all texts of a path
        accepted = spread(chosen, "p").mapInArrow(stage, "attempt string, files bigint").collect()  # one row for each task
        attempts = spark.createDataFrame([(r.attempt,) for r in accepted if r.files], "attempt string").repartition(max(1, len(accepted)))
        attempts.mapInArrow(publish, "files bigint").agg(F.sum("files")).first()
        return sum(r.files for r in accepted)
    finally:
        if store.get_file_info(base).type == fs.FileType.Directory:
            store.delete_dir(base)
