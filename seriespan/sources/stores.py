"""Files of any store that tasks can reach: listing a folder, opening a file.

Paths are Hadoop's: ``file:/a/b`` or ``scheme://authority/a/b``. Tasks open them with Arrow's file
systems (local disks and mounts, HDFS, S3, GCS, Azure); a scheme Arrow does not know is an error of
the path, reported like any other.
"""

from __future__ import annotations

import bz2
import contextlib
import errno
import functools
import gzip
import os
import re
import stat
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What opening, listing, reading or unpacking a file may raise.
FAULTS = (OSError, EOFError, zlib.error, zstandard.ZstdError, pa.ArrowException, ValueError)
#: Compressed files cannot be entered in the middle.
PACKED = (".gz", ".bz2", ".zst")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as the cluster's default file system completes it; nothing is looked up."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath).toString()


def file_name(path: Column) -> Column:
    """The name that lines of a listed path carry: the path as a URI, as Spark's readers give it."""
    encoded = F.regexp_replace(path, "%", "%25")
    for sign in ' "#<>?[\\]^`{|}':
        encoded = F.replace(encoded, F.lit(sign), F.lit(quote(sign)))
    return encoded


@functools.cache
def _store(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


@functools.cache
def _local() -> pafs.FileSystem:
    return pafs.LocalFileSystem()


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path's name in it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        return _local(), re.sub("^//+", "/", rest) if rest.startswith("//") else rest or path
    authority, _, below = rest.removeprefix("//").partition("/")
    store, base = _store(f"{scheme}://{authority}/")
    return store, f"{base.rstrip('/')}/{below}"


def is_local(path: str) -> bool:
    return path.startswith("file:") or ":" not in path


def resolved(path: str) -> str:
    """A path without links; other stores have none."""
    if not is_local(path):
        return path
    return "file:" + os.path.realpath(locate(path)[1])


def entry(path: str) -> tuple[str, int, int]:
    """``file``, ``folder`` or ``missing``, with size in bytes and change time in ms."""
    store, name = locate(path)
    return _shown(store.get_file_info(name))


def exists(path: str) -> bool:
    try:
        return entry(path)[0] != "missing"
    except FAULTS:
        return False


def _shown(info: pafs.FileInfo) -> tuple[str, int, int]:
    kinds = {pafs.FileType.File: "file", pafs.FileType.Directory: "folder", pafs.FileType.NotFound: "missing"}
    return kinds.get(info.type, "other"), info.size or 0, (info.mtime_ns or 0) // 1_000_000


def children(path: str) -> list[tuple[str, str, int, int]]:
    """``name, kind, size, mtime`` of what lies directly in a folder, hidden names left out."""
    return [(name, kind, size, mtime) for name, kind, size, mtime, _ in below(path)]


def below(path: str) -> Iterator[tuple[str, str, int, int, bool]]:
    """``children`` one by one, with whether a name may be a link, so that only links need be resolved."""
    store, name = locate(path)
    if not is_local(path):
        for i in store.get_file_info(pafs.FileSelector(name, recursive=False)):
            if not i.base_name.startswith("."):
                yield i.base_name, *_shown(i), False
        return
    with os.scandir(name) as found:
        for e in found:
            if not e.name.startswith("."):
                e.name.encode()  # a name that is no text makes its folder unreadable
                shown = _stat(e)
                if shown is not None:
                    yield e.name, *shown, e.is_symlink()


def _stat(e: os.DirEntry) -> tuple[str, int, int] | None:
    """As ``_shown``; what a link points to counts, and a link to nothing is none."""
    try:
        s = e.stat()
    except OSError as x:
        if x.errno in (errno.ENOENT, errno.ENOTDIR, errno.ELOOP):
            return None
        raise
    if stat.S_ISREG(s.st_mode):
        return "file", s.st_size, s.st_mtime_ns // 1_000_000
    return "folder" if stat.S_ISDIR(s.st_mode) else "other", 0, s.st_mtime_ns // 1_000_000


def open_file(path: str) -> BinaryIO:
    """A stream of the file's bytes, unpacked; only plain files can ``seek``."""
    store, name = locate(path)
    raw = store.open_input_file(name)
    if path.endswith(".gz"):
        return gzip.GzipFile(fileobj=raw)
    if path.endswith(".bz2"):
        return bz2.BZ2File(raw)
    if path.endswith(".zst"):
        return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    return raw


def write_hole(path: str, size: int) -> None:
    """Write a file of ``size`` zero bytes; a local one is a hole, which takes no block of the disk."""
    if not is_local(path):
        write_file(path, [bytes(size)])
        return
    name = locate(path)[1]
    os.makedirs(os.path.dirname(name), exist_ok=True)
    with open(name, "wb") as out:
        out.truncate(size)


#: Names that one file of holes is given; common file systems allow some more.
MOST_LINKS = 30_000


class Holes:
    """Writes files of zero bytes. Local ones are holes, and files of one size are names of the same few of them.

    A hole takes no block of the disk but an entry of its own; a further name takes only its line in the folder.
    """

    def __init__(self) -> None:
        self._last: dict[int, tuple[str, int]] = {}

    def write(self, path: str, size: int) -> None:
        if not is_local(path):
            write_hole(path, size)
            return
        name = locate(path)[1]
        first, names = self._last.get(size, ("", MOST_LINKS))
        if names < MOST_LINKS and _linked(first, name, size):
            self._last[size] = first, names + 1
            return
        with contextlib.suppress(FileNotFoundError):
            os.unlink(name)  # a file that is there may share its bytes with others
        write_hole(path, size)
        self._last[size] = name, 1


def _linked(first: str, name: str, size: int) -> bool:
    """Whether ``name`` could be made a further name of ``first`` and has its size; one that was there is replaced."""
    try:
        try:
            os.link(first, name)
        except FileExistsError:
            os.unlink(name)
            os.link(first, name)
        except FileNotFoundError:  # usually the folder
            os.makedirs(os.path.dirname(name), exist_ok=True)
            os.link(first, name)
        if os.stat(name).st_size == size:  # the first name may have been written again since, with another size
            return True
        os.unlink(name)
    except OSError:  # a store without links, or one that allows fewer
        pass
    return False


def write_file(path: str, parts) -> int:
    """Write byte strings one after the other; folders are made. Returns the size."""
    store, name = locate(path)
    store.create_dir(os.path.dirname(name), recursive=True)
    size = 0
    with store.open_output_stream(name, compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    return size
