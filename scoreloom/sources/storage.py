"""File access from inside tasks, by URI, on whatever store the cluster uses."""

from __future__ import annotations

import errno
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyarrow import fs

OBJECT_STORES = ("s3", "gcs", "abfs")
IO_THREADS = 8  # requests a task keeps open at once; it waits for the store more than it computes


@lru_cache(maxsize=1)
def _pool() -> ThreadPoolExecutor:
    return ThreadPoolExecutor(IO_THREADS)


def io_map(call: Callable, *columns: Iterable) -> list:
    """Call a function that waits for the store on several rows of a micro-batch at once, in order."""
    return list(_pool().map(call, *columns))


def io_start(call: Callable, values: Iterable) -> list[Future]:
    """Start the same for values that are needed a little later."""
    return [_pool().submit(call, value) for value in values]


@lru_cache(maxsize=64)
def _store(root: str) -> tuple[fs.FileSystem, str]:
    """File system of a bucket or host, and the path of its root; opened once per process."""
    return fs.FileSystem.from_uri(root)


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of ``uri`` (``file:``, ``hdfs:``, ``s3:``, ``gs:``, ``abfss:``).

    Everything after the host is taken as it stands, so names with blanks, ``%`` or ``#`` work.
    """
    scheme, _, rest = uri.partition(":")
    if not rest or "/" in scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, _, path = rest.removeprefix("//").partition("/")
    store, root = _store(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{host}/")
    return store, f"{root.rstrip('/')}/{path}"


def read_file(uri: str) -> bytes:
    store, path = open_store(uri)
    with store.open_input_file(path) as f:
        return f.read()


def map_file(uri: str, kind: str) -> np.ndarray:
    """Numbers of a file: mapped into memory where the file system is mounted, else read."""
    store, path = open_store(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    return np.frombuffer(read_file(uri), dtype=kind)


def write_file(uri: str, content: bytes) -> None:
    """Write so that a reader sees the whole file or none, however often a task is repeated.

    Object stores put a whole object at once; elsewhere a temporary name is moved over the final one.
    """
    store, path = open_store(uri)
    if store.type_name in OBJECT_STORES:
        with store.open_output_stream(path) as f:
            f.write(content)
        return
    folder, _, name = path.rpartition("/")
    temp = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        out = store.open_output_stream(temp)
    except FileNotFoundError:
        store.create_dir(folder, recursive=True)
        out = store.open_output_stream(temp)
    with out as f:
        f.write(content)
    try:
        store.move(temp, path)
    except OSError:
        if store.get_file_info(path).type != fs.FileType.File:
            raise
        store.delete_file(path)  # some stores do not move over a file that is there
        store.move(temp, path)


def exists(uri: str) -> bool:
    store, path = open_store(uri)
    return store.get_file_info(path).type != fs.FileType.NotFound


def file_size(uri: str) -> int:
    """Bytes of a file; none where it is gone, which whoever opens it will find out."""
    store, path = open_store(uri)
    return store.get_file_info(path).size or 0


def make_folder(uri: str) -> None:
    store, path = open_store(uri)
    store.create_dir(path, recursive=True)


def move_folder(uri: str, target: str) -> None:
    """Rename a folder within one file system."""
    store, path = open_store(uri)
    store.move(path, open_store(target)[1])


def delete_folder(uri: str) -> None:
    """Delete a folder and what lies in it; one that is not there is no error."""
    store, path = open_store(uri)
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)


class Entry(NamedTuple):
    """What a folder holds under one name. ``trail`` names, for a folder, the real folders left through links on the way to it."""

    path: str
    is_folder: bool
    length: int
    trail: tuple[str, ...] = ()


def list_folder(
    uri: str, name: re.Pattern | None = None, want: str = "both", trail: Sequence[str] = (), after: str | None = None, until: str | None = None
) -> Iterator[Entry]:
    """Entries directly below ``uri``; none where there is no such folder. Names that start with a dot are left out.

    ``want`` is ``folders``, ``files`` or ``both``. Those wanted must match ``name``; with ``both`` folders need not. With
    ``after`` and ``until`` only names beyond the one and up to the other count, so that several tasks can share a folder: each
    reads all names, and asks for the sizes of its own only. Local and mounted folders are streamed. A link that names nothing is
    left out, and so is a link to a folder that holds the link itself, or one that was left through a link before.
    """
    store, path = open_store(uri)
    base = uri.rstrip("/")

    def counts(entry: str, is_folder: bool) -> bool:
        if want != "both" and is_folder != (want == "folders"):
            return False
        return name is None or (is_folder and want == "both") or name.fullmatch(entry) is not None

    def inside(entry: str) -> bool:
        return not entry.startswith(".") and (after is None or entry > after) and (until is None or entry <= until)

    if not isinstance(store, fs.LocalFileSystem):
        below = len(path.rstrip("/"))
        for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            entry, is_folder = info.path[below:].lstrip("/"), info.type == fs.FileType.Directory
            if inside(entry) and counts(entry, is_folder):
                yield Entry(f"{base}/{entry}", is_folder, 0 if is_folder else info.size)
        return
    if not os.path.isdir(path):
        return
    with os.scandir(path) as entries:
        for entry in entries:
            if not inside(entry.name) or (want != "both" and name is not None and not name.fullmatch(entry.name)):
                continue
            try:
                is_folder = entry.is_dir()
                if not counts(entry.name, is_folder):
                    continue
                if not is_folder:
                    yield Entry(f"{base}/{entry.name}", False, entry.stat().st_size)
                    continue
            except OSError as err:
                if err.errno not in (errno.ENOENT, errno.ELOOP):
                    raise
                continue
            way = _followed(entry.path, path, trail) if entry.is_symlink() else tuple(trail)
            if way is not None:
                yield Entry(f"{base}/{entry.name}", True, 0, way)


def list_names(uri: str) -> Iterator[str]:
    """Names directly below ``uri``, nothing else about them."""
    store, path = open_store(uri)
    if not isinstance(store, fs.LocalFileSystem):
        yield from (info.base_name for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)))
        return
    with os.scandir(path) as entries:
        yield from (entry.name for entry in entries)


def _followed(link: str, folder: str, trail: Sequence[str]) -> tuple[str, ...] | None:
    """The trail beyond a link in ``folder``; None if it leads back to where the way came through."""
    target, here = os.path.realpath(link), os.path.realpath(folder)
    if any((held + "/").startswith(target.rstrip("/") + "/") for held in (here, *trail)):
        return None
    return (*trail, here)
