"""Listing and opening files by path or URI, through pyarrow's file systems."""

from __future__ import annotations

import fnmatch
import glob
import os

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:") :]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def listing(path: str, include_open: bool) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a path, folder or pattern names; hidden ones are left out, `.open` ones on request."""
    system, inner = locate(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) and "://" in path else ""
    if any(c in inner for c in "*?["):
        if isinstance(system, fs.LocalFileSystem):
            found = system.get_file_info(sorted(glob.glob(inner)))
        else:
            base = inner[: min(inner.index(c) for c in "*?[" if c in inner)].rpartition("/")[0]
            found = [i for i in system.get_file_info(fs.FileSelector(base, recursive=True)) if fnmatch.fnmatchcase(i.path, inner)]
    else:
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = system.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else [info]
    out = []
    for i in sorted(found, key=lambda i: i.path):
        if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")) and (include_open or not i.base_name.endswith(".open")):
            out.append((prefix + i.path, i.size))
    return out
