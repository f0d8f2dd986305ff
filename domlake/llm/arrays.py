"""Arrays sorted by hash, written by the tasks that hold them into the shared folder and memory-mapped by
workers. A table is cut by the top bits of its keys; only the list of its files reaches the driver."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs


def _kind(name: str) -> np.dtype:
    return np.dtype("<" + (name.partition("~")[2] or "f8"))


def save(folder: str, name: str, keys: np.ndarray, values: np.ndarray) -> None:
    """One sorted array as a file; written aside and moved, so a repeated task leaves the same file. Values are doubles,
    or what the end of the name says (~u1: bytes)."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    aside = f"{base}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as f:
        f.write(keys.astype("<u8").tobytes())
        f.write(values.astype(_kind(name)).tobytes())
    fs.move(aside, f"{base}/{name}")


_OPEN: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mapped(folder: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a saved array, memory-mapped. A folder that is not a mounted file system is
    copied once for each worker; the copy has no name any more once it is mapped."""
    at = f"{folder}/{name}"
    if at not in _OPEN:
        if len(_OPEN) > 4096:
            _OPEN.clear()
        fs, path = pafs.FileSystem.from_uri(at)
        if not fs.get_file_info(path).size:
            data = np.zeros(0, np.uint8)
        elif isinstance(fs, pafs.LocalFileSystem):
            data = np.memmap(path, np.uint8, "r")
        else:
            with fs.open_input_stream(path) as f, tempfile.NamedTemporaryFile(dir=os.environ.get("TMPDIR"), delete=False) as copy:
                while piece := f.read(1 << 22):
                    copy.write(piece)
            data = np.memmap(copy.name, np.uint8, "r")
            os.unlink(copy.name)
        n = len(data) // (8 + _kind(name).itemsize)
        _OPEN[at] = data[: 8 * n].view("<u8"), data[8 * n:].view(_kind(name))
    return _OPEN[at]


def find(folder: str, files: dict[int, str], bits: int, keys: np.ndarray,
         route: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Values of keys, and which were found. The top bits of route (keys, if not given) say in which file."""
    out, had = np.zeros(len(keys)), np.zeros(len(keys), bool)
    if not len(keys) or not files:
        return out, had
    bucket = ((keys if route is None else route) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(keys, kind="stable") if route is None else np.lexsort((keys, bucket))
    sought, cut = keys[order], np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
    for at, name in files.items():
        a, z = cut[at], cut[at + 1]
        if a == z:
            continue
        have, values = mapped(folder, name)
        if not len(have):
            continue
        i = np.minimum(np.searchsorted(have, sought[a:z]), len(have) - 1)
        hit = have[i] == sought[a:z]
        out[order[a:z][hit]] = values[i[hit]]
        had[order[a:z][hit]] = True
    return out, had


def flat(folder: str, name: str) -> np.ndarray:
    """All of a file that was saved without values."""
    at = f"{folder}/{name} flat"
    if at not in _OPEN:
        keys, _ = mapped(folder, name)
        whole = keys.base if keys.base is not None else keys
        while getattr(whole, "base", None) is not None and isinstance(whole.base, np.ndarray):
            whole = whole.base
        _OPEN[at] = whole.view("<u8"), whole[:0]
    return _OPEN[at][0]
