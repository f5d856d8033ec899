"""Arrays in the folder that all workers share, opened as memory maps."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def save(folder: str, **columns: np.ndarray) -> str:
    """Write arrays to a new file; its name, type and place of each array come back as text.

    A task that runs twice leaves two files; only what the finished one returns is ever read.
    """
    where, root = _at(folder)
    where.create_dir(root, recursive=True)
    name = uuid.uuid4().hex
    told = [name]
    with where.open_output_stream(f"{root}/{name}") as out:
        at = 0
        for key, a in columns.items():
            told.append(f"{key}:{a.dtype.str}:{at}:{len(a)}")
            out.write(np.ascontiguousarray(a).tobytes())
            at += a.nbytes
            out.write(b"\0" * (-at % 8))
            at += -at % 8
        out.write(b"\0" * 8)
    return " ".join(told)


def load(folder: str, told: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped: straight from a mounted folder, else by way of an unlinked copy."""
    name, *columns = told.split(" ")
    where, root = _at(folder)
    if isinstance(where, fs.LocalFileSystem):
        whole = np.memmap(f"{root}/{name}", np.uint8, "r")
    else:
        handle, copy = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as out, where.open_input_stream(f"{root}/{name}") as source:
            while block := source.read(1 << 22):
                out.write(block)
        whole = np.memmap(copy, np.uint8, "r")
        os.unlink(copy)
    out = {}
    for column in columns:
        key, kind, at, size = column.split(":")
        kind, at, size = np.dtype(kind), int(at), int(size)
        out[key] = whole[at : at + size * kind.itemsize].view(kind)
    return out


def planes(a: np.ndarray) -> bytes:
    """Bytes of an array, first bytes of all items first: what is small or alike then compresses."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes()


def unplanes(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()
