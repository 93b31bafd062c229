"""Files in shared storage, opened by whatever filesystem their address names."""

from __future__ import annotations

import uuid

import numpy as np
from pyarrow import fs


def _of(path: str):
    return fs.FileSystem.from_uri(path)


def write(path: str, data) -> None:
    """Write under a name of this attempt, then rename: a task that is run again, or twice, leaves one whole file.

    Where a store doesn't rename onto a file that is there, that file is an earlier attempt's, whole, and stays.
    """
    store, at = _of(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    own = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for part in data:
            out.write(part)
    try:
        store.move(own, at)
    except OSError:
        if store.get_file_info(at).type != fs.FileType.File:
            raise
        store.delete_file(own)


def exists(path: str) -> bool:
    store, at = _of(path)
    return store.get_file_info(at).type == fs.FileType.File


def read(path: str) -> memoryview:
    store, at = _of(path)
    with store.open_input_file(at) as f:
        return memoryview(f.read_buffer())


def read_ids(path: str, first: int, count: int, dtype: str) -> np.ndarray:
    """``count`` ids of a flat file from the ``first``, without reading what stands before."""
    store, at = _of(path)
    width = np.dtype(dtype).itemsize
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read_at(count * width, first * width), dtype)
