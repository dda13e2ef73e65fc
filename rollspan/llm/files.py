"""Binary files in the session's shared folder.

Tasks write files under a name of their own attempt, so a task that runs twice leaves
an orphan and never a torn file: only the names that a finished task returned are read.
"""

import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark import TaskContext

from rollspan.session import scratch


def new_folder(spark):
    """A fresh folder URI below the session's `spark.checkpoint.dir`."""
    return scratch(spark)


def _store(uri):
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def attempt_name(kind, part=None):
    """A file name that no other attempt of the task uses."""
    context = TaskContext.get()
    part = context.partitionId() if part is None else part
    return f"{kind}-{part:06d}-{uuid.uuid4().hex[:12]}"


def open_output(folder, name):
    """A writable stream in the shared folder."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    return store.open_output_stream(f"{path}/{name}", compression=None)


def open_input(folder, name):
    """A seekable stream of a file in the shared folder."""
    store, path = _store(folder)
    return store.open_input_file(f"{path}/{name}")


def file_size(folder, name):
    store, path = _store(folder)
    return store.get_file_info(f"{path}/{name}").size


def mapped(folder, name, dtype, count, offset=0):
    """A memory-mapped array; on a store that cannot be mapped, the range is read."""
    if count == 0:
        return np.zeros(0, dtype)
    parts = urlparse(folder)
    if parts.scheme in ("", "file"):
        path = f"{parts.path}/{name}"
        return np.memmap(path, dtype=dtype, mode="r", offset=offset, shape=(count,))
    with open_input(folder, name) as stream:
        stream.seek(offset)
        return np.frombuffer(stream.read(count * np.dtype(dtype).itemsize), dtype)
