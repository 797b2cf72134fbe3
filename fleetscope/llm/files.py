"""Files of this package's own formats in the shared store, written and read inside tasks.

A task writes under a name of its own and reports it; only names in the manifest of a finished job count, so
a task that ran twice or died leaves at most a file that nobody reads.
"""

from __future__ import annotations

import uuid


def store(uri: str):
    """(file system, path) of a folder URI or plain path; local, hdfs, s3 and gs as the installed Arrow has them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def fresh(prefix: str, part: int, suffix: str) -> str:
    return f"{prefix}-{part:06d}-{uuid.uuid4().hex}.{suffix}"


def create(uri: str, name: str):
    """A binary stream that writes uri/name."""
    system, path = store(uri)
    system.create_dir(path, recursive=True)
    return system.open_output_stream(f"{path}/{name}", compression=None)


def opened(uri: str, name: str):
    """uri/name for random access; memory-mapped where the store is a local one."""
    import pyarrow as pa
    from pyarrow import fs

    system, path = store(uri)
    return pa.memory_map(f"{path}/{name}") if isinstance(system, fs.LocalFileSystem) else system.open_input_file(f"{path}/{name}")
