"""File systems by address, for tasks and for the driver."""

from __future__ import annotations

import re


def filesystem(path: str):
    """(file system, path in it) of an address: a local path, file:, hdfs:, s3: (s3a: and s3n: are the same) or gs:."""
    from pyarrow import fs

    path = re.sub(r"^s3[an]:", "s3:", path)
    if path.startswith("file:"):
        path = "file://" + re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)
