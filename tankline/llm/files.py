"""Binary files in shared stores, from the driver and from tasks."""

from __future__ import annotations

import re

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a bare path and ``file:/path`` are local."""
    if "://" not in uri:
        uri = "file://" + re.sub(r"^file:", "", uri)
    return fs.FileSystem.from_uri(uri)
