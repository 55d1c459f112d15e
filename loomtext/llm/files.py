"""Files in the shared folder, written and read by Python workers."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse


def local_path(uri: str) -> str | None:
    """The path of a file:// or plain path; None for other stores."""
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


def write_file(uri: str, data: bytes) -> None:
    """All or nothing: another attempt at the same file replaces it by the same bytes."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def read_file(uri: str) -> bytes:
    path = local_path(uri)
    if path is not None:
        with open(path, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read()
