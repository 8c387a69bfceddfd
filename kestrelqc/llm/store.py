"""Binary files in the shared folder, written and read by tasks: plain files for ``file:``, else by pyarrow's file systems."""

from __future__ import annotations

import contextlib
import os
import uuid
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


@contextlib.contextmanager
def create(uri: str):
    """A new binary file that is there whole or not at all: it gets its name when the block ends well.

    A task that runs again writes the same name anew, so a lost executor leaves no half of a file.
    """
    path, attempt = _local(uri), f".{uuid.uuid4().hex}.part"
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            with open(path + attempt, "wb") as f:
                yield f
            os.replace(path + attempt, path)
        except BaseException:
            with contextlib.suppress(OSError):
                os.remove(path + attempt)
            raise
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(path + attempt) as f:
        yield f
    system.move(path + attempt, path)


def opened(uri: str):
    """A binary file that can seek."""
    path = _local(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
