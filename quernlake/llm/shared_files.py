"""Files of operators that have a format of their own, in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import BinaryIO

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path on it."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1)) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _moved(store: fs.FileSystem, draft: str, path: str) -> None:
    """A retried task may find the file of an earlier attempt, which has the same content."""
    try:
        store.move(draft, path)
    except OSError:
        store.delete_file(path)
        store.move(draft, path)


def write_once(uri: str, write: Callable[[BinaryIO], object]) -> object:
    """Writes beside the place and moves there: a task that runs twice, or dies, leaves either a whole file or none."""
    store, path = opened(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with store.open_output_stream(draft) as out:
        result = write(out)
    _moved(store, draft, path)
    return result


def write_both(uri: str, beside: str, write: Callable[[BinaryIO, BinaryIO], object]) -> object:
    """The same for a file and its index, written in one pass. The index is moved last, so where there is an index its file is whole."""
    return write_once(beside, lambda index: write_once(uri, lambda out: write(out, index)))
