"""Which stores Python on the executors reaches: those that pyarrow opens, and folders that all machines mount."""

from __future__ import annotations


def mounted(uri: str) -> str | None:
    """The path of a file: URI; None for another store."""
    return "/" + uri[5:].lstrip("/") if uri.startswith("file:") else None


def store_of(uri: str):
    """The pyarrow store of a full URI, and the path in it."""
    from pyarrow import fs

    path = mounted(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)


def reachable(uri: str) -> bool:
    from pyarrow import ArrowException

    try:
        store, path = store_of(uri)
        store.get_file_info(path)
        return True
    except (ArrowException, OSError):
        return False


def is_folder(uri: str) -> bool:
    from pyarrow import fs

    store, path = store_of(uri)
    return store.get_file_info(path).type == fs.FileType.Directory
