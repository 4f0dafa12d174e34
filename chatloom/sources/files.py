"""Small files on any file system a URI names: pointers, documents, media. Plain paths are local."""

from __future__ import annotations

import posixpath
import uuid


def _at(uri: str):  # noqa: ANN202
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def join(root: str, *parts: str) -> str:
    return posixpath.join(root, *parts) if root else posixpath.join(*parts)


def exists(uri: str) -> bool:
    from pyarrow import fs

    f, path = _at(uri)
    return f.get_file_info(path).type != fs.FileType.NotFound


def listing(uri: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    from pyarrow import fs

    f, path = _at(uri)
    return sorted(i.base_name for i in f.get_file_info(fs.FileSelector(path, allow_not_found=True)))


def read_bytes(uri: str) -> bytes:
    f, path = _at(uri)
    with f.open_input_stream(path) as s:
        return s.read()


def write_bytes(uri: str, data: bytes) -> None:
    """Write under another name and move into place: a reader never sees half a file, and a task that
    is tried again writes the same file again."""
    f, path = _at(uri)
    f.create_dir(posixpath.dirname(path), recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with f.open_output_stream(tmp) as s:
        s.write(data)
    try:
        f.move(tmp, path)
    except OSError:  # some file systems don't move onto a file
        if exists(uri):
            f.delete_file(path)
        f.move(tmp, path)
