"""Files in shared storage, from Python on the driver or an executor."""

from __future__ import annotations

from urllib.parse import urlparse


def filesystem(path: str):
    """A pyarrow file system and the path in it: local or shared folders, and any store that pyarrow can open."""
    from pyarrow import fs

    where = urlparse(path)
    if where.scheme in ("", "file"):
        return fs.LocalFileSystem(), where.path
    return fs.FileSystem.from_uri(path)


def write_file(path: str, parts) -> int:
    """Write byte strings under a name that appears only when all are there; gives the size."""
    fs, name = filesystem(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    import uuid

    size, part = 0, f"{name}.{uuid.uuid4().hex[:8]}.tmp"
    with fs.open_output_stream(part) as out:
        for data in parts:
            out.write(data)
            size += len(data)
    fs.move(part, name)
    return size


def open_file(path: str):
    """A random-access file."""
    fs, name = filesystem(path)
    return fs.open_input_file(name)


def list_files(folder: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the files of a folder in the order of their names."""
    from pyarrow.fs import FileSelector, FileType

    fs, name = filesystem(folder)
    found = fs.get_file_info(FileSelector(name, allow_not_found=True))
    head = folder.rstrip("/")
    return sorted((f"{head}/{x.base_name}", x.size) for x in found if x.type == FileType.File and x.base_name.endswith(suffix))
