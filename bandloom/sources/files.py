"""Files as tasks see them: on mounted folders by their path, elsewhere by an address that Arrow's file systems know."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from typing import Protocol

import pyarrow.fs as pafs

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+:")
#: Bytes that one read takes at most; a longer piece is one read.
SPAN_BYTES = 8 << 20
#: Bytes of whole files that one task reads.
TASK_BYTES = 16 << 20


class Readable(Protocol):
    def read_at(self, nbytes: int, offset: int) -> bytes: ...


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a path or an address."""
    if path.startswith("file:") or not _SCHEME.match(path):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return pafs.FileSystem.from_uri(path)


def names(path: str) -> list[str]:
    """The names of the files in a folder, sorted, without hidden ones; none if there is no such folder."""
    fs, inner = located(path)
    found = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pafs.FileType.File and not f.base_name.startswith("."))


def hidden(name: str) -> bool:
    """Whether Spark's file sources leave a file or folder out for its name."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


def entries(path: str) -> Iterator[tuple[str, int | None]]:
    """(address, bytes) of what is in a folder, without hidden names; bytes of a folder are None."""
    fs, inner = located(path)
    for f in fs.get_file_info(pafs.FileSelector(inner)):
        if not hidden(f.base_name):
            yield f"file:{f.path}" if isinstance(fs, pafs.LocalFileSystem) else f"{path.rstrip('/')}/{f.base_name}", f.size if f.type == pafs.FileType.File else None


def walked(path: str) -> Iterator[tuple[str, int]]:
    """(address, bytes) of the files in a folder and in those below it, without hidden ones."""
    for found, size in entries(path):
        if size is None:
            yield from walked(found)
        else:
            yield found, size


def alternatives(glob: str) -> list[str]:
    """The patterns for fnmatch that a pattern like *.{jpg,png} of Spark's pathGlobFilter stands for."""
    found = re.search(r"\{([^{}]*)\}", glob)
    if found is None:
        return [glob.replace("[^", "[!")]
    return [p for x in found[1].split(",") for p in alternatives(f"{glob[: found.start()]}{x}{glob[found.end() :]}")]


def write_file(path: str, data: bytes) -> None:
    fs, inner = located(path)
    fs.create_dir(os.path.dirname(inner), recursive=True)
    with fs.open_output_stream(inner) as out:
        out.write(data)


def read_file(path: str) -> bytes:
    fs, inner = located(path)
    with fs.open_input_stream(inner) as f:
        return f.read()


def create_new(path: str, data: bytes) -> bool:
    """Creates a file with all its data at once, or says that there is one of that name. Between two that try at once, a mounted
    folder lets one win; other stores have no such promise, so there the writers of one table must not overlap."""
    fs, inner = located(path)
    fs.create_dir(os.path.dirname(inner), recursive=True)
    if isinstance(fs, pafs.LocalFileSystem):
        own = f"{os.path.dirname(inner)}/.{os.path.basename(inner)}-{os.getpid()}-{os.urandom(4).hex()}"
        with open(own, "wb") as f:
            f.write(data)
        try:
            os.link(own, inner)
        except FileExistsError:
            return False
        finally:
            os.remove(own)
        return True
    if fs.get_file_info(inner).type != pafs.FileType.NotFound:
        return False
    write_file(path, data)
    return True


def grouped(paths: list[str], most: int = TASK_BYTES) -> list[list[int]]:
    """Places in `paths`, in their order, in groups of up to `most` bytes (a larger file is a group): small files share a task."""
    if not paths:
        return []
    fs, _ = located(paths[0])
    out: list[list[int]] = []
    room = 0
    for k, info in enumerate(fs.get_file_info([located(p)[1] for p in paths])):
        size = max(info.size or 0, 1 << 12)  # opening a file counts as well
        if not out or size > room:
            out.append([])
            room = most
        out[-1].append(k)
        room -= size
    return out


def delete_files(folder: str, which: Iterable[str]) -> None:
    fs, inner = located(folder)
    for name in which:
        fs.delete_file(f"{inner}/{name}")


def spans(pieces: list[tuple[int, int]], most: int = SPAN_BYTES, gap: int = 0) -> list[tuple[int, int, int, int]]:
    """(first piece, end piece, start, end) of the reads that fetch pieces (offset, length) in ascending order: pieces that follow
    on each other within `gap` bytes, or are the same, are one read of up to `most` bytes."""
    out: list[tuple[int, int, int, int]] = []
    for k, (offset, length) in enumerate(pieces):
        if out and out[-1][2] <= offset <= out[-1][3] + gap and max(out[-1][3], offset + length) - out[-1][2] <= most:
            first, _, start, end = out[-1]
            out[-1] = (first, k + 1, start, max(end, offset + length))
        else:
            out.append((k, k + 1, offset, offset + length))
    return out


def fetched(file: Readable, pieces: list[tuple[int, int]], most: int = SPAN_BYTES, gap: int = 0) -> Iterator[tuple[int, int, list[bytes], int, int]]:
    """For each read of spans(): (first piece, end piece, the pieces' bytes, start, length). Only these bytes are read."""
    for first, end, start, stop in spans(pieces, most, gap):
        data = file.read_at(stop - start, start)
        if len(data) != stop - start:
            raise OSError(f"{len(data)} bytes at {start} instead of {stop - start}")
        yield first, end, [data[o - start : o - start + n] for o, n in pieces[first:end]], start, stop - start
