"""Files opened for reading at any place, in tasks: local ones and those of the stores that Arrow knows."""

from __future__ import annotations

import re


def at_any_place(path: str):
    """A file with ``seek`` and ``read``; ``path`` is local or a URI of a store (``file``, ``hdfs``, ``s3``, ``gs``)."""
    if not re.match(r"\w+:/", path):
        return open(path, "rb")  # noqa: SIM115
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")  # noqa: SIM115
    from pyarrow.fs import FileSystem

    store, inner = FileSystem.from_uri(path)
    return store.open_input_file(inner)


def exists(path: str) -> bool:
    try:
        at_any_place(path).close()
    except OSError:
        return False
    return True


def first_lines(path: str, is_last, limit: int = 1 << 24) -> list[str] | None:
    """Lines of a text file, gzipped or not, up to the first that ``is_last``; null if the file's store can't be opened here.

    Nothing beyond is read, however long the file; more than ``limit`` bytes without such a line are an error.
    """
    import gzip
    import io

    try:
        file = at_any_place(path)
    except (OSError, ValueError):
        return None
    with file:
        packed = file.read(2) == b"\x1f\x8b"
        file.seek(0)
        out, size = [], 0
        for raw in io.BufferedReader(gzip.GzipFile(fileobj=file)) if packed else file:
            line = raw.decode("utf-8", "replace").rstrip("\r\n")
            out.append(line)
            size += len(raw)
            if is_last(line):
                break
            if size > limit:
                raise ValueError(f"{path} has a header of over {limit} bytes")
        return out
