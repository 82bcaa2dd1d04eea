"""Random access to files from tasks, by their address in any file system that pyarrow knows."""

from __future__ import annotations

import zlib
from bisect import bisect_right


def opened(path: str):
    """A file for reading at any place."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


class Blocks:
    """A block-compressed file (gzip members, one after the other), read at places of
    its text by the blocks' places: (in the file, in the text), from (0, 0) on.
    """

    def __init__(self, file, places: list[tuple[int, int]]) -> None:
        self.file, self.places = file, places
        self.begins = [x[1] for x in places]

    def read(self, at: int, size: int) -> bytes:
        packed, begin = self.places[bisect_right(self.begins, at) - 1]
        self.file.seek(packed)
        out, skip, rest = b"", at - begin, b""
        while len(out) < skip + size:
            rest = rest or self.file.read(1 << 16)
            if not rest:
                break
            member = zlib.decompressobj(31)
            while not member.eof and rest:
                out += member.decompress(rest)
                rest = member.unused_data or (b"" if member.eof else self.file.read(1 << 16))
        return out[skip : skip + size]


def gzi(path: str) -> list[tuple[int, int]]:
    """The places of an index file of blocks: their number, then pairs, eight bytes each."""
    with opened(path) as file:
        data = file.read()
    numbers = [int.from_bytes(data[i : i + 8], "little") for i in range(0, len(data), 8)]
    return [(0, 0), *zip(numbers[1 : 1 + 2 * numbers[0] : 2], numbers[2 : 2 + 2 * numbers[0] : 2], strict=True)]
