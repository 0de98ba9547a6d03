"""Files of independent Zstandard frames with a seek table at the end.

The table is a skippable frame, so that any Zstandard reader can decompress the whole file: per
frame its compressed size, its size and a checksum of its contents, then the number of frames, a
descriptor and a magic number. A reader fetches the last bytes, then the table, then only the
frames it wants."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import xxhash
import zstandard

# fixed values of the seekable format
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
FOOTER = struct.Struct("<IBI")


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def packed(frames: Iterable[bytes], level: int = 3):
    """Compressed frames, then the seek table."""
    press = zstandard.ZstdCompressor(level=level, write_content_size=True)
    entries = []
    for frame in frames:
        body = press.compress(frame)
        entries.append((len(body), len(frame), _checksum(frame)))
        yield body
    table = np.array(entries, "<u4").tobytes()
    table += FOOTER.pack(len(entries), WITH_CHECKSUMS, SEEKABLE)
    yield struct.pack("<II", SKIPPABLE, len(table)) + table


class Reader:
    """Frames of one file; each is fetched, decompressed and checked on its own."""

    def __init__(self, store, path: str):
        self._file = store.open_input_file(path)
        size = self._file.size()
        count, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE or flags != WITH_CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        body = self._at(size - FOOTER.size - 12 * count, 12 * count)
        self.table = np.frombuffer(body, "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self._held: tuple[int, bytes] | None = None

    def _at(self, start: int, size: int) -> bytes:
        self._file.seek(start)
        return self._file.read(size)

    def frame(self, k: int) -> bytes:
        if self._held is None or self._held[0] != k:
            size, plain, check = (int(x) for x in self.table[k])
            data = zstandard.ZstdDecompressor().decompress(
                self._at(int(self.starts[k]), size), max_output_size=plain)
            if len(data) != plain or _checksum(data) != check:
                raise ValueError(f"frame {k} is damaged")
            self._held = k, data
        return self._held[1]

    def close(self) -> None:
        self._file.close()
