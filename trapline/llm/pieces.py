"""Cutting text where no pre-token crosses, and remembering what was encoded.

The pattern that precedes byte-level merges lets a pre-token begin with one space and end before
the next, so a text may be cut before every space that has other characters than white space on
both sides. A single line end between such characters is a pre-token by itself, and so is a stop
or comma between a letter or digit and white space. The pieces repeat; each distinct piece is
encoded once per worker and table."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r"(?<=\S)(?= \S)")
_ODD = re.compile("[\0\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")


def _spaced(text: str) -> bool:
    """Whether a space may have white space beside it, or the text holds a zero byte."""
    return ("  " in text or "\n " in text or " \n" in text or _ODD.search(text) is not None)


# a stop or comma that follows anything but a letter or digit
_RUN = re.compile(r"[.,](?=[ \n])(?<![^\W_][.,])")


def _marked(text: str) -> str:
    """The text with a zero byte at each cut; the text holds none itself."""
    if _spaced(text):
        return "\0".join(_CUT.split(text))
    cut = text if "\n\n" in text else text.replace("\n", "\0\n\0")
    cut = cut.replace(" ", "\0 ")
    if _RUN.search(text):
        return cut
    return cut.replace(".\0", "\0.\0").replace(",\0", "\0,\0")


def pieces(text: str) -> list[str]:
    """``text`` in pieces."""
    return _CUT.split(text) if "\0" in text else _marked(text).split("\0")


def _cut(texts: list[str]) -> pa.ListArray:
    if any("\0" in t for t in texts):
        return pa.array([pieces(t) for t in texts], pa.list_(pa.string()))
    return pc.split_pattern(pa.array(map(_marked, texts), pa.string()), "\0")


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``flat`` joined in the given order."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def bounded(texts: list[str], most: int = 1 << 23):
    """Places where a list of texts is cut into parts of about ``most`` characters."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Memo:
    """Ids of pieces as little-endian 32-bit bytes; forgotten when ``limit`` pieces are held."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 1_000_000):
        self.encode, self.limit, self.held = encode, limit, {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. The pieces of all texts are made distinct before they are looked
        up, and the ids are gathered in one go."""
        if not texts:
            return []
        lists = _cut(texts)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        missing = [p for p in distinct if p not in self.held]
        if len(self.held) + len(missing) > self.limit:
            self.held, missing = {}, distinct
        self.held.update(zip(missing, self.encode(missing)))
        ids = list(map(self.held.__getitem__, distinct))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        order = coded.indices.to_numpy()
        flat = gathered(np.frombuffer(b"".join(ids), "<u4"),
                        (np.cumsum(sizes) - sizes)[order], sizes[order])
        ends = np.concatenate([[0], np.cumsum(sizes[order])])[lists.offsets.to_numpy()
                                                              - lists.offsets[0].as_py()]
        data, cuts = flat.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]
