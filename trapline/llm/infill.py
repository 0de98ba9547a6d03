"""Fill-in-the-middle transformation over a sparse index of multibyte characters.

A batch of texts is one run of UTF-8 bytes. Only the characters of more than one byte are written
down: where they begin and how many bytes they have beyond the first. A cut given in code points
is found in bytes, and the reverse, by a binary search in that short list; in an ASCII span the
two differ by a constant, so nothing is decoded. Tokens end where a word ends, which bytes show
too, as white space is ASCII. The draws are Spark columns of the key; nothing is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the prefix, the suffix and the middle. Each begins with a character that no mark
#: holds elsewhere, so that a mark never arises across a seam and the output can be taken apart.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of texts that are worked on at once.
SLICE_BYTES = 1 << 23
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# bytes that follow the first byte of a character
_EXCESS = np.zeros(256, np.uint8)
_EXCESS[0xC0:0xE0], _EXCESS[0xE0:0xF0], _EXCESS[0xF0:0xF8] = 1, 2, 3


class Exceptions:
    """The multibyte characters of a run of UTF-8 bytes: ``at`` (first byte), ``point`` (number
    of the character) and ``excess`` (bytes beyond one per character, up to and with it)."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        self.excess = np.cumsum(_EXCESS[data[self.at]], dtype=np.int64)
        before = np.concatenate([[0], self.excess[:-1]]).astype(np.int64)
        self.point = self.at - before[:len(self.at)]

    def _less(self, k: np.ndarray) -> np.ndarray:
        return np.where(k > 0, self.excess[np.maximum(k - 1, 0)], 0) if len(self.at) else 0 * k

    def points(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before each byte place (a place between two characters)."""
        return cuts - self._less(np.searchsorted(self.at, cuts, "left"))

    def bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Byte place before which so many code points lie."""
        return cuts + self._less(np.searchsorted(self.point, cuts, "left"))


def word_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Byte places after the last byte of each word; words do not cross the ends of texts."""
    space = _SPACE[data]
    last = np.ones(len(data), bool)
    last[:-1] = space[1:]
    last[ends[ends > 0] - 1] = True
    return np.flatnonzero(last & ~space) + 1


def _cuts(data, starts, ends, low, high, unit):
    """Units of each text and, in bytes, where its smaller and larger cut fall. The draws are
    reduced by the number of units and one, so that all places are as likely."""
    index = Exceptions(data)
    if unit == "code points":
        first = index.points(starts)
        n = index.points(ends) - first
        places = [low % (n + 1), high % (n + 1)]
        a, b = (index.bytes(first + f(*places)) for f in (np.minimum, np.maximum))
        return n, a, b, index
    words = word_ends(data, ends)
    first = np.searchsorted(words, starts, "right")
    found = np.searchsorted(words, ends, "right") - first
    # white space after the last word is a unit of its own
    after = np.where(found > 0, words[first + found - 1] if len(words) else starts, starts)
    n = found + (after < ends)

    def place(k):
        inside = np.where((k > 0) & (k <= found), first + k - 1, 0)
        return np.where(k == 0, starts, np.where(
            k > found, ends, words[inside] if len(words) else ends))

    places = [low % (n + 1), high % (n + 1)]
    a, b = (place(f(*places)) for f in (np.minimum, np.maximum))
    return n, a, b, index


def _infill(rate: int, spm: int, marks: tuple[str, str, str], unit: str):
    p, s, m = (mark.encode() for mark in marks)

    def cut(texts: pa.Array, draws: list[np.ndarray]):
        """One slice of texts without nulls."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[
            texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        raw = b"" if raw is None else memoryview(raw)[offsets[0]:offsets[-1]]
        data = np.frombuffer(raw, np.uint8)
        starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        n, a, b, index = _cuts(data, starts, ends, draws[0], draws[1], unit)
        chars = [index.points(b) - index.points(a), index.points(a) - index.points(starts)]
        changed = (ends > starts) & (draws[2] % 100 < rate)
        swapped = draws[3] % 100 < spm
        out, forms = [], []
        for i, (lo, x, y, hi) in enumerate(zip(starts.tolist(), a.tolist(), b.tolist(),
                                               ends.tolist())):
            text = bytes(raw[lo:hi])
            if not changed[i] or p in text or s in text or m in text:
                out.append(text)
                forms.append("plain")
                continue
            parts = text[:x - lo], text[x - lo:y - lo], text[y - lo:]
            out.append(b"".join((s, parts[2], p, parts[0], m, parts[1]) if swapped[i] else
                                (p, parts[0], s, parts[2], m, parts[1])))
            forms.append("spm" if swapped[i] else "psm")
        plain = np.array([f == "plain" for f in forms], bool)
        return [pa.array(n, pa.int64()), pa.array(forms, pa.string()),
                pa.array(chars[1], pa.int64(), mask=plain),
                pa.array(chars[0], pa.int64(), mask=plain),
                pa.array(out, pa.binary()).cast(pa.string())]

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            texts = texts.cast(pa.string()) if texts.type != pa.string() else texts
            draws = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)]
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[
                texts.offset:texts.offset + len(texts) + 1].astype(np.int64))
            start = 0
            while start < len(texts):
                fits = np.searchsorted(np.cumsum(sizes[start:]), SLICE_BYTES, "right")
                end = start + max(1, int(fits))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start:end],
                     *cut(texts[start:end], [d[start:end] for d in draws])],
                    ["_key", "n", "form", "prefix_chars", "middle_chars", "output"])
                start = end
    return run


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the digest of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast(
        "binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def infill(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42,
           rate: int = 50, spm: int = 80, marks: tuple[str, str, str] = MARKS,
           unit: str = "tokens") -> DataFrame:
    """One row per document: ``key``, ``n`` (its units), ``form``, ``prefix_chars``,
    ``middle_chars`` (code points, null where the form is plain) and ``output``.

    Of 100 documents about ``rate`` are cut in three at two drawn places, and ``spm`` of 100 of
    these begin with the suffix; the others are plain and keep their text. A unit is a word with
    the white space before it (white space after the last word is one more), or a code point if
    ``unit`` is "code points".

    A null text is an empty one, and an empty text and one that holds a mark are plain. Rows with
    equal keys are cut by the same draws, a null key draws as the empty string. A long text is
    worked on whole, in a slice of its own; it needs a few times its size in memory. No rows give
    an empty result; other columns are ignored, whatever their names."""
    heads = [mark[:1] for mark in marks]
    if len(set(marks)) < 3 or any(h in mark[1:] for h in heads for mark in marks) or "" in heads:
        raise ValueError("marks must differ and begin with a character they do not hold elsewhere")
    if unit not in ("tokens", "code points"):
        raise ValueError(f"unknown unit {unit}")
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
                       *[d.alias(f"_h{k}") for k, d in enumerate(draws(F.col(key), seed))])
    kind = rows.schema["_key"].dataType.simpleString()
    out = rows.mapInArrow(_infill(rate, spm, marks, unit), (
        f"_key {kind}, n long, form string, prefix_chars long, middle_chars long, output string"))
    return out.withColumnRenamed("_key", key)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``infill`` was given, from its output and form alone."""
    p, s, m = marks

    def between(first: str, second: str) -> Column:
        """What stands after the first mark and before the second."""
        return F.substring_index(F.substring_index(output, second, 1), first, -1)

    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(
        form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)
