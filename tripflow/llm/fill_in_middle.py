"""Fill-in-middle samples by memoised chunks.

A rolling hash of the last 32 bytes cuts texts into chunks by their content, so passages that texts share mostly become
equal chunks. A task keeps a memo of chunk summaries, looked up by the chunk's whole content: where its lines end, the
code points up to there, whether a marker is inside, and the bytes at its edges. A document's line count, its two cuts and
markers that lie across chunks come from combined summaries alone; a text is scanned only in chunks that are new.

The memo holds ``memo_bytes`` of chunks and forgets the one unused for longest, which costs time and changes no result.
Documents are independent: no shuffle, and a task holds a batch of texts and its memo.

Null text counts as empty; an empty text is plain and has no units. A null key draws as the text ``null``. Repeated rows and
keys give a row each, and rows of equal key and text give equal rows. Other columns aren't returned, so their names may clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._spark import released

MARKERS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
WINDOW, BITS, MOST = 32, 11, 1 << 14  # bytes that a cut depends on, 2^BITS bytes a chunk on average, bytes of a chunk at most

_GEAR = np.random.default_rng(32).integers(0, 2**32, 256, dtype=np.uint32)


class Summary(NamedTuple):
    """ends: bytes up to each line end, itself included; points: code points up to there; head, tail: the bytes at the edges."""

    ends: np.ndarray
    points: np.ndarray
    size: int
    chars: int
    marked: bool
    head: bytes
    tail: bytes


def rolled(data: np.ndarray) -> np.ndarray:
    """A hash of every WINDOW consecutive bytes, by doubling; len(data) - WINDOW + 1 of them."""
    h, k = _GEAR[data], 1
    while k < WINDOW:
        h = h[:-k] * np.uint32(pow(0x9E3779B1, k, 2**32)) + h[k:]
        k *= 2
    return h


def chunk_bounds(data: np.ndarray, offsets: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Where the chunks of all rows begin, and the end: row starts, places that the rolling hash selects, and every MOST bytes between."""
    found = [offsets]
    for lo in range(0, max(len(data) - WINDOW + 1, 0), step):
        part = data[lo : lo + step + WINDOW - 1]
        if len(part) >= WINDOW:
            found.append(np.flatnonzero(rolled(part) >> np.uint32(32 - BITS) == 0) + lo + WINDOW)
    at = np.unique(np.concatenate(found))
    row = np.searchsorted(offsets, at, "right") - 1
    before = np.where(offsets[row] == at, WINDOW, at - offsets[row])  # a row's start is a bound whatever lies before
    at = at[before >= WINDOW]
    size = np.diff(at)
    more = np.maximum((size - 1) // MOST, 0)
    long = np.repeat(np.arange(len(size)), more)
    nth = np.arange(len(long)) - np.repeat(np.cumsum(more) - more, more) + 1
    return np.sort(np.concatenate([at, at[long] + nth * MOST]))


class Memo:
    """Chunk summaries by content."""

    def __init__(self, markers: Sequence[bytes], limit: int):
        self.markers, self.limit, self.held, self.known = markers, limit, 0, OrderedDict()
        self.edge = max(map(len, markers)) - 1

    def summary(self, chunk: bytes) -> Summary:
        known = self.known.get(chunk)  # found by hash, then held against the whole content
        if known:
            self.known.move_to_end(chunk)
            return known
        data = np.frombuffer(chunk, np.uint8)
        ends, points = np.flatnonzero(data == 10) + 1, np.cumsum((data & 0xC0) != 0x80)
        made = self.known[chunk] = Summary(ends, points[ends - 1], len(chunk), int(points[-1]), any(m in chunk for m in self.markers), chunk[: self.edge], chunk[-self.edge :])
        self.held += len(chunk) + 16 * len(ends) + 500
        while self.held > self.limit and len(self.known) > 1:
            old, s = self.known.popitem(last=False)
            self.held -= len(old) + 16 * len(s.ends) + 500
        return made

    def marked(self, parts: Sequence[Summary]) -> bool:
        """Whether a marker lies in the chunks or across them."""
        before = b""
        for s in parts:
            if s.marked or any(m in before + s.head for m in self.markers):
                return True
            before = (before + s.tail)[-self.edge :]
        return False


class Lines:
    """A document's lines by its chunks' summaries."""

    def __init__(self, parts: Sequence[Summary]):
        self.parts = parts
        self.lines, self.bytes, self.chars = (list(accumulate(f, initial=0)) for f in ((len(s.ends) for s in parts), (s.size for s in parts), (s.chars for s in parts)))
        self.n = self.lines[-1] + (not parts[-1].tail.endswith(b"\n") if parts else 0)

    def after(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first k lines."""
        if k > self.lines[-1]:
            return self.bytes[-1], self.chars[-1]
        if not k:
            return 0, 0
        i = bisect_left(self.lines, k) - 1
        s, j = self.parts[i], k - self.lines[i] - 1
        return self.bytes[i] + int(s.ends[j]), self.chars[i] + int(s.points[j])


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, percent: int = 100, spm_percent: int = 50, markers: Sequence[str] = MARKERS, memo_bytes: int = 8 << 20) -> DataFrame:
    """key, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, of every document.

    Four numbers are drawn by the SHA-256 of seed and key: two line cuts, whether the text is rearranged (``percent``), and
    how (``spm_percent``). Texts that contain a marker stay plain, so an output can be taken apart again.
    """
    signs = [m.encode() for m in markers]
    p, s, m = signs

    def rearranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(signs, memo_bytes)
        for batch in batches:
            data, offsets = X.flat(batch.column(2))
            at = chunk_bounds(data, offsets)
            first = np.searchsorted(at, offsets).tolist()
            raw, at = data.tobytes(), at.tolist()
            rows = []
            for i, name in enumerate(batch.column(1).to_pylist()):
                body = raw[at[first[i]] : at[first[i + 1]]]
                parts = [memo.summary(raw[at[c] : at[c + 1]]) for c in range(first[i], first[i + 1])]
                doc, drawn = Lines(parts), hashlib.sha256(f"{seed}:{name}".encode()).digest()
                h = [int.from_bytes(drawn[4 * j : 4 * j + 4], "big") for j in range(4)]
                if not body or h[2] % 100 >= percent or memo.marked(parts):
                    rows.append((doc.n, "plain", None, None, body))
                    continue
                (a, chars_a), (b, chars_b) = (doc.after(k) for k in sorted(x % (doc.n + 1) for x in h[:2]))
                spm = h[3] % 100 < spm_percent
                pieces = (s, body[b:], p, body[:a], m, body[a:b]) if spm else (p, body[:a], s, body[b:], m, body[a:b])
                rows.append((doc.n, "spm" if spm else "psm", chars_a, chars_b - chars_a, b"".join(pieces)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            made[-1] = made[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["k", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("name"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    made = rows.mapInArrow(lambda batches: released(rearranged(batches)), f"k {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("k", key)


def restored(output: str | Column = "output", form: str | Column = "form", markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output was made of. Pieces contain no marker and markers don't overlap, so each marker of an output is found where it was put."""
    out, kind = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = markers

    def text(opening: str, second: str, psm: bool) -> Column:
        one = F.substr(F.substring_index(out, second, 1), F.lit(len(opening) + 1))
        rest = F.substring_index(out, second, -1)
        two, middle = F.substring_index(rest, m, 1), F.substring_index(rest, m, -1)
        return F.concat(one, middle, two) if psm else F.concat(two, middle, one)

    return F.when(kind == "psm", text(p, s, True)).when(kind == "spm", text(s, p, False)).otherwise(out)
