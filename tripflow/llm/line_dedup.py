"""Fuzzy line deduplication by MinHash.

Lines are compared without outer white space. Their sets of 8-character shingles give signatures of 40 minima in
ten bands of four, which pairs of similarity 0.8 share with a chance above 0.99. Up to 160 different shingles a line has 40
hash functions; from 128 on, where more would only cost time, one hash is split into 40 bins (one-permutation hashing).
Lines between have both, and lines of similarity 0.8 or more always have one kind in common.

Equal lines count as one; a task signs them once, so a line that is everywhere reaches its bands once a task. Lines of one band are first tied to the band's least line and to the next one, and a distributed
union-find makes classes of the ties that exact Jaccard similarity confirms. Bands that still hold lines of several
classes are then compared in all their pairs: a task counts shared shingles by matrix products and yields the ties of classes, so
no pair becomes a row. Bands of over about a thousand lines are dealt in blocks that meet
each other, or, where that sends fewer rows, by their lines' rarest shingles in a prefix-filtered join (`prefix_blocks`); neither loses a pair. Every two lines that share a band are so compared or of one class already. Of each
class the first line by (doc_id, text hash, line number) stays.

Lines without a word stay where they are. Null texts stay null. Of rows equal in doc_id and text, one keeps its lines as said and the others
lose all lines that have a word; a null doc_id comes first. Line keys are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._spark import Tables, apart, key_runs, released, sized, sized_lists, together
from .components import EDGE, components, roots

SHINGLE, BANDS, ROWS, SIMILARITY = 8, 10, 4, 0.8
CLASSIC_TO, BINNED_FROM = 160, 128
#: Lines and bytes of a band's block, and lines of a group whose pairs are listed rather than counted in a matrix.
BLOCK_LINES, BLOCK_SIZE, LISTED = 1_024, 1 << 19, 24
#: Rows of a key list that may be broadcast (16 to 40 bytes each); longer lists are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Slots in which the shingles of crowded bands' lines are counted (a power of 2; eight bytes each, in every task).
COUNTS = 1 << 18
#: Keys that a task remembers to have signed (a power of 2; eight bytes each).
SEEN = 1 << 18
_LOW = np.uint64((1 << 52) - 1)
_SEED = np.random.default_rng(23).integers(1, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SEED32 = list(zip((_SEED >> np.uint64(32)).astype(np.uint32), _SEED.astype(np.uint32), strict=True))


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each line with a word: row, line number, start and end without outer white space, key, and place among all lines."""
    starts, ends, first = X.lines(data, offsets)
    begin, end, _ = X.spans(data, offsets, X.NOT_SPACE)
    a, b = np.searchsorted(begin, starts), np.searchsorted(begin, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pos = np.arange(len(starts)) - first[row]
    some = b > a
    a, b, row, pos = a[some], b[some], row[some], pos[some]
    return row, pos, begin[a], end[b - 1], X.span_hash(data, begin[a], end[b - 1]), np.flatnonzero(some)


def _join(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some spans one after another, and their offsets."""
    edges = np.append(0, np.cumsum(ends - starts))
    at = np.arange(edges[-1]) + np.repeat(starts - edges[:-1], ends - starts)
    return data[at], edges


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles, and each text's first (n + 1); a shorter text is one shingle."""
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(chars, offsets)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    edges = np.append(0, np.cumsum(count))
    at = np.repeat(first[:-1] - edges[:-1], count) + np.arange(edges[-1])
    end = np.minimum(at + SHINGLE, np.repeat(first[1:], count))
    return X.span_hash(data, chars[at], chars[end]), edges


def _distinct(hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of up to 4096 texts with so many hashes each: the sorted different (text, 52-bit hash) codes, and their number by text."""
    text = np.repeat(np.arange(len(count), dtype=np.uint64), count)
    codes = np.sort((text << np.uint64(52)) | (hashes >> np.uint64(12)))
    codes = codes[np.append(True, codes[1:] != codes[:-1])] if len(codes) else codes
    return codes, np.bincount((codes >> np.uint64(52)).astype(np.int64), minlength=len(count))


def bands(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of each text and their n + 1 offsets: none if it is empty, ten of one kind, or twenty if it has both."""
    hashes, edges = _shingles(data, offsets)
    n = np.diff(edges)
    fold, slots = np.arange(1, BANDS + 1, dtype=np.uint64), BANDS * ROWS
    sizes = n.copy()
    long = np.flatnonzero(n > BINNED_FROM)  # only there can repeats change the kind
    for lo in range(0, len(long), 4096):
        mine = long[lo : lo + 4096]
        sizes[mine] = _distinct(hashes[np.repeat(edges[mine] - np.cumsum(n[mine]) + n[mine], n[mine]) + np.arange(n[mine].sum())], n[mine])[1]
    few, many = (n > 0) & (sizes <= CLASSIC_TO), sizes > BINNED_FROM
    at = np.append(0, np.cumsum(BANDS * (few.astype(np.int64) + many)))
    out = np.zeros(at[-1], dtype=np.uint64)

    def put(rows: np.ndarray, minima: np.ndarray, kind: int, place: np.ndarray) -> None:
        shaped = minima.reshape(len(rows), BANDS, ROWS)
        key = fold + np.uint64(kind << 8)
        for i in range(ROWS):
            key = X.mix(key + shaped[:, :, i])
        out[(place[:, None] + np.arange(BANDS)).ravel()] = key.ravel()

    if few.any():
        mine, count = hashes[np.repeat(few, n)], n[few]
        starts = np.cumsum(count) - count
        minima = np.empty((len(count), slots), dtype=np.uint64)
        mine = (mine >> np.uint64(32)).astype(np.uint32)  # 32 bits order a line's shingles, and are multiplied several at a time
        for i, (mask, odd) in enumerate(_SEED32):
            # A product with an odd number is hash enough for a minimum.
            minima[:, i] = np.minimum.reduceat((mine ^ mask) * odd, starts)
        put(np.flatnonzero(few), minima, 0, at[:-1][few])
    if many.any():
        mine, rows = hashes[np.repeat(many, n)], np.flatnonzero(many)
        row = np.repeat(np.arange(len(rows)), n[many])
        most = np.iinfo(np.uint64).max
        least = np.full(len(rows) * slots, most, dtype=np.uint64)
        np.minimum.at(least, row * slots + ((mine >> np.uint64(40)) % np.uint64(slots)).astype(np.int64), mine)
        least = least.reshape(-1, slots)
        while (empty := least == most).any():  # an empty bin takes the next one's minimum
            least = np.where(empty, np.roll(least, -1, axis=1), least)
        put(rows, least, 1, at[:-1][many] + BANDS * few[many])
    return out.view(np.int64), at


_SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All lines with a word. Band keys go with the first of a task's equal lines, but for those that `seen` has forgotten."""
    seen = np.zeros(SEEN, dtype=np.uint64)
    for batch in batches:
        for lo, _, data, offsets in X.blocks(batch.column(2)):
            row, pos, starts, ends, key, _ = _lines(data, offsets)
            _, once = np.unique(key, return_index=True)
            once.sort()
            slot = (key[once] & np.uint64(SEEN - 1)).astype(np.int64)
            once, slot = (x[seen[slot] != key[once]] for x in (once, slot))
            seen[slot] = key[once]
            found, at = bands(*_join(data, starts[once], ends[once]))
            size = np.zeros(len(key), dtype=np.int32)
            size[once] = np.diff(at)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(found))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row + lo)) for i in range(2)), pa.array(pos.astype(np.int32)), pa.array(key.view(np.int64)), lists], _SIGNED.names)


def _tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, key) sorted -> (band, a, b): every key of a band tied to the least and to the one before. Holds one batch, however large a band."""
    band = least = last = np.zeros(0, np.int64)  # of the row before
    for batch in batches:
        if not len(batch):
            continue
        bands_, keys = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((band, last)))
        head = np.append(True, bands_[1:] != bands_[:-1])
        first = keys[np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))]
        if len(least):
            first[np.cumsum(head) == 1] = least[0]  # the band that began in an earlier batch
        new = np.append(False, (bands_[1:] == bands_[:-1]) & (keys[1:] != keys[:-1]))
        at = np.flatnonzero(new)
        chain = at[first[at] != keys[at - 1]]
        for a, b in ((first[at], at), (keys[chain - 1], chain)):
            yield pa.RecordBatch.from_arrays([pa.array(bands_[b]), pa.array(a), pa.array(keys[b])], ["band", "a", "b"])
        band, least, last = bands_[-1:], first[-1:], keys[-1:]


def _ties(members: DataFrame) -> DataFrame:
    return members.select("band", "key").repartition("band").sortWithinPartitions("band", "key").mapInArrow(_tie, "band long, a long, b long")


def _wanted(data: np.ndarray, offsets: np.ndarray, want: pa.ListArray) -> tuple[np.ndarray, ...]:
    """What _lines returns, of the lines that a row's (pos, key) list names; a line whose key differs isn't meant."""
    row, pos, starts, ends, key, at = _lines(data, offsets)
    named = want.flatten()
    code = want.value_parent_indices().to_numpy().astype(np.int64) << 32 | named.field("pos").to_numpy()
    order = np.argsort(code, kind="stable")
    code, keys = code[order], named.field("key").to_numpy()[order]
    mine = row << 32 | pos
    hit = np.zeros(len(mine), dtype=bool)
    if len(code):
        lo, hi = np.searchsorted(code, mine, "left"), np.searchsorted(code, mine, "right")
        while (some := lo < hi).any():  # a repeated doc_id may name a line twice
            hit[some] |= keys[lo[some]] == key.view(np.int64)[some]
            lo = lo + 1
    return tuple(x[hit] for x in (row, pos, starts, ends, key, at))


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in X.blocks(batch.column(0)):
            _, _, starts, ends, key, _ = _wanted(data, offsets, batch.column(1).slice(lo, hi - lo))
            raw, edges = _join(data, starts, ends)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), _texts(raw, edges)], ["key", "line"])


def _texts(raw: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.string())


def _without(data: np.ndarray, offsets: np.ndarray, want: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """Each text without its wanted lines, and how many those were."""
    row, _, _, _, _, at = _wanted(data, offsets, want)
    starts, ends, first = X.lines(data, offsets)
    gone = np.zeros(len(starts), dtype=bool)
    gone[at] = True
    # A dropped line takes its line break along; dropped lines at a text's very end take the break before them.
    cut_from, cut_to = starts[at], np.minimum(ends[at] + 1, offsets[row + 1])
    kept = np.where(gone, -1, np.arange(len(gone)))
    last_kept = np.maximum.accumulate(np.append(-1, kept))[first[1:]]
    tail = (first[1:] > first[:-1]) & (last_kept >= first[:-1]) & (last_kept < first[1:] - 1) & (data[np.maximum(offsets[1:] - 1, 0)] != 10) if len(data) else np.zeros(len(offsets) - 1, dtype=bool)
    breaks = ends[last_kept[tail]]
    keep = ~X.covered(np.append(cut_from, breaks), np.append(cut_to, breaks + 1), len(data))
    sizes = X.per_row(keep, offsets)
    return _texts(data[keep], np.append(0, np.cumsum(sizes))), np.bincount(row, minlength=len(offsets) - 1)


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of up to 4096 texts as sorted (text, 52-bit hash) codes, and their sizes."""
    hashes, edges = _shingles(data, offsets)
    return _distinct(hashes, np.diff(edges))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, left, right) -> the pairs (a, b) whose shingle sets have Jaccard similarity of SIMILARITY or more."""
    for batch in batches:
        keep = np.zeros(len(batch), dtype=bool)
        sides = [X.flat(batch.column(c)) for c in (2, 3)]
        total, lo = sides[0][1] + sides[1][1], 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + X.BLOCK_BYTES, "right")) - 1)
            hi = min(hi, lo + 4096)
            (x, nx), (y, ny) = (_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) for data, at in sides)
            both = np.sort(np.concatenate([x, y]))
            shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(52)).astype(np.int64), minlength=hi - lo)
            keep[lo:hi] = shared >= SIMILARITY * (nx + ny - shared)
            lo = hi
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


def _shared(row: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    """How many tokens every two of n rows share, from sorted distinct (token, row) pairs."""
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    df = np.diff(np.append(starts, len(token)))
    out = np.zeros((n, n), dtype=np.float32)
    # Common tokens, of which there are few, as columns of a product; the others by their own pairs.
    common = np.flatnonzero(df > max(8, n // 16))
    for lo in range(0, len(common), 2048):
        part = common[lo : lo + 2048]
        count = df[part]
        at = np.repeat(starts[part] - np.cumsum(count) + count, count) + np.arange(count.sum())
        dense = np.zeros((n, len(part)), dtype=np.float32)
        dense[row[at], np.repeat(np.arange(len(part)), count)] = 1
        out += dense @ dense.T
    rare = np.repeat(df <= max(8, n // 16), df)
    row, token = row[rare], token[rare]
    held: list[np.ndarray] = []
    for step in range(1, len(row)):
        same = np.flatnonzero(token[step:] == token[:-step])
        if len(same):
            held.append(row[same] * n + row[same + step])
        if not len(same) or sum(map(len, held)) > 2_000_000:
            out += _counted(held, n)
            held = []
        if not len(same):
            break
    return out + _counted(held, n) if held else out


def _counted(codes: list[np.ndarray], n: int) -> np.ndarray:
    """A symmetric matrix of how often each code row * n + column occurs."""
    if not codes:
        return np.zeros((n, n), dtype=np.float32)
    upper = np.bincount(np.concatenate(codes), minlength=n * n).reshape(n, n).astype(np.float32)
    return upper + upper.T


def _compare(group: np.ndarray, own: np.ndarray, root: np.ndarray, lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ties of roots by similar lines of one group: of different own blocks, or of any if the group has just one."""
    data, offsets = X.flat(lines)
    hashes, edges = _shingles(data, offsets)
    count = np.diff(edges)
    parts = [_distinct(hashes[edges[lo] : edges[min(lo + 4096, len(group))]], count[lo : lo + 4096]) for lo in range(0, len(group), 4096)]
    hashes = np.concatenate([codes & _LOW for codes, _ in parts])
    size = np.concatenate([n for _, n in parts])
    row = np.repeat(np.arange(len(group)), size)
    first = np.cumsum(size) - size
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    stops = np.append(starts[1:], len(group))
    several = np.minimum.reduceat(own, starts) < np.maximum.reduceat(own, starts)
    a_found, b_found = [], []

    # Groups of few lines: their pairs at once.
    n = stops - starts
    listed = np.flatnonzero(n <= LISTED)
    cross = np.zeros(len(group), dtype=bool)
    for g in np.flatnonzero(several):
        cross[starts[g] : stops[g]] = True
    small = np.concatenate([np.arange(0), *(np.arange(starts[g], stops[g]) for g in listed)])
    end = np.repeat(stops, n)
    pairs = [(small[small + k < end[small]], k) for k in range(1, LISTED)]
    left = np.concatenate([i for i, _ in pairs])
    right = np.concatenate([i + k for i, k in pairs])
    lo_size, hi_size = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
    keep = (root[left] != root[right]) & (lo_size >= SIMILARITY * hi_size) & (~cross[left] | (own[left] != own[right]))
    left, right = left[keep], right[keep]
    total = np.append(0, np.cumsum(size[left] + size[right]))
    lo = 0
    while lo < len(left):
        hi = min(max(lo + 1, int(np.searchsorted(total, total[lo] + 1_000_000, "right")) - 1), lo + 4096)
        both = np.concatenate([left[lo:hi], right[lo:hi]])
        count = size[both]
        pair = np.repeat(np.tile(np.arange(hi - lo, dtype=np.uint64), 2), count)
        codes = np.sort(pair << np.uint64(52) | hashes[np.repeat(first[both] - np.cumsum(count) + count, count) + np.arange(count.sum())])
        shared = np.bincount((codes[1:][codes[1:] == codes[:-1]] >> np.uint64(52)).astype(np.int64), minlength=hi - lo)
        same = shared >= SIMILARITY * (size[left[lo:hi]] + size[right[lo:hi]] - shared)
        a_found.append(root[left[lo:hi]][same])
        b_found.append(root[right[lo:hi]][same])
        lo = hi

    for g in np.flatnonzero(n > LISTED):
        lo, hi = starts[g], stops[g]
        if (root[lo:hi] == root[lo]).all():
            continue
        mine = slice(first[lo], first[hi - 1] + size[hi - 1])
        r, t = row[mine] - lo, hashes[mine]
        if hi - lo <= 4096:
            codes = np.sort(t << np.uint64(12) | r.astype(np.uint64))
            r, t = (codes & np.uint64(4095)).astype(np.int64), codes >> np.uint64(12)
        else:
            order = np.argsort(t, kind="stable")
            r, t = r[order], t[order]
        shared = _shared(r, t, hi - lo).astype(np.float64)
        k = size[lo:hi].astype(np.float64)
        same = shared >= SIMILARITY * (k[:, None] + k[None, :] - shared)
        same &= root[lo:hi, None] != root[None, lo:hi]
        if several[g]:
            same &= own[lo:hi, None] != own[None, lo:hi]
        x, y = np.nonzero(np.triu(same, 1))
        a_found.append(root[lo:hi][x])
        b_found.append(root[lo:hi][y])
    a, b = np.concatenate([np.zeros(0, np.int64), *a_found]), np.concatenate([np.zeros(0, np.int64), *b_found])
    if not len(a):
        return a, b
    a, b = roots(a, b)
    return a[a != b], b[a != b]


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, i, j, own, root, line) sorted by (band, i, j) -> ties (a, b) of the roots of similar lines."""
    for table in key_runs(batches, 3, 4_096):
        keys = [table.column(i).to_numpy() for i in range(3)]
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
        group = np.cumsum(new) - 1
        own, root = table.column(3).to_numpy()[order], table.column(4).to_numpy()[order]
        lines = table.column(5).combine_chunks().take(pa.array(order))
        size = np.append(0, np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False)))
        edge = np.append(np.flatnonzero(new), len(group))
        lo = 0
        while lo < len(edge) - 1:  # whole groups of about a block's bytes
            hi = max(lo + 1, int(np.searchsorted(size[edge], size[edge[lo]] + 2 * BLOCK_SIZE, "right")) - 1)
            part = slice(edge[lo], edge[hi])
            a, b = _compare(group[part], own[part], root[part], lines.slice(edge[lo], edge[hi] - edge[lo]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            lo = hi


def _token_sets(lines: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By some thousand lines: place of the first, and of each different shingle its line, hash and the lines' set sizes."""
    for lo, hi, data, offsets in X.blocks(lines):
        for at in range(0, hi - lo, 4096):
            part = offsets[at : min(at + 4096, hi - lo) + 1]
            codes, size = _sets(data[part[0] : part[-1]], part - part[0])
            yield lo + at, (codes >> np.uint64(52)).astype(np.int64), codes & _LOW, size


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line) -> (slot, n): a task's different shingles of each line, counted in COUNTS slots of their hash."""
    counts = np.zeros(COUNTS, dtype=np.int64)
    for batch in batches:
        for _, _, token, _ in _token_sets(batch.column(0)):
            counts += np.bincount((token & np.uint64(COUNTS - 1)).astype(np.int64), minlength=COUNTS)
    slot = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(counts[slot])], ["slot", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, root, line) -> (token, own, key, root, bytes): a line's rarest shingles, own 0 those of its shorter prefix and 1 those of the longer."""
    for batch in batches:
        bytes_ = pc.binary_length(batch.column(2)).to_numpy()
        for lo, line, token, size in _token_sets(batch.column(2)):
            order = np.lexsort((token, counts[(token & np.uint64(COUNTS - 1)).astype(np.int64)], line))
            line, token = line[order], token[order]
            place = np.arange(len(line)) - (np.cumsum(size) - size)[line]
            for own, part in enumerate((9, 5)):
                mine = place <= size[line] // part
                at = pa.array(line[mine] + lo)
                sides = [pa.array(token[mine].view(np.int64)), pa.array(np.full(int(mine.sum()), own, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([*sides, batch.column(0).take(at), batch.column(1).take(at), pa.array(bytes_).take(at)], ["token", "own", "key", "root", "bytes"])


def _blocks(rows: Column, size: Column) -> Column:
    return F.greatest(F.ceil(rows / BLOCK_LINES), F.ceil(size / BLOCK_SIZE)).cast("int")


def prefix_blocks(lines: DataFrame, tables: Tables) -> tuple[DataFrame, int]:
    """(key, root, line) -> (band, i, j, own, root, line), and how many: groups for _across in which every two lines of similarity SIMILARITY or more meet.

    A prefix-filtered set join. Of two such lines the shorter set has at least 8/9 of its shingles in common with the other, the longer one
    4/5; so by any order of shingles the first common one is among the first n // 9 + 1 of the shorter and n // 5 + 1 of the longer. Shingles go by rarity (counted over all the
    lines in COUNTS slots; any counts give right results), so what a template repeats is in few short prefixes. A shingle's lines with it in
    the short prefix (own 0) meet those with it in the long one (own 1), in blocks; texts are sent only to shingles of several classes.
    """
    found = lines.select("line").mapInArrow(_token_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTS, dtype=np.int64)  # at most COUNTS rows, however many lines
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    prefixes = tables.save(lines.select("key", "root", "line").mapInArrow(lambda batches: _prefixes(batches, counts), "token long, own int, key long, root long, bytes int"))
    short, bytes_ = F.col("own") == 0, F.col("bytes").cast("long")

    def side(which: Column) -> Column:
        return _blocks(F.count_if(which), F.sum(F.when(which, bytes_))).alias("m")

    met = prefixes.groupBy("token").agg(side(short).alias("m0"), side(~short).alias("m1"), F.count_if(short).alias("n0"), F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    met = tables.save(met.where("m0 > 0 and m1 > 0 and lo <> hi").select("token", "m0", "m1", "n0", "n"))
    rows = met.agg(F.expr("sum(n0 * m1 + (n - n0) * m0)")).first()[0] or 0
    placed = prefixes.join(met, "token").withColumn("mine", F.when(short, F.pmod(F.xxhash64("key"), "m0")).otherwise(F.pmod(F.xxhash64("key"), "m1")).cast("int")).drop("n0", "n")
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(short, F.col("m1")).otherwise(F.col("m0")) - 1)))
    i, j = F.when(short, F.col("mine")).otherwise(F.col("other")), F.when(short, F.col("other")).otherwise(F.col("mine"))
    return placed.select(F.col("token").alias("band"), i.alias("i"), j.alias("j"), "own", "root", "key").join(lines.select("key", "line"), "key").drop("key"), rows


def _document() -> tuple[Column, Column]:
    """What tells rows apart, here as in dropped_lines: doc_id and the text's hash, for doc_ids may repeat or be null."""
    return F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")


def _of(lists: DataFrame) -> Column:
    """The join of documents with lists by (_id, _hash)."""
    doc_id, text_hash = _document()
    return (text_hash == lists["_hash"]) & doc_id.eqNullSafe(lists["_id"])


def line_classes(docs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """All lines as (doc_id, text_hash, pos, key) and classes of different lines as (key, root)."""
    signed = tables.save(docs.select(*_document(), "text").mapInArrow(lambda batches: released(_sign(batches)), _SIGNED))
    first = tables.save(_ties(signed.select("key", F.explode("bands").alias("band"))))
    members = tables.save(first.select("band", F.col("a").alias("key")).unionAll(first.select("band", F.col("b").alias("key"))).distinct())
    new = tables.save(first.select("a", "b").distinct())
    wanted = members.select("key").distinct()
    place = signed.join(sized(tables.save(wanted), BROADCAST_ROWS), "key", "left_semi").groupBy("key").agg(F.min(F.struct("doc_id", "text_hash", "pos")).alias("p"))
    by_doc = tables.save(place.groupBy("p.doc_id", "p.text_hash").agg(F.collect_list(F.struct("p.pos", "key")).alias("want")).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}))
    holders = docs.select("doc_id", "text").join(sized_lists(by_doc, "want", BROADCAST_ROWS), _of(by_doc)).select("text", "want")
    texts = tables.save(holders.mapInArrow(_pick, "key long, line string").dropDuplicates(["key"]))

    def check(pairs: DataFrame) -> DataFrame:
        left = pairs.join(texts.select(F.col("key").alias("a"), F.col("line").alias("left")), "a")
        both = left.join(texts.select(F.col("key").alias("b"), F.col("line").alias("right")), "b")
        return both.select("a", "b", "left", "right").mapInArrow(_similar, EDGE)

    ties = tables.save(check(new))
    classes = tables.save(components(ties, tables).select(F.col("node").alias("key"), "root"))
    # A band of three lines has had all its pairs; so has one whose lines are all of one class, for what classes need.
    classed = members.join(classes, "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    mixed = classed.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("n > 3 and lo <> hi")
    mixed = tables.save(mixed.select("band"))
    apart = tables.save(classed.join(sized(mixed, BROADCAST_ROWS), "band").join(texts, "key"))
    blocks = tables.save(apart.groupBy("band").agg(F.count("*").alias("n"), _blocks(F.count("*"), F.sum(F.octet_length("line"))).alias("m")).where("m > 1"))
    known = sized(blocks.select("band", "m"), BROADCAST_ROWS)
    grouped = apart.join(known, "band", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    # Each line of a crowded band would go to each of its blocks: only as long as that are fewer rows than by shingles.
    sent = blocks.agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    if sent:
        hot = tables.save(apart.join(known, "band", "left_semi").select("key", "root", "line").dropDuplicates(["key"]))
        by_shingles, rows = prefix_blocks(hot, tables)
        if rows < sent:
            grouped = grouped.where("m = 1")
    grouped = grouped.withColumn("own", F.expr("cast(pmod(xxhash64(key), m) as int)")).withColumn("other", F.explode(F.expr("sequence(0, m - 1)")))
    grouped = grouped.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "root", "line")
    if sent and rows < sent:
        grouped = grouped.unionAll(by_shingles)
    more = tables.save(grouped.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_across, EDGE).distinct())
    if not more.isEmpty():
        # The classes so far are links, too, and fewer than all ties.
        links = classes.select(F.col("key").alias("a"), F.col("root").alias("b")).where("a <> b").unionAll(more)
        classes = tables.save(components(links, tables).select(F.col("node").alias("key"), "root"))
    return signed.select("doc_id", "text_hash", "pos", "key"), classes


def dropped_lines(occurrences: DataFrame, classes: DataFrame, tables: Tables) -> DataFrame:
    """(doc_id, text_hash, want): per document, a mark of (line number, line) for each line that an earlier one of its class replaces."""
    place = F.struct("doc_id", "text_hash", "pos")
    by_key = occurrences.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # Written, so that a class of many different lines may be split in the join.
    rooted = tables.save(by_key.join(classes, "key", "left").where("n > 1 or root is not null").select("key", "first", F.coalesce("root", "key").alias("root")))
    firsts = sized(tables.save(rooted.groupBy("root").agg(F.min("first").alias("kept"))), BROADCAST_ROWS)
    keys = tables.save(rooted.join(firsts, "root").select("key", "kept"))
    drops = occurrences.join(sized(keys, BROADCAST_ROWS), "key").where(~place.eqNullSafe(F.col("kept")))
    return tables.save(_marks(drops))


def _marks(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("pos", "key")).alias("want"))


def _listed(lists: DataFrame) -> DataFrame:
    return lists.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash", "want": "_want"})


def _copies(docs: DataFrame, occurrences: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame | None]:
    """docs without the further rows of those equal in doc_id and text, and those rows with marks of all their lines; None if there are none."""
    twice = docs.where("text is not null").groupBy(*_document()).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    twice = tables.save(twice.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}))
    if twice.isEmpty():
        return docs, None
    some = sized(twice, BROADCAST_ROWS)
    lists = _listed(_marks(occurrences.join(some, (F.col("text_hash") == some["_hash"]) & F.col("doc_id").eqNullSafe(some["_id"]), "left_semi")))
    lists = tables.save(lists.select("_id", "_hash", F.col("_want").alias("_all")))
    # Numbered as they are written: nothing else tells these rows apart.
    rows = tables.save(docs.join(lists, _of(lists)).withColumn("_row", F.monotonically_increasing_id()))
    first = rows.groupBy("_id", "_hash").agg(F.min("_row").alias("_row")).select("_row")
    keepers, others = (rows.join(first, "_row", how) for how in ("left_semi", "left_anti"))
    # Equal rows without a line that has a word need no marks and stay among the rest.
    rest = docs.join(lists.select("_id", "_hash"), _of(lists), "left_anti")
    return rest.unionByName(keepers.select(*docs.columns)), others.select(*docs.columns, F.col("_all").alias("_want"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with its columns, text without the dropped lines, plus n_lines and n_dropped; columns that were so named are replaced."""
    docs = docs.drop("n_lines", "n_dropped")
    tables = Tables(docs.sparkSession, "lines")
    occurrences, classes = line_classes(docs, tables)
    drops = _listed(dropped_lines(occurrences, classes, tables))
    docs, copies = _copies(docs, occurrences, tables)
    joined = docs.join(sized_lists(drops, "_want", BROADCAST_ROWS), _of(drops), "left").drop("_id", "_hash")
    if copies is not None:
        joined = joined.unionByName(copies)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, want = batch.column(at), batch.column(len(schema) - 2)
            n_lines = pc.add(pc.count_substring(texts, "\n"), 1).fill_null(0).cast(pa.int64())
            dropped = np.zeros(len(batch), dtype=np.int64)
            if want.null_count < len(batch):
                parts = []
                for lo, hi, data, offsets in X.blocks(texts):
                    left, dropped[lo:hi] = _without(data, offsets, want.slice(lo, hi - lo))
                    parts.append(left)
                texts = pc.if_else(texts.is_valid(), pa.concat_arrays(parts), pa.scalar(None, pa.string()))
            columns = [texts if k == at else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, n_lines, pa.array(dropped)], schema.names)

    return joined.mapInArrow(lambda batches: released(cut(batches)), schema)


def without_duplicates(docs: DataFrame) -> DataFrame:
    """docs without dropped lines; a document that thereby loses its last line with a word goes."""
    own = ("n_lines", "n_dropped", "_id", "_hash", "_want")
    kept = dedup_lines(apart(docs, *own)).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^ \t-\r]"))
    return together(kept, docs.columns)
