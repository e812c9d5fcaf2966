"""Vectorised helpers over Arrow string columns: words, word hashes, word shingles.

Everything works on the UTF-8 bytes of a whole batch at once. Splitting and
lower-casing touch ASCII bytes only, which never occur inside a multi-byte
character, so the results equal those on decoded text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
#: Bytes of text that are handled at once; bounds a task's memory, not its input.
SLICE_BYTES = 2 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Keeps the bytes of a chunk that belong to a span, by their number.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], _U)
_PLACE = mix(np.arange(1001, 1001 + SHINGLE_WORDS, dtype=_U) * _U(_STEP)) | _U(1)


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes.

    Yields first row, row after the last, bytes, and offsets (one more than
    rows, from 0). A null has no bytes. One text is never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return
    _, offsets_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (one more entry than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each span as 64-bit chunks, zeros after its end, and where each span's chunks begin (one more entry than spans)."""
    length = ends - starts
    begin = np.concatenate(([0], np.cumsum((length + 7) >> 3)))
    if not begin[-1]:
        return np.zeros(0, _U), begin
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    view = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # every position's next eight bytes
    span = np.repeat(np.arange(len(starts)), np.diff(begin))
    place = (np.arange(begin[-1]) - begin[span]) << 3
    return view[starts[span] + place] & _LOW_BYTES[np.minimum(length[span] - place, 8)], begin


def chunk_hashes(chunks: np.ndarray, begin: np.ndarray, length: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each span from its chunks: each is mixed with its place, which isn't linear in the bytes.

    Equal bytes have equal hashes; different ones may collide like random
    numbers, so that whoever needs certainty compares chunks. Lanes are
    independent of one another.
    """
    place = (np.arange(len(chunks)) - np.repeat(begin[:-1], np.diff(begin))).astype(_U)
    key = mix((place + _U(1)) * _U(_STEP) + _U(lane))
    return mix(per_row(np.add, mix(mix(chunks ^ key) + key), begin) + length.astype(_U) * _U(_STEP) + _U(lane))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, see :func:`chunk_hashes`."""
    chunks, begin = span_chunks(data, starts, ends)
    return chunk_hashes(chunks, begin, ends - starts, lane)


class SpanNumbers:
    """Numbers byte spans: equal numbers exactly for equal bytes, which are compared and not only hashed.

    Spans are remembered from call to call. A span whose hash belongs to other
    bytes gets a number of its own each time it comes.
    """

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.count = 0
        self.hashes, self.number = np.zeros(0, _U), np.zeros(0, np.int64)
        self.chunks, self.place, self.length = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def full(self, more: int) -> bool:
        return len(self.hashes) > 0 and len(self.hashes) + more > self.most

    def _same(self, at: np.ndarray, chunks: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether each span has the bytes of the kept span ``at``."""
        ok = self.length[at] == length
        span = np.repeat(np.arange(len(at)), np.where(ok, np.diff(begin), 0))
        sizes = np.bincount(span, minlength=len(at))
        j = np.arange(len(span)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        differ = chunks[begin[span] + j] != self.chunks[self.place[at[span]] + j]
        ok[span[differ]] = False
        return ok

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each span, and the indices of spans whose numbers are new: self.count before the call and the ones after it, in order."""
        chunks, begin = span_chunks(data, starts, ends)
        length = ends - starts
        hashes = chunk_hashes(chunks, begin, length)
        distinct, index, back = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(find_sorted(self.hashes, distinct) < 0)
        fresh = index[new]
        if len(new):
            sizes = np.diff(begin)[fresh]
            take = np.repeat(begin[fresh] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            where = np.searchsorted(self.hashes, distinct[new])
            self.hashes = np.insert(self.hashes, where, distinct[new])
            self.number = np.insert(self.number, where, self.count + np.arange(len(new)))
            self.place = np.insert(self.place, where, len(self.chunks) + np.cumsum(sizes) - sizes)
            self.length = np.insert(self.length, where, length[fresh])
            self.chunks = np.concatenate((self.chunks, chunks[take]))
            self.count += len(new)
        at = np.searchsorted(self.hashes, distinct)[back]
        out = self.number[at]
        odd = np.flatnonzero(~self._same(at, chunks, begin, length))
        if len(odd):
            raw = data.tobytes()
            own: dict[bytes, int] = {}
            first = []
            for i in odd.tolist():
                span = raw[starts[i] : ends[i]]
                if span not in own:
                    own[span] = self.count
                    first.append(i)
                    self.count += 1
                out[i] = own[span]
            fresh = np.concatenate((fresh, np.array(first, np.int64)))
        return out, fresh


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after the other, and where each row begins (one more entry than rows).

    A shingle is ``width`` words in a row (five or fewer); a row of fewer words
    has one shingle, its whole sequence; a row without words has none.
    """
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    counts = np.diff(first)
    n_shingles = np.where(counts >= width, counts - width + 1, counts > 0).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(n_shingles)))
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], n_shingles)
    size = np.minimum(np.repeat(counts, n_shingles), width)
    padded = np.concatenate((words, np.zeros(width, _U)))
    hashes = size.astype(_U) * _U(_STEP)
    short = bool(len(size)) and int(size.min()) < width
    for k in range(width):
        part = padded[at + k] * _PLACE[k]
        hashes += np.where(size > k, part, _U(0)) if short else part
    hashes = mix(hashes)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a > 1:
            hashes[a:b].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[begin[:-1][n_shingles > 0]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return hashes[keep], kept[begin]


def per_row(ufunc: np.ufunc, values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """``ufunc`` reduced over each row's values; 0 for rows without any."""
    out = np.zeros(len(begin) - 1, values.dtype)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        out[full] = ufunc.reduceat(values, begin[full])
    return out


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: one thing at a time, so that stages in turn don't add up."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def keep_nothing() -> None:
    """For tasks that need the memory for themselves."""
    _kept.clear()


def find_sorted(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value stands in the sorted table, -1 if it doesn't."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)
