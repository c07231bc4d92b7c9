"""Vectorised text primitives on Arrow batches: words, lines and shingles as numpy arrays over UTF-8 bytes.

Hashes are multilinear over 64-bit words (random odd multiplier per position) with a splitmix64 finaliser.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_odd: dict[int, np.ndarray] = {}


def odd(n: int, seed: int = 0) -> np.ndarray:
    """The first n position multipliers of a seed."""
    if len(_odd.get(seed, ())) < n:
        size = max(4096, 1 << int(n - 1).bit_length())
        _odd[seed] = mix((np.arange(1, size + 1, dtype=np.uint64) + (U(seed) << U(40))) * U(0x9E3779B97F4A7C15)) | U(1)
    return _odd[seed][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    big = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64 if big else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``limit`` bytes of text, or one row."""
    _, offs = text_bytes(batch.column(batch.schema.get_field_index(text)))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def by_chunk(text: str, f: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """A mapInArrow function that applies f to chunks of every batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                out = f(part)
                if out is not None and out.num_rows:
                    yield out

    return run


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all else as it is."""
    return buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a:b + 1] = True
    return table


#: Bytes of [^\x20\x09-\x0D] and of [^\x00-\x2F\x3A-\x60\x7B-\x7F].
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def spans(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, broken at text borders."""
    prev = np.zeros(len(mask), bool)
    prev[1:] = mask[:-1]
    inner = offs[1:-1]
    prev[inner[inner < len(mask)]] = False
    nxt = np.zeros(len(mask), bool)
    nxt[:-1] = mask[1:]
    last = offs[1:] - 1
    nxt[last[last >= 0]] = False
    return np.flatnonzero(mask & ~prev), np.flatnonzero(mask & ~nxt) + 1


def blocks(size: np.ndarray, limit: int = CHUNK >> 1) -> Iterator[slice]:
    """Slices over items of the given sizes whose sizes sum to at most ``limit``, or of one item."""
    total, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, side="right")))
        yield slice(a, b)
        a = b


def gather(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the spans one after the other; temporaries are those of one block."""
    size = ends - starts
    place = np.cumsum(size) - size
    out = np.empty(int(size.sum()), buf.dtype)
    for some in blocks(size):
        n, at = size[some], int(place[some.start])
        total = int(n.sum())
        out[at:at + total] = buf[np.repeat(starts[some] - (place[some] - at), n) + np.arange(total)]
    return out


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each non-empty span of bytes; temporaries are those of one block."""
    out, size = np.zeros(len(starts), np.uint64), ends - starts
    for some in blocks(size):
        lens = size[some]
        first = np.cumsum(lens) - lens
        pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
        value = (buf[np.repeat(starts[some], lens) + pos].astype(np.uint64) + U(1)) * odd(int(lens.max()), seed)[pos]
        out[some] = np.add.reduceat(value, first) + lens.astype(np.uint64) * U(0xD6E8FEB86659FD93)
    return mix(out)


class Words:
    """Word hashes of the texts of one chunk: ``h`` by word, ``first`` the n + 1 word offsets by text."""

    def __init__(self, column: pa.Array, table: np.ndarray):
        self.raw, self.offs = text_bytes(column)
        self.buf = lower(self.raw)
        self.starts, self.ends = spans(table[self.buf], self.offs)
        self.h = span_hash(self.buf, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.offs)
        self.n = np.diff(self.first)

    def grams(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of k consecutive words of one text, the word each starts at, and n + 1 offsets by text.
        short: a text of fewer than k words, but not none, gives its whole sequence as one.
        """
        h, n = self.h, len(self.h)
        count = np.maximum(self.n - k + 1, 0)
        at = np.repeat(self.first[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        value = gram_hash(h, at, k)
        if short and (few := np.flatnonzero((self.n > 0) & (self.n < k))).size:
            extra, where = np.zeros(len(few), np.uint64), self.first[few]
            for size in range(1, k):
                same = self.n[few] == size
                extra[same] = gram_hash(h, where[same], size)
            count[few] = 1
            place = np.cumsum(count) - count
            put = np.zeros(int(count.sum()), bool)
            put[place[few]] = True
            all_value, all_at = np.zeros(len(put), np.uint64), np.zeros(len(put), np.int64)
            all_value[put], all_value[~put] = extra, value
            all_at[put], all_at[~put] = where, at
            value, at = all_value, all_at
        return value, at, np.concatenate([[0], np.cumsum(count)])


def gram_hash(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[at], ..., h[at + k - 1]; k is part of it."""
    out = np.full(len(at), k * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF, np.uint64)
    if len(at):
        for j, c in enumerate(odd(k)):
            out += h[at + j] * c
    return mix(out)


def whole_grams(column: pa.Array, table: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct k-word shingles of each text as numbers, and n + 1 offsets: equal numbers are equal words, with no hash in between. Numbers
    hold for this call alone, so texts that are to be compared come in one column. A text of fewer than k words, but not none, has its whole
    sequence as one."""
    raw, offs = text_bytes(column)
    buf = lower(raw)
    starts, ends = spans(table[buf], offs)
    first = np.searchsorted(starts, offs)
    data, bounds = gather(buf, starts, ends), np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    number, most = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary) + 1
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    place = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(n)), count)
    at = first[owner] + np.arange(place[-1]) - place[owner]
    gram, size = np.zeros(len(at), np.int64), 1
    for j in range(k):  # past the end of a short text stands a number that no word has
        inside = at + j < first[owner + 1]
        part = np.where(inside, number[np.minimum(at + j, max(len(number) - 1, 0))], most - 1) if len(at) else gram
        if size * most >= 1 << 62:
            some, gram = np.unique(gram, return_inverse=True)
            size = len(some)
        gram, size = gram * most + part, size * most
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return gram[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(n)))])


def lists(values: pa.Array | np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column from flat values and the number of them by row."""
    flat = values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of each text (split at line feeds; an empty text is one line), and lines by text."""
    feeds = np.flatnonzero(buf == 10)
    count = np.searchsorted(feeds, offs)
    return (np.sort(np.concatenate([offs[:-1], feeds + 1]), kind="stable"),
            np.sort(np.concatenate([feeds, offs[1:]]), kind="stable"), np.diff(count) + 1)
