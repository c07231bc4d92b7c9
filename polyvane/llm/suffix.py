"""Removal of repeated byte strings by external induced suffix sorting over shards.

Every 200-byte window has an anchor: the leftmost of its smallest hashed 32-byte grams. Equal windows have equal anchors at equal distance,
so windows are sorted anchor by anchor, in shards, instead of all at once. Consecutive windows with one anchor are a run. Anchors
that occur once are dropped first; equal runs are combined, within a chunk, within a map task, and over all.

In a shard the suffixes that start at the anchors are the sampled ones. They are sorted by recursion: strings of words become strings of names
half as long, and so on. Each then gets the length of its common prefix with the one before. All other suffixes are induced, one byte to
the left at a time: suffixes go, in order, to the queue of their (anchor, preceding byte); reading the queues in order gives the order one
step on. The common prefix of queue neighbours is one more than the least one between them in the step before, so no bytes are
compared again. A window that has 200 bytes in common with a neighbour is repeated.

Shards are sized by bytes (``SHARD``), several times what a task sorts in memory (``BLOCK``). A shard that goes beyond ``BLOCK`` is sorted on disk
as a whole (``External``): tuples (suffix, common prefix) go through priority queues that spill sorted runs and merge them, and no more than a
part of them is in memory at once. Suffixes of all its anchors share the queues: windows at one distance that are equal have one anchor, and order and
prefixes hold across anchors too. Only an anchor that is itself larger than a few shards (``HOT`` distinct runs) is first split over tasks, by
distance and shared bytes, again and again while it is hot.

Repeated windows are given back to the texts that hold them; kept bytes are what no repeated window covers.

Defined cases: null counts as empty; texts shorter than 200 bytes keep everything; rows that repeat a text share its result; kept bytes that
are no longer UTF-8 stay bytes (``kept`` is binary); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvane.llm.filters import BitFilter
from polyvane.llm.textvec import U, by_chunk, chunks, gather, lists, mix, odd, span_hash, text_bytes
from polyvane.llm.work import Work

MATCH, GRAM = 200, 32
#: Bytes of runs sorted in memory, beyond which a shard is sorted on disk; bytes of a long text winnowed at once.
BLOCK, SEGMENT = 8 << 20, 2 << 20
#: Bytes of a shard, at most, and the most shards; beyond that many shards grow, on disk.
SHARD, MAX_SHARDS = 64 << 20, 20_000
#: Distinct runs of an anchor (up to 400 bytes each) beyond which it is split, and by how many distances at a time; hot anchors that are broadcast.
HOT, WIDTHS, MAX_BROADCAST = 1 << 18, (32, 8, 1), 500_000
#: An accumulator, where set, of the bytes of runs that went through the queues on disk.
QUEUED = None


def _runs_of(buf: np.ndarray, offs: np.ndarray, match: int) -> tuple[np.ndarray, ...]:
    """Runs of one buffer below 16 MB: first window, windows, distance of the first to the anchor, anchor hash."""
    none = np.zeros(0, np.int64)
    gram = min(GRAM, match)
    width = match - gram + 1
    if len(buf) < match:
        return none, none, none, np.zeros(0, np.uint64)
    h, size, base = buf.astype(np.uint64) + U(1), 1, int(odd(1)[0])
    while size < gram:  # hash of 2 * size bytes from two of size bytes; the last step may overlap
        step = min(size, gram - size)
        h = h[:-step] * U(pow(base, size, 1 << 64)) + h[step:]
        size += step
    h = mix(h)
    low = (h & ~U(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    n = len(low)
    left = np.zeros(len(buf) + 1, np.int64)  # whether a window of one text starts there
    full = np.diff(offs) >= match
    np.add.at(left, offs[:-1][full], 1)
    np.add.at(left, offs[1:][full] - match + 1, -1)
    valid = np.cumsum(left)[:n] > 0
    cut = np.ones(n, bool)
    cut[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
    first = np.flatnonzero(cut & valid)
    stop = np.ones(n, bool)
    stop[:-1] = cut[1:] | ~valid[1:]
    last = np.flatnonzero(stop & valid)
    at = (low[first] & U(0xFFFFFF)).astype(np.int64)
    # anchors are minima, so their hashes crowd at the low end; mixed once more they are spread evenly over keys and filter bits
    return first, last - first + 1, at - first, mix(h[at])


def runs(buf: np.ndarray, offs: np.ndarray, match: int) -> tuple[np.ndarray, ...]:
    if len(buf) <= SEGMENT:
        return _runs_of(buf, offs, match)
    parts = []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        for x in range(a, max(b - match + 1, a + 1), SEGMENT):
            y = min(x + SEGMENT + match - 1, b)
            first, *rest = _runs_of(buf[x:y], np.array([0, y - x]), match)
            parts.append((first + x, *rest))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _least(lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(lcp[a + 1 .. b]) for a < b, by doubling."""
    gap = b - a
    level = np.zeros(len(gap), np.int64)
    big = gap > 1
    level[big] = np.log2(gap[big]).astype(np.int64)
    out, table = np.empty(len(gap), lcp.dtype), lcp
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            table = np.minimum(table[:-(1 << (k - 1))], table[1 << (k - 1):])
        here = level == k
        out[here] = np.minimum(table[a[here] + 1], table[b[here] - (1 << k) + 1])
    return out


def by_names(words: np.ndarray) -> np.ndarray:
    """Order of the rows, by recursion on reduced strings: each pair of neighbouring columns is named by its rank, and the strings of names, half as
    long, are sorted the same way, until a first name tells all rows apart or is all that is left.
    """
    m, k = words.shape
    if k == 1:
        return np.argsort(words[:, 0], kind="stable")
    names = np.empty((m, (k + 1) // 2), np.uint64)
    for c in range(0, k - 1, 2):
        order = np.lexsort((words[:, c + 1], words[:, c]))
        x, y = words[order, c], words[order, c + 1]
        names[order, c // 2] = np.concatenate([[0], np.cumsum((x[1:] != x[:-1]) | (y[1:] != y[:-1]))])
        if not c and names[order[-1], 0] == m - 1:
            return order
    if k % 2:
        names[:, -1] = words[:, -1]
    return by_names(names)


def contexts(text: np.ndarray, at: np.ndarray, stop: np.ndarray, match: int) -> np.ndarray:
    """The ``match`` bytes from each place on, 0 from ``stop`` on and up to a multiple of eight."""
    width = -(-match // 8) * 8
    out = np.zeros((len(at), width), np.uint8)
    step = max(1, BLOCK // (8 * width))  # positions are eight bytes each
    for a in range(0, len(at), step):
        some = slice(a, a + step)
        place = at[some, None] + np.arange(width)
        out[some] = np.where((place < stop[some, None]) & (np.arange(width) < match), text[np.minimum(place, len(text) - 1)], 0)
    return out


def prefixes(sorted_rows: np.ndarray, before: np.ndarray | None, match: int) -> np.ndarray:
    """Common prefix of each row with the one before; ``before`` is that of the first, if there is one."""
    lcp = np.zeros(len(sorted_rows), np.uint8)
    for a in range(0, len(sorted_rows), 1 << 14):
        now = sorted_rows[a:a + (1 << 14)]
        last = np.concatenate([sorted_rows[a - 1:a] if a else now[:1] if before is None else before[None], now[:-1]])
        differ = now != last
        lcp[a:a + len(now)] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), match), match)
    if before is None and len(lcp):
        lcp[0] = 0
    return lcp


class Shard:
    """Runs of whole anchors, in memory: text, and by run its start in it, length, anchor distance and anchor number."""

    def __init__(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, off: np.ndarray, group: np.ndarray, match: int):
        self.text, self.start, self.size, self.off, self.group, self.match = text, start, size, off, group, match
        self.windows = size - match + 1
        self.base = np.cumsum(self.windows) - self.windows
        self.nearest = off - self.windows + 1  # distance of the last window to the anchor

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes at the anchors, and common prefixes with the one before (0 across anchors)."""
        context = contexts(self.text, self.start + self.off, self.start + self.size, self.match)
        order = by_names(np.concatenate([self.group[:, None].astype(np.uint64), context.view(">u8").astype(np.uint64)], axis=1))
        lcp = np.zeros(len(order), np.uint8)
        for a in range(0, len(order), 1 << 14):  # sorted a part at a time: contexts are the largest arrays here
            part = order[max(a - 1, 0):a + (1 << 14)]
            lcp[a:a + (1 << 14)] = prefixes(context[part], None, self.match)[1 if a else 0:]
        lcp[1:][self.group[order[1:]] != self.group[order[:-1]]] = 0
        return order, lcp

    def repeated(self, twice: np.ndarray) -> np.ndarray:
        """A flag for each window, run by run; ``twice`` marks runs that occur more than once as they are."""
        flags = np.repeat(twice, self.windows)
        order, lcp = self.seeds()
        for d in range(int(self.off.max(initial=-1)) + 1):
            if d:
                live = np.flatnonzero(self.off[order] >= d)
                if not len(live):
                    break
                lcp, _ = thin(lcp, live, MOST)
                order, lcp = self._induce(order[live], lcp, d)
            live = np.flatnonzero(self.nearest[order] <= d)
            if len(live):
                near, _ = thin(lcp, live, MOST)
                at, same = order[live], near >= self.match
                same[0] = False
                hit = at[same | np.concatenate([same[1:], [False]])]
                flags[self.base[hit] + self.off[hit] - d] = True
        return flags

    def _induce(self, order: np.ndarray, lcp: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """One step to the left: stable distribution to the queues of (anchor, preceding byte)."""
        byte = self.text[self.start[order] + self.off[order] - d].astype(np.int64)
        key = self.group[order] * 256 + byte
        to = np.argsort(key, kind="stable")
        same = key[to][1:] == key[to][:-1]
        new = np.zeros(len(to), np.uint8)
        a, b = to[:-1][same], to[1:][same]
        new[1:][same] = np.minimum(_least(lcp, a, b).astype(np.int64) + 1, self.match)
        return order[to], new


#: Above every common prefix.
MOST = 255


def thin(lcp: np.ndarray, live: np.ndarray, carry: int) -> tuple[np.ndarray, int]:
    """Common prefixes of the suffixes that stay with those that stayed before, and the least prefix after the last of them; ``carry`` is
    what the part before left over.
    """
    if not len(live):
        return lcp[:0], int(lcp.min(initial=carry))
    out = np.minimum.reduceat(lcp[:live[-1] + 1], np.concatenate([[0], live[:-1] + 1]))
    out[0] = min(out[0], carry)
    return out, int(lcp[live[-1] + 1:].min(initial=MOST))


class Queue:
    """A priority queue on disk, for tuples in bulk: a batch is pushed sorted, as a run of its own in a file, and ``drain`` merges the runs a
    part at a time, ``fan`` at once.
    """

    def __init__(self, folder: str, kind: np.dtype, part: int, fan: int = 64):
        self.file, self.kind, self.part, self.fan = tempfile.TemporaryFile(dir=folder), kind, part, fan
        self.end, self.runs = 0, []

    def _write(self, rows: np.ndarray) -> None:
        raw = memoryview(np.ascontiguousarray(rows)).cast("B")
        while len(raw):
            done = os.pwrite(self.file.fileno(), raw, self.end)
            self.end, raw = self.end + done, raw[done:]

    def push(self, rows: np.ndarray) -> None:
        if len(rows):
            self.runs.append((self.end, len(rows)))
            self._write(rows)

    def drain(self) -> Iterator[np.ndarray]:
        while len(self.runs) > self.fan:
            some, self.runs = self.runs[:self.fan], self.runs[self.fan:]
            begin = self.end
            for rows in self._merge(some):
                self._write(rows)
            self.runs.append((begin, (self.end - begin) // self.kind.itemsize))
        yield from self._merge(self.runs)
        self.file.close()

    def _merge(self, runs: list[tuple[int, int]]) -> Iterator[np.ndarray]:
        part, size = max(1, self.part // max(len(runs), 1)), self.kind.itemsize
        place, left, held = [p for p, _ in runs], [n for _, n in runs], [np.zeros(0, self.kind) for _ in runs]
        while any(left) or any(len(x) for x in held):
            for k in range(len(runs)):
                if not len(held[k]) and left[k]:
                    held[k] = np.frombuffer(os.pread(self.file.fileno(), min(part, left[k]) * size, place[k]), self.kind)
                    place[k], left[k] = place[k] + len(held[k]) * size, left[k] - len(held[k])
            # all that is not above the last key of any run that goes on can come out
            bound = min((x["key"][-1] for x, n in zip(held, left, strict=True) if n), default=None)
            cut = [len(x) if bound is None else int(np.searchsorted(x["key"], bound, side="right")) for x in held]
            rows = np.concatenate([x[:c] for x, c in zip(held, cut, strict=True)])
            held = [x[c:] for x, c in zip(held, cut, strict=True)]
            yield rows[np.argsort(rows["key"], kind="stable")] if len(runs) > 1 else rows


class External:
    """The distinct runs of a shard, however many, on disk: batches come in by ``add`` and are not kept.

    Tuples (anchor suffix, run) wait in a queue that sorts them; then, one byte to the left at a time, tuples (preceding byte, place, run, common prefix) go
    through a queue each. The preceding bytes lie in a file by distance. In memory are, besides the parts at hand, a run's distance, number
    of windows, preceding byte and flag of one step: about ten bytes a run.
    """

    def __init__(self, match: int, part: int = 1 << 18, fan: int = 64):
        self.match, self.part, self.few, self.fan, self.m = match, max(64, part // 64 * 64), max(8, part // 128 * 8), fan, 0
        self.scratch = tempfile.TemporaryDirectory(prefix="suffix-")
        self.width = -(-match // 8) * 8
        self.seeds = Queue(self.scratch.name, np.dtype([("key", f"S{self.width}"), ("run", "<i8")]), self.few, fan)
        self.left, self.names = self._file(), self._file()
        self.off, self.nearest, self.twice = [], [], []

    def _file(self):
        return tempfile.TemporaryFile(dir=self.scratch.name)

    def add(self, table: pa.Table) -> None:
        for a in range(0, table.num_rows, self.few):
            self._add(table.slice(a, self.few))

    def _add(self, table: pa.Table) -> None:
        text, offs = region_bytes(table)
        start, off = offs[:-1], table["off"].to_numpy().astype(np.int64)
        context = contexts(text, start + off, offs[1:], self.match)
        order = by_names(context.view(">u8").astype(np.uint64))
        rows = np.empty(len(order), self.seeds.kind)
        rows["key"], rows["run"] = context[order].view(f"S{self.width}").reshape(-1), self.m + order
        self.seeds.push(rows)
        for a in range(0, len(off), 2048):
            back = off[a:a + 2048, None] - np.arange(1, self.match)
            np.where(back >= 0, text[np.maximum(start[a:a + 2048, None] + back, 0)], 0).astype(np.uint8).tofile(self.left)
        np.stack([table[c].to_numpy() for c in ("r1", "r2")], 1).tofile(self.names)
        self.off.append(off.astype(np.int16))
        self.nearest.append((off - (np.diff(offs) - self.match)).astype(np.int16))
        self.twice.append(table["n"].to_numpy() > 1)
        self.m += len(off)

    def _columns(self) -> None:
        """Preceding bytes by distance instead of by run."""
        out, wide = self._file(), self.match - 1
        self.left.seek(0)
        for a in range(0, self.m, self.few):
            rows = np.frombuffer(self.left.read(self.few * wide), np.uint8).reshape(-1, wide)
            for d in range(int(self.off.max())):
                os.pwrite(out.fileno(), rows[:, d].tobytes(), d * self.m + a)
        self.left = out

    def spans(self) -> Iterator[pa.RecordBatch]:
        """(r1, r2, lo, hi) of repeated windows, run by run."""
        self.off, self.nearest, self.twice = np.concatenate(self.off), np.concatenate(self.nearest), np.concatenate(self.twice)
        self._columns()
        flags, last = self._file(), int(self.off.max())
        now = self._in_order()
        for d in range(last + 1):
            flag = np.zeros(self.m, bool)
            now = self._spill(self._marked(now if not d else self._induced(now, d), d, flag))
            os.pwrite(flags.fileno(), np.packbits(flag, bitorder="little").tobytes(), d * -(-self.m // 8))
        yield from self._found(flags, last)
        self.scratch.cleanup()

    STEP = np.dtype([("run", "<i8"), ("near", "u1")])

    def _spill(self, parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        """A step's tuples, in order, to a file, to be read for the next one."""
        out = self._file()
        for rows in parts:
            rows.tofile(out)
        out.flush()
        out.seek(0)

        def read() -> Iterator[np.ndarray]:
            while raw := out.read(self.part * self.STEP.itemsize):
                yield np.frombuffer(raw, self.STEP)

        return read()

    def _in_order(self) -> Iterator[np.ndarray]:
        before = None
        for rows in self.seeds.drain():
            text = np.frombuffer(rows["key"].tobytes(), np.uint8).reshape(-1, self.width)
            out = np.empty(len(rows), self.STEP)
            out["run"], out["near"] = rows["run"], prefixes(text, before, self.match)
            before = text[-1] if len(text) else before
            yield out

    def _induced(self, parts: Iterator[np.ndarray], d: int) -> Iterator[np.ndarray]:
        """One step to the left. A tuple's prefix is one more than the least since the last tuple that went to the same queue."""
        column = np.frombuffer(os.pread(self.left.fileno(), self.m, (d - 1) * self.m), np.uint8)
        queue = Queue(self.scratch.name, np.dtype([("key", "<u8"), ("run", "<i8"), ("near", "u1")]), self.part, self.fan)
        carry, least, seen, place = MOST, np.full(256, MOST), np.zeros(256, bool), 0
        for rows in parts:
            live = np.flatnonzero(self.off[rows["run"]] >= d)
            near, carry = thin(rows["near"], live, carry)
            if not len(live):
                continue
            run = rows["run"][live]
            byte = column[run]
            to = np.argsort(byte, kind="stable")
            same = byte[to][1:] == byte[to][:-1]
            value = np.zeros(len(to), np.int64)
            value[1:][same] = _least(near, to[:-1][same], to[1:][same]).astype(np.int64) + 1
            head = np.concatenate([[True], ~same])
            lead, tail = to[head], to[np.concatenate([~same, [True]])]
            since = np.minimum.accumulate(near)
            own = byte[lead]
            value[head] = np.where(seen[own], np.minimum(least[own], since[lead]) + 1, 0)
            until = np.append(np.minimum.accumulate(near[::-1])[::-1], MOST)
            least = np.minimum(least, since[-1])
            least[byte[tail]] = until[tail + 1]
            seen[own] = True
            out = np.empty(len(to), queue.kind)
            out["key"], out["run"], out["near"] = byte[to].astype(np.uint64) << U(48) | (place + to).astype(np.uint64), run[to], np.minimum(value, self.match)
            queue.push(out)
            place += len(to)
        for rows in queue.drain():
            out = np.empty(len(rows), self.STEP)
            out["run"], out["near"] = rows["run"], rows["near"]
            yield out

    def _marked(self, parts: Iterator[np.ndarray], d: int, flag: np.ndarray) -> Iterator[np.ndarray]:
        """Passes a step's tuples on; flags runs whose window at distance d equals that of a neighbour."""
        carry, before = MOST, -1
        for rows in parts:
            live = np.flatnonzero(self.nearest[rows["run"]] <= d)
            near, carry = thin(rows["near"], live, carry)
            if len(live):
                at, same = rows["run"][live], near >= self.match
                if before < 0:
                    same[0] = False
                flag[at[same]] = True
                flag[np.concatenate([[before], at[:-1]])[same]] = True
                before = int(at[-1])
            yield rows

    def _found(self, flags, last: int) -> Iterator[pa.RecordBatch]:
        self.names.seek(0)
        for a in range(0, self.m, self.few):
            n = min(self.few, self.m - a)
            names = np.frombuffer(self.names.read(16 * n), np.int64).reshape(-1, 2)
            bits = [np.unpackbits(np.frombuffer(os.pread(flags.fileno(), -(-n // 8), d * -(-self.m // 8) + a // 8), np.uint8), bitorder="little")[:n] for d in range(last + 1)]
            d, off = np.arange(last + 1), self.off[a:a + n, None]
            hit = np.stack(bits, 1).astype(bool) | (self.twice[a:a + n, None] & (d <= off) & (d >= self.nearest[a:a + n, None]))
            edge = np.zeros((n, 1), bool)
            run, near = np.nonzero(hit & ~np.concatenate([edge, hit[:, :-1]], 1))
            _, far = np.nonzero(hit & ~np.concatenate([hit[:, 1:], edge], 1))
            # windows count from the left end of the run, distances from the anchor
            yield pa.RecordBatch.from_arrays([pa.array(names[run, 0]), pa.array(names[run, 1]), pa.array((off[run, 0] - far).astype(np.int32)), pa.array((off[run, 0] - near + 1).astype(np.int32))], ["r1", "r2", "lo", "hi"])


def region_bytes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the column ``region`` and their borders."""
    region = table["region"]
    region = (region.combine_chunks() if isinstance(region, pa.ChunkedArray) else region).cast(pa.large_binary())
    offs = np.frombuffer(region.buffers()[1], np.int64)[region.offset:region.offset + len(region) + 1]
    return np.frombuffer(region.buffers()[2], np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def _sort_shard(match: int, block: int | None = None):
    block, queued = BLOCK if block is None else block, QUEUED

    def flush(table: pa.Table) -> pa.RecordBatch:
        text, offs = region_bytes(table)
        _, group = np.unique(table["a"].to_numpy(), return_inverse=True)
        shard = Shard(text, offs[:-1], np.diff(offs), table["off"].to_numpy().astype(np.int64), group, match)
        flags = shard.repeated(table["n"].to_numpy() > 1)
        edge = np.zeros(len(flags) + 1, bool)
        edge[shard.base] = True
        start = np.flatnonzero(flags & ~(np.concatenate([[False], flags[:-1]]) & ~edge[:-1]))
        stop = np.flatnonzero(flags & ~(np.concatenate([flags[1:], [False]]) & ~edge[1:])) + 1
        run = np.searchsorted(shard.base, start, side="right") - 1
        rows = pa.array(run)
        return pa.RecordBatch.from_arrays([table[c].combine_chunks().take(rows) for c in ("r1", "r2")] + [pa.array((x - shard.base[run]).astype(np.int32)) for x in (start, stop)], ["r1", "r2", "lo", "hi"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, disk = 0, None
        for batch in batches:
            size += batch.column(2).nbytes
            held.append(batch)
            if size > block:  # from here on the shard is sorted on disk
                disk = disk or External(match)
                for x in held:
                    disk.add(pa.Table.from_batches([x]))
                held = []
        if disk is not None:
            yield from disk.spans()
            if queued is not None:
                queued.add(size)
        elif held:
            yield flush(pa.Table.from_batches(held))

    return sort


def _repeated_runs(runs: DataFrame, work: Work, match: int, widths: tuple[int, ...] = WIDTHS, hot: int = HOT) -> DataFrame:
    """(r1, r2, lo, hi): repeated windows of runs(a, off, region, r1, r2, n).

    An anchor of more than ``hot`` distinct runs is split: windows are grouped by their distance to the anchor, ``widths[0]`` distances a group, and by
    the bytes that all windows of the group share. Equal windows stay together. What is still hot is split by the next width; at a width
    of one a group is one window.
    """
    name, whole = f"w{len(widths)}", ["a", "off", "region", "r1", "r2"]

    def sort(rows: DataFrame) -> DataFrame:
        distinct = rows.groupBy(*whole).agg(F.sum("n").alias("n")).repartition(shards, "a")
        return distinct.mapInArrow(_sort_shard(match), "r1 long, r2 long, lo int, hi int")

    anchors = work.table(runs.groupBy("a").agg(F.countDistinct("r1").alias("c")), f"sizes-{name}")
    total, n = anchors.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > hot, 1))).first()
    shards = max(1, min(MAX_SHARDS, -(-total * 2 * match // SHARD)))
    if not widths or not n:
        return work.table(sort(runs), f"spans-{name}")
    many = anchors.where(F.col("c") > hot).select("a")
    many = F.broadcast(many) if n <= MAX_BROADCAST else many.hint("merge")
    heavy = runs.join(many, "a", "left_semi").groupBy(*whole).agg(F.sum("n").alias("n"))
    step, size = widths[0], F.length("region")
    lo = F.explode(F.sequence(F.floor(F.greatest(F.col("off") - size + match, F.lit(0)) / step) * step, F.col("off").cast("long"), F.lit(step).cast("long"))).alias("lo")
    parts = heavy.select(*whole, "n", lo).withColumn("far", F.least(F.col("lo") + step - 1, "off").cast("int")).withColumn("near", F.greatest("lo", F.col("off") - F.length("region") + match).cast("int"))
    cut = lambda a, n: F.substring("region", (F.col("off") + a + 1).cast("int"), n.cast("int"))
    shared = F.xxhash64("a", "lo", cut(-F.col("lo"), F.col("lo")), cut(F.lit(0), F.lit(match) - F.col("lo") - step + 1))
    parts = parts.select("r1", "r2", "n", (F.col("off") - F.col("far")).alias("shift"), shared.alias("b"), F.col("far").alias("d"), cut(-F.col("far"), F.col("far") - F.col("near") + match).alias("part"))
    parts = work.table(parts.withColumn("s1", F.xxhash64("b", "d", "part")).withColumn("s2", F.xxhash64(F.lit(1), "part", "d", "b")), f"parts-{name}")
    below = _repeated_runs(parts.select(F.col("b").alias("a"), F.col("d").alias("off"), F.col("part").alias("region"), F.col("s1").alias("r1"), F.col("s2").alias("r2"), "n"), work, match, widths[1:], hot)
    back = parts.select("r1", "r2", "s1", "s2", "shift").join(below.toDF("s1", "s2", "lo", "hi"), ["s1", "s2"]).select("r1", "r2", (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi"))
    return work.table(sort(runs.join(many, "a", "left_anti")).unionByName(back), f"spans-{name}")


def repeated_spans(texts: DataFrame, work: Work, match: int = MATCH) -> DataFrame:
    """(key, starts, ends) for the texts(key, text) that hold repeated windows; spans may overlap. Rows with one key are one
    text that occurs so often.
    """
    spark = texts.sparkSession

    def anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = text_bytes(batch.column(1))
        value, n = np.unique(runs(buf, offs, match)[3], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["a", "n"])

    counted = texts.mapInArrow(by_chunk("text", anchors), "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    again = work.table(counted.where("n > 1").select("a"), "anchors")
    shared = spark.sparkContext.broadcast(BitFilter(again, "a", again.count()))

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        buf, offs = text_bytes(batch.column(1))
        first, count, off, a = runs(buf, offs, match)
        some = np.flatnonzero(shared.value(a))
        if not len(some):
            return None
        first, count, off, a = first[some], count[some], off[some], a[some]
        stop = first + count + match - 1
        r1, r2 = span_hash(buf, first, stop), span_hash(buf, first, stop, 1)
        doc = np.searchsorted(offs, first, side="right") - 1
        order = np.lexsort((first, r2, r1))
        new = np.ones(len(order), bool)
        new[1:] = (r1[order][1:] != r1[order][:-1]) | (r2[order][1:] != r2[order][:-1])
        lead, n = order[new], np.diff(np.concatenate([np.flatnonzero(new), [len(order)]]))
        size = (stop - first)[lead]
        data = gather(buf, first[lead], stop[lead])
        region = pa.BinaryArray.from_buffers(pa.binary(), len(lead), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(a[lead].view(np.int64)), pa.array(off[lead].astype(np.int32)), region, pa.array(r1[lead].view(np.int64)), pa.array(r2[lead].view(np.int64)), pa.array(n),
                                           lists(batch.column(0).take(pa.array(doc[order])), n), lists((first - offs[doc])[order].astype(np.int32), n)], ["a", "off", "region", "r1", "r2", "n", "keys", "starts"])

    found = work.table(texts.mapInArrow(by_chunk("text", emit), "a long, off int, region binary, r1 long, r2 long, n long, keys array<binary>, starts array<int>").join(again, "a", "left_semi"), "runs")
    spans = _repeated_runs(found.select("a", "off", "region", "r1", "r2", "n"), work, match)
    held = found.select("r1", "r2", F.explode(F.arrays_zip("keys", "starts")).alias("x")).select("r1", "r2", "x.keys", "x.starts")
    hits = held.join(spans, ["r1", "r2"]).select(F.col("keys").alias("key"), (F.col("starts") + F.col("lo")).alias("s"), (F.col("starts") + F.col("hi") + match - 1).alias("e")).distinct()
    out = hits.groupBy("key").agg(F.collect_list("s").alias("starts"), F.collect_list("e").alias("ends"))
    out = work.table(out, "hits")
    work.drop("anchors", "runs")
    return out


def remove_repeats(docs: DataFrame, match: int = MATCH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the id, n_bytes, n_removed, starts and ends of the removed runs, kept (binary; null where nothing was removed),
    sha256 of the text.
    """
    work = Work(docs.sparkSession, "suffix")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), body.alias("text"), F.unhex(F.sha2(body, 256)).alias("sha256")).withColumn("key", F.substring("sha256", 1, 16))
    spans = repeated_spans(rows.select("key", "text"), work, match)
    shared = docs.sparkSession.sparkContext.broadcast(BitFilter(spans.select(F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long").alias("h")), "h", spans.count()))

    def concerned(batches):
        for batch in batches:
            key = batch.column(0)
            flat = np.frombuffer(key.buffers()[2], np.uint8)[np.frombuffer(key.buffers()[1], np.int32)[key.offset]:][:16 * len(key)].reshape(-1, 16)
            part = batch.filter(pa.array(shared.value(flat[:, :8].copy().view(">u8").reshape(-1).astype(np.uint64))))
            if part.num_rows:
                yield part

    def cut(batches):
        for whole in batches:
            for batch in chunks(whole, "text"):
                buf, offs = text_bytes(batch.column(1))
                cover = np.zeros(len(buf) + 1, np.int64)
                for c, sign in ((2, 1), (3, -1)):
                    row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(c).offsets.to_numpy()))
                    np.add.at(cover, offs[row] + batch.column(c).flatten().to_numpy(), sign)
                gone = np.cumsum(cover)[:-1] > 0
                size = np.concatenate([[0], np.cumsum(~gone)])[offs].astype(np.int32)
                edge = np.zeros(len(buf) + 1, bool)
                edge[offs] = True
                start = np.flatnonzero(gone & ~(np.concatenate([[False], gone[:-1]]) & ~edge[:-1]))
                stop = np.flatnonzero(gone & ~(np.concatenate([gone[1:], [False]]) & ~edge[1:])) + 1
                doc = np.searchsorted(offs, start, side="right") - 1
                count = np.bincount(doc, minlength=batch.num_rows)
                kept = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(size), pa.py_buffer(buf[~gone])])
                yield pa.RecordBatch.from_arrays([batch.column(0), kept, lists((start - offs[doc]).astype(np.int32), count), lists((stop - offs[doc]).astype(np.int32), count)], ["key", "kept", "starts", "ends"])

    texts = rows.select("key", "text").mapInArrow(concerned, "key binary, text string").groupBy("key", "text").agg(F.count("*").alias("n")).select("key", "text")
    done = texts.join(spans, "key").select("key", "text", "starts", "ends").mapInArrow(cut, "key binary, kept binary, starts array<int>, ends array<int>")
    done = work.table(done, "done")
    small = rows.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes"), "sha256")
    none = F.array().cast("array<int>")
    return small.join(done, "key", "left").select(F.col("id").alias(doc_id), "n_bytes", (F.col("n_bytes") - F.coalesce(F.length("kept"), "n_bytes")).alias("n_removed"),
                                                  F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"), "kept", "sha256")
