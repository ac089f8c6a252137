"""Benchmark passages in texts: q-gram lemma filtering over diagonal bands, then banded alignment."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, pieces

#: Bytes of a q-gram: of segments of ``LONG`` bytes or more, and of those of ``SHORT`` or more.
Q, LONG, SHORT_Q, SHORT = 10, 30, 5, 10
#: An item of fewer bytes must stand between white space.
WHOLE = 20
TABLE_BITS = 22
#: Bytes of a text that are searched at a time, and occurrences of its q-grams in segments that are listed at a time.
STRETCH, HITS = 1 << 19, 1 << 18
#: Comparisons of one text that are remembered.
SEEN = 1 << 16


def normal(text: bytes | None) -> bytes:
    """A-Z lower-cased, white space as single spaces."""
    return b" ".join((text or b"").lower().split())


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The q-grams (of 10 or 5 bytes) as 64-bit numbers, from those of two, four and eight bytes."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    two = data[:-1].astype(np.uint64) << np.uint64(8) | data[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    if q == SHORT_Q:
        return four[:n] << np.uint64(8) | data[4:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    with np.errstate(over="ignore"):
        return eight[:n] * np.uint64(0xBF58476D1CE4E5B9) + two[q - 2 :] * np.uint64(0x94D049BB133111EB)


def slot(code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Index:
    """Segments ``(item, bytes)`` and where their q-grams occur; a segment of m bytes may have ``rate`` m edits."""

    def __init__(self, parts: list[tuple[int, bytes]], q: int = Q, rate: float = 0.075):
        self.q = q
        self.item = np.array([p[0] for p in parts], np.int64)
        self.text = [np.frombuffer(p[1], np.uint8) for p in parts]
        self.m = np.array([len(t) for t in self.text], np.int64)
        self.k = np.minimum((self.m * rate).astype(np.int64), (self.m - q) // q)  # the lemma needs one q-gram that is left
        self.need = self.m - q + 1 - self.k * q
        #: Diagonals and text that hold all q-grams of one band.
        self.reach = int((self.m + 2 * self.k).max(initial=0)) + 1
        code = [grams(t, q) for t in self.text]
        flat = np.concatenate(code) if code else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(code)), [len(c) for c in code]) if code else np.zeros(0, np.int64)
        offset = np.concatenate([np.arange(len(c)) for c in code]) if code else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.codes, first, times = np.unique(flat[order], return_index=True, return_counts=True)
        self.owner, self.offset = owner[order], offset[order]
        #: Occurrences in order of q-gram, then segment.
        self.place = np.repeat(np.arange(len(self.codes)), times) * len(parts) + self.owner
        self.first = np.concatenate((first, [len(flat)]))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[slot(self.codes)] = True


class Searched:
    """A block of items: indexes of their segments, and items of under ``SHORT`` bytes by their words.

    An item is cut into segments of ``size`` bytes, half overlapping, so that a copied part of 1.5 ``size`` bytes holds a whole
    one; a shorter item is one segment.
    """

    def __init__(self, items: list[tuple[int, bytes]], size: int = 80, rate: float = 0.075):
        if not LONG <= size < Q + 128:
            raise ValueError(f"segments have {LONG} to {Q + 127} bytes")  # a q-gram's offset has seven bits
        parts, self.words = [], {}
        for item, text in items:
            text = normal(text)
            if 0 < len(text) < SHORT:
                self.words.setdefault(text, []).append(item)
            elif text:
                last = max(0, len(text) - size)
                parts += [(item, text[a : a + size]) for a in sorted({*range(0, last, size // 2), last})]
        self.runs = sorted({w.count(b" ") + 1 for w in self.words})
        long, short = [p for p in parts if len(p[1]) >= LONG], [p for p in parts if len(p[1]) < LONG]
        self.indexes = [Index(p, q, rate) for p, q in ((long, Q), (short, SHORT_Q)) if p]


def crowded(data: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Places of the text's q-grams that segments have, and their numbers, where there are enough for the least demanding segment."""
    code = grams(data, index.q)
    maybe = np.flatnonzero(index.table[slot(code)])
    least, none = int(index.need.min()), np.zeros(0, np.int64)
    if len(maybe) < least:
        return none, none
    ok = np.flatnonzero(maybe[least - 1 :] - maybe[: len(maybe) - least + 1] <= index.reach)
    edge = np.zeros(len(maybe) + 1, np.int64)
    edge[ok] += 1
    np.add.at(edge, ok + least, -1)
    maybe = maybe[np.cumsum(edge[:-1]) > 0]
    place = np.searchsorted(index.codes, code[maybe])
    place[place == len(index.codes)] = 0
    true = index.codes[place] == code[maybe]
    return maybe[true], place[true]


def candidates(data: np.ndarray, index: Index, done: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Segments and first diagonals of the bands with enough common q-grams, some at a time; those of segments that are ``done`` by then are left out.

    An alignment within k edits keeps m - q + 1 - kq q-grams, whose diagonals (place in the text
    minus place in the segment) span k at most, so one of the bands of width 2k + 1 that start
    every k + 1 diagonals has them all. Occurrences are listed ``HITS`` at a time: a text with more is halved,
    with the reach of a band in both halves, and where it is that short already, the segments are.
    """
    for start in range(0, max(1, len(data)), STRETCH):
        at, place = crowded(data[start : start + STRETCH + index.reach + index.q], index)
        todo = [(at, place, 0, len(index.m))] if len(at) else []
        while todo:
            at, place, low, high = todo.pop()
            if done[low:high].all():
                continue
            begin = np.searchsorted(index.place, place * len(index.m) + low) if low else index.first[place]
            n = (np.searchsorted(index.place, place * len(index.m) + high) if high < len(index.m) else index.first[place + 1]) - begin
            total, span = int(n.sum()), int(at[-1] - at[0])
            if total > HITS and span > 4 * index.reach:
                middle = int(at[0]) + span // 2
                left, right = np.searchsorted(at, (middle + index.reach, middle))
                todo += [(at[x], place[x], low, high) for x in (slice(right, None), slice(0, left)) if len(at[x])]
            elif total > HITS and high - low > 1:
                todo += [(at, place, (low + high) // 2, high), (at, place, low, (low + high) // 2)]
            elif total:
                which = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(total)
                seg = index.owner[which]
                open_ = ~done[seg]
                if open_.any():
                    seg, diagonal = _banded(seg[open_], np.repeat(at, n)[open_], index.offset[which[open_]], index)
                    if len(seg):
                        yield seg, diagonal + start


def _banded(seg: np.ndarray, at: np.ndarray, offset: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    base = 1 << 20
    band = (at - offset + base) // (index.k[seg] + 1)
    # each hit lies in two overlapping bands: the one from its own step and the one before
    keys = np.concatenate(((seg << 27 | band) << 7 | offset, (seg << 27 | (band - 1)) << 7 | offset))
    key, times = np.unique(np.unique(keys) >> 7, return_counts=True)  # a q-gram of the segment counts once
    seg, band = key >> 27, key & ((1 << 27) - 1)
    full = times >= index.need[seg]
    seg, band = seg[full], band[full]
    return seg, band * (index.k[seg] + 1) - base


def edits(data: np.ndarray, segments: np.ndarray, diagonals: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each segment (rows, of one length) the least edits to a part of the text in its band.

    Bands hold the 2k + 1 diagonals from the given one and k more to each side; all segments
    advance together.
    """
    wide = 1 << 20
    low, width = (diagonals - k)[:, None], 4 * int(k.max()) + 3
    across = np.arange(width)[None, :]
    cost = np.where((low + across >= 0) & (low + across <= len(data)), 0, wide)
    for i in range(segments.shape[1]):
        at = low + across + i + 1  # bytes of the text used
        match = np.where((at >= 1) & (at <= len(data)), data[np.clip(at - 1, 0, len(data) - 1)] != segments[:, i : i + 1], wide)
        new = cost + match
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        new[(at < 0) | (at > len(data))] = wide
        cost = np.minimum.accumulate(new - across, axis=1) + across
    return cost.min(axis=1)


def _distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def standing(raw: bytes, short: bytes, diagonal: int, k: int) -> int:
    """Least edits to a part between white space that begins at the band's diagonals, or k more to each side; k + 1 if none has so few."""
    best = k + 1
    for at in range(max(0, diagonal - k), min(len(raw), diagonal + 3 * k + 2)):
        if at and raw[at - 1 : at] != b" ":
            continue
        for stop in range(at + len(short) - k, min(len(raw), at + len(short) + k) + 1):
            if stop == len(raw) or raw[stop : stop + 1] == b" ":
                best = min(best, _distance(short, raw[at:stop]))
    return best


#: What this worker searched last, by the block's name: tasks of one block share it.
_KEPT: dict[str, Searched] = {}


def kept_index(name: str, *block) -> Searched:
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Searched(*block)
    return _KEPT[name]


def _segments(raw: bytes, data: np.ndarray, index: Index) -> dict[int, int]:
    """The least edits of each segment found; a segment without edits isn't looked for any further."""
    best: dict[int, int] = {}
    done = np.zeros(len(index.m), bool)
    seen: set[tuple] = set()  # segments with the bytes that they were compared with: repetitive texts have the same ones again and again
    for segs, diagonals in candidates(data, index, done):
        left: dict[int, list[tuple[int, int]]] = {}
        for seg, diagonal in zip(segs.tolist(), diagonals.tolist(), strict=True):
            k, m = int(index.k[seg]), int(index.m[seg])
            if done[seg]:
                continue
            low = diagonal - k
            same = seg, min(low, 0), raw[max(0, low - 1) : max(0, diagonal + 3 * k + m + 2)]
            if same in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(same)
            if m < WHOLE:
                cost = standing(raw, index.text[seg].tobytes(), diagonal, k)
                if cost <= k:
                    best[seg] = min(cost, best.get(seg, cost))
            elif raw.find(index.text[seg].tobytes(), max(0, diagonal - k), max(0, diagonal + 3 * k + m)) >= 0:
                best[seg] = 0  # an alignment without edits lies in the band
            else:
                left.setdefault(m, []).append((seg, diagonal))
            done[seg] = best.get(seg) == 0
        for some in left.values():
            some = [x for x in some if not done[x[0]]]
            for at in range(0, len(some), 512):
                segs, diagonals = (np.array(c) for c in zip(*some[at : at + 512], strict=True))
                cost = edits(data, np.stack([index.text[s] for s in segs.tolist()]), diagonals, index.k[segs])
                for s, c in zip(segs[cost <= index.k[segs]].tolist(), cost[cost <= index.k[segs]].tolist(), strict=True):
                    best[s] = min(c, best.get(s, c))
    return best


def matches(text: bytes | None, searched: Searched) -> dict[int, tuple[int, int]]:
    """For each item found: segments matched and the least edits of one."""
    raw = normal(text)
    data = np.frombuffer(raw, np.uint8)
    out: dict[int, tuple[int, int]] = {}
    for index in searched.indexes:
        for seg, cost in _segments(raw, data, index).items():
            n, least = out.get(int(index.item[seg]), (0, cost))
            out[int(index.item[seg])] = (n + 1, min(least, cost))
    if searched.words:
        words = raw.split()
        seen = {w for r in searched.runs for w in map(b" ".join, zip(*[words[i:] for i in range(r)], strict=False)) if w in searched.words}
        for item in (i for w in seen for i in searched.words[w]):
            out[item] = (out.get(item, (0, 0))[0] + 1, 0)
    return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's items in blocks of about ``limit`` bytes."""
    held, size = [], 0
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).dropna().distinct()
    for r in items.toLocalIterator():
        held.append((r["item_id"], r["text"].encode()))
        size += len(held[-1][1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 80, rate: float = 0.075, block_bytes: int = 4 << 20) -> DataFrame:
    """``doc_id, item_id, n_segments, n_edits``: a row for each text that has a segment of an item, and the item.

    The benchmark is the stated set that all texts are searched for: it goes through in blocks of
    ``block_bytes``, each broadcast by itself. If there are several, each is searched for and its result
    written before the next is broadcast. Items of all lengths are searched for, with ``rate`` edits a byte (rounded down); those under 20 bytes,
    which chance may spell within words, where they stand between white space. Of an item longer than ``size``, parts of 1.5 ``size`` bytes are found.
    Texts are read whole, however long or repetitive, in bounded memory. Null texts and items match nothing;
    null ids keep their rows; repeated rows give rows each. An item whose id has several texts counts under that id.
    """
    spark, texts, out = docs.sparkSession, documents(docs, id_col, text_col), None
    following = blocks(benchmark, item_col, item_text, block_bytes)
    items = next(following, None)
    while items is not None:
        index, name = spark.sparkContext.broadcast((items, size, rate)), uuid.uuid4().hex

        def make(batches: Iterator[pa.RecordBatch], index=index, name=name) -> Iterator[pa.RecordBatch]:
            own = kept_index(name, *index.value)
            for batch in batches:
                for piece in pieces(batch):
                    rows = [(d, i, n, e) for d, t in zip(piece["doc_id"].to_pylist(), piece["text"].to_pylist(), strict=True) for i, (n, e) in matches(t, own).items()]
                    cols = zip(*rows, strict=True) if rows else [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["doc_id", "item_id", "n_segments", "n_edits"])

        part = texts.mapInArrow(make, "doc_id long, item_id long, n_segments long, n_edits long")
        items = next(following, None)
        if out is not None or items is not None:
            part = cut(part, "benchmark-block")
            index.destroy()
        out = part if out is None else out.unionByName(part)
    empty = texts.where("false").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("item_id", "n_segments", "n_edits")])
    return empty if out is None else out
