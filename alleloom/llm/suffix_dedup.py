"""Removal of long repeated byte strings, decided on Burrows-Wheeler intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, documents

#: Anchors are the least hashes of GRAM bytes within a window.
GRAM = 32
#: Windows are handled in blocks whose positions fit the low bits of an ordering key.
BLOCK_BITS = 20
BASE, MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(base: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, for every position of a block."""
    steps = np.full((1 << BLOCK_BITS) + 2, base, np.uint64)
    steps[0] = 1
    with np.errstate(over="ignore"):
        return steps.cumprod(dtype=np.uint64)


POWERS, INVERSES = _powers(int(BASE)), _powers(pow(int(BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    x ^= x >> np.uint64(29)
    x *= BASE
    x ^= x >> np.uint64(32)
    return x


def runs(data: np.ndarray, allowed: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Runs of consecutive window starts that have the same anchor.

    ``data``: bytes; ``allowed``: a flag for each window start (len(data) - size + 1). Gives
    start, n (window starts), rel (anchor minus start), h (hash of the anchor) and region
    (hash of all bytes that the windows cover, with rel). Equal windows have their anchors at
    the same offset, so equal strings always meet under the same h.
    """
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * INVERSES[: len(data)], dtype=np.uint64)))
    grams = len(data) - GRAM + 1
    h = mixed((prefix[GRAM:] - prefix[:grams]) * POWERS[:grams])
    low = np.uint64((1 << BLOCK_BITS) - 1)
    least = (h & ~low) | np.arange(grams, dtype=np.uint64)
    width, have = size - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least & low).astype(np.int64)
    first = allowed.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~allowed[:-1]
    start = np.flatnonzero(first)
    last = allowed.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~allowed[1:]
    n = np.flatnonzero(last) - start + 1
    at = anchor[start]
    region = mixed((prefix[start + n + size - 1] - prefix[start]) * POWERS[start])
    region = mixed(region + (at - start).astype(np.uint64) * BASE)
    return {"start": start, "n": n, "h": h[at], "region": region}


def _run_batches(size: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = 1 << BLOCK_BITS

        def flush(parts: list) -> pa.RecordBatch:
            data = np.concatenate([p[0] for p in parts])
            lengths = np.array([len(p[0]) for p in parts])
            begins = np.cumsum(lengths) - lengths
            allowed = np.zeros(len(data) - size + 1, bool)
            for b, n in zip(begins.tolist(), lengths.tolist(), strict=True):
                allowed[b : b + n - size + 1] = True
            with np.errstate(over="ignore"):
                found = runs(data, allowed, size)
            part = np.searchsorted(begins, found["start"], side="right") - 1
            offset = np.array([p[3] for p in parts])
            valid = np.array([p[1] is not None for p in parts])
            ids, tags = np.array([p[1] or 0 for p in parts], np.int64), np.array([p[2] for p in parts], np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(found["h"].view(np.int64)), pa.array(found["region"].view(np.int64)), pa.array(ids[part], mask=~valid[part]), pa.array(tags[part]),
                 pa.array((found["start"] - begins[part] + offset[part]).astype(np.int64)), pa.array(found["n"].astype(np.int16))],
                names=["h", "region", "doc_id", "tag", "start", "n"],
            )

        parts, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch["text"][i].as_py() or b""
                if len(text) < size:
                    continue
                whole, doc, tag = np.frombuffer(text, np.uint8), batch["doc_id"][i].as_py(), batch["tag"][i].as_py()
                for at in range(0, len(whole) - size + 1, room - size + 1):
                    piece = whole[at : at + room]
                    if held + len(piece) > room:
                        yield flush(parts)
                        parts, held = [], 0
                    parts.append((piece, doc, tag, at))
                    held += len(piece)
        if parts:
            yield flush(parts)

    return make


def ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places in ascending order, the dense rank of each place, and the number of ranks."""
    order = np.argsort(key)
    up = key[order]
    dense = np.concatenate(([0], np.cumsum(up[1:] != up[:-1])))
    rank = np.empty(len(key), np.int64)
    rank[order] = dense
    return order, rank, int(dense[-1]) + 1


def long_repeats(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text, flags of the window starts whose ``size`` bytes start elsewhere in the texts too.

    Builds the suffix order to depth ``size`` by prefix doubling and the Burrows-Wheeler
    transform from it. Then intervals are expanded breadth-first: those of length l patterns
    give, by one backward extension for every byte, those of length l + 1; the first interval to
    end at a place fixes the common prefix there as l. Levels stop at ``size``, so a place left
    open is a common prefix of ``size`` or more between neighbouring suffixes.
    """
    lengths = np.array([len(t) for t in texts])
    begins = np.cumsum(lengths + 1) - lengths - 1
    raw = np.full(int((lengths + 1).sum()), 256, np.int64)
    for b, t in zip(begins.tolist(), texts, strict=True):
        raw[b : b + len(t)] = np.frombuffer(t, np.uint8)
    alphabet, codes = np.unique(raw, return_inverse=True)
    n, sigma = len(codes), len(alphabet)
    depth = max(1, int(62 / np.log2(sigma)))
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key = key * sigma + np.roll(codes, -k)
    order, rank, most = ordered(key)
    while depth < size and most < n:
        order, rank, most = ordered(rank * most + np.roll(rank, -depth))
        depth *= 2
    bwt = codes[order - 1]  # the text is taken as a ring
    back = np.empty(n, np.int64)  # the place of each suffix with the byte before it in front
    back[np.argsort(bwt.astype(np.uint16), kind="stable")] = np.arange(n)
    seen = np.zeros((sigma, n + 1), np.int32)
    seen[bwt, np.arange(1, n + 1)] = 1
    np.cumsum(seen, axis=1, out=seen)
    before = np.concatenate(([0], np.cumsum(seen[:, -1])[:-1])).astype(np.int32)[:, None]
    lcp = np.full(n + 1, -1, np.int16)
    lcp[[0, n]] = 0
    left, right = np.array([0]), np.array([n])
    for level in range(size):
        # intervals of one or two suffixes have one or two extensions, so only wider ones try every byte
        wide, one, two = right - left > 2, left[right - left == 1], left[right - left == 2]
        first, second, same = back[two], back[two + 1], bwt[two] == bwt[two + 1]
        lo, hi = seen[:, left[wide]] + before, seen[:, right[wide]] + before
        some = hi > lo
        ends = second[~same]
        left = np.concatenate((lo[some], back[one], first, ends))
        right = np.concatenate((hi[some], back[one] + 1, np.where(same, second, first) + 1, ends + 1))
        new = lcp[right] < 0
        left, right = left[new], right[new]
        if not len(right):
            break
        lcp[right] = level
    open_ = lcp[:n] < 0
    twin = open_.copy()
    twin[:-1] |= open_[1:]
    flags = np.zeros(n, bool)
    flags[order[twin]] = True
    return [flags[b : b + m - size + 1] for b, m in zip(begins.tolist(), lengths.tolist(), strict=True)]


def _texts_of(bundle: list[dict], size: int) -> dict[str, list]:
    flags = long_repeats([r["bytes"] for r in bundle], size)
    rows = [(r["doc_id"], r["tag"], r["start"] + np.flatnonzero(f)) for r, f in zip(bundle, flags, strict=True) if r["n"] == 1 and f.any()]
    out: dict[str, list] = {"doc_id": [], "tag": [], "begin": [], "end": []}
    for doc, tag, at in rows:
        edge = np.flatnonzero(np.diff(at) > 1)
        for a, b in zip(at[np.concatenate(([0], edge + 1))].tolist(), at[np.concatenate((edge, [len(at) - 1]))].tolist(), strict=True):
            for k, v in zip(out, (doc, tag, a, b + size), strict=True):
                out[k].append(v)
    return out


SPANS = "doc_id long, tag long, begin long, end long"
_SPANS = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def _bundled(size: int, limit: int = 24 << 10):
    """Groups of equal ``h`` come sorted; whole groups fill bundles of about ``limit`` bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, held, last = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if held > limit and row["h"] != last:
                    yield pa.RecordBatch.from_pydict(_texts_of(bundle, size), schema=_SPANS)
                    bundle, held = [], 0
                bundle.append(row)
                held, last = held + len(row["bytes"]), row["h"]
        if bundle:
            yield pa.RecordBatch.from_pydict(_texts_of(bundle, size), schema=_SPANS)

    return make


STRINGS = "h long, n long, doc_id long, tag long, start long, bytes binary, k long"
_KINDS = {"h": pa.int64(), "n": pa.int64(), "doc_id": pa.int64(), "tag": pa.int64(), "start": pa.int64(), "bytes": pa.binary()}


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each listed run with the bytes that its windows cover."""

    def flush(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*_KINDS.values(), pa.int64()], strict=True)], names=[*_KINDS, "k"])

    for batch in batches:
        rows = []
        for text, doc, tag, found in zip(batch["text"], batch["doc_id"], batch["tag"], batch["found"], strict=True):
            data = text.as_py()
            rows += [(f["h"], f["n"], doc.as_py(), tag.as_py(), f["start"], data[f["start"] : f["end"]], f["k"]) for f in found.as_py()]
            if len(rows) > 20_000:
                yield flush(rows)
                rows = []
        if rows:
            yield flush(rows)


def anchor_of(data: bytes, size: int) -> int:
    """Offset of the anchor of a run's first window, which is that of all its windows."""
    x = np.frombuffer(data[:size], np.uint8).astype(np.uint64) + np.uint64(1)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * INVERSES[: len(x)], dtype=np.uint64)))
    h = mixed((prefix[GRAM:] - prefix[:-GRAM]) * POWERS[: len(x) - GRAM + 1])
    return int(np.argmin(h >> np.uint64(BLOCK_BITS)))


def _parts(size: int, step: int):
    """Runs split by how many bytes their windows have left of the anchor, ``step`` counts to a part.

    All windows of a part share the bytes from its least to its greatest reach, so those bytes
    are its key: equal windows lie in equal parts of their runs and meet under one key. At
    ``step`` 1 the key is the window itself.
    """
    import xxhash

    def make(batch: pa.RecordBatch) -> dict:
        out: list[list] = [[] for _ in range(7)]
        with np.errstate(over="ignore"):
            for h, n, doc, tag, start, data in zip(*(batch[c].to_pylist() for c in _KINDS), strict=True):
                at = anchor_of(data, size)
                least = at - (len(data) - size)
                for part in range(least // step, at // step + 1):
                    low, high = part * step, min(part * step + step - 1, size - GRAM)
                    a, b = max(low, least), min(high, at)
                    own = data[at - b : at - a + size]
                    key = xxhash.xxh64_intdigest(data[at - low : at - high + size], (h ^ part) & 0xFFFFFFFFFFFFFFFF)
                    for c, v in zip(out, (key, xxhash.xxh64_intdigest(own, b), n, doc, tag, start + at - b, own), strict=True):
                        c.append(v)
        keys = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in out[:2]]
        return dict(zip(("h", "region", *list(_KINDS)[1:]), [*keys, *(pa.array(c, t) for c, t in zip(out[2:], list(_KINDS.values())[1:], strict=True))], strict=True))

    return make


def _split(strings: DataFrame, size: int, step: int) -> tuple[DataFrame, DataFrame]:
    """``(spans, strings)``: what parts that occur twice cover, and one string for each different part of a key, with their number ``k``."""
    parts = cut(arrow_map(strings, _parts(size, step), "h long, region long, n long, doc_id long, tag long, start long, bytes binary"), "repeat-parts")
    classes = parts.groupBy("h", "region").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "tag", "start", "bytes")).alias("one"))
    again = parts.where("n = 1").join(classes.where("n > 1").select("h", "region"), ["h", "region"], "left_semi")
    spans = again.select("doc_id", "tag", F.col("start").alias("begin"), (F.col("start") + F.octet_length("bytes")).alias("end"))
    kinds = classes.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    return spans, classes.join(kinds, "h").select("h", "n", "one.*", "k")


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 200, group_limit: int = 256) -> DataFrame:
    """``doc_id, text (binary), spans``: the byte ranges that repeated strings of ``size`` bytes cover.

    1. Every text is dealt into runs of window starts with a common anchor (a least gram hash);
       equal strings share the anchor's hash. Hashes that occur once end there.
    2. All windows of a run that occurs twice repeat (its anchor's and its own 64-bit hash are
       equal). A hash's most common run is known from the counts that find the hash, the other
       ones by a join. Copies thus collapse before anything is compared.
    3. Different texts under one hash are compared: their distinct runs, cut from the texts,
       fill bundles, and ``long_repeats`` finds the common strings on each bundle's transform.
    4. Where over ``group_limit`` different runs meet under one hash (the rims of very common
       passages), each run is first split by its windows' reach to the left of the anchor, into
       13 parts at most, keyed by the bytes that all windows of a part have. Inside the passage
       all parts of a key are equal, beyond it no key is met twice, and what is left goes through
       3 under its narrower key. Only a part that holds the rim itself can stay crowded; it
       splits once more, into its windows, which are equal or not. So a crowded hash costs a
       bounded number of rows for each of its runs, and no bundle exceeds ``group_limit`` strings.
    """
    texts = documents(docs, id_col, text_col).withColumn("tag", F.xxhash64("text"))
    found = texts.where(F.octet_length("text") >= size).mapInArrow(_run_batches(size), "h long, region long, doc_id long, tag long, start long, n short")
    regions = found.groupBy("h", "region").agg(F.count("*").alias("n"))
    dup = regions.groupBy("h").agg(F.sum("n").alias("times"), F.count("*").alias("kinds"), F.max("n").alias("most"), F.max_by("region", "n").alias("top")).where("times > 1")
    # kept apart, so that the join has plain exchanges on both sides and Spark can split a common hash
    dup = cut(dup.select("h", (F.col("kinds") == 1).alias("same"), F.when(F.col("most") > 1, F.col("top")).alias("top")), "repeat-hashes")
    met = cut(found.join(dup, "h"), "repeat-runs")
    end = (F.col("start") + F.col("n") + F.lit(size - 1)).alias("end")
    common = met.where("region = top").select("doc_id", "tag", F.col("start").alias("begin"), end)

    other = met.where("not same").select("h", "region", "top", "doc_id", "tag", "start", end)
    classes = cut(other.groupBy("h", "region").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tag", "start", "end")).alias("one")), "repeat-classes")
    rarer = other.where(~F.coalesce(F.col("region") == F.col("top"), F.lit(False)))
    twice = rarer.join(classes.where("n > 1").select("h", "region"), ["h", "region"], "left_semi").select("doc_id", "tag", F.col("start").alias("begin"), "end")
    sized = classes.join(classes.groupBy("h").agg(F.count("*").alias("k")), "h").select("h", "k", "n", "one.*")
    wanted = cut(sized.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("h", "k", "n", "start", "end")).alias("found")), "repeat-strings")
    same_doc = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["tag"] == wanted["tag"])
    # repeated rows would cut the same strings again: one of them is enough
    picked = texts.join(wanted, same_doc).select(texts["doc_id"], texts["tag"], "text", "found").dropDuplicates(["doc_id", "tag"])

    # written once: crowded hashes and the others are read from it
    strings = cut(picked.mapInArrow(_cut_out, STRINGS), "repeat-texts")
    crowded = F.col("k") > group_limit
    # a part for every 13 of the 169 reaches, then one for each
    parted, narrower = _split(strings.where(crowded), size, int((size - GRAM + 1) ** 0.5))
    equal, _ = _split(narrower.where(crowded), size, 1)
    few = strings.where(~crowded).unionByName(narrower.where(~crowded)).drop("k")
    compared = few.repartition("h").sortWithinPartitions("h").mapInArrow(_bundled(size), SPANS)

    spans = common.unionByName(twice).unionByName(compared).unionByName(parted).unionByName(equal)
    spans = spans.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    here = texts["doc_id"].eqNullSafe(spans["doc_id"]) & (texts["tag"] == spans["tag"])
    return texts.join(spans, here, "left").select(texts["doc_id"], "text", "spans")


def remaining(text: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left, the bytes removed and the maximal runs of them."""
    if not spans:
        return text, 0, 0
    kept, at, removed, n = [], 0, 0, 0
    stop = -1
    for a, b in sorted((s["begin"], s["end"]) for s in spans):
        if a > stop:
            kept.append(text[at:a])
            n += 1
        removed += max(0, b - max(a, stop))
        stop = max(stop, b)
        at = stop
    kept.append(text[at:])
    return b"".join(kept), removed, n


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 200) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (binary).

    Each byte goes that is covered by a string of ``size`` bytes which starts anywhere else too,
    in any text or the same one, judged on the input. Texts are UTF-8 bytes, null texts are
    empty; texts shorter than ``size`` stay whole; repeated rows repeat each other, so both lose
    their strings. Matches never cross documents. No documents give no rows.
    """

    def make(batch: pa.RecordBatch) -> dict:
        text = [t or b"" for t in batch["text"].to_pylist()]
        out = [remaining(t, s) for t, s in zip(text, batch["spans"].to_pylist(), strict=True)]
        return {
            "doc_id": batch["doc_id"],
            "n_bytes": pa.array([len(t) for t in text], pa.int64()),
            "n_removed": pa.array([o[1] for o in out], pa.int64()),
            "n_spans": pa.array([o[2] for o in out], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(o[0]).hexdigest() for o in out], pa.string()),
            "kept": pa.array([o[0] for o in out], pa.binary()),
        }

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return arrow_map(with_spans(docs, id_col, text_col, size), make, schema)
