"""Language-model scores: the likelihood of a text over all segmentations into subwords."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents

#: Bytes of text in a block, whose distinct words are looked up together.
BLOCK = 24 << 20
START = "▁"


@lru_cache(1)
def vocabulary(path: str) -> dict[str, int]:
    """Pieces of the sentencepiece vocabulary that lie within one word, and its byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i) or not (model.is_control(i) or model.is_unknown(i) or START in piece[1:]):
            out[piece] = i
    return out


def _odd_powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    steps[0] = 1
    with np.errstate(over="ignore"):
        return steps.cumprod(dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15


#: Words of more characters are reached in parts side by side.
LONG = 4096


def _log_sum(terms: np.ndarray, axis: int) -> np.ndarray:
    most = terms.max(axis=axis)
    with np.errstate(invalid="ignore"):
        return np.where(most > -np.inf, most + np.log(np.exp(terms - np.expand_dims(most, axis)).sum(axis=axis)), -np.inf)


def _forward_long(steps: list[np.ndarray], byte: np.ndarray) -> np.ndarray:
    """What reaches each place of one long word, as ``Lattice._forward`` gives it, in steps of the square root of its length.

    What reaches a place depends on the k places before it, k the longest piece, so a part of the word turns the k values before it into the
    k values at its end. All parts find theirs for each single entry side by side; the word's beginning then goes
    through them one by one, and all parts, entered by what really reaches them, find their places side by side.
    """
    n, k = len(byte), len(steps)
    size = max(k, int(n**0.5) + 1)
    parts = -(-n // size)
    first = np.arange(parts) * size
    edge = np.full((k, parts * size + k), -np.inf)  # by length and where it starts; the first k places are before the word
    for length, s in enumerate(steps):
        edge[length, k : k + len(s)] = s
    edge[0, k : k + n] = np.logaddexp(edge[0, k : k + n], byte)

    def run(entries: list[np.ndarray], part: np.ndarray, keep: bool) -> list[np.ndarray]:
        """From the k columns before each row's part, oldest first, to those of its places as well, or to the last k."""
        held = list(entries)
        for j in range(1, size + 1):
            terms = np.stack([held[-length] + edge[length - 1, k + first[part] + j - length] for length in range(1, k + 1)])
            held.append(_log_sum(terms, 0))
            if not keep:
                del held[0]
        return held

    each = np.repeat(np.arange(parts), k)
    only = np.tile(np.eye(k, dtype=bool), (parts, 1))
    turned = np.stack(run([np.where(only[:, e], 0.0, -np.inf) for e in range(k)], each, False), axis=1).reshape(parts, k, k)
    enters = np.full((parts, k), -np.inf)
    enters[0, k - 1] = 0.0
    for p in range(1, parts):
        enters[p] = _log_sum(enters[p - 1][:, None] + turned[p - 1], 0)
    reached = np.stack(run([enters[:, e] for e in range(k)], np.arange(parts), True)[k:], axis=1).reshape(1, -1)[:, :n]
    return np.concatenate((np.zeros((1, 1)), reached), axis=1)


class Lattice:
    """All ways to write words in pieces, for many words of one length at a time.

    Substrings of up to the longest piece's length are looked up by 64-bit polynomial hash. A
    character that is no piece is written in byte pieces.
    """

    def __init__(self, pieces: dict[str, int]):
        self.pieces, self.size = pieces, max(pieces.values()) + 1
        self.longest = max(map(len, pieces))
        self.bytes = np.array([pieces[f"<0x{b:02X}>"] for b in range(256)])
        self._grow(256)
        by_length: dict[int, list[str]] = {}
        for p in pieces:
            if not (len(p) == 6 and p.startswith("<0x")):
                by_length.setdefault(len(p), []).append(p)
        keys, ids = [], []
        for n, some in by_length.items():
            keys.append(self._hashes(self._codes(some, n), n)[:, 0])
            ids.append([pieces[p] for p in some])
        flat, own = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(flat)
        self.keys, self.ids = flat[order], own[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def _grow(self, n: int) -> None:
        self.powers, self.inverses = _odd_powers(_BASE, n), _odd_powers(pow(_BASE, -1, 1 << 64), n)

    @staticmethod
    def _codes(texts: list[str], n: int) -> np.ndarray:
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), n)

    def _hashes(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Of all substrings of k characters."""
        n = codes.shape[1]
        if n >= len(self.powers):
            self._grow(2 * n)
        with np.errstate(over="ignore"):
            prefix = np.zeros((len(codes), n + 1), np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.powers[:n], axis=1, out=prefix[:, 1:])
            x = (prefix[:, k:] - prefix[:, : n + 1 - k]) * self.inverses[: n + 1 - k]
            x = (x ^ (x >> np.uint64(31)) ^ np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    def edges(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length the piece that starts at each place; ``size`` where there is none."""
        out = []
        for k in range(1, min(self.longest, codes.shape[1]) + 1):
            h = self._hashes(codes, k)
            found = np.full(h.shape, self.size, np.int32)
            at = np.nonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            place = np.searchsorted(self.keys, h[at])
            place[place == len(self.keys)] = 0
            true = self.keys[place] == h[at]
            found[at[0][true], at[1][true]] = self.ids[place[true]]
            out.append(found)
        return out

    def spelled(self, codes: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each character a number: 0 for pieces, else that of its byte pieces, which are listed."""
        missing = single == self.size
        chars, inverse = np.unique(codes[missing], return_inverse=True)
        which = np.zeros(codes.shape, np.int64)
        which[missing] = inverse + 1
        return which, [self.bytes[list(chr(c).encode("utf-8", "replace"))] for c in chars.tolist()]

    def _forward(self, steps: list[np.ndarray], byte: np.ndarray) -> np.ndarray:
        """Log of what reaches each place: the log-sum-exp over the edges that end there. Long words go by ``_forward_long``."""
        rows, n = byte.shape
        if n > LONG:
            return np.concatenate([_forward_long([s[i] for s in steps], byte[i]) for i in range(rows)])
        reach = np.full((rows, n + 1), -np.inf)
        reach[:, 0] = 0.0
        for j in range(1, n + 1):
            terms = [reach[:, j - k] + steps[k - 1][:, j - k] for k in range(1, min(len(steps), j) + 1)]
            reach[:, j] = _log_sum(np.stack([*terms, reach[:, j - 1] + byte[:, j - 1]]), 0)
        return reach

    def _scored(self, codes: np.ndarray, logs: np.ndarray):
        found = self.edges(codes)
        padded = np.append(logs, -np.inf)
        which, spellings = self.spelled(codes, found[0])
        byte = np.array([-np.inf, *[logs[s].sum() for s in spellings]])[which]
        return found, [padded[e] for e in found], which, spellings, byte

    @staticmethod
    def _by_length(words: list[str]):
        texts = [START + w for w in words]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                n = int(sizes[part[0]])
                room = max(1, (1 << 18) // n)
                for at in range(0, len(part), room):
                    own = part[at : at + room]
                    yield own, Lattice._codes([texts[i] for i in own.tolist()], n)

    def marginal(self, words: list[str], logs: np.ndarray) -> np.ndarray:
        """Natural log of each word's summed probability over all its segmentations, given the pieces' logs."""
        out = np.zeros(len(words))
        for own, codes in self._by_length(words):
            _, steps, _, _, byte = self._scored(codes, logs)
            out[own] = self._forward(steps, byte)[:, -1]
        return out

    def expected(self, words: list[str], counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """How often each piece is used, over all segmentations by their probability and all words by their counts."""
        used = np.zeros(self.size + 1)
        for own, codes in self._by_length(words):
            found, steps, which, spellings, byte = self._scored(codes, logs)
            n, c = codes.shape[1], counts[own][:, None]
            ahead = self._forward(steps, byte)
            # what leads from a place to the end: the same recursion on the turned lattice
            turned = [s[:, ::-1] for s in steps]
            back = self._forward(turned, byte[:, ::-1])[:, ::-1]
            total = ahead[:, -1:]
            for k, (e, s) in enumerate(zip(found, steps, strict=True), 1):
                at = e < self.size
                share = np.where(at, c * np.exp(np.where(at, ahead[:, : n + 1 - k] + s + back[:, k:] - total, -np.inf)), 0)
                used += np.bincount(e[at], weights=share[at], minlength=self.size + 1)
            if spellings:
                share = (c * np.exp(ahead[:, :-1] + byte + back[:, 1:] - total))[which > 0]
                chars = np.bincount(which[which > 0], weights=share, minlength=len(spellings) + 1)
                for spelling, x in zip(spellings, chars[1:].tolist(), strict=True):
                    np.add.at(used, spelling, x)
        return used[:-1]


@lru_cache(1)
def lattice_of(path: str) -> Lattice:
    """A worker keeps it from task to task."""
    return Lattice(vocabulary(path))


def prior(pieces: dict[str, int]) -> np.ndarray:
    """Logs of first probabilities of the pieces: a vocabulary lists frequent ones first, so they fall with the place as in Zipf's law."""
    logs = np.full(max(pieces.values()) + 1, -np.inf)
    ids = np.array(sorted(pieces.values()))
    weights = 1 / (np.arange(len(ids)) + 2.7)
    logs[ids] = np.log(weights / weights.sum())
    return logs


def maximised(used: np.ndarray, pieces: dict[str, int], smooth: float, ends: float = 0.0) -> np.ndarray:
    """Logs of the pieces' probabilities from how often they are used, ``smooth`` added to each; beside them texts end ``ends`` times."""
    logs = np.full(len(used), -np.inf)
    ids = np.array(sorted(pieces.values()))
    logs[ids] = np.log((used[ids] + smooth) / (used[ids].sum() + smooth * len(ids) + (ends + smooth if ends else 0)))
    return logs


def end_log(logs: np.ndarray) -> float:
    """Log of the probability that a text ends, which is what the pieces leave."""
    return math.log(max(1e-12, 1 - float(np.exp(logs).sum())))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


WORDS = "block long, place int, word binary, n long, cells binary"
_WORDS = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("word", pa.binary()), ("n", pa.int64()), ("cells", pa.binary())])


def _packed(values: np.ndarray) -> bytes:
    """Bytes of one significance together, then compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block a row for each distinct word, with its count in training texts, and one row of documents.

    That row holds for each text its id, part and, in ascending order, the places of its
    distinct words with their counts.
    """
    import pickle

    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    number: dict[bytes, int] = {}
    docs: list[tuple] = []
    rows: list[np.ndarray] = []
    held = count = 0

    def block() -> Iterator[pa.RecordBatch]:
        name = part << 24 | count
        sizes = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), sizes)
        train = np.repeat(np.array([not d[1] for d in docs], bool), sizes)
        n = np.bincount(flat[train], minlength=len(number))
        cell, times = np.unique(owner * max(1, len(number)) + flat, return_counts=True)
        each = np.bincount(cell // max(1, len(number)), minlength=len(docs))
        step = np.diff(cell, prepend=0)
        data = pickle.dumps(([d[0] for d in docs], [d[1] for d in docs], sizes.tolist(), each.tolist(), _packed(step), _packed(times)))
        words = list(number)
        for at in range(0, len(words), 50_000):
            some = words[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"block": [name] * len(some), "place": np.arange(at, at + len(some), dtype=np.int32), "word": some, "n": n[at : at + len(some)], "cells": [None] * len(some)}, schema=_WORDS)
        yield pa.RecordBatch.from_pydict({"block": [name], "place": [-1], "word": [None], "n": [0], "cells": [data]}, schema=_WORDS)

    for batch in batches:
        for text, doc, out in zip(batch["text"], batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), strict=True):
            data = (text.as_py() or b"").lower()
            words = data.split()
            rows.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
            docs.append((doc, out))
            held += len(data)
            if held >= BLOCK:
                yield from block()
                number, docs, rows, held, count = {}, [], [], 0, count + 1
    if docs:
        yield from block()


def piece_logs(counts: DataFrame, pieces_path: str, rounds: int, smooth: float, ends: float) -> np.ndarray:
    """Logs of the pieces' probabilities after ``rounds`` of expectation and maximisation over ``counts(word, c)`` of ``ends`` texts.

    Pieces and the end together have probability 1. A round reads the counted words once; a number for each piece of the vocabulary comes to the driver.
    """
    pieces = vocabulary(pieces_path)
    logs = prior(pieces)
    for _ in range(rounds):
        model = counts.sparkSession.sparkContext.broadcast(logs)

        def expect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            own = lattice_of(pieces_path)
            used = np.zeros(own.size)
            for batch in batches:
                words = [w.decode("utf-8", "replace") for w in batch["word"].to_pylist()]
                used += own.expected(words, batch["c"].to_numpy().astype(np.float64), model.value)
            some = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(used[some])], names=["piece", "n"])

        rows = counts.where("c > 0").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        used = np.zeros(len(logs))
        used[[r["piece"] for r in rows]] = [r["n"] for r in rows]
        logs = maximised(used, pieces, smooth, max(ends, smooth))
        model.destroy()
    return logs


def score(docs: DataFrame, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", smooth: float = 0.1, rounds: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score``.

    Tokens are A-Z-lower-cased words and one end per text; ids whose crc32 is 0 modulo 10 are held
    out and the rest is learned from (a null id is learned from). ``base_score``: log10 of the
    add-``smooth`` unigram. ``score``: log10 of the marginal probability over all
    segmentations of the words into pieces of an existing vocabulary, then the end: pieces and end are drawn from one
    distribution, so the probabilities of all texts sum to 1 at most. Pieces are weighed by
    ``rounds`` of expectation and maximisation on the lattices of the training words, each word by its count; of no training
    texts, first weights that fall with the place in the vocabulary are smoothed.
    ``word_score``: the same with each training word as a piece too, one edge more in its lattice, by its relative frequency, discounted by
    the share of words seen once, which is the weight of the other edges together. Null and empty texts have only
    the end. Repeated rows each count. No documents: no rows.

    Texts are read once and never shuffled: blocks of them become distinct words with counts,
    and cells. Words meet their corpus-wide counts in a shuffle on the word, are scored once each,
    and go back to their blocks by place.
    """
    texts = documents(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    found = cut(texts.mapInArrow(_blocks, WORDS), "lm-words")
    words = found.where("place >= 0").select(F.col("block").alias("of"), "place", "word", "n")
    cells = found.where("place < 0").select("block", "cells")
    counts = cut(words.groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    seen = counts.agg(F.sum("c").alias("tokens"), F.sum((F.col("c") > 0).cast("long")).alias("kinds"), F.sum((F.col("c") == 1).cast("long")).alias("once")).first()
    trained = texts.where(~F.col("held_out")).count()  # one end each
    total, kinds, once = (seen["tokens"] or 0) + trained, (seen["kinds"] or 0) + (trained > 0), seen["once"] or 0
    model = docs.sparkSession.sparkContext.broadcast(piece_logs(counts, pieces_path, rounds, smooth, trained))
    below = math.log(total + smooth * (kinds + 1))
    spare = min(0.5, max(1e-6, (once + 1) / (total + 1)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, logs = lattice_of(pieces_path), model.value
        for batch in batches:
            c = batch["c"].to_numpy().astype(np.float64)
            sub = own.marginal([w.decode("utf-8", "replace") for w in batch["word"].to_pylist()], logs)
            whole = np.log(np.maximum(c, 1e-300) / max(total, 1)) + math.log1p(-spare)
            both = np.where(c > 0, np.logaddexp(whole, sub + math.log(spare)), sub + math.log(spare))
            yield pa.RecordBatch.from_arrays([batch["word"], batch["c"], pa.array(sub), pa.array(both)], names=["word", "c", "sub", "both"])

    weighed = counts.mapInArrow(weigh, "word binary, c long, sub double, both double")
    back = words.select("of", "place", "word").join(weighed, "word").select("of", "place", "c", "sub", "both")
    end = math.log(trained / total) + math.log1p(-spare) if trained else math.log(spare)
    end_sub = end_log(model.value)

    def gather(key, left: pa.Table, right: pa.Table) -> pa.Table:
        import pickle

        place = right["place"].to_numpy()
        cols = []
        for name in ("c", "sub", "both"):
            v = np.zeros(len(place))
            v[place] = right[name].to_numpy()
            cols.append(v)
        c, sub, both = cols
        base = np.log(c + smooth) - below
        out: list[list] = [[] for _ in range(8)]
        for data in left["cells"].to_pylist():
            ids, apart, sizes, each, step, times = pickle.loads(data)
            step, times = _unpacked(step).astype(np.int64), _unpacked(times).astype(np.float64)
            at = np.cumsum(step) % max(1, len(place))
            owner = np.repeat(np.arange(len(ids)), each)
            known = np.bincount(owner, weights=times * (c[at] > 0), minlength=len(ids)).astype(np.int64) + (trained > 0)
            sums = [np.bincount(owner, weights=times * v[at], minlength=len(ids)) for v in (base, sub, both)]
            ends = (math.log(trained + smooth) - below, end_sub, end)
            out[0] += ids
            out[1] += apart
            out[2] += [n + 1 for n in sizes]
            out[3] += known.tolist()
            out[4] += [total] * len(ids)
            for o, s, e in zip(out[5:], sums, ends, strict=True):
                o += ((s + e) / math.log(10)).tolist()
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 3), strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "word_score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, word_score double"
    # a partition for each block, where there are more blocks than partitions
    parts = max(cells.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cells.repartition(parts, "block").groupBy("block").cogroup(back.repartition(parts, "of").groupBy("of")).applyInArrow(gather, schema)
