"""Token ids in grammar-compressed binary shards with random access."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, documents, pieces, shared_path

MAGIC = b"RPG1"
HEADER = np.dtype([("magic", "S4"), ("base", "<u4"), ("rules", "<u4"), ("docs", "<u4"), ("symbols", "<u8"), ("tokens", "<u8")])
#: Symbols must fit 16 bits where the vocabulary does, so rules are limited to what is left.
SYMBOLS = 1 << 16
#: A rule takes 12 bytes of a shard, and a use of it saves 2.
LEAST = 7
#: Pairs that are replaced in one step are looked up in a table of so many bits.
SLOT_BITS = 16


@lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: A punctuation mark behind an ASCII letter or a letter of U+00C0 to U+00FF. The tokenizer ends a run of letters there.
MARK = re.compile(rb"[.,!?;:*$%&#](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")
#: Beginnings of special tokens, which have capitals of their own, and lead bytes of combining marks, which may join with a small letter only.
APART = (b"<|", b"\xcc", b"\xcd")


def spaced(text: bytes) -> bytes:
    """The text in small letters and with punctuation set apart where that leaves the ids alone."""
    if any(x in text for x in APART):
        return text
    return MARK.sub(rb" \g<0>", text.lower())


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: ``MARK`` by tables: marks, small ASCII letters, second bytes of small and capital letters of U+00C0 to U+00FF.
MARKS = _table(*[(c, c) for c in b".,!?;:*$%&#"])
LETTERS = _table((ord("a"), ord("z")))
SECOND = _table((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))


def all_spaced(texts: list[bytes]) -> pa.LargeStringArray:
    """``spaced`` of many texts, found over all their bytes at once."""
    apart = [any(x in t for x in APART) for t in texts]
    flat = np.frombuffer(b"  " + b"\n".join([t if a else t.lower() for t, a in zip(texts, apart, strict=True)]) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) + 2  # a line end stands behind each text
    at = np.flatnonzero(MARKS[flat])
    before = flat[at - 1]
    at = at[LETTERS[before] | (SECOND[before] & (flat[at - 2] == 0xC3))]
    if any(apart):
        at = at[~np.array(apart)[np.searchsorted(ends, at, side="right")]]
    out = np.insert(flat, at, ord(" "))
    offsets = np.concatenate(([2], ends)) + np.searchsorted(at, np.concatenate(([2], ends)))
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))


def words_of(text: bytes) -> list[bytes]:
    """The text's words, in small letters and without punctuation behind them where that leaves the ids alone."""
    return spaced(text).split()


#: Texts that tell whether a tokenizer is of the kind that ``WordIds`` needs.
PROBES = ("Two words, and MORE: 3 or 4?", "  a\tb\n\nc  ", "it's the 'quoted' end.", "Éa é, ß; Ünder*score_ #1 $5 50%", "x.y.z a.b. !?!", "日本語 текст 😀")


class WordIds:
    """Ids of words, as little-endian 32-bit bytes. The tokenizer splits at white space, so a text's ids are those of its words.

    This holds for tokenizers that lower-case, split at white space and mark a word's last token; others are refused, by ``PROBES``.

    Words of letters are the tokenizer's own pieces. Many new ones are encoded as one text and told
    apart by their last tokens, which alone carry the word-end mark.
    """

    def __init__(self, path: str, limit: int = 700_000):
        self.path, self.limit = path, limit
        # a plain dict: a set's difference with one looks up its own few members only
        self.ids: dict[bytes, bytes] = {}
        vocab = _tokenizer(path).get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        for text in PROBES:
            if self.flat([text.encode()])[0].tolist() != _tokenizer(path).encode(text, add_special_tokens=False).ids:
                raise ValueError(f"the tokenizer {path} doesn't encode a text as its words")

    def of(self, texts: list[list[bytes]]) -> dict[bytes, bytes]:
        """Ids of the words of texts."""
        distinct = list(set().union(*texts))
        return dict(zip(distinct, self._learned(distinct), strict=True))

    def flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids, one after the other, and how many there are up to each text's end.

        Arrow splits the texts and numbers their words, so that Python looks up each different word once.
        """
        split = pc.ascii_split_whitespace(all_spaced(texts))
        numbered = split.flatten().dictionary_encode()
        distinct = numbered.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        own = self._learned(distinct)
        flat, sizes = np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) // 4
        which = numbered.indices.to_numpy()
        n = sizes[which]
        after = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - after + n, n) + np.arange(after[-1] if len(after) else 0)]
        return ids, np.concatenate(([0], after))[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]

    def _learned(self, distinct: list[bytes]) -> list[bytes]:
        """Ids of different words, each looked up once; new ones are encoded together."""
        if len(self.ids) > self.limit:
            self.ids.clear()
        own = list(map(self.ids.get, distinct))
        new = [i for i, x in enumerate(own) if x is None]
        letters, odd = [], []
        for w in map(distinct.__getitem__, new):
            (letters if w.isalpha() or not w.isascii() and (t := w.decode("utf-8", "replace")).isalpha() and max(t) < "\u0100" else odd).append(w)
        self._encode(odd)
        self._encode_runs(letters)
        for i in new:
            own[i] = self.ids[distinct[i]]
        return own

    def _encode(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            for w, e in zip(part, _tokenizer(self.path).encode_batch_fast([x.decode("utf-8", "replace") for x in part], add_special_tokens=False), strict=True):
                self.ids[w] = np.array(e.ids, "<u4").tobytes()

    def _encode_runs(self, words: list[bytes], together: int = 400) -> None:
        for at in range(0, len(words), together):
            part = words[at : at + together]
            ids = np.array(_tokenizer(self.path).encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(stops) != len(part):
                raise ValueError("the tokenizer doesn't end every word by a marked token")
            raw = ids.tobytes()
            self.ids.update(zip(part, (raw[i:j] for i, j in zip([0, *stops], stops, strict=False)), strict=True))


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """A worker keeps what it has learned from task to task."""
    return WordIds(path)


def repair(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST, factor: int = 16, at_once: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: the most frequent neighbouring pairs become nonterminals, again and again.

    ``ids``: one sequence; ``ends``: the number of ids up to each document's end, over which no
    pair reaches. A step counts all pairs exactly and takes those that are at least a ``factor``th as frequent as
    the most frequent one, the ``at_once`` first of them; of overlapping occurrences the more frequent pair's is replaced, and in a run of one id every
    other. Rules that were used twice are kept. It ends when no pair occurs ``least`` times, below
    which a rule takes more room than it saves, or when the 16-bit symbols are used up. Returns
    symbols, rules (pairs, by number) and the documents' ends in symbols.
    """
    # a pair of 16-bit symbols is one 32-bit number; wider vocabularies take twice that
    narrow = base < SYMBOLS
    one, both, half, mix = (np.uint16, np.uint32, np.uint32(16), np.uint32(2654435769)) if narrow else (np.uint32, np.uint64, np.uint64(32), np.uint64(0x9E3779B97F4A7C15))
    shift, low, none = both(2 * int(half) - SLOT_BITS), both((1 << int(half)) - 1), np.iinfo(both).max
    seq = ids.astype(one)
    filled = np.diff(ends, prepend=0) > 0
    last = np.asarray(ends, np.int64)[filled] - 1
    rules: list[np.ndarray] = []
    made, limit = 0, max(0, SYMBOLS - 1 - base) if narrow else 1 << 20
    while len(seq) > 1 and made < limit:
        code = seq[:-1].astype(both)
        code <<= half
        code |= seq[1:]
        code[last[:-1]] = none  # a document's last id begins no pair
        up = np.sort(code)
        up = up[: np.searchsorted(up, none)]
        # where a pair begins that occurs ``least`` times
        often = up[least - 1 :] == up[: max(0, len(up) - least + 1)]
        often[1:] &= up[1 : len(often)] != up[: max(0, len(often) - 1)]
        begin = np.flatnonzero(often)
        if not len(begin):
            break
        times = np.searchsorted(up, up[begin], side="right") - begin
        most = int(times.max())
        some = np.flatnonzero(times >= max(least, most // factor))
        pair = up[begin[some[np.argsort(-times[some], kind="stable")[: min(at_once, limit - made)]]]]
        # where they occur: by a table of slots, in which the more frequent pair stays; the other one's turn comes later
        table = np.zeros(1 << SLOT_BITS, np.int16 if at_once < 1 << 15 else np.int32)
        with np.errstate(over="ignore"):
            table[(pair * mix >> shift)[::-1]] = np.arange(len(pair), 0, -1)
            which = table[code * mix >> shift]
        at = np.flatnonzero(which != 0)
        which = which[at]
        met = code[at] == pair[which - 1]
        at, which = at[met], which[met]
        if (pair >> half == pair & low).any():  # runs of one id
            start = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (which[1:] != which[:-1]))))
            even = (np.arange(len(at)) - np.repeat(start, np.diff(start, append=len(at)))) % 2 == 0
            at, which = at[even], which[even]
        # neighbours overlap: the one whose pair is more frequent, the lower number, stays
        first = np.flatnonzero(at[1:] - at[:-1] == 1)
        lost = np.where(which[first] < which[first + 1], first + 1, first)
        chosen = np.ones(len(at), bool)
        chosen[lost] = False
        at, which = at[chosen], which[chosen]
        used = np.bincount(which, minlength=len(pair) + 1) > 1
        good = used[which]
        at, which = at[good], which[good]
        if not len(at):
            break
        new = pair[used[1:]]
        rules.append(np.stack((new >> half, new & low), axis=1).astype(np.int64))
        seq[at] = (base + made + np.cumsum(used) - 1)[which]
        made += len(new)
        last -= np.searchsorted(at + 1, last, side="right")
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
    rows = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    stops = np.zeros(len(ends), np.int64)
    stops[filled] = last + 1
    return seq, rows, np.maximum.accumulate(stops) if len(stops) else stops


def expanded(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    out = symbols.astype(np.int64)
    while len(out) and (deep := out >= base).any():
        at = np.cumsum(deep) - deep + np.arange(len(out))
        pair = rules[out[deep] - base]
        out = np.repeat(out, deep + 1)
        out[at[deep]], out[at[deep] + 1] = pair[:, 0], pair[:, 1]
    return out


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for; a rule only names earlier ones."""
    length = np.ones(len(rules), np.int64)
    while len(rules):  # as often as rules are nested
        part = np.where(rules < base, 1, length[np.maximum(rules - base, 0)]).sum(axis=1)
        if (part == length).all():
            break
        length = part
    return length


def pack_shard(ids: np.ndarray, ends: np.ndarray, doc_ids: list[int | None], base: int) -> bytes:
    """One shard's bytes: header, rules, rule lengths, documents (id, has id, ends in symbols and ids), symbols."""
    symbols, rules, stops = repair(ids, ends, base)
    kind = "<u2" if base + len(rules) <= SYMBOLS else "<u4"
    head = np.array([(MAGIC, base, len(rules), len(doc_ids), len(symbols), len(ids))], HEADER)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    plain = np.array([d or 0 for d in doc_ids], "<i8")
    parts = (head, rules.astype("<u4"), rule_lengths(rules, base).astype("<u4"), plain, known, stops.astype("<u8"), ends.astype("<u8"), symbols.astype(kind))
    return b"".join(p.tobytes() for p in parts)


class Shard:
    """Reads a shard's bytes; any document, or any range of its ids, without expanding the rest."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, HEADER, 1)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a token shard")
        self.base, at = int(head["base"]), HEADER.itemsize

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        n, m = int(head["rules"]), int(head["docs"])
        self.rules = take("<u4", 2 * n).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u4", n).astype(np.int64)
        plain, known = take("<i8", m), take("u1", m)
        self.doc_ids = [int(d) if k else None for d, k in zip(plain, known, strict=True)]
        self.stops, self.ends = take("<u8", m).astype(np.int64), take("<u8", m).astype(np.int64)
        self.symbols = take("<u2" if self.base + n <= SYMBOLS else "<u4", int(head["symbols"]))

    def all_ids(self) -> np.ndarray:
        whole = expanded(np.arange(self.base, self.base + len(self.rules)), self.rules, self.base)
        flat = np.concatenate((np.arange(self.base), whole)).astype("<u4")
        size = np.concatenate((np.ones(self.base, np.int64), self.lengths))
        place = np.concatenate((np.arange(self.base), self.base + np.cumsum(self.lengths) - self.lengths))
        n = size[self.symbols]
        after = np.cumsum(n)
        return flat[np.repeat(place[self.symbols] - after + n, n) + np.arange(after[-1] if len(after) else 0)]

    def ids(self, doc: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids ``begin`` to ``end`` of the shard's document number ``doc``."""
        part = self.symbols[self.stops[doc - 1] if doc else 0 : self.stops[doc]].astype(np.int64)
        size = np.where(part < self.base, 1, self.lengths[np.maximum(part - self.base, 0)] if len(self.lengths) else 1)
        after = np.cumsum(size)
        end = int(after[-1]) if end is None and len(after) else (end or 0)
        first, stop = np.searchsorted(after, begin, side="right"), np.searchsorted(after, end)
        skipped = int(after[first - 1]) if first else 0
        return expanded(part[first : stop + 1], self.rules, self.base)[begin - skipped : end - skipped].astype("<u4")


def _encode(path: str, end_id: int, shard_tokens: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, base = word_ids(path), _tokenizer(path).get_vocab_size()
        part, number = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4")
        ids, ends, docs, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            data = pack_shard(flat, np.array(ends, np.int64), docs, base)
            return pa.RecordBatch.from_pydict({"part": [part], "number": [number], "n_tokens": [held], "data": [data]}, schema=pa.schema([("part", pa.int32()), ("number", pa.int32()), ("n_tokens", pa.int64()), ("data", pa.binary())]))

        for batch in batches:
            for piece in pieces(batch, 6 << 20):
                flat, stops = memo.flat([t or b"" for t in piece["text"].to_pylist()])
                begin = 0
                for doc, stop in zip(piece["doc_id"].to_pylist(), stops.tolist(), strict=True):
                    ids += (flat[begin:stop], end)
                    held += stop - begin + 1
                    begin = stop
                    ends.append(held)
                    docs.append(doc)
                    if held >= shard_tokens:
                        yield shard()
                        ids, ends, docs, held, number = [], [], [], 0, number + 1
        if docs:
            yield shard()

    return make


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1_000_000) -> str:
    """Writes ``(part, number, n_tokens, data)``: shards in ascending id order, each one row of a Parquet table at ``path``.

    Each text (null: empty) is encoded whole, then ``end_id`` follows. A shard closes after the
    document that takes it to ``shard_tokens``, so a very long text fills its own. Spark's
    committer writes the rows, so lost or repeated tasks leave no halves. No documents: no shards.
    """
    # rows of one id, or of none, are told apart by how their texts begin
    texts = documents(docs, id_col, text_col).repartitionByRange("doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")
    texts.mapInArrow(_encode(tokenizer, end_id, shard_tokens), "part int, number int, n_tokens long, data binary").write.mode("overwrite").option("compression", "none").parquet(path)
    return path


def read_shards(spark, path: str) -> DataFrame:
    """One row per document from the files: ``doc_id, start, n_tokens, ids_crc32``; start counts the ids of all documents before it."""

    def make(batch: pa.RecordBatch) -> dict:
        cols: dict[str, list] = {k: [] for k in ("part", "number", "doc_id", "before", "n_tokens", "ids_crc32")}
        for part, number, data in zip(batch["part"].to_pylist(), batch["number"].to_pylist(), batch["data"], strict=True):
            shard = Shard(data.as_py())
            raw, begins = memoryview(shard.all_ids().tobytes()), np.concatenate(([0], shard.ends[:-1]))
            n = len(shard.ends)
            for c, v in zip(cols.values(), ([part] * n, [number] * n, shard.doc_ids, begins.tolist(), (shard.ends - begins).tolist(), [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), shard.ends.tolist(), strict=True)]), strict=True):
                c.extend(v)
        kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 4)
        return {k: pa.array(v, t) for (k, v), t in zip(cols.items(), kinds, strict=True)}

    shards = spark.read.schema("part int, number int, n_tokens long, data binary").parquet(path)
    rows = arrow_map(shards.select("part", "number", "data"), make, "part int, number int, doc_id long, before long, n_tokens long, ids_crc32 long")
    # sums of parts are added up first, so no task holds a row for each shard of all parts
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("n_tokens")
    starts = shards.select("part", "number", own.alias("own")).join(parts, "part").select("part", "number", (F.col("own") + F.col("earlier")).alias("first"))
    return rows.join(starts, ["part", "number"]).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_lengths(spark, path: str) -> DataFrame:
    """``doc_id, n_tokens`` of every document, from the shards' own lists; no id is decoded."""

    def make(batch: pa.RecordBatch) -> dict:
        shards = [Shard(data.as_py()) for data in batch["data"]]
        return {"doc_id": pa.array([d for s in shards for d in s.doc_ids], pa.int64()), "n_tokens": pa.array(np.concatenate([np.diff(s.ends, prepend=0) for s in shards]), pa.int64())}

    return arrow_map(spark.read.schema("data binary").parquet(path), make, "doc_id long, n_tokens long")


def token_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes the shards (to the shared folder unless ``path`` is given) and reads them back."""
    return read_shards(docs.sparkSession, write_shards(docs, path or shared_path(docs.sparkSession, "token-shards"), tokenizer, id_col=id_col, text_col=text_col))
