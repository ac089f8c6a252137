"""Ranked search, filter audit and metric join against brute force on awkward tables."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from samples import SCHEMA, awkward, frame, lower, rows_of, words

from alleloom.llm import filter_audit, metric_join, ranked_search
from alleloom.llm.common import cut

ROWS = awkward()
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ranking(rows, items, k):
    held = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in rows]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, asked in items.items():
        w = {t: math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df[t] + 1))) for t in asked if df[t]}
        scored = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n // length
            s = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in w if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out.update((item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1))
    return out


QUERIES = [(1, ROWS[10][1]), (2, "Ünïcode 東京 zzz none"), (3, None), (4, ""), (None, "word"), (5, ROWS[12][1] + " " + ROWS[20][1]), (5, ROWS[30][1]), (5, ROWS[30][1]), (6, ROWS[6][1])]


@pytest.mark.parametrize("k,shard,block", [(50, 16 << 20, 4 << 20), (3, 3000, 4 << 20), (7, 3000, 1)])
def test_search_ranks_what_all_scores_rank(spark, docs, monkeypatch, k, shard, block):
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", shard)
    items: dict = {}
    for i, t in QUERIES:
        if i is not None and TERM.findall(t or ""):
            items.setdefault(i, set()).update(TERM.findall(lower(t)))
    asked = spark.createDataFrame(QUERIES, "item_id long, text string")
    shards = cut(ranked_search.index(docs))
    assert rows_of(ranked_search.search(shards, asked, k=k, block_bytes=block), "item_id", "rank", "doc_id", "score") == ranking([(r[0], r[1]) for r in ROWS], items, k)


def test_runs_with_a_bar_give_the_scores_of_all(monkeypatch):
    """Lists fall away as the bar rises; ties at the bar stay in, smaller ids first."""
    monkeypatch.setattr(ranked_search, "RUN", 16)
    r = random.Random(3)
    stock = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(stock, weights=[1 / (i + 1) for i in range(60)], k=r.randint(1, 30))) for _ in range(500)] * 2
    ids = list(range(len(texts)))
    r.shuffle(ids)
    held = ranked_search.Shard(0)
    for i, t in zip(ids, texts, strict=True):
        held.add(i, t.encode())
    import pyarrow as pa

    rows = list(zip(ids, texts, strict=True))
    n, df = len(rows), Counter(t for _, x in rows for t in set(x.split()))
    own = ranked_search.Postings(pa.Table.from_batches([held.rows()]), n, sum(len(x.split()) for x in texts))
    for _ in range(20):
        asked = set(r.sample(stock, r.randint(1, 25)))
        places, scores = own.best([(t.encode(), ranked_search.weight(n, df[t])) for t in sorted(asked)], 10)
        got = Counter((0, k, int(own.ids[p]), int(s)) for k, (p, s) in enumerate(zip(places, scores, strict=True), 1))
        assert got == ranking(rows, {0: asked}, 10)


def test_search_of_nothing(spark, docs, none):
    asked = spark.createDataFrame(QUERIES, "item_id long, text string")
    assert ranked_search.search(cut(ranked_search.index(none)), asked).count() == 0
    assert ranked_search.search(cut(ranked_search.index(docs)), asked.where("false")).count() == 0
    assert ranked_search.search(cut(ranked_search.index(docs)), spark.createDataFrame([(1, "qqqqqqq")], "item_id long, text string")).count() == 0


def audited(rows, labels):
    least: dict = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, part in rows:
        t = t or ""
        ws = words(t)
        f = (len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t])
        good, toxic = (any(x[k] == 1 for x in labels if x[0] == i and i is not None) for k in (1, 2))
        fails.append((part or "", dict(zip("ABCDE", f, strict=True)), good, toxic))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            for step, c in enumerate(order, 1):
                gone, left = [f for f in left if f[1][c]], [f for f in left if not f[1][c]]
                all_ = [f for f in fails if f[0] == part and f[1][c]]
                shapley[part, c] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(all_) - len(gone), sum(sum(f[1].values()) == 1 for f in all_), sum(f[2] for f in gone), sum(f[3] for f in gone)]
    return Counter((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_audit_counts_what_filters_remove_one_by_one(spark, none):
    r = random.Random(5)
    rows = [(x[0], x[1] and (x[1].upper() if i % 7 == 0 else x[1] + " $" if i % 5 == 0 else x[1]), x[2], r.choice(["a", "b", "", None]), *x[4:]) for i, x in enumerate(ROWS)]
    rows += [(i, "same text " * 3, "en", r.choice(["a", "b"]), 1, 1, "t", "r", "w", 2, "k") for i in (900, 901, 901, 902, None)]
    rows += [(950, " ".join(f"w{i}" for i in range(250)), "en", "rare", 1, 1, "t", "r", "w", 2, "k")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 60)] + [(4, 1, 1), (4, None, None), (None, 1, 1), (901, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = rows_of(filter_audit.audit(frame(spark, rows), marks), *names)
    assert got == audited([(x[0], x[1], x[3]) for x in rows], labels)
    assert filter_audit.audit(none, marks).count() == 0
    assert filter_audit.audit(frame(spark, rows), marks.where("false")).where("good_lost + toxic_lost > 0").count() == 0


def joined(rows):
    """(doc_id, n_shingles, component_id) by comparing all with all."""
    sets = []
    for _, t in rows:
        ws = words(lower(t or ""))
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def crowd(seed=11):
    """Copies of three texts, edited a little, much, or step by step, and texts around one passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    for edits in (1, 3, 6):
        base = [word() for _ in range(120)]
        for _ in range(40):
            t = list(base)
            for at in r.sample(range(len(t)), edits):
                t[at] = word()
            rows.append(" ".join(t))
    chain = [word() for _ in range(100)]
    for _ in range(30):
        chain = list(chain)
        chain[r.randrange(100)] = word()
        chain[r.randrange(100)] = word()
        rows.append(" ".join(chain))
    passage = " ".join(word() for _ in range(60))
    rows += [f"{passage} {' '.join(word() for _ in range(r.randint(5, 40)))}" for _ in range(60)]
    rows += ["one two three", "one two three", "One two  three", "one two", "a b c d e", "a b c d e f"]
    return list(enumerate(rows))


@pytest.mark.parametrize("leaf", [64, 8, 2])
def test_join_links_what_all_pairs_link(spark, none, monkeypatch, leaf):
    monkeypatch.setattr(metric_join, "LEAF", leaf)
    for rows in ([(x[0], x[1]) for x in ROWS], crowd()):
        made = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(5)
        assert rows_of(metric_join.near_duplicates(made), "doc_id", "n_shingles", "component_id") == joined(rows)
    assert metric_join.near_duplicates(none).count() == 0


def test_prefixes_of_linked_sets_meet():
    r = np.random.default_rng(2)
    common = np.sort(r.choice(1 << 20, 200, replace=False).astype(np.uint64))
    rank = r.permutation(200)
    for _ in range(300):
        n = int(r.integers(1, 60))
        a = r.choice(1 << 20, n, replace=False).astype(np.uint64)
        a[: n // 3] = r.choice(common, n // 3, replace=False)
        a = np.unique(a)
        b = np.unique(np.concatenate((a[r.random(len(a)) > 0.12], r.integers(0, 1 << 20, int(r.integers(0, 5))).astype(np.uint64))))
        both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if len(b) and 5 * both >= 4 * either:
            assert len(np.intersect1d(metric_join.prefix(a, common, rank), metric_join.prefix(b, common, rank)))


def test_shingles_left_out_lose_no_link_and_chance_ones_make_no_pairs(spark):
    """op13: of any order of shingles and any counts, linked sets keep enough in common; sets that share a few common shingles make no region."""
    r = np.random.default_rng(8)
    none = np.zeros(0, np.uint64)
    for n in [*range(1, 30), 60, 117, 200]:
        for _ in range(6):
            pool = np.sort(r.choice(1 << 40, 3 * n + 3, replace=False).astype(np.uint64))
            a = pool[np.sort(r.permutation(len(pool))[:n])]
            gone = int(r.integers(0, n // 5 + 1))
            b = np.sort(np.concatenate((r.permutation(a)[: n - gone], np.setdiff1d(pool, a)[: int(r.integers(0, max(1, n // 5)))])))
            both = len(np.intersect1d(a, b))
            if 5 * both < 4 * len(np.union1d(a, b)):
                continue
            times = dict(zip(pool.tolist(), r.integers(2, 9, len(pool)).tolist(), strict=True))
            kept = []
            for s in (a, b):
                left = -(-4 * len(s) // 5) // 10
                kept.append(set(sorted(metric_join.prefix(s, none, none).tolist(), key=lambda t: (-times[t], -t))[left:]))
            beyond, left = ([f(len(s)) for s in (a, b)] for f in (lambda k: -(-4 * k // 5) - 1 - k // 10, lambda k: -(-4 * k // 5) // 10))
            assert len(kept[0] & kept[1]) >= max(1, -(-4 * (len(a) + len(b)) // 9) - max(beyond) - max(left))
            sizes = spark.range(1).selectExpr(f"{len(a)}L n", f"{len(b)}L np", f"{len(kept[0] & kept[1])}L c") if n in (1, 7, 117) else None
            assert sizes is None or sizes.where(metric_join.ENOUGH).count() == 1
    rows = [(i, 100, [*range(5), *range(1000 * (i + 1), 1000 * (i + 1) + 26)]) for i in range(40)]
    nodes = spark.createDataFrame(rows, "node long, n long, prefix array<long>")
    assert metric_join.first_regions(nodes).count() == 0
