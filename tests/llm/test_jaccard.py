"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random
from collections import Counter

import pytest
from conftest import DATA
from samples import lower, words

from alleloom.llm import jaccard
from alleloom.llm.common import table
from alleloom.llm.pipeline_stages import keep_one_of_each


def shingle_set(text) -> frozenset:
    ws = words(lower(text or ""))
    return frozenset(" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def groups(texts: list) -> list[int]:
    """For each text the number of its component at similarity 0.8 or more."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def kept(spark, rows: list[tuple]) -> Counter:
    return Counter(r["doc_id"] for r in keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect())


def expected(rows: list[tuple]) -> Counter:
    least = {}
    for (i, _), k in zip(rows, groups([t for _, t in rows]), strict=True):
        least[k] = min(i, least.get(k, i))
    return Counter(least.values())


def edited(r: random.Random, text: str, n: int) -> str:
    ws = text.split()
    for at in r.sample(range(len(ws)), n):
        ws[at] = f"new{r.random()}"
    return " ".join(ws)


def test_recall_at_the_stated_similarity():
    assert jaccard.recall(0.8) > 0.999


@pytest.mark.parametrize("size,copies", [(300, 3), (120, 60)])
def test_edited_copies_go_as_by_brute_force(spark, size, copies):
    r = random.Random(size)
    rows = []
    for k in range(12):
        base = " ".join(f"w{k}x{r.randrange(10**6)}" for _ in range(size))
        rows += [(1000 * k + i, edited(r, base, min(i % 4 * 2, size // 60 + i % 3))) for i in range(copies)]
    rows += [(90001, None), (90002, "  "), (90003, "a b"), (90004, "A  b")]
    want = expected(rows)
    assert len(want) < len(rows)
    assert kept(spark, rows) == want


@pytest.mark.parametrize("pivots", [1, 2])
def test_copies_of_several_templates_with_different_edits(spark, monkeypatch, pivots):
    """Copies that differ from the pivot by more than a link allows, and templates that share buckets."""
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    r = random.Random(pivots)
    base = " ".join(f"b{i}" for i in range(150))
    templates = [base, edited(r, base, 3), edited(r, base, 4)]
    rows = []
    for k, t in enumerate(templates):
        for i in range(70):
            text = edited(r, t, r.choice([0, 1, 1, 2, 2, 3, 4, 5, 6]))
            if r.random() < 0.2:  # some share an edit
                text = text.replace(f"b{r.choice([40, 41])}", f"same{r.choice([1, 2])}")
            rows.append((100 * k + i, text if r.random() < 0.8 else text + " " + " ".join(f"tail{r.random()}" for _ in range(r.randint(1, 20)))))
    rows = [x for x in rows if x[1] != base]
    want = expected(rows)
    assert 20 < len(want) < len(rows) - 50
    assert kept(spark, rows) == want


def test_documents_of_the_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").select("doc_id", "text").collect()]
    assert kept(spark, rows) == expected(rows)


def test_pairs_that_neither_bands_nor_chains_meet_are_found(spark):
    """seeds whose two texts are at similarity 0.8 and share no band; alone, or with copies that make two components of theirs."""
    rows = []
    for k, seed in enumerate([296, 522, 1697]):
        r = random.Random(seed)

        def some(n, r=r):
            return [f"w{r.randrange(10**6)}" for _ in range(n)]

        common = some(44)
        x, y = (" ".join(common + some(5)) for _ in range(2))
        a, b = (jaccard.shingles(t.encode()) for t in (x, y))
        assert not set(jaccard.bands(a).tolist()) & set(jaccard.bands(b).tolist())
        rows += [(100 * k, x), (100 * k + 1, y)]
        if k:
            rows += [(100 * k + 10 + i, t + f" end{i}" * i) for t in (x, y) for i in range(k + 2)]
    rows += [(900 + i, " ".join(f"other{i}x{j}" for j in range(30))) for i in range(5)]
    want = expected(rows)
    assert len(want) == 3 + 5
    assert kept(spark, rows) == want
