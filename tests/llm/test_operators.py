"""Operators against brute force on a table with nulls, empty and long texts, copies, repeated rows and clashing names."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from conftest import DATA
from samples import SCHEMA, awkward, contains, crc, cut_repeats, frame, linked, lower, rows_of, simhash, unigram, words

from alleloom.llm import classifier, decontamination, lattice_lm, licenses, packing, quality_rules, ranking, sharding, simhash as sh, suffix_dedup, token_output
from alleloom.llm.components import components
from alleloom.llm.queries import QUERIES, tokenizer_path

ROWS = awkward()
IDS_TEXTS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ledger_counts_words_and_repeats(docs, none):
    def brute(text):
        ws = words(text)
        grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
        n = Counter(grams)
        inside = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)

    got = rows_of(quality_rules.ledger(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == Counter((i, *brute(t)) for i, t in IDS_TEXTS)
    assert quality_rules.ledger(none).count() == 0
    kept = quality_rules.apply_policies(quality_rules.ledger(docs))
    assert {"kept_base", "kept_v1", "kept_v2"} < set(kept.columns) and kept.where("kept_v2 and not kept_v1").count() == 0
    stored = quality_rules.stored(docs)
    rows = {r["rule"]: r for r in quality_rules.ablations(stored, "v1").collect()}
    assert rows["few_words"]["n_failed"] == sum(len(words(t)) < 10 for _, t in IDS_TEXTS)
    assert "MapInArrow" not in stored._jdf.queryExecution().executedPlan().toString()


def test_policies_and_ablations_count_what_single_rows_say(docs):
    rows = [r.asDict() for r in quality_rules.apply_policies(quality_rules.stored(docs)).collect()]
    checks = {"few_words": lambda r: r["n_words"] < 10, "repeated_words": lambda r: 100 * r["n_repeat_words"] > 20 * r["n_words"], "symbols": lambda r: 10 * r["n_symbols"] > r["n_words"], "repeated_lines": lambda r: 100 * r["n_dup_lines"] > 30 * r["n_lines"], "short_words": lambda r: r["word_chars"] < 2 * r["n_words"], "long_words": lambda r: r["word_chars"] > 14 * r["n_words"], "shouting": lambda r: 2 * r["n_upper"] > r["n_upper"] + r["n_lower"], "no_letters": lambda r: 100 * r["n_wordless"] > 40 * r["n_words"]}
    for policy, mask in quality_rules.POLICIES.items():
        rules = [k for k in checks if quality_rules.BIT[k] & mask]
        failed = [{k for k in rules if checks[k](r)} for r in rows]
        assert [r[f"kept_{policy}"] for r in rows] == [not f for f in failed]
        got = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept_without"]) for r in quality_rules.ablations(quality_rules.stored(docs), policy).collect()}
        assert got == {k: (sum(k in f for f in failed), sum(f == {k} for f in failed), sum(not f - {k} for f in failed)) for k in rules}


def test_tokens_come_back_from_the_shards(docs, none):
    import zlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    order = sorted(IDS_TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = Counter(), 0
    for i, text in order:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    assert rows_of(token_output.token_table(docs, tokenizer_path("word_bpe_49k.json")), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert token_output.token_table(none, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_word_table_gives_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    path, r = tokenizer_path("word_bpe_49k.json"), random.Random(5)
    t, memo = Tokenizer.from_file(path), token_output.WordIds(path, limit=500)
    bits = ["a", "B", "é", "É", "ß", "'s", "'T", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", ",", ".", "!", "*", "$", "%", "#", "&", "\u0300", "\u0331", "H", "İ", "Σ", "1", "²", "ª", "×", "—", "’", "日本", " ", " ", "\n", "\u00a0", "\x85", "foo", "\u212a", "😀"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(5000)]
    for at in range(0, len(texts), 250):
        part = [token_output.words_of(x.encode()) for x in texts[at : at + 250]]
        ids = memo.of(part)
        for text, ws in zip(texts[at:], part, strict=False):
            assert np.frombuffer(b"".join(ids[w] for w in ws), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_refused(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.BPE({"a": 0, "b": 1, " ": 2, "<unk>": 3}, [], unk_token="<unk>"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        token_output.WordIds(str(tmp_path / "t.json"))


def test_grammar_replaces_every_pair_that_pays():
    """No pair within a document is left that occurs often, runs of one id included; the most frequent go first."""
    r = np.random.default_rng(1)
    words = [r.integers(0, 500, int(n)) for n in r.integers(2, 9, 60)]
    parts = [np.concatenate([words[i] for i in np.minimum(r.geometric(0.05, 40), 60) - 1] + [np.full(30, 7)]) for _ in range(50)]
    ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    symbols, rules, stops = token_output.repair(ids, ends, 1000, least=4)
    assert (token_output.expanded(symbols, rules, 1000) == ids).all()
    lengths = np.append(np.ones(1000, int), token_output.rule_lengths(rules, 1000))[symbols]
    assert (np.cumsum(lengths)[stops - 1] == ends).all()
    inner = np.ones(len(symbols), bool)
    inner[stops - 1] = False
    pairs = Counter(zip(symbols[:-1][inner[:-1]].tolist(), symbols[1:][inner[:-1]].tolist(), strict=True))
    assert max(pairs.values()) < 4 and len(symbols) < len(ids) / 5
    first = Counter()
    for p in parts:
        first.update(zip(p[:-1].tolist(), p[1:].tolist(), strict=True))
    assert first[tuple(rules[0].tolist())] == max(first.values())
    few, limited, _ = token_output.repair(ids, ends, token_output.SYMBOLS - 5, least=2)
    assert len(limited) == 4  # the last 16-bit number stands for no symbol
    wide, rules, _ = token_output.repair(ids, ends, token_output.SYMBOLS + 9, least=4)
    assert len(rules) > 4 and (token_output.expanded(wide, rules, token_output.SYMBOLS + 9) == ids).all()


def test_shard_random_access():
    r = np.random.default_rng(3)
    phrase = r.integers(0, 900, 40)
    parts = [np.concatenate([phrase if r.random() < 0.6 else r.integers(0, 900, 17) for _ in range(int(r.integers(0, 30)))] or [np.zeros(0, int)]).astype("<u4") for _ in range(40)]
    ends = np.cumsum([len(p) for p in parts])
    data = token_output.pack_shard(np.concatenate(parts), ends, [None, *range(1, 40)], 1000)
    shard = token_output.Shard(data)
    assert len(shard.rules) and len(data) < 3 * ends[-1] and shard.doc_ids[0] is None
    for k, p in enumerate(parts):
        assert (shard.ids(k) == p).all()
        a = len(p) // 3
        assert (shard.ids(k, a, 2 * a) == p[a : 2 * a]).all()
    assert (shard.all_ids() == np.concatenate(parts)).all()
    with pytest.raises(ValueError):
        token_output.Shard(b"\0" * 100)


def test_simhash_components(docs, none):
    fps = [simhash(t) for _, t in IDS_TEXTS]
    roots = linked(fps)
    least = {}
    for (i, _), k in zip(IDS_TEXTS, roots, strict=True):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    want = Counter((i, f"{f:016x}", least.get(k)) for (i, _), f, k in zip(IDS_TEXTS, fps, roots, strict=True))
    assert rows_of(sh.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert sh.near_duplicates(none).count() == 0


@pytest.mark.parametrize("limit", [0, 3, 64])
def test_simhash_links_of_crowded_buckets(spark, limit):
    r = random.Random(limit)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 4))}) for b in base for _ in range(14)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = sorted(fps)
    got = {r["node"]: r["root"] for r in components(sh.links(spark.createDataFrame([(signed(f),) for f in nodes], "fp long"), 2, limit)).collect()}
    mine = linked(nodes)
    group = [got.get(signed(f), signed(f)) for f in nodes]
    assert len(set(zip(mine, group, strict=True))) == len(set(mine)) == len(set(group))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (1000, 1001), (1001, 1002), (1002, 1000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1003)}}


def test_contaminated_texts(spark, docs, none):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    items = [(k, " ".join(word() for _ in range(24))) for k in range(6)] + [(6, None), (7, ""), (8, "tiny"), (None, "nothing here")]
    edited = list(items[1][1])
    for at in (20, 60, 100):
        edited[at] = "z"
    texts = [(900, "Some " + items[0][1].upper() + " after"), (901, "in " + "".join(edited) + " it"), (902, items[2][1][:45]), (903, " ".join(word() for _ in range(50))), (904, items[3][1].replace(" ", "\n  ")), (None, items[4][1]), (905, items[5][1][8:140])]
    all_rows = ROWS + [(i, t, *ROWS[0][2:]) for i, t in texts]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(frame(spark, all_rows), bench).collect()}
    want = set()
    for item, text in items:
        if item is None or not text or len(text) < 20:  # shorter ones are in the next test
            continue
        parts = [text[a : a + 80] for a in {*range(0, max(0, len(text) - 80), 40), max(0, len(text) - 80)}]
        for i, t in [*texts, *[x for x in IDS_TEXTS if len(x[1] or "") < 400]]:
            if any(contains(t, p, int(len(p) * 0.075)) <= int(len(p) * 0.075) for p in parts):
                want.add((i, item))
    assert got == want == {(900, 0), (901, 1), (904, 3), (None, 4), (905, 5)}
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(docs, bench.where("false")).count() == 0
    many = decontamination.contaminated(frame(spark, all_rows), bench, block_bytes=100)
    assert {(x["doc_id"], x["item_id"]) for x in many.collect()} == want
    with pytest.raises(ValueError):
        decontamination.Searched([], size=138)


def test_short_items_match_whole_words_and_rows_repeat(spark):
    bench = spark.createDataFrame([(1, "forty two!"), (2, "a tiny one"), (3, "yes"), (4, "exactly nineteen ab")], "item_id long, text string")
    texts = [(1, "it is Forty  Two! indeed"), (1, "it is Forty  Two! indeed"), (2, "forty two!x"), (3, "xforty two!"), (4, "forty two!"), (5, "a tiny\none"), (6, "a tiny ones"), (7, "yes"), (8, "so exactly nineteen ab"), (9, "exactly ninteen ab"), (None, "a tiny one"), (None, "a tiny one"), (10, "forty two! forty two!")]
    texts += [(11, "exactly nineteen  abc"), (12, "exactly ninetee ab"), (13, "oh yes"), (14, "yesterday"), (15, "exactly nineteen abcd"), (16, "forty twx!")]
    got = Counter((x["doc_id"], x["item_id"]) for x in decontamination.contaminated(frame(spark, [(i, t, *ROWS[0][2:]) for i, t in texts]), bench).collect())
    assert got == Counter({(1, 1): 2, (4, 1): 1, (5, 2): 1, (7, 3): 1, (8, 4): 1, (9, 4): 1, (11, 4): 1, (12, 4): 1, (13, 3): 1, (None, 2): 2, (10, 1): 1})


def sellers(text: str, item: str) -> int:
    return contains(text, item, len(item))


def test_parts_of_items_against_all_alignments():
    """Without the operator's segments: every copy of 120 bytes or of a whole shorter item is found, and what is found aligns well somewhere."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((2, 3, 4, 5, 6, 8, 12, 20, 40, 60))]
    searched = decontamination.Searched([(k, t.encode()) for k, t in items])
    for item, text in items:
        for turn in range(6):
            at = r.randint(0, max(0, len(text) - 120))
            part = text[at : at + 120] if turn % 2 else text
            m = min(len(part), 80)
            edited = list(part)
            for place in r.sample(range(len(part)), int(0.075 * m) if len(part) <= 80 else int(0.05 * 40)):
                edited[place] = r.choice(["", "z", edited[place] + "z"]) if edited[place] != " " else " "
            found = decontamination.matches(f"{word()} {word()} {''.join(edited)} {word()}".encode(), searched)
            assert item in found, (text, "".join(edited))
        clean = " ".join(word() for _ in range(60))
        for k in decontamination.matches(clean.encode(), searched):
            own = dict(items)[k]
            parts = [own] if len(own) <= 80 else [own[a : a + 80] for a in range(len(own) - 79)]
            assert min(sellers(clean, p) for p in parts) <= 0.075 * len(parts[0])


@pytest.mark.parametrize("letters,items,times,end", [("a", 300, 20_000, ""), ("ab", 300, 20_000, ""), ("a", 1, 5_000_000, ""), ("abc ", 40, 400_000, ""), ("a", 20, 20_000, "z")])
def test_repetitive_texts_take_bounded_memory(letters, items, times, end):
    import tracemalloc

    stock = [(k, ((letters * 80)[: 70 + k % 10] + end).encode()) for k in range(items)]
    searched = decontamination.Searched(stock)
    text = (letters * (times // len(letters))).encode()
    tracemalloc.start()
    found = decontamination.matches(text, searched)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(found) == set(range(items)) and most < 400 << 20, most >> 20


def test_repeated_rows_are_found_each(spark):
    item = "a passage of some length that is part of the benchmark and was copied"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontamination.contaminated(frame(spark, [(5, "x " + item, *ROWS[0][2:])] * 3 + [(6, None, *ROWS[0][2:])]), bench).collect()
    assert [(x["doc_id"], x["item_id"]) for x in got] == [(5, 1)] * 3


def licensed(text) -> Counter:
    """Templates of whose five-word shingles a text has four fifths, with the shingles found."""
    def grams(t):
        ws = regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}

    own = grams(text)
    return Counter((k, n, len(grams(v))) for k, v in licenses.TEMPLATES.items() if (n := len(own & grams(v))) >= 0.8 * len(grams(v)))


def test_license_scan(spark, none):
    t = licenses.TEMPLATES
    texts = [(1, "x " * 50 + t["mit-permission"].upper() + " y" * 9), (2, "released under the mit license"), (3, "released under the license"), (4, None), (5, ""), (6, " ".join(t["bsd-redistribution"].split()[:9])), (None, t["gpl-3.0"]), (2, "released under the mit license")]
    texts += [(7, t["mit"] + ". " + t["no-warranty"].title() + " " + " ".join(t["apache-2.0"].split()[1:])), (8, " ".join(t["mit-permission"].split()[k] for k in range(19) if k != 9)), (9, "word " * 20_000 + t["cc-by-nc-4.0"]), (2, "other"), (10, "the license and the software under the mit license version is granted " + t["mit"])] * 2
    got = rows_of(licenses.scan(frame(spark, [(i, t, *ROWS[0][2:]) for i, t in texts])), "doc_id", "license", "n_found", "n_shingles")
    want = Counter()
    for i, x in texts:
        want.update({(i, *k): n for k, n in licensed(x).items()})
    assert got == want and {(1, "mit-permission"), (2, "mit"), (None, "gpl-3.0")} <= {k[:2] for k in got} and got[2, "mit", 1, 1] == 2
    assert licenses.scan(none).count() == 0 and licenses.scan(frame(spark, ROWS), {}).count() == 0


def test_edited_licenses_are_found_whichever_way_sides_meet(spark, monkeypatch):
    """Copies of every template with words replaced, put in or left out, among its own words, against all templates."""
    r = random.Random(3)
    fill = [w for v in licenses.TEMPLATES.values() for w in v.split()]
    texts = []
    for v in licenses.TEMPLATES.values():
        for _ in range(12):
            ws = v.split()
            for _ in range(r.randint(0, max(1, len(ws) // 20))):
                at = r.randrange(len(ws))
                ws[at : at + r.randint(0, 1)] = r.choice([[], ["zzz"], [r.choice(fill)]])
            texts.append((len(texts), " ".join([*(r.choice(["foo", "the", "of"]) for _ in range(r.randint(0, 60))), *ws, "tail words"])))
    want = Counter()
    for i, x in texts:
        want.update({(i, *k): n for k, n in licensed(x).items()})
    df = frame(spark, [(i, x, *ROWS[0][2:]) for i, x in texts])
    assert rows_of(licenses.scan(df), "doc_id", "license", "n_found", "n_shingles") == want and sum(want.values()) > len(licenses.TEMPLATES) * 6
    monkeypatch.setattr(licenses, "BROADCAST_CHARACTERS", 0)
    assert rows_of(licenses.scan(df), "doc_id", "license", "n_found", "n_shingles") == want


def test_a_long_text_of_licenses_and_one_of_other_words(spark):
    whole = " ".join(licenses.TEMPLATES.values())
    df = frame(spark, [(1, whole * 100, *ROWS[0][2:]), (2, "word " * 300_000 + whole, *ROWS[0][2:]), (3, "the software " * 50_000, *ROWS[0][2:])])
    got = rows_of(licenses.scan(df), "doc_id", "license")
    assert got == Counter({(i, k): 1 for i in (1, 2) for k in licenses.TEMPLATES})


def test_trees_learn_and_score_every_row(spark, docs, none):
    held = QUERIES["op6_boosted_trees"](spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = [x["score"] for x in held if x["quality"] == 1], [x["score"] for x in held if x["quality"] == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.85, auc
    trees = classifier.train(docs, spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 1), (10, None, 1), (999, 1, 1)], "doc_id long, quality int, text int"))
    got = classifier.score(docs, trees).collect()
    assert len(got) == len(ROWS) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got)
    assert classifier.score(none, trees).count() == 0
    assert {x["score"] for x in classifier.score(docs, classifier.train(none, spark.createDataFrame([], "doc_id long, quality int"))).collect()} == {0.5}


def test_flattened_trees_follow_their_splits():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 4))
    y = (x[:, 1] + 0.3 * x[:, 2] > 0).astype(float)
    t = classifier.fit(x, y, trees=20)

    def walk(row):
        total = t.start
        for at in t.roots:
            while t.left[at] != at:
                at = t.left[at] if row[t.feature[at]] <= t.threshold[at] else t.right[at]
            total += t.value[at]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(t.score(x), [walk(v) for v in x]) and ((t.score(x) > 0.5) == y).mean() > 0.95


def test_splits_are_the_best_of_all():
    """Of every node's splits at the bins' edges the one with the greatest gain is taken, the first of equals; leaves have none that pays."""
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(300, 5)), 1)
    y = (x[:, 1] * x[:, 3] + 0.2 * r.normal(size=300) > 0).astype(float)
    bins, least, smooth = 16, 12, 1.0
    t = classifier.fit(x, y, trees=1, depth=3, bins=bins, least=least, smooth=smooth, rate=0.3)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(5)]
    p = 1 / (1 + math.exp(-t.start))
    g, h = y - p, np.full(300, p * (1 - p))
    part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + smooth)
    todo, seen = [(0, np.arange(300), 0)], 0
    while todo:
        k, rows, deep = todo.pop()
        assert math.isclose(t.value[k], 0.3 * g[rows].sum() / (h[rows].sum() + smooth))
        gains = {}
        for f in range(5):
            for e in edges[f]:
                go = x[rows, f] <= e
                if least <= go.sum() <= len(rows) - least:
                    gains[f, e] = part(rows[go]) + part(rows[~go]) - part(rows)
        if t.left[k] == k:
            assert deep == 3 or not gains or max(gains.values()) <= 1e-6 or len(rows) < 2 * least
            continue
        seen += 1
        chosen = t.feature[k], t.threshold[k]
        assert math.isclose(gains[chosen], max(gains.values()))
        go = x[rows, chosen[0]] <= chosen[1]
        todo += [(t.left[k], rows[go], deep + 1), (t.right[k], rows[~go], deep + 1)]
    assert seen >= 4


def test_lattice_scores(docs, none):
    """The words' marginals are those of the next test; here every text's sums, from counts of the whole table."""
    path = tokenizer_path("piece_bpe_32k.model")
    got = lattice_lm.score(docs, path).collect()
    key = lambda x: (str(x[0]), *x[1:5], round(x[5], 6))
    assert Counter(map(key, got)) == Counter(map(key, unigram(IDS_TEXTS)))
    toks = [(i, words(lower(t or ""))) for i, t in IDS_TEXTS]
    train = [ws for i, ws in toks if crc(i, 10) != 0]
    c = Counter(w for ws in train for w in ws)
    pieces, everyone = lattice_lm.vocabulary(path), sorted({w for _, ws in toks for w in ws})
    own, logs, kinds = lattice_lm.Lattice(lattice_lm.vocabulary(path)), lattice_lm.prior(pieces), sorted(c)
    for _ in range(2):
        logs = lattice_lm.maximised(own.expected(kinds, np.array([c[w] for w in kinds], float), logs), pieces, 0.1, len(train))
    stop = 1 - np.exp(logs[sorted(pieces.values())]).sum()
    assert stop > 0 and math.isclose(math.log(stop), lattice_lm.end_log(logs))
    sub = dict(zip(everyone, own.marginal(everyone, logs).tolist(), strict=True))
    total = sum(c.values()) + len(train)
    spare = (sum(n == 1 for n in c.values()) + 1) / (total + 1)
    whole = {w: math.log((1 - spare) * c[w] / total + spare * math.exp(s)) if c[w] else s + math.log(spare) for w, s in sub.items()}
    end = len(train) / total
    want = Counter((str(i), round((sum(sub[w] for w in ws) + math.log(stop)) / math.log(10), 5), round((sum(whole[w] for w in ws) + math.log((1 - spare) * end)) / math.log(10), 5)) for i, ws in toks)
    assert Counter((str(x["doc_id"]), round(x["score"], 5), round(x["word_score"], 5)) for x in got) == want
    assert lattice_lm.score(none, path).count() == 0


def test_long_words_are_reached_in_parts(monkeypatch):
    path = tokenizer_path("piece_bpe_32k.model")
    own, r = lattice_lm.Lattice(lattice_lm.vocabulary(path)), random.Random(4)
    logs = lattice_lm.prior(lattice_lm.vocabulary(path))
    some = ["".join(r.choice("abcdeinrst東é") for _ in range(n)) for n in (40, 97, 400, 401, 1500)] + ["a" * 700]
    counts = np.arange(1.0, 7.0)
    want = own.marginal(some, logs), own.expected(some, counts, logs)
    monkeypatch.setattr(lattice_lm, "LONG", 30)
    assert own.marginal(some, logs) == pytest.approx(want[0], abs=1e-6)
    assert own.expected(some, counts, logs) == pytest.approx(want[1], abs=1e-6)


def test_a_very_long_word_takes_seconds():
    import time

    path = tokenizer_path("piece_bpe_32k.model")
    own, r = lattice_lm.Lattice(lattice_lm.vocabulary(path)), random.Random(4)
    word = "".join(r.choice("abcdeinrst") for _ in range(200_000))
    began = time.process_time()
    assert own.marginal([word], lattice_lm.prior(lattice_lm.vocabulary(path)))[0] < -100_000
    assert time.process_time() - began < 60


def test_scores_where_all_are_held_out(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    ids = [i for i in range(300) if crc(i, 10) == 0][:5]
    rows = [(i, "one two", *ROWS[0][2:]) for i in ids] + [(ids[0], None, *ROWS[0][2:])]
    got = lattice_lm.score(frame(spark, rows), path).collect()
    key = lambda x: (str(x[0]), *x[1:5], round(x[5], 6))
    assert Counter(map(key, got)) == Counter(map(key, unigram([r[:2] for r in rows])))
    assert all(x["base_score"] == 0 and x["train_tokens"] == 0 and x["n_known"] == 0 and x["score"] < 0 for x in got)


def test_all_short_texts_have_a_probability_of_one_at_most():
    """Words of two letters over a tiny vocabulary, with the end."""
    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "▁a", "ab", *[f"<0x{b:02X}>" for b in range(256)]])}
    own = lattice_lm.Lattice(pieces)
    words_ = ["a", "b", "ab", "ba", "aa", "bb"]
    logs = lattice_lm.maximised(own.expected(words_, np.ones(6), lattice_lm.prior(pieces)), pieces, 0.1, 3)
    one = np.exp(own.marginal(words_, logs)).sum()
    stop = math.exp(lattice_lm.end_log(logs))
    assert 0 < one < 1 - stop and stop * sum(one**n for n in range(50)) <= 1


def test_lattice_sums_all_segmentations():
    score = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -1.5, "▁a": -2.2, "ba": -4.0, "éa": -3.5, **{f"<0x{b:02X}>": -9.0 - b / 1000 for b in range(256)}}
    pieces = {p: i for i, p in enumerate(score)}
    logs = np.array(list(score.values()))

    def ways(text):
        """(log probability, pieces) of every way to write the text."""
        if not text:
            return [(0.0, ())]
        first = [(score[text[:n]], (text[:n],), text[n:]) for n in range(1, len(text) + 1) if text[:n] in score]
        if text[0] not in score:
            own = tuple(f"<0x{b:02X}>" for b in text[0].encode())
            first.append((sum(score[b] for b in own), own, text[1:]))
        return [(x + y, p + q) for x, p, rest in first for y, q in ways(rest)]

    own = lattice_lm.Lattice(pieces)
    some = ["ab", "abab", "ba", "aéb", "éa", "", "東a", "abéabbaab", "zé"]
    found = [ways("▁" + w) for w in some]
    sums = [sum(math.exp(x) for x, _ in f) for f in found]
    assert own.marginal(some, logs) == pytest.approx([math.log(x) for x in sums])
    counts = np.arange(1.0, len(some) + 1)
    used = np.zeros(len(pieces))
    for f, whole, n in zip(found, sums, counts, strict=True):
        for x, parts in f:
            for part in parts:
                used[pieces[part]] += n * math.exp(x) / whole
    assert own.expected(some, counts, logs) == pytest.approx(used)


def test_expectation_and_maximisation_raise_the_likelihood(docs):
    path = tokenizer_path("piece_bpe_32k.model")
    c = Counter(w for _, t in IDS_TEXTS for w in words(lower(t or "")))
    kinds, n = list(c), np.array(list(c.values()), float)
    own, pieces = lattice_lm.Lattice(lattice_lm.vocabulary(path)), lattice_lm.vocabulary(path)
    logs, before = lattice_lm.prior(pieces), -math.inf
    for _ in range(4):
        now = float(own.marginal(kinds, logs) @ n)
        assert now > before
        logs, before = lattice_lm.maximised(own.expected(kinds, n, logs), pieces, 1e-9), now


def test_bounded_ring(docs, none):
    got = sharding.shard(docs).collect()
    assert Counter((x["doc_id"], x["size"]) for x in got) == Counter((i, len((t or "").encode()) + 1) for i, t in IDS_TEXTS)
    counts = Counter(x["shard"] for x in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(counts[s]))
    assert sharding.shard(none).count() == 0


def walked(places: list[int], shards: int, nodes: int) -> Counter:
    """(place, shard) counts by walking the ring key by key: own shards first, then clockwise to one with room."""
    at = sorted((int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:3], 16), s) for s in range(shards) for v in range(nodes))
    at = [x for i, x in enumerate(at) if not i or at[i - 1][0] != x[0]]  # of nodes at one place the least shard's counts
    room = {s: len(places) // shards + (s < len(places) % shards) for s in range(shards)}
    out, left = Counter(), []
    for p in sorted(places):
        s = next((x for q, x in at if q >= p), at[0][1])
        if room[s]:
            room[s] -= 1
            out[p, s] += 1
        else:
            left.append(p)
    for p in left:
        s = next(x for q, x in [y for y in at if y[0] >= p] + at if room[x])
        room[s] -= 1
        out[p, s] += 1
    return out


def test_bounded_ring_is_that_of_single_steps(spark):
    r = random.Random(2)
    rows = [(None, f"text {k % 40}") for k in range(150)] + [(7, "same")] * 60 + [(i, "a" * r.randint(0, 9)) for i in range(300)] + [(9, None)]
    got = sharding.shard(frame(spark, [(i, t, *ROWS[0][2:]) for i, t in rows])).collect()
    place = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:3], 16)
    assert Counter((place(x["doc_id"]), x["shard"]) for x in got) == walked([place(i) for i, _ in rows], 16, 64)
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in got) == Counter((i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert {(x["law"], x["grown_shard"]) for x in got} == {("rows", None)}
    for s in range(16):
        slots = sorted(x["slot"] for x in got if x["shard"] == s)
        assert slots == list(range(len(slots)))


def test_copies_beyond_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CHUNK", 7)
    rows = [(None, "x")] * 100 + [(5, "y")] * 7 + [(i, "z") for i in range(10)]
    df = frame(spark, [(i, t, *ROWS[0][2:]) for i, t in rows])
    got = sharding.shard(df).collect()
    assert Counter(x["doc_id"] for x in got) == Counter(i for i, _ in rows)
    assert all(sorted(x["slot"] for x in got if x["shard"] == s) == list(range(n)) for s, n in Counter(x["shard"] for x in got).items())
    packed = packing.pack_documents(df, batch_tokens=10).collect()
    assert len({(x["bucket"], x["batch"], x["place"]) for x in packed}) == len(rows)


def test_ring_moves_few_keys():
    counts = {p: 3 for p in range(0, 4096, 3)}

    def owners(n):
        out = {}
        parts = sharding.allot(counts, n)
        for place, first, s, _ in sorted(parts):
            for k in range(first, counts[place]):
                out[place, k] = s
        return out

    a, b = owners(16), owners(17)
    assert sum(a[k] != b[k] for k in a) / len(a) < 0.4


def test_bucket_boundaries_are_optimal():
    from itertools import combinations

    r = random.Random(1)
    for _ in range(60):
        tops = sorted(r.sample(range(1, r.choice([14, 90])), 9))
        histogram = [(t, r.randint(1, r.choice([1, 30]))) for t in tops]
        for k in (1, 2, 3, 4, 12):
            cost = lambda cuts: sum((min(c for c in cuts if c >= t) - t) * n for t, n in histogram)
            best = min(cost([*c, tops[-1]]) for c in combinations(tops[:-1], min(k, 9) - 1))
            assert cost(packing.boundaries(histogram, k)) == best


def test_boundaries_of_a_long_histogram():
    r = random.Random(5)
    histogram = [(t, r.randint(1, 10**6)) for t in range(1, 3000)]
    top, count = np.array(histogram, np.int64).T
    c, s = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(top * count)))
    best = top * c[1:] - s[1:]
    for _ in range(4):
        best = np.array([(np.concatenate(([0], best[:j])) + top[j] * (c[j + 1] - c[: j + 1]) - (s[j + 1] - s[: j + 1])).min() for j in range(len(top))])
    cuts = packing.boundaries(histogram, 5)
    assert len(cuts) == 5 and ((np.array(cuts)[np.searchsorted(cuts, top)] - top) * count).sum() == best[-1]


def test_packing(docs, none):
    got = packing.pack_documents(docs, batch_tokens=500).collect()
    assert Counter((x["doc_id"], x["n_tokens"]) for x in got) == Counter((i, len(words(t)) + 1) for i, t in IDS_TEXTS)
    assert all(x["padding"] == x["boundary"] - x["n_tokens"] >= 0 for x in got)
    for (_, _, bound), n in Counter((x["bucket"], x["batch"], x["boundary"]) for x in got).items():
        assert n == 1 or n * bound <= 500
    assert len({(x["bucket"], x["batch"], x["place"]) for x in got}) == len(got)
    assert packing.pack_documents(none).count() == 0


def least_padding(lengths, buckets) -> int:
    """By trying every choice of bounds."""
    every = sorted(set(lengths))
    tops = [(*c, every[-1]) for c in itertools.combinations(every[:-1], min(buckets, len(every)) - 1)]
    return min(sum(min(b for b in t if b >= x) - x for x in lengths) for t in tops)


def test_packing_by_token_ids(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    encoder = Tokenizer.from_file(path)
    lengths = [(i, len(encoder.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in IDS_TEXTS]
    got = packing.pack_tokens(docs, path, buckets=3, batch_tokens=500).collect()
    assert Counter((x["doc_id"], x["n_tokens"]) for x in got) == Counter(lengths)
    assert sum(x["padding"] for x in got) == least_padding([n for _, n in lengths], 3)
    for (_, _, bound), n in Counter((x["bucket"], x["batch"], x["boundary"]) for x in got).items():
        assert n == 1 or n * bound <= 500
    assert len({(x["bucket"], x["batch"], x["place"]) for x in got}) == len(got)
    assert packing.pack_tokens(none, path).count() == 0


def test_token_starts_over_many_shards(spark, tmp_path):
    """Shards of a few ids: many a part, over several parts."""
    rows = [(i, f"word{i} " * (i % 7), *ROWS[0][2:]) for i in range(300)]
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    try:
        path = token_output.write_shards(frame(spark, rows), str(tmp_path / "shards"), tokenizer_path("word_bpe_49k.json"), shard_tokens=20)
    finally:
        spark.conf.unset(merge)
    got = token_output.read_shards(spark, path).orderBy("doc_id").collect()
    assert spark.read.parquet(path).count() > 50 and spark.read.parquet(path).select("part").distinct().count() > 1
    assert [x["doc_id"] for x in got] == list(range(300))
    assert [x["start"] for x in got] == list(itertools.accumulate([x["n_tokens"] for x in got], initial=0))[:-1]
    assert rows_of(token_output.read_lengths(spark, path), "doc_id", "n_tokens") == Counter((x["doc_id"], x["n_tokens"]) for x in got)


@pytest.mark.parametrize("limit", [1, 1024])
def test_repeats_are_cut(spark, none, limit):
    want = [(i, *w[:4]) for (i, _), w in zip(IDS_TEXTS, cut_repeats([t for _, t in IDS_TEXTS]), strict=True)]
    original = suffix_dedup.with_spans.__defaults__
    suffix_dedup.with_spans.__defaults__ = (*original[:-1], limit)
    try:
        got = rows_of(suffix_dedup.remove_repeats(frame(spark, ROWS)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    finally:
        suffix_dedup.with_spans.__defaults__ = original
    assert got == Counter(want)
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("limit", [2, 1024])
def test_repeats_of_random_texts(spark, limit):
    r = random.Random(11)
    base = "".join(r.choice("abcd ") for _ in range(900))
    texts = []
    for _ in range(70):
        t = list(base[(a := r.randint(0, 600)) : a + r.randint(150, 500)])
        for _ in range(r.randint(0, 2)):
            t[r.randrange(len(t))] = r.choice("XYZé")
        texts.append("".join(t) * r.choice([1, 1, 1, 2]))
    rows = [(i, t, *ROWS[0][2:]) for i, t in enumerate(texts)]
    spans = suffix_dedup.with_spans(frame(spark, rows), group_limit=limit).collect()
    got = {x["doc_id"]: suffix_dedup.remaining(bytes(x["text"]), x["spans"]) for x in spans}
    for i, w in enumerate(cut_repeats(texts)):
        assert got[i] == (w[4], w[1], w[2]), i


@pytest.mark.parametrize("limit", [1, 8, 256])
def test_repeats_around_a_common_passage(spark, limit):
    r = random.Random(3)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = noise(260)
    texts = [noise(r.randint(0, 90)) + passage[r.choice([0, 0, 0, 9, 70]) : r.choice([260, 260, 260, 230])] + noise(r.randint(0, 90)) for _ in range(60)]
    texts += [noise(50) + passage + noise(50) + passage[:210]] + [texts[0]] * 2
    rows = [(i, t, *ROWS[0][2:]) for i, t in enumerate(texts)]
    spans = suffix_dedup.with_spans(frame(spark, rows), group_limit=limit).collect()
    got = {x["doc_id"]: suffix_dedup.remaining(bytes(x["text"]), x["spans"]) for x in spans}
    for i, w in enumerate(cut_repeats(texts)):
        assert got[i] == (w[4], w[1], w[2]), i


def test_equal_rows_gather_their_spans_once(spark):
    text = " ".join(f"word{i * i}" for i in range(300))
    spans = suffix_dedup.with_spans(frame(spark, [(5, text, *ROWS[0][2:])] * 300 + [(None, text, *ROWS[0][2:])] * 20)).collect()
    assert len(spans) == 320 and max(len(x["spans"]) for x in spans) <= len(text)
    assert {suffix_dedup.remaining(bytes(x["text"]), x["spans"])[:2] for x in spans} == {(b"", len(text))}


def test_held_out_parts(docs):
    got = {x["doc_id"]: x["p"] for x in docs.select("doc_id", classifier.training_part(docs["doc_id"]).alias("p")).collect()}
    assert got == {i: crc(i, 5) for i, _ in IDS_TEXTS}


def test_texts_are_encoded_by_their_words_together():
    """op2: ids of many texts at once are the tokenizer's own, with marks, odd bytes, blank texts and more words than are kept."""
    import numpy as np
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, memo = Tokenizer.from_file(path), token_output.WordIds(path, limit=20)
    texts = ["", "a.", ".b", " \t\n", "É.é.A. x.Y!", "x<|A.b", "y.", "é. É.x", "\x0b\x0cend\r\n", "日本語 текст. 😀", *[f"wörd{i}. and{i}, it's" for i in range(60)], "last."]
    for size in (1, 7, len(texts)):
        for at in range(0, len(texts), size):
            part = texts[at : at + size]
            ids, stops = memo.flat([x.encode() for x in part])
            assert [x.tolist() for x in np.split(ids, stops)[:-1]] == [e.ids for e in t.encode_batch(part, add_special_tokens=False)]
    raw = [x.encode() for x in texts] + [b"\xff. \xc3", b"\xa9.a", b"."]
    assert [x.split() for x in token_output.all_spaced(raw).view(pa.large_binary()).to_pylist()] == [token_output.words_of(x) for x in raw]
    assert [x.tolist() for x in memo.flat([])] == [[], []]
