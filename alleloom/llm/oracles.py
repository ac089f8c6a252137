"""SQL that gives the same rows as a query, for those that SQL can express."""

from __future__ import annotations

from .license_texts import TEMPLATES
from .licenses import SHINGLE
from .quality_rules import POLICIES, RULES

W = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_LEDGER = rf"""
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{W}') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{W}')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS gram
      FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
             length(regexp_replace(t, '[^a-z]+', '', 'g'))::BIGINT AS n_lower,
             len(list_filter(ws, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')))::BIGINT AS n_wordless
      FROM w LEFT JOIN cov USING (r)),
l AS (SELECT *, ({' + '.join(f'(CASE WHEN {c} THEN {1 << i} ELSE 0 END)' for i, (_, c) in enumerate(RULES))})::BIGINT AS failed_bits FROM m)
"""
_V1 = POLICIES["v1"]
_BITS = ", ".join(f"('{k}', {1 << i})" for i, (k, _) in enumerate(RULES) if _V1 >> i & 1)
_QUOTED = {k: v.replace("'", "''") for k, v in TEMPLATES.items()}
_TEMPLATES = ", ".join(f"('{k}', '{v}')" for k, v in _QUOTED.items())

ORACLES: dict[str, str] = {
    "op1_rule_ledger": f"""WITH {_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & {POLICIES["base"]}) <> 0 AS base_failed,
       (failed_bits & {POLICIES["base"] | _V1}) = 0 AS kept, failed_bits
FROM l""",
    "op1_rule_ablations": f"""WITH {_LEDGER}, b(rule, bit) AS (VALUES {_BITS})
SELECT rule, count(*) FILTER (WHERE failed_bits & bit <> 0) AS n_failed,
       count(*) FILTER (WHERE failed_bits & {_V1} = bit) AS n_only,
       count(*) FILTER (WHERE (failed_bits & {_V1}) - (failed_bits & bit) = 0) AS n_kept_without
FROM l, b GROUP BY rule""",
    "op5_license_minhash": f"""
WITH t(license, wording) AS (VALUES {_TEMPLATES}),
tw AS (SELECT license, regexp_extract_all(lower(wording), '[\\p{{L}}\\p{{N}}]+') AS ws FROM t),
ts AS (SELECT DISTINCT license, array_to_string(ws[i:i+{SHINGLE - 1}], ' ') AS s FROM (SELECT license, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 2}, 1))) AS i FROM tw)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents),
ds AS (SELECT DISTINCT r, doc_id, array_to_string(ws[i:i+{SHINGLE - 1}], ' ') AS s FROM (SELECT r, doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 2}, 1))) AS i FROM d)),
n AS (SELECT license, count(*) AS n_shingles FROM ts GROUP BY license)
SELECT doc_id, license, count(*)::INT AS n_found, any_value(n_shingles)::INT AS n_shingles, round(count(*) / any_value(n_shingles), 6) AS containment
FROM ds JOIN ts USING (s) JOIN n USING (license) GROUP BY r, doc_id, license HAVING count(*) >= 0.8 * any_value(n_shingles)""",
    "op9_length_buckets": "",
    "op11_maxscore_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS ts FROM documents WHERE text IS NOT NULL),
e AS (SELECT r, unnest(ts) AS term FROM d),
p AS (SELECT r, term, count(*) AS tf FROM e GROUP BY r, term),
s AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT item_id, term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM q JOIN f USING (term), s),
m AS (SELECT r, doc_id, 50 + (50 * len(ts) * s.n) // s.l AS m FROM d, s WHERE len(ts) > 0),
x AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM w JOIN p USING (term) JOIN m USING (r) GROUP BY item_id, r),
y AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 50""",
    "op12_filter_audit": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '{W}') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
i(i, letter) AS (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step, o FROM o),
x AS (SELECT part, filter_order, step, o[step] AS own, n, good, toxic, fails[o[step]] AS fails,
             len(list_filter(o[1:step - 1], lambda k: fails[k])) AS before, len(list_filter([1, 2, 3, 4, 5], lambda k: fails[k])) AS times FROM c, s),
y AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE before = 0 AND NOT fails), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (WHERE before = 0 AND fails), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE before > 0 AND fails), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (WHERE times = 1 AND fails), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (WHERE before = 0 AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE before = 0 AND fails), 0)::BIGINT AS toxic_lost
      FROM x GROUP BY part, filter_order, step, own)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM y""",
}


def _packing(buckets: int = 8, budget: int = 65_536) -> str:
    """The same dynamic program, one table for each number of buckets."""
    steps = [f"""
p1 AS (SELECT j, top * c - s AS cost, 0 AS i FROM q)"""]
    for k in range(2, buckets + 1):
        steps.append(f"""
p{k} AS (SELECT q.j, min(b.cost + q.top * (q.c - a.c) - (q.s - a.s)) AS cost,
                arg_min(a.j, (b.cost + q.top * (q.c - a.c) - (q.s - a.s), a.j)) AS i
         FROM q JOIN (SELECT * FROM q UNION ALL SELECT 0, 0, 0, 0) a ON a.j < q.j
         JOIN (SELECT j, cost FROM p{k - 1} UNION ALL SELECT 0, 0) b ON b.j = a.j GROUP BY q.j)""")
    cuts = [f"c{buckets} AS (SELECT max(j) AS j FROM q)"]
    for k in range(buckets, 1, -1):
        cuts.append(f"c{k - 1} AS (SELECT p{k}.i AS j FROM p{k} JOIN c{k} USING (j))")
    union = " UNION ".join(f"SELECT j FROM c{k}" for k in range(1, buckets + 1))
    return f"""
WITH n AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{W}'))::BIGINT + 1 AS n_tokens FROM documents),
h AS (SELECT n_tokens::DOUBLE AS top, count(*)::DOUBLE AS n, sum(n_tokens)::DOUBLE AS total FROM n GROUP BY n_tokens),
q AS (SELECT row_number() OVER (ORDER BY top) AS j, top, sum(n) OVER (ORDER BY top) AS c, sum(total) OVER (ORDER BY top) AS s FROM h),
{",".join(steps)},
{", ".join(cuts)},
tops AS (SELECT (row_number() OVER (ORDER BY top) - 1)::INT AS bucket, top::BIGINT AS boundary FROM q WHERE j IN ({union})),
x AS (SELECT doc_id, n_tokens, (SELECT min(boundary) FROM tops WHERE boundary >= n_tokens) AS boundary FROM n),
y AS (SELECT *, row_number() OVER (PARTITION BY boundary ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, n_tokens) - 1 AS r, greatest({budget} // boundary, 1) AS size FROM x)
SELECT doc_id, n_tokens, bucket, boundary, r // size AS batch, r % size AS place, boundary - n_tokens AS padding FROM y JOIN tops USING (boundary)"""


ORACLES["op9_length_buckets"] = _packing()
