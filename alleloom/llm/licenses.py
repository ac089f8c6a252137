"""License scan with SQL functions only: MinHash bands over overlapping windows, then exact containment."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .license_texts import TEMPLATES

SHINGLE = 5
#: Windows of a text have 12 shingles (16 words) and start at every eighth, those of a template at every fourth.
SPAN, STEP, OWN_STEP = 12, 8, 4
#: Templates of 12 shingles or fewer are one window and have bands of one row: a shared shingle is 1/12 of the
#: union at least, and 96 bands collide with probability 1 - (11/12)^96 > 0.9997; where four are shared 96 bands miss one in 10^12.
#: Longer ones have bands of two rows, each minimum paired with the next. At a containment of 0.8 edits leave some run of
#: eight of their shingles, of which one window of the text holds six, and one of the template's too: a similarity
#: of 6/18 or more. No two neighbours among 96 then agree with probability 0.00015, and another window often meets as well.
BANDS = 96
#: Templates of so many characters in all are broadcast (64 bytes of keys a character); beyond, Spark joins by shuffle.
BROADCAST_CHARACTERS = 1 << 20


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def places(n: Column, step: int = 1) -> Column:
    """0, step, ... below ``n``; none for 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))


def shingles(words: str, known: str | None = None) -> Column:
    """Hashes of all runs of ``SHINGLE`` words; null where one of them isn't marked in ``known``."""

    def one(i: Column) -> Column:
        value = F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])
        if known is None:
            return value
        marked = F.get(known, i)
        for k in range(1, SHINGLE):
            marked = marked & F.get(known, i + k)
        return F.when(marked, value)

    return F.transform(places(F.size(words) - (SHINGLE - 1)), one)


def windows(hashes: str, step: int) -> Column:
    """The sets of ``SPAN`` shingles from every ``step``-th on, without the nulls; no empty and no equal ones."""
    every = F.transform(places(F.size(hashes), step), lambda i: F.array_compact(F.slice(hashes, i + 1, F.lit(SPAN))))
    return F.array_distinct(F.filter(every, lambda w: F.size(w) > 0))


def minhash(hashes: Column) -> Column:
    """The least of the hashes under each of ``BANDS`` permutations."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))))


def single_keys(minima: str) -> Column:
    return F.transform(minima, lambda m, b: F.xxhash64(b, m))


def paired_keys(minima: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b + BANDS, F.get(minima, b), F.get(minima, (b + 1) % BANDS)))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, n_found, n_shingles, containment``: templates of whose five-word shingles a text has ``least`` or more.

    Texts are read whole and once. Only runs of five words that all occur in templates can be a template's
    shingle; the others are not hashed, and no window holds them. What is left of a text (its windows and its different shingles)
    is written, a window's minima give its keys, and texts and templates meet by an equi-join on the key of a band;
    then the text's own shingles decide, exactly. However many keys a text and a template share, they are one pair before that.
    Only the templates' words pass the driver. Templates (a parameter) under five words are not searched for. Null, empty and short
    texts match nothing; null ids keep their rows; repeated rows give a row each. No documents or no templates: no rows.
    """
    spark = docs.sparkSession
    listed = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("wording")) for k, v in templates.items()])
    wanted = spark.range(1).select(F.inline(listed.cast("array<struct<license: string, wording: string>>"))).withColumn("words", words_of(F.col("wording")))
    wanted = wanted.where(F.size("words") >= SHINGLE).withColumn("hashes", shingles("words"))
    vocabulary = sorted(r["word"] for r in wanted.select(F.explode("words").alias("word")).distinct().collect())
    small = sum(map(len, templates.values())) <= BROADCAST_CHARACTERS
    side = F.broadcast if small else lambda df: df
    sets = wanted.select("license", F.array_distinct("hashes").alias("shingles"))
    minima = wanted.select("license", (F.size("hashes") > SPAN).alias("long"), F.explode(windows("hashes", OWN_STEP)).alias("window"))
    whole = wanted.where(F.size("hashes") <= SPAN).select("license", F.lit(False).alias("long"), F.array_distinct("hashes").alias("window"))
    minima = minima.where("long").unionByName(whole).withColumn("minima", minhash(F.col("window")))
    keys = minima.select("license", F.explode(F.when(F.col("long"), paired_keys("minima")).otherwise(single_keys("minima"))).alias("key")).distinct()

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), words_of(F.col(f"`{text_col}`").cast("string")).alias("words"))
    texts = texts.withColumn("known", F.transform("words", lambda w: w.isin(vocabulary) if vocabulary else F.lit(False))).withColumn("hashes", shingles("words", "known"))
    # the row's number is given with what is kept, so that the filter isn't pushed below, where it would take all apart again
    kept = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.array_distinct(F.array_compact("hashes")).alias("own"), windows("hashes", STEP).alias("windows")).where(F.size("own") > 0)
    kept = cut(kept, "license-windows")
    asked = kept.select("row", F.explode("windows").alias("window")).withColumn("minima", minhash(F.col("window"))).select("row", F.explode(F.concat(single_keys("minima"), paired_keys("minima"))).alias("key"))
    met = asked.join(side(keys), "key").select("row", "license").distinct()
    found = kept.select("row", "doc_id", "own").join(met, "row").join(side(sets), "license")
    found = found.select("doc_id", "license", F.size(F.array_intersect("own", "shingles")).alias("n_found"), F.size("shingles").alias("n_shingles"))
    return found.where(F.col("n_found") >= least * F.col("n_shingles")).withColumn("containment", F.round(F.col("n_found") / F.col("n_shingles"), 6))
