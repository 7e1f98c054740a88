"""Quality rules whose cutoffs are chosen by risk control, in DataFrame functions only.

Every rule flags a document whose measure exceeds a cutoff. Cutoffs stand in levels from the
strictest to the laxest, one of each rule a level; at a level a document is rejected if any
rule flags it. For each stratum (a band of lengths) the labelled good documents say how many
good ones a level would reject: k of n. Levels are tested in a fixed sequence from the laxest
on: a level is admitted if it and all laxer ones have an exact binomial (Clopper-Pearson)
upper bound of the rate of good documents rejected, by all rules together, of at most
``ALPHA`` at confidence 1 - ``DELTA`` / strata. The bound is at most alpha exactly where
P(Binomial(n, alpha) <= k) <= delta, which is what is computed. Trials are distinct texts: a
text that is repeated, under one id or several, counts once. The sequence needs no
correction for the number of levels or rules, and Bonferroni's covers the strata. The
strictest admitted level of a stratum is used; strata with fewer good labels than any test
needs are pooled; where no level is admitted the rules stay off.

Defined cases: a null text has no word, so it fails the base rules; repeated rows are each
judged; a measure equal to its cutoff passes; texts of any length are measured whole, in
arrays of their words; other columns are ignored; repeated labels of a document count once, by the lowest
quality, and of equal texts one is enough that is labelled good; with no labels only the base rules decide; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Words below which a document belongs to a stratum; the last stratum has no bound.
STRATA = (64, 256, 1024)
ALPHA, DELTA = 0.02, 0.05
#: Cutoffs by rule and level, as shares (characters in a word for long_words).
GRID = {
    "symbols": (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3),
    "dup_lines": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5),
    "repeats": (0.01, 0.02, 0.04, 0.06, 0.1, 0.15, 0.2, 0.25),
    "capitals": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7),
    "long_words": (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0),
}
MEASURES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "long_words": ("word_chars", "n_words"),
}
LEVELS = len(GRID["symbols"])
#: Chance of a mistake in one stratum; good labels below which no test can succeed.
EACH = DELTA / (len(STRATA) + 1)
LEAST = math.ceil(math.log(EACH) / math.log(1 - ALPHA))


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words from words: words covered by a window that occurs twice or more.

    Windows are compared by 64-bit hashes. Most texts repeat none, which the count of
    distinct hashes shows; the others sort (hash, place) and mark equal neighbours.
    """
    df = df.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn(
        "_w",
        F.when(
            F.size("_h") > WINDOW,
            F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)])),
        ),
    )
    df = df.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_w")) < F.size("_w"),
            F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )

    def again(x: Column, k: Column) -> Column:
        before, after = F.get("_s", k - 1)["h"], F.get("_s", k + 1)["h"]
        return F.when(before.eqNullSafe(x["h"]) | after.eqNullSafe(x["h"]), x["i"])

    df = df.withColumn("_p", F.sort_array(F.array_compact(F.transform("_s", again))))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).cast("long").alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_h", "_w", "_s", "_p")


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, the counts, base_failed, stratum) of each row of (doc_id, text)."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("words", common.words_of(F.col("text")))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(common.SPACE)) != ""))
    df = df.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"[A-Z]")).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    df = _repeat_words(df).drop("words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    band = F.lit(0)
    for bound in STRATA:
        band = band + (F.col("n_words") >= bound).cast("int")
    return df.withColumns({"base_failed": failed, "stratum": band})


def exceeds(rule: str, cutoff: float | Column) -> Column:
    over, under = MEASURES[rule]
    return F.col(over) > F.col(under) * cutoff


def admitted(k: Column, n: Column) -> Column:
    """P(Binomial(n, ALPHA) <= k) <= EACH: summed down from k until terms vanish."""
    odds, n, k = (1 - ALPHA) / ALPHA, n.cast("double"), k.cast("double")
    top = common.ln_choose(n, k) + k * F.log(F.lit(ALPHA)) + (n - k) * F.log(F.lit(1 - ALPHA))
    terms = F.least(k, F.ceil(12 * F.sqrt(n * ALPHA)) + 64).cast("int")
    total = F.aggregate(
        F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, j: F.struct(
            (a["sum"] + a["term"] * (k - j + 1) * odds / (n - k + j)).alias("sum"),
            (a["term"] * (k - j + 1) * odds / (n - k + j)).alias("term"),
        ),
        lambda a: a["sum"],
    )
    return (k < n * ALPHA) & (F.exp(top) * total <= EACH)


def rejected_at(level: int) -> Column:
    out = F.lit(False)
    for rule, cutoffs in GRID.items():
        out = out | exceeds(rule, cutoffs[level])
    return out


def thresholds(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, level): the strictest admitted level of each stratum that has any."""
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    known = measured.filter(~F.col("base_failed")).join(good.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["text_hash"])
    counts = known.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(rejected_at(i)).alias(f"k{i}") for i in range(LEVELS)])
    counts = counts.withColumn("pool", F.when(F.col("n") < LEAST, -1).otherwise(F.col("stratum")))  # a row a stratum from here on
    pools = counts.groupBy("pool").agg(*[F.sum(c).alias(c) for c in ("n", *[f"k{i}" for i in range(LEVELS)])])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"k{i}").alias("k")) for i in range(LEVELS)]))
    tests = pools.select("pool", "n", each.alias("t")).select("pool", "t.level", admitted(F.col("t.k"), F.col("n")).alias("ok"))
    first = F.coalesce(F.max(F.when(~F.col("ok"), F.col("level"))), F.lit(-1)) + 1  # the sequence ends at the laxest level that fails
    pools = tests.groupBy("pool").agg(first.alias("level")).filter(F.col("level") < LEVELS)
    return counts.select("stratum", "pool").join(pools, "pool").select("stratum", "level")


def judge(measured: DataFrame, levels: DataFrame) -> DataFrame:
    """Adds rejected_by (names of the rules, comma-joined) and kept. levels has at most one row a stratum."""
    df = measured.join(F.broadcast(levels), "stratum", "left")
    cut = lambda r: F.get(F.array(*map(F.lit, GRID[r])), F.col("level"))
    by = F.concat_ws(",", *[F.when(exceeds(r, cut(r)), F.lit(r)) for r in GRID])
    return df.withColumn("rejected_by", by).withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures, thresholds and verdicts of every row of ``docs``; texts are read once."""
    measured = common.written(measure(docs), "quality-measures")
    return judge(measured, thresholds(measured, labels)).select(*COLUMNS)


#: DuckDB: the same rows; windows are compared as strings, bounds by DuckDB's own lgamma.
def oracle() -> str:
    over = {r: f"{a} > {b} * CAST({{}} AS DOUBLE)" for r, (a, b) in MEASURES.items()}
    flagged = [" OR ".join(over[r].format(cutoffs[i]) for r, cutoffs in GRID.items()) for i in range(LEVELS)]
    counts = ", ".join(f"count(*) FILTER (WHERE {x}) AS k{i}" for i, x in enumerate(flagged))
    cdf = f"list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA!r}) + (n - j) * ln(1 - {ALPHA!r}))))"
    bands = " + ".join(f"CAST(n_words >= {b} AS INT)" for b in STRATA)
    cut = lambda r: f"list_extract([{', '.join(map(repr, GRID[r]))}], level + 1)"
    rejected = ", ".join(f"CASE WHEN {over[r].format(cut(r))} THEN '{r}' END" for r in GRID)
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS x
        FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) > {WINDOW})),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, x) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range({WINDOW}) AS t(k) GROUP BY rid),
m0 AS (SELECT d.rid, doc_id, md5(text) AS text_hash, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
        CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
        FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {bands} AS stratum FROM m0),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
counts AS (SELECT stratum, count(*) AS n, {counts} FROM (SELECT DISTINCT ON (text_hash) * FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)) GROUP BY stratum),
pools AS (SELECT CASE WHEN n < {LEAST} THEN -1 ELSE stratum END AS pool, CAST(sum(n) AS BIGINT) AS n, {", ".join(f"CAST(sum(k{i}) AS BIGINT) AS k{i}" for i in range(LEVELS))} FROM counts GROUP BY 1),
tests AS (SELECT pool, n, unnest(range({LEVELS})) AS level, unnest([{", ".join(f"k{i}" for i in range(LEVELS))}]) AS k FROM pools),
passed AS (SELECT pool, level, CASE WHEN k < n * {ALPHA!r} THEN {cdf} <= {EACH!r} ELSE false END AS ok FROM tests),
chain AS (SELECT pool, level, min(CAST(ok AS INT)) OVER (PARTITION BY pool ORDER BY level DESC) AS ok FROM passed),
cuts AS (SELECT stratum, min(level) AS level FROM counts JOIN chain ON pool = CASE WHEN n < {LEAST} THEN -1 ELSE stratum END WHERE ok = 1 GROUP BY stratum),
j AS (SELECT m.*, concat_ws(',', {rejected}) AS rejected_by FROM m LEFT JOIN cuts USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM j"""
