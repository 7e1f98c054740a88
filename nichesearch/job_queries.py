"""The jobs as registered queries: each is run twice into one new folder, and its output is read back."""

from __future__ import annotations

import json
from importlib.resources import files as resources

from jobs import mentions, training_table
from pyspark.sql import functions as F

from .functions import files
from .queries import BLOCK, FOLDS, SEED, SIDE, _u, query, six


def settings(job: str) -> dict:
    return json.loads(resources("jobs").joinpath(f"{job}.json").read_text())


_NAMES = ", ".join(f"'{n.lower()}'" for n in settings("mentions")["names"])
_HEX = "CAST(('0x' || substr(md5({}), {}, {})) AS BIGINT)"


@query(
    rf""", texts AS (SELECT doc_id, source AS site, list_filter(string_split_regex(coalesce(text, ''), '[^\p{{L}}]+'), lambda x: x <> '') AS words FROM documents),
visits AS (SELECT doc_id, site, len(words) AS n_words, list_filter(list_transform(words, lambda x: lower(x)), lambda x: x IN ({_NAMES})) AS hits FROM texts),
told AS (SELECT v.*, n.name FROM visits v, (SELECT unnest([{_NAMES}]) AS name) n WHERE len(hits) > 0)
SELECT name, {_HEX.format("concat_ws(':', doc_id, name)", 1, 15)} AS record_id, CAST({_HEX.format("site", 1, 4)} % {SIDE} AS INT) AS "row", CAST({_HEX.format("site", 5, 4)} % {SIDE} AS INT) AS col,
CAST(len(list_filter(hits, lambda x: x = name)) > 0 AS INT) AS label, CAST(NULL AS VARCHAR) AS obs_date, doc_id, site, CAST(len(list_filter(hits, lambda x: x = name)) AS INT) AS n_mentions, CAST(n_words AS INT) AS n_words FROM told"""
)
def job1_mentions(spark, sf):
    """Presences and absences of names that the texts mention."""
    folder = files.shared_folder(spark, "job1")
    for _ in range(2):
        mentions.run(spark, f"{sf}/documents.parquet*", folder, settings("mentions"))
    return mentions.read(spark, folder).withColumn("obs_date", F.col("obs_date").cast("string"))


_JOB2 = settings("training_table")


@query(
    f""", rec AS (SELECT l_returnflag || CAST(l_quantity AS INT) AS species, CAST(l_partkey % {SIDE} AS INT) AS "row", CAST(l_suppkey % {SIDE} AS INT) AS col, CAST(l_shipdate AS DATE) AS d FROM lineitem),
jl AS (SELECT CAST(l_partkey % {SIDE} AS INT) AS "row", CAST(l_suppkey % {SIDE} AS INT) AS col, CASE WHEN (max(l_partkey % {SIDE}) * {SIDE} + max(l_suppkey % {SIDE})) % 37 <> 0 THEN round(avg(l_extendedprice), 6) END AS price, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1, 2),
lst AS (SELECT avg(price) AS m1, stddev_pop(price) AS s1, avg(discount) AS m2, stddev_pop(discount) AS s2 FROM jl),
seen AS (SELECT species, "row", col, count(*) AS n_records, min(d) AS first_date, max(d) AS last_date FROM rec GROUP BY ALL),
visited AS (SELECT "row", col, sum(n_records) AS effort, (price - m1) / s1 AS price, (discount - m2) / s2 AS discount FROM seen JOIN jl USING ("row", col), lst WHERE price IS NOT NULL GROUP BY ALL),
vb AS (SELECT DISTINCT "row" // {BLOCK} AS br, col // {BLOCK} AS bc FROM visited),
vf AS (SELECT br, bc, CAST((row_number() OVER (ORDER BY md5('{SEED}:block:' || br || ':' || bc), br, bc) - 1) % {FOLDS} AS INT) AS fold FROM vb),
sites AS (SELECT visited.*, fold FROM visited JOIN vf ON br = "row" // {BLOCK} AND bc = col // {BLOCK}),
pres AS (SELECT species, 1 AS label, "row", col, fold, n_records, first_date, last_date, price, discount, 'presence' AS kind FROM seen JOIN sites USING ("row", col) QUALIFY count(*) OVER (PARTITION BY species) >= {_JOB2["min_presences"]}),
back AS (SELECT 'background', 0, "row", col, fold, CAST(effort AS BIGINT), NULL, NULL, price, discount, 'background' FROM sites ORDER BY -ln({_u("target_group", "\"row\" || ':' || col")}) / effort, "row", col LIMIT {_JOB2["n_background"]})
SELECT * REPLACE (round(price, 6) AS price, round(discount, 6) AS discount, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date) FROM (SELECT * FROM pres UNION ALL SELECT * FROM back)"""
)
def job2_training_table(spark, sf):
    """Training rows of many species and their shared background."""
    folder = files.shared_folder(spark, "job2")
    for _ in range(2):
        training_table.run(spark, sf, folder, _JOB2)
    rows = training_table.read(spark, folder, _JOB2)
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})
    return rows.withColumns({c: six(c, c) for c in _JOB2["layers"]["predictors"]})
