"""Profiles and key relationships of the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import profile
from quarry.plans.registry import query
from quarry.runtime import table

#: Columns whose text form is the same in every engine.
KEYS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "region": ["r_regionkey", "r_name"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
}
#: The other tables' columns of whole numbers and text.
OTHERS = {
    "benchmark": ["item_id", "text"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "label"],
    "events": ["event_id", "user_id", "event_type", "props"],
    "labels": ["doc_id", "quality", "toxic"],
    "pages": ["page_id", "url", "html"],
}
_PAIRS = [(t, c) for t, cs in KEYS.items() for c in cs]
_VALUES = " UNION ALL ".join(f"SELECT '{t}' AS dataset, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {t}" for t, c in _PAIRS)
_EVERY = " UNION ALL ".join(f"SELECT '{t}' AS dataset, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {t}" for t, cs in (KEYS | OTHERS).items() for c in cs)
_DISTINCT = f"vals AS (SELECT DISTINCT dataset, col, v FROM ({_VALUES}) WHERE v IS NOT NULL AND v <> '')"
_PROFILE = f"""
WITH raw AS ({_EVERY}), vals AS (SELECT DISTINCT dataset, col, v FROM raw WHERE v IS NOT NULL AND v <> ''),
first AS (SELECT dataset, col, string_agg(v, '|' ORDER BY v) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY dataset, col ORDER BY v) AS k FROM vals) WHERE k <= 5 GROUP BY 1, 2),
stats AS (SELECT dataset, col, count(*) AS n, count(NULLIF(v, '')) AS non_null, count(DISTINCT NULLIF(v, '')) AS n_distinct FROM raw GROUP BY 1, 2)
SELECT s.dataset, s.col AS column_name, non_null, round(1 - non_null / greatest(1, n), 4) AS null_rate, n_distinct, round(n_distinct / greatest(1, non_null), 4) AS uniqueness, coalesce(samples, '') AS samples
FROM stats s LEFT JOIN first f ON s.dataset = f.dataset AND s.col = f.col"""
_OVERLAP = f"""
{_DISTINCT}, n AS (SELECT dataset, col, count(*) AS n FROM vals GROUP BY 1, 2),
common AS (SELECT a.dataset AS ad, a.col AS ac, b.dataset AS bd, b.col AS bc, count(*) AS common FROM vals a JOIN vals b ON a.v = b.v AND a.dataset < b.dataset GROUP BY 1, 2, 3, 4),
pairs AS (SELECT ad || '.' || ac AS "left", bd || '.' || bc AS "right", common / l.n AS lc, common / r.n AS rc, common FROM common JOIN n l ON l.dataset = ad AND l.col = ac JOIN n r ON r.dataset = bd AND r.col = bc)"""


def star(spark, sf_dir):
    return {t: table(spark, sf_dir, t).select(*cs) for t, cs in KEYS.items()}


@query(_PROFILE)
def column_profile(spark, sf_dir):
    others = {t: table(spark, sf_dir, t).select(*cs) for t, cs in OTHERS.items()}
    p = profile.column_profile(star(spark, sf_dir) | others)
    return p.select("dataset", F.col("column").alias("column_name"), "non_null", "null_rate", F.col("distinct").alias("n_distinct"), "uniqueness", F.array_join("samples", "|").alias("samples"))


@query(f'WITH {_OVERLAP} SELECT "left", "right", round(lc, 6) AS left_coverage, round(rc, 6) AS right_coverage, common AS common_distinct_values FROM pairs')
def value_overlap(spark, sf_dir):
    o = profile.value_overlap(star(spark, sf_dir))
    return o.withColumns({c: F.round(c, 6) for c in ("left_coverage", "right_coverage")})


@query(f"""WITH {_OVERLAP} SELECT "left", "right", round(lc, 4) AS left_coverage, round(rc, 4) AS right_coverage, common AS common_distinct_values, round(greatest(lc, rc), 4) AS score
FROM pairs WHERE common >= 2 AND greatest(lc, rc) >= 0.55 ORDER BY 6 DESC, 5 DESC, 1, 2""")
def relationship_rank(spark, sf_dir):
    return profile.rank_relationships(profile.value_overlap(star(spark, sf_dir)))


@query(f"""WITH {_OVERLAP}, sizes AS (SELECT dataset || '.' || col AS c, count(*) AS rows, count(DISTINCT v) AS d FROM ({_VALUES}) WHERE v IS NOT NULL AND v <> '' GROUP BY 1),
uniq AS (SELECT c FROM sizes WHERE round(d / rows, 4) = 1.0 AND d > 1),
both_ AS (SELECT "left" AS "from", "right" AS "to", lc AS cov, common FROM pairs UNION ALL SELECT "right", "left", rc, common FROM pairs)
SELECT "from", "to", round(cov, 4) AS coverage, common AS common_distinct_values FROM both_ WHERE cov >= 0.55 AND common >= 2 AND "to" IN (SELECT c FROM uniq)""")
def typed_fk_candidates(spark, sf_dir):
    tables = star(spark, sf_dir)
    return profile.typed_key_candidates(profile.value_overlap(tables), profile.column_profile(tables))
