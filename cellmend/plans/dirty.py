"""A dirty table with known truth, derived from the star-schema tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.operators import constraints
from cellmend.sources.tables import normalise

ATTRS = ["nation", "region", "segment"]
#: Forms that counts per block do not decide: two unequal attributes, and attributes that differ.
TWO_UNEQUAL = constraints.parse("\n\nt1&t2&EQ(t1.nation,t2.nation)&IQ(t1.region,t2.region)&IQ(t1.segment,t2.segment)")[0]
CROSSED = constraints.parse("\n\n\nt1&t2&EQ(t1.own,t2.other)&IQ(t1.label,t2.label)")[0]
RULES = constraints.parse("t1&t2&EQ(t1.nation,t2.nation)&IQ(t1.region,t2.region)\nt1&t2&EQ(t1.nation,t2.nation)&EQ(t1.segment,t2.segment)&IQ(t1.region,t2.region)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with nation and region names; both dimensions are bounded by their keys, and AQE decides how to join them."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _joined(spark, sf_dir).select(
        (k + 1).alias("tid"), F.when(k % 53 != 0, F.col("n_name")).alias("nation"), F.when(k % 37 == 0, "XX").otherwise(F.col("r_name")).alias("region"),
        F.when(k % 41 == 0, " empty ").otherwise(F.col("c_mktsegment")).alias("segment"),
    )


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(raw(spark, sf_dir))


def crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with two numbers of one range, for a constraint between different attributes."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("tid"), F.col("s_nationkey").cast("string").alias("own"), (k % 31).cast("string").alias("other"), (k % 3).cast("string").alias("label"))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir).select((F.col("c_custkey") + 1).alias("tid"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"))


# The same in SQL, as common table expressions that build on one another.
CTES: dict[str, str] = {
    "raw": """SELECT c_custkey + 1 AS tid, CASE WHEN c_custkey % 53 <> 0 THEN n_name END AS nation, CASE WHEN c_custkey % 37 = 0 THEN 'XX' ELSE r_name END AS region,
        CASE WHEN c_custkey % 41 = 0 THEN ' empty ' ELSE c_mktsegment END AS segment
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "dirty": """SELECT tid, nation, region, CASE WHEN trim(segment) NOT IN ('', 'empty', 'nan', 'None') THEN trim(segment) END AS segment FROM raw""",
    "cells": """SELECT tid, 'nation' AS attr, nation AS val FROM dirty UNION ALL SELECT tid, 'region', region FROM dirty UNION ALL SELECT tid, 'segment', segment FROM dirty""",
    "truth": """SELECT tid, attr, val AS correct_val FROM (SELECT c_custkey + 1 AS tid, n_name AS nation, r_name AS region, c_mktsegment AS segment
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) UNPIVOT (val FOR attr IN (nation, region, segment))""",
    "sup": "SELECT nation AS k, region AS v, count(*) AS n FROM dirty WHERE nation IS NOT NULL AND region IS NOT NULL GROUP BY nation, region",
    "vclass": """SELECT * FROM (SELECT k AS nation, v AS region, n, CAST(CASE WHEN n >= 2 THEN sum(n) OVER w - n ELSE coalesce(sum(n) FILTER (n >= 2) OVER w, 0) END AS BIGINT) AS n_links FROM sup WINDOW w AS (PARTITION BY k)) WHERE n_links > 0""",
    "noisy_fd": "SELECT tid, 'region' AS attr FROM dirty WHERE EXISTS (SELECT 1 FROM sup WHERE k = nation AND v <> region AND n >= 2)",
    "noisy_gen": """SELECT tid, unnest(['nation', 'region', 'segment']) AS attr FROM dirty AS d
        WHERE EXISTS (SELECT 1 FROM dirty AS e WHERE e.nation = d.nation AND e.segment = d.segment AND e.region <> d.region)""",
    "noisy": "SELECT tid, attr FROM noisy_fd UNION SELECT tid, attr FROM noisy_gen",
    "singles": "SELECT attr, coalesce(val, '__NULL__') AS val, count(*) AS n, min(tid) AS first_tid FROM cells GROUP BY ALL",
    "pairs": """SELECT a.attr AS a1, coalesce(a.val, '__NULL__') AS v1, b.attr AS a2, coalesce(b.val, '__NULL__') AS v2, count(*) AS n, min(a.tid) AS first_tid
        FROM cells AS a JOIN cells AS b ON a.tid = b.tid AND a.attr <> b.attr GROUP BY ALL""",
    "pstats": "SELECT * FROM pairs WHERE v1 <> '__NULL__' AND v2 <> '__NULL__'",
    "h": "SELECT attr, -sum(p * log2(p)) AS h FROM (SELECT attr, n / sum(n) OVER (PARTITION BY attr) AS p FROM singles) GROUP BY attr",
    "hj": "SELECT a1, a2, -sum(p * log2(p)) AS h FROM (SELECT a1, a2, n / sum(n) OVER (PARTITION BY a1, a2) AS p FROM pairs) GROUP BY a1, a2",
    "corr": """SELECT a1 AS attr_x, a2 AS attr_y, CASE WHEN x.h = 0 THEN 1.0 ELSE 1 - greatest(hj.h - y.h, 0) / x.h END AS corr
        FROM hj JOIN h AS x ON x.attr = a1 JOIN h AS y ON y.attr = a2 UNION ALL SELECT attr, attr, 1.0 FROM h""",
    "cands": """SELECT a2 AS target, a1 AS cond, v1 AS cond_val, v2 AS candidate_val, pstats.n, pstats.n / s.n AS p
        FROM pstats JOIN singles AS s ON s.attr = a1 AND s.val = v1 WHERE pstats.n / s.n >= 0.005
        QUALIFY row_number() OVER (PARTITION BY a2, a1, v1 ORDER BY pstats.n DESC, pstats.first_tid) <= 10""",
    "dom0": """SELECT tid, attr, val AS candidate_val FROM cells WHERE val IS NOT NULL
        UNION SELECT tid, target, candidate_val FROM cells JOIN cands ON cond = attr AND cond_val = val JOIN corr ON attr_x = target AND attr_y = cond AND attr_x <> attr_y AND corr >= 0.1""",
    "fallback": """SELECT tid, attr, candidate_val FROM (
        SELECT q.tid, q.attr, s.val AS candidate_val, coalesce(z.size, 0) AS size, row_number() OVER (PARTITION BY q.tid, q.attr ORDER BY s.n DESC, s.first_tid) AS r
        FROM noisy AS q LEFT JOIN (SELECT tid, attr, count(*) AS size FROM dom0 GROUP BY ALL) AS z USING (tid, attr) JOIN singles AS s ON s.attr = q.attr AND s.val <> '__NULL__'
        WHERE coalesce(z.size, 0) < 2 AND NOT EXISTS (SELECT 1 FROM dom0 AS d WHERE d.tid = q.tid AND d.attr = q.attr AND d.candidate_val = s.val)) WHERE r <= 2 - size""",
    "dom": "SELECT * FROM dom0 UNION ALL SELECT * FROM fallback",
    "f_cooc": "SELECT d.tid, d.attr, candidate_val, 'cooc_' || d.attr || '=' || candidate_val || '_' || c.attr || '=' || c.val AS feature FROM dom AS d JOIN cells AS c ON c.tid = d.tid AND c.attr <> d.attr WHERE c.val IS NOT NULL",
    "f_min": "SELECT tid, attr, candidate_val, 'prior_minimality' AS feature FROM dom JOIN cells USING (tid, attr) WHERE candidate_val = val",
    "f_freq": """SELECT tid, dom.attr, candidate_val, 'LOGFREQ_' || dom.attr || '_BIN=' || CAST(least(5, floor(log10(coalesce(n, 0) + 1))) AS INTEGER) AS feature
        FROM dom LEFT JOIN (SELECT attr, val, count(*) AS n FROM cells WHERE val IS NOT NULL GROUP BY ALL) AS k ON k.attr = dom.attr AND k.val = candidate_val""",
    "filled": "SELECT tid, coalesce(nation, '__NULL__') AS nation, coalesce(region, '__NULL__') AS region, coalesce(segment, '__NULL__') AS segment FROM dirty",
    "hyp": """SELECT dom.tid, attr, candidate_val, CASE WHEN attr = 'nation' THEN candidate_val ELSE nation END AS nation, CASE WHEN attr = 'region' THEN candidate_val ELSE region END AS region,
        CASE WHEN attr = 'segment' THEN candidate_val ELSE segment END AS segment FROM dom JOIN filled USING (tid)""",
    "blk1": "SELECT nation, region, count(*) AS n, min(tid) AS t FROM filled WHERE nation <> '__NULL__' GROUP BY ALL",
    "blk2": "SELECT nation, segment, region, count(*) AS n, min(tid) AS t FROM filled WHERE nation <> '__NULL__' AND segment <> '__NULL__' GROUP BY ALL",
    # another tuple with another region: a group of two, or of one that is not the tuple itself
    "f_dc": """SELECT tid, attr, candidate_val, 'DC_VIOLATES_1_ON_' || attr AS feature FROM hyp
        WHERE attr IN ('nation', 'region') AND EXISTS (SELECT 1 FROM blk1 AS b WHERE b.nation = hyp.nation AND b.region <> hyp.region AND (b.n > 1 OR b.t <> hyp.tid))
        UNION ALL SELECT tid, attr, candidate_val, 'DC_VIOLATES_2_ON_' || attr FROM hyp
        WHERE EXISTS (SELECT 1 FROM blk2 AS b WHERE b.nation = hyp.nation AND b.segment = hyp.segment AND b.region <> hyp.region AND (b.n > 1 OR b.t <> hyp.tid))""",
    "feats": "SELECT * FROM f_cooc UNION ALL SELECT * FROM f_min UNION ALL SELECT * FROM f_freq UNION ALL SELECT * FROM f_dc",
    "weights": """SELECT feature, CAST(CASE WHEN feature = 'prior_minimality' THEN -2.0 WHEN feature LIKE 'cooc%' THEN 0.05 * (length(feature) % 7)
        WHEN feature LIKE 'LOGFREQ%' THEN 0.1 * CAST(right(feature, 1) AS INTEGER) ELSE -0.7 END AS DOUBLE) AS weight FROM (SELECT DISTINCT feature FROM feats)""",
    "scored": """SELECT dom.tid, dom.attr, dom.candidate_val, coalesce(s, 0) AS score FROM dom JOIN noisy USING (tid, attr)
        LEFT JOIN (SELECT tid, attr, candidate_val, sum(weight) AS s FROM feats JOIN weights USING (feature) GROUP BY ALL) AS x
        ON x.tid = dom.tid AND x.attr = dom.attr AND x.candidate_val = dom.candidate_val""",
    "marg": """SELECT tid, attr, candidate_val, e / sum(e) OVER (PARTITION BY tid, attr) AS prob
        FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY tid, attr)) AS e FROM scored)""",
    "tcells": """SELECT c.tid, c.attr, c.val FROM cells AS c JOIN dom AS d ON d.tid = c.tid AND d.attr = c.attr AND d.candidate_val = c.val
        WHERE (c.tid, c.attr) NOT IN (SELECT (tid, attr) FROM noisy)""",
    "tstates": "SELECT tid, attr, candidate_val, CASE WHEN candidate_val = val THEN 1 ELSE 0 END AS y FROM dom JOIN tcells USING (tid, attr)",
    "ident": """SELECT dom.tid, dom.attr, candidate_val, v.i AS var_idx, row_number() OVER (PARTITION BY dom.tid, dom.attr ORDER BY candidate_val) - 1 AS domain_idx
        FROM dom JOIN (SELECT tid, attr, row_number() OVER (ORDER BY tid, attr) - 1 AS i FROM cells) AS v ON v.tid = dom.tid AND v.attr = dom.attr""",
    "best": "SELECT tid, attr, candidate_val AS predicted_val, prob FROM marg QUALIFY row_number() OVER (PARTITION BY tid, attr ORDER BY round(prob, 9) DESC, candidate_val) = 1",
    "judged": """SELECT c.tid, c.attr, coalesce(c.val, '__NULL__') AS original, correct_val AS truth, predicted_val AS predicted, q.tid IS NOT NULL AS is_noisy,
        coalesce(coalesce(c.val, '__NULL__') <> correct_val, false) AS is_error
        FROM cells AS c LEFT JOIN truth AS t USING (tid, attr) LEFT JOIN best AS b USING (tid, attr) LEFT JOIN noisy AS q USING (tid, attr)""",
    "counts": """SELECT count(*) FILTER (is_noisy AND is_error AND predicted = truth) AS tp, count(*) FILTER (is_noisy AND predicted <> truth) AS fp,
        count(*) FILTER (is_noisy AND is_error AND predicted IS DISTINCT FROM truth) AS fn, count(*) FILTER (is_error) AS n_errors,
        count(*) FILTER (is_noisy AND is_error) AS noisy_errors, count(*) FILTER (is_noisy AND truth IS NOT NULL AND predicted IS NOT NULL) AS n_predicted FROM judged""",
}


def sql(body: str) -> str:
    """body, which may begin with expressions of its own, after those that it may need."""
    import re

    need: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(CTES[name])
    if not need:
        return body
    before = "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in CTES.items() if k in need)
    return f"{before},\n{body[5:]}" if body.startswith("WITH ") else f"{before}\n{body}"
