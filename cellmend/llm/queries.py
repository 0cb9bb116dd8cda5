"""Queries over the synthetic tables for the operators of this subpackage, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.llm import common
from cellmend.llm.decontaminate import decontaminate
from cellmend.llm.exact_dedup import exact_dedup
from cellmend.llm.html_extract import extract_text
from cellmend.llm.lm_score import lm_scores
from cellmend.llm.pack import pack
from cellmend.llm.quality import quality
from cellmend.llm.secrets import find_secrets
from cellmend.llm.simhash import simhash_groups
from cellmend.llm.toxicity import THRESHOLD, toxicity
from cellmend.llm.url_filter import filter_urls


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(common.table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded, as sums of logarithms differ in the last digits by the order of their terms."""
    scored = lm_scores(common.table(spark, sf_dir, "documents"), leave_out=True)
    return scored.select("doc_id", "n_tokens", *[(F.round(c, n) + 0.0).alias(c) for c, n in (("log_score", 6), ("left_out_log_score", 6), ("mean_log_score", 6))])


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256, {_LOWERED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""



def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(common.table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(common.table(spark, sf_dir, "pages"), rules)


OP4_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM p),
q AS (SELECT r, page_id, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path,
             translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM h),
rules(rh, rp, v) AS (VALUES {", ".join(map(str, URL_RULES))}),
m AS (SELECT r, rh || rp AS rule, v FROM q JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
      QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM q LEFT JOIN m USING (r)
"""


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), F.col("doc_id"))
    return scored.select(
        F.col("row").alias("doc_id"), common.held_out(F.col("row")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans"
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(common.table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("spans")


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_words("text")} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM b, unnest(range(1, len(w) - k + 2)) AS t(i)),
dw AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM d, (SELECT DISTINCT k FROM bw) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
hits AS (SELECT DISTINCT r, i, dw.k, item_id FROM dw JOIN bw USING (k, g)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + k)) AS t(p) GROUP BY r),
m AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items
      FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""

_GRAMS = ("w[i]", "w[i - 1] || ' ' || w[i]", "w[i - 2] || ' ' || w[i - 1] || ' ' || w[i]")

#: c1 to c3: in the corpus, o1 to o3: in the document itself; b1, b2 the gram before, which is the context.
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents),
p AS (SELECT r, i, {", ".join(f"CASE WHEN i >= {k} THEN {g} END AS g{k}" for k, g in enumerate(_GRAMS, 1))} FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
c AS (SELECT r, i, {", ".join(f"count(*) OVER (PARTITION BY g{k}) AS c{k}, count(*) OVER (PARTITION BY r, g{k}) AS o{k}" for k in (1, 2, 3))} FROM p),
x AS (SELECT *, c1 - o1 AS d1, c2 - o2 AS d2, c3 - o3 AS d3, count(*) OVER () AS total, count(*) OVER (PARTITION BY r) AS own,
             lag(c1) OVER v AS b1, lag(c2) OVER v AS b2, lag(c1 - o1) OVER v AS e1, lag(c2 - o2) OVER v AS e2 FROM c WINDOW v AS (PARTITION BY r ORDER BY i)),
s AS (SELECT r, sum(CASE WHEN i >= 3 THEN ln(c3 / b2) WHEN i = 2 THEN ln(c2 / b1) + ln(0.4) ELSE ln(c1 / total) + 2 * ln(0.4) END) AS a,
             sum(CASE WHEN i >= 3 AND d3 > 0 THEN ln(d3 / e2) WHEN i >= 2 AND d2 > 0 THEN ln(d2 / e1) + ln(0.4)
                 ELSE ln(greatest(d1, 1) / greatest(total - own, 1)) + 2 * ln(0.4) END) AS b FROM x GROUP BY r)
SELECT doc_id, len(w) AS n_tokens, round(coalesce(a, 0), 6) + 0.0 AS log_score, round(coalesce(b, 0), 6) + 0.0 AS left_out_log_score,
       round(a / nullif(len(w), 0), 6) + 0.0 AS mean_log_score
FROM d LEFT JOIN s USING (r)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_html_extract": op2_html_extract,
    "op3_quality": op3_quality,
    "op4_url_filter": op4_url_filter,
    "op5_pack": op5_pack,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_decontaminate": op8_decontaminate,
    "op9_secrets": op9_secrets,
    "op10_lm_score": op10_lm_score,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op4_url_filter": OP4_SQL,
    "op8_decontaminate": OP8_SQL,
    "op10_lm_score": OP10_SQL,
}
