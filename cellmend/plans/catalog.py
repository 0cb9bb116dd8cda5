"""Queries over the star-schema tables for the operators of this library, each with the SQL that must give the same rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend import schema
from cellmend.functions.layout import apart
from cellmend.functions.text import normalise_null, or_placeholder, strip, to_number
from cellmend.operators import cells as cell_ops
from cellmend.operators import constraints, detect, domains, evaluate, features, model, repair, stats
from cellmend.plans import dirty as base
from cellmend.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FD, GENERAL = base.RULES


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = base.sql(sql)
        return f

    return register


class View:
    """What queries share, each part made when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.wide = base.dirty(spark, sf_dir)

    @property
    def cells(self) -> DataFrame:
        return cell_ops.to_cells(self.wide, base.ATTRS)

    @functools.cached_property
    def noisy(self) -> DataFrame:
        return tables.checkpointed(detect.DenialConstraintDetector(base.RULES).detect(self.wide), "noisy")  # several branches read it

    @property
    def flagged(self) -> DataFrame:
        return cell_ops.mark_noisy(self.cells, self.noisy)

    @property
    def singles(self) -> DataFrame:
        return stats.single_stats(self.cells)

    @property
    def pairs(self) -> DataFrame:
        return stats.pair_counts(self.wide)

    @functools.cached_property
    def domains(self) -> DataFrame:
        return tables.checkpointed(domains.generate(self.wide, self.noisy), "domains")  # three branches read it

    @property
    def features(self) -> DataFrame:
        return features.compile_all(self.wide, self.domains, base.RULES)

    @property
    def marginals(self) -> DataFrame:
        feats = tables.checkpointed(self.features, "features")
        return model.predict(feats, self.domains, fixed_weights(feats), self.noisy)

    @property
    def best(self) -> DataFrame:
        return repair.argmax(self.marginals.withColumn("prob", F.round("prob", 9)))

    def judged(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        truth = cell_ops.to_cells(base.clean(spark, sf_dir), base.ATTRS).select("tid", "attr", F.col("val").alias("correct_val"))
        return evaluate.judged(self.flagged, truth, self.best)


def fixed_weights(feats: DataFrame) -> DataFrame:
    """Weights by family and name, so that scores can be compared."""
    f = F.col("feature")
    w = F.when(f == schema.PRIOR_FEATURE, -2.0).when(f.startswith("cooc"), 0.05 * (F.length(f) % 7)).when(f.startswith("LOGFREQ"), 0.1 * F.right(f, F.lit(1)).cast("int")).otherwise(-0.7)
    return feats.groupBy("feature", apart("feature")).agg(w.cast("double").alias("weight")).select("feature", "weight")


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


# Sources, sinks, reshaping


@query("SELECT tid, attr, val FROM cells")
def cells_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return View(spark, sf_dir).cells.drop("is_noisy")


@query("SELECT tid, nation, region, segment FROM dirty")
def cells_pivot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_ops.to_wide(View(spark, sf_dir).cells, base.ATTRS)


@query("SELECT tid, coalesce(nation, '__NULL__') AS nation, coalesce(region, '__NULL__') AS region, coalesce(segment, '__NULL__') AS segment FROM dirty")
def cells_pivot_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_ops.with_placeholder(cell_ops.to_wide(View(spark, sf_dir).cells, base.ATTRS))


@query("SELECT tid, 'nation=' || coalesce(nation, '__NULL__') || ';region=' || region || ';segment=' || coalesce(segment, '__NULL__') AS tuple_text FROM dirty")
def tuples_as_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cell_ops.to_tuples(View(spark, sf_dir).cells)
    return t.select("tid", F.concat_ws(";", *[F.concat(F.lit(a + "="), or_placeholder(F.col("values")[a])) for a in base.ATTRS]).alias("tuple_text"))


@query("SELECT attr, count(*) AS n_cells, count(*) FILTER (val IS NULL) AS n_null FROM cells GROUP BY attr")
def null_normalise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return View(spark, sf_dir).cells.groupBy("attr").agg(F.count("*").alias("n_cells"), F.count_if(F.col("val").isNull()).alias("n_null"))


@query("SELECT c_custkey, '  ' || c_name || chr(9) AS padded, c_name AS stripped, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS nulled FROM customer")
def strip_and_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base.table(spark, sf_dir, "customer")
    padded = F.concat(F.lit("  "), "c_name", F.lit("\t"))
    token = F.when(F.col("c_custkey") % 3 == 0, " None ").otherwise(padded)
    return c.select("c_custkey", padded.alias("padded"), strip(padded).alias("stripped"), normalise_null(token).alias("nulled"))


@query("SELECT tid, nation, region, segment FROM dirty WHERE tid <= 500")
def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV in order of tid and read again; tid comes from the file's order, and the limit is the reader's own."""
    path = f"{tables.shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    base.raw(spark, sf_dir).repartitionByRange(4, "tid").sortWithinPartitions("tid").select("nation", "region", "segment").write.csv(path, header=True)
    return tables.read_csv(spark, path, limit=500, multi_line=False)


@query("SELECT tid, nation, region, segment FROM dirty")
def csv_source_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole view from several files, whose tids run on from one to the next in order of their names."""
    path = f"{tables.shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    base.raw(spark, sf_dir).repartitionByRange(8, "tid").sortWithinPartitions("tid").select("nation", "region", "segment").write.csv(path, header=True)
    return tables.read_csv(spark, path)


@query("SELECT * FROM (VALUES (2, 'EQ', 'nation', 'nation', true, true), (2, 'IQ', 'region', 'region', true, true), (4, 'EQ', 'a', 'b', false, false), (4, 'EQ', 'c', 'c', false, false), (4, 'IQ', 'd', 'd', false, false)) AS t(id, op, left_attr, right_attr, is_symmetric, is_fd)")
def constraint_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints read from a file that Spark wrote; ids are line numbers, comments and blank lines count."""
    path = f"{tables.shared_dir(spark)}/rules-{uuid.uuid4().hex}"
    text = "# rules\nt1&t2&EQ(t1.nation,t2.nation)&IQ(t1.region,t2.region)\n\nt1&t2&EQ(t1.a,t2.b)&EQ(t1.c,t2.c)&IQ(t1.d,t2.d)"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    rows = [(c.id, p.op, p.left, p.right, c.symmetric, c.fd is not None) for c in constraints.read(spark, path) for p in c.predicates]
    return spark.createDataFrame(rows, "id int, op string, left_attr string, right_attr string, is_symmetric boolean, is_fd boolean")


@query("SELECT tid, attr, CASE WHEN tid % 10 = 0 THEN '__NULL__' ELSE correct_val END AS correct_val FROM truth")
def truth_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole truth as a CSV with ids from 0, some values empty, read again."""
    path = f"{tables.shared_dir(spark)}/truth-{uuid.uuid4().hex}"
    t = cell_ops.to_cells(base.clean(spark, sf_dir), base.ATTRS)
    t.select((F.col("tid") - 1).alias("tid"), F.col("attr").alias("attribute"), F.when(F.col("tid") % 10 != 0, F.col("val")).alias("correct_val")).write.csv(path, header=True)
    return tables.read_truth(spark, path)


@query("SELECT 'cells' AS name, count(*) AS n_rows FROM cells UNION ALL SELECT 'noisy_cells', count(*) FROM noisy UNION ALL SELECT 'repairs', 0 UNION ALL SELECT 'ext_dict', 0")
def run_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = View(spark, sf_dir)
    cells = tables.checkpointed(v.flagged, "flagged")
    run = tables.RunDirectory(spark, f"{tables.shared_dir(spark)}/run-{uuid.uuid4().hex}")
    run.reset()
    run.write("cells", cells)
    run.write("noisy_cells", v.noisy)
    return reduce(DataFrame.unionByName, [run.read(t).agg(F.lit(t).alias("name"), F.count("*").alias("n_rows")) for t in ("cells", "noisy_cells", "repairs", "ext_dict")])


@query("""SELECT 'domains' AS name, count(*) AS n_rows, count(DISTINCT tid) AS n_keys FROM dom UNION ALL SELECT 'features', count(*), count(DISTINCT tid) FROM feats UNION ALL SELECT 'marginals', count(*), count(DISTINCT tid) FROM marg
    UNION ALL SELECT 'weights', count(*), count(DISTINCT feature) FROM weights UNION ALL SELECT 'settings', 3, 1 UNION ALL SELECT 'violation_classes', count(*), 1 FROM vclass""")
def run_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage tables written to a run, replaced by themselves and read again, and the settings beside them."""
    v = View(spark, sf_dir)
    run = tables.RunDirectory(spark, f"{tables.shared_dir(spark)}/run-{uuid.uuid4().hex}")
    feats = run.write("features", v.features)
    weights = run.write("weights", fixed_weights(feats))
    run.write("domains", v.domains)
    run.write("domains", run.read("domains"))  # the old version is read while the new one is written
    run.write("marginals", model.predict(feats, v.domains, weights, v.noisy))
    run.write("violation_classes", detect.violation_classes(v.wide, FD))
    run.write_settings({"attributes": base.ATTRS})
    count = lambda t, key: run.read(t).agg(F.lit(t).alias("name"), F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"))
    settings = spark.createDataFrame([("settings", len(run.read_settings()["attributes"]), 1)], "name string, n_rows long, n_keys long")
    return reduce(DataFrame.unionByName, [count("domains", "tid"), count("features", "tid"), count("marginals", "tid"), count("weights", "feature"), count("violation_classes", "constraint_id")], settings)


@query("SELECT tid, row_number() OVER (ORDER BY tid) AS n FROM dirty")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.dense_number(View(spark, sf_dir).wide.select("tid"), ["tid"], "n0").select("tid", (F.col("n0") + 1).alias("n"))


# Detection


@query("SELECT 1 AS constraint_id, a.tid AS tid1, b.tid AS tid2 FROM dirty AS a JOIN dirty AS b ON a.nation = b.nation AND a.region <> b.region AND a.tid < b.tid JOIN sup AS x ON x.k = a.nation AND x.v = a.region JOIN sup AS y ON y.k = b.nation AND y.v = b.region WHERE x.n >= 2 OR y.n >= 2")
def dc_fd_violations_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.violations(View(spark, sf_dir).wide, FD)


@query("SELECT tid, attr FROM noisy_fd")
def dc_fd_noisy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.fd_noisy(View(spark, sf_dir).wide, *FD.fd)


@query("SELECT 2 AS constraint_id, a.tid AS tid1, b.tid AS tid2 FROM dirty AS a JOIN dirty AS b ON a.nation = b.nation AND a.segment = b.segment AND a.region <> b.region AND a.tid < b.tid")
def dc_nonfd_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.violations(View(spark, sf_dir).wide, GENERAL)


@query("SELECT tid, attr FROM noisy_gen")
def dc_nonfd_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.general_noisy(View(spark, sf_dir).wide, GENERAL)


@query("SELECT 1 AS constraint_id, CAST((sum(a * a) - sum(s)) / 2 AS BIGINT) AS n_pairs FROM (SELECT p_name, sum(n) AS a, sum(n * n) AS s FROM (SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_name)")
def dc_violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = base.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tid"), "p_name", "p_brand")
    return detect.violation_counts(part, constraints.parse("t1&t2&EQ(t1.p_name,t2.p_name)&IQ(t1.p_brand,t2.p_brand)")[0])


@query("SELECT 1 AS constraint_id, nation, region, n, n_links FROM vclass")
def dc_fd_violation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What dc_fd_violations_pairs says, in a row for each value of a key."""
    c = detect.violation_classes(View(spark, sf_dir).wide, FD)
    return c.select("constraint_id", F.col("key")[0].alias("nation"), F.col("value")[0].alias("region"), "n", "n_links")


@query("""WITH g AS (SELECT nation, region, segment, count(*) AS n FROM dirty WHERE nation IS NOT NULL AND region IS NOT NULL AND segment IS NOT NULL GROUP BY ALL)
    SELECT 3 AS constraint_id, a.nation, a.region, a.segment, any_value(a.n) AS n, CAST(sum(b.n) AS BIGINT) AS n_links FROM g AS a JOIN g AS b ON a.nation = b.nation AND a.region <> b.region AND a.segment <> b.segment GROUP BY ALL""")
def dc_general_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two unequal attributes."""
    c = detect.violation_classes(View(spark, sf_dir).wide, base.TWO_UNEQUAL)
    return c.select("constraint_id", F.col("key")[0].alias("nation"), F.col("value")[0].alias("region"), F.col("value")[1].alias("segment"), "n", "n_links")


@query("""SELECT tid, unnest(['nation', 'region', 'segment']) AS attr FROM dirty AS d
    WHERE EXISTS (SELECT 1 FROM dirty AS e WHERE e.nation = d.nation AND e.segment <> d.segment AND e.region <> d.region)""")
def dc_general_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.general_noisy(View(spark, sf_dir).wide, base.TWO_UNEQUAL)


_CROSSED = "SELECT s_suppkey AS tid, s_nationkey AS own, s_suppkey % 31 AS other, s_suppkey % 3 AS label FROM supplier"


@query(f"WITH x AS ({_CROSSED}) SELECT 4 AS constraint_id, a.tid AS tid1, b.tid AS tid2 FROM x AS a JOIN x AS b ON a.own = b.other AND a.label <> b.label AND a.tid < b.tid")
def dc_crossed_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constraint between different attributes, the first tuple being the one with the smaller id."""
    return detect.violations(base.crossed(spark, sf_dir), base.CROSSED)


@query(f"WITH x AS ({_CROSSED}), p AS (SELECT a.tid AS t, b.tid AS u FROM x AS a JOIN x AS b ON a.own = b.other AND a.label <> b.label AND a.tid < b.tid) SELECT DISTINCT tid, unnest(['label', 'other', 'own']) AS attr FROM (SELECT t AS tid FROM p UNION SELECT u FROM p)")
def dc_crossed_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.general_noisy(base.crossed(spark, sf_dir), base.CROSSED)


@query("""WITH p AS (SELECT count(*) AS a, count(*) FILTER (x.n < 2 AND y.n < 2) AS b FROM dirty AS l JOIN dirty AS r ON l.nation = r.nation AND l.region <> r.region AND l.tid < r.tid
    JOIN sup AS x ON x.k = l.nation AND x.v = l.region JOIN sup AS y ON y.k = r.nation AND y.v = r.region),
    q AS (SELECT count(*) AS a FROM dirty AS l JOIN dirty AS r ON l.nation = r.nation AND l.segment = r.segment AND l.region <> r.region AND l.tid < r.tid)
    SELECT 1 AS constraint_id, a AS n_potential, b AS n_ignored, a - b AS n_stored FROM p UNION ALL SELECT 2, a, 0, a FROM q""")
def dc_violation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = View(spark, sf_dir).wide
    return reduce(DataFrame.unionByName, [detect.violation_summary(wide, c) for c in base.RULES])


@query("SELECT 2 AS constraint_id, a.tid AS tid1, b.tid AS tid2, 2 AS n FROM dirty AS a JOIN dirty AS b ON a.nation = b.nation AND a.segment = b.segment AND a.region <> b.region AND a.tid < b.tid")
def violations_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = detect.violation_table(detect.violations(View(spark, sf_dir).wide, GENERAL))
    return t.select("constraint_id", F.col("tids")[0].alias("tid1"), F.col("tids")[1].alias("tid2"), F.size("tids").alias("n"))


@query("SELECT event_id + 1 AS tid, 'value' AS attr, round(abs(value - m) / s, 6) AS z FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) WHERE abs(value - m) / s > 3")
def outlier_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("tid"), F.col("value").cast("string").alias("value"))
    d = detect.OutlierDetector(["value"])
    return d.scores(e).where(~F.isnan("z") & (F.col("z") > d.threshold)).select("tid", "attr", r6("z"))


@query("SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS DOUBLE) AS number, CAST(NULL AS DOUBLE) AS no_number, c_acctbal AS balance FROM customer")
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base.table(spark, sf_dir, "customer")
    return c.select("c_custkey", to_number(F.substr("c_name", F.lit(10))).alias("number"), to_number(F.col("c_name")).alias("no_number"), to_number(F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("balance"))


@query("SELECT tid, attr, CAST(NULL AS VARCHAR) AS detection_method FROM noisy UNION ALL SELECT tid, 'region', 'Placeholder' FROM dirty WHERE region = 'XX' AND tid NOT IN (SELECT tid FROM noisy WHERE attr = 'region') UNION ALL SELECT c_custkey + 1, 'balance', 'StatisticalOutlierDetector' FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer) WHERE abs(c_acctbal - m) / s > 1.6")
def noisy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    class PlaceholderRegion:
        def detect(self, wide: DataFrame) -> DataFrame:
            return wide.where("region = 'XX'").select("tid", F.lit("region").alias("attr"), F.lit("Placeholder").alias("detection_method"))

    v = View(spark, sf_dir)
    balance = base.table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("tid"), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("balance"))
    return detect.run_detectors(v.wide.join(balance, "tid"), [detect.DenialConstraintDetector(base.RULES), PlaceholderRegion(), detect.OutlierDetector(["balance"], threshold=1.6)])


@query("SELECT tid, attr, val, (tid, attr) IN (SELECT (tid, attr) FROM noisy) AS is_noisy FROM cells")
def is_noisy_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return View(spark, sf_dir).flagged


# Statistics


@query("SELECT attr, val, n, first_tid FROM singles")
def single_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return View(spark, sf_dir).singles


@query("SELECT a1, v1, a2, v2, n, first_tid FROM pstats")
def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pair_stats(View(spark, sf_dir).pairs)


@query("SELECT attr, val, count(*) AS n FROM cells WHERE val IS NOT NULL GROUP BY attr, val")
def value_counts_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(View(spark, sf_dir).cells)


@query("SELECT k, v, n FROM sup")
def fd_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.fd_support(View(spark, sf_dir).wide, *FD.fd)


@query("SELECT attr, round(h, 6) AS h FROM h")
def attr_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.attr_entropy(View(spark, sf_dir).singles).select("attr", r6("h"))


@query("SELECT a1, a2, round(h, 6) AS h FROM hj WHERE a1 < a2")
def joint_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.joint_entropy(View(spark, sf_dir).pairs).select("a1", "a2", r6("h"))


@query("SELECT attr_x, attr_y, round(corr, 6) AS corr FROM corr")
def attr_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = View(spark, sf_dir)
    return stats.correlations(v.singles, v.pairs).select("attr_x", "attr_y", r6("corr"))


@query("SELECT attr_x, attr_y FROM corr WHERE attr_x <> attr_y AND corr >= 0.1")
def correlated_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = View(spark, sf_dir)
    return stats.correlated(stats.correlations(v.singles, v.pairs))


# Domains


@query("SELECT target, cond, cond_val, candidate_val, n, round(p, 6) AS p FROM cands")
def cooc_candidates_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = View(spark, sf_dir)
    return domains.candidates(v.pairs, v.singles).select("target", "cond", "cond_val", "candidate_val", "n", r6("p"))


@query("SELECT tid, attr, candidate_val FROM (SELECT q.tid, q.attr, s.val AS candidate_val, c.val AS own, row_number() OVER (PARTITION BY q.tid, q.attr ORDER BY s.n DESC, s.first_tid) AS r FROM noisy AS q JOIN cells AS c USING (tid, attr) JOIN singles AS s ON s.attr = q.attr AND s.val <> '__NULL__' WHERE c.val IS NULL OR s.val <> c.val) WHERE r <= CASE WHEN own IS NULL THEN 2 ELSE 1 END")
def domain_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback where a domain is the cell's own value alone."""
    v = View(spark, sf_dir)
    own = v.cells.where("val is not null").select("tid", "attr", F.col("val").alias("candidate_val"))
    return domains.fallback(v.cells, own, v.noisy, v.singles)


@query("SELECT tid, attr, candidate_val FROM dom")
def cell_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = View(spark, sf_dir)
    return domains.generate(v.wide, v.noisy)


@query("SELECT tid, attr, count(*) AS size FROM dom GROUP BY tid, attr")
def domain_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.sizes(View(spark, sf_dir).domains)


@query("SELECT max(size) AS max_size FROM (SELECT count(*) AS size FROM dom GROUP BY tid, attr)")
def domain_max_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.max_size(View(spark, sf_dir).domains)


# Features


@query("SELECT tid, attr, candidate_val, feature FROM f_cooc")
def feat_cooc(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = View(spark, sf_dir)
    return features.cooccurrence(v.domains, v.cells)


@query("SELECT tid, attr, candidate_val, feature FROM f_min")
def feat_minimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = View(spark, sf_dir)
    return features.minimality(v.domains, v.cells)


@query("SELECT tid, attr, candidate_val, feature FROM f_freq")
def feat_logfreq(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = View(spark, sf_dir)
    return features.log_frequency(v.domains, v.cells)


@query("SELECT tid, attr, candidate_val, feature FROM f_dc")
def feat_dc(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = View(spark, sf_dir)
    return reduce(DataFrame.unionByName, [features.dc_violation(v.domains, v.wide, c) for c in base.RULES])


@query("""SELECT tid, attr, candidate_val, 'DC_VIOLATES_3_ON_' || attr AS feature FROM hyp
    WHERE nation <> '__NULL__' AND EXISTS (SELECT 1 FROM filled AS e WHERE e.tid <> hyp.tid AND e.nation = hyp.nation AND e.region <> hyp.region AND e.segment <> hyp.segment)""")
def feat_dc_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = View(spark, sf_dir)
    return features.dc_violation(v.domains, v.wide, base.TWO_UNEQUAL)


@query("""SELECT 1 AS constraint_id, count(*) FILTER (attr IN ('nation', 'region')) AS n_candidates, count(*) FILTER (attr IN ('nation', 'region') AND nation = '__NULL__') AS n_skipped,
        (SELECT count(*) FROM f_dc WHERE feature LIKE 'DC_VIOLATES_1%') AS n_found FROM hyp
    UNION ALL SELECT 2, count(*), count(*) FILTER (nation = '__NULL__' OR segment = '__NULL__'), (SELECT count(*) FROM f_dc WHERE feature LIKE 'DC_VIOLATES_2%') FROM hyp""")
def dc_feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = View(spark, sf_dir)
    return reduce(DataFrame.unionByName, [features.dc_counts(v.domains, v.wide, c) for c in base.RULES])


@query("""SELECT CASE WHEN feature = 'prior_minimality' THEN 'prior' WHEN feature LIKE 'DC%' THEN 'dc' WHEN feature LIKE 'cooc%' THEN 'cooc' ELSE 'logfreq' END AS family,
    count(*) AS n_rows, count(DISTINCT feature) AS n_names FROM feats GROUP BY ALL""")
def feature_union_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.counts(View(spark, sf_dir).features)


@query("SELECT DISTINCT feature FROM feats")
def feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return View(spark, sf_dir).features.select("feature").distinct()


# Model


@query("SELECT tid, attr, row_number() OVER (ORDER BY tid, attr) - 1 AS var_idx, (tid, attr) IN (SELECT (tid, attr) FROM noisy) AS is_query FROM cells")
def encode_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.encode_variables(View(spark, sf_dir).flagged)


@query("SELECT tid, attr, candidate_val, CAST(row_number() OVER (PARTITION BY tid, attr ORDER BY candidate_val) - 1 AS INTEGER) AS domain_idx FROM dom")
def encode_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.encode_domains(View(spark, sf_dir).domains)


@query("SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS feature_idx FROM (SELECT DISTINCT feature FROM feats)")
def encode_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.encode_features(View(spark, sf_dir).features)


@query("SELECT var_idx, CAST(domain_idx AS INTEGER) AS domain_idx, feature_idx FROM feats JOIN ident USING (tid, attr, candidate_val) JOIN (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS feature_idx FROM (SELECT DISTINCT feature FROM feats)) USING (feature)")
def design_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = View(spark, sf_dir)
    return model.encode_states(tables.checkpointed(v.features, "features"), v.domains, v.flagged)


@query("""SELECT count(*) AS n_rows, count(*) FILTER (attr = 'segment') AS n_unknown_cells, count(*) FILTER (attr <> 'segment' AND candidate_val = 'XX') AS n_unknown_candidates,
    count(*) FILTER (attr <> 'segment' AND candidate_val <> 'XX' AND feature = 'prior_minimality') AS n_unknown_features FROM feats""")
def encoding_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the cells of one attribute, one candidate and one feature unknown."""
    v = View(spark, sf_dir)
    feats = tables.checkpointed(v.features, "features")
    return model.encoding_skips(feats, v.domains.where("candidate_val <> 'XX'"), v.cells.where("attr <> 'segment'"), feats.where(F.col("feature") != schema.PRIOR_FEATURE))


@query("SELECT c.tid, c.attr, CAST(coalesce(x.i, -1) AS INTEGER) AS y FROM cells AS c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY tid, attr ORDER BY candidate_val) - 1 AS i FROM dom) AS x ON x.tid = c.tid AND x.attr = c.attr AND x.candidate_val = c.val")
def evidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = View(spark, sf_dir)
    return model.labels(v.domains, v.cells)


@query("SELECT q AS is_query, attr, count(*) AS n FROM (SELECT attr, (tid, attr) IN (SELECT (tid, attr) FROM noisy) AS q FROM cells) GROUP BY ALL")
def evidence_query_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = zip(model.split(View(spark, sf_dir).flagged), (False, True), strict=True)
    return reduce(DataFrame.unionByName, [p.groupBy("attr").agg(F.count("*").alias("n")).withColumn("is_query", F.lit(q)) for p, q in parts])


@query("SELECT tid, attr, candidate_val, round(score, 6) AS score FROM scored")
def score_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = View(spark, sf_dir)
    feats = tables.checkpointed(v.features, "features")
    mine = v.noisy.select("tid", "attr")
    return model.scores(feats.join(mine, ["tid", "attr"], "left_semi"), v.domains.join(mine, ["tid", "attr"], "left_semi"), fixed_weights(feats)).select("tid", "attr", "candidate_val", r6("score"))


@query("SELECT tid, attr, candidate_val, round(prob, 6) AS prob FROM marg")
def score_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return View(spark, sf_dir).marginals.select("tid", "attr", "candidate_val", r6("prob"))


@query("SELECT tid, attr, count(*) AS n, round(sum(prob), 6) AS total FROM marg GROUP BY tid, attr")
def marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = repair.marginal_maps(View(spark, sf_dir).marginals)
    total = F.aggregate(F.map_values("marginals"), F.lit(0.0), lambda a, x: a + x)
    return m.select("tid", "attr", F.size("marginals").cast("long").alias("n"), F.round(total, 6).alias("total"))


@query("SELECT tid, attr, predicted_val, round(prob, 6) AS prob FROM best")
def argmax_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return View(spark, sf_dir).best.select("tid", "attr", "predicted_val", r6("prob"))


@query("SELECT tid, attr, predicted_val AS repaired_val, round(prob, 4) AS confidence FROM best")
def repairs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = repair.repairs(View(spark, sf_dir).marginals.withColumn("prob", F.round("prob", 9)))
    return fixed.select("tid", "attr", "repaired_val", F.round(F.col("confidence").cast("double"), 4).alias("confidence"))


@query("SELECT c.tid, c.attr, coalesce(b.predicted_val, c.val) AS val, n.tid IS NOT NULL AS is_noisy FROM cells AS c LEFT JOIN best AS b USING (tid, attr) LEFT JOIN noisy AS n USING (tid, attr)")
def repaired_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = View(spark, sf_dir)
    return repair.apply_repairs(v.flagged, repair.repairs(v.marginals.withColumn("prob", F.round("prob", 9))))


@query("""SELECT feature, round(sum(1 / size - CASE WHEN candidate_val = val THEN 1 ELSE 0 END), 6) AS gradient FROM feats JOIN cells USING (tid, attr)
    JOIN (SELECT tid, attr, count(*) AS size FROM dom GROUP BY tid, attr) AS z USING (tid, attr)
    WHERE val IS NOT NULL AND (tid, attr) NOT IN (SELECT (tid, attr) FROM noisy) GROUP BY feature""")
def gradient_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full-batch gradient at zero weights."""
    v = View(spark, sf_dir)
    rows = tables.checkpointed(model.training_rows(v.features, v.domains, v.flagged), "training")
    zero = rows.where("feature is not null").select("feature").distinct().withColumn("weight", F.lit(0.0))
    return model.gradient(rows, zero).select("feature", (F.round("gradient", 6) + 0.0).alias("gradient"))


def _residual(weights: str) -> str:
    """SQL: probability less observation of each training state."""
    return f"""SELECT tid, attr, candidate_val, e / sum(e) OVER (PARTITION BY tid, attr) - y AS residual FROM (
        SELECT *, exp(s - max(s) OVER (PARTITION BY tid, attr)) AS e FROM (
            SELECT t.tid, t.attr, t.candidate_val, any_value(y) AS y, coalesce(sum(weight), 0) AS s FROM tstates AS t
            LEFT JOIN feats USING (tid, attr, candidate_val) LEFT JOIN {weights} USING (feature) GROUP BY t.tid, t.attr, t.candidate_val))"""


def _gradient(residual: str) -> str:
    return f"SELECT feature, sum(residual) AS g FROM feats JOIN {residual} USING (tid, attr, candidate_val) GROUP BY feature"


@query(f"WITH r0 AS ({_residual('weights')}), g0 AS ({_gradient('r0')}) SELECT feature, round(g, 6) + 0.0 AS gradient FROM g0")
def gradient_at_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full-batch gradient at weights that are not zero, so the softmax inside it counts."""
    v = View(spark, sf_dir)
    rows = tables.checkpointed(model.training_rows(v.features, v.domains, v.flagged), "training")
    return model.gradient(rows, fixed_weights(rows.where("feature is not null"))).select("feature", (F.round("gradient", 6) + 0.0).alias("gradient"))


#: Of descent_two_steps.
_RATE, _DECAY = 0.37, 0.013


@query(f"""WITH r0 AS ({_residual('weights')}), n AS (SELECT count(*) AS n FROM tcells),
    w0 AS (SELECT feature, weight, g / n + {_DECAY} * weight AS m FROM ({_gradient('r0')}) JOIN weights USING (feature), n),
    w1 AS (SELECT feature, CASE WHEN feature = 'prior_minimality' THEN -2.0 ELSE weight - {_RATE} * m END AS weight, m FROM w0), r1 AS ({_residual('w1')}),
    w2 AS (SELECT feature, CASE WHEN feature = 'prior_minimality' THEN -2.0 ELSE weight - {_RATE} * (0.9 * m + g / n + {_DECAY} * weight) END AS weight FROM ({_gradient('r1')}) JOIN w1 USING (feature), n)
    SELECT feature, round(weight, 6) + 0.0 AS weight FROM w2""")
def descent_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training itself, from stated weights: two epochs of one batch, by gradient descent with momentum and decay."""
    v = View(spark, sf_dir)
    feats, cells = tables.checkpointed(v.features, "features"), tables.checkpointed(v.flagged, "cells")
    t = model.Training(epochs=2, learning_rate=_RATE, weight_decay=_DECAY, optimizer="sgd", batch_size=1 << 40)
    return model.fit(feats, v.domains, cells, t, start=fixed_weights(feats)).select("feature", (F.round("weight", 6) + 0.0).alias("weight"))


@query("SELECT count(*) AS n_features, round(1 / sqrt(count(*)), 9) AS bound, true AS all_within, true AS spread FROM (SELECT DISTINCT feature FROM feats JOIN tstates USING (tid, attr, candidate_val))")
def initial_weight_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights start within one over the root of their number, all but the prior's."""
    v = View(spark, sf_dir)
    w = model.initial_weights(tables.checkpointed(model.training_rows(v.features, v.domains, v.flagged), "training"))
    free, size = F.when(F.col("feature") != schema.PRIOR_FEATURE, F.abs("weight")), F.lit(1.0) / F.sqrt(F.count("*"))
    return w.agg(F.count("*").alias("n_features"), F.round(size, 9).alias("bound"), (F.max(free) <= size).alias("all_within"), (F.max(free) > 0.5 * size).alias("spread"))


@query("""SELECT count(*) AS n, round(avg(CASE WHEN candidate_val = val THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM tcells JOIN (
    SELECT tid, attr, candidate_val FROM (SELECT t.tid, t.attr, t.candidate_val, coalesce(sum(weight), 0) AS s FROM tstates AS t LEFT JOIN feats USING (tid, attr, candidate_val) LEFT JOIN weights USING (feature)
    GROUP BY t.tid, t.attr, t.candidate_val) QUALIFY row_number() OVER (PARTITION BY tid, attr ORDER BY round(s, 9) DESC, candidate_val) = 1) USING (tid, attr)""")
def training_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = View(spark, sf_dir)
    feats = tables.checkpointed(v.features, "features")
    weights = fixed_weights(feats)
    return model.accuracy(feats, v.domains, tables.checkpointed(v.flagged, "cells"), weights).select("n", r6("accuracy"))


@query("""WITH k AS (SELECT tid, attr, val FROM tcells ORDER BY tid, attr LIMIT 1 OFFSET 100), o AS (SELECT tid, attr, val, min(candidate_val) FILTER (candidate_val <> val) AS other FROM k LEFT JOIN dom USING (tid, attr) GROUP BY ALL),
    f AS (SELECT o.*, feature, bool_or(candidate_val = val) AS t, coalesce(bool_or(candidate_val = other), false) AS u FROM feats JOIN o USING (tid, attr) GROUP BY ALL)
    SELECT tid, attr, val AS target_val, other AS other_val, CASE WHEN t THEN 'target' ELSE 'other' END AS side, feature FROM f WHERE t <> u""")
def inspect_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training cell 100, which any table of the tests has."""
    v = View(spark, sf_dir)
    return model.inspect_sample(v.features, v.domains, v.flagged, 100)


@query()
def train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = View(spark, sf_dir)
    feats, cells = tables.checkpointed(v.features, "features"), tables.checkpointed(v.flagged, "cells")
    return model.predict(feats, v.domains, model.fit(feats, v.domains, cells, model.Training()), v.noisy)


# Evaluation and reports


@query("SELECT tp, fp, fn, n_errors, noisy_errors, n_predicted FROM counts")
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(View(spark, sf_dir).judged(spark, sf_dir))


@query("""SELECT round(p, 6) AS precision, round(r, 6) AS recall_noisy, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1_noisy, round(a, 6) AS recall_all
    FROM (SELECT coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(noisy_errors, 0), 0) AS r, coalesce(tp / nullif(n_errors, 0), 0) AS a FROM counts)""")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.metrics(evaluate.confusion(View(spark, sf_dir).judged(spark, sf_dir)))
    return m.select(*[r6(c) for c in m.columns])


@query("""(SELECT 'tp' AS kind, tid, attr, original, truth, predicted FROM judged WHERE is_noisy AND is_error AND predicted = truth ORDER BY tid, attr LIMIT 5)
    UNION ALL (SELECT 'fp', tid, attr, original, truth, predicted FROM judged WHERE is_noisy AND predicted <> truth ORDER BY tid, attr LIMIT 10)
    UNION ALL (SELECT 'fn', tid, attr, original, truth, predicted FROM judged WHERE is_noisy AND is_error AND predicted IS DISTINCT FROM truth ORDER BY tid, attr LIMIT 10)""")
def eval_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.examples(tables.checkpointed(View(spark, sf_dir).judged(spark, sf_dir), "judged"))


@query("""SELECT CASE WHEN feature = 'prior_minimality' THEN 'prior' WHEN feature LIKE 'DC%' THEN 'dc' WHEN feature LIKE 'cooc%' THEN 'cooc' ELSE 'logfreq' END AS family,
    count(*) AS n, round(avg(weight), 6) AS mean, round(stddev_pop(weight), 6) AS std, round(min(weight), 6) AS low, round(max(weight), 6) AS high, round(avg(abs(weight)), 6) AS mean_abs FROM weights GROUP BY ALL""")
def weight_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.weight_report(fixed_weights(View(spark, sf_dir).features))
    return r.select("family", "n", *[r6(c) for c in ("mean", "std", "low", "high", "mean_abs")])


@query("""SELECT feature, 'target' AS side FROM (SELECT feature FROM feats WHERE tid = 75 AND attr = 'region' AND candidate_val = 'XX' EXCEPT SELECT feature FROM feats WHERE tid = 75 AND attr = 'region' AND candidate_val = 'ASIA')
    UNION ALL SELECT feature, 'other' FROM (SELECT feature FROM feats WHERE tid = 75 AND attr = 'region' AND candidate_val = 'ASIA' EXCEPT SELECT feature FROM feats WHERE tid = 75 AND attr = 'region' AND candidate_val = 'XX')""")
def active_feature_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.active_difference(View(spark, sf_dir).features, 75, "region", "XX", "ASIA")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(attr, n_noisy): noisy cells of the dirty view by attribute."""
    v = View(spark, sf_dir)
    return v.noisy.groupBy("attr").agg(F.count("*").alias("n_noisy"))


QUERIES["noisy_by_attribute"] = flagship
SQL["noisy_by_attribute"] = base.sql("SELECT attr, count(*) AS n_noisy FROM noisy GROUP BY attr")
