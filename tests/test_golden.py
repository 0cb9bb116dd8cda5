"""Counts on a 100-row sample that two independent formulations agreed on. SAMPLE_CSV names the sample's file; without it, a table of 100
rows with the sample's columns is looked for in the folders beside the repository."""

import csv
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cellmend.operators import constraints, detect, domains, features, stats
from cellmend.operators.cells import to_cells
from cellmend.sources.tables import checkpointed, read_csv



def sample() -> str:
    if "SAMPLE_CSV" in os.environ:
        return os.environ["SAMPLE_CSV"]
    for path in sorted(Path(__file__).resolve().parents[2].glob("*/*.csv")):
        try:
            with path.open(newline="") as f:
                rows = csv.reader(f)
                if {"ProviderNumber", "MeasureCode", "Stateavg"} <= {*next(rows, [])} and sum(1 for _ in rows) == 100:
                    return str(path)
        except (OSError, UnicodeDecodeError, csv.Error):
            continue
    return ""


CSV = sample()
pytestmark = pytest.mark.skipif(not os.path.exists(CSV), reason="there is no sample")
RULES = [
    (["ZipCode"], "City"), (["ZipCode"], "State"), (["PhoneNumber"], "ZipCode"), (["PhoneNumber"], "City"), (["PhoneNumber"], "State"),
    (["ProviderNumber", "MeasureCode"], "Stateavg"), (["MeasureCode"], "MeasureName"), (["MeasureCode"], "Condition"), (["State", "MeasureCode"], "Stateavg"),
]
TEXT = "\n".join("&".join(["t1", "t2", *(f"EQ(t1.{k},t2.{k})" for k in keys), f"IQ(t1.{t},t2.{t})"]) for keys, t in RULES)


@pytest.fixture(scope="module")
def hospital(spark):
    wide = checkpointed(read_csv(spark, CSV), "hospital")
    rules = constraints.parse(TEXT)
    noisy = checkpointed(detect.run_detectors(wide, [detect.DenialConstraintDetector(rules), detect.OutlierDetector(["Score"])]), "noisy")
    return wide, rules, noisy


def test_cells(hospital):
    cells = to_cells(hospital[0])
    assert cells.count() == 1900
    assert cells.where("val is not null").count() == 1677
    assert [r.tid for r in hospital[0].orderBy("tid").select("tid").collect()] == list(range(1, 101))


def test_violations(hospital):
    wide, rules, _ = hospital
    found = detect.DenialConstraintDetector(rules).find_violations(wide).cache()
    per = {r.constraint_id: r["count"] for r in found.groupBy("constraint_id").count().collect()}
    assert [per.get(k, 0) for k in range(1, 10)] == [9, 10, 4, 5, 4, 0, 10, 3, 4]
    assert sorted((r.tid1, r.tid2) for r in found.where("constraint_id = 9").collect()) == [(7, 34), (34, 37), (34, 73), (34, 94)]
    assert sorted((r.tid1, r.tid2) for r in found.where("constraint_id = 2").collect()) == [(6, 7), (6, 8), (6, 9), (15, 16), (16, 17), (16, 18), (16, 19), (70, 74), (71, 74), (73, 74)]
    assert [detect.violation_counts(wide, c).first().n_pairs for c in rules] == [9, 11, 4, 5, 6, 0, 10, 3, 4]
    assert [detect.pair_violations(wide, c).count() for c in rules] == [9, 11, 4, 5, 6, 0, 10, 3, 4]


def test_noisy(hospital):
    noisy = {}
    for r in hospital[2].collect():
        noisy.setdefault(r.attr, []).append(r.tid)
    assert {k: sorted(v) for k, v in noisy.items()} == {
        "City": [16, 39, 76], "Condition": [15], "MeasureCode": [7, 34, 37, 73, 94], "MeasureName": [61, 99],
        "State": [6, 7, 16, 34, 37, 73, 74, 94], "Stateavg": [7, 34, 37, 73, 94], "ZipCode": [72],
    }


def test_correlations(hospital):
    wide = hospital[0]
    corr = stats.correlations(stats.single_stats(to_cells(wide)), stats.pair_counts(wide)).cache()
    assert corr.count() == 19 * 19
    assert stats.correlated(corr).count() == 269
    of = {(r.attr_x, r.attr_y): r.corr for r in corr.collect()}
    for (x, y), v in {("City", "ZipCode"): 0.980715, ("ZipCode", "City"): 0.981681, ("State", "City"): 0.813541, ("City", "State"): 0.077532, ("Address2", "City"): 1.0, ("City", "Address2"): 0.0}.items():
        assert of[x, y] == pytest.approx(v, abs=1e-6)


def test_domains_and_features(hospital):
    wide, rules, noisy = hospital
    dom = checkpointed(domains.generate(wide, noisy), "domains")
    assert dom.count() == 25592 and dom.distinct().count() == 25592
    sizes = domains.sizes(dom)
    assert sizes.count() == 1700 and domains.max_size(dom).first().max_size == 33
    feats = features.compile_all(wide, dom, rules)
    per = {r.family: (r.n_rows, r.n_names) for r in features.counts(feats).collect()}
    assert per == {"cooc": (404422, 140549), "prior": (1677, 1), "logfreq": (25592, 24), "dc": (19409, 19)}
    dc = {r.feature: r["count"] for r in feats.where(F.col("feature").startswith("DC_")).groupBy("feature").count().collect()}
    assert dc["DC_VIOLATES_9_ON_State"] == 23 and dc["DC_VIOLATES_3_ON_ZipCode"] == 1658 and "DC_VIOLATES_6_ON_Stateavg" not in dc
