"""Small cases that the sample never reaches, and equivalence of rewrites with the literal forms on random tables."""

import random

import pytest
from pyspark.sql import functions as F

from cellmend import schema
from cellmend.functions.text import log_bin, normalise_null, to_number
from cellmend.operators import constraints, detect, domains, evaluate, features, model, repair, stats
from cellmend.operators.cells import mark_noisy, to_cells, to_tuples, to_wide
from cellmend.plans import catalog, dirty
from cellmend.plans.pipeline import Repair, Settings
from cellmend.sources import tables

PH = schema.PLACEHOLDER


def wide(spark, rows, names):
    return spark.createDataFrame([(k + 1, *r) for k, r in enumerate(rows)], "tid long, " + ", ".join(f"{n} string" for n in names))


def pairs(df):
    return sorted((r.tid, r.attr) for r in df.collect())


def test_parser():
    found = constraints.parse("# note\n\nt1&t2&EQ(t1.A,t2.A)&IQ(t1.B,t2.B)\nt1&t2&EQ( t1.A , t2.C )&IQ(t1.B,t2.B)&IQ(t1.C,t2.C)")
    assert [c.id for c in found] == [3, 4]
    assert found[0].fd == ("A", "B") and found[0].block_form == (["A"], "B") and found[1].fd is None and found[1].block_form is None
    assert found[1].attributes == ["A", "B", "C"] and not found[1].symmetric
    for bad in ("t1&t2&LT(t1.A,t2.A)", "t1&t2&EQ(t1.A,5)", "t1&t2&EQ(t1.A)", "t1&what ever"):
        with pytest.raises(ValueError):
            constraints.parse(bad)


def test_text_functions(spark):
    df = spark.createDataFrame([("100%",), ("1d",), ("nan",), (" 12 ",), ("1e3",), ("inf",), ("1_000",), (None,)], "v string")
    assert [r[0] for r in df.select(to_number(F.col("v"))).collect()] == [None, None, None, 12.0, 1000.0, float("inf"), None, None]
    df = spark.createDataFrame([(" a \t",), ("empty",), ("  ",), ("Empty",), ("nan",), ("None",), (None,)], "v string")
    assert [r[0] for r in df.select(normalise_null(F.col("v"))).collect()] == ["a", None, None, "Empty", None, None, None]
    df = spark.createDataFrame([(n,) for n in (0, 8, 9, 98, 99, 99_999, 10**9)], "n long")
    assert [r[0] for r in df.select(log_bin(F.col("n"))).collect()] == [0, 0, 1, 1, 2, 5, 5]


def test_outliers(spark):
    rows = [(str(10 + k % 3), "5", "5" if k == 0 else "x", None) for k in range(20)] + [("1000", "5", "y", "nan")]
    w = wide(spark, rows, ["a", "same", "one", "none"])
    assert pairs(detect.OutlierDetector(["a", "same", "one", "none", "missing"]).detect(w)) == [(21, "a")]
    assert detect.OutlierDetector([]).attributes == ["Score", "Sample"]
    assert detect.OutlierDetector().detect(w).count() == 0
    with pytest.raises(ValueError):
        detect.OutlierDetector(method="isolation_forest")


@pytest.mark.parametrize(("values", "noisy", "kept"), [("xy", "", 0), ("xxy", "y", 2), ("xxyy", "xxyy", 4)])
def test_support(spark, values, noisy, kept):
    c = constraints.parse("t1&t2&EQ(t1.k,t2.k)&IQ(t1.v,t2.v)")[0]
    w = wide(spark, [("k", v) for v in values], ["k", "v"])
    assert sorted(values[t - 1] for t, _ in pairs(detect.fd_noisy(w, "k", "v"))) == sorted(noisy)
    assert detect.violations(w, c).count() == kept


def literal(rows, c, support=2):
    """Pairs and noisy cells by looking at every pair."""
    names = sorted({a for p in c.predicates for a in (p.left, p.right)})
    count = {}
    if c.fd:
        for r in rows:
            if None not in (r[c.fd[0]], r[c.fd[1]]):
                count[r[c.fd[0]], r[c.fd[1]]] = count.get((r[c.fd[0]], r[c.fd[1]]), 0) + 1
    found, noisy = set(), set()
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if not all(None not in (a[p.left], b[p.right]) and (a[p.left] == b[p.right]) == (p.op == "EQ") for p in c.predicates):
                continue
            if c.fd:
                k, t = c.fd
                one, two = count[a[k], b[t]] >= support, count[a[k], a[t]] >= support
                noisy |= ({(i + 1, t)} if one else set()) | ({(j + 1, t)} if two else set())
                if not one and not two:
                    continue
            else:
                noisy |= {(x + 1, n) for x in (i, j) for n in names}
            found.add((i + 1, j + 1))
    return found, noisy


RULES = "\n".join([
    "t1&t2&EQ(t1.a,t2.a)&IQ(t1.b,t2.b)", "t1&t2&EQ(t1.a,t2.a)&EQ(t1.c,t2.c)&IQ(t1.b,t2.b)", "t1&t2&EQ(t1.a,t2.a)&IQ(t1.b,t2.b)&IQ(t1.c,t2.c)",
    "t1&t2&EQ(t1.a,t2.b)&IQ(t1.c,t2.c)", "t1&t2&IQ(t1.a,t2.a)",
])


@pytest.mark.parametrize("seed", range(3))
def test_detection_equals_literal(spark, seed):
    rng = random.Random(seed)
    rows = [{n: rng.choice(["x", "y", "z", None]) for n in "abc"} for _ in range(25)]
    w = wide(spark, [tuple(r[n] for n in "abc") for r in rows], "abc")
    for c in constraints.parse(RULES):
        found, noisy = literal(rows, c) if c.equal else (set(), set())
        assert {(r.tid1, r.tid2) for r in detect.violations(w, c).collect()} == found
        assert set(pairs(detect.fd_noisy(w, *c.fd) if c.fd else detect.general_noisy(w, c))) == noisy
        before = detect.pair_violations(w, c).count()
        assert detect.violation_counts(w, c).first().n_pairs == before


@pytest.mark.parametrize("seed", range(3))
def test_violation_classes_equal_literal(spark, seed):
    """Classes give every tuple as many links as it has violating pairs, and all pairs can be made of them."""
    rng = random.Random(50 + seed)
    rows = [{n: rng.choice(["x", "y", "z", None]) for n in "abc"} for _ in range(25)]
    w = wide(spark, [tuple(r[n] for n in "abc") for r in rows], "abc")
    for c in constraints.parse(RULES + "\nt1&t2&EQ(t1.a,t2.a)&EQ(t1.b,t2.b)"):
        if not c.symmetric:
            with pytest.raises(ValueError):
                detect.violation_classes(w, c)
            continue
        found, _ = literal(rows, c) if c.equal else (set(), set())
        links = [sum(k + 1 in p for p in found) for k in range(len(rows))]
        keys, targets = sorted({p.left for p in c.equal}), sorted({p.left for p in c.unequal})
        want = {}
        for r, n in zip(rows, links, strict=True):
            if n:
                group = (tuple(r[k] for k in keys), tuple(r[t] for t in targets))
                assert want.get(group, (0, n))[1] == n
                want[group] = (want.get(group, (0, n))[0] + 1, n)
        got = {(tuple(r.key), tuple(r.value)): (r.n, r.n_links) for r in detect.violation_classes(w, c).collect()}
        assert got == want
        s = detect.violation_summary(w, c).first()
        assert s.n_stored == len(found) and s.n_potential == detect.pair_violations(w, c).count() == s.n_ignored + s.n_stored
    d = detect.DenialConstraintDetector(constraints.parse(RULES))
    assert d.find_violations(w, all_pairs=False).select("constraint_id").distinct().count() <= 1 and d.find_classes(w).count() > 0
    assert detect.violation_classes(w.limit(0), d.constraints[0]).count() == 0


def test_hot_keys_can_be_split(spark):
    """Where rows meet an aggregate on their key, each side is read through an exchange of its own: no aggregate stands between."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        w = tables.checkpointed(wide(spark, [("k", f"v{i}", "c") for i in range(20)], "abc"), "w")
        cells = tables.checkpointed(to_cells(w), "cells")
        dom = tables.checkpointed(cells.where("val is not null").select("tid", "attr", F.col("val").alias("candidate_val")), "dom")
        fd, block = constraints.parse("t1&t2&EQ(t1.a,t2.a)&IQ(t1.b,t2.b)\nt1&t2&EQ(t1.a,t2.a)&EQ(t1.c,t2.c)&IQ(t1.b,t2.b)")
        plans = [features.log_frequency(dom, cells), features.dc_violation(dom, w, fd), detect.violations(w, fd), detect.general_noisy(w, block), detect.violation_classes(w, fd), detect.fd_noisy(w, "a", "b"),
                 catalog.fixed_weights(features.cooccurrence(dom, cells)).join(features.cooccurrence(dom, cells), "feature")]
        for df in plans:
            plan = df._jdf.queryExecution().executedPlan()

            def check(node):
                kids = [node.children().apply(i) for i in range(node.children().size())]
                if node.nodeName() == "SortMergeJoin" and "tid" not in node.leftKeys().toString():
                    for side in kids:
                        while side.nodeName() not in ("Exchange", "ReusedExchange"):
                            assert "Aggregate" not in side.nodeName(), plan.toString()
                            side = side.children().apply(0)
                for k in kids:
                    check(k)

            check(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_name_counts_once(spark):
    w = wide(spark, [("v", "d", "c=d")], ["a", "`b=c`", "b"])
    dom = spark.createDataFrame([(1, "a", "v")], schema.DOMAINS)
    assert [r.feature for r in features.cooccurrence(dom, to_cells(w)).collect()] == ["cooc_a=v_b=c=d"]


def test_history_and_unusable_batches(spark):
    """Losses fall, accuracy is that of the weights; a batch whose loss is no number makes no step."""
    w = wide(spark, [(f"k{i % 4}", f"v{i % 4}", "ab"[i % 2]) for i in range(40)], ["k", "v", "o"])
    flagged = mark_noisy(to_cells(w), spark.createDataFrame([], schema.NOISY_CELLS))
    dom = tables.checkpointed(domains.generate(w, spark.createDataFrame([], schema.NOISY_CELLS)), "d")
    feats = tables.checkpointed(features.compile_all(w, dom, []), "f")
    for limit in (10**6, 0):
        seen = []
        weights = model.fit(feats, dom, flagged, model.Training(epochs=4, learning_rate=0.1, batch_size=16, local_rows=limit), history=seen)
        assert [e.epoch for e in seen] == [0, 1, 2, 3] and seen[-1].loss < seen[0].loss and all(e.n_skipped == 0 for e in seen)
        assert seen[-1].accuracy == pytest.approx(model.accuracy(feats, dom, flagged, weights).first().accuracy)
    bad = feats.select("feature").distinct().withColumn("weight", F.lit(float("nan")))
    seen = []
    model.fit(feats, dom, flagged, model.Training(epochs=1, batch_size=16), start=bad, history=seen)
    assert seen[0].n_skipped > 0 and seen[0].loss == 0.0
    one = feats.where(F.col("feature") == schema.PRIOR_FEATURE)
    assert model.inspect_sample(one, dom, flagged, 0).first().side == "target" and model.inspect_sample(feats, dom, flagged, 10**6).count() == 0


def test_jdbc(spark):
    url = "jdbc:derby:memory:cells;create=true"
    cells = to_cells(wide(spark, [("p", None), ("it's", "q")], ["x", "y"]))
    tables.write_jdbc(cells, url, "cells", driver="org.apache.derby.jdbc.EmbeddedDriver", numPartitions="2")
    tables.write_jdbc(cells.where("tid = 1"), url, "cells", driver="org.apache.derby.jdbc.EmbeddedDriver")
    back = tables.read_jdbc(spark, url, "cells", driver="org.apache.derby.jdbc.EmbeddedDriver", partitionColumn="TID", lowerBound="1", upperBound="3", numPartitions="2")
    assert back.rdd.getNumPartitions() == 2
    assert sorted(map(str, (tuple(r) for r in back.collect()))) == sorted(str(tuple(r)) for r in [*cells.collect(), *cells.where("tid = 1").collect()])


def test_run_tables_survive_a_failed_write(spark, tmp_path):
    run = tables.RunDirectory(spark, str(tmp_path / "run"))
    assert run.read("cells").count() == 0
    cells = to_cells(wide(spark, [("p",), ("q",)], ["x"]))
    run.write("cells", cells)
    with pytest.raises(Exception):  # noqa: B017  any error of Spark's
        run.write("cells", cells.withColumn("val", F.raise_error(F.lit("no"))))
    assert run.read("cells").count() == 2
    run.write("cells", run.read("cells").where("tid = 1"))
    assert run.read("cells").count() == 1 and len([x for x in (tmp_path / "run" / "cells").iterdir() if x.is_dir()]) == 2  # the failed one is left
    run.reset()
    assert run.read("cells").count() == 0


def test_scope_deletes_what_it_kept(spark, tmp_path):
    with tables.scope(spark):
        inner = tables.checkpointed(spark.range(3), "scoped")
        folder = {f.removeprefix("file:").rsplit("/", 1)[0] for f in inner.inputFiles()}.pop()
        assert inner.count() == 3
    import os

    assert not os.path.exists(folder)


def test_command_line(spark, tmp_path, capsys):
    from cellmend.plans import pipeline

    (tmp_path / "t.csv").write_text("zip,city\n" + "".join(f"{10000 + i % 3},city {i % 3}\n" for i in range(20)) + "10000,town\n")
    (tmp_path / "rules.txt").write_text("t1&t2&EQ(t1.zip,t2.zip)&IQ(t1.city,t2.city)")
    (tmp_path / "truth.csv").write_text("tid,attribute,correct_val\n20,city,city 0\n")
    common = ["--run", str(tmp_path / "run"), "--constraints", str(tmp_path / "rules.txt"), "--outliers", "zip"]
    pipeline.main(["all", *common, "--file", str(tmp_path / "t.csv"), "--truth", str(tmp_path / "truth.csv"), "--epochs", "12", "--lr", "0.1", "--pairs"])
    out = capsys.readouterr().out
    assert "epoch 12: loss" in out and "f1_noisy" in out and "town" in out and "noisy_errors" in out
    pipeline.main(["inspect", *common, "--index", "2"])
    assert "side" in capsys.readouterr().out
    run = tables.RunDirectory(spark, str(tmp_path / "run"))
    assert run.read("violations").count() == 7 and run.read("violation_classes").count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_dc_features_equal_literal(spark, seed):
    rng = random.Random(100 + seed)
    rows = [{n: rng.choice(["x", "y", "z", None]) for n in "abc"} for _ in range(15)]
    w = wide(spark, [tuple(r[n] for n in "abc") for r in rows], "abc")
    dom = [(i + 1, n, v) for i in range(len(rows)) for n in "abc" for v in "xyz" if rng.random() < 0.5]
    df = spark.createDataFrame(dom, schema.DOMAINS)
    filled = [{n: PH if v is None else v for n, v in r.items()} for r in rows]
    for c in constraints.parse(RULES):
        want = set()
        for tid, attr, cand in dom if c.equal else []:
            if attr in c.attributes:
                h = filled[tid - 1] | {attr: cand}
                others = [r for k, r in enumerate(filled) if k != tid - 1]
                if any(all((h[p.left] == r[p.right]) == (p.op == "EQ") and not (p.op == "EQ" and h[p.left] == PH) for p in c.predicates) for r in others):
                    want.add((tid, attr, cand, f"DC_VIOLATES_{c.id}_ON_{attr}"))
        assert {tuple(r) for r in features.dc_violation(df, w, c).collect()} == want


def test_null_target_violates_only_as_feature(spark):
    c = constraints.parse("t1&t2&EQ(t1.k,t2.k)&IQ(t1.v,t2.v)")[0]
    w = wide(spark, [("k", "x"), ("k", None)], ["k", "v"])
    assert detect.pair_violations(w, c).count() == 0
    dom = spark.createDataFrame([(1, "v", "x")], schema.DOMAINS)
    assert features.dc_violation(dom, w, c).count() == 1


def test_merge_first_wins_and_flags(spark):
    a = spark.createDataFrame([(1, "x", None)], schema.NOISY_CELLS)
    b = spark.createDataFrame([(1, "x", "B"), (2, "x", "B")], schema.NOISY_CELLS)
    merged = detect.merge(a, b)
    assert sorted((r.tid, r.detection_method) for r in merged.collect()) == [(1, None), (2, "B")]
    cells = to_cells(wide(spark, [("p",), (None,), ("q",)], ["x"]))
    assert sorted((r.tid, r.is_noisy) for r in mark_noisy(cells, merged).collect()) == [(1, True), (2, True), (3, False)]


def test_reshaping(spark):
    w = wide(spark, [("p", None), (None, "q")], ["x", "y"])
    cells = to_cells(w)
    assert cells.count() == 4
    assert sorted(map(tuple, to_wide(cells, ["x", "y"]).collect())) == sorted(map(tuple, w.collect()))
    assert {r.tid: r["values"] for r in to_tuples(cells).collect()} == {1: {"x": "p", "y": None}, 2: {"x": None, "y": "q"}}
    assert tables.with_tid(w.drop("tid")).count() == 2


def test_domains_ties_and_fallback(spark):
    rows = [("k", f"v{20 - i:02d}") for i in range(11)]
    w = wide(spark, rows, ["c", "t"])
    got = domains.candidates(stats.pair_counts(w), stats.single_stats(to_cells(w)))
    found = {r.candidate_val for r in got.where("target = 't' and cond_val = 'k'").collect()}
    assert found == {f"v{20 - i:02d}" for i in range(10)}  # the ten that come first by tid
    cells = to_cells(wide(spark, [("b",), ("a",), ("b",), ("a",), (None,), ("c",)], ["t"]))
    own = cells.where("val is not null").select("tid", "attr", F.col("val").alias("candidate_val"))
    noisy = spark.createDataFrame([(5, "t", None), (6, "t", None)], schema.NOISY_CELLS)
    more = domains.fallback(cells, own, noisy, stats.single_stats(cells))
    assert sorted((r.tid, r.candidate_val) for r in more.collect()) == [(5, "a"), (5, "b"), (6, "b")]
    assert domains.generate(wide(spark, rows, ["c", "t"]), noisy.limit(0), cap=1).groupBy("tid", "attr").count().where("count > 1").count() == 0


def test_argmax_tie_and_softmax(spark):
    scored = spark.createDataFrame([(1, "a", "y", 2.0), (1, "a", "x", 2.0), (1, "a", "z", 1.0), (2, "a", "q", -900.0)], "tid long, attr string, candidate_val string, score double")
    m = model.softmax(scored)
    assert {r.tid: r.predicted_val for r in repair.argmax(m).collect()} == {1: "x", 2: "q"}
    assert all(abs(r.s - 1) < 1e-12 for r in m.groupBy("tid", "attr").agg(F.sum("prob").alias("s")).collect())


def test_training_agrees_and_learns(spark):
    rows = [(f"k{i % 4}", f"v{i % 4}", "ab"[i % 2]) for i in range(40)]
    w = wide(spark, rows, ["k", "v", "o"])
    cells = to_cells(w)
    noisy = spark.createDataFrame([(1, "v", None)], schema.NOISY_CELLS)
    flagged = mark_noisy(cells, noisy)
    dom = tables.checkpointed(domains.generate(w, noisy), "d")
    feats = tables.checkpointed(features.compile_all(w, dom, []), "f")
    one = model.Training(epochs=3, learning_rate=0.1, batch_size=10**6)
    a = {r.feature: r.weight for r in model.fit_local(model.training_rows(feats, dom, flagged), one).collect()}
    b = {r.feature: r.weight for r in model.fit_distributed(model.training_rows(feats, dom, flagged), one).collect()}
    assert a.keys() == b.keys() and all(a[f] == pytest.approx(b[f], abs=1e-6) for f in a)
    assert a[schema.PRIOR_FEATURE] == -2.0
    weights = model.fit(feats, dom, flagged, model.Training(epochs=30, learning_rate=0.1, optimizer="adam"))
    assert model.accuracy(feats, dom, flagged, weights).first().accuracy > 0.95
    assert repair.argmax(model.predict(feats, dom, weights, noisy)).first().predicted_val == "v0"
    assert model.unknown_features(feats, weights.where("feature not like 'LOG%'")).first().n_rows > 0


def test_training_is_the_same_on_both_sides_of_local_rows(spark):
    w = wide(spark, [(f"k{i % 4}", f"v{i % 4}", "ab"[i % 2]) for i in range(40)], ["k", "v", "o"])
    flagged = mark_noisy(to_cells(w), spark.createDataFrame([(1, "v", None)], schema.NOISY_CELLS))
    dom = tables.checkpointed(domains.generate(w, flagged.where("is_noisy").select("tid", "attr", F.lit(None).cast("string").alias("detection_method"))), "d")
    feats = tables.checkpointed(features.compile_all(w, dom, []), "f")
    for optimizer in ("adam", "sgd"):
        n = model.training_rows(feats, dom, flagged).count()
        a, b = ({r.feature: r.weight for r in model.fit(feats, dom, flagged, model.Training(epochs=3, batch_size=7, optimizer=optimizer, local_rows=limit)).collect()} for limit in (n, n - 1))
        assert a and a == b


def test_csv_tids_run_across_files_of_any_size(spark, tmp_path):
    for k, rows in enumerate([2, 900, 40, 0, 300]):
        (tmp_path / f"part-{k}.csv").write_text("a,b\n" + "".join(f"{k},{i}\n" for i in range(rows)))
    want = [(k, i) for k, rows in enumerate([2, 900, 40, 0, 300]) for i in range(rows)]
    got = tables.read_csv(spark, str(tmp_path)).orderBy("tid").collect()
    assert [r.tid for r in got] == [*range(1, len(want) + 1)] and [(int(r.a), int(r.b)) for r in got] == want
    assert [(r.tid, int(r.a)) for r in tables.read_csv(spark, str(tmp_path), limit=3).orderBy("tid").collect()] == [(1, 0), (2, 0), (3, 1)]


def test_csv_source_reads_the_whole_view(spark):
    got = {tuple(r) for r in catalog.csv_source_whole(spark, "/root/testdata/sf0.001").collect()}
    assert got == {tuple(r) for r in dirty.dirty(spark, "/root/testdata/sf0.001").collect()} and got


def test_train_predict_trains_as_the_method_does(spark, monkeypatch):
    used, fit = [], model.fit
    monkeypatch.setattr(model, "fit", lambda f, d, c, t=model.Training(): used.append(t) or fit(f, d, c, t))
    assert catalog.train_predict(spark, "/root/testdata/sf0.001").count() > 0
    assert used == [model.Training()] and used[0].epochs == 10


def test_evaluation(spark):
    cells = spark.createDataFrame([(1, "a", "bad", True), (2, "a", "ok", True), (3, "a", "ok", True), (4, "a", None, True), (5, "a", "bad", False), (6, "a", "bad", True)], schema.CELLS)
    truth = spark.createDataFrame([(k, "a", "ok") for k in (1, 2, 3, 4, 5, 6)], schema.TRUTH)
    predicted = spark.createDataFrame([(1, "a", "ok"), (2, "a", "ok"), (3, "a", "no"), (4, "a", "no")], "tid long, attr string, predicted_val string")
    rows = evaluate.judged(cells, truth, predicted)
    c = evaluate.confusion(rows).first()
    assert (c.tp, c.fp, c.fn, c.n_errors, c.noisy_errors, c.n_predicted) == (1, 2, 2, 4, 3, 4)
    m = evaluate.metrics(evaluate.confusion(rows)).first()
    assert (m.precision, m.recall_noisy, m.recall_all) == pytest.approx((1 / 3, 1 / 3, 1 / 4))
    assert [r.kind for r in evaluate.examples(rows).collect()].count("fn") == 2
    none = evaluate.metrics(evaluate.confusion(rows.limit(0))).first()
    assert none.f1_noisy == 0.0


def test_end_to_end(spark, tmp_path):
    csv = tmp_path / "t.csv"
    csv.write_text("tid,zip,city\n" + "".join(f"9,{10000 + i % 3},city {i % 3}\n" for i in range(30)) + '9,10000,"ci,ty x"\n9,10001, empty \n')
    rules = constraints.parse("t1&t2&EQ(t1.zip,t2.zip)&IQ(t1.city,t2.city)")
    settings = Settings(outlier_attributes=("zip",), training=model.Training(epochs=20, learning_rate=0.1))
    job = Repair(spark, str(tmp_path / "run"), rules, settings)
    job.run_all(tables.read_csv(spark, str(csv)))
    assert job.run.read("cells").count() == 64
    fixed = {(r.tid, r.attr): r.repaired_val for r in job.run.read("repairs").collect()}
    assert fixed == {(31, "city"): "city 0"}
    truth_csv = tmp_path / "truth.csv"
    truth_csv.write_text("tid,attribute,correct_val\n30,city,city 0\n31,city,\n")
    assert job.evaluate(tables.read_truth(spark, str(truth_csv))).first().f1_noisy == 1.0
    assert job.run.read("repairs").schema == schema.REPAIRS
