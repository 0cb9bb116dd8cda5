from cellmend import schema
from cellmend.operators import constraints, detect
from cellmend.sources.tables import RunDirectory
from cellmend.streaming.incremental import detect_batches


def test_incremental_detection(spark, tmp_path):
    source, run = tmp_path / "in", RunDirectory(spark, str(tmp_path / "run"))
    run.reset()
    fields = "tid long, k string, v string"
    write = lambda rows: spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(str(source))
    rules = constraints.parse("t1&t2&EQ(t1.k,t2.k)&IQ(t1.v,t2.v)")

    def step(rows):
        write(rows)
        q = detect_batches(spark.readStream.schema(fields).parquet(str(source)), run, lambda: spark.read.schema(fields).parquet(str(source)), rules, str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
        return sorted((r.tid, r.attr) for r in run.read("noisy_cells").collect())

    assert step([(1, "a", "x"), (2, "a", "x"), (3, "b", "z")]) == []
    assert step([(4, "a", "y")]) == [(4, "v")]
    assert step([(5, "b", "z"), (6, "a", "y")]) == [(1, "v"), (2, "v"), (4, "v"), (6, "v")]
    assert run.read("noisy_cells").schema == schema.NOISY_CELLS


def test_two_rules_on_different_keys_and_outliers(spark, tmp_path):
    source, run = tmp_path / "in", RunDirectory(spark, str(tmp_path / "run"))
    run.reset()
    fields = "tid long, k string, v string, j string, u string, n string"
    rules = constraints.parse("t1&t2&EQ(t1.k,t2.k)&IQ(t1.v,t2.v)\nt1&t2&EQ(t1.j,t2.j)&IQ(t1.u,t2.u)")
    table = lambda: spark.read.schema(fields).parquet(str(source))
    detectors = [detect.DenialConstraintDetector(rules), detect.OutlierDetector(["n"])]
    # 1 shares j with 2 and 3, and their u differ; the batch shares k with 1 alone
    first = [(1, "a", "x", "p", "s", "1"), (2, "b", "x", "p", "t", "1"), (3, "c", "x", "p", "t", "1"), *[(k, f"q{k}", "x", f"q{k}", "s", str(k % 2)) for k in range(10, 30)], (30, "z", "x", "z", "s", "90")]
    for rows in (first, [(4, "a", "x", "o", "s", "1")], [(5, "a", "y", "o", "w", "2"), (6, "a", "y", "o", "w", "500")]):
        spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(str(source))
        q = detect_batches(spark.readStream.schema(fields).parquet(str(source)), run, table, rules, str(tmp_path / "cp"), detectors[1:])
        q.processAllAvailable()
        q.stop()
        got = sorted(tuple(r) for r in run.read("noisy_cells").select("tid", "attr", "detection_method").collect())
        assert got == sorted(tuple(r) for r in detect.run_detectors(table(), detectors).collect())
        assert (1, "u", None) in got
