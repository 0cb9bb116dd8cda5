"""From a dirty table to repairs and their evaluation; each stage is a table of the run directory."""

from __future__ import annotations

import argparse
import functools
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from cellmend import schema
from cellmend.operators import constraints, detect, domains, evaluate, features, model, repair
from cellmend.operators.cells import attributes, mark_noisy, to_cells, to_wide
from cellmend.sources import tables


@dataclass(frozen=True)
class Settings:
    outlier_attributes: tuple[str, ...] = ("Score",)
    z_threshold: float = schema.Z_THRESHOLD
    min_support: int = schema.MIN_SUPPORT
    correlation_threshold: float = schema.CORRELATION_THRESHOLD
    cooccurrence_threshold: float = schema.COOCCURRENCE_THRESHOLD
    top_candidates: int = schema.TOP_CANDIDATES
    min_domain_size: int = schema.MIN_DOMAIN_SIZE
    max_domain_size: int | None = None
    #: Write every violating pair too; without it, only those of constraints that have no classes.
    pairs: bool = False
    training: model.Training = field(default_factory=model.Training)


def _stage(f: Callable) -> Callable:
    """A stage writes its tables before it ends: what it kept on the way is deleted then."""

    @functools.wraps(f)
    def run(self: Repair, *args: object, **more: object) -> DataFrame:
        with tables.scope(self.run.spark):
            return f(self, *args, **more)

    return run


class Repair:
    """Stages in order: ingest, detect, prune, compile, train, predict, evaluate. Each reads what those before it wrote."""

    def __init__(self, spark: SparkSession, run_path: str, rules: Sequence[constraints.Constraint], settings: Settings = Settings()):
        self.run, self.rules, self.settings = tables.RunDirectory(spark, run_path), list(rules), settings

    def _wide(self) -> DataFrame:
        return to_wide(self.run.read("cells"), self.run.read_settings()["attributes"])

    def ingest(self, wide: DataFrame) -> DataFrame:
        """wide: tid and attributes, as sources.tables gives it. Resets the run."""
        self.run.reset()
        self.run.write_settings({"attributes": attributes(wide), "settings": asdict(self.settings)})
        return self.run.write("cells", to_cells(wide))

    @_stage
    def detect(self, more: Sequence[detect.Detector] = ()) -> DataFrame:
        wide, s = tables.checkpointed(self._wide(), "wide"), self.settings
        dc = detect.DenialConstraintDetector(self.rules, s.min_support)
        self.run.write("violation_classes", dc.find_classes(wide))
        self.run.write("violations", detect.violation_table(dc.find_violations(wide, s.pairs)))
        found = self.run.write("noisy_cells", detect.run_detectors(wide, [dc, detect.OutlierDetector(s.outlier_attributes, threshold=s.z_threshold), *more]))
        self.run.write("cells", mark_noisy(self.run.read("cells"), found))
        return found

    @_stage
    def prune(self) -> DataFrame:
        s = self.settings
        wide = tables.checkpointed(self._wide(), "wide")
        return self.run.write("domains", domains.generate(wide, self.run.read("noisy_cells"), s.correlation_threshold, s.cooccurrence_threshold, s.top_candidates, s.min_domain_size, s.max_domain_size))

    @_stage
    def compile(self) -> DataFrame:
        return self.run.write("features", features.compile_all(tables.checkpointed(self._wide(), "wide"), self.run.read("domains"), self.rules))

    @_stage
    def train(self, start: DataFrame | None = None) -> DataFrame:
        """start: weights to go on from. Losses and accuracies of the epochs are kept in `epochs`."""
        self.epochs: list[model.Epoch] = []
        return self.run.write("weights", model.fit(self.run.read("features"), self.run.read("domains"), self.run.read("cells"), self.settings.training, start, self.epochs))

    @_stage
    def predict(self) -> DataFrame:
        found = self.run.write("marginals", model.predict(self.run.read("features"), self.run.read("domains"), self.run.read("weights"), self.run.read("noisy_cells")))
        return self.run.write("repairs", repair.repairs(found))

    def judged(self, truth: DataFrame) -> DataFrame:
        return evaluate.judged(self.run.read("cells"), truth, repair.argmax(self.run.read("marginals")))

    def evaluate(self, truth: DataFrame) -> DataFrame:
        return evaluate.metrics(evaluate.confusion(self.judged(truth)))

    def report(self, truth: DataFrame) -> list[DataFrame]:
        """The counts, the ratios, and examples of right, wrong and missed repairs."""
        rows = self.judged(truth)
        counts = evaluate.confusion(rows)
        return [counts, evaluate.metrics(counts), evaluate.examples(rows)]

    def inspect(self, k: int = 0) -> DataFrame:
        """What tells the own value of the k-th training cell from its first other candidate."""
        return model.inspect_sample(self.run.read("features"), self.run.read("domains"), self.run.read("cells"), k)

    def run_all(self, wide: DataFrame) -> DataFrame:
        self.ingest(wide)
        self.detect()
        self.prune()
        self.compile()
        self.train()
        return self.predict()


def main(argv: Sequence[str] | None = None) -> None:
    """python -m cellmend.plans.pipeline STAGE --run DIR ...: one stage, or all of them."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("stage", choices=["all", "ingest", "detect", "prune", "compile", "train", "predict", "train_predict", "evaluate", "inspect", "weights"])
    p.add_argument("--run", required=True, help="run directory")
    p.add_argument("--file", help="CSV of the dirty table")
    p.add_argument("--limit", type=int, help="rows to ingest")
    p.add_argument("--constraints", help="file of denial constraints")
    p.add_argument("--truth", help="CSV of the ground truth")
    p.add_argument("--outliers", nargs="*", default=["Score"], help="numeric attributes")
    p.add_argument("--tau", type=float, default=schema.CORRELATION_THRESHOLD, help="least correlation")
    p.add_argument("--z-threshold", type=float, default=schema.Z_THRESHOLD, help="standard deviations from which a number is an outlier")
    p.add_argument("--min-support", type=int, default=schema.MIN_SUPPORT, help="tuples that a value needs to accuse another")
    p.add_argument("--cooccurrence", type=float, default=schema.COOCCURRENCE_THRESHOLD, help="least share of a candidate beside a value")
    p.add_argument("--top", type=int, default=schema.TOP_CANDIDATES, help="candidates for each value beside them")
    p.add_argument("--min-domain", type=int, default=schema.MIN_DOMAIN_SIZE, help="candidates that a noisy cell gets at least")
    p.add_argument("--max-domain", type=int, help="candidates that a cell keeps at most; all by default")
    p.add_argument("--pairs", action="store_true", help="write every violating pair, not their classes alone")
    p.add_argument("--index", type=int, default=0, help="training cell to inspect")
    p.add_argument("--epochs", type=int, default=10)
    p.add_argument("--lr", type=float, default=0.001)
    p.add_argument("--weight-decay", type=float, default=1e-6)
    p.add_argument("--batch-size", type=int, default=64)
    p.add_argument("--optimizer", choices=["adam", "sgd"], default="adam")
    p.add_argument("--seed", type=int, default=0)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("cellmend").getOrCreate()
    rules = constraints.read(spark, a.constraints) if a.constraints else []
    training = model.Training(a.epochs, a.lr, a.weight_decay, a.optimizer, a.batch_size, a.seed)
    job = Repair(spark, a.run, rules, Settings(tuple(a.outliers), a.z_threshold, a.min_support, a.tau, a.cooccurrence, a.top, a.min_domain, a.max_domain, a.pairs, training))
    if a.stage in ("all", "ingest"):
        job.ingest(tables.read_csv(spark, a.file, a.limit))
    for stage in ("detect", "prune", "compile", "train", "predict"):
        if a.stage in ("all", stage) or a.stage == "train_predict" and stage in ("train", "predict"):
            getattr(job, stage)()
            for e in job.epochs if stage == "train" else ():
                print(f"epoch {e.epoch + 1}: loss {e.loss:.6f}, accuracy {e.accuracy}, batches skipped {e.n_skipped}")
    if a.stage == "evaluate" or a.stage == "all" and a.truth:
        for part in job.report(tables.read_truth(spark, a.truth)):
            part.show(truncate=False)
    if a.stage == "inspect":
        job.inspect(a.index).orderBy("side", "feature").show(1000, truncate=False)
    if a.stage == "weights":
        evaluate.weight_report(job.run.read("weights")).show()


if __name__ == "__main__":
    main()
