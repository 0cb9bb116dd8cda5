"""Schemas of the stage tables and the fixed values of the method."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

#: Stands for a missing value where a stage compares missing values as values.
PLACEHOLDER = "__NULL__"
#: Texts that an ingested table means as missing.
NULL_TEXTS = ("", "empty", "nan", "None")

# Thresholds and names of the method.
CORRELATION_THRESHOLD = 0.1
COOCCURRENCE_THRESHOLD = 0.005
TOP_CANDIDATES = 10
MIN_DOMAIN_SIZE = 2
MIN_SUPPORT = 2
Z_THRESHOLD = 3.0
OUTLIER_ATTRIBUTES = ("Score", "Sample")
OUTLIER_METHOD = "StatisticalOutlierDetector"
PRIOR_FEATURE, PRIOR_WEIGHT = "prior_minimality", -2.0
COOC_PREFIX, FREQ_PREFIX, DC_PREFIX = "cooc_", "LOGFREQ_", "DC_VIOLATES_"


def _schema(**columns: object) -> StructType:
    return StructType([StructField(k, v) for k, v in columns.items()])


CELLS = _schema(tid=LongType(), attr=StringType(), val=StringType(), is_noisy=BooleanType())
DOMAINS = _schema(tid=LongType(), attr=StringType(), candidate_val=StringType())
FEATURES = _schema(tid=LongType(), attr=StringType(), candidate_val=StringType(), feature=StringType())
VIOLATIONS = _schema(constraint_id=IntegerType(), tids=ArrayType(LongType()))
VIOLATION_CLASSES = _schema(constraint_id=IntegerType(), key=ArrayType(StringType()), value=ArrayType(StringType()), n=LongType(), n_links=LongType())
NOISY_CELLS = _schema(tid=LongType(), attr=StringType(), detection_method=StringType())
EXT_DICT = _schema(dict_id=StringType(), ext_tid=StringType(), ext_attr=StringType(), ext_val=StringType())
REPAIRS = _schema(tid=LongType(), attr=StringType(), repaired_val=StringType(), confidence=FloatType())
MARGINALS = _schema(tid=LongType(), attr=StringType(), candidate_val=StringType(), prob=DoubleType())
WEIGHTS = _schema(feature=StringType(), weight=DoubleType())
TRUTH = _schema(tid=LongType(), attr=StringType(), correct_val=StringType())
#: Stage tables by name; a run directory holds one Parquet table of each.
TABLES = {
    "cells": CELLS, "domains": DOMAINS, "features": FEATURES, "violations": VIOLATIONS, "violation_classes": VIOLATION_CLASSES, "noisy_cells": NOISY_CELLS,
    "ext_dict": EXT_DICT, "repairs": REPAIRS, "marginals": MARGINALS, "weights": WEIGHTS,
}
