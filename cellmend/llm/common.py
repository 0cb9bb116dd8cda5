"""What the training-data operators share: shipping the package, written stages, word tables."""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  binds pa.compute
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.functions.layout import apart  # noqa: F401  for the other modules
from cellmend.sources.tables import checkpointed as save
from cellmend.sources.tables import drop_checkpoint as drop_saved

_SHIPPED: set[str] = set()

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of text that one vectorised step looks at; bounds a Python worker's memory.
STEP_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    folder = tempfile.mkdtemp(prefix="cellmend-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "cellmend.zip")
    with open(path, "wb") as f:
        f.write(blob.getvalue())
    sc.addPyFile(path)
    # Texts can be long: smaller Arrow batches bound a Python worker's memory, and the executor's beside its heap.
    if spark.conf.get(_BATCH) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(_BATCH, "16777216b")
    _SHIPPED.add(sc.applicationId)


def column(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) alone: other columns, whatever their names, never reach the operator. Null text is empty. Ids are integers of any
    width, or texts of such; Spark raises an error for any other."""
    return df.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"))


#: Names of a row's key.
ROW_KEY = ["__file", "__row"]


def with_row_key(df: DataFrame) -> DataFrame:
    """df with ROW_KEY, which tells any two of its rows apart and is the same whenever they are read again: the file that a row is from
    (as a hash) and its place there. What does not come from files is written first."""
    try:
        meta = df.metadataColumn("_metadata")
        keyed = df.select("*", F.xxhash64(meta["file_path"]).alias(ROW_KEY[0]), meta["row_index"].alias(ROW_KEY[1]))
    except AnalysisException:
        return with_row_key(save(df, "rows"))
    return keyed


def texts_with(df: DataFrame, id_col: str, text_col: str, carry: list[str]) -> tuple[DataFrame, str]:
    """texts() with columns to carry after them, and the types of these for a schema."""
    docs = df.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"), *map(column, carry))
    kinds = dict(docs.dtypes)
    return docs, "".join(f", `{c}` {kinds[c]}" for c in carry)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_with_text(df: DataFrame, row: Column | None, text_col: str) -> DataFrame:
    """(row, text) with null text empty; or only row, a struct of all columns with the text among them, where none is given."""
    if row is None:
        return df.select(F.struct(*[column(c) for c in df.columns]).alias("row"))
    return df.select(row.alias("row"), F.coalesce(column(text_col), F.lit("")).alias("text"))


def text_array(batch: pa.RecordBatch, inside: str | None, text_at: int = 1) -> pa.Array:
    """The texts of a batch: a column, or a field of the structs in the first."""
    return batch.column(text_at) if inside is None else pa.compute.struct_field(batch.column(0), inside)


def texts_of(batch: pa.RecordBatch, inside: str | None) -> list[str]:
    return [t or "" for t in text_array(batch, inside).to_pylist()]


def steps(batch: pa.RecordBatch, text_at: int = 1, limit: int = STEP_BYTES, inside: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `limit` bytes of text each; a longer text makes a slice of its own."""
    pa.default_memory_pool().release_unused()  # a worker lives through many stages
    if not batch.num_rows:
        return
    sizes = np.asarray(pa.compute.binary_length(text_array(batch, inside, text_at)).fill_null(0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


#: A-Z to a-z, every other byte as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: As LOWER, and ASCII that is neither letter nor digit becomes a space: what stays are the words.
WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _ASCII_UPPER, _ASCII_LOWER)


def signed(x: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    return x - (1 << 64) if x >= 1 << 63 else x


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learnt from: crc32 of the id's decimal text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """At most n rows in the order of their id's hash: the same rows on every cluster."""
    return df.orderBy(F.xxhash64(column(id_col)), column(id_col)).limit(n)


def labelled_texts(docs: DataFrame, known: DataFrame, most: dict[int, int], id_col: str, text_col: str, chars: int) -> tuple[list[str], list[int]]:
    """Different texts of at most `chars` characters with their labels, at most most[y] of label y, from known (doc_id, y; an id once).
    The documents are read once for all labels; of rows that share an id the greatest text counts."""
    known = save(known, "labels")
    # more ids than are wanted: some documents are too long, or not there
    ids = [bounded_sample(known.where(F.col("y") == y), "doc_id", 2 * n) for y, n in most.items()]
    if not ids:
        return [], []
    found = texts(docs, id_col, text_col).join(F.broadcast(reduce(DataFrame.union, ids)), "doc_id").where(F.length("text") <= chars)
    found = save(found.groupBy("doc_id", "y").agg(F.max("text").alias("text")), "sample")
    out: dict[tuple[str, int], None] = {}
    for y, n in most.items():
        out |= dict.fromkeys((r.text, y) for r in bounded_sample(found.where(F.col("y") == y), "doc_id", n).collect())
    drop_saved(known)
    drop_saved(found)
    return [t for t, _ in out], [y for _, y in out]


SPACES = re.compile(r"\s+")
