"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its last 16 bytes says so, so equal stretches give equal chunks wherever
they stand. Each chunk is named by a 128-bit address. One pass moves every distinct chunk once (copies merge
before the shuffle) and verifies byte by byte that no address stands for two chunks; where one does, all are
named anew with the next seed. From then on a text is its ordered list of verified identifiers, 1-2 % of
its size, and only these lists are grouped and joined.

Defined results: null text counts as empty (an empty list); a null id is a row like any other, is never
preferred to a number, and its group keeps null only if it has no number; rows that repeat an id and text are all
kept (they are the same document) unless one row of each group is asked for; an id that is no integer is an error; an empty table
gives an empty result; other columns are ignored, or carried where asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.llm import common

MIN_CHUNK, MEAN_BITS, MAX_CHUNK, WINDOW = 256, 10, 8192, 16
#: Random 32-bit values by byte for the rolling hash.
GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)


def address(chunk: bytes, seed: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk, seed)


def candidates(data: np.ndarray) -> np.ndarray:
    """Positions after which the hash of the last 16 bytes asks for a cut."""
    h = GEAR[data]
    span = 1
    while span < WINDOW:  # h covers `span` bytes; doubling keeps older bytes in higher bits
        h = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return np.flatnonzero((h >> np.uint32(32 - MEAN_BITS)) == 0) + WINDOW


def cuts(starts: np.ndarray, data: np.ndarray) -> Iterator[list[int]]:
    """For each text between two starts, the ends of its chunks. Nothing before MIN_CHUNK counts, so no window
    reaches into the text before."""
    found = candidates(data) if len(data) >= WINDOW else np.empty(0, dtype=np.int64)
    where = np.searchsorted(found, starts)
    for k in range(len(starts) - 1):
        at, end, out = int(starts[k]), int(starts[k + 1]), []
        for c in found[where[k] : where[k + 1]].tolist():
            while c - at > MAX_CHUNK:
                at += MAX_CHUNK
                out.append(at)
            if c - at >= MIN_CHUNK and c < end:
                out.append(at := c)
        while end - at > MAX_CHUNK:
            at += MAX_CHUNK
            out.append(at)
        if end > at:
            out.append(end)
        yield out


def _normalised(batch: pa.RecordBatch) -> tuple[bytes, np.ndarray]:
    """All texts of a batch in one buffer with A-Z lowered, and where each starts."""
    parts = [x.translate(common.LOWER) for x in batch.column(1).cast(pa.binary()).to_pylist()]
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in parts], out=starts[1:])
    return b"".join(parts), starts


def _recipes(seed: int, name: Callable[[bytes, int], bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.steps(whole):
                data, starts = _normalised(batch)
                recipes, shas = [], []
                for k, ends in enumerate(cuts(starts, np.frombuffer(data, dtype=np.uint8))):
                    at, ids = int(starts[k]), []
                    shas.append(hashlib.sha256(data[at : starts[k + 1]]).digest())
                    for end in ends:
                        ids.append(name(data[at:end], seed))
                        at = end
                    recipes.append(b"".join(ids))
                cols = [batch.column(0), pa.array(recipes, pa.binary()), pa.array(shas, pa.binary()), *batch.columns[2:]]
                yield pa.record_batch(cols, ["doc_id", "recipe", "sha", *batch.schema.names[2:]])

    return run


def _chunks(seed: int, name: Callable[[bytes, int], bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.steps(whole):
                data, starts = _normalised(batch)
                here = set()
                for k, ends in enumerate(cuts(starts, np.frombuffer(data, dtype=np.uint8))):
                    at = int(starts[k])
                    for end in ends:
                        here.add(data[at:end])
                        at = end
                chunks = list(here)
                yield pa.record_batch([pa.array([name(x, seed) for x in chunks], pa.binary()), pa.array(chunks, pa.binary())], ["address", "chunk"])

    return run


def verified_seed(docs: DataFrame, name: Callable[[bytes, int], bytes] = address) -> int:
    """The first seed under which no address stands for two different chunks of docs (doc_id, text)."""
    seed = 0
    while True:
        chunks = docs.mapInArrow(_chunks(seed, name), "address binary, chunk binary").distinct()
        clashes = chunks.groupBy("address").agg(F.count("*").alias("n")).where("n > 1")
        if clashes.limit(1).count() == 0:
            return seed
        seed += 1


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: Callable[[bytes, int], bytes] = address, one_by: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when identical after
    lower-casing A-Z; of equal texts the largest id stays. one_by names columns that tell rows apart: they are carried, and of rows
    that share text and id the greatest by them is kept alone, null ids included."""
    common.ship(df.sparkSession)
    by = one_by or []
    docs, kinds = common.texts_with(df, id_col, text_col, by)
    seed = verified_seed(docs.select("doc_id", "text"), name)
    recipes = common.save(docs.mapInArrow(_recipes(seed, name), "doc_id long, recipe binary, sha binary" + kinds), "recipes")
    # sha follows from the recipe; as a second key it leaves the join below an exchange that AQE can split.
    size, least_null = F.count("*").alias("group_size"), F.struct("doc_id", *map(common.column, by))  # null is least in a struct
    if not by:
        groups = recipes.groupBy("recipe", "sha").agg(F.max("doc_id").alias("keep_id"), size)
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    else:
        groups = recipes.groupBy("recipe", "sha").agg(F.max(least_null).alias("best"), size).withColumn("keep_id", F.col("best.doc_id"))
        kept = least_null.eqNullSafe(F.col("best"))
    return recipes.select("doc_id", "recipe", *map(common.column, by)).join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), *map(common.column, by)
    )
