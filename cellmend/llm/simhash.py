"""SimHash near-dedup with pigeonring candidate filtering.

Fingerprints are 64 bits over word shingles. Copies fall together first: only distinct fingerprints are compared.
Cut the 64 bits into M = 5 segments on a ring. If two fingerprints differ in at most TAU = 2 bits, then by the
pigeonring principle some segment starts a chain all of whose prefixes of l segments differ in at most l * TAU / M
bits: 0 in the first and second, 1 up to the third and fourth, 2 in all. So the index key of a segment is itself and
the next one, 25 or 26 bits, five keys a fingerprint; inside a bucket the further prefixes prune before the Hamming check.

A bucket that holds more than a task should hold is taken apart exactly: with its third and fourth segment the key has
51 or 52 bits, one of the last two segments' bits may differ, so each member also visits the keys one bit away. Members of
one such key differ in the fifth segment alone, at most 2^13 of them, a bound that no data can exceed. A bucket
gives back a star from each member to the least one of its local component, never all pairs; links
between different fingerprints are thus kept as connectivity, and components() closes them.

Defined results: null text and text without words have fingerprint 0 and are linked as any other; a null id is carried,
never the least while its component has a number; rows that repeat are rows of one class; an id that is no integer is an error; an empty
table gives an empty result; other columns are ignored, or carried where asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.llm import common
from cellmend.llm.components import components

SHINGLE, SEED, TAU = 3, 42, 2
#: Segment bounds from the highest bit, on a ring.
BOUNDS = (0, 13, 26, 39, 52, 64)
#: Distinct fingerprints of one bucket that a task compares in memory.
BUCKET = 20_000
#: Keyed fingerprints of a task.
ROWS = 2_000_000
_WHITE = bytes(32 if c == 32 or 9 <= c <= 13 else (c + 32 if 65 <= c <= 90 else c) for c in range(256))


def _hashes(text: str, n: int, seed: int) -> list[int]:
    w = text.encode().translate(_WHITE).split()
    if not w:
        return []
    line, at, pos = b" ".join(w), [], 0
    if len(w) <= n:
        return [xxhash.xxh64_intdigest(line, seed)]
    for x in w:
        at.append(pos)
        pos += len(x) + 1
    at.append(pos)
    digest = xxhash.xxh64_intdigest
    return [digest(line[a : b - 1], seed) for a, b in zip(at, at[n:])]  # noqa: B905  shorter by n on purpose


def fingerprint(hashes: list[int]) -> int:
    """A bit is set if it is in over half the hashes."""
    return int(_fingerprints(np.array(hashes, dtype=np.uint64), np.array([0, len(hashes)]))[0])


def _fingerprints(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts) - 1, dtype=np.uint64)
    for k, (a, b) in enumerate(pairwise(starts.tolist())):
        bits = np.unpackbits(h[a:b].astype(">u8").view(np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255  # a byte counts up to 255
        ones = bits[whole:].sum(axis=0, dtype=np.uint8).astype(np.int64)
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > b - a).view(">u8")[0]
    return out


def _fingerprint_rows(n: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.steps(whole):
                hashes, starts = [], [0]
                for t in b.column(1).to_pylist():
                    hashes += _hashes(t, n, seed)
                    starts.append(len(hashes))
                f = _fingerprints(np.array(hashes, dtype=np.uint64), np.array(starts))
                yield pa.record_batch([b.column(0), pa.array(f.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])

    return run


def _rotated(fp: np.ndarray, i: int) -> np.ndarray:
    """The fingerprint turned so that segment i comes first."""
    k = np.uint64(BOUNDS[i])
    return fp if not i else (fp << k) | (fp >> (np.uint64(64) - k))


def _widths(i: int) -> list[int]:
    w = [b - a for a, b in pairwise(BOUNDS)]
    return w[i:] + w[:i]


def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint its five bucket keys: start segment and two segments."""
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(5):
            width = sum(_widths(i)[:2])
            key = (_rotated(fp, i) >> np.uint64(64 - width)).astype(np.int64) * 5 + i
            yield pa.record_batch([pa.array(key), b.column(0)], ["key", "fp"])


def deep_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a member of a large bucket: its key of four segments (home), and those that one bit of the last two makes of it."""
    for b in batches:
        key = b.column(0).to_numpy(zero_copy_only=False)
        fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(5):
            mine = fp[key % 5 == i]
            w = _widths(i)
            home = _rotated(mine, i) >> np.uint64(64 - sum(w[:4]))
            for flip in range(-1, w[2] + w[3]):
                k = home if flip < 0 else home ^ np.uint64(1 << flip)
                yield pa.record_batch([pa.array((k * np.uint64(8) + np.uint64(i)).view(np.int64)), pa.array(mine.view(np.int64)), pa.array(np.full(len(mine), flip < 0))], ["key", "fp", "home"])


def _stars(fp: np.ndarray, i: int, home: np.ndarray | None) -> list[tuple[int, int]]:
    """Links from each member to the least of its component inside this bucket. home: only pairs with a home member count."""
    n = len(fp)
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    turned, w = _rotated(fp, i), _widths(i)
    prefixes = [(np.uint64(64 - sum(w[:size])), size * TAU // 5) for size in (3, 4)]
    span = max(1, min(n, (1 << 20) // max(1, n)))
    for a in range(0, n, span):
        x = turned[a : a + span, None] ^ turned[None, a:]
        ok = np.ones(x.shape, dtype=bool)
        for shift, budget in prefixes:  # the chain's budgets, before the full check
            ok &= np.bitwise_count(x >> shift) <= budget
        p, q = np.nonzero(ok)
        near = np.bitwise_count(x[p, q]) <= TAU
        p, q = p[near] + a, q[near] + a
        known = np.array([find(k) for k in range(n)])  # what is linked already needs no second look
        new = (p < q) & (known[p] != known[q])
        if home is not None:
            new &= home[p] | home[q]
        for s, t in zip(p[new].tolist(), q[new].tolist(), strict=True):
            s, t = find(s), find(t)
            root[max(s, t)] = min(s, t)
    value = fp.view(np.int64)
    return [(int(value[k]), int(value[r])) for k in range(n) if (r := find(k)) != k]


def _bucket_stars(modulus: int) -> Callable:
    """Over rows sorted by key: one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray | None]] = []
        now = None

        def close() -> list[tuple[int, int]]:
            fp = np.concatenate([x[0] for x in held])
            if len(fp) < 2:
                return []
            home = None if held[0][1] is None else np.concatenate([x[1] for x in held])
            return _stars(fp.view(np.uint64), now % modulus if modulus == 5 else now & 7, home)

        out: list[tuple[int, int]] = []
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            fp = b.column(1).to_numpy(zero_copy_only=False)
            home = b.column(2).to_numpy(zero_copy_only=False) if b.num_columns > 2 else None
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, z in pairwise(edges):
                if z == a:
                    continue
                if key[a] != now and held:
                    out += close()
                    held = []
                now = int(key[a])
                held.append((fp[a:z], None if home is None else home[a:z]))
            if out:
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
                out = []
        if held and (out := close()):
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) at TAU bits or fewer: as many as keep their connectivity."""
    parts = max(distinct.sparkSession.sparkContext.defaultParallelism, 5 * distinct.count() // ROWS)
    keyed = distinct.mapInArrow(keys, "key long, fp long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    large = common.save(sizes.where(F.col("n") > bucket), "large-buckets")
    n_large = large.count()
    small = keyed
    if n_large:
        # a large bucket has over `bucket` of the keys, so there are few: but the join is Spark's to choose
        small = keyed.join(large, "key", "left_anti")
    out = small.repartition(parts, "key").sortWithinPartitions("key").select("key", "fp").mapInArrow(_bucket_stars(5), "a long, b long")
    if n_large:
        deep = keyed.join(large, "key", "left_semi").select("key", "fp").mapInArrow(deep_keys, "key long, fp long, home boolean")
        lone = deep.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_bucket_stars(8), "a long, b long")
        out = out.union(lone)
    return out.distinct()


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET, one_by: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the least id it reaches by links of TAU bits). one_by names columns
    that tell rows apart: they are carried, with kept, true for one row of each component: the least id, and of its rows (or of
    those without an id, where there is no other) the least by these columns."""
    common.ship(df.sparkSession)
    by = one_by or []
    docs, kinds = common.texts_with(df, id_col, text_col, by)
    prints = common.save(docs.mapInArrow(_fingerprint_rows(shingle, SEED), "doc_id long, fp long" + kinds), "fingerprints")
    classes = common.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), bucket))
    rooted = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = rooted.groupBy("root", common.apart("root")).agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    if not by:
        return prints.join(of, "fp").select("doc_id", hexed, "component_id")
    rows = common.save(prints.join(of, "fp").select("doc_id", hexed, "component_id", "root", *map(common.column, by)), "members")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), *map(common.column, by))
    first = rows.groupBy("root", common.apart("root")).agg(F.min(rank).alias("first")).drop("__apart")
    return rows.join(first, "root").select("doc_id", "fingerprint", "component_id", rank.eqNullSafe(F.col("first")).alias("kept"), *map(common.column, by))


def hex_of(fp: int) -> str:
    return struct.pack(">Q", fp).hex()


def brute_force(texts: list[tuple[int, str | None]], shingle: int = SHINGLE) -> list[tuple[int, str, int]]:
    """For tests: every pair, then closure."""
    f = [fingerprint(_hashes(t or "", shingle, SEED)) for _, t in texts]
    root = list(range(len(f)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(f)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= TAU:
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for k, (d, _) in enumerate(texts):
        least[find(k)] = min(d, least.get(find(k), d))
    return [(d, hex_of(f[k]), least[find(k)]) for k, (d, _) in enumerate(texts)]
