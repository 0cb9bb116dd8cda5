"""Near copies beyond what 64 bits tell: texts that share four fifths of their five-word shingles, by the pigeonring of simhash.py.

A few changed words move 3 to 14 of 64 majority bits, and no key of so few bits both keeps such pairs together and tells other texts
apart. So a text has a wider fingerprint here: LANES lanes, each the least of its shingles' hashes under a hash of its own. Two
texts' lanes agree as often as their shingle sets are similar, so a Jaccard similarity of 0.8 leaves a fifth of the lanes different.
The lanes stand on a ring of RING segments of three. By the pigeonring principle two fingerprints that differ in at most TAU = RING - 1 lanes have a
segment from which every run of l segments holds at most l * TAU / RING, that is l - 1, different lanes: the first is equal, and
its hash is the index key. In a bucket the next prefixes prune, then comes the Hamming check, then the exact similarity of the two texts.

What is certain and what is not: every pair within TAU lanes meets in a bucket. A pair of similarity 0.8 exactly is within TAU in 99 of 100
cases, of 0.85 in all but some 3 of 100,000. A bucket gives trees over its members and not all pairs, closer links first; the exact check is made on
the trees' links, so a link is lost where a tree's link fails it and no other bucket joins its ends. Nothing is linked that is not 0.8 similar, but for
equal lanes (similarity 0.8 makes them by chance once in 10 million pairs).

A bucket of more than BUCKET fingerprints is cut into blocks by hash, and each two blocks meet in a task: all its pairs are
looked at, at a cost that is quadratic in the number of different lane vectors of one bucket.

Defined results: null texts are empty; texts of no words are copies of each other, texts of fewer than five words have one shingle; null and repeated ids are
rows as others; an empty table gives an empty result; an id that is no integer is an error; other columns are carried only where named.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.llm import common, simhash
from cellmend.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Segments on the ring, lanes of a segment, and the budget of different lanes.
RING, WIDTH = 24, 3
LANES, TAU = RING * WIDTH, RING - 1
#: Links of at most so many different lanes are taken first: they rarely fail the exact check.
CLOSE = 10
#: Lane vectors of one bucket that a task compares at once.
BUCKET = 20_000
#: Keyed vectors of a task, of some 100 bytes each.
ROWS = 400_000
_MIX = np.random.default_rng(simhash.SEED).integers(0, 1 << 63, (2, LANES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def lanes(hashes: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each list of shingle hashes: its lanes (8 bits of each least hash) and its RING keys (64 bits of a segment's least hashes)."""
    filled = [h or [0] for h in hashes]
    at = np.concatenate([[0], np.cumsum([len(h) for h in filled])[:-1]]).astype(np.int64)
    h = np.array([x for one in filled for x in one], dtype=np.uint64)
    least = np.empty((len(filled), LANES), dtype=np.uint64)
    for k in range(LANES):
        x = (h ^ _MIX[0, k]) * _MIX[1, k]
        least[:, k] = np.minimum.reduceat((x ^ (x >> np.uint64(29))) * _ODD, at)
    key = np.zeros((len(filled), RING), dtype=np.uint64)
    for k in range(WIDTH):
        key = (key ^ least[:, k::WIDTH]) * _ODD
        key ^= key >> np.uint64(32)
    return ((least * _ODD) >> np.uint64(56)).astype(np.uint8), key


def _fingerprints(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.steps(whole):
                texts = b.column(1).to_pylist()
                wide, key = lanes([simhash._hashes(t, shingle, simhash.SEED) for t in texts])
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, RING), pa.int32()), pa.array(key.reshape(-1).view(np.int64)))
                cols = [b.column(0), pa.array([w.tobytes() for w in wide], pa.binary()), keys]
                yield pa.record_batch([*cols, *b.columns[2:]], ["doc_id", "lanes", "keys", *b.schema.names[2:]])

    return run


def _trees(v: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links (places in v) that connect what chains from segment `start` and the Hamming check connect: first a forest of close links, then, until
    nothing joins, from each member outside the largest tree its nearest one in another."""
    n = len(v)
    turned = np.roll(v, -start * WIDTH, axis=1)

    def differ(x: int, others: np.ndarray) -> np.ndarray:
        """Different lanes of x and others; more than TAU where the chain breaks."""
        d = np.full(len(others), LANES)
        left = np.arange(len(others))
        for size in (2, 4, 8):
            left = left[(turned[others[left], : size * WIDTH] != turned[x, : size * WIDTH]).sum(axis=1) <= size - 1]
        d[left] = (turned[others[left]] != turned[x]).sum(axis=1)
        return d

    out: list[tuple[int, int]] = []
    tree = np.full(n, -1)
    rest = np.arange(n)
    while len(rest):
        tree[rest[0]] = rest[0]
        queue, root, rest = [int(rest[0])], int(rest[0]), rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = differ(x, rest) <= CLOSE
            found = rest[near]
            tree[found] = root
            out += [(x, int(y)) for y in found]
            queue += found.tolist()
            rest = rest[~near]
    while True:
        roots, sizes = np.unique(tree, return_counts=True)
        largest = roots[np.argmax(sizes)]
        joined = []
        for x in np.flatnonzero(tree != largest).tolist():
            others = np.flatnonzero(tree != tree[x])
            d = differ(x, others)
            if d.min() <= TAU:
                joined.append((x, int(others[np.argmin(d)])))
        if not joined:
            break
        out += joined
        for x, y in joined:
            tree[tree == tree[x]] = tree[y]
    return out


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (start, key, block, node, lanes) sorted by the first three: links of one bucket at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now = None

    def links() -> list[tuple[int, int]]:
        node = np.concatenate([x[0] for x in held])
        if len(node) < 2:
            return []
        v = np.concatenate([x[1] for x in held])
        return [(min(int(node[a]), int(node[b])), max(int(node[a]), int(node[b]))) for a, b in _trees(v, now[0])]

    def rows(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        start, key, block, node = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        v = np.frombuffer(b"".join(b.column(4).to_pylist()), dtype=np.uint8).reshape(-1, LANES)
        change = (np.diff(start) != 0) | (np.diff(key) != 0) | (np.diff(block) != 0)
        out: list[tuple[int, int]] = []
        for p, q in pairwise([0, *(np.flatnonzero(change) + 1).tolist(), len(key)]):
            mine = (int(start[p]), int(key[p]), int(block[p]))
            if mine != now and held:
                out += links() if len(held) > 1 or len(held[0][0]) > 1 else []
                held = []
            now = mine
            held.append((node[p:q], v[p:q]))
        if out:
            yield rows(out)
    if held and (out := links()):
        yield rows(out)


def _similar(shingle: int, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [jaccard(s, t, shingle) >= least for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    return run


def jaccard(s: str, t: str, shingle: int = SHINGLE) -> float:
    """Of the two texts' shingle sets; 1 where both are empty."""
    x, y = (set(simhash._hashes(u, shingle, simhash.SEED)) for u in (s, t))
    return len(x & y) / len(x | y) if x or y else 1.0


def candidates(vectors: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), a < b, between nodes of vectors (node, lanes, keys; different lanes), before the exact check."""
    parts = max(vectors.sparkSession.sparkContext.defaultParallelism, RING * vectors.count() // ROWS)
    keyed = vectors.select("node", "lanes", F.posexplode("keys").alias("start", "key"))
    large = common.save(keyed.groupBy("start", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket), "large-buckets")
    whole = keyed.withColumn("block", F.lit(0).cast("long"))
    if large.count():
        blocks = F.ceil(F.col("n") / bucket).cast("long")
        mine = F.pmod(F.xxhash64("lanes"), F.col("blocks"))
        cut = keyed.join(large, ["start", "key"]).withColumn("blocks", blocks).withColumn("mine", mine)
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other <> mine")
        pair = F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")
        whole = whole.join(large, ["start", "key"], "left_anti").unionByName(cut.select("node", "lanes", "start", "key", pair.alias("block")))
    # trees follow the order of the lanes: numbers of nodes differ from run to run
    dealt = whole.repartition(parts, "start", "key", "block").sortWithinPartitions("start", "key", "block", "lanes")
    return dealt.select("start", "key", "block", "node", "lanes").mapInArrow(_bucket_links, "a long, b long").distinct()


def near_groups(df: DataFrame, one_by: list[str], id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """Per row: doc_id, component_id (the least id that links reach), kept (true for one row of a component: the least id, and of its rows, or of those
    without an id where there is no other, the least by one_by), and the columns one_by, which tell rows apart. `similarity` may be 0.8 or more."""
    common.ship(df.sparkSession)
    docs, kinds = common.texts_with(df, id_col, text_col, one_by)
    schema = "doc_id long, lanes binary, keys array<long>" + kinds
    prints = common.save(docs.mapInArrow(_fingerprints(shingle), schema), "near-fingerprints")
    row = F.struct(*map(common.column, one_by))
    classes = prints.groupBy("lanes").agg(F.min(F.struct(row.alias("r"), F.col("keys"))).alias("m"))
    # a number is the same whenever the table is read again: it is written
    classes = common.save(classes.select(F.monotonically_increasing_id().alias("node"), "lanes", "m.keys", "m.r"), "near-classes")
    found = common.save(candidates(classes, bucket), "near-candidates")
    ends = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
    reps = classes.join(ends, "node", "left_semi").select("node", "r.*")
    texts = common.save(docs.select("text", *map(common.column, one_by)).join(reps, one_by).select("node", "text"), "near-texts")
    both = found.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    checked = both.mapInArrow(_similar(shingle, similarity), "a long, b long")
    roots = components(checked)
    of = classes.join(roots, "node", "left").select("lanes", F.coalesce("root", "node").alias("root"))
    rows = common.save(prints.join(of, "lanes").select("doc_id", "root", *map(common.column, one_by)), "near-members")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), *map(common.column, one_by))
    first = rows.groupBy("root", common.apart("root")).agg(F.min(rank).alias("first"), F.min("doc_id").alias("component_id")).drop("__apart")
    out = rows.join(first, "root").select("doc_id", "component_id", rank.eqNullSafe(F.col("first")).alias("kept"), *map(common.column, one_by))
    for t in (found, texts):
        common.drop_saved(t)
    return out


def brute_force(texts: list[str | None], shingle: int = SHINGLE, similarity: float = SIMILARITY) -> list[int]:
    """For tests: the place of the first text of each text's component, by every pair's similarity."""
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    sets = [set(simhash._hashes(t or "", shingle, simhash.SEED)) for t in texts]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)) and len(x & y) >= similarity * len(x | y):
                s, t = find(i), find(j)
                root[max(s, t)] = min(s, t)
    return [find(k) for k in range(len(texts))]
