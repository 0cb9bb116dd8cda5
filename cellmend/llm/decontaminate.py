"""Benchmark decontamination with one FM-index per training shard.

A shard is some megabytes of documents in one task. Those of its words that the benchmark has become symbols; a run of
others can't be part of a benchmark passage and becomes one separator. Backward search runs windows of the benchmark
at once through the wavelet matrix, sampled suffix positions locate their occurrences, and what they cover is merged per document.
Documents are never shuffled and each shard's index is built once, in one pass with one worker a task. The benchmark is taken in
blocks of a stated size, each broadcast on its own and looked at in turn; a worker holds one at a time, so its memory does not grow
with the benchmark.

Defined results: null text has no words; items without words have no window; a null item_id counts as one item and is written as
an empty string; equal item_ids count once; rows are never merged, so ids may repeat or be null, and are of any type; an empty
benchmark hits nothing; other columns are ignored, or carried where asked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmend.llm import common
from cellmend.llm.fm_index import FMIndex

WINDOW = 13
#: Text of a shard, and of a block of the benchmark, in bytes.
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 16 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str) -> list[bytes]:
    return text.encode().translate(common.WORDS).split()


class Phrases:
    """Windows of some benchmark items as rows of numbers of their words, right-aligned; 0 where a row is shorter."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(number.setdefault(w, len(number) + 1) for w in words(text))
            k = min(window, len(ids))
            for i in range(len(ids) - k + 1 if k else 0):
                found.setdefault(ids[i : i + k], set()).add(item)
        self.words = list(number)
        self.lengths = np.array([len(x) for x in found], dtype=np.int64)
        self.rows = np.zeros((len(found), window), dtype=np.int32)
        for r, x in enumerate(found):
            self.rows[r, window - len(x) :] = x
        self.items = [sorted(x) for x in found.values()]


class Shard:
    """Documents of one task, as symbols, and the FM-index of all that can match: 1 separates, 2 and up are words that some
    block of the benchmark knows. The alphabet is the shard's own, so it and the index are bounded by the shard."""

    def __init__(self, docs: list[list[bytes]], known: set[bytes], shortest: int):
        self.symbol = {w: k for k, w in enumerate(sorted(known), 2)}
        self.starts = np.concatenate(([0], np.cumsum([len(d) + 1 for d in docs])))
        get = self.symbol.get
        ids = np.zeros(int(self.starts[-1]), dtype=np.int32)  # 0: a word outside the alphabet, or a document's end
        for d, a in zip(docs, self.starts.tolist()):  # noqa: B905  starts has one more
            ids[a : a + len(d)] = [get(w, 0) for w in d]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        start, end = edge[::2], edge[1::2]
        long = end - start >= shortest
        start, size = start[long], (end - start)[long]
        self.index = None
        if not shortest or not len(start):
            return
        # the runs that are long enough, with a separator after each
        place = np.cumsum(size + 1) - size - 1
        total = int(size.sum() + len(size))
        self.origin = np.arange(total) + np.repeat(start - place, size + 1)
        text = np.where(np.arange(total) == np.repeat(place + size, size + 1), 1, ids[np.minimum(self.origin, len(ids) - 1)])
        self.index = FMIndex(text, len(self.symbol) + 2)

    def occurrences(self, p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where windows of p occur: document, word in it, and window number."""
        none = np.empty(0, dtype=np.int64)
        if self.index is None:
            return none, none, none
        get = self.symbol.get
        mine = np.fromiter((get(w, 0) for w in [b"", *p.words]), dtype=np.int64, count=len(p.words) + 1)
        rows = mine[p.rows]
        able = np.flatnonzero((rows > 0).sum(axis=1) == p.lengths)  # a word that the shard has not: no occurrence
        lo, hi = self.index.search(rows[able], p.lengths[able])
        hit = np.flatnonzero(lo < hi)
        n = (hi - lo)[hit]
        at = np.repeat(lo[hit] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        at = self.origin[self.index.locate(at)]
        doc = np.searchsorted(self.starts, at, side="right") - 1
        return doc, at - self.starts[doc], np.repeat(able[hit], n)


def _loaded(block, keep: bool) -> Phrases:
    """A broadcast's value, which the worker does not hold on to unless it is the only one."""
    value = block.value
    if not keep:
        block.__dict__.pop("_value", None)
    return value


def _scan(blocks: list, shortest: int, inside: str | None, clean: bool) -> Callable:
    """row[, text] to row, n_words, spans, items. inside: the field of the row that holds the text, where it is not a column of
    its own. clean: give the cleaned rows alone; it is done here, since a second Python pass would double a task's workers."""

    def shard(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = [words(t) for b in batches for t in common.texts_of(b, inside)]
        here, known = set().union(*docs), set()
        for block in blocks:
            known.update(here.intersection(_loaded(block, len(blocks) == 1).words))
        s = Shard(docs, known, shortest)
        n_words = [len(d) for d in docs]
        del docs, here, known
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for block in blocks:
            p = _loaded(block, len(blocks) == 1)
            doc, at, window = s.occurrences(p)
            for d, a, z in zip(doc.tolist(), at.tolist(), (at + p.lengths[window]).tolist(), strict=True):
                spans.setdefault(d, []).append((a, z))
            both = np.unique(doc * max(1, len(p.items)) + window)
            for d, w in zip((both // max(1, len(p.items))).tolist(), (both % max(1, len(p.items))).tolist(), strict=True):
                items.setdefault(d, set()).update(p.items[w])
        k = 0
        for b in batches:
            mine = range(k, k + b.num_rows)
            k += b.num_rows
            n, found = n_words[mine.start : mine.stop], [merge(sorted(spans.get(i, ()))) for i in mine]
            if clean:
                yield _cleaned(b.column(0), found, n, inside)
                continue
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array([sorted(items.get(i, ())) for i in mine], pa.list_(pa.string()))]
            yield pa.record_batch(cols, ["row", "n_words", "spans", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for b in common.steps(whole, inside=inside):
                held.append(b)
                size += common.text_array(b, inside).nbytes
                if size >= SHARD_BYTES:
                    yield from shard(held)
                    held, size = [], 0
        if held:
            yield from shard(held)

    return run


def _cleaned(rows: pa.Array, spans: list[list[int]], n_words: list[int], inside: str) -> pa.RecordBatch:
    """The rows that are not contaminated, with hit spans cut from the text."""
    hits = [sum(s[1::2]) - sum(s[::2]) for s in spans]
    keep = [k for k, (h, n) in enumerate(zip(hits, n_words, strict=True)) if not (h > 0 and 20 * h >= n)]
    rows = rows.take(pa.array(keep, pa.int64()))
    if any(hits[k] for k in keep):
        at = rows.type.get_field_index(inside)
        text = [cut(t, spans[k]) if hits[k] else t for t, k in zip(rows.field(at).to_pylist(), keep, strict=True)]
        fields = [pa.array(text, rows.type.field(i).type) if i == at else rows.field(i) for i in range(rows.type.num_fields)]
        rows = pa.StructArray.from_arrays(fields, fields=list(rows.type))
    return pa.record_batch([rows], ["row"])


def merge(pairs: list[tuple[int, int]]) -> list[int]:
    """Sorted half-open spans, flat, with those that touch or overlap made one."""
    out: list[int] = []
    for a, b in pairs:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def cut(text: str, spans: list[int]) -> str:
    """text without the words of spans, from a span's first word to its last."""
    places, out, at = [m.span() for m in WORD.finditer(text)], [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items, in blocks of about block_bytes; the driver holds one at a time."""
    items = benchmark.select(F.coalesce(common.column(item_col).cast("string"), F.lit("")).alias("i"), common.column(text_col).alias("t")).where("t is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.collect()]


def find_spans(df: DataFrame, row: Column | None, text_col: str, benchmark: DataFrame, item_col: str = "item_id", bench_text_col: str = "text",
               window: int = WINDOW, block_bytes: int = BLOCK_BYTES, clean: bool = False) -> DataFrame:
    """Per row of df: row (the given column, else a struct of all columns), n_words, spans (flat half-open word positions, merged) and
    items (sorted ids); with clean, the cleaned rows alone."""
    spark = df.sparkSession
    common.ship(spark)
    out = common.rows_with_text(df, row, text_col)
    kind = dict(out.dtypes)["row"]
    parts, shortest = [], window
    for items in blocks(benchmark, item_col, bench_text_col, block_bytes):
        p = Phrases(items, window)
        if len(p.lengths):
            shortest = min(shortest, int(p.lengths.min()))
            parts.append(spark.sparkContext.broadcast(p))
    kinds = f"row {kind}" if clean else f"row {kind}, n_words long, spans array<int>, items array<string>"
    return out.mapInArrow(_scan(parts, shortest if parts else 0, text_col if row is None else None, clean), kinds)


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (hit words are a twentieth or more),
    and the merged removal spans."""
    found = find_spans(df, common.column(id_col), text_col, benchmark, **more)
    return found.select(F.col("row").alias("doc_id"), "n_words", "spans", "items").withColumn("n_hit", n_hit()).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"), "spans",
    )


def n_hit() -> Column:
    """Words inside spans."""
    return F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")),
                       lambda a, x: F.struct((a.n + a.sign * x).alias("n"), (-a.sign).alias("sign")), lambda a: a.n)


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **more) -> DataFrame:
    """df's columns: contaminated documents go; from the others every hit span is cut, to its last word."""
    names = df.columns
    out = find_spans(df, None, text_col, benchmark, clean=True, **more).select("row.*")
    if "n_chars" in names and text_col == "text":
        length = F.length(common.column(text_col)).cast(df.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))
    return out.select(*[common.column(c) for c in names])


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """(n_words, n_hit, items) by comparing every window: for tests."""
    w, hit, names = words(text or ""), set(), set()
    for item, other in items:
        ids = words(other or "")
        k = min(window, len(ids))
        for i in range(len(ids) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == ids[i : i + k]:
                    hit.update(range(j, j + k))
                    names.add(item)
    return len(w), len(hit), sorted(names)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
