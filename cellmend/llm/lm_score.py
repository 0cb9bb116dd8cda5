"""Stupid-backoff language model scores, computed relationally.

Three relations, all over 64-bit n-gram hashes and stored as packed rows (sorted, delta-coded arrays) so that a shuffle
carries some six bytes for an n-gram:
  requests(block, gram, n)   the exploded n-grams of every document, pre-aggregated in each block of a few million words;
  table(gram, count)         their sums, partitioned by ranges of the hash: a range is a partition, so each task sums one;
  replies(block, gram, count) requests joined to the table in the partition where it is made: one shuffle serves count and join. A reply
                              lists counts in the order of the block's sorted grams, which the block makes again from its texts.
Replies and the block's texts meet by block, and each word of a document takes the longest gram that the table holds:
S(w | context) = count(context w) / count(context), times `backoff` for each shorter gram; at last count(w) / words. Logarithms are
summed per document. Counts are over all documents and every n-gram counts, those that occur once too, unless `least` asks to prune.
With leave_out a document's own occurrences are taken from the counts before it is scored, exactly: what the rest of the corpus
says of it. A frequent gram has one request in a block, however many documents hold it, so no bucket of the table grows with a word's
frequency; blocks are bounded by their words, buckets by their bytes, and both are as many as the input asks for.

Grams are known by 64-bit hashes that are not verified: two that share one share a count. Of n distinct grams some n * n / 2^65 pairs
do: none is likely below a billion grams, and of 10^13 (some 100 TB) a millionth part is touched.

Defined results: null, empty and wordless texts have no words, log_score 0 and null mean and perplexity; rows that repeat are counted and scored
each (each leaves out itself alone); a null id is carried; an id that is no integer is an error; an empty table gives an empty result; other
columns are ignored. The documents are read twice and must come in the same order both times, as from a table; if they do not, the job
fails with a RuntimeError and gives no scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.llm import common

ORDER, BACKOFF, LEAST = 3, 0.4, 1
#: Words of a block, and bytes of text for each bucket of the count table.
BLOCK_WORDS, BUCKET_BYTES = 2_000_000, 16 << 20
_CACHE = 300_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_known: dict[bytes, int] = {}


def words(text: str) -> list[bytes]:
    return text.encode().translate(common.WORDS).split()


def word_hashes(docs: list[list[bytes]]) -> np.ndarray:
    if len(_known) > _CACHE:
        _known.clear()
    for w in set().union(*docs).difference(_known) if docs else ():
        _known[w] = xxhash.xxh3_64_intdigest(w)
    get = _known.__getitem__
    return np.fromiter((get(w) for d in docs for w in d), dtype=np.uint64, count=sum(map(len, docs)))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * _MIX[0] + b
    x = (x ^ (x >> np.uint64(32))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the gram that ends at each word; grams exist where place (in its document) >= n - 1."""
    out = [_mix(h, np.full(len(h), 1, dtype=np.uint64))]
    for n in range(2, order + 1):
        prev = np.concatenate((np.zeros(1, dtype=np.uint64), out[-1][:-1])) if len(h) else out[-1]
        out.append(_mix(prev + np.uint64(n), h))
    return out


def places(docs: list[list[bytes]]) -> np.ndarray:
    """Each word's place in its document."""
    return _places(np.array([len(d) for d in docs], dtype=np.int64))


def _places(sizes: np.ndarray) -> np.ndarray:
    return (np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)


def packed(g: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted hashes as differences and counts, each by byte planes: the shuffle's compression then finds the zeros."""
    d = np.diff(g, prepend=np.uint64(0)).astype("<u8")
    return d.view(np.uint8).reshape(-1, 8).T.tobytes(), _planes(n)


def unpacked(g: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    d = np.ascontiguousarray(np.frombuffer(g, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(d, dtype=np.uint64), _from_planes(n)


def _bucket(g: np.ndarray, buckets: int) -> np.ndarray:
    """The range of the hash that a gram is in."""
    return ((g >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str]]]:
    """(block, ids, texts) of about BLOCK_WORDS words. A block is named by its contents: both relations that are made of blocks name
    it alike wherever their tasks run, and _score() refuses texts whose block never asked."""
    ids, texts, size = [], [], 0

    def block() -> tuple[int, list, list[str]]:
        h = xxhash.xxh3_64(np.array([-1 if i is None else i for i in ids], dtype=np.int64).tobytes())
        for t in texts:
            h.update(t.encode())
        return common.signed(h.intdigest()), ids, texts

    for whole in batches:
        for b in common.steps(whole):
            ids += b.column(0).to_pylist()
            texts += (mine := b.column(1).to_pylist())
            size += sum(map(len, mine)) // 6
            if size >= BLOCK_WORDS:
                yield block()
                ids, texts, size = [], [], 0
    if ids:
        yield block()


def _requests(order: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in _blocks(batches):
            parts = []
            for at in range(0, len(texts), 500):
                docs = [words(t) for t in texts[at : at + 500]]
                place = places(docs)
                parts += [g[place >= n] for n, g in enumerate(grams(word_hashes(docs), place, order))]
            g = np.concatenate(parts)
            del parts
            g.sort()
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(g)), dtype=bool), g[1:] != g[:-1])))
            n, g = np.diff(first, append=len(g)), g[first]
            cuts = np.searchsorted(_bucket(g, buckets), np.arange(buckets + 1))
            home = block % buckets  # this bucket is asked even if for nothing: its reply says that the block asked
            for k in range(buckets):
                if cuts[k + 1] > cuts[k] or k == home:
                    x, y = packed(g[cuts[k] : cuts[k + 1]], n[cuts[k] : cuts[k + 1]])
                    yield pa.record_batch([pa.array([k], pa.int32()), pa.array([block], pa.int64()), pa.array([x], pa.binary()), pa.array([y], pa.binary())], ["bucket", "block", "grams", "counts"])

    return run


def _planes(n: np.ndarray) -> bytes:
    """Counts of 32 bits where all fit, else of 64; the first byte is their width."""
    width = 8 if len(n) and int(n.max()) >> 32 else 4
    return bytes([width]) + n.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    width = data[0]
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8, offset=1).reshape(width, -1).T).view(f"<u{width}").ravel()


def _answer(least: int) -> Callable:
    """Over the rows of one bucket: sum, prune (to 0) and reply, in the order of each block's own grams."""

    def answers(bucket: int, held: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        table, at = np.unique(np.concatenate([x[1] for x in held]), return_inverse=True)
        total = np.bincount(at, np.concatenate([x[2] for x in held]), minlength=len(table)).astype(np.int64)
        total = np.where(total >= least, total, 0)
        start = 0
        for block, g, _ in held:
            count = total[at[start : start + len(g)]]
            start += len(g)
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([_planes(count)], pa.binary())], ["block", "part", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for bucket, block, g, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(bucket, []).append((block, *unpacked(g, n)))
        for bucket in sorted(held):  # one, as a bucket is a partition; more if Spark puts small partitions together
            yield from answers(bucket, held.pop(bucket))

    return run


def _texts(buckets: int) -> Callable:
    """A block's documents, in compressed packs that are numbered after its replies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in _blocks(batches):
            part, at = buckets, 0
            while at < len(ids):
                size, end = 0, at
                while end < len(ids) and (size < 1 << 20 or end == at):
                    size += len(texts[end])
                    end += 1
                rows = pa.record_batch([pa.array(ids[at:end], pa.int64()), pa.array(texts[at:end], pa.string())], ["i", "t"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as w:
                    w.write_batch(rows)
                yield pa.record_batch([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([zlib.compress(sink.getvalue(), 3)], pa.binary())], ["block", "part", "data"])
                part, at = part + 1, end

    return run


def scores(sizes: np.ndarray, place: np.ndarray, counts: list[np.ndarray], total: np.ndarray | int, backoff: float, least: int) -> np.ndarray:
    """Sum of log S over each document's words, from the counts of the grams that end at each word (0 where there are none). A word
    that no count knows is taken to occur once."""
    order = len(counts)
    s = np.log(np.maximum(counts[0], 1)) - np.log(np.maximum(total, 1)) + (order - 1) * math.log(backoff)
    for n in range(2, order + 1):
        c, before = counts[n - 1], counts[n - 2]
        at = np.flatnonzero((place >= n - 1) & (c >= least))
        s[at] = np.log(c[at]) - np.log(np.maximum(before[at - 1], 1)) + (order - n) * math.log(backoff)
    out, full = np.zeros(len(sizes)), sizes > 0
    if len(s):
        out[full] = np.add.reduceat(s, (np.cumsum(sizes) - sizes)[full])
    return out


def own_counts(at: np.ndarray, doc: np.ndarray, kinds: int) -> np.ndarray:
    """How often the gram at each place occurs in its own document. at: a number below `kinds` for each gram."""
    both = doc.astype(np.int64) * kinds + at
    by = np.argsort(both, kind="stable")
    first = np.flatnonzero(np.diff(both[by], prepend=-1))
    n = np.diff(first, append=len(both))
    out = np.empty(len(both), dtype=np.int64)
    out[by] = np.repeat(n, n)
    return out


def _score(order: int, backoff: float, least: int, total: int, buckets: int, leave_out: bool) -> Callable:
    """Over rows sorted by block and part: a block's replies in order of bucket, then its texts."""

    def close(replies: dict[int, bytes], packs: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, hashes, sizes = [], [], []
        for data in packs:
            rows = pa.ipc.open_stream(zlib.decompress(data)).read_all().combine_chunks()
            docs = [words(t) for t in rows.column("t").to_pylist()]
            hashes.append(word_hashes(docs))
            sizes.append(np.array([len(d) for d in docs], dtype=np.int64))
            ids.append(rows.column("i").combine_chunks())
        size = np.concatenate(sizes)
        place = _places(size)
        g = grams(np.concatenate(hashes), place, order)
        del hashes
        some = [np.flatnonzero(place >= n) for n in range(order)]
        # one sort finds every gram's place among the block's own: far faster than a search for each
        keys, at = np.unique(np.concatenate([x[m] for x, m in zip(g, some, strict=True)]), return_inverse=True)
        del g
        # buckets are ranges of the hash: their replies in order are the counts of the sorted grams
        values = np.concatenate([_from_planes(replies[k]) for k in sorted(replies)]) if replies else None
        if values is None or len(values) != len(keys):
            raise RuntimeError("the documents came in another order when read again: write them to a table first")
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        counts, less, start = [], [], 0
        for m in some:
            mine = at[start : (start := start + len(m))]
            c = np.zeros(len(place), dtype=values.dtype)
            c[m] = values[mine]
            counts.append(c)
            if leave_out:
                rest = c.astype(np.int64)
                rest[m] -= own_counts(mine, doc[m], len(keys))
                less.append(rest)
        del at, keys
        results = [scores(size, place, counts, total, backoff, least)]
        if leave_out:
            results.append(scores(size, place, less, total - size[doc], backoff, max(1, least)))
        start = 0
        for i in ids:
            yield pa.record_batch([i, pa.array(size[start : start + len(i)]), *(pa.array(x[start : start + len(i)]) for x in results)], ["doc_id", "n_tokens", "log_score", "left_out_log_score"][: 2 + len(results)])
            start += len(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, replies, packs = None, {}, []
        for b in batches:
            for block, part, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != now and packs:
                    yield from close(replies, packs)
                if block != now:
                    now, replies, packs = block, {}, []
                if part < buckets:
                    replies[part] = data
                else:
                    packs.append(data)
        if packs:
            yield from close(replies, packs)

    return run


def _size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        yield pa.record_batch([pa.array([sum(len(words(t)) for t in texts)]), pa.array([sum(map(len, texts))])], ["words", "bytes"])


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST, leave_out: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, log_score (natural, summed), mean_log_score, perplexity; with leave_out also left_out_log_score,
    by the counts without the document's own occurrences."""
    spark = df.sparkSession
    common.ship(spark)
    docs = common.texts(df, id_col, text_col)
    size = docs.mapInArrow(_size, "words long, bytes long").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    cores = spark.sparkContext.defaultParallelism
    buckets = max(cores, -(-size.bytes // BUCKET_BYTES))
    asked = docs.mapInArrow(_requests(order, buckets), "bucket int, block long, grams binary, counts binary")
    replies = asked.repartitionById(buckets, F.col("bucket")).mapInArrow(_answer(least), "block long, part int, data binary")
    packs = docs.mapInArrow(_texts(buckets), "block long, part int, data binary")
    together = replies.unionByName(packs).repartition(max(cores, -(-size.words // BLOCK_WORDS)), "block").sortWithinPartitions("block", "part")
    kinds = "doc_id long, n_tokens long, log_score double" + (", left_out_log_score double" if leave_out else "")
    out = together.mapInArrow(_score(order, backoff, least, size.words, buckets, leave_out), kinds)
    mean = F.try_divide("log_score", "n_tokens")
    return out.withColumn("mean_log_score", mean).withColumn("perplexity", F.exp(-mean))
