"""Best-fit packing of token sequences, after Martello and Toth's dominance reduction.

Pieces of one length are interchangeable, so the instance is the histogram of lengths: at most `capacity` numbers,
whatever the corpus. On it the driver fixes sets that provably dominate every other way to use their first
member (a piece that nothing fits beside; a pair that fills a sequence; the largest companion where only one fits, or
where it is no smaller than any two; a triple where at most two fit and no other two are larger), as
often as their members last, until nothing more can be fixed; best-fit decreasing places the rest, again by length.
Pieces then take their places by rank within their length: ranks come from counts per task and a running sum over
tasks, so no task ever holds all pieces of a length.

Tokens are those of the given `tokenizers` file. A text is cut before single spaces between words, where its pre-tokenizer always
cuts, and a part that a worker remembers is not encoded again; texts with other white space around a space are encoded whole.

Defined results: null and empty texts are the end mark alone; rows that repeat are packed as often as they occur; a null id is
carried; an id that is no integer is an error; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmend.llm import common

CAPACITY, END = 2048, 0
TOKENIZER = "byte_bpe_50k.json"
#: Word parts that a Python worker remembers.
CACHE = 400_000
_UNSURE = re.compile(r"\s | \s|^ | $")
_ENCODERS: dict[str, Encoder] = {}


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(other)}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The ids are those of the `tokenizers` file. Where the file is a byte-level BPE whose ids follow its merges, tiktoken reads the same
    vocabulary and pattern and finds the same ids several times faster; a probe checks that both agree before it is used.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    PROBE = " The quick—brown fox's 12345 jumps\n\n  over\tthe été größe niño 日本語 lazy_dog!!! $$$ xqzvwk 'll don't ... <|endoftext|> é"

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.exists(name):
            import public_tokenizers

            name = str(public_tokenizers.path(name))
        self.tokenizer = Tokenizer.from_file(name)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.fast = self._fast()
        if self.fast and self.fast.encode_ordinary(self.PROBE) != self.tokenizer.encode(self.PROBE, add_special_tokens=False).ids:
            self.fast = None

    def _fast(self):
        spec = json.loads(self.tokenizer.to_str())
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
            return None
        import tiktoken

        byte_of, special = _byte_of(), {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): k for t, k in model["vocab"].items() if t not in special}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = [model["vocab"][t] for t in merged]
        if len(ranks) < 256 or order != sorted(order):
            return None
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for t, k in ranks.items():
            self.size[k] = len(t)
        return tiktoken.Encoding("same", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def of(name: str) -> Encoder:
        if name not in _ENCODERS:
            _ENCODERS[name] = Encoder(name)
        return _ENCODERS[name]

    def whole(self, texts: list[str]) -> list[bytes]:
        if self.fast:
            return [np.array(self.fast.encode_ordinary(t), dtype="<u4").tobytes() for t in texts]
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part with the space before it."""
        if not self.fast:
            return self.whole([" " + p for p in parts])
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(parts)), dtype="<u4")  # no token reaches over a part's end
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(p.encode()) + 1 for p in parts])) + 1
        data, out, at = ids.tobytes(), [], 0
        for e in (4 * ends).tolist():
            out.append(data[at:e])
            at = e
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        unsure = [k for k, t in enumerate(texts) if _UNSURE.search(t)]
        for k, ids in zip(unsure, self.whole([texts[k] for k in unsure]), strict=True):
            out[k] = ids
        sure = sorted({*range(len(texts))} - {*unsure})
        parts = [texts[k].split(" ") for k in sure]
        need = set().union(*(p[1:] for p in parts)) if parts else set()
        new = list(need.difference(self.known))
        if len(self.known) + len(new) > CACHE:
            self.known = {p: self.known[p] for p in need.intersection(self.known)}  # what is in use stays
        for a in range(0, len(new), 10_000):
            self.known.update(zip(new[a : a + 10_000], self.parts(new[a : a + 10_000]), strict=True))
        first = self.whole([p[0] for p in parts])
        get = self.known.__getitem__
        for k, p, f in zip(sure, parts, first, strict=True):
            out[k] = f + b"".join(map(get, p[1:]))
        return out


def _pieces(tokenizer: str, capacity: int, end: int) -> Callable:
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for whole in batches:
            for b in common.steps(whole, limit=2 << 20):
                rows = []
                for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    start, stop, piece = 0, n % capacity or capacity, 0
                    while start < n:
                        rows.append((doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), part, int(seen[stop - start])))
                        seen[stop - start] += 1
                        start, stop, piece = stop, stop + capacity, piece + 1
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


@dataclass
class Bins:
    """`copies` sequences of one content: (length, how many of it), in the order in which they stand."""

    content: list[tuple[int, int]]
    copies: int


def reduce_instance(n: Counter[int], capacity: int) -> list[Bins]:
    """Fixes dominating sets; takes their members out of n."""
    fixed: list[Bins] = []

    def fix(*lengths: int) -> None:
        need = Counter(lengths)
        k = min(n[x] // m for x, m in need.items())
        fixed.append(Bins(sorted(need.items(), reverse=True), k))
        for x, m in need.items():
            n[x] -= m * k
            if not n[x]:
                del n[x]

    def others(a: int) -> list[int]:
        return sorted(x for x in n if x != a or n[x] > 1)

    def largest(present: list[int], room: int) -> int:
        k = bisect.bisect_right(present, room)
        return present[k - 1] if k else 0

    def least(count: int, a: int, above: int = 0) -> int | None:
        """Sum of the `count` least pieces over `above`, besides one a."""
        out = 0
        for x in sorted(n):
            if x > above:
                m = min(count, n[x] - (x == a))
                out, count = out + m * x, count - m
                if not count:
                    return out
        return None

    def dominating(a: int) -> tuple[int, ...] | None:
        room, present = capacity - a, others(a)
        b = largest(present, room)
        if not b:
            return (a,)
        two = least(2, a)
        if a + b == capacity or two is None or two > room:
            return a, b
        three = least(3, a)
        if three is not None and three <= room:
            return None
        # at most two fit beside a
        best, y = 0, 0
        for x in present:
            left = [z for z in present if z <= room - x and (z not in (x, a) or n[z] > (z == x) + (z == a))]
            if left:
                best = max(best, x + left[-1])
                if x == b:
                    y = left[-1]
        if b >= best:
            return a, b
        if y:
            over = least(2, a, y)  # two pieces that are both larger than y
            if over is None or over > room:
                return a, b, y
        return None

    again = True
    while again and n:
        again = False
        for a in sorted(n, reverse=True):
            while n.get(a) and (s := dominating(a)):
                fix(*s)
                again = True
    return fixed


def best_fit(n: Counter[int], capacity: int) -> list[Bins]:
    """Best-fit decreasing, all pieces of a length at once."""
    open_: dict[int, list[Bins]] = {}  # by room left
    rooms: list[int] = []

    def put(room: int, bins: Bins) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append(bins)

    for length in sorted(n, reverse=True):
        left = n[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                put(capacity, Bins([], left))  # empty sequences, as many as are needed at most
                k = len(rooms) - 1
            room = rooms[k]
            bins = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[k]
            each = min(room // length, left)
            full = min(bins.copies, left // each)
            put(room - each * length, Bins([*bins.content, (length, each)], full))
            left -= full * each
            rest = bins.copies - full
            if rest and bins.content:
                put(room, Bins(bins.content, rest))
    return [b for group in open_.values() for b in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    n = Counter(histogram)
    return reduce_instance(n, capacity) + best_fit(n, capacity)


def places(bins: list[Bins]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset) by length and rank: where the pieces of each rank go."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for b in bins:
        offset = 0
        for length, each in b.content:
            rows.append((length, used[length], b.copies, sequence, offset))
            used[length] += each * b.copies
            offset += each * length
        sequence += b.copies
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _place(table) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = t[:, 0] * (1 << 50) + t[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            r = t[np.searchsorted(key, length * (1 << 50) + rank, side="right") - 1]
            k = rank - r[:, 1]
            yield pa.record_batch([*b.columns[:5], pa.array(r[:, 3] + k % r[:, 2]), pa.array(r[:, 4] + k // r[:, 2] * length)],
                                  ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    common.ship(spark)
    docs = common.texts(df, id_col, text_col)
    cut = docs.mapInArrow(_pieces(tokenizer, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")
    pieces = common.save(cut, "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = common.save(counts.select("length", "part", "n", before.alias("before")), "ranks")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    # counts grow with the tasks: they are merged, whatever their files' size suggests
    ranked = pieces.join(counts.hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_place(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
