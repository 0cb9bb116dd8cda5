"""Secret scans by grammar inference.

From labelled credentials one probabilistic automaton is inferred for each format: a prefix tree whose
statistically compatible states are merged. Automata of labelled ordinary strings (words, paths, names) are the alternatives. Every run of
token characters in a text, however short, is a candidate and is scored; it is a secret if its most likely format explains it better than
the likeliest alternative by a margin that grows with its length. The fixed patterns below come first, and their spans always stay;
inferred spans are added where they overlap none of them.

Labels come from two places. What the fixed patterns find in documents outside the held-out fold are credentials, and runs of letters there
are ordinary: a bounded sample of different strings, chosen by hash. Beside these stand strings drawn from documented formats and
from common kinds of names. A format has an automaton over character classes, and, if its strings share a beginning, one that knows
it letter by letter and is asked only about strings that begin so. So a candidate's score follows from its classes
and its beginning, and is computed once for each of these.

Texts are scanned whole, in one narrow pass after the one that gathers labels; what is shuffled is the sample. The automata are small and of
fixed size.

Defined results: null and empty texts have no spans; rows that repeat or have null ids are scanned like others, and nothing is learnt
from null ids; an id that is no integer is an error; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import random
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmend.llm import common
from cellmend.llm.automata import Automaton

KINDS = ("assign", "access", "hex", "inferred")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A candidate of the method, in a text or in its classes: '0' a digit, 'a' and 'A' a letter, other signs themselves.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
_CLASSES = str.maketrans({c: "0" if c.isdigit() else "a" if c.islower() else "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"})
#: Nats by which a format must beat the alternative: in all, and for each character.
MARGIN, MARGIN_EACH = 8.0, 0.25
#: Different credentials and ordinary strings of the corpus that are learnt from, and the longest of them.
SAMPLE, SAMPLE_CHARS = 2000, 200
_HEX_RUN = b"x" * 24
_HEX_MAP = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))

_UP, _LOW, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Publicly documented credential formats: name, then parts that are literal text or (characters, least, most).
FORMATS = {
    "cloud access id": ["AKIA", (_UP + _DIGIT, 16, 16)],
    "code host token": ["ghp_", (_UP + _LOW + _DIGIT, 36, 36)],
    "code host token, fine": ["github_pat_", (_UP + _LOW + _DIGIT, 22, 22), "_", (_UP + _LOW + _DIGIT, 59, 59)],
    "chat bot token": ["xoxb-", (_DIGIT, 10, 12), "-", (_DIGIT, 10, 12), "-", (_UP + _LOW + _DIGIT, 24, 24)],
    "payment key": ["sk_live_", (_UP + _LOW + _DIGIT, 24, 24)],
    "maps key": ["AIza", (_UP + _LOW + _DIGIT + "-_", 35, 35)],
    "web token": ["eyJ", (_UP + _LOW + _DIGIT, 20, 40), ".eyJ", (_UP + _LOW + _DIGIT, 30, 60), ".", (_UP + _LOW + _DIGIT + "-_", 40, 43)],
    "hex digest": [(_DIGIT + "abcdef", 32, 40)],
    "random key": [(_UP + _LOW + _DIGIT, 12, 40)],
    "base64 key": [(_UP + _LOW + _DIGIT + "+/", 42, 43), "="],
}
_SYLLABLES = "an er in on re th ti es or en at ed nd to it is ar te se ha le me de ion ing ent tion ment sch ung".split()


def labelled_credentials(n: int = 200, seed: int = 11) -> list[tuple[str, str]]:
    """(format, string): n drawn strings of each documented format."""
    rng = random.Random(seed)
    return [(name, "".join(p if isinstance(p, str) else "".join(rng.choices(p[0], k=rng.randint(p[1], p[2]))) for p in parts)) for name, parts in FORMATS.items() for _ in range(n)]


def labelled_ordinary(n: int = 200, seed: int = 12) -> list[tuple[str, str]]:
    """(kind, string): n long strings each of token characters that are no secrets: words, names, paths, numbers, dates, rules."""
    rng = random.Random(seed)
    word = lambda a=2, b=4: "".join(rng.choices(_SYLLABLES, k=rng.randint(a, b)))
    kinds = {
        "word": lambda: word(6, 14), "capitals": lambda: word(6, 14).upper(), "title": lambda: word(6, 14).capitalize(),
        "hyphens": lambda: "-".join(word() for _ in range(rng.randint(3, 6))), "snake": lambda: "_".join(word() for _ in range(rng.randint(3, 6))),
        "camel": lambda: "".join(word().capitalize() for _ in range(4)), "path": lambda: "/".join(word() for _ in range(rng.randint(3, 6))),
        "file": lambda: f"/{word()}/{word()}/{word()}{rng.randint(1, 999)}.html", "host": lambda: f"www.{word()}.{word()}.com/{word()}/{rng.randint(1, 999)}",
        "time": lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}", "number": lambda: "".join(rng.choices(_DIGIT, k=rng.randint(16, 24))),
        "rule": lambda: rng.choice("=-_.") * rng.randint(16, 60), "sentences": lambda: f"{word(3, 6)}.{word(3, 6).capitalize()}", "version": lambda: f"{word(3, 5)}-{rng.randint(1, 99)}.{rng.randint(1, 9)}.{word()}",
        "listed": lambda: f"{word(3, 6)}={word(3, 6)}", "numbered": lambda: f"{word(3, 6)}{rng.randint(1, 9999)}",
        "uuid": lambda: "-".join("".join(rng.choices(_DIGIT + "abcdef", k=n)) for n in (8, 4, 4, 4, 12)), "product": lambda: f"{word(1, 2).upper()}-{rng.randint(1, 99999)}",
        "identifier": lambda: "".join(rng.choice((word(1, 3).capitalize(), word(1, 3).capitalize(), "A", "Is")) for _ in range(rng.randint(2, 8))) + rng.choice(("", str(rng.randint(1, 99)))),
        "camel, low": lambda: word(1, 2) + "".join(word(1, 3).capitalize() for _ in range(rng.randint(1, 5))) + rng.choice(("", "", str(rng.randint(1, 999)))),
        "address": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "phone": lambda: "-".join("".join(rng.choices(_DIGIT, k=n)) for n in (3, 3, 4)[rng.randint(0, 1) :]),
        "decimal": lambda: f"{rng.randint(0, 99999)}.{rng.randint(0, 999999)}", "code": lambda: f"{rng.choice('ABCDEFGHKLMNPRS')}{rng.randint(1, 999)}{rng.choice(('', 'a', 'X', '-' + str(rng.randint(1, 99))))}",
        "constant": lambda: "_".join(word(1, 2).upper() for _ in range(rng.randint(2, 5))), "slug": lambda: f"{rng.randint(1990, 2030)}/{rng.randint(1, 12)}/" + "-".join(word(1, 2) for _ in range(rng.randint(2, 6))),
    }
    return [(name, draw()) for name, draw in kinds.items() for _ in range(n)]


def _by_label(labelled: list[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name, x in labelled:
        out.setdefault(name, []).append(x)
    return out


class Scorer:
    def __init__(self, credentials: list[tuple[str, str]], ordinary: list[tuple[str, str]]):
        by_format = _by_label(credentials)
        self.formats = [Automaton([x.translate(_CLASSES) for x in xs], 0) for xs in by_format.values()]
        self.ordinary = [Automaton([x.translate(_CLASSES) for x in xs], 0) for xs in _by_label(ordinary).values()]
        # formats whose strings share their beginning are known by it
        shared = {name: os.path.commonprefix(xs) for name, xs in by_format.items()}
        self.begun = [(shared[name], Automaton(xs, len(shared[name]))) for name, xs in by_format.items() if len(shared[name]) >= 3]
        self.seen: dict[tuple[str, int], bool] = {}

    def margin(self, text: str) -> float:
        classes = text.translate(_CLASSES)
        formats = [a.log_likelihood(classes) for a in self.formats] + [a.log_likelihood(text) for p, a in self.begun if text.startswith(p)]
        return max(formats, default=float("-inf")) - max((a.log_likelihood(classes) for a in self.ordinary), default=float("-inf"))

    def _least(self, text: str) -> float:
        return max(MARGIN, MARGIN_EACH * len(text))

    def by_class(self, classes: str) -> bool:
        """Whether any text of these classes is a secret, whatever it begins with."""
        if classes not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[classes] = self.margin(classes) >= self._least(classes)
        return self.seen[classes]

    def secret(self, text: str) -> bool:
        if self.by_class(text.translate(_CLASSES)):
            return True
        return any(text.startswith(p) for p, _ in self.begun) and self.margin(text) >= self._least(text)

    def nothing_in(self, text: str) -> bool:
        """Quickly: no candidate of the text is a secret. Each is scored by its classes; beginnings are looked for in the whole text."""
        kinds = {x.strip(".") for x in {*CANDIDATE.findall(text.translate(_CLASSES))}}
        return not any(map(self.by_class, kinds)) and not any(p in text for p, _ in self.begun)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}


@functools.cache
def default_scorer() -> Scorer:
    """From drawn strings alone."""
    return Scorer(labelled_credentials(), labelled_ordinary())


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, string): what the fixed patterns find, and a part of the runs of letters, the same ones everywhere."""
    for whole in batches:
        for b in common.steps(whole):
            good, bad = set(), set()
            for text in b.column(1).to_pylist():
                spans = base_spans(text)
                for a, z, kind in spans:
                    x = text[a:z]
                    bad.add(ASSIGN.fullmatch(x)[2] if kind == "assign" else x)
                if not spans:
                    good.update(w for w in {*text.split()} if w.isalpha() and w.isascii() and zlib.crc32(w.encode()) % 64 == 0)
            rows = [("credential", x) for x in bad if len(x) <= SAMPLE_CHARS] + [("ordinary", x) for x in good if len(x) <= SAMPLE_CHARS]
            yield pa.record_batch([pa.array([x[k] for x in rows], pa.string()) for k in (0, 1)], ["label", "string"])


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Scorer:
    """From at most `sample` credentials and as many ordinary strings of documents that are not held out, beside drawn ones."""
    docs = common.texts(df, id_col, text_col).where(F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id")))
    found = common.save(docs.mapInArrow(_labels, "label string, string string").distinct(), "strings")
    some = lambda label: [("found", r.string) for r in common.bounded_sample(found.where(F.col("label") == label), "string", sample).collect()]
    scorer = Scorer(labelled_credentials() + some("credential"), labelled_ordinary() + some("ordinary"))
    common.drop_saved(found)
    return scorer


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns; leftmost, non-overlapping for each kind; sorted by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _HEX_RUN in text.encode().translate(_HEX_MAP):
        out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def inferred_spans(text: str, base: list[tuple[int, int, str]], scorer: Scorer) -> list[tuple[int, int, str]]:
    if scorer.nothing_in(text):
        return []
    out = []
    for m in CANDIDATE.finditer(text):
        start, x = m.start(), m[0]
        start += len(x) - len(x.lstrip("."))
        x = x.strip(".")
        if scorer.secret(x) and all(b <= start or a >= start + len(x) for a, b, _ in base):
            out.append((start, start + len(x), "inferred"))
    return out


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _scan(scorer) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer.value
        for whole in batches:
            for b in common.steps(whole):
                rows = []
                for text in b.column(1).to_pylist():
                    base = base_spans(text)
                    more = sorted(base + inferred_spans(text, base, s), key=lambda x: (x[0], KINDS.index(x[2])))
                    n = [sum(x[2] == k for x in base) for k in KINDS[:3]]
                    rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(more)))
                cols = zip(*rows, strict=True)
                kinds = [pa.int64()] * 3 + [pa.string()] * 2
                yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scorer: Scorer | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined, in code points)."""
    spark = df.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(scorer or learn(df, id_col, text_col))
    return common.texts(df, id_col, text_col).mapInArrow(_scan(shared), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: Column | str, spans: Column | str, mask: str = "[secret]") -> Column:
    """text with every span of find_secrets() masked; overlapping spans mask once."""
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    bounds = F.transform(F.filter(F.split(spans, ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("a"), F.split(x, ":")[2].cast("int").alias("b")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.when(x.a < s.at, F.struct(s.out.alias("out"), F.greatest(s.at, x.b).alias("at"))).otherwise(
        F.struct(F.concat(s.out, F.substr(text, s.at + 1, x.a - s.at), F.lit(mask)).alias("out"), x.b.alias("at")))
    return F.aggregate(bounds, start, step, lambda s: F.concat(s.out, F.substr(text, s.at + 1, F.length(text) - s.at)))
