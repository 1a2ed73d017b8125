"""Secret scan: fixed patterns, and a randomness battery under false-discovery control.

Patterns give the base spans (assignments, access keys, hex strings).  Besides,
every run of token characters of ``SHORTEST`` or more is tested.  Its encoding is
the smallest alphabet that holds it.  The battery is: chi-squared uniformity of
the alphabet, character by character and with cells pooled (vowels, consonants
that words are rich in, the other letters, digits, marks), which short runs need;
runs of its kinds of characters (digits, small letters, capitals, others; low and
high ranks where there is one kind only) and of vowels and other characters; and
serial correlation of ranks at lag one.

What the five statistics are like at an encoding and length is simulated for both
classes (:func:`model_of`): random strings, and words as identifiers, paths and
compounds join them.  A run must not be implausible as a random string (``ALPHA``);
its p-value is the chance that words come as near to random strings, by the ratio
of the two likelihoods, whose upper tail is taken as exponential.  A run longer
than ``PIECE`` is cut into equal pieces, all tested; its p-value is the largest,
which is valid whatever the pieces are.  The p-values of all candidates of a
document form a family: Benjamini and Hochberg's procedure at ``RATE``, with
weights in proportion to length, decides which are secrets.

Defined cases: null and empty texts have no spans; offsets count code points,
ends exclusive; found secrets that touch a base span are not reported again; ties
in p-values go to the earlier span; repeated rows give equal results; rows with a
null id keep it; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import slices, small_batches, strings

#: Shortest run that is tested, rate of false discoveries, share of random strings given up as implausible.
SHORTEST, RATE, ALPHA = 20, 0.005, 0.01
#: Longest piece that is tested as one, simulated strings of each class, letters of the stream of words.
PIECE, SIMULATED, STREAM = 256, 4000, 120_000

KINDS = ("assign", "access", "hex", "random")
_assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_run = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+={0,2}" % SHORTEST)
_words = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Encodings by rising alphabet.
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "UPPER": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
_sets = {k: frozenset(v) for k, v in ALPHABETS.items()}
_ranks = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


VOWELS = frozenset("aeiouAEIOU")
_several = {k: len(set(map(_kind, v))) > 1 for k, v in ALPHABETS.items()}
#: Of each rank: the kind of character, and whether it is a vowel.
_kinds = {k: np.array([_kind(c) if _several[k] else int(2 * i >= len(v)) for i, c in enumerate(v)]) for k, v in ALPHABETS.items()}
_vowels = {k: np.array([int(c in VOWELS) for c in v]) for k, v in ALPHABETS.items()}


def _pool(c: str) -> int:
    return 3 if c.isdigit() else 4 if not c.isalpha() else 0 if c in VOWELS else 1 if c.lower() in "tnsrhldcm" else 2


_pools = {k: np.array(list(map(_pool, v))) if any(map(str.isalpha, v)) else _kinds[k] for k, v in ALPHABETS.items()}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    base: bool
    encoding: str | None = None
    p_value: float | None = None


def base_spans(text: str) -> list[Span]:
    found = []
    low = text.lower()
    if any(w in low for w in _words) or not text.isascii():
        found += [Span("assign", *m.span(), True) for m in _assign.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [Span("access", *m.span(), True) for m in _access.finditer(text) if m.end() - m.start() >= 20]
    found += [Span("hex", *m.span(), True) for m in _hex.finditer(text)]
    return found


def encoding_of(run: str) -> str:
    chars = frozenset(run)
    return next((k for k, v in _sets.items() if chars <= v), "mixed")


def _changes(marks: np.ndarray, of_ranks: np.ndarray) -> np.ndarray:
    """Standard score of the number of changes of mark along each row."""
    steps = marks.shape[1] - 1
    stay = float(((np.bincount(of_ranks) / len(of_ranks)) ** 2).sum())
    if stay == 1:
        return np.zeros(len(marks))
    return ((marks[:, 1:] != marks[:, :-1]).sum(1) - steps * (1 - stay)) / math.sqrt(steps * stay * (1 - stay))


def battery(ranks: np.ndarray, encoding: str) -> np.ndarray:
    """Scores of each row (a string as ranks in its alphabet): uniformity and runs of
    kinds, runs of vowels, serial correlation (about 0 and 1 wide for random strings),
    and the root of the pooled cells' chi-squared."""
    rows, n = ranks.shape
    size = len(ALPHABETS[encoding])
    counts = np.bincount((ranks + size * np.arange(rows)[:, None]).ravel(), minlength=rows * size).reshape(rows, size)
    uniform = ((counts.astype(float) ** 2).sum(1) * size / n - n - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    off = ranks - ranks.mean(1, keepdims=True)
    power = (off**2).sum(1)
    serial = np.where(power > 0, (off[:, 1:] * off[:, :-1]).sum(1) / np.maximum(power, 1e-9), 1.0) * math.sqrt(n)
    kinds, vowels, pools = _kinds[encoding], _vowels[encoding], _pools[encoding]
    expected = np.bincount(pools) * n / size
    pooled = sum(((pools[ranks] == k).sum(1) - e) ** 2 / e for k, e in enumerate(expected) if e)
    return np.stack([uniform, _changes(kinds[ranks], kinds), _changes(vowels[ranks], vowels), serial, np.sqrt(pooled)], 1)


#: Words that identifiers, paths and compounds are made of.
VOCABULARY = (
    "the and for with this that from have not you all can will one what time which their other about into over after first also people than most only state through "
    "get set is to of by in on at new old add remove update create delete index value key name list item user account order price total count number size length width "
    "file path folder config option setting server client request response message error warning status session token cache buffer stream thread queue event handler "
    "http www com org html json xml utf test build release version module package library source target string object array table column query filter result report "
    "und der die das nicht eine gesellschaft schiff fahrt versicherung verordnung strasse entwicklung wirtschaft kraft werk zeug donau dampf rechts schutz grund "
    "que los una para como pero desarrollo trabajo numero cuenta persona gobierno nous vous avec dans pour sont etre gouvernement travail compte entreprise "
    "strength rhythm school church night light world house water great small between system program language international information administration"
).split()


def plain_number(r: random.Random) -> str:
    """Digits that are not random: dates, times, counters, round and repeated numbers."""
    return r.choice([
        lambda: f"{r.randint(1990, 2030)}{r.randint(1, 12):02}{r.randint(1, 28):02}", lambda: f"{r.randrange(24):02}{r.randrange(60):02}{r.randrange(60):02}", lambda: str(r.randint(1990, 2030)),
        lambda: f"{r.randrange(1000):08}", lambda: str(r.randint(1, 99)) + "0" * r.randint(2, 6), lambda: r.choice("0123456789") * r.randint(2, 6), lambda: "01234567890123456789"[(k := r.randrange(10)) : k + r.randint(3, 9)],
    ])()


def word_like(encoding: str, letters: int = STREAM) -> tuple[str, list[int]]:
    """A long string of words and numbers in the alphabet, and where its parts begin."""
    r = random.Random(hashlib.sha256(encoding.encode()).digest())
    allowed = _sets[encoding]
    small, large, numbers = "a" in allowed and "z" in allowed, "A" in allowed and "Z" in allowed, "2" in allowed
    joints = [c for c in "-_/+" if c in allowed]
    out, starts, at = [], [], 0

    def put(part: str) -> None:
        nonlocal at
        part = "".join(c for c in part if c in allowed)
        if part:
            starts.append(at)
            out.append(part)
            at += len(part)

    while at < letters:
        style = r.choice(("flat", "camel", "joined", "joined") if joints else ("flat", "camel", "camel"))
        joint = r.choice(joints) if joints else ""
        numbered = 0.5 if encoding in ("hex", "HEX", "lower36", "base32") else 0.15
        for k in range(r.randint(2, 7)):
            word = r.choice(VOCABULARY)
            if r.random() < 0.04:  # letters without vowels, as in abbreviations
                word = "".join(c for c in word if c not in VOWELS) or word
            if not small or (large and style != "camel" and r.random() < 0.1):
                word = word.upper()
            elif large and style == "camel" and (k or r.random() < 0.5):
                word = word.capitalize()
            if small or large or r.random() < 0.3:
                put(word)
            if numbers and (r.random() < numbered or not (small or large)):
                put(plain_number(r) if r.random() < 0.5 or not (small or large) else str(r.randrange(100)))
            if style == "joined":
                put(joint)
    return "".join(out), starts


@functools.lru_cache(maxsize=None)
def _stream(encoding: str) -> tuple[np.ndarray, np.ndarray]:
    text, starts = word_like(encoding)
    rank = _ranks[encoding]
    return np.array([rank[c] for c in text]), np.array(starts)


@dataclass(frozen=True)
class Model:
    """Both classes of strings of one encoding and length: means and inverse
    covariances of the battery, and the tails that decide."""

    means: tuple[np.ndarray, np.ndarray]
    inverses: tuple[np.ndarray, np.ndarray]
    shift: float
    widest: float  # squared distance that ``ALPHA`` of the random strings exceed
    null: np.ndarray  # sorted ratios of words
    high: float  # their 95 % quantile, and how far beyond it the rest is on average
    excess: float

    def distance(self, x: np.ndarray, k: int) -> np.ndarray:
        off = x - self.means[k]
        return np.einsum("ij,jk,ik->i", off, self.inverses[k], off)

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Log of the likelihood as a random string over that as words."""
        return (self.distance(x, 1) - self.distance(x, 0)) / 2 + self.shift

    def p_value(self, x: np.ndarray) -> np.ndarray:
        """Chance of such a ratio for words; 1 for what is implausible as random."""
        got = self.ratio(x)
        p = np.where(got > self.high, 0.05 * np.exp(-np.maximum(got - self.high, 0) / self.excess), 1 - np.searchsorted(self.null, got) / len(self.null))
        return np.where(self.distance(x, 0) > self.widest, 1.0, np.maximum(p, 1e-300))


@functools.lru_cache(maxsize=None)
def model_of(encoding: str, length: int) -> Model:
    r = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{encoding}:{length}".encode()).digest()[:8], "big"))
    drawn = battery(r.integers(0, len(ALPHABETS[encoding]), (SIMULATED, length)), encoding)
    stream, starts = _stream(encoding)
    starts = starts[starts < len(stream) - length]
    words = battery(stream[r.choice(starts, SIMULATED)[:, None] + np.arange(length)], encoding)
    means = (drawn.mean(0), words.mean(0))
    spreads = tuple(np.cov(x.T) + 1e-3 * np.eye(x.shape[1]) for x in (drawn, words))
    inverses = tuple(np.linalg.inv(c) for c in spreads)
    shift = (np.linalg.slogdet(spreads[1])[1] - np.linalg.slogdet(spreads[0])[1]) / 2
    blank = Model(means, inverses, shift, 0.0, np.empty(0), 0.0, 1.0)
    null = np.sort(blank.ratio(words))
    high = float(np.quantile(null, 0.95))
    beyond = null[null > high] - high
    return Model(means, inverses, shift, float(np.quantile(blank.distance(drawn, 0), 1 - ALPHA)), null, high, float(beyond.mean()) if len(beyond) else 1.0)


def class_of(length: int) -> int:
    """Length at which a run's classes are simulated: the even one below, from 64 on the multiple of 8."""
    return length // 2 * 2 if length < 64 else length // 8 * 8


def p_value(run: str, encoding: str) -> float:
    """How likely words look so random."""
    rank = _ranks[encoding]
    ranks = np.array([rank[c] for c in run])
    worst = 0.0
    for piece in np.array_split(ranks, -(-len(ranks) // PIECE)):  # at least PIECE / 2 each
        worst = max(worst, float(model_of(encoding, class_of(len(piece))).p_value(battery(piece[None, :], encoding))[0]))
        if worst == 1:
            break
    return worst


def random_spans(text: str) -> list[Span]:
    """Runs that pass the false-discovery control of their document."""
    found = []
    for m in _run.finditer(text):
        run = m[0].rstrip("=")
        if len(run) < SHORTEST:
            continue
        encoding = encoding_of(run)
        found.append((p_value(run, encoding), m.start(), m.end(), encoding))
    if not found:
        return []
    mean = sum(e - s for _, s, e, _ in found) / len(found)
    ranked = sorted((p / ((e - s) / mean), s, e, p, enc) for p, s, e, enc in found)
    last = max((k + 1 for k, x in enumerate(ranked) if x[0] <= RATE * (k + 1) / len(ranked)), default=0)
    return [Span("random", s, e, False, enc, p) for _, s, e, p, enc in ranked[:last]]


def scan_text(text: str | None) -> list[Span]:
    if not text:
        return []
    base = base_spans(text)
    more = [s for s in random_spans(text) if not any(s.start < b.end and b.start < s.end for b in base)]
    return sorted(base + more, key=lambda s: (s.start, KINDS.index(s.kind)))


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,encoding:string,p_value:double>>"
_arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("encoding", pa.string()), ("p_value", pa.float64())]))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>`` and ``found``, the spans of each whole text in order."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[vars(s) for s in scan_text(t)] for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _arrow)], names=[id_col, "found"])

    small_batches(df.sparkSession)
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, found {SPANS}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_assign, n_access, n_hex, base_sha256, spans, n_random``."""
    found = find_secrets(df, id_col, text_col)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        id_col, count("assign"), count("access"), count("hex"),
        F.sha2(_joined(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"), count("random"),
    )
