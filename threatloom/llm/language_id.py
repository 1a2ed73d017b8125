"""Language identification by rank-order profiles.

A profile is a list of a language's most frequent letter n-grams (1 to 3 letters
of space-padded lower-case words), by falling frequency.  A document's own most
frequent n-grams are compared with each profile by the out-of-place distance:
the sum over its n-grams of how far their ranks differ, or ``profile`` for those
that a profile lacks.  The nearest language wins.

Profiles are counted in every task over training documents only, summed by a
shuffle of (language, n-gram, count) rows and cut to the top of each language.
A language with more than ``PER_LANGUAGE`` training documents is learned from
about so many, chosen by a hash of the id: a bounded sample of labelled rows.
Every document is predicted from its whole text.

Defined cases: a text that is null, or has no letter, is ``und`` with score 0;
so is every text if nothing was learned; ties go to the language that sorts
first; null languages are not learned; a null id counts as an empty one;
repeated rows are predicted alike; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.common import slices, small_batches, strings

#: n-grams in a profile, and of a document that are compared.
PROFILE = 400
#: Bound of the training sample: expected documents of each language.
PER_LANGUAGE = 4000
#: More languages than this are refused (profiles are broadcast: about 20 bytes an entry).
MOST_LANGUAGES = 2000
#: Words whose n-grams a worker remembers; beyond it starts anew.
REMEMBERED = 150_000
#: n-grams that a worker numbers; beyond it starts anew.
MOST_NUMBERED = 200_000

_words = regex.compile(r"\p{L}+").findall


class Grams(dict):
    """Word to the numbers of its n-grams, which are numbered as they come."""

    def __init__(self) -> None:
        super().__init__()
        self.number: dict[str, int] = {}
        self.codes = np.empty(1 << 12, np.int64)  # of each number, the n-gram as one integer

    def __missing__(self, word: str) -> bytes:
        padded, number = f" {word} ", self.number
        grams = [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)]
        out = []
        for g in grams:
            if g != " ":
                k = number.get(g)
                if k is None:
                    k = number[g] = len(number)
                    if k == len(self.codes):
                        self.codes = np.resize(self.codes, 2 * k)
                    self.codes[k] = code(g)
                out.append(k)
        ids = np.array(out, np.int32).tobytes()  # a third of an array's size, and joined faster
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def counts(self, text: str | None) -> np.ndarray | None:
        """How often each numbered n-gram occurs in the whole text."""
        words = _words((text or "").lower())
        if not words:
            return None
        if len(self.number) > MOST_NUMBERED:  # start anew
            self.clear()
            self.number = {}
        return np.bincount(np.frombuffer(b"".join([self[w] for w in words]), np.int32))

    def top(self, text: str | None, size: int) -> np.ndarray | None:
        """The most frequent n-grams of a text as integers, by falling frequency
        and among equals by their integer."""
        counts = self.counts(text)
        if counts is None:
            return None
        found = np.flatnonzero(counts)
        if len(found) > size:
            n = counts[found]
            found = found[n >= np.partition(n, len(n) - size)[len(n) - size]]
        codes = self.codes[found]
        return codes[np.lexsort((codes, -counts[found]))][:size]


def code(gram: str) -> int:
    return functools.reduce(lambda code, c: code << 21 | ord(c), gram, 0)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(df: DataFrame, text_col: str, lang_col: str, by: Column, per_language: int = PER_LANGUAGE) -> DataFrame | None:
    """``_lang, _text`` of the rows that are learned from, or None if there are none."""
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), by.alias("_by"))
    counts = known.groupBy("_lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return None
    share = F.create_map(*chain.from_iterable((F.lit(r["_lang"]), F.lit(min(1.0, per_language / r["count"]))) for r in counts))
    drawn = F.pmod(F.xxhash64("_by", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return known.where(drawn < share[F.col("_lang")]).select("_lang", "_text")


def learn(df: DataFrame, text_col: str, lang_col: str, by: Column, per_language: int = PER_LANGUAGE, profile: int = PROFILE) -> dict[str, list[int]]:
    """Language to its n-grams (as integers, see :func:`code`) by rank, from the rows of ``df``; ``by`` is what
    the sample's hash is taken of."""
    sample = training_sample(df, text_col, lang_col, by, per_language)
    return {} if sample is None else profiles_of(sample, profile)


def profiles_of(sample: DataFrame, profile: int = PROFILE) -> dict[str, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, Counter] = {}
        grams = Grams()
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                n = grams.counts(text)
                if n is not None:
                    found = np.flatnonzero(n)
                    totals.setdefault(lang, Counter()).update(dict(zip(grams.codes[found].tolist(), n[found].tolist(), strict=True)))
        for lang, found in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["lang", "gram", "n"])

    summed = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = summed.withColumn("place", F.row_number().over(place)).where(F.col("place") <= profile)
    out: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "place").collect():  # languages x profile rows
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.array(sorted(set(chain.from_iterable(profiles.values()))), np.int64)
        self.ranks = np.full((len(self.codes), len(self.langs)), size, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), k] = np.arange(len(profiles[lang]))
        self.own = np.arange(size, dtype=np.int32)[:, None]

    def predict(self, text: str | None, grams: Grams) -> tuple[str, float]:
        return self.scored(text, grams)[:2]

    def scored(self, text: str | None, grams: Grams) -> tuple[str, float, int]:
        """Nearest language, score, and how many n-grams were compared."""
        top = grams.top(text, self.size)
        if top is None or not self.langs:
            return "und", 0.0, 0
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        ranks = self.ranks[at]
        ranks[self.codes[at] != top] = self.size
        off = np.where(ranks == self.size, self.size, np.abs(ranks - self.own[: len(top)])).sum(0)
        best = int(off.argmin())
        return self.langs[best], float(1 - off[best] / (self.size * len(top))), len(top)


def predict(df: DataFrame, profiles: dict[str, list[int]], text_col: str, pred_col: str = "lang_pred", score_col: str = "score", profile: int = PROFILE) -> DataFrame:
    """``df`` with the nearest language and a score: 1 less the mean distance as
    a share of the largest.  The text is the only input of a prediction."""
    at, schema = df.columns.index(text_col), df.schema
    model = df.sparkSession.sparkContext.broadcast(profiles)
    names = [*df.columns, pred_col, score_col]
    wider = T.StructType([*schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_here, grams = Profiles(model.value, profile), Grams()
        for batch in slices(batches):
            got = [model_here.predict(t, grams) for t in strings(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=names)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, wider)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``<id_col>, held_out, lang_pred, score``: learned from the rows that are
    not held out, predicted for all."""
    profiles = learn(df.where(~held_out(id_col)), text_col, lang_col, F.col(id_col))
    return predict(df.select(id_col, held_out(id_col).alias("held_out"), text_col), profiles, text_col).drop(text_col)


#: In the pipeline: texts farther from every language than this are rejected, whatever was learned.
LEAST_SCORE = 0.2
#: Quantile of the training documents' scores, and the share of it that a text must reach.
LOW, SLACK = 0.001, 0.9
#: Words of the longest beginning of a training document that is scored besides the whole.
BEGINNING = 256


def length_class(grams: int) -> int:
    """Half powers of two of the number of n-grams compared."""
    return int(2 * math.log2(grams))


def limits_of(sample: DataFrame, profiles: dict[str, list[int]], profile: int = PROFILE) -> dict[str, list[float]]:
    """Language to the least score of a text by :func:`length_class`: ``SLACK`` of
    the low quantile of the training documents of the language, whole ones or
    their beginnings, whichever is lower."""
    model = sample.sparkSession.sparkContext.broadcast(profiles)
    classes = length_class(profile) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, grams = Profiles(model.value, profile), Grams()
        for batch in slices(batches):
            rows = []
            for lang, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                words = text.split(None, BEGINNING)
                parts = [" ".join(words[: 1 << k]) for k in range(BEGINNING.bit_length()) if 1 << k < len(words)]
                for part, whole in [(text, True), *((x, False) for x in parts)]:
                    best, score, n = here.scored(part, grams)
                    if n and best == lang:
                        rows.append((lang, whole, length_class(n), score))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int32(), pa.float64()), strict=True)], names=["lang", "whole", "length", "score"])

    scores = sample.mapInArrow(run, "lang string, whole boolean, length int, score double")
    low = scores.groupBy("lang", "whole", "length").agg(F.percentile_approx("score", LOW, 10_000).alias("low"))
    seen: dict[str, dict[int, float]] = {}
    for r in low.collect():  # languages x 2 x classes of length
        of = seen.setdefault(r["lang"], {})
        of[r["length"]] = min(SLACK * r["low"], of.get(r["length"], 1.0))
    out = {}
    for lang, of in seen.items():  # a class without scores takes the lower of its neighbours'
        out[lang] = [min(of[j] for j in (max((j for j in of if j <= k), default=None), min((j for j in of if j >= k), default=None)) if j is not None) for k in range(classes)]
    return out


def drop_unknown(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``df`` whose text is in one of the learned languages: as near
    to it as its training documents of the same length are, and ``least`` at least."""
    sample = training_sample(df.where(~held_out(id_col)), text_col, lang_col, F.col(id_col))
    profiles = {} if sample is None else profiles_of(sample)
    limits = limits_of(sample, profiles) if profiles else {}
    at = df.columns.index(text_col)
    model = df.sparkSession.sparkContext.broadcast((profiles, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, low), grams = model.value, Grams()
        here = Profiles(known, PROFILE)
        for batch in slices(batches):
            keep = []
            for text in strings(batch.column(at)):
                lang, score, n = here.scored(text, grams)
                keep.append(bool(n) and score >= max(least, low[lang][length_class(n)] if lang in low else least))
            yield batch.filter(pa.array(keep, pa.bool_()))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)
