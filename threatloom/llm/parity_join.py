"""N-gram Jaccard join by parity sketches, and the classes that its links form.

A document's set is its distinct word shingles, as 64-bit hashes.  Its parity
sketch has ``blocks * BITS`` bits; every shingle flips one bit, so the Hamming
distance of two sketches is at most the symmetric difference of the sets.

1. Size bands: sets within the similarity have sizes within its ratio.  Band
   ``k`` holds pairs whose larger set has a size in ``[edge k, edge k+1)``; a set
   takes part in its own band, and in the next if it may be the smaller partner.
2. Pigeonhole: in a band, linked sets differ in at most ``D`` shingles, hence in
   at most ``D`` blocks of the sketch.  With ``D + 1 + E`` blocks ``E + 1`` at least
   are equal, so the two share one among the ``D + 1`` rarest of either.  The join
   key is a digest of (band, block, bits of the block); by its rarest keys a set
   meets few others, even if most of its blocks are those of a large group.
3. Identical sets are merged first, so copies are never paired.  Keys are
   worked off in ``ROUNDS`` parts, so shuffle files take a part of their space.
4. In every bucket (sets with the same key) all are compared with one hub:
   folded sketches first, and where these allow a link the sets themselves.
   Most links of a group of near copies then exist already, and components are
   built.  While the pairs left are many for each set, hubs are drawn anew in
   each bin of a bucket, and those of other components compared with these: a
   few comparisons for each set, by which the components of a group join.
5. Only pairs from components that still differ in one bucket are verified
   in addition, and links between two components count once.  Passed over without being emitted are pairs whose sketches differ
   in more bits than those of linked sets can, directly or by the difference of
   their distances to the hub (the Hamming distance is a metric).

No bucket is capped and no link between different texts is lost.  Similarities
below ``1 / WIDTH``, whose partners may be more than one band apart, are refused.

Defined cases: null and empty texts, and texts without words, have an empty set
and stay alone; rows with a null id have a null component and take no part; a
text with fewer words than a shingle has its whole sequence as only member;
repeated rows fall into one class; an empty table gives an empty result.  The id
is taken to identify the text: where rows share an id but not the text, the
smallest text is compared.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.common import cut, removed, slices, small_batches, written
from threatloom.llm.components import components, joined

#: Bits of each block of the sketch.
BITS = 4096
#: Bits of the folded sketch that candidates are compared by.
FOLDED = 2048
#: Width of a size band.
WIDTH = 1.35
#: Parts that the keys are worked off in.
ROUNDS = 4
#: Of a set's keys, the least ones that tell which bucket of two sets is their first.
LEAST_KEYS = 16
#: Sets of a bin that are compared in one task; more are cut into parts.
PART = 2048
#: Times that hubs are drawn anew, at most, and the comparisons for each set that
#: are left for pairs without a hub.
DRAWS, PAIRS = 8, 4
#: Words whose hashes a worker remembers; beyond it starts anew.
REMEMBERED = 200_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word to 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes | None, n: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of the whole text."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and \x20 \x09-\x0D
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.array([words[w] for w in found], np.uint64)
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * _A + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def band_edges(size: int) -> list[int]:
    edges = [1]
    while edges[-1] <= size:
        edges.append(max(edges[-1] + 1, -int(-edges[-1] * WIDTH // 1)))
    return edges


def most_different(high: int, p: int, q: int) -> int:
    """Largest symmetric difference of two sets of up to ``high`` members whose
    Jaccard similarity is ``p / q`` or more."""
    return 2 * high * (q - p) // (q + p)


def spare(need, p: int, q: int):
    """``E`` for ``D + 1 = need`` (a number or a column): as much as leaves each
    block a few shingles."""
    part = 2 if 10 * p >= 9 * q else 4
    return F.floor(need / part) if isinstance(need, Column) else need // part


def block_keys(hashes: np.ndarray, p: int, q: int) -> tuple[np.ndarray, list[int]]:
    """The join keys of a set, as signed 64-bit numbers whose lowest bit is that
    of the band, and ``D + 1`` for the even and the odd band (0: not in it)."""
    n, needs = len(hashes), [0, 0]
    if not n:
        return np.empty(0, np.int64), needs
    edges = band_edges(n)  # edges[-2] <= n < edges[-1]
    own, out = len(edges) - 2, []
    for band, high in ((own, edges[-1] - 1), (own + 1, max(edges[-1] + 1, -int(-edges[-1] * WIDTH // 1)) - 1)):
        if band > own and n * q < p * edges[-1]:
            break  # too small for any partner there
        need = most_different(high, p, q) + 1
        needs[band & 1] = need
        blocks = need + spare(need, p, q)
        block = hashes % np.uint64(blocks)
        flips = mixed((hashes >> np.uint64(20)) % np.uint64(BITS) + _A)  # XOR of these is a digest of the block's bits
        order = np.argsort(block, kind="stable")
        block, flips = block[order], flips[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        bits = np.zeros(blocks, np.uint64)
        bits[block[starts]] = np.bitwise_xor.reduceat(flips, starts)
        where = (np.uint64(band) << np.uint64(40)) + np.arange(blocks, dtype=np.uint64)
        out.append(mixed(mixed(where + _C) + bits) & ~np.uint64(1) | np.uint64(band & 1))
    return np.concatenate(out).view(np.int64), needs


def folded_sketch(hashes: np.ndarray) -> np.ndarray:
    """The set's parity sketch of ``FOLDED`` bits, as 64-bit numbers."""
    bits = np.bincount(mixed(hashes + _B) % np.uint64(FOLDED), minlength=FOLDED) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def profiler(n: int) -> Batches:
    """Size and 128-bit digest of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches):
            sizes, first, second = [], [], []
            for text in batch.column(1).to_pylist():
                h = shingles(text, n, words)
                digest = xxhash.xxh3_128_digest(h.tobytes())
                sizes.append(len(h))
                first.append(int.from_bytes(digest[:8], "big", signed=True))
                second.append(int.from_bytes(digest[8:], "big", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["_id", "_n", "_d1", "_d2"])

    return run


def keyer(n: int, p: int, q: int) -> Batches:
    """Size, folded sketch and join keys of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches):
            sets = [shingles(t, n, words) for t in batch.column(1).to_pylist()]
            keys = [block_keys(h, p, q) for h in sets]
            sizes, needs = pa.array(list(map(len, sets)), pa.int64()), pa.array([need for _, need in keys], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, needs, _lists(list(map(folded_sketch, sets))), _lists([k for k, _ in keys])], ["_id", "_n", "_needs", "_bits", "_keys"])

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], pa.int64()))


def set_maker(n: int) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches):
            sets = [shingles(t, n, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([s.view(np.int64) for s in sets])], ["_id", "_set"])

    return run


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (``a``, ``b``) with ``both`` and ``either``: the sizes of intersection and union."""
    joined = pairs.join(sets.select(F.col("_id").alias("b"), F.col("_set").alias("sb")), "b").join(sets.select(F.col("_id").alias("a"), F.col("_set").alias("sa")), "a")
    joined = joined.withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return joined.select("a", "b", "both", (F.size("sa") + F.size("sb") - F.col("both")).alias("either"))


def distance() -> Column:
    """Hamming distance of the folded sketches ``ba`` and ``bb``."""
    return F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def compared(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """``pairs`` with ``na``, ``nb`` and ``differ``, the distance of their sketches."""
    joined = pairs.join(bits.select(F.col("_id").alias("b"), F.col("_bits").alias("bb"), F.col("_size").alias("nb")), "b")
    joined = joined.join(bits.select(F.col("_id").alias("a"), F.col("_bits").alias("ba"), F.col("_size").alias("na")), "a")
    return joined.select("a", "b", "na", "nb", distance().alias("differ"))


def may_link(p: int, q: int) -> Column:
    """Whether sizes and sketches allow the similarity."""
    return (F.col("differ") * (q + p) <= (F.col("na") + F.col("nb")) * (q - p)) & (F.least("na", "nb") * q >= F.greatest("na", "nb") * p)


def unsettled(placed: DataFrame) -> DataFrame:
    """The rows (``key``, ``_id``, ``component``, ``bin``, ...) in whose bin, or in a
    bin beside it, another component is; with ``parts``, the number of parts that
    the row's bin and the next are cut into (null: empty bin)."""
    bins = placed.groupBy("key", "bin").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count(F.lit(1)) / F.lit(PART)).cast("int").alias("r"))
    bins = bins.select("key", "lo", "hi", "r", F.posexplode(F.array(F.col("bin"), F.col("bin") - 1, F.col("bin") + 1)).alias("side", "bin"))
    of = [F.max(F.when(F.col("side") == k, F.col("r"))) for k in range(2)]
    around = bins.groupBy("key", "bin").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array(*of).alias("parts"))
    return placed.join(around.where("lo <> hi").drop("lo", "hi"), ["key", "bin"])


def many_left(rows: DataFrame) -> bool:
    """Whether ``rows`` have more pairs in the same or in neighbouring bins than
    ``PAIRS`` for each row."""
    bins = rows.groupBy("key", "bin").agg(F.count(F.lit(1)).alias("m"))
    after = bins.select("key", (F.col("bin") - 1).alias("bin"), F.col("m").alias("next"))
    pairs = F.sum(F.col("m") * ((F.col("m") - 1) / 2 + F.coalesce("next", F.lit(0))))
    return bool(bins.join(after, ["key", "bin"], "left").agg((pairs > PAIRS * F.sum("m")).alias("many")).first()["many"])


def refolded(bits: Column, need: Column) -> Column:
    """The folded sketch, folded further to four bits or more for each shingle that
    linked sets of the band may differ in."""
    for size in (FOLDED >> k for k in range(1, 6)):
        half = size // 64
        short = F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        bits = F.when((need * 4 <= size) & (F.size(bits) == 2 * half), short).otherwise(bits)
    return bits


def folded_as(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """``rows`` with their sketches, folded as their band needs it."""
    return rows.join(bits.drop("_size"), "_id").withColumn("_bits", refolded(F.col("_bits"), F.col("need")))


def allowed(p: int, q: int) -> Column:
    """Whether two rows of a bucket differ in component, and sizes, distances to the
    hub and sketches allow the similarity."""
    most = (F.col("na") + F.col("nb")) * (q - p)
    within = (F.col("ca") != F.col("cb")) & (F.abs(F.col("ha") - F.col("hb")) * (q + p) <= most) & (F.least("na", "nb") * q >= F.greatest("na", "nb") * p)
    return within & (distance() * (q + p) <= most)


def first_shared() -> Column:
    """Whether no smaller key than ``key`` is among the least keys of both sets.  A key
    that both lists hold is the pair's first one if it is the least of these."""
    return F.coalesce(F.col("key") <= F.array_min(F.array_intersect("ka", "kb")), F.lit(True))


def neighbours(rows: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs (``a``, ``b``) of sets in the same or in neighbouring bins of a bucket,
    of different components, whose sizes, distances to the hub and sketches allow
    a link.  A bin of more than ``PART`` sets is cut into parts by the ids' hash,
    and each pair of parts is a key of its own, so no task gets a whole bucket."""
    part = lambda r: F.pmod(F.xxhash64("_id"), r).cast("int")
    each = lambda r: F.explode(F.sequence(F.lit(0), r - 1))
    left = rows.select("*", F.posexplode("parts").alias("up", "r")).where("r IS NOT NULL")
    left = left.select("key", (F.col("bin") + F.col("up")).alias("bin"), "up", part(F.col("r")).alias("i"), each(F.col("r")).alias("j"), F.col("_id").alias("a"), F.col("_n").alias("na"), F.col("component").alias("ca"), F.col("differ").alias("ha"), F.col("_bits").alias("ba"), F.col("_least").alias("ka"))
    own = F.col("parts")[0]
    right = rows.select("key", "bin", each(own).alias("i"), part(own).alias("j"), F.col("_id").alias("b"), F.col("_n").alias("nb"), F.col("component").alias("cb"), F.col("differ").alias("hb"), F.col("_bits").alias("bb"), F.col("_least").alias("kb"))
    once = (F.col("up") == 1) | (F.col("a") < F.col("b"))
    found = left.join(right, ["key", "bin", "i", "j"]).where(once & allowed(p, q) & first_shared())
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def met(rows: DataFrame, bits: DataFrame, draw: int, p: int, q: int) -> DataFrame:
    """Pairs (``a``, ``b``) of each row with one drawn hub of its bin, and of either
    bin beside it, of another component, where sizes and sketches allow a link."""
    at = F.col("bin")
    hubs = rows.groupBy("key", "bin").agg(F.min_by(F.struct("_id", "_n", "component", "differ", "need"), F.xxhash64("_id", "key", F.lit(draw))).alias("hub"))
    hubs = folded_as(hubs.select("key", "bin", "hub.*"), bits)
    hubs = hubs.select("key", F.explode(F.array(at - 1, at, at + 1)).alias("bin"), F.col("_id").alias("b"), F.col("_n").alias("nb"), F.col("component").alias("cb"), F.col("differ").alias("hb"), F.col("_bits").alias("bb"))
    left = folded_as(rows, bits).select("key", "bin", F.col("_id").alias("a"), F.col("_n").alias("na"), F.col("component").alias("ca"), F.col("differ").alias("ha"), F.col("_bits").alias("ba"))
    return left.join(hubs, ["key", "bin"]).where(allowed(p, q)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def of_round(rows: DataFrame, k: int) -> DataFrame:
    """The rows whose key belongs to the ``k``-th of ``ROUNDS`` parts."""
    return rows.where(F.pmod(F.shiftright("key", 1), F.lit(ROUNDS)) == k)


def similar(p: int, q: int) -> Column:
    return F.col("both") * q >= F.col("either") * p


def jaccard_classes(df: DataFrame, words: int, p: int, q: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_shingles, component_id``, one row per row of ``df``: links are
    pairs with Jaccard similarity ``p / q`` or more of their ``words``-word shingles."""
    if p * WIDTH < q:  # partners may be two size bands apart
        raise ValueError(f"a similarity below 1 / {WIDTH} is not covered by the size bands")
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    small_batches(df.sparkSession)
    profile = written(texts.mapInArrow(profiler(words), f"_id {kind}, _n long, _d1 long, _d2 long"), "parity-profile")
    digest = ["_d1", "_d2"]
    present = profile.where("_n > 0 AND _id IS NOT NULL")
    classes = cut(present.groupBy(*digest).agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies")))

    def text_of(ids: DataFrame) -> DataFrame:
        return texts.join(ids, "_id", "left_semi").groupBy("_id").agg(F.min("_text").alias("_text"))

    # One set stands for all that are identical.
    reps = text_of(classes.select(F.col("rep").alias("_id")))
    keys = written(reps.mapInArrow(keyer(words, p, q), f"_id {kind}, _n long, _needs array<int>, _bits array<long>, _keys array<long>"), "parity-keys")
    sketches = written(keys.drop("_keys"), "parity-sketches")
    keyed = keys.select("_id", F.explode("_keys").alias("key"))
    listed = None  # the other keys are the rarest, and meet nobody
    for k in range(ROUNDS):
        some = of_round(keyed, k)
        shared = some.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        part = written(some.join(shared, "key"), "parity-shared")
        listed = part if listed is None else listed.unionByName(part)

    removed(keys)  # the largest table

    # Of each set's keys in a band the D + 1 rarest.
    band = F.col("key").bitwiseAND(F.lit(1))
    ranked = listed.join(sketches.select("_id", "_n", "_needs"), "_id").withColumn("need", F.get("_needs", band.cast("int")))
    own = Window.partitionBy("_id", band)
    ranked = ranked.withColumn("alone", F.col("need") + spare(F.col("need"), p, q) - F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("m", "key")))
    rare = written(ranked.where("rank <= need - alone").select("key", "_id", "_n", "need"), "parity-rare")
    removed(listed)
    hubs = rare.groupBy("key").agg(F.min("_id").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    members = written(rare.join(hubs, "key"), "parity-members")
    removed(rare)

    # Every member against its bucket's hub: sketches first, then sets, made of
    # the whole texts again, where these allow a link.
    bits = sketches.select("_id", "_bits", F.col("_n").alias("_size"))
    stars = cut(compared(members.where("_id <> hub").select(F.col("_id").alias("a"), F.col("hub").alias("b")).distinct(), bits))

    def sets_of(ids: DataFrame) -> DataFrame:
        return written(text_of(ids).mapInArrow(set_maker(words), f"_id {kind}, _set array<long>"), "parity-sets")

    def linked(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        ends = pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id"))).distinct()
        own = sets_of(ends) if sets is None else None
        out = cut(verified(pairs, own if sets is None else sets).where(similar(p, q)).select("a", "b"))
        if own is not None:
            removed(own)
        return out

    found = components(linked(stars.where(may_link(p, q)).select("a", "b")))

    # Pairs in one bucket whose components differ still.  Bins by the distance to
    # the hub: linked sets are in one bin or in neighbours.  Of a bin only those
    # rows are left around which there is another component.
    def labelled(rows: DataFrame) -> DataFrame:
        label = found.select(F.col("node").alias("_id"), "component")
        return rows.join(label, "_id", "left").withColumn("component", F.coalesce("component", "_id"))

    placed = written(
        labelled(members.where("_id <> hub"))
        .join(stars.select(F.col("a").alias("_id"), F.col("b").alias("hub"), "differ"), ["_id", "hub"])
        .withColumn("bin", F.floor(F.col("differ") / F.col("need")).cast("int"))
        .select("key", "_id", "_n", "need", "component", "differ", "bin"),
        "parity-placed",
    )
    removed(members)
    open_rows = written(unsettled(placed), "parity-unsettled")
    removed(placed)

    # While many pairs are left, each bin's rows against hubs drawn anew.  The sets
    # of all rows that take part are made once.
    sets = None
    for draw in range(DRAWS):
        if not many_left(open_rows):
            break
        if sets is None:
            sets = sets_of(open_rows.select("_id").distinct())
        some = cut(compared(met(open_rows, bits, draw, p, q), bits).where(may_link(p, q)).select("a", "b"))
        new = linked(some, sets)
        if new.isEmpty():
            break
        found = joined(found, new)
        before, open_rows = open_rows, written(unsettled(labelled(open_rows.drop("component", "parts"))), "parity-unsettled")
        removed(before)
        if new.count() * 4 < some.count():  # most of what is left does not link
            break
    least = open_rows.groupBy("_id").agg(F.slice(F.sort_array(F.collect_list("key")), 1, LEAST_KEYS).alias("_least"))  # at most D + 1 keys of either band
    open_keys = written(folded_as(open_rows.join(least, "_id"), bits), "parity-open")
    removed(open_rows)
    rest = None
    for k in range(ROUNDS):
        part = written(neighbours(of_round(open_keys, k), p, q), "parity-rest")
        rest = part if rest is None else rest.unionByName(part)
    removed(open_keys)
    more = linked(cut(compared(rest.distinct(), bits).where(may_link(p, q)).select("a", "b")), sets)
    if sets is not None:
        removed(sets)
    if not more.isEmpty():
        found = joined(found, more)

    classes = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").where("copies > 1 OR component IS NOT NULL")
    classes = classes.select(*digest, F.coalesce("component", "rep").alias("component_id"))
    out = profile.select("_id", "_n", *digest).join(classes, digest, "left")
    alone = F.col("_id").isNull() | (F.col("_n") == 0)
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.when(alone, F.col("_id")).otherwise(F.coalesce("component_id", "_id")).alias("component_id"))


def keep_one_of_each(df: DataFrame, words: int, p: int, q: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with their columns, without those whose class has a
    smaller id: the smallest of each class stays.  Rows with a null id stay."""
    classes = jaccard_classes(df, words, p, q, id_col, text_col)
    gone = classes.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("_gone")).distinct()
    return df.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")


#: The query's parameters: three words, 90 of 100.
SHINGLE_WORDS, AT_LEAST = 3, (9, 10)

ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = w.doc_id
"""
