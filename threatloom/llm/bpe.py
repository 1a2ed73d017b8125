"""BPE encoding by backtracking, and decoding by an offset table.

For every piece of pre-tokenised text one Aho-Corasick pass finds, at each
position, all tokens that start there.  The encoder walks along the longest
ones; a token may follow another only if the pair is compatible, that is if
merging in rank order would leave exactly that boundary, which a table of
pairs (filled when first met) answers.  Where no token fits it steps back and
takes a shorter one; positions found dead are never entered again, so the work
is linear in the piece.  A sequence whose pairs are all compatible is the one
that the merges give.

The tokenizer file is read on the driver and broadcast (its size is checked);
its path is a parameter.  Supported are BPE models with a word-end suffix,
whose file states NFC, white-space and lower-case normalisers, a split pattern
and byte-level symbols; other settings are refused.

Defined cases: null and empty texts encode to no ids and decode to an empty
text; special tokens' strings in a text become their ids, as in the library;
null ids decode as none; repeated rows encode alike; empty tables give empty
results; all other columns are kept, under any name.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers.normalizers import NFC

from threatloom.llm.common import slices, small_batches, strings

#: Largest tokenizer file that is broadcast.
LARGEST_FILE = 64 << 20
#: Code points that the regex module counts as letters or numbers
#: and the tokenizers library (Unicode 16) does not know yet.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF "
    "18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD "
    "323B0-33479 3D000-3FC3F"
)
#: Capitals that the library lower-cases and Python's tables
#: don't know yet, and how far off their small letters are.
CAPITALS = "1C89:1 A7CB:-A567 A7CC:1 A7CE:1 A7D2:1 A7D4:1 A7DA:1 A7DC:-A641 10D50-10D65:20 16EA0-16EB8:1B"
#: Runs whose ids a worker remembers; beyond it starts anew.
REMEMBERED = 300_000
#: Longer runs are encoded each time they occur.
LONGEST_REMEMBERED = 64


#: Composed form by the library's own tables, which are older than Python's.
_composed = NFC().normalize_str


def byte_symbols() -> list[str]:
    """The printable character for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Tokenizer(dict):
    """Encodes and decodes; as a dict it maps runs without white space to their ids."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, added = spec["model"], spec["added_tokens"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or not model["end_of_word_suffix"] or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in added):
            raise ValueError("this tokenizer file has settings that are not supported")
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        # \s of the file is Unicode's White_Space
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.plain = regex.compile(pattern.replace("[^\\s", "[^\\p{White_Space}")).findall
        newer = "[" + "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in NEWER.split()) + "]"
        self.small: dict[int, int] = {}
        for span, off in (x.split(":") for x in CAPITALS.split()):
            low, high = (int(x, 16) for x in (span.split("-") * 2)[:2])
            self.small |= {c: c + int(off, 16) for c in range(low, high + 1)}
        self.newer = regex.compile(newer[:-1] + "".join(map(chr, self.small)) + "]").search
        exact = regex.sub(r"\[?\\p\{([LN])\}\]?", rf"[\\p{{\1}}--{newer}]", pattern.replace("[^\\s\\p{L}\\p{N}]", "[^\\p{White_Space}L_N_]"))
        exact = exact.replace("L_", f"[\\p{{L}}--{newer}]").replace("N_", f"[\\p{{N}}--{newer}]")
        self.exact = regex.compile(exact, regex.V1).findall
        self.spaced = regex.compile(r"\P{White_Space}+").findall
        self.special = {x["content"]: x["id"] for x in added}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if added else None
        self.bytes = str.maketrans({chr(b): c for b, c in enumerate(byte_symbols())})
        # A symbol that ends a word is one symbol: its character moved up by END.
        self.end = 0x10000
        self.merge: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge[x << 32 | y] = z
            self.parts[z] = (x, y)
        if any(z <= max(p) for z, p in self.parts.items()) or len(self.parts) != len(model["merges"]):
            raise ValueError("token ids must rise with the rank of their merges")
        lacking = [c for c in byte_symbols() if c not in vocab or c + self.suffix not in vocab]
        if lacking:  # a symbol without a token could not be encoded
            raise ValueError(f"{len(lacking)} byte symbols have no token")
        self.find = ahocorasick.Automaton()
        texts = {self.ended(t[: -len(self.suffix)]) if t.endswith(self.suffix) else t: i for t, i in vocab.items() if t not in self.special}
        self.size = [0] * (max(vocab.values()) + 1)
        self.shorter = [-1] * len(self.size)  # the longest token that begins a token, besides itself
        for symbols, i in texts.items():
            self.find.add_word(symbols, (len(symbols), i))
            self.size[i] = len(symbols)
            self.shorter[i] = next((texts[symbols[:k]] for k in range(len(symbols) - 1, 0, -1) if symbols[:k] in texts), -1)
        self.find.make_automaton()
        self.fits: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        # decoding: all tokens one after another, and where each begins
        by_id = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        texts = [by_id.get(i, "").encode() for i in range(max(by_id) + 1)]
        self.offsets = np.cumsum([0, *map(len, texts)])
        self.blob = np.frombuffer(b"".join(texts), np.uint8)

    def ended(self, symbols: str) -> str:
        return symbols[:-1] + chr(ord(symbols[-1]) + self.end)

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at one side (0 left, 1 right) of a token at
        some time while it is merged, each with the token that ends it."""
        found = self.edges[side].get(token)
        if found is None:
            found, part = [(token, 1 << 31)], token
            while part in self.parts:
                part, above = self.parts[part][side], part
                found.append((part, above))
            self.edges[side][token] = found
        return found

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging in rank order leaves the boundary between ``a`` and ``b``."""
        merge = self.merge
        for x, x_until in self.edge(a, 1):
            for y, y_until in self.edge(b, 0):
                # Of equal merges the leftmost comes first: the one across
                # precedes one inside b, not one inside a.
                z = merge.get(x << 32 | y)
                if z is not None and z < x_until and z <= y_until:
                    return False
        return True

    def __missing__(self, run: str) -> tuple[int, ...]:
        """The ids of a run without white space."""
        # tuples of numbers: the garbage collector passes over them
        ids = tuple(chain.from_iterable(map(self.encode_piece, self.pieces(run))))
        if len(run) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            if len(self.fits) >= 2 * REMEMBERED:
                self.fits.clear()
            self[run] = ids
        return ids

    def encode_piece(self, piece: str) -> list[int]:
        symbols = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.bytes)
        symbols = self.ended(symbols)
        # The longest token at each step; mostly their pairs are compatible and this is the result.
        ids = [i for _, (_, i) in self.find.iter_long(symbols)]
        fits = self.fits
        for a, b in zip(ids, ids[1:], strict=False):
            key = a << 32 | b
            ok = fits.get(key)
            if ok is None:
                ok = fits[key] = self._compatible(a, b)
            if not ok:
                return self.backtrack(symbols)
        return ids

    def backtrack(self, symbols: str) -> list[int]:
        n, size, shorter, fits = len(symbols), self.size, self.shorter, self.fits
        longest = [0] * n
        for end, (length, i) in self.find.iter(symbols):
            longest[end - length + 1] = i  # ends rise, so the last one is the longest
        dead = bytearray(n + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while True:
            while token >= 0:
                end = at + size[token]
                if not dead[end]:
                    if not ids:
                        break
                    key = ids[-1] << 32 | token
                    ok = fits.get(key)
                    if ok is None:
                        ok = fits[key] = self._compatible(ids[-1], token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at = end
                if at == n:
                    return ids
                token = longest[at]
            else:
                dead[at] = 1
                token = ids.pop()
                at -= size[token]
                token = shorter[token]

    def pieces(self, run: str) -> list[str]:
        if not run.isascii() and self.newer(run):
            return self.exact(run.translate(self.small))
        return self.plain(run)

    def runs(self, text: str) -> list[str]:
        """The normalised text's runs without white space; no piece spans two."""
        if text.isascii():
            text = text.lower()
        else:  # each character by itself: no special form of a final sigma
            text = _composed(text).replace("Σ", "σ").lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split() only
            return self.spaced(text)
        return text.split()

    def encode(self, text: str | None, special: bool = True) -> list[int]:
        """``special``: whether special tokens' strings become their ids, or are ordinary text."""
        if not text:
            return []
        parts = self.split(text) if self.split and special else [text]
        out: list[int] = []
        for part in parts:
            if special and part in self.special:
                out.append(self.special[part])
            else:
                out += chain.from_iterable(map(self.__getitem__, self.runs(part)))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts with single spaces between them, as the library
        gives them where the file states no decoder."""
        if not len(ids):
            return b""
        begin, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        stop = np.cumsum(size + 1)  # one more for the space
        out = np.full(stop[-1], 0x20, np.uint8)
        shift = np.repeat(begin - (stop - size - 1), size)
        where = np.arange(len(shift)) + np.repeat(np.arange(len(ids)), size)
        out[where] = self.blob[where + shift]
        return out[:-1].tobytes()


@functools.lru_cache(maxsize=4)
def _loaded(digest: str, data: bytes) -> Tokenizer:
    return Tokenizer(data)


def tokenizer(data: bytes) -> Tokenizer:
    """One for each worker process and file."""
    return _loaded(hashlib.sha256(data).hexdigest(), data)


def read_file(path: str) -> bytes:
    data = Path(path).read_bytes()
    if len(data) > LARGEST_FILE:
        raise ValueError(f"{path} has {len(data)} bytes; at most {LARGEST_FILE} are broadcast")
    return data


def _mapped(df: DataFrame, column: str, fields: list[T.StructField], make) -> DataFrame:
    """``df`` with ``fields`` made from ``column`` batch by batch; all other
    columns pass through by position, so their names don't matter."""
    at = df.columns.index(column)
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch.column(at))], names=schema.names)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``df`` with the ids of each whole text, and if ``decoded_col`` is named also
    with the text that these ids decode to, in the same pass."""
    file = df.sparkSession.sparkContext.broadcast(read_file(path))

    def make(texts: pa.Array) -> list[pa.Array]:
        t = tokenizer(file.value)
        ids = [np.array(t.encode(x), np.int32) for x in strings(texts)]
        at = np.cumsum([0, *map(len, ids)])
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
        return [lists, *([_decoded(t, ids)] if decoded_col else [])]

    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded_col, T.StringType())] if decoded_col else [])
    return _mapped(df, text_col, fields, make)


def _decoded(t: Tokenizer, ids: list[np.ndarray]) -> pa.Array:
    return pa.array([t.decode(x.astype(np.int64)) for x in ids], pa.binary()).cast(pa.string())


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text that each row's ids stand for."""
    file = df.sparkSession.sparkContext.broadcast(read_file(path))
    none = np.empty(0, np.int32)

    def make(lists: pa.Array) -> list[pa.Array]:
        return [_decoded(tokenizer(file.value), [x.values.to_numpy(zero_copy_only=False) if x.is_valid else none for x in lists])]

    return _mapped(df, ids_col, [T.StructField(out_col, T.StringType())], make)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_tokens, ids_sha256, decoded_sha256`` for each row."""
    coded = encode(df.select(id_col, text_col), path, text_col, "_ids", "_decoded").drop(text_col)
    return coded.select(
        id_col,
        F.size("_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("_decoded", 256).alias("decoded_sha256"),
    )
