"""Personal data: fixed patterns, and a skip-chain conditional random field.

Patterns with their checks (digit counts, octets, Luhn) give the base spans.
Beside them a conditional random field labels all mentions: numbers with whatever
separates their groups (blanks, dots, brackets, hyphens), and addresses, also with
``(at)`` for the sign.  The labels are notations of numbers and addresses, so words
that are neither can have none of them.  Its factors are

* what a mention looks like, and the words beside it,
* labels of neighbours, up to ``NEAR`` words away,
* skip edges between distant mentions that repeat, or are alike (the same digits
  in another notation, the same last digits, the same address in other letters):
  each is tied to the nearest earlier one, so edges are few times as many as mentions.

Loopy belief propagation passes messages along all edges until they settle; so
what is plain in one place labels its bare repetition in another.  Messages that
have not settled when they could have passed every path ``ROUNDS`` times are not
used: then a spanning forest (the chain first) is solved, which is exact.  Weights
are learned on the driver by pseudo-likelihood from generated labelled texts
(:func:`labelled_texts`), and are the same for all documents.

Defined cases: null and empty texts have no spans; offsets count code points,
ends exclusive; found spans that touch a base span are not reported again;
repeated rows give equal results; rows with a null id keep it; of mentions that are
alike ties go to the nearest; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import slices, small_batches, strings

KINDS = ("email", "ip", "card", "phone", "crf_email", "crf_ip", "crf_card", "crf_phone")
LABELS = ("O", "email", "ip", "card", "phone")
#: Least posterior of a span that the field adds.
LEAST = 0.9
#: Rounds of message passing at most for each edge of the longest path, texts that the weights are learned from, and words between neighbours at most.
ROUNDS, TEXTS, NEAR = 12, 800, 4

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_marked = re.compile(r"[0-9@]|[(\[] ?at ?[)\]]", re.I)
_at = re.compile(r"@| ?[(\[] ?at ?[)\]] ?", re.I)
_rest = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[(\[] ?dot ?[)\]] ?)[A-Za-z0-9-]+)*", re.I)
_number = re.compile(r"\+?\(?\+?[0-9]+(?:(?:[ \xa0]?[().\-/\u2010-\u2013]{1,2}[ \xa0]?|[ \xa0]|\[\.\])[0-9]+)*")
_group = re.compile(r"[+(]*[0-9]+")
_word = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    base: bool
    posterior: float | None = None


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d - 9 if (d := 2 * int(c)) > 9 else d for c in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by kind and start."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:  # leftwards from each at sign, so long runs cost no more than once
        start = at
        while start > free and text[start - 1] in _local:
            start -= 1
        if at >= free and start < at and (m := _domain.match(text, at + 1)):
            out.append(Span("email", start, m.end(), True))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", at + 1)
    if not re.search("[0-9]", text):
        return out
    out += [Span("ip", *m.span(), True) for m in _ip.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in _card.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(Span("card", *m.span(), True))
    if "+" in text:
        out += [Span("phone", *m.span(), True) for m in _phone.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# --- the field -----------------------------------------------------------


#: Words that announce what a number or address is.
CUES = (
    frozenset("tel telephone phone call calls called mobile cell fax ring dial telefon handy reach whatsapp sms téléphone appel teléfono llame".split()),
    frozenset("card cards visa mastercard amex credit debit karte carte tarjeta".split()),
    frozenset("ip host server ping gateway subnet router addr dns".split()),
    frozenset("mail email mailto write courriel correo".split()),
    frozenset("order invoice ticket serial isbn id nr no number version ref reference article sku tracking case page pages chapter year years total rechnung bestellung".split()),
)


@dataclass
class Token:
    """A mention: a number or an address, as it is written."""

    text: str
    start: int
    end: int
    place: int  # words before it in the text, where they count
    before: tuple[str, ...]  # up to three words before, nearest first
    glued: bool  # letters or digits touch it
    mark: str  # the characters just before and after


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    for m in _at.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _local:
            start -= 1
        rest = _rest.match(text, m.end())
        if free <= start < m.start() and rest:
            yield start, rest.end()
            free = rest.end()
        else:
            free = max(free, m.end())


def tokens_of(text: str) -> list[Token]:
    """The mentions of a text in order."""
    spans = list(_addresses(text))
    taken = iter(spans)
    busy = next(taken, None)
    for m in _number.finditer(text):
        while busy and busy[1] <= m.start():
            busy = next(taken, None)
        if busy and busy[0] < m.end():
            continue
        if sum(c.isdigit() for c in m[0]) <= 19:
            spans.append(m.span())
        else:  # too long for one number: its groups by themselves
            spans += [(m.start() + g.start(), m.start() + g.end()) for g in _group.finditer(m[0])]
    spans.sort()
    out: list[Token] = []
    last, place = 0, 0
    recent: tuple[str, ...] = ()
    for start, end in spans:
        words = _word.findall(text, last, start)
        place += len(words)
        recent = (*(w.lower() for w in words[: -4 : -1]), *recent)[:3]
        before, after = text[start - 1 : start], text[end : end + 1]
        out.append(Token(text[start:end], start, end, place, recent, before.isalnum() or before == "_" or after.isalnum() or after == "_", before + "\0" + after))
        last = end
    return out


_date = re.compile(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:[0-9]{2}|[0-9]{4})")
_decimal = re.compile(r"[0-9]+[.][0-9]+")


def features(t: Token) -> list[float]:
    x = t.text
    groups = re.findall("[0-9]+", x)
    digits = "".join(groups)
    n, shape = len(digits), tuple(map(len, groups))
    if _at.search(x):
        return [1.0, 1.0, "." in x.partition("@")[2] or "dot" in x.lower(), *[0.0] * 25, *(float(not c.isdisjoint(t.before)) for c in CUES)]
    octets = len(groups) == 4 and n <= 12 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and "." in x
    return [
        1.0, 0.0, 0.0, octets, octets and x.count(".") == 3, x.startswith("+") or x.startswith("(+"), "(" in x, n == 0, 13 <= n <= 19, 13 <= n <= 19 and luhn(digits), 13 <= n <= 19 and not luhn(digits),
        9 <= n <= 12, n in (7, 8), n <= 6, len(groups) == 1, len(groups) == 1 and n in (10, 11, 12), shape[-3:] == (3, 3, 4), shape == (4, 4, 4, 4), digits.startswith("0"), digits.startswith("00"),
        len(groups) > 2, t.glued, bool(_date.fullmatch(x)), bool(_decimal.fullmatch(x)), len(set(digits)) <= 2, any(c in "$€£#/=_" for c in t.mark), any(c in "%:°" for c in t.mark), any(c in "\"'<" for c in t.mark),
        *(float(not c.isdisjoint(t.before)) for c in CUES),
    ]


def alike(t: Token) -> list[str]:
    """What ties a mention to others: its digits if many, its address."""
    if m := _at.search(t.text):
        name = t.text[: m.start()].lower()
        host = re.sub(r" ?[(\[] ?dot ?[)\]] ?", ".", t.text[m.end() :].lower())
        return [f"a{name}@{host}", *([f"n{name}"] if len(name) >= 4 else [])]
    digits = "".join(c for c in t.text if c.isdigit())
    keys = [f"d{digits}"] if len(digits) >= 4 else []
    if len(digits) >= 7:
        keys.append(f"e{digits[-7:]}")
    return keys


def edges_of(tokens: list[Token]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges and skip edges, as pairs of places in ``tokens``."""
    chain = [(k, k + 1) for k in range(len(tokens) - 1) if tokens[k + 1].place <= tokens[k].place + NEAR]
    seen: dict[str, int] = {}
    skips: set[tuple[int, int]] = set()
    for k, t in enumerate(tokens):
        for key in alike(t):
            if key in seen:
                skips.add((seen[key], k))
            seen[key] = k
    return chain, sorted(skips)


def forest(size: int, pairs: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, np.ndarray]]:
    """Those pairs, in order, that close no circle."""
    root = list(range(size))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    out = []
    for pair in pairs:
        a, b = find(pair[0]), find(pair[1])
        if a != b:
            root[a] = b
            out.append(pair)
    return out


def longest_path(pairs: list[tuple[int, int]]) -> int:
    """Edges on the longest forward path, along which evidence may have to pass."""
    reach: dict[int, int] = {}
    for a, b in sorted(pairs):
        reach[b] = max(reach.get(b, 0), reach.get(a, 0) + 1)
    return max(reach.values(), default=0)


@dataclass(frozen=True)
class Field:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray

    def posteriors(self, tokens: list[Token]) -> np.ndarray:
        """Beliefs after loopy message passing: tokens x labels."""
        local = np.array([features(t) for t in tokens], float) @ self.unary
        chain, skips = edges_of(tokens)
        pairs = [(a, b, self.chain) for a, b in chain] + [(a, b, self.skip) for a, b in skips]
        if pairs:
            beliefs, settled = self.passed(local, pairs, ROUNDS * (longest_path(chain + skips) + 1), 0.5)
            if not settled:
                beliefs, _ = self.passed(local, forest(len(tokens), pairs), len(tokens) + 1, 0.0)
            local = beliefs
        local = np.exp(local - local.max(1, keepdims=True))
        return local / local.sum(1, keepdims=True)

    def passed(self, local: np.ndarray, pairs: list[tuple[int, int, np.ndarray]], rounds: int, damping: float) -> tuple[np.ndarray, bool]:
        """Logarithms of beliefs, and whether the messages have settled."""
        src = np.array([a for a, _, _ in pairs] + [b for _, b, _ in pairs])
        dst = np.array([b for _, b, _ in pairs] + [a for a, _, _ in pairs])
        tables = np.array([t for _, _, t in pairs] + [t.T for _, _, t in pairs])
        back = np.r_[len(pairs) : 2 * len(pairs), 0 : len(pairs)]  # each message's reverse
        messages = np.zeros((len(src), len(LABELS)))
        done = False
        for _ in range(rounds):
            belief = local.copy()
            np.add.at(belief, dst, messages)
            out = (belief[src] - messages[back])[:, :, None] + tables
            top = out.max(1, keepdims=True)
            fresh = (top + np.log(np.exp(out - top).sum(1, keepdims=True)))[:, 0]
            fresh = damping * messages + (1 - damping) * (fresh - fresh.max(1, keepdims=True))
            done = bool(np.abs(fresh - messages).max() < 1e-4)
            messages = fresh
            if done:
                break
        belief = local.copy()
        np.add.at(belief, dst, messages)
        return belief, done


def labelled_texts(count: int = TEXTS, seed: int = 23) -> list[list[tuple[str, str]]]:
    """Texts as lists of (words, label): personal data in common notations, often
    repeated in others or bare, among numbers that are none."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("aeiounrstlmd") for _ in range(r.randint(2, 9)))
    cue = lambda k, share: [(r.choice(sorted(CUES[k])) + r.choice([":", "", " is"]), "O")] if r.random() < share else []

    def card() -> str:
        body = str(r.randint(3, 6)) + digits(14)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def cards() -> list[tuple[str, str]]:
        number = card()
        ways = ["".join, "-".join, " ".join, ".".join, " - ".join, "/".join]
        return [(r.choice(ways)([number[k : k + 4] for k in range(0, 16, 4)]), "card") for _ in range(r.randint(1, 3))]

    def phones() -> list[tuple[str, str]]:
        if r.random() < 0.6:
            a, b, c = str(r.randint(2, 9)) + digits(2), digits(3), digits(4)
            forms = [f"+1 ({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", a + b + c, f"001 {a} {b} {c}", f"({a}){b}{c}"]
        else:
            land, area, own = r.choice(["49", "44", "33", "34"]), str(r.randint(1, 9)) + digits(r.randint(1, 2)), digits(r.randint(6, 7))
            forms = [f"+{land} {area} {own}", f"+{land}{area}{own}", f"+{land} ({area}) {own}", f"0{area} {own}", f"0{area}/{own}", f"0{area}{own}", f"0{area}-{own}", area + own, f"00{land} {area} {own}", f"(0{area}) {own[:3]} {own[3:]}"]
        got = [r.choice(forms) for _ in range(r.randint(1, 3))]
        return [(x, "phone") for x in got]

    def mails() -> list[tuple[str, str]]:
        name, host, end = f"{word()}{r.choice(['.', '_', ''])}{word()}{r.choice(['', str(r.randint(1, 99))])}", word(), r.choice(["com", "org", "de"])
        forms = [f"{name}@{host}.{end}", f"{name}@{host}.{end}".upper(), f"{name}(at){host}.{end}", f"{name} [at] {host} [dot] {end}", f"{name}@{host}"]
        return [(r.choice(forms), "email") for _ in range(r.randint(1, 3))]

    def hosts() -> list[tuple[str, str]]:
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        return [(r.choice([".".join, ".".join, "[.]".join])(parts), "ip") for _ in range(r.randint(1, 2))]

    def plain() -> list[tuple[str, str]]:
        x = r.choice([
            lambda: digits(r.randint(1, 3)), lambda: digits(4), lambda: str(r.randint(1900, 2030)), lambda: f"{digits(2)}:{digits(2)}", lambda: f"${digits(2)}.{digits(2)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 30)}",
            lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", lambda: digits(r.randint(5, 12)), lambda: f"{word()}{digits(2)}", lambda: f"{digits(2)}%", lambda: f"{word()}-{digits(4)}-{word()}",
            lambda: digits(20), lambda: digits(r.randint(13, 19)), lambda: f"{r.randint(1, 999)},{digits(3)}", lambda: f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: f"#{digits(r.randint(4, 10))}", lambda: f"{digits(4)} {digits(2)}", lambda: f"{digits(r.randint(1, 4))}-{digits(r.randint(1, 4))}",
        ])()
        return [(x, "O")] * r.choice([1, 1, 1, 2])

    out = []
    for _ in range(count):
        items: list[list[tuple[str, str]]] = []
        for _ in range(r.randint(2, 8)):
            kind = r.random()
            k, group = (0, phones()) if kind < 0.2 else (1, cards()) if kind < 0.3 else (2, hosts()) if kind < 0.37 else (3, mails()) if kind < 0.47 else (4, plain())
            items += [[*cue(k, 0.5), item] for item in group]
        r.shuffle(items)
        mixed: list[tuple[str, str]] = []
        for item in items:
            mixed += [(word(), "O") for _ in range(r.randint(1, 6))] + item + ([(",", "O")] if r.random() < 0.3 else [])
        out.append(mixed)
    return out


def learn(texts: list[list[tuple[str, str]]]) -> Field:
    """Weights by pseudo-likelihood: each label given its neighbours' labels."""
    size = len(LABELS)
    x, y, context = [], [], []
    for items in texts:
        text, spans = "", []
        for words, label in items:
            spans.append((len(text), len(text) + len(words), LABELS.index(label)))
            text += words + " "
        tokens = tokens_of(text)
        if not tokens:
            continue
        labels = [next(k for s, e, k in spans if s <= t.start < e) if next(e for s, e, k in spans if s <= t.start < e) >= t.end - 1 else 0 for t in tokens]
        near = np.zeros((len(tokens), 3, size))  # labels before, after, and at skip edges
        chain, skips = edges_of(tokens)
        for a, b in chain:
            near[b, 0, labels[a]] += 1
            near[a, 1, labels[b]] += 1
        for a, b in skips:
            near[b, 2, labels[a]] += 1
            near[a, 2, labels[b]] += 1
        x += [features(t) for t in tokens]
        y += labels
        context.append(near)
    fx, near, want = np.array(x, float), np.concatenate(context), np.eye(size)[y]
    unary, chain, skip = np.zeros((fx.shape[1], size)), np.zeros((size, size)), np.zeros((size, size))
    velocity = [np.zeros_like(unary), np.zeros_like(chain), np.zeros_like(skip)]
    for _ in range(400):
        score = fx @ unary + near[:, 0] @ chain + near[:, 1] @ chain.T + near[:, 2] @ skip
        score = np.exp(score - score.max(1, keepdims=True))
        gap = (want - score / score.sum(1, keepdims=True)) / len(fx)
        steps = [fx.T @ gap - 1e-4 * unary, near[:, 0].T @ gap + gap.T @ near[:, 1] - 1e-3 * chain, near[:, 2].T @ gap + gap.T @ near[:, 2] - 1e-3 * skip]
        for k, w in enumerate((unary, chain, skip)):
            velocity[k] = 0.9 * velocity[k] + steps[k]
            w += 0.5 * velocity[k]
    return Field(unary, chain, (skip + skip.T) / 2)


@functools.lru_cache(maxsize=1)
def field() -> Field:
    return learn(labelled_texts())


def field_spans(text: str, model: Field) -> list[Span]:
    """Spans of the labels that the field is sure of."""
    tokens = tokens_of(text)
    if not tokens:
        return []
    p = model.posteriors(tokens)
    label = p.argmax(1)
    out: list[Span] = []
    for k, t in enumerate(tokens):
        if label[k] and p[k, label[k]] >= LEAST:
            out.append(Span(f"crf_{LABELS[label[k]]}", t.start, t.end, False, float(p[k, label[k]])))
    return [s for s in out if plausible(s, text)]


def plausible(s: Span, text: str) -> bool:
    """Whether a span has what its kind can't do without."""
    value = text[s.start : s.end]
    digits = sum(c in "0123456789" for c in value)
    if s.kind == "crf_email":
        return bool(_at.search(value))
    if s.kind == "crf_ip":
        return value.count(".") == 3
    return 13 <= digits <= 19 if s.kind == "crf_card" else 7 <= digits <= 15


def scan_text(text: str | None, model: Field) -> list[Span]:
    if not text or not _marked.search(text):
        return []
    base = base_spans(text)
    found = field_spans(text, model)
    if found and base:
        by_start = sorted((b.start, b.end) for b in base)
        starts = np.array([s for s, _ in by_start])
        reach = np.maximum.accumulate([e for _, e in by_start])
        found = [s for s in found if (k := int(np.searchsorted(starts, s.end))) == 0 or reach[k - 1] <= s.start]
    return sorted(base + found, key=lambda s: (KINDS.index(s.kind), s.start))


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,posterior:double>>"
_arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("posterior", pa.float64())]))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>`` and ``found``, the spans of each whole text by kind and start."""
    kind = df.schema[id_col].dataType.simpleString()
    model = df.sparkSession.sparkContext.broadcast(field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[vars(s) for s in scan_text(t, model.value)] for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _arrow)], names=[id_col, "found"])

    small_batches(df.sparkSession)
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, found {SPANS}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``."""
    found = find_personal_data(df, id_col, text_col)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        id_col, count("email"), count("ip"), count("card"), count("phone"),
        F.sha2(_joined(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"), F.size(F.filter("found", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
