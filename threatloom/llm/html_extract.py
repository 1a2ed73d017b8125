"""Main text of web pages: a maximum-scoring subsequence of words and tags.

A page becomes a sequence of words and tags.  Words score positive and tags
negative, with weights learned from labelled pages (:func:`labelled_pages` writes
them from templates, with a label for each word).  A word's weight is the log odds
of a logistic regression over what is around it: elements such as menus and forms,
the words of class, id and role of containers (apart inside and outside of the main
element; names of paragraphs, headings, items and inline elements tell what the text
is about, not its place, and say nothing), links, and the share of links in its
block.  A name that the labelled pages lack weighs nothing.  A tag's weight is the
log odds of tags of its name inside and outside of content.

One linear scan finds the contiguous region with the greatest sum.  Words inside it
that are more likely boilerplate than content (an advert or a comment inside the
article) are left out, and score nothing, lest text after a long one be lost.  What
no reader sees is no text: scripts, styles, drawings, templates, option lists
(``ASIDE``) and what is marked as hidden.

Defined cases: null and empty html, and pages without content, give an empty
text; unclosed and stray tags are tolerated (only comments and raw text, such as
scripts, reach to the end of the page if they are not closed); html is read whole, however long;
repeated rows give repeated results; of regions with equal sums the first is taken;
rows with null ids keep them; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import functools
import html as htmllib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threatloom.llm.common import slices, small_batches, strings

#: Labelled pages that the weights are learned from.
PAGES = 500

_token = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|iframe|textarea|title)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:(?<=/)>|>.*?(?:</\1(?=[\s/>])[^>]*>|\Z))"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
_attribute = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?""")
_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text joins that around it; all others end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no text of the page; those that are never closed hold nothing.
ASIDE = frozenset("script style iframe textarea title noscript template svg select annotation annotation-xml".split())
#: Markup inside a formula, which neither ends blocks nor counts.
FORMULA = frozenset("annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
#: Elements that are a sign of their own for the text in them.
SIGNS = frozenset("nav menu footer aside form dialog head fieldset header button".split())
#: Elements whose names (class, id, role) are no sign.
TEXTUAL = INLINE | frozenset("html body p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption figcaption blockquote pre figure img br button input option main article".split())
#: Classes that hide an element; as parts of a longer name they say nothing.
HIDING = frozenset(("hidden", "invisible"))


def stem(word: str) -> str:
    """A name's word without the plural's end."""
    return word[:-1] if len(word) > 2 and word.endswith("s") else word


def signs_of(name: str, attributes: str) -> tuple[frozenset[str], str | None]:
    """The words of an element's names, and ``hidden`` or ``main`` if it says so."""
    words: set[str] = set()
    kind = "main" if name in ("main", "article") else None
    for m in _attribute.finditer(attributes):
        key, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return frozenset(), "hidden"
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return frozenset(), "hidden"
        elif key in ("class", "id", "role"):
            if key == "role" and value.lower() in ("main", "article"):
                kind = "main"
            if key == "class" and not HIDING.isdisjoint(value.lower().split()):
                return frozenset(), "hidden"
            words.update(w.lower() for w in _parts.findall(value))
    return frozenset(words), kind


class Run:
    """Text between two tags: the signs around it, whether it is a link, and its block."""

    __slots__ = ("block", "link", "main", "signs", "text")

    def __init__(self, text: str, signs: frozenset[str] | None, main: bool, link: bool, block: int):
        self.text, self.signs, self.main, self.link, self.block = text, signs, main, link, block


Place = tuple[frozenset | None, bool, int, frozenset]  # signs (None: hidden), in main, aside, names around
NOWHERE: Place = (frozenset(), False, 0, frozenset())


def entered(name: str, attributes: str, around: Place, aside: int) -> tuple[Place, bool]:
    """The place within an element, and whether that is the main one."""
    signs, main, _, names = around
    own, kind = signs_of(name, attributes)
    words = frozenset(map(stem, own))
    if signs is None or kind == "hidden":
        return (None, main, aside, words), False
    # an article named like what is around it is one of its items
    if kind == "main" and not main and not (words & names and signs):
        return (frozenset(f"a:.{w}" for w in own), True, aside, words), True
    level = "m:" if main else "o:"
    more = {level + name} if name in SIGNS else set()
    if name not in TEXTUAL or kind == "main":
        more |= {f"{level}.{w}" for w in words}
    return (signs | more if more else signs, main, aside, names | words if words else names), False


def read(page: str) -> tuple[list[Run | str], bool]:
    """The page as runs of text and names of tags, and whether it has a main element."""
    out: list[Run | str] = []
    stack: list[tuple[str, Place]] = []
    asides: list[int] = [0]  # the aside around each; number 0 is the page
    inside: list[int] = []  # aside of each item of ``out``
    closed: set[int] = set()
    place = NOWHERE
    links = has_main = False
    at, block, formulas = 0, 0, 0

    def add(item: Run | str) -> None:
        out.append(item)
        inside.append(place[2])

    def text(upto: int) -> None:
        if upto > at and (s := page[at:upto]):
            add(Run(s, place[0], place[1], links, block))

    for m in _token.finditer(page):
        text(m.start())
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:  # comment, doctype, or an element that is no text at all
            if m[1]:
                block += m[1].lower() not in INLINE
                add(m[1].lower())
            continue
        closing, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        if not formulas or name not in FORMULA:
            block += name not in INLINE
            if not (closing and name in ASIDE):
                add(name)
        if closing:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                if name in ASIDE:
                    closed.add(stack[depth][1][2])
                formulas -= sum(e[0] == "math" for e in stack[depth:])
                del stack[depth:]
                place = stack[-1][1] if stack else NOWHERE
        elif name not in VOID and not attributes.endswith("/"):
            if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
                stack.pop()
                place = stack[-1][1] if stack else NOWHERE
            if name not in INLINE and name not in ASIDE:  # a button that was not closed ends where a block begins
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in INLINE), None)
                if depth is not None and stack[depth][0] == "button" and name not in ("button", "img", "canvas"):
                    del stack[depth:]
                    place = stack[-1][1] if stack else NOWHERE
            formulas += name == "math"
            if name in ASIDE:
                asides.append(place[2])
                place = (*place[:2], len(asides) - 1, place[3])
            else:
                place, is_main = entered(name, attributes, place, place[2])
                has_main |= is_main
                if is_main:
                    place = (place[0], True, 0, place[3])
            stack.append((name, place))
        if name == "a":
            links = not closing
    text(len(page))
    if closed:
        left = [False] * len(asides)
        for k in range(1, len(asides)):
            left[k] = k in closed or left[asides[k]]
        out = [t for t, k in zip(out, inside, strict=True) if not left[k]]
    return out, has_main


def dense_blocks(tokens: list[Run | str]) -> set[int]:
    """Blocks half of whose words or more are links."""
    words, linked = Counter(), Counter()
    for t in tokens:
        if not isinstance(t, str):
            n = len(t.text.split())
            words[t.block] += n
            linked[t.block] += n * t.link
    return {k for k, n in linked.items() if n and 2 * n >= words[k]}


def features(t: Run, has_main: bool, dense: bool) -> frozenset[str]:
    """What the weight of a run's words depends on."""
    level = "m" if t.main else "o" if has_main else "p"  # in main, beside one, on a page without one
    out = {level, *(t.signs or ())}
    if dense:
        out.add(f"{level}-links")
        if any(x[1:3] == ":." and x[0] != "a" for x in t.signs or ()):
            out.add(f"{level}-named-links")
    return frozenset(out)


class Weights:
    """Log odds of content, for words by their features and for tags by name."""

    def __init__(self, pages: list[tuple[str, list[str]]]):
        runs: Counter = Counter()  # features and label
        tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for page, content in pages:
            wanted, inside = set(content), False
            tokens, has_main = read(page)
            dense = dense_blocks(tokens)
            for t in tokens:
                if isinstance(t, str):
                    tags[inside][t] += 1
                elif (w := htmllib.unescape(t.text).split()) and t.signs is not None:
                    inside = w[0] in wanted
                    runs[features(t, has_main, t.block in dense), inside] += 1
        total = {k: sum(c.values()) + 1 for k, c in tags.items()}
        self.tags = {k: min(-0.02, math.log((tags[True][k] + 0.5) / total[True]) - math.log((tags[False][k] + 0.5) / total[False])) for k in {*tags[True], *tags[False]}}
        self.words = self._fitted(runs)
        self.known: dict[frozenset[str], float] = {}

    @staticmethod
    def _fitted(runs: Counter) -> dict[str, float]:
        """Logistic regression, by gradient steps with momentum."""
        names = sorted({f for found, _ in runs for f in found})
        at = {f: k for k, f in enumerate(names)}
        ordered = sorted(runs, key=lambda r: (sorted(r[0]), r[1]))
        x = np.zeros((len(ordered), len(names)))
        for k, (found, _) in enumerate(ordered):
            x[k, [at[f] for f in found]] = 1
        y = np.array([label for _, label in ordered], float)
        n = np.sqrt(np.array([runs[r] for r in ordered], float))  # common patterns count more, but not by their number
        n /= n.sum()
        w, speed = np.zeros(len(names)), np.zeros(len(names))
        for _ in range(3000):
            gap = n * (y - 1 / (1 + np.exp(-x @ w)))
            speed = 0.95 * speed + x.T @ gap - 1e-5 * w
            w += 2.0 * speed
        return dict(zip(names, w.tolist(), strict=True))

    def word(self, found: frozenset[str]) -> float:
        odds = self.known.get(found)
        if odds is None:
            if len(self.known) > 10_000:
                self.known.clear()
            odds = self.known[found] = sum(self.words.get(f, 0.0) for f in sorted(found))
        return min(max(odds, 0.0), 4.0)

    def tag(self, name: str) -> float:
        return max(-0.5, self.tags.get(name, -0.1))


#: Names of containers that hold boilerplate, by kind, and of such that hold content.
BOILERPLATE = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager skip main-menu site-nav nav-links",
    "header": "header site-header page-header masthead topbar banner siteheader top-bar",
    "footer": "footer site-footer page-footer colophon copyright contentinfo",
    "sidebar": "sidebar widget widgets related related-posts recommended recommendations trending popular complementary side-bar sidebar-left",
    "notice": "cookie cookies cookie-notice cookie-banner consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription paywall disclaimer",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion adsbygoogle ad-slot",
    "form": "form login signin signup sign-up register search searchbox search-form",
    "comments": "comments comment-list disqus replies respond discussion user-comments comments-area",
    "share": "share sharing social sharebar share-buttons",
}
CONTENT = "content entry entry-content post post-body text body article-body story section chapter wrapper container row col main-content panel tabs tab toc gallery box inner page block lead summary intro quote figure note".split()


def labelled_pages(count: int = PAGES, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Pages in several layouts, each with the words of its content.  Content
    words begin with ``c``, all others with ``x``, so words tell the label."""
    r = random.Random(seed)
    pick = lambda *kinds: r.choice(BOILERPLATE[r.choice(kinds)].split())
    every = [n for names in BOILERPLATE.values() for n in names.split()]

    def words(kind: str, low: int, high: int) -> str:
        return " ".join(f"{kind}{r.randrange(10**6)}" for _ in range(r.randint(low, high)))

    def named(name: str) -> str:
        return r.choice(['class="{}"', 'id="{}"', "class='x1 {}'"]).format(name) if name else ""

    def about(share: float = 0.15) -> str:
        """A name of a paragraph or heading: of its subject, whatever that is."""
        return " " + named(r.choice(every + CONTENT)) if r.random() < share else ""

    def menu(kind: str = "x", least: int = 3) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(kind, 1, 3)}</a></li>' for k in range(r.randint(least, 9))) + "</ul>"

    def filling() -> str:
        return r.choice([lambda: words("x", 3, 25), menu, lambda: f"<p{about()}>{words('x', 3, 30)}</p>", lambda: f"<h3>{words('x', 1, 3)}</h3>{menu()}", lambda: f"<span>{words('x', 1, 5)}</span><a>{words('x', 1, 2)}</a>", lambda: f"<button>{words('x', 1, 2)}</button>"])()

    def extra() -> str:
        kind = r.choice(["menu", "sidebar", "notice", "advert", "form", "share"])
        tag = r.choice(["div", "div", "section", {"sidebar": "aside", "form": "form", "menu": "nav"}.get(kind, "div")])
        name = r.choice(BOILERPLATE[kind].split())
        if r.random() < 0.2 and tag in ("aside", "form", "nav"):
            name = ""
        label = f"<label>{words('x', 1, 5)}</label><input>" if tag == "form" else ""
        return f"<{tag} {named(name)}>{filling()}{label}</{tag}>"

    def comments() -> str:
        tag, item, name = r.choice([("div", "div", "comment"), ("section", "article", "comment"), ("ul", "li", "reply"), ("div", "article", "comment")])
        body = "".join(f'<{item} class="{name}"><p>{words("x", 3, 40)}</p></{item}>' for _ in range(r.randint(1, 5)))
        return f"<{tag} {named(pick('comments'))}>{body}</{tag}>"

    def prose(depth: int = 0) -> str:
        parts = []
        for _ in range(r.randint(2, 10) if not depth else r.randint(1, 3)):
            kind = r.random()
            if kind < 0.5:
                link = f' <a href="#">{words("c", 1, 3)}</a> {words("c", 3, 20)}' if r.random() < 0.3 else ""
                parts.append(f"<p{about()}>{words('c', 1, 60)}{link}</p>")
            elif kind < 0.58:
                parts.append("<ul>" + "".join(f"<li{about()}>{words('c', 1, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.62:
                parts.append(menu("c", 2))
            elif kind < 0.68:
                parts.append(f"<h2{about(0.3)}>{words('c', 1, 6)}</h2><p><b>{words('c', 1, 5)}</b> {words('c', 5, 40)}<br>{words('c', 5, 20)}</p>")
            elif kind < 0.74:
                parts.append("<table>" + "".join(f"<tr><td{about()}>{words('c', 1, 3)}</td><td>{words('c', 1, 3)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>")
            elif kind < 0.86 and depth < 2:
                parts.append(f"<{(tag := r.choice(['div', 'section', 'div']))} {named(r.choice(CONTENT))}>{prose(depth + 1)}</{tag}>")
            elif kind < 0.94:
                parts.append(extra())
            else:
                parts.append(f"<blockquote{about()}>{words('c', 4, 30)}</blockquote>")
        return "".join(parts)

    def heading() -> str:
        title = f"<h1{about()}>{words('c', 2, 9)}</h1>"
        return r.choice([title, title, f"<header>{title}<p>{words('c', 1, 6)}</p></header>", f'<div class="header">{title}</div>'])

    pages = []
    for _ in range(count):
        plain = f"<div {named(r.choice(CONTENT))}>{{}}</div>"
        shell = r.choice(["<article{}>{{}}</article>".format(about(0.3)), "<main>{}</main>", "<main><article>{}</article></main>", '<div role="main">{}</div>', plain, plain])
        page = f"<html><head><title>{words('x', 2, 8)}</title></head><body{about()}>"
        page += r.choice([f"<header>{words('x', 1, 5)}</header>", f"<div {named(pick('header'))}>{filling()}</div>", ""])
        page += r.choice([f"<nav>{menu()}</nav>", f"<div {named(pick('menu'))}>{menu()}</div>", f"<ul {named(pick('menu'))}><li><a>{words('x', 1, 2)}</a></li></ul>"])
        body = heading() + prose()
        body = shell.format(body + (comments() if r.random() < 0.25 else ""))
        if r.random() < 0.3:
            body = f"<div {named(r.choice(CONTENT))}>{body}</div>"
        page += (extra() if r.random() < 0.6 else "") + body + (comments() if r.random() < 0.4 else "") + (extra() if r.random() < 0.5 else "")
        page += (f"<div {named(pick('sidebar'))}>{filling()}<p>{words('x', 3, 30)}</p></div>" if r.random() < 0.4 else "")
        page += r.choice([f"<footer><p>{words('x', 3, 20)}</p></footer>", f"<div {named(pick('footer'))}>{filling()}</div>"]) + "</body></html>"
        if shell is not plain and r.random() < 0.4:  # text beside a main element is none of it
            page = page.replace("</head>", "</head>", 1).replace(body, f"<div>{words('x', 1, 15)}</div>{body}<div>{words('x', 1, 30)}</div>", 1)
        pages.append((page, re.findall(r"\bc\d+", page)))
    return pages


@functools.lru_cache(maxsize=1)
def weights() -> Weights:
    return Weights(labelled_pages())


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end (exclusive) of the contiguous run with the greatest positive sum."""
    best, begin, end = 0.0, 0, 0
    total, start = 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, begin, end = total, start, k + 1
    return begin, end


def extract(page: str | None, w: Weights) -> str:
    """The page's main text."""
    if not page:
        return ""
    tokens, has_main = read(page)
    dense = dense_blocks(tokens)
    scores, kept = [], []
    for t in tokens:
        if isinstance(t, str):
            scores.append(w.tag(t))
            kept.append(False)
        else:
            weight = w.word(features(t, has_main, t.block in dense)) if t.signs is not None else 0.0
            scores.append(len(t.text.split()) * weight)
            kept.append(weight > 0)
    begin, end = best_region(scores)
    blocks: list[str] = []
    last = None
    for t, keep in zip(tokens[begin:end], kept[begin:end], strict=True):
        if not keep:
            continue
        if t.block == last:
            blocks[-1] += t.text
        else:
            blocks.append(t.text)
            last = t.block
    return " ".join(x for b in blocks if (x := " ".join(htmllib.unescape(b).split())))


def main_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` and ``text, n_chars`` for each row of ``df``."""
    rows = df.select(*keep, html_col)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights()
        for batch in slices(batches):
            texts = [extract(x, w) for x in strings(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    small_batches(df.sparkSession)
    return rows.mapInArrow(run, f"{fields}, text string, n_chars long")
