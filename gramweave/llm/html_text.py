"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat sequence of text blocks, cut at block-level tags. A block has its number of words and its link density
(words in links among all words) and those of the blocks before and after it. Further features: whether it stands in an article or main
element, beside one, in an element that is a menu, header, footer, sidebar or form, and under a heading tag; how far the innermost element that has one is named as a menu,
header, footer, sidebar, notice, advert, form or comments (not, by a part of a name, by a whole one, as comments), and the share of the page's words under that element: a
name such as social-history on the element that holds most of the page names nothing that goes. A decision tree says which blocks are the article's. It is trained on the blocks of the small labelled table that
`labelled_pages` writes by rule: pages with and without article elements and telling names. Where a page has neither, word counts and
link densities decide, so a short line between paragraphs stays and one between menus goes; of even leaves the block stays.

Pages are read in one pass, each character a bounded number of times. White space inside a block becomes one space (a line break tag is
white space), blocks without text are no blocks, and the kept blocks are joined by an empty line. Scripts, styles, comments and what a head holds
never give text. Character references are decoded once. A tag ends at the first > outside quotes; if there is none, at the first >, and
quotes are passed over in the rest of that page too; an unclosed tag at the end of a cut page is dropped. A script, style, textarea or comment that isn't
closed goes on to the end of the page, as in HTML.

Cases: a null or empty page has the empty text; a page of one huge text is one block; repeated rows are extracted each for
itself; an empty table gives an empty result; other columns are left alone, and one named like a result, in capitals or not, gives way to it.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import other_columns, slices

START = re.compile(r"</?[a-zA-Z][^\s/>]*|<!--|<[!?/]")
QUOTES = re.compile(r"[\"'>]")
#: Elements whose text is never the page's, and their ends; one that isn't closed goes on to the end of the page.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea")}
#: Elements without text of the page if they are closed, and their ends. Of an unclosed one only the tag goes.
CLOSED = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("title", "noscript", "template", "svg", "iframe", "select", "object")}
NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Elements that break the line, those that can hold blocks, and words that name what isn't the article.
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HOLDERS = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header html li main menu nav ol search section table td tr ul".split())
OTHER = frozenset("aside dialog footer form menu nav search".split())
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert banner billboard breadcrumb breadcrumbs comment comments consent cookie cookies"
    " copyright disclaimer discussion disqus dropdown footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices"
    " pager pagination paywall popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor"
    " sponsored subscribe subscription toolbar topbar trending widget".split()
)
COMMENT_NAMES = frozenset("comment comments discussion disqus replies reply respond".split())


@dataclass
class Block:
    text: str
    words: int
    linked: int
    inside: bool
    other: bool
    heading: bool
    named: int
    share: float


def named_as(rest: str, inside: bool) -> int:
    """How far a class, id or role of the tag names what isn't the article's: 0 not, 1 by a part of a name, 2 by a whole name, 3 as comments. An article's own header holds its title."""
    found = 0
    if "=" in rest:
        for name in {n for m in NAMES.finditer(rest) for n in (m[1] or m[2] or m[3] or "").lower().split()}:
            for word in re.split(r"[^a-z]+", name):
                if word in OTHER_NAMES and not (inside and word == "header"):
                    found = max(found, 3 if word in COMMENT_NAMES else 2 if word == name else 1)
    return found


def marks(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Of each tag: where it begins, where the text after it goes on, its name in small letters (empty: no tag, or one without a meaning here), whether it is an end tag, its attributes."""
    at, quotes, unclosed = 0, True, set()
    while m := START.search(page, at):
        begin, name = m.start(), m[0].lower().lstrip("</!?-")
        end_tag, at = m[0].startswith("</"), m.end()
        if not name:
            stop = page.find("-->", at) if m[0] == "<!--" else page.find(">", at)
            at = len(page) if stop < 0 else stop + (3 if m[0] == "<!--" else 1)
            yield begin, at, "", False, ""
            continue
        stop = tag_end(page, at) if quotes else page.find(">", at)
        if stop < 0 and quotes:
            quotes = False
            stop = page.find(">", at)
        if stop < 0:
            yield begin, len(page), "", False, ""
            return
        rest, at = page[at:stop], stop + 1
        if not end_tag and name in RAW:
            last = RAW[name].search(page, at)
            at, name = last.end() if last else len(page), ""
        elif not end_tag and name in CLOSED and name not in unclosed and not (name == "svg" and rest.endswith("/")):
            if last := CLOSED[name].search(page, at):
                at = last.end()
            else:
                unclosed.add(name)
            name = ""
        yield begin, at, name, end_tag, rest


def tag_end(page: str, at: int) -> int:
    """The first > outside quotes; -1 if there is none."""
    while m := QUOTES.search(page, at):
        if m[0] == ">":
            return m.start()
        at = page.find(m[0], m.end()) + 1
        if not at:
            break
    return -1


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    parts: list[str] = []
    held: list[tuple[str, bool, bool, int, int]] = []  # open holders: tag, in the article, in something else, how far it is named, number of the named element
    under: list[int] = [0]  # words under each named element
    owner: list[int] = []  # of each block
    open_: Counter[str] = Counter()
    linked = links = 0
    heading = False
    at = 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            inside, other, named, number = held[-1][1:] if held else (False, False, 0, 0)
            out.append(Block(text, len(text.split()), linked, inside, other, heading, named, 0.0))
            under[number] += out[-1].words
            owner.append(number)
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.split())

    for begin, after, tag, end_tag, rest in marks(page):
        add(page[at:begin])
        at = after
        if tag == "a":
            links = max(0, links + (-1 if end_tag else 1))
        elif tag == "br":
            parts.append(" ")
        elif tag in BREAKS:
            close()
            links = 0
            heading = not end_tag and re.fullmatch("h[1-6]", tag) is not None
            if tag not in HOLDERS:
                continue
            if end_tag:
                while open_[tag]:
                    last = held.pop()[0]
                    open_[last] -= 1
                    if last == tag:
                        break
            elif not rest.endswith("/"):
                inside, other, named, number = held[-1][1:] if held else (False, False, 0, 0)
                inside = inside or tag in ("article", "main")
                other = other or tag in OTHER or (tag == "header" and not inside)
                own = named_as(rest, inside) if tag not in ("article", "main", "body", "html") and named < 3 else 0
                if own:
                    named, number = own, len(under)
                    under.append(0)
                held.append((tag, inside, other, named, number))
                open_[tag] += 1
    add(page[at:])
    close()
    total = sum(b.words for b in out)
    for block, number in zip(out, owner, strict=True):
        if block.named:
            block.share = under[number] / total
    return out


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "in the article", "beside an article", "in something else", "heading", "named", "share of the named")


def features(found: list[Block]) -> np.ndarray:
    own = np.array([[b.words, min(1.0, b.linked / b.words)] for b in found]).reshape(-1, 2)
    if not found:
        return np.zeros((0, len(FEATURES)))
    edge = np.zeros((1, 2))
    any_inside = any(b.inside for b in found)
    flags = np.array([[b.inside, any_inside and not b.inside, b.other, b.heading, b.named, b.share] for b in found], dtype="f8").reshape(-1, 6)
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), flags])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 14, least: int = 2):
    """A decision tree by Gini impurity: a share of the article's, or (feature, limit, up to it, over it). Ties go to the first feature and limit."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        value, ones = x[order, k], np.cumsum(y[order])
        low = np.arange(1, len(y))
        able = np.flatnonzero((value[1:] > value[:-1]) & (low >= least) & (len(y) - low >= least))
        if not len(able):
            continue
        low, hits = low[able], ones[able]
        high, others = len(y) - low, ones[-1] - hits
        impurity = hits * (low - hits) / low + others * (high - others) / high
        i = int(np.argmin(impurity))
        if best is None or impurity[i] < best[0] - 1e-9:
            best = impurity[i], k, float(value[able[i]] + value[able[i] + 1]) / 2
    if best is None or best[0] >= share * (1 - share) * len(y) - 1e-9:
        return share
    _, k, limit = best
    low = x[:, k] <= limit
    return k, limit, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def article_share(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


# The words that the labelled pages are written with.
WORDS = (
    "the river rose in night and by morning lower fields were under water as far old mill people who had lived there for years said they never"
    " seen it come up so quickly or stay long before end of week roads open again market was held usual on square"
).split()


def labelled_pages(pages: int = 400, seed: int = 8) -> Iterator[tuple[str, str]]:
    """The labelled table, written by rule: pages, and for each a letter a block: y (the article's) or n.

    A third has an article or main element, a third tells by names what isn't the article, and a third is bare markup.
    """
    r = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join(r.choice(WORDS) for _ in range(r.randint(low, high)))

    def link(text: str) -> str:
        return f"<a href=x>{text}</a>"

    def menu() -> list[tuple[str, str]]:
        if r.random() < 0.3:
            return [("<p>" + " | ".join(link(words(1, 2)) for _ in range(r.randint(3, 7))) + "</p>", "n")]
        n = r.randint(3, 7)
        return [("<ul>" + "".join(f"<li>{link(words(1, 3))}</li>" for _ in range(n)) + "</ul>", "n" * n)]

    def teasers() -> list[tuple[str, str]]:
        return [(f"<h3>{words(1, 3)}</h3>", "n"), *((f"<p>{link(words(4, 12))}</p>", "n") for _ in range(r.randint(2, 5)))]

    def prose() -> tuple[str, str]:
        text = words(18, 110)
        if r.random() < 0.25:
            text = f"{words(5, 40)} {link(words(1, 5))} {text}"
        return f"<p>{text}</p>", "y"

    def article(kind: str) -> list[tuple[str, str]]:
        out = [(f"<h1>{words(2, 12)}</h1>", "y")] if r.random() < 0.85 else []
        if r.random() < 0.3:
            out.append((f"<p>{words(2, 6)}</p>", "y"))
        for _ in range(r.randint(1, 8)):
            out.append(prose())
            if kind == "element" and r.random() < 0.3:
                out.append((f"<p>{link(words(1, 12))}</p>", "y"))
            turn = r.random()
            if turn < 0.15:
                out.append((f"<h2>{words(1, 6)}</h2>", "y"))
            elif turn < 0.4:
                out.append((f"<p>{words(1, 12)}</p>", "y"))
            elif turn < 0.5:
                n = r.randint(2, 4)
                out.append(("<ul>" + "".join(f"<li>{words(2, 14)}</li>" for _ in range(n)) + "</ul>", "y" * n))
            elif turn < 0.55:
                out.append((f"<blockquote>{words(8, 30)}</blockquote>", "y"))
            elif turn < 0.6:
                out += [(f"<p>{words(3, 8)} {link(words(2, 4))}</p>", "y"), prose()]
        return out

    def put(tag: str, name: str, inside: list[tuple[str, str]]) -> list[tuple[str, str]]:
        return [(f"<{tag}{name and f' class={name}'}>", ""), *inside, (f"</{tag}>", "")]

    for number in range(pages):
        kind = ("element", "named", "bare")[number % 3]
        name = lambda x: x if kind == "named" or (kind == "element" and r.random() < 0.5) else ""  # noqa: E731, B023
        tag = lambda x: x if kind == "element" else "div"  # noqa: E731, B023
        top = [(f"<p>{words(1, 8)}</p>", "n")] if r.random() < 0.6 else []
        out = [] if r.random() < 0.25 else put(tag("header"), "masthead" if kind == "named" else "", top + menu()) if r.random() < 0.5 else put(tag("nav"), "menu" if kind == "named" else "", menu())
        body = article(kind)
        if r.random() < 0.1:  # a short text, and nothing beside it
            body = [(f"<p>{words(1, 30)}</p>", "y") for _ in range(r.randint(1, 3))]
            yield "".join(x for x, _ in body), "".join(x for _, x in body)
            continue
        if kind != "bare":
            extra = [
                put("div", "ad", [(f"<p>{words(4, 15)}</p>", "n")]),
                put("div", "cookie-notice", [(f"<p>{words(12, 40)}</p>", "n"), (f"<p>{words(1, 2)}</p>", "n")]),
                put("form", "", [(f"<p>{words(5, 20)}</p>", "n"), (f"<p>{words(1, 3)}</p>", "n")]),
                put("div", "share", [(f"<p>{link(words(1, 2))} {link(words(1, 2))}</p>", "n")]),
                put("section", r.choice(("comments", "comment-list")), [(f"<h3>{words(1, 3)}</h3>", "n"), *((f"<p>{words(*n)}</p>", "n") for _ in range(r.choice((1, 1, 2, 9))) for n in ((1, 3), (5, 80)))]),
            ]
            if (turn := r.random()) < 0.25:  # names that say nothing, as they stand at what most of the page's words are under
                name_of = f"{r.choice(sorted(OTHER_NAMES - COMMENT_NAMES))}-{r.choice(WORDS)}" if turn < 0.15 or kind != "element" else "'notice share'"
                body = put("section", name_of, [*body, *(prose() for _ in range(6))])
            for part in r.sample(extra, r.randint(1, 3)):
                place = r.randint(1, len(body))
                if r.random() < 0.5:
                    body[place:place] = part
                else:
                    out += part
        if r.random() < 0.4:
            out += put(tag("aside"), name("sidebar") if kind != "bare" else "", teasers())
        out += put(("article", "main")[number % 2], "", body) if kind == "element" else put("div", "", body) if r.random() < 0.7 else body
        if r.random() < 0.5:
            out += put("div", "related" if kind != "bare" else "", teasers())
        last = menu() + ([(f"<p>{words(3, 14)}</p>", "n")] if r.random() < 0.7 else [])
        if r.random() < 0.7:
            out += put(tag("footer"), "footer" if kind == "named" else "", last)
        yield "".join(x for x, _ in out), "".join(x for _, x in out)


LABELLED = tuple(labelled_pages())


@lru_cache(1)
def tree():
    """The tree trained on LABELLED."""
    x, y = [], []
    for page, labels in LABELLED:
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(found)} blocks")
        x.append(features(found))
        y += [c == "y" for c in labels]
    return grow(np.vstack(x), np.array(y))


def main_text(page: str | None, own=None) -> str:
    """The text of the blocks that the tree (own, if given) says are the article's."""
    found = blocks(page or "")
    own = tree() if own is None else own
    return "\n\n".join(b.text for b, row in zip(found, features(found), strict=True) if article_share(own, row) >= 0.5)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of pages but the html, with text and n_chars (code points) instead; columns of these names are replaced."""
    kept = other_columns(pages, html_col, "text", "n_chars")
    own = tree()  # trained once, here

    def work(batches):
        for batch in slices(batches):
            texts = [main_text(p, own) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    rows = pages.select(*[F.col(f"`{c}`") for c in kept])
    return pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html_col)).mapInArrow(work, rows.schema.add("text", "string").add("n_chars", "long"))
