"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks of text at block-level tags.  A block is
described by its own and its neighbours' word counts and link densities, and by
where it stands: inside an article or main element or one whose class or id
names content; inside an element that is furniture by its name, hidden or a
comment section; inside an element whose class or id holds a word that often
names furniture (menu, notice, form ...), with that element's number of words,
link density and share of the page's text, and whether it is the block's own
paragraph; as a heading.  A small decision tree decides which blocks are main
text.  It is trained on a labelled table of blocks that is laid out by rule:
content and furniture pieces of many kinds, put together as pages, in which such
words also name long parts of the text.

The page is read by one pass of a regular expression over its tags, whatever
their depth; unclosed and stray tags are tolerated.  Scripts, styles and other raw elements hold no
text.  A line break inside a block is white space.

Defined cases: null, empty or text-less html gives the empty text; character
references are decoded once, an unknown one stays as written; a page cut off in
the middle of a tag or comment ends there; repeated rows give one row each; an
empty table gives an empty table; other columns are ignored; very long pages
are read whole, in linear time.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z|(?=<))"
    r"|<(?:/?[a-zA-Z][^<>]*)(?:>|\Z|(?=<))", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element names of HTML by their role here.
RAW = frozenset("script style template svg math iframe object canvas audio video title textarea head noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark q rb rp rt
    ruby s samp small span strike strong sub sup time tt u var wbr img br input picture output meter progress""".split())
FURNITURE = frozenset("nav footer aside form menu dialog button select noscript fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in a class, id or role that name page furniture, reader comments, content.
FURNITURE_WORDS = frozenset("""ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored
    sponsors promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side aside
    complementary footer foot contentinfo masthead topbar toolbar cookie cookies consent gdpr notice notices
    notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login
    signin register share sharing social related recommended recommendations teaser widget widgets pagination
    pager skip copyright legal disclaimer search form outbrain taboola paywall tooltip""".split())
HEADER_WORDS = frozenset("header hdr pageheader siteheader".split())
COMMENT_WORDS = frozenset("comment comments commentlist commenter disqus guestbook".split())
REPLY_WORDS = frozenset("reply replies respond discussion feedback".split())
CONTENT_WORDS = frozenset("content article post entry story body text main page prose".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "page_has_main",
            "firm", "listed", "own", "box_words", "box_links", "box_share", "heading")
_TEXT_LEVEL = HEADINGS | frozenset("p li dd dt td th blockquote pre figcaption".split())


@dataclass(frozen=True)
class _Place:
    """Where text stands; ``box`` numbers the innermost element around it with a
    listed word (-1: none), ``own`` says that this is the paragraph itself."""

    article: bool = False
    content: bool = False
    firm: bool = False
    box: int = -1
    own: bool = False
    heading: bool = False
    link: bool = False


@dataclass
class Block:
    text: str
    words: int
    linked: int
    place: _Place


def _named(attrs: str) -> tuple[set[str], bool]:
    """Words of class, id and role; whether the element is hidden."""
    words: set[str] = set()
    hidden = re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs) is not None
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key in ("class", "id", "role"):
            words.update(w.lower() for w in _NAME_PART.findall(value))
            words.update(value.lower().split())
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif key == "aria-hidden" and value.lower() == "true":
            hidden = True
    return words, hidden


def _inside(p: _Place, name: str, attrs: str, box: int) -> _Place:
    """The place inside an element; ``box`` numbers the element if a listed word names it."""
    words, hidden = _named(attrs) if "=" in attrs or "hidden" in attrs else (frozenset(), False)
    named = name not in ("body", "html") and bool(
        words & FURNITURE_WORDS or words & REPLY_WORDS or (words & HEADER_WORDS and not p.article))
    firm = (p.firm or hidden or name in FURNITURE or (name == "header" and not p.article)
            or (bool(words & COMMENT_WORDS) and name not in ("body", "html")))
    opens = name in ("article", "main") or "main" in words and name in ("div", "section", "td")
    held, own = p.box if not opens else -1, named
    return _Place(p.article or name in ("article", "main"), p.content or bool(words & CONTENT_WORDS), firm,
                  box if own else held, name in _TEXT_LEVEL if own else p.own and held >= 0,
                  p.heading or name in HEADINGS, p.link or name == "a")


class _Open:
    """The open elements, with how many there are of each name: a closing tag
    without an opening one costs no search."""

    def __init__(self):
        self.stack: list[tuple[str, _Place]] = [("", _Place())]
        self.count: Counter = Counter()
        self.boxes = 0

    @property
    def place(self) -> _Place:
        return self.stack[-1][1]

    def push(self, name: str, attrs: str) -> None:
        place = _inside(self.place, name, attrs, self.boxes)
        self.boxes += place.box == self.boxes
        self.push_place(name, place)

    def push_place(self, name: str, place: _Place) -> None:
        self.stack.append((name, place))
        self.count[name] += 1

    def cut(self, at: int) -> None:
        """Closes the element at ``at`` and all inside it."""
        for name, _ in self.stack[at:]:
            self.count[name] -= 1
        del self.stack[at:]

    def find(self, name: str) -> int:
        """The innermost open element of a name; 0 if there is none."""
        if self.count[name]:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == name:
                    return i
        return 0

    def end_link(self) -> None:
        at = self.find("a")
        if at:
            self.count["a"] -= 1
            del self.stack[at]


def blocks(page: str) -> tuple[list[Block], bool]:
    """Flat text blocks in page order; whether the page has an article."""
    out: list[Block] = []
    open_ = _Open()
    held: list[str] = []
    linked, has_article = 0, False

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            n = text.count(" ") + 1
            out.append(Block(text, n, min(linked, n), open_.place))
        held.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            held.append(text)
            if open_.place.link:
                linked += len(text.split())

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        attrs = m["attrs"] or ""
        if name in RAW and name != "head":
            if not m["close"] and not attrs.endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name in INLINE or name == "head":
            if name == "br":
                held.append(" ")
            elif name == "a":
                if m["close"] or not attrs.endswith("/"):
                    open_.end_link()                             # a link also ends where the next one starts
                if not m["close"] and not attrs.endswith("/"):
                    open_.push_place("a", _inside(open_.place, "a", "", -1))
            elif name in ("span", "label", "small", "time") and "=" in attrs and not m["close"]:
                inner = _inside(open_.place, name, attrs, open_.boxes)
                if (inner.firm and not open_.place.firm) or inner.box != open_.place.box:
                    flush()                                      # an advert or a notice in the running text
                    open_.push(name, attrs)
            elif m["close"] and open_.stack[-1][0] == name:
                flush()
                open_.cut(len(open_.stack) - 1)
            continue
        flush()
        if m["close"]:
            i = open_.find(name)
            if i:
                open_.cut(i)
            continue
        if name in VOID or attrs.endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):   # implied ends
            stack = open_.stack
            for i in range(len(stack) - 1, max(0, len(stack) - 8), -1):
                if stack[i][0] == name or (stack[i][0] == "p"):
                    open_.cut(i)
                    break
                if stack[i][0] not in ("a", "p", "li", "dt", "dd", "td", "th", "tr", "option"):
                    break
        open_.push(name, attrs)
        has_article = has_article or (name in ("article", "main") and not (open_.place.firm or open_.place.box >= 0))
    flush()
    return out, has_article


def features(found: list[Block], has_article: bool) -> np.ndarray:
    """One row per block, columns as in ``FEATURES``.  The main part of a page is
    its article or main element, else what a class or id names as content."""
    words = np.array([0, *(b.words for b in found), 0], float)
    links = np.array([0, *(b.linked / b.words for b in found), 0], float)
    flag = lambda name: np.array([float(getattr(b.place, name)) for b in found])
    firm, content, box = flag("firm"), flag("content"), np.array([b.place.box for b in found])
    listed = box >= 0
    in_main = flag("article") if has_article else content
    has_main = has_article or bool((content * (1 - firm) * ~listed).any())
    own, linked = words[1:-1] * (1 - firm), np.array([b.linked for b in found], float) * (1 - firm)
    of_main = own * in_main if has_main else own
    size = np.bincount(box[listed], own[listed], minlength=1) if listed.any() else np.zeros(1)
    held = np.bincount(box[listed], linked[listed], minlength=len(size)) if listed.any() else np.zeros(1)
    at = np.where(listed, box, 0)
    box_words = np.where(listed, size[at], 0)
    return np.stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], in_main,
                     np.full(len(found), float(has_main)), firm, listed.astype(float), flag("own") * listed, box_words,
                     np.where(listed, held[at] / np.maximum(size[at], 1), 0), box_words / max(of_main.sum(), 1), flag("heading")],
                    axis=1)


# A labelled piece: html with a {t} for its text, whether it is main text, and how many words it may have.
_CONTENT = [("<p>{t}</p>", 1, 60), ("<p>{t}</p>", 20, 120), ("<p><b>{t}<br>", 1, 30), ("<h2>{t}</h2>", 1, 8),
            ("<ul><li>{t}</li></ul>", 2, 20), ("<blockquote>{t}</blockquote>", 5, 40), ("<div>{t}</div>", 15, 80),
            ("<p>{t} <a href='/x'>more</a> {t}</p>", 10, 40)]
_FURNITURE = [("<nav><ul><li><a href='/x'>{t}</a></li></ul></nav>", 1, 3), ("<header><a href='/x'>{t}</a></header>", 1, 5),
              ("<header><p>{t}</p></header>", 1, 12), ("<footer>{t}</footer>", 2, 25), ("<aside><p>{t}</p></aside>", 2, 60),
              ("<div class='sidebar'><p>{t}</p></div>", 2, 60), ("<div class='ad'>{t}</div>", 2, 20),
              ("<div id='cookie-notice'>{t}</div>", 5, 30), ("<form><label>{t}</label></form>", 1, 6),
              ("<section class='comments'><p>{t}</p></section>", 2, 90), ("<div id='respond'>{t}</div>", 2, 40),
              ("<p class='notice'>{t}</p>", 2, 9), ("<p class='share'><a href='/x'>{t}</a></p>", 2, 9),
              ("<ul class='related'><li><a href='/x'>{t}</a></li></ul>", 2, 9), ("<div class='menu'>{t}</div>", 1, 5)]
# Parts of the main text whose class or id holds a listed word; each {t} is a block.
_LISTED = [("<p class='notice-of-motion'>{t}</p>", 14, 70), ("<h2 id='legal-form'>{t}</h2><p>{t}</p>", 14, 40),
           ("<section id='discussion'><h2>{t}</h2><p>{t}</p><p>{t}</p><p>{t}</p></section>", 22, 90),
           ("<div class='feedback-loop'><p>{t}</p><p>{t}</p></div>", 40, 90)]
# On pages without an article element: text with no sign around it.
_BARE = [("<p>{t}</p>", 12, 120, 1), ("<div>{t}</div>", 15, 80, 1), ("<h1>{t}</h1>", 2, 9, 1),
         ("<div><a href='/x'>{t}</a></div>", 1, 6, 0), ("<div><a href='/x'>{t}</a> <a href='/y'>{t}</a></div>", 1, 4, 0)]


def labelled_table(pages: int = 2_000, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of the blocks of pages laid out by rule."""
    rnd, rows, labels = random.Random(seed), [], []

    def piece(form: str, low: int, high: int) -> str:
        return re.sub(r"\{t\}", lambda _: " ".join("w" * rnd.randint(2, 8) for _ in range(rnd.randint(low, high))), form)
    for k in range(pages):
        if k % 4 == 3:
            parts = [(piece(f, a, b), y) for f, a, b, y in rnd.choices(_BARE, k=rnd.randint(4, 12))]
            parts.insert(rnd.randint(1, len(parts)), ("<p>" + piece("{t}", 20, 60) + "</p><p>" + piece("{t}", 1, 6) + "</p><p>"
                                                      + piece("{t}", 20, 60) + "</p>", 3))
            parts += [(piece(*f), 0) for f in rnd.choices(_FURNITURE, k=2)]
            parts.append(("<div>" + piece("{t}", 1, 6) + "</div>", 0) if rnd.random() < 0.5 else (piece("<p>{t}</p>", 12, 90), 1))
            page, want = "<body>" + "".join(x for x, _ in parts) + "</body>", [v for _, y in parts for v in [min(y, 1)] * max(y, 1)]
        else:
            front, inner, back = (rnd.choices(_FURNITURE, k=n) for n in (2, rnd.randint(0, 2), 3))
            body = [(piece(*f), 1) for f in [("<h1>{t}</h1>", 2, 10), *rnd.choices(_CONTENT, k=rnd.randint(1, 10))]]
            for f in inner:
                if not f[0].startswith("<header"):
                    body.insert(rnd.randint(1, len(body)), (piece(*f), 0))
            if k % 5 < 2:
                f = rnd.choice(_LISTED)
                body.insert(rnd.randint(1, len(body)), (piece(*f), f[0].count("{t}")))
            if k % 7 == 2:                           # one element around all of the text
                body[1:] = [("<div class='long-form'>" + body[1][0], body[1][1]), *body[2:]]
                body.append(("</div>", None))
            open_, close = (("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post-content'>", "</div>"))[k % 3]
            before, after = [(piece(*f), 0) for f in front], [(piece(*f), 0) for f in back]
            loose = [("<div>" + piece("{t}", 2, 30) + "</div>", 0)]
            page = "".join(x for x, _ in before) + open_ + "".join(x for x, _ in body) + close + "".join(
                x for x, _ in loose + after)
            want = [v for _, y in before + body + loose + after if y is not None for v in [min(y, 1)] * max(y, 1)]
        found, has_article = blocks(page)
        if len(found) == len(want):
            rows.append(features(found, has_article))
            labels.append(np.array(want, float))
    return np.concatenate(rows), np.concatenate(labels)


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 4):
    """A decision tree by Gini impurity: a leaf is the share of main text, a
    node (feature, threshold, tree up to it, tree above it)."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return share
    best = (share * (1 - share) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        n, ones = np.arange(1, len(t)), np.cumsum(t)[:-1]
        m, rest = len(t) - n, t.sum() - ones
        cost = ones * (n - ones) / n + rest * (m - rest) / m
        cost[(v[1:] == v[:-1]) | (n < least) | (m < least)] = np.inf
        if len(cost) and cost.min() < best[0]:
            i = int(cost.argmin())
            best = (cost[i], f, (v[i] + v[i + 1]) / 2)
    if best[1] is None:
        return share
    low = x[:, best[1]] <= best[2]
    return (best[1], float(best[2]), train_tree(x[low], y[low], depth - 1, least),
            train_tree(x[~low], y[~low], depth - 1, least))


def _leaf(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree) -> str:
    """The page's main text, one line per block."""
    if not page:
        return ""
    found, has_article = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, row in zip(found, features(found, has_article).tolist()) if _leaf(tree, row) >= 0.5)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(train_tree(*labelled_table()))

    def run(batches):
        for b in batches:
            text = [main_text(x, sent.value) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text), pa.array([len(t) for t in text], pa.int64())],
                                             names=[id_col, url_col, "text", "n_chars"])
    rows = pages.select(id_col, F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string").alias("_html"))
    kind = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint")
