"""Main text of web pages from flat text blocks and a decision tree.

A page is read once, tag by tag, into flat blocks of text. Each block has its word count and link density, those of the
two blocks before and behind it, whether long prose stands anywhere before or behind, its form (heading, sentence,
separators), and what the elements around it and their names say. A decision tree of bounded depth, grown on the driver
from the labelled pages of labelled_pages.py, tells main text from the rest. Names are matched whole: every part of
a class or id must speak of page furniture or be neutral, so that "cookie-notice" does and "social-science" does not.
A form or a named box that holds most of a page's prose is taken for the page's own frame and says nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from html import unescape
from random import Random
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomspark.llm._shared import arrow_batches, read
from loomspark.llm.labelled_pages import LABELLED_PAGES

# Elements, and parts of class, id and role attributes.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea title iframe svg math object noembed noframes xmp".split())
FURNITURE = frozenset("nav footer aside menu dialog search select fieldset head button".split())
FURNITURE_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notification alert popup modal "
    "overlay sidebar widget aside menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer copyright legal share sharing social related "
    "recommended recommendations newsletter subscribe subscription signup login search pagination pager toolbar teaser teasers contentinfo complementary form dialog".split()
)
COMMENT_PARTS = frozenset("comment comments disqus respond reply replies discussion".split())
NEUTRAL_PARTS = frozenset(
    "site page main top bottom left right inner outer wrapper wrap container box block area section list item items row col column bar slot unit panel widget module global "
    "primary secondary links link buttons button text body content head title posts stories articles thread feed js fixed sticky sm md lg xl id no".split()
)
QUOTE_PARTS = frozenset("pullquote pull quote quotes".split())  # of an aside that is the article's own
TALK = re.compile(
    r"^\s*(?:(?:\d+|one|two|three|no|reader|readers'?)\s+)*(?:comments?|responses?|replies|thoughts?|kommentare?|antworten|commentaires?|réponses|comentarios?|respuestas)"
    r"(?:\s*\(?\d+\)?|\s+on\b.*|\s+to\b.*)?\s*:?\s*$|^\s*(?:leave|post|add|write)\s+a\s+(?:comment|reply|response)\b", re.I,
)
HOME_PARTS = frozenset("article content post entry story main body text".split())
HOME_STRONG = frozenset("article content post entry story".split())
OWN_END = frozenset("li dd dt td th tr option".split())

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
LONG, PROSE = 12, 0.3  # words, and link density under which a block of that many is prose
FRAME = 0.6  # of a page's words outside links, for a box of several prose blocks to be its frame
NONE, NAMED, FORM, STRONG = 0, 1, 2, 3


class Block(NamedTuple):
    text: str
    words: int
    links: int  # words within links
    box: int  # 2 within a menu, footer, comments ..., 1 within what is named like one, else 0
    home: int  # 2 within an article or main element, 1 within what is named like one, else 0
    heading: int


def _named(value: str) -> tuple[int, int]:
    """What a class, id or role says: a box (NAMED, STRONG for comments) or a home, or neither."""
    box = home = 0
    for token in value.split():
        parts = {x.lower() for x in PART.findall(token) if not x.isdigit()}
        if parts & COMMENT_PARTS and parts <= COMMENT_PARTS | FURNITURE_PARTS | NEUTRAL_PARTS:
            box = STRONG
        elif parts & FURNITURE_PARTS and parts <= FURNITURE_PARTS | NEUTRAL_PARTS:
            box = max(box, NAMED)
        elif parts == {"main"} or parts & HOME_STRONG and parts <= HOME_PARTS:
            home = 1
    return (box, home) if not (box == NAMED and home) else (0, 0)


def _marks(tag: str, attributes: str, within: int) -> tuple[int, int]:
    """The box that an element opens, and the home. A header within a home is that article's own."""
    box = STRONG if tag in FURNITURE or tag == "header" and not within else FORM if tag == "form" else NONE
    if tag == "aside" and within and any(n.lower() == "class" and {x.lower() for x in PART.findall(v)} & QUOTE_PARTS for n, v in ATTRIBUTE.findall(attributes)):
        box = NONE
    home = 2 if tag in ("article", "main") else 0
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                box = STRONG
            elif name == "itemprop" and value == "articleBody":
                home = 2
            elif name in ("class", "id", "role"):
                b, h = _named(value)
                if tag not in ("html", "body", "main") and not (tag == "article" and b == NAMED):
                    box = max(box, b)
                home = max(home, 2 if name == "role" and value in ("main", "article") else h)
    return box, home


def blocks(html: str) -> list[Block]:
    """The flat blocks of a page, in order. Tags that are cut off by its end are dropped."""
    raw: list[tuple[str, int, int, tuple[int, ...], int, int]] = []  # text, words, links, numbers of the boxes around, home, heading
    kinds: list[int] = []  # of the boxes, by number
    stack: list[tuple[str, tuple[int, ...], int]] = []  # open block elements with what holds within them
    around: tuple[int, ...] = ()
    home = 0
    own: tuple[int, ...] = ()  # of a paragraph, heading or button
    heading = link = 0
    pieces: list[tuple[str, int]] = []

    def close() -> None:
        if pieces:
            text = " ".join(unescape("".join(x for x, _ in pieces)).split())
            if text:
                links = sum(len(unescape(x).split()) for x, in_link in pieces if in_link)
                raw.append((text, len(text.split()), links, around + own, home, heading))
            pieces.clear()

    def opened(kind: int) -> tuple[int, ...]:
        if not kind:
            return ()
        kinds.append(kind)
        return (len(kinds) - 1,)

    at, n = 0, len(html)
    while at < n:
        found = TOKEN.search(html, at)
        end = found.start() if found else n
        if end > at:
            pieces.append((html[at:end], link))
        if not found:
            break
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(found[1] or found[4]), found[3] or found[6] or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                ends = re.compile(rf"</{tag}\s*>|</{tag}\s[^>]*>", re.I).search(html, at)
                at = ends.end() if ends else n
            if tag == "title":
                close()
        elif tag == "a":
            link = int(not closing)
        elif tag == "br":
            pieces.append((" ", link))
        elif tag in BLOCKS:
            close()
            own, link = (), 0
            heading = int(not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())
            if tag == "p" or heading:
                if not closing:
                    own = opened(_marks(tag, attributes, home)[0])
            elif len(tag) == 2 and tag[0] == "h" or tag == "hr":
                pass
            elif closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                around, home = stack[-1][1:] if stack else ((), 0)
            else:
                if tag in OWN_END and stack and stack[-1][0] == tag:
                    stack.pop()
                    around, home = stack[-1][1:] if stack else ((), 0)
                box, h = _marks(tag, attributes, home)
                if tag in ("article", "main"):
                    around = tuple(x for x in around if kinds[x] != FORM)  # a form around an article is the page's frame
                around, home = around + opened(box), max(home, h)
                stack.append((tag, around, home))
        elif tag in FURNITURE:  # inline, as button
            close()
            own = () if closing else opened(STRONG)
    close()
    prose = [w - k for _, w, k, *_ in raw]
    held = [[0, 0, 0, 0] for _ in kinds]  # words outside links, prose blocks, blocks, blocks within an article
    for p, (_, w, _, boxes, h, _) in zip(prose, raw, strict=True):
        for b in boxes:
            for i, x in enumerate((p, w >= LONG and p > (1 - PROSE) * w, 1, h == 2)):
                held[b][i] += x
    homes = sum(h == 2 for *_, h, _ in raw)
    frame = {
        b for b, k in enumerate(kinds)
        if k < STRONG and held[b][3] == homes and (held[b][1] > 1 and held[b][0] > FRAME * sum(prose) or k == FORM and held[b][2] == len(raw))
    }
    level = [0 if b in frame else 1 if k == NAMED else 2 for b, k in enumerate(kinds)]
    return [Block(t, w, k, max((level[b] for b in boxes), default=0), h, hd) for t, w, k, boxes, h, hd in raw]


FEATURES = (
    "box", "home", "heading", "sentence", "separators", "words", "density", "words before", "density before", "words behind", "density behind",
    "words two before", "words two behind", "prose before", "prose behind", "astray", "talk",
)
SENTENCE = tuple(".!?…:;。！？؟。\"”’»)")
SEPARATORS = re.compile(r"[|·•©®→]|\ball rights reserved\b", re.I)


def features(page: Sequence[Block]) -> list[tuple[float, ...]]:
    """One row of FEATURES for each block. astray: how much more of a home the page's prose has than the block; talk: behind a heading of comments."""
    words = [0.0, 0.0, *(float(b.words) for b in page), 0.0, 0.0]
    density = [0.0, 0.0, *(min(1.0, b.links / b.words) for b in page), 0.0, 0.0]
    prose = [i for i, b in enumerate(page) if b.box == 0 and b.words >= LONG and b.links < PROSE * b.words]
    first, last = (prose[0], prose[-1]) if prose else (len(page), -1)
    top = max((page[i].home for i in prose), default=0)
    talk, said = [], False
    for b in page:
        said = bool(TALK.match(b.text[:80])) if b.heading else said
        talk.append(float(said))
    return [
        (
            float(b.box), float(b.home), float(b.heading), float(b.text.endswith(SENTENCE)), float(min(3, len(SEPARATORS.findall(b.text[:400])))), words[i], density[i],
            words[i - 1], density[i - 1], words[i + 1], density[i + 1], words[i - 2], words[i + 2], float(first < i - 2), float(last > i - 2), float(top - b.home), talk[i - 2],
        )
        for i, b in enumerate(page, 2)
    ]


VARIANTS = 30  # of each labelled page, with sizes drawn anew


def labelled_blocks(pages: str = LABELLED_PAGES) -> list[tuple[list[Block], list[bool]]]:
    """The labelled pages as blocks, and for each block whether it is main text."""
    out = []
    for page in pages.strip().split("\n\n"):
        found, labels = [], []
        for line in page.splitlines():
            if line.startswith("#"):
                continue
            label, where, n_words, n_links, *form = line.split()
            at = where.split(".")
            text = "x" * (not form) + "".join({"s": ".", "|": "|", "t": "comments"}[f] for f in sorted(form, reverse=True))
            box = 2 if "box" in at else 1 if "named" in at else 0
            found.append(Block(text, int(n_words), int(n_links), box, 2 if "article" in at else 1 if "content" in at else 0, int("h" in at)))
            labels.append(label == "+")
        out.append((found, labels))
    return out


def varied(page: Sequence[Block], labels: Sequence[bool], rng: Random) -> tuple[list[Block], list[bool]]:
    """A page of the same layout with other sizes, so that no cut rests on the sizes that a labelled page happens to have.

    Between prose of the article a paragraph that is mostly links may come in, as where a text says what else to read,
    and furniture that is named as such anywhere.
    """
    out: list[Block] = []
    kept: list[bool] = []
    up_to = lambda least, most: int(math.exp(rng.uniform(math.log(least), math.log(most + 0.99))))
    for i, (b, y) in enumerate(zip(page, labels, strict=True)):
        share = b.links / b.words
        if y:
            n = rng.randint(1, 14) if b.heading or b.words < LONG else up_to(8, 160)
        elif b.box or b.words >= LONG:
            n = up_to(1, 70) if b.box else up_to(8, 120)
        else:
            n = rng.randint(1, 4) if share == 1 else max(1, round(b.words * rng.uniform(0.5, 1.5)))
        out.append(b._replace(words=n, links=round(share * n)))
        kept.append(y)
        if rng.random() < 0.12:  # furniture may stand anywhere
            n = up_to(1, 60)
            out.append(Block(rng.choice(("x", "x.")), n, rng.choice((0, n)), rng.choice((1, 2)), b.home, 0))
            kept.append(False)
        follows = any(z and not x.heading and x.words >= LONG for x, z in zip(page[i + 1 :], labels[i + 1 :], strict=True))
        if y and not b.box and follows and (b.home or b.words >= LONG) and rng.random() < 0.25:
            n = rng.randint(1, 30)
            out.append(b._replace(text=rng.choice(("x", "x.")), words=n, heading=0, links=min(n, max(1, round(n * rng.uniform(0.3, 1.0 if b.home else 0.9))))))
            kept.append(True)
    return out, kept


def labelled_table(pages: str = LABELLED_PAGES, variants: int = VARIANTS) -> list[tuple[float, ...]]:
    """The labelled table: the features of each block of the labelled pages and of their variants, and 1 for main text."""
    rows: list[tuple[float, ...]] = []
    for k, (page, labels) in enumerate(labelled_blocks(pages)):
        for i in range(variants + 1):
            found, kept = varied(page, labels, Random(f"{k} {i}")) if i else (page, labels)
            rows += [(*f, float(y)) for f, y in zip(features(found), kept, strict=True)]
    return rows


class Node(NamedTuple):
    feature: int
    limit: float
    low: Node | bool
    high: Node | bool


def grow(rows: list[tuple[float, ...]], depth: int = 8, leaf: int = 15) -> Node | bool:
    """A decision tree by Gini impurity, of at most that depth and with at least `leaf` rows on each side of a cut.

    The earliest feature and the least limit win ties, so it is the same each time.
    """
    positive, n = sum(r[-1] for r in rows), len(rows)
    best = None
    if depth and 0 < positive < n:
        for f in range(len(rows[0]) - 1):
            ordered = sorted((r[f], r[-1]) for r in rows)
            low = 0.0
            for i in range(1, n):
                low += ordered[i - 1][1]
                if leaf <= i <= n - leaf and ordered[i][0] > ordered[i - 1][0]:
                    impurity = low * (i - low) / i + (positive - low) * (n - i - positive + low) / (n - i)
                    if best is None or impurity < best[0] - 1e-12:
                        best = impurity, f, (ordered[i - 1][0] + ordered[i][0]) / 2
    if best is None or best[0] > positive * (n - positive) / n - 1e-9:
        return 2 * positive >= n
    _, f, limit = best
    low, high = (grow([r for r in rows if (r[f] > limit) == side], depth - 1, leaf) for side in (False, True))
    return low if low == high and isinstance(low, bool) else Node(f, limit, low, high)


def decide(tree: Node | bool, row: Sequence[float]) -> bool:
    while isinstance(tree, Node):
        tree = tree.low if row[tree.feature] <= tree.limit else tree.high
    return tree


def main_text(html: str, tree: Node | bool) -> str:
    page = blocks(html)
    return "\n\n".join(b.text for b, row in zip(page, features(page), strict=True) if decide(tree, row))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), labelled: Sequence[tuple[float, ...]] | None = None) -> DataFrame:
    """Return the columns keep, text and n_chars for each row.

    The tree is grown once, from the labelled table (rows of FEATURES and 1 for main text; the built-in one by
    default). Null and empty html give an empty text, and so does a page without text outside its furniture. Rows are
    handled one by one and whole, however long; repeated rows give equal rows, an empty table gives none. Other
    columns are ignored.
    """
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"
    tree = grow(labelled_table() if labelled is None else list(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", tree) for x in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "text", "n_chars"])

    arrow_batches(pages.sparkSession)
    return pages.select(*[pages[c] for c in keep], pages[html].alias("_html")).mapInArrow(run, schema)


def op10_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(read(spark, sf_dir, "pages"))
