"""Main text of HTML pages: flat text blocks, classified by a decision tree over their neighbours."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.html_pages import PAGES, page
from ledgerscope.llm.shared import ship, with_columns

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.DOTALL)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
RAW = frozenset("script style template iframe svg math object canvas video audio noscript textarea title".split())
CONTAINERS = frozenset("article aside blockquote body button dd div dl dt fieldset figure footer form head header html li main menu nav ol section select table tbody td tr ul dialog details".split())
BLOCKS = CONTAINERS | frozenset("address caption center figcaption h1 h2 h3 h4 h5 h6 hr legend optgroup option p pre summary tfoot th thead".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, roles and words of class names and ids that mark page furniture.
CHROME_TAGS = frozenset("aside button dialog footer form head header menu nav select".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
CHROME_WORDS = frozenset(
    """ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs byline-share colophon comment comments
    consent cookie cookies copyright disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation
    newsletter notice notification overlay pager paginate pagination paywall popular popup promo promoted promotion recommend
    recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar
    topbar trending widget widgets""".split()
)
COMMENT_WORDS = frozenset("comment comments discussion disqus replies reply respond".split())
ARTICLE_WORDS = frozenset("article articlebody content entry post story text".split())
#: Phrases of notices, as page furniture words them.
NOTICE = re.compile(
    r"accept (?:all )?cookies|uses? cookies|cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|copyright \d|copyright ©|©|"
    r"(?:sign up|subscribe) (?:for|to) our|share this|log in|newsletter", re.IGNORECASE
)
WHITE = re.compile(r"[ \t\n\f\r\v]+")
WORDS_IN_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "chrome", "heading", "item", "notice")


def marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element starts an article, and whether it starts page furniture."""
    article, chrome = tag in ("article", "main"), tag in CHROME_TAGS
    if not attributes:
        return article, chrome
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    names = [w for k in ("class", "id") for w in found.get(k, "").split()]
    for name in names:
        words = {w.lower() for w in WORDS_IN_NAME.findall(name)}
        if words & COMMENT_WORDS:
            chrome = True
        elif tag not in ("article", "main", "body", "html"):
            chrome |= bool(words & CHROME_WORDS) and not (words & {"article", "post", "entry", "story"} and words & CHROME_WORDS == {"header"})
            article |= bool(words & ARTICLE_WORDS) and not chrome
    chrome |= found.get("role", "").lower() in CHROME_ROLES or found.get("aria-hidden", "").lower() == "true"
    chrome |= "display:none" in found.get("style", "").replace(" ", "").lower() or bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes))
    article |= found.get("role", "").lower() == "main" or found.get("itemprop", "").lower() == "articlebody"
    return article, chrome


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """The page's text blocks in order: text and, without neighbours, (words, links, article, chrome, heading, item, notice).

    Elements that break lines end a block; others only contribute their text. ``links`` is the share
    of words inside links. The content of raw elements, comments and declarations is no text.
    """
    out: list[tuple[str, list[float]]] = []
    stack: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    linked = depth = 0
    heading = False
    at, end = 0, len(page)

    def close() -> None:
        nonlocal linked
        text = WHITE.sub(" ", html.unescape("".join(parts))).strip(" ")
        parts.clear()
        if text:
            n = len(text.split(" "))
            article, chrome = any(s[1] for s in stack), any(s[2] for s in stack)
            out.append((text, [n, min(1.0, linked / n), article, chrome, heading, any(s[0] == "li" for s in stack), bool(NOTICE.search(text))]))
        linked = 0

    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            parts.append(text)
            linked += len(text.split()) if depth else 0
        if not m:
            break
        at = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        tag = (m[2] or m[5] or "").lower()
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if not tag:
            continue
        if tag == "a":
            depth = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in RAW and not closing:
            if not attributes.endswith("/"):
                over = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
                at = over.end() if over else (end if tag in ("script", "style", "textarea", "title") else at)
        elif tag in BLOCKS:
            close()
            depth = 0
            if tag in HEADINGS:
                heading = not closing
            elif not closing:
                heading = False
            if tag in CONTAINERS:
                if not closing:
                    if tag == "li" and stack and stack[-1][0] == "li" or tag == "body":
                        while stack and stack[-1][0] in ("li", "head"):
                            stack.pop()
                    stack.append((tag, *marks(tag, attributes)))
                elif any(s[0] == tag for s in stack):
                    while stack.pop()[0] != tag:
                        pass
    close()
    return out


def with_neighbours(own: list[list[float]]) -> list[list[float]]:
    """Rows of FEATURES: each block's own figures and those of the blocks before and after it."""
    edge = [0.0, 0.0]
    return [
        [*map(float, b[:2]), *map(float, own[i - 1][:2] if i else edge), *map(float, own[i + 1][:2] if i + 1 < len(own) else edge), *map(float, b[2:])]
        for i, b in enumerate(own)
    ]


def labelled() -> list[tuple[list[float], float]]:
    """Figures and label (1: main text) of each block of the invented pages."""
    rows = []
    for form in PAGES:
        found = blocks(page(form))
        rows += zip(with_neighbours([own for _, own in found]), [float(text.startswith("*")) for text, _ in found])
    return rows


def train(spark: SparkSession, depth: int = 12) -> tuple:
    """A decision tree over FEATURES, fitted to ``labelled``: nested (feature, threshold, left, right), leaves 0.0 or 1.0."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors

    table = spark.createDataFrame([(Vectors.dense(x), y) for x, y in labelled()], ["features", "label"])
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=128, seed=1).fit(table.coalesce(1))
    return _parse(iter(model.toDebugString.splitlines()[1:]))


def _parse(lines: Iterator[str]):
    """The printed tree as nested tuples."""
    line = next(lines).strip()
    if line.startswith("Predict"):
        return float(line.split()[-1])
    m = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line)
    left = _parse(lines)
    next(lines)  # the matching Else
    return int(m[1]), float(m[2]), left, _parse(lines)


def main_text(page: str | None, tree) -> str:
    """The blocks that ``tree`` takes for main text, in page order, one a line."""
    found = blocks(page or "")
    kept = []
    for (text, _), x in zip(found, with_neighbours([own for _, own in found])):
        at = tree
        while isinstance(at, tuple):
            at = at[2] if x[at[0]] <= at[1] else at[3]
        if at:
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` (main text) and ``n_chars`` (its code points), replacing columns of those names.

    Character references are decoded; white space inside a block becomes one space. A null or empty
    page, and one without main text, gives an empty text. Unclosed elements end with their
    container. Pages are read whole, each on its own: repeated rows get equal texts, an empty table
    an empty one.
    """
    ship(pages.sparkSession)
    tree = train(pages.sparkSession)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, tree) for p in batch], dtype=object)

    out = with_columns(pages, {"text": texts(F.col(f"`{html_col}`"))})
    return with_columns(out, {"n_chars": F.char_length("text").cast("long")})
