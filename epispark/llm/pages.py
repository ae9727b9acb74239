"""Main text of web pages: points passed up the tree of elements."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.llm.words import slices

# Elements by what they mean for a page's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPHS = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th".split())
NO_TEXT = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input label legend map menu nav noscript object "
    "option output script search select style svg template textarea title video".split()
)
CLOSED_BY_ITS_LIKE = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
SCOPES = frozenset("article aside body button details div dl fieldset footer form header html main nav ol section table ul".split())
#: In a class, id or role: words that tell what is no part of the article.
APART = frozenset(
    "ad ads adsense advert advertisement advertising adverts advertorial alert alertdialog banner breadcrumb breadcrumbs "
    "comment comments commentlist complementary consent contentinfo cookie cookies dialog disclaimer discussion disqus "
    "footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices notification overlay "
    "pager pagination paywall popup promo promoted recommended register related remark replies reply respond responses "
    "rss search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe subscription tagcloud tags "
    "toolbar tooltip widget widgets".split()
)
#: Those of them that an element around an article hardly has by chance.
SURE = frozenset(
    "ad ads adsense advert advertisement advertising adverts alertdialog breadcrumb breadcrumbs comment comments commentlist "
    "complementary consent contentinfo cookie cookies dialog discussion disqus footer gdpr login menu modal nav navbar "
    "navigation newsletter pager pagination popup replies respond sidebar signup tagcloud toolbar tooltip".split()
)
#: Beside one of these a word tells of the page's state or layout: has-sidebar, comments-open, overflow-hidden.
STATE = frozenset("closed disabled enabled has is no non not off on open overflow with without".split())
#: What points inside an element count for that is named as apart but stays, if its name is sure or not.
DISCOUNT = {True: 0.05, False: 0.5}
#: Words that tell the same unless one of ARTICLE stands beside them.
MAYBE_APART = frozenset("bar bottom byline header legal meta outbrain side top topbar".split())
ARTICLE = frozenset("article body content entry main page post story text".split())
BONUS = {"article": 20.0, "main": 15.0, "section": 3.0, "div": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "body": -5.0, "html": -5.0}

_WORDS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _hidden(attributes: list[tuple[str, str | None]]) -> bool:
    return any(
        name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value or "")
        for name, value in attributes
    )


def _apart(attributes: list[tuple[str, str | None]]) -> bool | None:
    """Whether a class, id or role surely tells what is no part of the article; none if it doesn't tell that."""
    words = set()
    for name, value in attributes:
        if name in ("class", "id", "role") and value:
            for said in value.split():
                parts = set(_WORDS.findall(_CAMEL.sub(" ", said).lower()))
                if not parts & STATE and ":" not in said:
                    words |= parts
    if words & APART or words & MAYBE_APART and not words & ARTICLE:
        return bool(words & SURE)
    return None


class _Page(HTMLParser):
    """The elements of a page in order of their start, and its pieces of text by block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.named: dict[int, bool] = {}
        self.tags, self.parents, self.gone, self.linked = ["html"], [-1], [False], [False]
        self.holders = [0]  # the innermost block element
        self.open = [0]
        # Where open elements are, by tag, and containers: an end tag is looked up, not searched for.
        self.depths: dict[str, list[int]] = {}
        self.scopes = [0]
        self.block = 0
        self.pieces: list[tuple[int, int, str]] = []

    def _depth(self, tag: str) -> int:
        return self.depths[tag][-1] if self.depths.get(tag) else 0

    def _cut(self, depth: int) -> None:
        while len(self.open) > depth:
            tag = self.tags[self.open.pop()]
            self.depths[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()

    def _shut(self, tags: tuple[str, ...]) -> None:
        """Close the innermost open element of ``tags``, unless a container lies in between."""
        depth = max(map(self._depth, tags))
        if depth and depth >= self.scopes[-1]:
            self._cut(depth)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and tag in (self.tags[k] for k in self.open[:3]):
            return
        if tag in BLOCKS:
            self.block += 1
            if tag != "p":
                self._shut(("p",))
        if tag in CLOSED_BY_ITS_LIKE:
            self._shut(CLOSED_BY_ITS_LIKE[tag])
        if tag in VOID:
            self.handle_data(" ")
            return
        at = self.open[-1]
        told = attrs and tag not in ("html", "body")
        inside = self.gone[at] or tag in NO_TEXT or bool(told and _hidden(attrs))
        if tag == "header" and not inside:
            inside = not (self._depth("article") or self._depth("main"))
        if told and not inside and (apart := _apart(attrs)) is not None:
            self.named[len(self.tags)] = apart
        self.depths.setdefault(tag, []).append(len(self.open))
        if tag in SCOPES:
            self.scopes.append(len(self.open))
        self.holders.append(len(self.tags) if tag in BLOCKS else self.holders[at])
        self.tags.append(tag)
        self.parents.append(at)
        self.gone.append(inside)
        self.linked.append(self.linked[at] or tag == "a")
        self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.block += 1
        depth = self._depth(tag)
        if depth and (tag in BLOCKS or depth >= self.scopes[-1]):
            self._cut(depth)

    def handle_data(self, data):
        at = self.open[-1]
        if not self.gone[at]:
            self.pieces.append((at, self.block, data))


def _blocks(page: _Page) -> list[tuple[int, str, float]]:
    """Innermost block element, text and share of link text of every block, in page order."""
    out, number, runs = [], None, []

    def end():
        text = " ".join("".join(data for _, data in runs).split())
        if text:
            total = sum(len(data) for _, data in runs)
            links = sum(len(data) for at, data in runs if page.linked[at])
            at = page.holders[next(at for at, data in runs if data.strip())]
            out.append((at, text, links / total))

    for at, block, data in page.pieces:
        if block != number and runs:
            end()
            runs = []
        number = block
        runs.append((at, data))
    if runs:
        end()
    return out


def _title(blocks: list[tuple[int, str, float]], tags: list[str], parents: list[int], best: int) -> int | None:
    """The headline outside the ``best`` element: the only h1 before it, beside it or beside an element
    around it, and not mostly a link. None if the best element has an h1 or begins with a heading."""
    around, within, at = {best}, [False] * len(tags), best
    while parents[at] >= 0:
        at = parents[at]
        around.add(at)
    for k in range(len(tags)):
        within[k] = k == best or parents[k] >= 0 and within[parents[k]]
    own = [at for at, _, _ in blocks if within[at]]
    if any(tags[at] == "h1" for at in own) or own and tags[own[0]] == "h2":
        return None
    heads = {at: share for at, _, share in blocks if tags[at] == "h1"}
    if len(heads) != 1:
        return None
    (at, share), = heads.items()
    return at if at < best and parents[at] in around and share < 0.5 else None


def main_text(html: str) -> str:
    """The article of a page: its blocks in page order, with an empty line between two.

    Every block has 1 point, 1 for each comma and up to 3 for its length, less its share of
    link text. The element that holds it (its parent if it is a paragraph) gets all of them,
    the elements around that one 1/2, 1/4, 1/6 and 1/8. Scores are discounted by the
    element's share of link text. The best element, or the article or main element around
    it, is kept, and beside it those with a fifth of its score and long plain paragraphs;
    lists and divisions in it that are two thirds link text are not, unless an article or
    main element is around them. A page's only h1 is kept if it stands before the best element,
    beside it or beside an element around it, and that has no headline of its own.

    An element whose name says that it is apart is left out, unless it is or holds an article
    or main element, or most of the page's points (all of them, if the name is not sure).
    Then points inside it count for less, and it is left out only if it does not hold the
    best element, nor an article or main element.
    """
    page = _Page()
    page.feed(html)
    page.close()
    tags, parents, named = page.tags, page.parents, page.named
    blocks = _blocks(page)
    worth = [
        (1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3.0)) * (1 - share)
        for _, text, share in blocks
    ]
    weight = [1.0] * len(tags)
    holds = [t in ("article", "main") and not gone for t, gone in zip(tags, page.gone)]
    if named:
        below = [0.0] * len(tags)
        for (at, _, _), value in zip(blocks, worth):
            below[at] += value
        for k in range(len(tags) - 1, 0, -1):
            below[parents[k]] += below[k]
            holds[parents[k]] |= holds[k]
        for k in range(1, len(tags)):
            weight[k] = weight[parents[k]]
            if k in named and weight[k]:
                most, every = 2 * below[k] > below[0], below[k] >= below[0] - 1e-6
                stays = holds[k] or most and not (named[k] and every)
                around = holds[k] and (most or tags[k] not in ("article", "main"))
                weight[k] = min(weight[k], DISCOUNT[named[k] and not around]) if stays else 0.0
        blocks, worth = [b for b in blocks if weight[b[0]]], [v for b, v in zip(blocks, worth) if weight[b[0]]]
    if not blocks:
        return ""
    points = [0.0] * len(tags)
    size, links = [0] * len(tags), [0.0] * len(tags)
    for (at, text, share), value in zip(blocks, worth):
        size[at] += len(text)
        links[at] += share * len(text)
        value *= weight[at]
        holder, part = (parents[at] if tags[at] in PARAGRAPHS else at), 1.0
        for level in range(5):
            if holder < 0:
                break
            points[holder] += value * part
            holder, part = parents[holder], 1 / (2 * (level + 1))
    for k in range(len(tags) - 1, 0, -1):
        size[parents[k]] += size[k]
        links[parents[k]] += links[k]
    score = [
        (p + BONUS.get(t, 0.0) * (w if t in ("article", "main") else 1)) * (1 - x / n) if p else float("-inf")
        for p, t, n, x, w in zip(points, tags, size, links, weight)
    ]
    best = max(range(len(tags)), key=lambda k: (score[k], -k))
    for name in ("article", "main"):
        around = best
        while around >= 0 and tags[around] != name:
            around = parents[around]
        if around >= 0:
            best = around
            break
    apart, around = set(named), best
    while around >= 0:
        apart.discard(around)
        around = parents[around]
    apart -= {k for k in apart if holds[k]}
    kept, least = {best}, max(5.0, 0.2 * score[best])
    for k in range(1, len(tags)):
        if parents[k] == parents[best] and size[k]:
            plain = links[k] < 0.25 * size[k]
            if score[k] >= least or tags[k] == "p" and plain and size[k] > 80:
                kept.add(k)
    title = _title(blocks, tags, parents, best) if best else None
    if title is not None and title not in apart:
        kept.add(title)
    inside, article = [False] * len(tags), [False] * len(tags)
    for k in range(len(tags)):
        article[k] = tags[k] in ("article", "main") or parents[k] >= 0 and article[parents[k]]
        menu = tags[k] in ("div", "ul", "ol", "section", "table") and links[k] > 0.66 * size[k] and not article[k]
        inside[k] = k not in apart and (k in kept or parents[k] >= 0 and inside[parents[k]] and not menu)
    return "\n\n".join(text for at, text, _ in blocks if inside[at])


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` without ``html``, with ``text`` and its code points ``n_chars`` behind the rest.

    Null and empty pages, and pages without any text of their own, have an empty text.
    Character references are decoded, white space inside a block becomes one space. Whole
    pages are read, one at a time; repeated rows are each read. Columns of ``pages`` named
    like a new one are replaced.
    """
    others = [c for c in pages.columns if c not in (html, text, "n_chars")]
    kept = pages.select(*others, F.col(html))  # last, found by its place
    schema = pages.select(*others, F.lit("").alias(text), F.lit(0).cast("long").alias("n_chars")).schema

    def extract(batches):
        for batch in batches:
            for part in slices(batch, html):
                texts = [main_text(x) if x else "" for x in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*part.schema.names[:-1], text, "n_chars"])

    return kept.mapInArrow(extract, schema)
