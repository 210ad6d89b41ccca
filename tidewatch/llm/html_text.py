"""Main text of web pages by consensus of a host's pages.

Each page is read once into containers (``div``, ``article``, ...) with the words in them.  The
best one by words outside links votes for its path: tags with ids and classes from the body
down, numbers in names made equal.  Votes are added up by host in Spark.  A path that a quarter
of a host's pages chose, or else its most chosen one, wins; pages are then read again and the
text of the containers at the host's winning path is taken, in the order of votes.  A page
without any of these containers gives its own best one.

Menus, headers, footers, side columns, notices, adverts, forms, scripts, styles, hidden parts and
reader comments never count and are never taken; they are told by tag, role and names (see the
fixed lists).  Headings inside an article's own header stay.

Defined cases: NULL and empty html, and pages without words, give an empty text; a NULL url has the
host ''.  Rows may repeat; each is answered and votes for itself.  Other columns are ignored.
Text is never cut: unclosed and unknown tags are read as browsers do, a quote without its end is
an ordinary sign, and only a tag that the end of the page cuts off is lost.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewatch.config import Config
from tidewatch.llm.common import BROADCAST_ROWS, materialize
from tidewatch.operators.attach import attach

#: A path wins a host with one of so many votes.
QUORUM = 4

# Tags by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_CONTAINERS = frozenset("article body center div form main section td".split())
_ARTICLES = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
_LEFT_OUT = frozenset(
    "nav aside footer menu dialog noscript template svg canvas audio video object button select label fieldset datalist map".split()
)
#: Start tags that end open ones, up to the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr"}, {"table"}),
}
# Words in ids and classes, and roles.
_FOREIGN_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation "
    "breadcrumb breadcrumbs masthead footer sidebar aside comment comments disqus respond reply replies cookie cookies consent "
    "notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations widget toolbar pagination pager copyright legal skip search".split()
)
_HEADER_NAMES = frozenset(["header"])
_OWN_NAMES = frozenset("article content post entry story text body main".split())
_SIGNS = frozenset("has with no not without is".split())
_FOREIGN_ROLES = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split()
)

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|</(?![a-zA-Z])[^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_TELLING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NUMBER = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: How an element's text is treated.
_TAKEN, _HEADINGS_ONLY, _FOREIGN, _FOREIGN_BY_NAME = range(4)
#: A form with so many words in paragraphs wraps the page.
_WRAPPER_WORDS = 50


@functools.lru_cache(maxsize=20_000)
def _kind(tag: str, attrs: str) -> tuple[str, int, float]:
    """Path segment, treatment and weight of an element."""
    found: dict[str, str] = {}
    if attrs and _TELLING.search(attrs):
        for name, *values in _ATTRIBUTE.findall(attrs):
            found.setdefault(name.lower(), entities.unescape(next((v for v in values if v), "")))
    names = found.get("class", "").split()
    ids = found.get("id", "").split()
    segment = tag
    segment += "".join(f"#{_NUMBER.sub('0', n)}" for n in ids)
    segment += "".join(f".{n}" for n in sorted({_NUMBER.sub("0", n) for n in names}))
    words: set[str] = set()
    for name in names + ids:
        parts = [w.lower() for w in _WORD.findall(name)]
        if parts and parts[0] not in _SIGNS:
            words.update(parts)
    role = found.get("role", "").lower()
    own = bool(words & _OWN_NAMES)
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", ""))
    treatment = _TAKEN
    if tag in _LEFT_OUT or hidden:
        treatment = _FOREIGN
    elif tag not in ("article", "main", "body", "html") and (words & _FOREIGN_NAMES or role in _FOREIGN_ROLES):
        treatment = _FOREIGN_BY_NAME
    elif tag == "header" or words & _HEADER_NAMES and tag not in _HEADINGS:
        treatment = _HEADINGS_ONLY if own else _FOREIGN_BY_NAME
    weight = 1.25 if own else 1.0
    if tag in _ARTICLES or role in ("main", "article") or found.get("itemprop", "") == "articleBody":
        weight = 1.5
    return segment.replace("/", "|"), treatment, weight


def _hash(segment: str, above: int) -> int:
    return xxhash.xxh64_intdigest(segment, above)


@functools.lru_cache(maxsize=10_000)
def path_hash(path: str) -> int:
    now = 0
    for segment in path.split("/"):
        now = _hash(segment, now)
    return now


class Page:
    """The containers of a page, as ranges of its pieces of text."""

    def __init__(self, text: str) -> None:
        self.pieces: list[str] = []
        self.words: list[int] = []  # by piece, outside links
        self.linked: list[int] = []
        self.places: list[int] = []  # the nearest container of each piece
        self.titles: list[int] = []  # pieces in h1
        # containers; number 0 is the body
        self.parents, self.segments, self.hashes = [-1], ["body"], [_hash("body", 0)]
        self.weights, self.tags = [1.0], ["body"]
        self.ranges: list[list[int]] = [[0, 0]]
        self._read(text)
        self.ranges[0][1] = len(self.pieces)

    def _read(self, text: str) -> None:
        # open elements: tag, container before it, treatment before it, its own container or -1, first piece
        stack: list[tuple[str, int, int, int, int]] = []
        open_tags: Counter[str] = Counter()
        place, treatment, link, heading, paragraph_words = 0, _TAKEN, False, "", [0]
        pieces, words, linked, places = self.pieces, self.words, self.linked, self.places

        def add(raw: str) -> None:
            if treatment and (treatment != _HEADINGS_ONLY or not heading):
                return
            if "&" in raw:
                raw = entities.unescape(raw)
            n = len(raw.split())
            if n and heading == "h1":
                self.titles.append(len(pieces))
            if n and open_tags["p"] and not link and open_tags["form"]:
                paragraph_words[0] += n
            pieces.append(raw)
            words.append(0 if link else n)
            linked.append(n if link else 0)
            places.append(place)

        def cut() -> None:
            if pieces and pieces[-1] != " ":
                pieces.append(" ")
                words.append(0)
                linked.append(0)
                places.append(place)

        def close() -> None:
            nonlocal place, treatment, heading
            tag, place, treatment, own, first = stack.pop()
            open_tags[tag] -= 1
            if own >= 0:
                self.ranges[own][1] = len(pieces)
            if tag == heading:
                heading = ""
            if tag == "form" and not open_tags["form"]:
                if paragraph_words[0] < _WRAPPER_WORDS:
                    for k in range(first, len(pieces)):
                        pieces[k], words[k], linked[k] = " ", 0, 0
                    while self.titles and self.titles[-1] >= first:
                        self.titles.pop()
                paragraph_words[0] = 0

        at = 0
        while True:
            token = _TOKEN.search(text, at)
            if token is None:
                if at < len(text):
                    add(text[at:])
                break
            if token.start() > at:
                add(text[at : token.start()])
            at = token.end()
            tag = token["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            block = tag in _BLOCKS
            if block:
                cut()
            if token["end"]:
                if tag == "a":
                    link = False
                elif open_tags[tag] and tag not in ("body", "html"):
                    while stack[-1][0] != tag:
                        close()
                    close()
                    if block:
                        link = False
                continue
            if tag in _VOID or tag in ("body", "html"):
                continue
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I).search(text, at)
                at = end.end() if end else len(text)
                continue
            if tag == "a":
                link = True
            if block and open_tags["p"]:
                while stack[-1][0] != "p":
                    close()
                close()
            if tag in _CLOSES:
                ended, scope = _CLOSES[tag]
                k = len(stack) - 1
                while k >= 0 and stack[k][0] not in ended and stack[k][0] not in scope and stack[k][0] not in _CONTAINERS - {"td"}:
                    k -= 1
                if k >= 0 and stack[k][0] in ended:
                    while len(stack) > k:
                        close()
            attrs = token["attrs"]
            container = tag in _CONTAINERS
            segment, own_treatment, weight = _kind(tag, attrs if container or block or _TELLING.search(attrs) else "")
            if own_treatment == _FOREIGN_BY_NAME and tag == "header" and (open_tags["article"] or open_tags["main"]):
                own_treatment = _HEADINGS_ONLY
            if not (block or own_treatment or treatment or tag in _LEFT_OUT):
                continue  # tags inside a line leave no trace
            before = treatment
            if tag in _ARTICLES and treatment == _FOREIGN_BY_NAME:
                treatment = _TAKEN  # a name around the article tells nothing
            own = -1
            if container and not treatment and not own_treatment:
                own = len(self.parents)
                self.parents.append(place)
                self.segments.append(segment)
                self.hashes.append(_hash(segment, self.hashes[place]))
                self.weights.append(weight)
                self.tags.append(tag)
                self.ranges.append([len(pieces), len(pieces)])
            stack.append((tag, place, before, own, len(pieces)))
            open_tags[tag] += 1
            if own >= 0:
                place = own
            if tag in _HEADINGS and not heading:
                heading = tag
            treatment = max(treatment, own_treatment)
        while stack:
            close()

    def text(self, container: int) -> str:
        first, last = self.ranges[container]
        return " ".join("".join(self.pieces[first:last]).split())

    def path(self, container: int) -> str:
        out = []
        while container >= 0:
            out.append(self.segments[container])
            container = self.parents[container]
        return "/".join(reversed(out))

    def best(self) -> tuple[int, float] | None:
        """The container with the most words outside links, and its score; those of inner containers count less."""
        n = len(self.parents)
        words, linked = [0] * n, [0] * n
        for place, w, k in zip(self.places, self.words, self.linked, strict=True):
            words[place] += w
            linked[place] += k
        direct = [w * w / (w + k) if w else 0.0 for w, k in zip(words, linked, strict=True)]
        scores = list(direct)
        for c in range(1, n):
            parent = self.parents[c]
            scores[parent] += 0.7 * direct[c]
            if parent > 0:
                scores[self.parents[parent]] += 0.5 * direct[c]
        scores = [s * w for s, w in zip(scores, self.weights, strict=True)]
        top = max(range(n), key=lambda c: (scores[c], -c))
        if not scores[top]:
            return None
        return self._whole(top), scores[top]

    def _whole(self, container: int) -> int:
        """The article around the container; else a little more, if that brings in the title."""
        above, outermost = container, None
        while above >= 0:
            if self.tags[above] == "article":
                outermost = above
            above = self.parents[above]
        if outermost is not None:
            return outermost
        first, last = self.ranges[container]
        titles = [t for t in self.titles if t < first]
        if not titles or any(first <= t < last for t in self.titles):
            return container
        inside = sum(self.words[first:last])
        above = self.parents[container]
        while above >= 0 and self.ranges[above][0] > titles[-1]:
            above = self.parents[above]
        low, high = self.ranges[above] if above > 0 else (0, len(self.pieces))
        around = sum(self.words[low:high]) + sum(self.linked[low:high]) - inside - sum(self.linked[first:last])
        return above if around <= inside / 4 else container

    def at(self, path: str) -> list[int]:
        """Containers at a path, without those of few words or mostly links if only their tags tell them."""
        wanted = path_hash(path)
        found = [c for c, h in enumerate(self.hashes) if h == wanted]
        if len(found) < 2 or not path.endswith(("/div", "/td", "/section", "/center", "/form")):
            return found
        sizes = [(sum(self.words[slice(*self.ranges[c])]), sum(self.linked[slice(*self.ranges[c])])) for c in found]
        most = max(w for w, _ in sizes)
        return [c for c, (w, k) in zip(found, sizes, strict=True) if w >= k and 5 * w >= most]


def main_text(html: str | None, paths: list[str]) -> str:
    """Text at the first of ``paths`` that the page has words at, else of its best container."""
    page = Page(html or "")
    for path in paths:
        text = " ".join(filter(None, (page.text(c) for c in page.at(path))))
        if text:
            return text
    best = page.best()
    return page.text(best[0] if best else 0)


def _votes(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for f in frames:
        votes: Counter[tuple[str, str]] = Counter()
        scores: Counter[tuple[str, str]] = Counter()
        for host, html in zip(f.column(0).to_pylist(), f.column(1).to_pylist(), strict=True):
            page = Page(html or "")
            best = page.best()
            if best:
                key = host, page.path(best[0])
                votes[key] += 1
                scores[key] += round(best[1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in votes], pa.string()),
                pa.array([k[1] for k in votes], pa.string()),
                pa.array(list(votes.values()), pa.int64()),
                pa.array([scores[k] for k in votes], pa.int64()),
            ],
            ["host", "path", "votes", "score"],
        )


def winning_paths(pages: DataFrame) -> DataFrame:
    """``host, paths, votes``: at most ``QUORUM`` paths of each host, most votes first; ties go to the score, then the path."""
    votes = materialize(
        pages.select("host", "html").mapInArrow(_votes, "host string, path string, votes bigint, score bigint")
        .groupBy("host", "path")
        .agg(F.sum("votes").alias("votes"), F.sum("score").alias("score")),
        "votes",
    )
    rank = F.struct("votes", "score", "path")
    totals = votes.groupBy("host").agg(F.sum("votes").alias("n"), F.max(rank).alias("top"))
    chosen = votes.join(totals, "host").where((F.col("votes") * QUORUM >= F.col("n")) | (rank == F.col("top")))
    return chosen.groupBy("host").agg(
        F.reverse(F.array_sort(F.collect_list(rank)))["path"].alias("paths"), F.max("n").alias("votes")
    )


@F.pandas_udf(StringType())
def _main_texts(html: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([main_text(h, [] if p is None else list(p)) for h, p in zip(html, paths, strict=True)], dtype=object)


def extract(pages: DataFrame, id_col: str = "page_id", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``id_col, url, text`` of every page.

    The winning paths are broadcast if at most ``limit`` hosts have some; otherwise pages meet them
    in a join that spreads the pages of large hosts.
    """
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    hosted = pages.select(id_col, "url", "html", F.coalesce(host, F.lit("")).alias("host"))
    winners = materialize(winning_paths(hosted), "paths")
    if winners.count() <= limit:
        told = hosted.join(F.broadcast(winners), "host", "left")
    else:
        told = attach(hosted, winners, "host", "votes", Config())
    return told.select(id_col, "url", _main_texts("html", "paths").alias("text"))
