"""Main text of web pages by tag-path ratios.

A page's text nodes (the text of a block element up to the next block boundary) are grouped by
their root-to-leaf tag path; a step of a path is a tag, for containers with their classes.

1. *ratios*: each path has its text length per node and its punctuation per node;
2. *smooth*: both are laid out in page order and smoothed over neighbouring nodes (Gaussian), so
   that a heading or a one-line paragraph takes part in what surrounds it;
3. *fuse*: each ratio is the geometric mean of the path's own and the smoothed one; per path the
   greatest geometric mean of both ratios counts, times the share of text outside links
   and the path's prior: 4 inside ``article`` or ``main``, 1/20 under a name that tells of
   adverts, comments, sidebars and the like (``PENALTY``), else 1;
4. *threshold*: a path at ``SHARE`` of the best path's value is content, and its nodes are
   chosen.  If one ``article`` or ``main`` holds all chosen nodes, the region is that element;
   else it is the stretch from the first to the last chosen node, with the headings right before
   it.  Other nodes of the region (lists of links, captions) come along unless their path has
   the penalty.

Lists veto only what never shows or never is article text: scripts, styles, forms and their
controls, ``nav``, ``aside``, ``footer``, a ``header`` outside the article, hidden elements.

Character references are decoded, white space inside a block (line breaks included) becomes
one space, blocks come in page order, one line feed between them.  The parser looks at every
character a bounded number of times, whatever is left unclosed.

Defined results: a null or empty page, and one without text, gives an empty text; an element
that is never closed ends with its parent or the page; a tag whose quote is never closed ends at
the next ``>``, and one without ``>`` ends the page; equal values keep page order; repeated rows
each have their own result; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SIGMA, SHARE = 1.0, 0.3
CONTENT_PRIOR, PENALTY = 4.0, 0.05

# HTML's own element classes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VETOED = set(
    "head nav footer aside form script style noscript template button select option textarea input fieldset legend menu dialog iframe svg canvas object embed applet audio video title math noembed noframes datalist".split()
)
VETOED_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CONTENT = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Containers whose classes are part of a path.
CONTAINERS = set("div section ul ol dl table td center header".split())
#: Names with a penalty wherever they stand among a class's or id's parts, and those that have it alone only.
PART = re.compile(
    r"(?:nav\w*|menu\w*|footer|sidebar\w*|ads?|advert\w*|banner\w*|promo\w*|sponsor\w*|cookies?|consent|gdpr|newsletter|subscri\w*|comments?|commentlist|respond|disqus\w*|"
    r"share\w*|sharing|social\w*|related\w*|recommend\w*|breadcrumbs?|pagination|pager|widget\w*|popup\w*|modal|login|signup|search\w*|toolbar|masthead|teasers?)$"
)
WHOLE = set("header head foot aside notice notices alert tags tagcloud tag-cloud toc legal copyright hidden skip skip-link side side-bar page-header site-header page-footer site-footer top-bar topbar meta-nav site-notice".split())
COMMENTS = re.compile(r"(?:comments?|commentlist|respond|disqus\w*)$")
#: Parts that turn a name round or say that the element is about the article.
QUALIFIES = set("no non not has with without hide is article post entry story content main body text wrapper wrap".split())

#: Opening one of these ends an open paragraph.
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: A paragraph is not reached through these.
HOLDS_P = ("button", "td", "li", "div", "article", "section")
#: Opening the first ends an open element of the second kind, up to the nearest of the third.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>=]*>")
_ATTR = re.compile(r"[\s/]*(=?[^\s/>=]*)\s*(=?)\s*")
_VALUE = re.compile(r"[^\s>]*")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PUNCT = re.compile(r"[.,;:!?…。，、？！¿¡،؟।]")


def named(value: str) -> tuple[bool, bool]:
    """Whether a class or id has the penalty, and whether it is one of comments."""
    for token in value.lower().split():
        parts = re.split(r"[-_]+", token)
        if any(COMMENTS.match(p) for p in parts) and not {"no", "non", "has", "with", "without", "hide"} & set(parts):
            return True, True
        if token in WHOLE or (any(PART.match(p) for p in parts) and not QUALIFIES & set(parts)):
            return True, False
    return False, False


class Page:
    """Elements and text nodes of a page, by one pass over its characters."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        # elements: parent, penalty (0 none, 1 by name, 2 comments), whether it is or holds article or main
        self.parent, self.penalty, self.content, self.holds = [-1], [0], [False], [False]
        self.paths: dict[tuple, int] = {}
        #: text nodes: path, element, text, characters in links, heading
        self.nodes: list[tuple[int, int, str, int, bool]] = []
        self._unclosed: set[str] = set()
        self._parse()

    # -- tags

    def _attributes(self, at: int, wanted: bool) -> tuple[int, dict]:
        """Where the tag ends, and its attributes."""
        text, got = self.text, {}
        plain = _PLAIN.match(text, at)
        if plain and not (wanted and "hidden" in plain[0]):
            return plain.end(), got
        while True:
            m = _ATTR.match(text, at)
            at = m.end()
            if m[2]:
                quote = text[at : at + 1]
                if quote in ("'", '"') and quote:
                    end = -1 if quote in self._unclosed else text.find(quote, at + 1)
                    if end < 0:
                        self._unclosed.add(quote)
                        end = text.find(">", at)
                        return (self.n, got) if end < 0 else (end + 1, got)
                    value, at = text[at + 1 : end], end + 1
                else:
                    v = _VALUE.match(text, at)
                    value, at = v[0], v.end()
            else:
                value = ""
            if m[1]:
                got.setdefault(m[1].lower(), value)
            if at >= self.n:
                return self.n, got
            if text[at] == ">":
                return at + 1, got

    def _parse(self) -> None:
        text, n = self.text, self.n
        stack: list[tuple[str, int, int, bool, bool]] = []  # tag, element, path, vetoed, inside content
        blocks: list[int] = []  # stack places of block elements
        places: dict[str, list[int]] = defaultdict(list)
        parts: list[str] = []
        linked = 0

        def top(tags) -> int:
            return max((places[t][-1] for t in tags if places[t]), default=-1)

        def flush():
            nonlocal linked
            if parts:
                got = " ".join(html.unescape("".join(parts)).split())
                if got:
                    tag, element, path = (stack[blocks[-1]][:3]) if blocks else ("", 0, 0)
                    self.nodes.append((path, element, got, min(linked, len(got)), tag in HEADINGS))
                parts.clear()
            linked = 0

        def close(upto: int):
            if blocks and blocks[-1] >= upto:
                flush()
            while len(stack) > upto:
                places[stack.pop()[0]].pop()
                if blocks and blocks[-1] >= len(stack):
                    blocks.pop()

        at = 0
        while at < n:
            lt = text.find("<", at)
            piece = text[at : lt if lt >= 0 else n]
            if piece and not (stack and stack[-1][3]):
                parts.append(piece)
                if places["a"]:
                    linked += len(piece.strip())
            if lt < 0:
                break
            m = _NAME.match(text, lt + 1)
            if not m:
                if text.startswith("<!--", lt):
                    end = text.find("-->", lt + 4)
                    at = n if end < 0 else end + 3
                elif text[lt + 1 : lt + 2] in ("!", "?", "/") and lt + 1 < n:
                    end = text.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    if not (stack and stack[-1][3]):
                        parts.append("<")
                    at = lt + 1
                continue
            tag = m[2].lower()
            at, attrs = self._attributes(m.end(), not m[1])
            if m[1]:
                if tag == "br":
                    parts.append(" ")
                elif places[tag]:
                    k = places[tag][-1]
                    if tag not in INLINE or not blocks or k > blocks[-1]:
                        close(k)
                continue
            if tag in ("br", "img", "wbr"):
                parts.append(" " if tag == "br" else "")
                continue
            if tag not in INLINE:
                if tag in ENDS_P and places["p"] and places["p"][-1] > top(HOLDS_P):
                    close(places["p"][-1])
                if tag in ENDS:
                    ended, within = ENDS[tag]
                    limit = top(within)
                    while (k := top(ended)) > limit:
                        close(k)
                if tag == "body" and places["head"]:
                    close(places["head"][0])
                flush()
            if tag in VOID:
                continue
            if tag in RAW:
                if tag in self._unclosed:
                    at = n
                    continue
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(text, at)
                if not end:
                    self._unclosed.add(tag)
                at = end.end() if end else n
                continue
            up = stack[-1] if stack else ("", 0, 0, False, False)
            inside = up[4] or tag in CONTENT
            vetoed = up[3] or tag in VETOED or (tag == "header" and not up[4]) or self._hidden(tag, attrs)
            element = len(self.parent)
            names = " ".join(attrs[a] for a in ("class", "id") if attrs.get(a))
            penalty, comments = named(names) if names and tag not in ("html", "body") else (False, False)
            if tag in CONTENT and not comments:
                penalty = False
            self.parent.append(up[1])
            self.penalty.append(2 if comments else int(penalty))
            self.content.append(tag in CONTENT)
            self.holds.append(False)
            if tag in CONTENT and not penalty:
                e = up[1]
                while e > 0 and not self.holds[e]:
                    self.holds[e] = True
                    e = self.parent[e]
            if tag in INLINE:
                path = up[2]
            else:
                label = tag
                if tag in CONTAINERS:
                    label += "." + re.sub(r"\d+", "", attrs.get("class", "")).lower() + ("!" if penalty else "")
                path = self.paths.setdefault((up[2], label), len(self.paths) + 1)
                blocks.append(len(stack))
            places[tag].append(len(stack))
            stack.append((tag, element, path, vetoed, inside))
        flush()

    @staticmethod
    def _hidden(tag: str, attrs: dict) -> bool:
        if not attrs:
            return False
        if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _NONE.search(attrs.get("style", "")):
            return tag not in ("html", "body")
        return attrs.get("role", "").lower() in VETOED_ROLES and tag not in ("html", "body")

    # -- what holds for elements, from their parents

    def settle(self) -> tuple[list[bool], list[int]]:
        """Whether each element lies under a penalty, and the outermost article or main that it lies in (0: none)."""
        held = [0] * len(self.parent)
        for _, e, t, _, _ in self.nodes:
            held[e] += len(t)
        for e in range(len(held) - 1, 0, -1):
            held[self.parent[e]] += held[e]
        any_content = any(c and h for c, h in zip(self.content, held))
        under, content = [False] * len(held), [0] * len(held)
        for e in range(1, len(held)):
            most = not any_content and 2 * held[e] > held[0] and self.penalty[e] < 2
            under[e] = under[self.parent[e]] or (self.penalty[e] > 0 and not self.holds[e] and not most)
            content[e] = content[self.parent[e]] or (e if self.content[e] else 0)
        return under, content


def _smooth(v: list[float]) -> list[float]:
    r = max(1, math.ceil(2 * SIGMA))
    k = [math.exp(-(i * i) / (2 * SIGMA * SIGMA)) for i in range(-r, r + 1)]
    out = []
    for i in range(len(v)):
        lo, hi = max(0, i - r), min(len(v), i + r + 1)
        w = k[lo - i + r : hi - i + r]
        out.append(sum(a * b for a, b in zip(w, v[lo:hi])) / sum(w))
    return out


def fused_ratios(nodes: list[tuple], under: list[bool], content: list[int]) -> dict[int, float]:
    """The fused ratio of each path."""
    length, punct, link, count = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for path, _, text, linked, _ in nodes:
        length[path] += len(text)
        punct[path] += len(PUNCT.findall(text))
        link[path] += linked
        count[path] += 1
    out: dict[int, float] = defaultdict(float)
    for penalty in (False, True):  # what has the penalty lifts nothing beside it
        row = [b for b in nodes if under[b[1]] == penalty]
        text, dots = ([sums[b[0]] / count[b[0]] for b in row] for sums in (length, punct))
        for (path, e, *_), t, t2, d, d2 in zip(row, text, _smooth(text), dots, _smooth(dots)):
            prior = PENALTY if penalty else CONTENT_PRIOR if content[e] else 1.0
            value = math.sqrt(math.sqrt(t * t2) * (1.0 + math.sqrt(d * d2)))
            out[path] = max(out[path], value * (1 - link[path] / length[path]) * prior)
    return out


def main_text(page: str | None, share: float | None = None) -> str:
    """The article of the page; empty if there is none."""
    share = SHARE if share is None else share
    p = Page(page or "")
    under, content = p.settle()
    nodes = p.nodes
    if not nodes:
        return ""
    fused = fused_ratios(nodes, under, content)
    best = max((fused[b[0]] for b in nodes if not under[b[1]]), default=0.0) or max(fused.values())
    chosen = [i for i, b in enumerate(nodes) if fused[b[0]] >= share * best]
    if not chosen:
        return ""
    first, last = chosen[0], chosen[-1]
    region = content[nodes[first][1]]
    if region and all(content[nodes[i][1]] == region for i in chosen):
        inside = [i for i, b in enumerate(nodes) if content[b[1]] == region]
    else:
        while first and nodes[first - 1][4] and not under[nodes[first - 1][1]]:
            first -= 1
        inside = range(first, last + 1)
    taken = set(chosen)
    return "\n".join(nodes[i][2] for i in inside if i in taken or not under[nodes[i][1]])


OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=OUT)

    cols = F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")
    return pages.select(*cols).mapInArrow(run, C.ddl(OUT))


def op4_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(C.table(spark, sf_dir, "pages"))
