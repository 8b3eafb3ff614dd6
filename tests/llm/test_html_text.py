"""HTML extraction against a twin over a real tree, with thresholds, broken markup and times."""

import math
import random
import re
import time
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from fieldweave.llm import html_text as H


class Tree(HTMLParser):
    """Text nodes of well-formed pages of div, p, ul, li, h1, article, nav, script and a, by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.nodes, self.buf, self.linked, self.ads = [], [], "", 0, 0
        self.feed(page)
        self.close()

    def flush(self):
        text = " ".join(self.buf.split())
        if text and not {"nav", "script"} & {t for t, _, _ in self.stack}:
            blocks = [s for s in self.stack if s[0] != "a"]
            self.nodes.append((tuple((t, c) for t, c, _ in blocks), text, self.linked, [i for t, _, i in blocks if t == "article"], any(c == "ads" for _, c, _ in blocks), bool(blocks) and blocks[-1][0] == "h1"))
        self.buf, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag != "a":
            self.flush()
        self.ads += 1
        self.stack.append((tag, dict(attrs).get("class", ""), self.ads))

    def handle_endtag(self, tag):
        if tag != "a":
            self.flush()
        self.stack.pop()

    def handle_data(self, data):
        self.buf += data
        if any(t == "a" for t, _, _ in self.stack):
            self.linked += len(data.strip())


def twin(page, share):
    nodes = Tree(page).nodes
    paths = defaultdict(list)
    for p, *rest in nodes:
        paths[p].append(rest)
    own = {p: (sum(len(r[0]) for r in v) / len(v), sum(len(re.findall("[.,;:!?]", r[0])) for r in v) / len(v), 1 - sum(r[1] for r in v) / sum(len(r[0]) for r in v)) for p, v in paths.items()}
    fused = defaultdict(float)
    for ads in (False, True):
        row = [n for n in nodes if n[4] == ads]
        for i, n in enumerate(row):
            near = [(math.exp(-(d * d) / 2), own[row[i + d][0]]) for d in (-2, -1, 0, 1, 2) if 0 <= i + d < len(row)]
            t, d = (sum(w * o[k] for w, o in near) / sum(w for w, _ in near) for k in (0, 1))
            o = own[n[0]]
            fused[n[0]] = max(fused[n[0]], math.sqrt(math.sqrt(t * o[0]) * (1 + math.sqrt(d * o[1]))) * o[2] * (0.05 if ads else 4 if n[3] else 1))
    if not nodes:
        return ""
    best = max((fused[n[0]] for n in nodes if not n[4]), default=0) or max(fused.values())
    chosen = [i for i, n in enumerate(nodes) if fused[n[0]] >= share * best]
    a, b = chosen[0], chosen[-1]
    article = nodes[a][3][:1]
    if article and all(nodes[i][3][:1] == article for i in chosen):
        inside = [i for i, n in enumerate(nodes) if n[3][:1] == article]
    else:
        while a and nodes[a - 1][5] and not nodes[a - 1][4]:
            a -= 1
        inside = range(a, b + 1)
    return "\n".join(nodes[i][1] for i in inside if i in chosen or not nodes[i][4])


def a_page(r):
    def prose(n):
        return " ".join(r.choice(["one,", "two", "three.", "four;", "five"]) for _ in range(n))

    def part(depth, ads=False):
        # a container of an article has no penalty, which the twin does not know
        k = r.choice(["p", "p", "p", "div", "ads", "ul", "h1", "nav", "text", "script"] + ["article"] * (not ads))
        if k == "p":
            return f"<p>{prose(r.randint(1, 60))} <a href='x'>{prose(r.randint(0, 3))}</a></p>"
        if k == "h1":
            return f"<h1>{prose(4)}</h1>"
        if k == "ul":
            return "<ul>" + "".join(f"<li><a>{prose(2)}</a></li>" for _ in range(r.randint(1, 6))) + "</ul>"
        if k == "script":
            return "<script>if (a < b) { '<p>no</p>' }</script>"
        if k == "text":
            return prose(5)
        inner = "".join(part(depth + 1, ads or k == "ads") for _ in range(r.randint(1, 4))) if depth < 3 else prose(8)
        return {"div": f"<div>{inner}</div>", "ads": f"<div class='ads'>{inner}</div>", "nav": f"<nav>{inner}</nav>", "article": f"<article>{inner}</article>"}[k]

    # an article of some weight, so that nothing under a penalty holds most of the text
    return "<html><body><div>" + "".join(part(0) for _ in range(r.randint(1, 7))) + f"<article><p>{prose(300)}</p></article></div></body></html>"


@pytest.mark.parametrize("share", [0.0, 0.1, H.SHARE, 0.6, 0.9])
def test_against_a_twin(share):
    r = random.Random(11)
    for _ in range(300):
        page = a_page(r)
        assert H.main_text(page, share) == twin(page, share), page


def test_the_threshold_selects():
    sizes = (300, 150, 60, 20, 4)
    page = "".join(f"<section class='{c}'><p>" + "word, " * n + f"{c}</p></section>" for c, n in zip("vwxyz", sizes))
    got = [H.main_text(page, s) for s in (0.0, 0.05, 0.1, 0.3, 0.6, 0.9)]
    assert all(a.startswith(b) and len(a) >= len(b) for a, b in zip(got, got[1:]))
    assert len({len(x) for x in got}) >= 4 and got[0].count("\n") == 4 and "\n" not in got[-1]


def test_titles_links_and_notes_of_an_article_stay():
    for page, want in (
        ("<article><div class='article-header'><h1>Title</h1></div><p>Long text, here it is. And more, of it.</p></article>", "Title\nLong text, here it is. And more, of it."),
        ("<article><h1><a href=x>Title</a></h1><p>Text one, two. three</p><ul><li><a>Reference one</a></li></ul><p class='legal-note'>Note.</p></article>", "Title\nText one, two. three\nReference one\nNote."),
        ("<p>Seen <span style='display:none'>not</span> text, long enough.</p>", "Seen text, long enough."),
        ("<div class='content no-sidebar'><div><p>First part, with text; and more.</p></div><div><p>Second part, it has text.</p></div></div>", "First part, with text; and more.\nSecond part, it has text."),
    ):
        assert H.main_text(page) == want


@pytest.mark.parametrize("unit", ["<div>", "<a '", "<a x='", "<b>", "<li>", "<p><div class=x>y", "<!--", "<script>", "<", "&", "</i>", "<i><div></i>", "<article>x", "<td><table>"])
def test_time_is_linear(unit):
    def took(n):
        page = unit * (n // len(unit))
        t = time.process_time()
        H.main_text(page)
        return time.process_time() - t

    took(1000)
    assert took(1_000_000) < 40 * max(took(100_000), 0.02)
