"""Operator 6: main text of HTML pages by tree scoring.

Blocks of text pass points for their length and commas to their parent and, halved, to their grandparent, discounted by the share of
their text in links. The element with the most points, discounted by its own link density, or the <article> or <main> that it lies in, is the
container; it is kept with those siblings that read like text. Menus, headers and footers outside the article, sidebars, notices, adverts, forms, scripts, styles and
comments are cut out before, by tag, role or whole words of class and id.

Edge cases: null, empty and tagless html: the text itself counts as one block, empty gives an empty string. Unclosed and stray tags
are repaired as browsers do for paragraphs, list items and cells. No page, block or nesting depth is capped. Repeated rows get equal
results; null page_id and url are carried; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PARAGRAPH = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CUT_TAGS = frozenset("nav footer aside form button select option menu dialog svg canvas object embed audio video map head datalist fieldset".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar widget menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations pagination pager toolbar".split()
)
KEEP_TAGS = frozenset("html body main article".split())
PRIOR = {"article": 10.0, "main": 8.0, "section": 2.0, "div": 2.0}
# Tags that end an open element of the first kind.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>)", re.S)
# Behind the last >: comments and declarations that never end.
REST = re.compile(r"<[!?].*", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
COMMA = re.compile("[,，、،؛;]")


def _cut(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in CUT_TAGS or (tag == "header" and not in_article):
        return True
    if not attrs or tag in KEEP_TAGS:
        return False
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in CUT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id") and not (in_article and tag == "header") and not CUT_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
    return False


class Page:
    """Elements in document order, with parent and last descendant, and the text blocks of those that are not cut out.

    Made in one pass: the depths at which each tag is open are kept, so that no step walks the open elements.
    """

    def __init__(self, html: str):
        self.tags, self.parent, self.end = ["#root"], [-1], [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        stack, holders, buf, link, at = [0], [0], [], 0, 0
        depths: dict[str, list[int]] = {"#root": [0]}
        cut, links, articles = -1, 0, 0  # depth of the stack at which a cut element began; open <a>; open <article> or <main>
        last = html.rfind(">")  # no tag ends behind it

        def flush() -> None:
            nonlocal link
            if buf:
                text = " ".join(unescape("".join(buf)).split())
                if text:
                    self.blocks.append((holders[-1], text, min(link, len(text))))
                buf.clear()
            link = 0

        def close(depth: int) -> None:
            nonlocal cut, links, articles
            while len(stack) > depth:
                tag = self.tags[stack[-1]]
                if tag not in INLINE and cut < 0:
                    flush()
                k = stack.pop()
                depths[tag].pop()
                if tag not in INLINE:
                    holders.pop()
                self.end[k] = len(self.tags) - 1
                links -= tag == "a"
                articles -= tag in ("article", "main")
                if cut >= len(stack):
                    cut = -1
                    flush()

        def find(tags: set[str], until: set[str]) -> int:
            """The depth of the innermost open one of tags, 0 if there is none or one of until lies inside."""
            d = max((depths[t][-1] for t in tags if depths.get(t)), default=0)
            return d if d > max((depths[t][-1] for t in until if depths.get(t)), default=0) else 0

        while at < len(html):
            m = TAG.search(html, at) if at <= last else REST.search(html, at)
            stop = m.start() if m else len(html)
            if stop > at and cut < 0:
                buf.append(html[at:stop])
                if links:
                    link += stop - at
            if not m:
                break
            at = m.end()
            if m.re is REST:
                continue
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            attrs = m[3] or m[6] or ""
            if m[1] or m[4]:
                if tag == "br":
                    buf.append(" ")
                elif tag == "p" and not find({"p"}, set()) and cut < 0:
                    flush()
                elif d := find({tag}, {"article", "main", "body"} - {tag} if tag in INLINE or tag == "p" else set()):
                    close(d)
                continue
            if tag in RAW:
                if tag != "title" and attrs.endswith("/"):
                    continue
                e = re.compile(rf"</{re.escape(tag)}\b", re.I).search(html, at)
                at = html.find(">", e.end()) + 1 if e and e.end() <= last else len(html)
                if cut < 0 and tag not in INLINE:
                    buf.append(" ")
                continue
            if tag in ("html", "body") and find({tag}, set()):
                continue
            if tag in VOID:
                if cut < 0:
                    if tag == "hr":
                        flush()
                    elif tag == "br":
                        buf.append(" ")
                continue
            if tag not in INLINE and (d := find({"p"}, {"table", "article", "section", "button"})):
                close(d)
            if tag in HEADINGS and self.tags[stack[-1]] in HEADINGS:
                close(len(stack) - 1)
            if tag in CLOSES and (d := find(*CLOSES[tag])):
                close(d)
            if tag == "a" and (d := find({"a"}, {"td", "li", "div", "p"})):
                close(d)
            if tag == "body" and cut >= 0:
                close(max(find({"head"}, set()), 1))
            if tag not in INLINE and cut < 0:
                flush()
            k = len(self.tags)
            self.tags.append(tag)
            self.parent.append(stack[-1])
            self.end.append(k)
            if attrs.endswith("/") and tag in INLINE:
                continue
            if cut < 0 and _cut(tag, attrs, articles > 0):
                flush()
                cut = len(stack)
            depths.setdefault(tag, []).append(len(stack))
            stack.append(k)
            if tag not in INLINE:
                holders.append(k)
            links += tag == "a"
            articles += tag in ("article", "main")
        if cut < 0:
            flush()
        close(0)

    def text(self) -> str:
        if not self.blocks:
            return ""
        n = len(self.tags)
        score, size, linked = [0.0] * n, [0] * n, [0] * n
        for k, text, link in self.blocks:
            points = (1 + len(COMMA.findall(text)) + min(len(text) / 100, 3)) * (1 - link / len(text))
            up = self.parent[k] if self.tags[k] in PARAGRAPH and k else k
            score[up] += points
            if self.parent[up] >= 0:
                score[self.parent[up]] += points / 2
            size[k] += len(text)
            linked[k] += link
        for k in range(n - 1, 0, -1):
            size[self.parent[k]] += size[k]
            linked[self.parent[k]] += linked[k]
        worth = [(s + PRIOR.get(t, 0.0)) * (1 - b / a) if s and a else 0.0 for s, t, a, b in zip(score, self.tags, size, linked)]
        best = max(range(n), key=lambda k: (worth[k], -k))
        # The text of an article is one text, however short its sections: the outermost <article> around the best element, else <main>.
        around, top = [best], worth[best]
        while self.parent[around[-1]] >= 0:
            around.append(self.parent[around[-1]])
        best = next((k for tag in ("article", "main") for k in reversed(around) if self.tags[k] == tag), best)
        # Kept elements as the steps of a sum over all elements.
        steps, up = [0] * (n + 1), self.parent[best]
        steps[best] += 1
        steps[self.end[best] + 1] -= 1
        if up >= 0:
            for s in range(up + 1, n):
                if self.parent[s] != up or s == best or not size[s]:
                    continue
                dense, tag = linked[s] / size[s], self.tags[s]
                if worth[s] >= 0.2 * top and dense < 0.5 or tag in PARAGRAPH and dense < 0.25 and (size[s] > 80 or tag in HEADINGS):
                    steps[s] += 1
                    steps[self.end[s] + 1] -= 1
        kept = list(accumulate(steps))
        return "\n".join(t for k, t, _ in self.blocks if kept[k] > 0)


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(make, "page_id long, url string, text string, n_chars long")


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
