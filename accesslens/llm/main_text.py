"""Main text of web pages by line-block distribution: text lengths over sliding line windows, surge and dive points."""

import html as references
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from accesslens.llm.common import pieces

#: Lines in a sliding window.
WINDOW = 3

# A comment, declaration or tag; one that is never closed runs to the end of the page.
_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
                    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))|([^\s=\"'/]+)")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rp rt s samp "
                    "small span strike strong sub sup time tt u var wbr td th".split())
_DROPPED = frozenset("nav footer aside form button select option datalist dialog menu svg math canvas object video "
                     "audio map head".split())
_REGIONS = frozenset("article main section header footer nav aside form table body".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
                   "toolbar".split())
# Words of class and id names that mark what is no article.
_WORDS = frozenset("ad ads adsense adslot advert adverts advertisement advertisements advertising banner breadcrumb "
                   "breadcrumbs comment commentlist comments consent cookie cookies copyright disclaimer disqus footer "
                   "gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification "
                   "overlay pager pagination popup promo promoted promotion recommended related replies reply respond "
                   "responses search share sharing sidebar signup social sponsor sponsored subscribe subscription "
                   "teaser toolbar widget widgets".split())
# Elements that may wrongly stay open, or lie around a whole page.
_LEAKY = frozenset("nav header footer form button head".split())
_NOT_MEANT = ("no-", "has-", "with-", "without-", "no_", "has_", "with_")


def _attributes(source):
    found = {}
    for name, quoted, single, bare, alone in _ATTRIBUTE.findall(source):
        found.setdefault((name or alone).lower(), references.unescape(quoted or single or bare))
    return found


def _boilerplate(name, attributes):
    """Whether an element's name, role, class or id says that it is no part of an article."""
    if name in _DROPPED:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "")):
        return True
    if name in ("article", "main", "html", "body"):
        # Whole words only: a post may be of class "comment-open".
        return name == "article" and bool(_WORDS & set(attributes.get("class", "").lower().split()))
    if attributes.get("role") in _ROLES:
        return True
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        if not token.startswith(_NOT_MEANT) and _WORDS & set(re.split(r"[-_]+", token)):
            return True
    return False


class _Lines:
    """Strips the markup of one page; ``found`` holds its lines as (text, weight, whether in an article).

    A line is the text of one block; its weight is the number of characters that count, links none outside articles.
    Boilerplate elements leave no text. Region boundaries outside articles are kept as (key, None, False): a sectioning
    element has the empty key, a named ``div`` its class and id.
    """

    def __init__(self, page):
        self.found, self.regions = [], Counter()
        self.parts, self.linked, self.breaks = [], 0, 0
        self.stack, self.open, self.shut, self.article, self.link = [], Counter(), 0, 0, False
        position = 0
        while (token := _TOKEN.search(page, position)) is not None:
            self.text(page[position:token.start()])
            position = token.end()
            closing, name = token.group(1) or token.group(4), (token.group(2) or token.group(5) or "").lower()
            if closing:
                self.end(name)
            elif name in _RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, position)
                position = end.end() if end else len(page)
            elif name == "br":
                self.line_break()
            elif name:
                self.start(name, token.group(3) or token.group(6) or "")
        self.text(page[position:])
        self.line()

    def text(self, source):
        if self.shut or not source:
            return
        text = references.unescape(source) if "&" in source else source
        if not text.isspace():
            self.breaks = 0
            if self.link and not self.article:
                self.linked += sum(map(len, text.split()))
        self.parts.append(text)

    def line_break(self):
        """One line break is white space, two in a row end the block."""
        self.breaks += 1
        if self.breaks == 2:
            self.line()
        else:
            self.parts.append(" ")

    def line(self):
        words = "".join(self.parts).split()
        if words:
            self.found.append((" ".join(words), sum(map(len, words)) - self.linked, self.article > 0))
        self.parts, self.linked, self.breaks = [], 0, 0

    def border(self, key):
        self.line()
        if key is not None and not self.article:
            self.found.append((key, None, False))

    def start(self, name, source):
        if name in _VOID:
            if name == "hr":
                self.line()
            return
        if name not in _INLINE and self.open["p"]:
            self.end("p")
        attributes = _attributes(source) if source.strip(" /\n\t") else {}
        if name == "a":
            self.link = "href" in attributes
            return
        key = "" if name in _REGIONS else None
        if name == "div" and ("id" in attributes or "class" in attributes):
            key = f"{attributes.get('class', '')}#{attributes.get('id', '')}"
            self.regions[key] += 1
        if name not in _INLINE:
            self.border(key)
        elif name in ("td", "th"):
            self.parts.append(" ")
        drop = _boilerplate(name, attributes) or (name == "header" and not self.article)
        self.stack.append((name, self.shut, self.article, drop, key))
        self.open[name] += 1
        if drop:
            self.shut += 1
        elif name in ("article", "main"):
            # An article opens even within a menu that was never closed or a form around the page.
            if self.shut and not self.article and all(s[0] in _LEAKY for s in self.stack if s[3]):
                self.shut = 0
            if not self.shut:
                self.article += 1

    def end(self, name):
        if name == "a":
            self.link = False
            return
        if not self.open[name]:
            if name not in _INLINE:
                self.line()
            return
        top = None
        while top != name:
            top, shut, article, _, key = self.stack.pop()
            self.open[top] -= 1
            if top not in _INLINE:
                self.line()
            elif top in ("td", "th"):
                self.parts.append(" ")
            self.shut, self.article = shut, article
            if top not in _INLINE:
                self.border(key)


def line_blocks(page, window=WINDOW):
    """(texts, weights) of the lines of a page without its markup, blank lines at the borders of regions.

    Lines outside articles weigh nothing where the page has an article with text. A named ``div`` is a region if its
    name occurs once on the page: repeated ones are paragraphs.
    """
    lines = _Lines(page)
    marked = any(inside and weight for _, weight, inside in lines.found)
    texts, weights = [], []
    for text, weight, inside in lines.found:
        if weight is None:
            if text == "" or lines.regions[text] == 1:
                texts += [""] * window
                weights += [0] * window
        else:
            texts.append(text)
            weights.append(weight if inside or not marked else 0)
    return texts, weights, marked


def main_lines(page, window=WINDOW):
    """The lines between the surge and dive points of a page.

    The sum of the weights over a sliding window surges where it leaves zero and dives where it falls back to zero. Of
    the stretches between, those count whose peak reaches a third of the page's peak; in a marked article every stretch
    counts, because only its own lines have a weight.
    """
    texts, weights, marked = line_blocks(page, window)
    if not any(weights):
        return []
    padded = np.concatenate([np.zeros(window - 1, np.int64), np.array(weights, np.int64)])
    total = np.cumsum(np.concatenate([[0], padded]))
    # sums[i]: the window that ends at line i.
    sums = total[window:] - total[:-window]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (sums > 0).astype(np.int8), [0]])))
    floor = 1 if marked else max(1, -(-int(sums.max()) // 3))
    kept = []
    for surge, dive in zip(edges[::2], edges[1::2]):
        if sums[surge:dive].max() >= floor:
            kept += texts[surge:dive]
    return [text for text in kept if text]


def _main_text(page):
    return "\n".join(main_lines(page)) if page else ""


def extract_main_text(pages, id_col="page_id", url_col="url", html_col="html"):
    """(page_id, url, text, n_chars) of every row of ``pages``: the article of each page.

    Markup, scripts, styles, comments, hidden elements, menus, headers, footers, sidebars, notices, adverts, forms and
    reader comments are stripped by element, role and class or id words. Of the lines left, the line-block distribution
    (``main_lines``) keeps those between surge and dive points. Character references are decoded, white space in a block
    becomes one space, blocks are joined by one line feed. The title in the page's head is no part of the text.

    A null or empty page, or one without any text, gives an empty text with n_chars 0. Ids and urls may be null and
    repeat; every row gives one row. Pages are independent and read whole: a very long one is a step of its own.
    Unclosed elements, comments and scripts run to the end of their parent or of the page. Other columns are ignored.
    """
    def extract(batches):
        for ids, urls, sources in pieces(batches, text_column=2):
            texts = [_main_text(source) for source in sources]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                          F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
