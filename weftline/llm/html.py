"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. A line's weight is
its text length outside links (none if most of it is linked), and :data:`ARTICLE_BONUS` more inside an
``article`` or ``main`` element (linked or not); lines in boilerplate elements
(by tag, role, class or id) have no weight. Weights are summed over sliding
windows of :data:`WINDOW` lines. A surge point is where the sum climbs over the
page's threshold, a dive point where it falls to nothing; lines with weight
between a surge and its dive are the main text, inside an ``article`` or not.

Defined results: null and empty pages, and pages without a surge, have the empty
text; character references are decoded once, after markup is stripped; repeated
rows give repeated rows, an empty table an empty table; columns other than id,
url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

WINDOW = 3
#: Added to the weight of a line inside an article: a short paragraph or a linked heading counts there.
ARTICLE_BONUS = 40
#: Least window sum of a surge, in characters.
SURGE = 120

# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav header footer aside form menu button select dialog head search".split())
MAIN = frozenset("article main".split())

# Words in class, id and role that mark boilerplate.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|complementary|contentinfo|cookies?|consent|disqus|footer|gdpr|header|masthead|menu\w*|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo\w*|related|replies|respond|search|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CLOSING = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


def lines(page: str) -> list[tuple[str, int]]:
    """Text and weight of each block that has text."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    free: list[str] = []  # outside links
    stack: list[tuple[str, bool, bool]] = []  # tag, boilerplate, main
    boiler = main = anchor = 0

    def end() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                plain = " ".join(entities.unescape("".join(free)).split())
                weight = 0 if boiler or 2 * len(plain) < len(line) else len(plain)
                if main and not boiler:
                    weight += ARTICLE_BONUS
                out.append((line, weight))
            text.clear()
            free.clear()

    def put(piece: str) -> None:
        if piece:
            text.append(piece)
            if not anchor:
                free.append(piece)

    at = 0
    while m := TAG.search(page, at):
        put(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        close = (m[1] or m[4]) == "/"
        if name == "a":
            anchor = max(0, anchor + (-1 if close else 1))
            continue
        if name in RAW:
            if not close:
                stop = CLOSING[name].search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if name not in BLOCKS and name not in MAIN:
            continue
        end()
        if name in VOID:
            continue
        anchor = 0
        if close:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for _, b, a in stack[k:]:
                        boiler -= b
                        main -= a
                    del stack[k:]
                    break
        else:
            if name in ("p", "li") and stack and stack[-1][0] == name:  # these close themselves
                _, b, a = stack.pop()
                boiler -= b
                main -= a
            # the header of an article belongs to it
            b = name in BOILERPLATE and not (name == "header" and main) or name not in MAIN and any(MARKS.search(x) for v in ATTRIBUTE.findall(m[3] or m[6] or "") for x in v if x) and name not in ("body", "html")
            a = name in MAIN
            stack.append((name, b, a))
            boiler += b
            main += a
    put(page[at:])
    end()
    return out


def main_text(page: str | None) -> str:
    found = lines(page or "")
    if not found:
        return ""
    weight = np.array([w for _, w in found], np.int64)
    total = np.cumsum(np.r_[0, weight, np.zeros(WINDOW - 1, np.int64)])
    sums = total[WINDOW:] - total[:-WINDOW]
    need = min(SURGE, max(1, int(sums.max()) // 4))
    keep, inside = [], False
    for i, (line, _) in enumerate(found):
        if not inside:
            inside = sums[i] >= need and weight[i] > 0
        elif sums[i] == 0:
            inside = False
        if inside and weight[i]:
            keep.append(line)
    return "\n".join(keep)


def extract(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, url, text`` of every page."""

    def run(keys, urls, sources):
        return {key: keys, url: urls, "text": [main_text(s) for s in sources]}

    kind = pages.schema[key].dataType.simpleString()
    return map_rows(pages.select(key, url, html), lambda: run, f"`{key}` {kind}, `{url}` string, text string")


def op2_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
