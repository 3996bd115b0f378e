"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one a block of the page, and each line weighs as much as the text it has outside links. Lines that are nothing but links weigh nothing; lines in containers named as something else than an
article (menus, headers of the page, footers, asides, forms, notices, adverts, comments) count against text. Over a sliding window of lines the weights of text are summed. Text surges where
the sum reaches a share of the page's typical line (half of the page's text stands in lines as long or longer), and dives where a whole window has no text. All between the first surge and the last dive is kept, with the lines of text that
lead to the surge, but for lines that count against and for dives in between. So short lines before, between or after rows of links or clutter
(a date, a slogan, a copyright line) go without being named, while a short last line of the story stays.

A page's own marks (article, main) are weights: lines in one gain half of what a surge takes, and lines outside weigh nothing; but where a stretch outside is longer than all text inside, as beside a mere
teaser, the marks weigh nothing. Where nothing surges, names of classes are forgiven, and the page is read again: its text stands in a container that is badly named.

A null or empty page gives an empty text. Character references are decoded, also without a semicolon
where HTML allows that; references cut short stay as they are. White space inside a block becomes one
space, and blocks are joined by a line feed in page order.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..runtime import ship
from .bpe import texts_of

WINDOW = 3
SURGE, MOST = 0.2, 80  # a window's sum at a surge: of the page's typical line, and never more than so many code points
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)[^<]*\Z", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Element names of HTML by what they do.
RAW = frozenset("script style template noscript textarea select svg math iframe object canvas audio video title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output progress q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLUTTER = frozenset("nav footer aside form button menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class and id names that tell clutter.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer sidebar sidebars widget widgets"
    " comment comments disqus reply replies respond cookie cookies consent gdpr notice notices popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended"
    " toolbar pagination pager skip copyright masthead topbar alert".split()
)
NOT = frozenset("has no with without".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "tr": frozenset(["tr"]), "td": frozenset("td th tr".split()), "th": frozenset("td th tr".split()), "option": frozenset(["option"])}


def named_clutter(attributes: str) -> bool:
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and any(WORDS & parts and not NOT & parts for parts in (set(re.split(r"[^a-z0-9]+", x)) for x in value.split())):
            return True
    return False


def lines(page: str, named: bool = True) -> list[tuple[str, int, int, bool, bool]]:
    """Of each block: its text, the code points of it in links, how many clutter containers (by element or, if `named`, by attributes) hold it, whether an article does, and whether no letter or digit stands outside links."""
    out: list[tuple[str, int, int, bool, bool]] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each is clutter
    text: list[str] = []
    clutter = article = links = in_link = hidden = 0  # hidden: clutter inside a line of text
    deep: dict[str, int] = {}
    bare = True

    def end_block():
        nonlocal links, bare
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                out.append((line, links, clutter, article > 0, bare and links > 0))
            text.clear()
        links, bare = 0, True

    def pop():
        nonlocal clutter, article, in_link, hidden
        name, bad = stack.pop()
        deep[name] -= 1
        clutter -= bad
        article -= name in ("article", "main")
        in_link -= name == "a"
        hidden -= bad and name in INLINE

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and not hidden:
            part = page[at:stop]
            text.append(part)
            if in_link:
                links += len(part)
            elif bare:
                bare = not any(map(str.isalnum, html.unescape(part)))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        closing = bool(m[1] or m[4])
        if name in RAW and not closing:
            if name not in ("title",) and (m[3] or "").rstrip().endswith("/") and name in ("svg", "math"):
                continue
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            if name not in INLINE:
                text.append(" ")
            continue
        if name == "br":
            text.append(" ")
            continue
        if name not in INLINE:
            end_block()
        if closing:
            if deep.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in VOID:
            continue
        while stack and (shut := next((x for x, _ in reversed(stack) if x not in INLINE), None)) in CLOSED_BY and name in CLOSED_BY[shut]:
            while stack[-1][0] != shut:
                pop()
            pop()
        bad = name in CLUTTER or name == "header" and not article or named and name not in ("html", "body", "article", "main") and named_clutter(m[3] or "")
        stack.append((name, bad))
        deep[name] = deep.get(name, 0) + 1
        if bad and name in INLINE:
            hidden += 1
        clutter += bad
        article += name in ("article", "main")
        in_link += name == "a"
    end_block()
    return out


def typical(weights: list[int]) -> int:
    """The length of line such that half of the text stands in lines as long or longer."""
    half, most = sum(n for n in weights if n > 0) / 2, 0
    for n in sorted((n for n in weights if n > 0), reverse=True):
        most += n
        if most >= half:
            return n
    return 0


def stretches(weights: list[int], surge: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """From which to which line (not included) text lies between a surge and the next dive of the windows' sums."""
    out, first, last = [], None, None  # first: of the lines of text since the last dive; last: one of those
    risen, total = False, 0
    for i, n in enumerate([*weights, *[0] * window]):
        total += max(n, 0) - (max(weights[i - window], 0) if i >= window else 0)
        if n > 0:
            first, last = i if first is None else first, i
            risen = risen or total >= surge
        elif total == 0 and first is not None:
            if risen:
                out.append((first, last + 1))
            first, risen = None, False
    return out


def longest_outside(weights: list[int], found: list[tuple[str, int, int, bool, bool]], window: int = WINDOW) -> int:
    """The text of the longest stretch outside articles."""
    own = [0 if line[3] else n for n, line in zip(weights, found)]
    return max((sum(max(n, 0) for n in own[a:b]) for a, b in stretches(own, 1, window)), default=0)


def weighed(found: list[tuple[str, int, int, bool, bool]]) -> list[int]:
    """What each line weighs; -1 where it counts against text."""
    weights = [-1 if c else 0 if bare else max(1, len(x) - li) for x, li, c, _, bare in found]
    inside = sum(len(x) for x, _, c, a, _ in found if a and not c)
    if not inside or inside < longest_outside(weights, found):
        return weights
    gain = round(min(MOST, SURGE * typical([len(x) if a and not c else 0 for x, _, c, a, _ in found])) / 2)
    return [-1 if c else len(x) + gain if a else 0 for x, _, c, a, _ in found]


def chosen(weights: list[int], window: int = WINDOW) -> list[int]:
    """The lines between surges and dives."""
    parts = stretches(weights, max(1.0, min(MOST, SURGE * typical(weights))), window)
    if not parts:
        return []
    out, empty = [], []
    for i in range(parts[0][0], parts[-1][1]):
        if weights[i] <= 0:
            empty.append(i)
            continue
        out += [k for k in empty if weights[k] == 0] if len(empty) < window else []  # else a dive
        out.append(i)
        empty = []
    return out


def main_text(page: str | None) -> str:
    for named in (True, False):
        found = lines(page or "", named)
        kept = chosen(weighed(found))
        if kept or not found:
            break
    return "\n".join(found[i][0] for i in kept) if found else ""


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            found = [main_text(x) for x in texts_of(batch, "html")]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, StructType([rows.schema["page_id"], rows.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())]))
