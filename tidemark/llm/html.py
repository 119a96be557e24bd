"""Main text of web pages by consensus of their hosts.

A page's containers (elements that may hold an article) are scored by the text of their own blocks, the share
of it in links, and their names. Each one has a path of tags and classes, generalised by dropping numbers. In Spark the
scores of a path are added over all pages of a host, and every page is read again with the path that
won there. A page without that path uses its own best container.

A block's white space becomes single spaces; blocks are joined in page order by a line feed. Menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and comments of readers are left out: by their tags, or by
whole names and first or last words of their classes, unless what is so named wraps the article. Null, empty and
unreadable pages give an empty text; pages with a null url vote as one host. Repeated pages are read each; extra
columns pass through; empty tables give empty ones. Unclosed elements end where HTML's rules end them, and pages
that break off give what they hold.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import checkpointed, fresh, table

HOSTS_BROADCAST = 50_000
"""The winning paths are broadcast if there are at most so many hosts, and joined with salted keys beyond."""
SALTS = 32
SLICE = 256
PATH = 256
"""Characters up to which a path is kept as it is."""
# Tags by HTML's states for attributes: a quotation mark opens a quoted value only right after the equals sign.
TAG = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|$))"
    r"|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$)|[^\s>\"'][^\s>]*+)?+)?+|=[^\s/>=]*+)*+)(?:>|$)"
    r"|/(?:[^a-zA-Z>][^>]*+)?(?:>|$)|[!?][^>]*+(?:>|$))",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|$)|'([^']*+)(?:'|$)|([^\s>\"'][^\s>]*+)))?+")
RAW = {"script", "style", "textarea", "iframe", "title", "xmp", "noembed", "noframes"}
"""Elements whose content is no markup up to their own end tag."""
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BOXES = {"article", "main", "section", "div", "td", "body", "center", "table", "tbody", "tr", "th"}
BLOCKS = BOXES | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "header", "footer", "nav", "aside", "form", "hr", "address", "details", "summary", "fieldset", "caption", "html", "head"}
WEAK, STRONG, NEVER, HARD = 1, 2, 3, 4
"""What an element is taken for: by a name that may be wrong, by a sure one, as what no article holds, by its tag."""
AWAY = {"nav": HARD, "header": HARD, "footer": HARD, "aside": HARD, "button": HARD, "select": HARD, "dialog": HARD, "menu": HARD, "head": HARD, "option": HARD, "template": HARD, "svg": HARD, "math": HARD, "form": WEAK, "fieldset": WEAK}
FOREIGN = ("svg", "math")
BREAKOUT = BLOCKS | {"b", "br", "code", "em", "i", "img", "span", "strong", "u", "small", "sub", "sup", "tt", "var", "s"}
"""HTML elements that end a foreign one."""
NAMES = {
    **dict.fromkeys("banner promo promos promotion sponsor sponsored notice popup modal overlay newsletter subscribe subscription signup login side widget widgets share sharing social foot toolbar tag tags legal search form skip".split(), WEAK),
    **dict.fromkeys("menu nav navbar navigation breadcrumb breadcrumbs sidebar related recommended recommendations footer header masthead topbar pagination pager copyright".split(), STRONG),
    **dict.fromkeys("ad ads advert adverts advertisement advertising advertorial comment comments disqus replies respond cookie cookies consent gdpr".split(), NEVER),
}
"""By the whole name of a class or id, or its last word."""
FIRST = {n: NAMES[n] for n in "ad ads advert adverts advertisement comment comments disqus cookie cookies consent gdpr nav navbar navigation breadcrumb breadcrumbs sidebar menu footer related recommended newsletter promo sponsor sponsored share sharing social popup modal widget".split()}
"""By the first word of a name of several."""
TOLD_OF = {"has", "with", "without", "no", "not", "have", "show", "shows", "hide", "hides", "is", "js", "open", "opened", "closed", "enabled", "disabled", "allowed", "active", "on", "off", "free", "none"}
"""Names that begin or end so tell of something elsewhere, as has-sidebar and comments-open do."""
WORDS = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
HIDDEN = re.compile(r"display:\s*none|visibility:\s*hidden", re.I)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_CLOSERS = BLOCKS - {"html", "head", "body"}
GOOD_NAMES = re.compile(r"article|content|entry|post|story|main|text|body", re.I)
ROW_PARENTS = {"table", "tbody", "ul", "ol", "dl"}


class Element:
    __slots__ = ("tag", "path", "zone", "box", "parent")

    def __init__(self, tag: str, path: str, zone: int, box: int, parent: Element | None):
        self.tag, self.path, self.zone, self.box, self.parent = tag, path, zone, box, parent


def _named(names: str) -> int:
    """What classes and an id tell an element to be: the surest of them, 0 if nothing."""
    found = 0
    for name in names.split():
        words = [w.lower() for w in WORDS.findall(CAMEL.sub(" ", name))]
        if words and not (len(words) > 1 and (words[0] in TOLD_OF or words[-1] in TOLD_OF)):
            found = max(found, NAMES.get("".join(words), 0), NAMES.get(words[-1], 0), FIRST.get(words[0], 0))
    return found


def _label(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted({re.sub(r"\d+", "#", c.lower()) for c in attributes.get("class", "").split()})
    return tag + "".join("." + c for c in classes)


def _path(above: str, label: str) -> str:
    """The path below another; long ones go on from a digest, so that deep pages take memory in proportion."""
    if len(above) > PATH:
        above = hashlib.blake2b(above.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    return f"{above}>{label}"


def blocks(page: str) -> tuple[list[tuple[str, int]], list[tuple[str, int, str, int, int, int, bool]]]:
    """The blocks of text outside of boilerplate, each with its box; and the boxes: (path, parent box, tag, ...).

    The numbers of a box are the characters of its own blocks, those inside links, and how many blocks it has; then
    whether an h1 is among them.
    Elements taken for boilerplate are zones; only when the page is read is it decided which of them are dropped.
    """
    raw: list[tuple[list[tuple[int, str, bool]], int]] = []  # blocks: pieces (zone, text, in a link), and the box
    boxes: list[list] = [["", -1, "", 0, 0, 0, False]]
    zones: list[list] = [[0, 0, False, False]]  # parent, kind, whether it holds an article or main element, or an h1
    stack = [Element("", "", 0, 0, None)]
    # Places in the stack, so that no tag has to search through it: those of each tag, and of all blocks.
    places: dict[str, list[int]] = defaultdict(list)
    block_places = [0]
    held: list[tuple[int, str, bool]] = []
    links = 0
    at = 0

    def text(piece: str) -> None:
        zone = stack[-1].zone
        if piece and zones[zone][1] != HARD:
            held.append((zone, html.unescape(piece), links > 0))

    def flush() -> None:
        nonlocal held
        if held:
            raw.append((held, stack[-1].box))
            held = []

    def close(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            if stack[-1].tag in BLOCKS:
                flush()
            links -= stack[-1].tag == "a"
            places[stack[-1].tag].pop()
            if stack[-1].tag in BLOCKS:
                block_places.pop()
            stack.pop()

    def last(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    # Each search starts where the last tag or raw element ended, as what looks like a tag inside a raw one is none.
    while m := TAG.search(page, at):
        tag = (m[2] or "").lower()
        text(page[at : m.start()])
        at = m.end()
        if not tag:
            continue
        if m[1]:
            k = last((tag,))
            if k and (tag in BLOCKS or k > block_places[-1]):  # an inline end tag does not reach beyond its block
                close(k)
            continue
        foreign = last(FOREIGN)
        if foreign and tag in BREAKOUT and foreign > last(("foreignobject",)):
            close(foreign)
            foreign = 0
        empty = m[3].endswith("/") and (foreign or tag in FOREIGN)
        if tag == "br":
            text(" ")
            continue
        if tag in RAW:
            # A raw element runs to its own end tag, whatever its content looks like.
            if not empty:
                end = RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if empty:
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in P_CLOSERS:
            if stack[block_places[-1]].tag == "p":
                close(block_places[-1])
            flush()
        if tag in CLOSED_BY:
            k = last(CLOSED_BY[tag])
            if k > last(ROW_PARENTS):
                close(k)
        if tag == "body" and stack[-1].tag == "head":
            close(len(stack) - 1)
        up = stack[-1]
        attributes = {n.lower(): a or b or c for n, a, b, c in ATTRIBUTE.findall(m[3])} if m[3] else {}
        path, box, zone = up.path, up.box, up.zone
        if tag in BOXES:
            path = _path(up.path, _label(tag, attributes))
            boxes.append([path, up.box, tag, 0, 0, 0, False])
            box = len(boxes) - 1
        if zones[zone][1] != HARD:
            kind = AWAY.get(tag, 0)
            if attributes and kind != HARD:
                if "hidden" in attributes or HIDDEN.search(attributes.get("style", "")):
                    kind = HARD
                elif tag not in ("html", "body", "main"):
                    kind = max(kind, _named(f"{attributes.get('class', '')} {attributes.get('id', '')}"), STRONG if attributes.get("role", "").lower() in AWAY_ROLES else 0)
            if kind:
                zones.append([zone, kind, False, False])
                zone = len(zones) - 1
            elif tag in ("article", "main"):
                zones[zone][2] = True
            elif tag == "h1":
                zones[zone][3] = boxes[box][6] = True
        places[tag].append(len(stack))
        if tag in BLOCKS:
            block_places.append(len(stack))
        stack.append(Element(tag, path, zone, box, up))
        links += tag == "a"
    if at < len(page):
        text(page[at:])
    close(1)
    flush()
    found: list[tuple[str, int]] = []
    for dropped in _dropped(zones, raw):
        for pieces, box in raw:
            block = " ".join("".join(piece for zone, piece, _ in pieces if not dropped[zone]).split())
            if block:
                found.append((block, box))
                boxes[box][3] += len(block)
                boxes[box][4] += sum(len(piece.strip()) for zone, piece, link in pieces if link and not dropped[zone])
                boxes[box][5] += 1
        if found:
            break
    return found, [tuple(b) for b in boxes]


def _dropped(zones: list[list], raw: list) -> Iterator[list[bool]]:
    """Which zones are boilerplate; further choices, ever fewer zones, count only if the ones before leave no text.

    A zone around an article or main element is a wrapper with a misleading name, and so is one with a weak name or a
    main heading that holds most of the page's text. What remains of a page without any other text are zones with
    weak names, and then those with strong ones that are not mostly links.
    """
    if len(zones) == 1:
        yield [False]
        return
    size, linked = [0] * len(zones), [0] * len(zones)
    for pieces, _ in raw:
        for zone, piece, link in pieces:
            n = len(piece.strip())
            size[zone] += n
            linked[zone] += n * link
    for zone in range(len(zones) - 1, 0, -1):
        size[zones[zone][0]] += size[zone]
        linked[zones[zone][0]] += linked[zone]
    for rescued in range(3):
        dropped = [False] * len(zones)
        for zone in range(1, len(zones)):
            parent, kind, article, heading = zones[zone]
            keep = kind != HARD and (
                article
                or 2 * size[zone] > size[0] and kind < NEVER and (kind == WEAK or heading)
                or rescued > 0 and kind == WEAK
                or rescued > 1 and kind == STRONG and 2 * linked[zone] < size[zone]
            )
            dropped[zone] = dropped[parent] or not keep
        yield dropped


def scores(boxes: list[tuple]) -> list[float]:
    """Each box's score: its own text without links, and nine tenths of that of boxes inside.

    A box that adds own blocks around an inner one wins over that inner one if they are long, or hold the main heading;
    a mere wrapper does not, nor does it make the inner one count for less farther out.
    """
    mass = [max(0.0, size - 2.0 * linked) * (1.0 + 0.1 * min(count, 20)) for _, _, _, size, linked, count, _ in boxes]
    inner, parts = [0.0] * len(boxes), [0] * len(boxes)
    total = mass[:]
    for i in range(len(boxes) - 1, -1, -1):
        _, parent, _, _, _, count, heading = boxes[i]
        wrapper = not count and parts[i] == 1
        total[i] = mass[i] + (1.0 if heading and count else 0.9) * inner[i]
        mass[i] = inner[i] if wrapper else total[i]
        if parent >= 0 and mass[i] > 0:
            inner[parent] += mass[i]
            parts[parent] += 1
    for i, (path, _, tag, *_) in enumerate(boxes):
        if tag in ("article", "main"):
            total[i] *= 1.5
        elif GOOD_NAMES.search(path.rpartition(">")[2].partition(".")[2]):
            total[i] *= 1.2
        elif tag in ("body", ""):
            total[i] *= 0.7
    return total


def extract(page: str | None, wanted: str | None) -> str:
    """The text of the boxes with the wanted path, or of the page's best one."""
    found, boxes = blocks(page or "")
    if not found:
        return ""
    inside = [wanted is not None and path == wanted for path, *_ in boxes]
    if not any(inside):
        total = scores(boxes)
        inside[max(range(len(boxes)), key=lambda i: (total[i], -i))] = True
    for i in range(1, len(boxes)):
        inside[i] = inside[i] or inside[boxes[i][1]]
    return "\n".join(block for block, box in found if inside[box])


def host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(pages: DataFrame, url: str, page: str) -> DataFrame:
    """(host, path): the path with the highest score over all pages of its host; ties go to the first path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], float] = {}
            for name, markup in zip(batch.column(0).to_pylist(), batch.column(1)):
                boxes = blocks(markup.as_py() or "")[1]
                best: dict[str, float] = {}
                for (path, *_), score in zip(boxes, scores(boxes)):
                    if path and score > 0:
                        best[path] = max(best.get(path, 0.0), score)
                # A page's votes are shares of its text, so that one long page does not outvote its host.
                top = max(best.values(), default=0.0)
                for path, score in best.items():
                    sums[name, path] = sums.get((name, path), 0.0) + score / top
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in sums], pa.string()), pa.array([p for _, p in sums], pa.string()), pa.array(list(sums.values()), pa.float64())], names=["host", "path", "score"])

    parts = pages.select(host(F.col(url)).alias("host"), F.col(page).alias("html")).mapInArrow(run, "host string, path string, score double")
    sums = parts.groupBy("host", "path").agg(F.round(F.sum("score"), 6).alias("score"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("score"), "path")).alias("path"))


def extracted(pages: DataFrame, url: str = "url", page: str = "html", to: str = "text", drop_page: bool = False, hosts_broadcast: int = HOSTS_BROADCAST) -> DataFrame:
    """pages with the main text of each."""
    (to,) = fresh(pages.drop(page) if drop_page else pages, to)
    names = [f"c{i}" for i in range(len(pages.columns))]
    at = names[pages.columns.index(page)]
    winners = checkpointed(votes(pages, f"`{url}`", f"`{page}`"))
    rows = pages.toDF(*names).withColumn("host", host(F.col(names[pages.columns.index(url)])))
    if winners.count() <= hosts_broadcast:
        rows = rows.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(at), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    rows = rows.select(*names, "path")
    kept = [n for n in names if not (drop_page and n == at)]
    where = [names.index(n) for n in kept]
    html_at = names.index(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                texts = [extract(p.as_py(), w.as_py()) for p, w in zip(batch.column(html_at), batch.column(len(names)))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in where), pa.array(texts, pa.string())], names=[*kept, "text"])

    schema = T.StructType([*(rows.schema[n] for n in kept), T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).toDF(*(pages.columns[i] for i in where), to)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, and its length in code points."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages, drop_page=True).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
