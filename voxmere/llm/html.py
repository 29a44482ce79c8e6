"""HTML extraction through wrappers inferred for each host.

A page becomes a stream of tags and texts, and that an expression in which, among the parts of an element, all from the
first to the last of a name form one repeated group. The expressions of a host are aligned pairwise: parts that only one
side has become optional, parts that come in another order or number become repeated groups, texts are slots. The
outcome, a union-free regular expression, is the host's wrapper. Equal expressions are counted first, and a host's are
merged in groups of bounded size, round by round, so no task holds all expressions of a host.

Then every page is aligned with its host's wrapper, which says of each text which slot it fills. Over the different pages
of a host, a text that fills one slot on more than half of the pages that have the slot is template; what varies is
content. That holds inside article and main elements, too, where only pages count whose article varies by a third or more, so
that copies of one story don't make it a template. Other slots in article or main elements are the article where pages have such
elements; which of the two is learned from what the host's slots hold. Elsewhere the article is what varies and isn't mostly
links. Elements and names that say of themselves that they hold something else (menus, adverts, comments) are left out.
"""

from __future__ import annotations

import html as html_lib
import json
import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmere.llm.text import shared_checkpoint

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>=]|=)*+)>|<[!?][^>]*>""", re.DOTALL)
UNENDED = re.compile(r"<[a-zA-Z/!?]")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
# Elements by what HTML says of them, and names that sites give to what isn't the article.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
SKIPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "svg", "menu", "dialog", "script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "object", "canvas", "audio", "video"}
HINTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "copyright", "disqus", "footer", "legal", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "related", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets"}
HEADERS = {"header", "masthead"}
CLOSES_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "header", "footer", "nav", "form", "blockquote", "pre", "figure", "main", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "address", "details", "fieldset"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROOTS = ("article", "main")
WHOLE = {"html", "body", *ROOTS}
NUMBERED = re.compile("[A-Za-z]*[0-9][A-Za-z0-9]*")
STATES = re.compile(r"(?:has|with|without|no|not|is)[-_]")
PLAIN, MAIN, ARTICLE = 0, 1, 2


class Node:
    """An element: its name for alignment, whether it is left out, and its children, elements and texts."""

    __slots__ = ("name", "key", "skip", "children", "inside")

    def __init__(self, name: str, attributes: str = "", inside: bool = False):
        given = {m[1].lower(): next(x for x in m.groups()[1:] if x is not None) for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        said = {x for g in given.values() for token in g.lower().split() if not STATES.match(token) for x in re.split(r"[^a-z]+", token)} if name not in WHOLE or inside else set()
        self.name = name
        label = (given.get("class") or given.get("id") or given.get("role") or "").split()
        self.skip = name in SKIPPED or bool(said & HINTS) or not inside and (name in HEADERS or bool(said & HEADERS))
        self.key = ("!" if self.skip else "") + (f"{name}.{NUMBERED.sub('0', label[0])}" if label else name)
        self.inside = inside or name in ROOTS
        self.children: list[Node | str] = []


def parse(text: str) -> Node:
    """Element tree of a page; unclosed, unopened and crossed tags are taken as browsers do, roughly.

    How many elements of a name are open is counted, so that a tag that closes nothing isn't searched for. A tag or comment
    that the page ends in is left out.
    """
    top = Node("#")
    stack, at, end, opened = [top], 0, len(text), Counter()

    def add(piece: str) -> None:
        if piece:
            stack[-1].children.append(html_lib.unescape(piece))

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x.name] -= 1
        del stack[k:]

    last = text.rfind(">")
    while at < end:
        m = TOKEN.search(text, at) if at <= last else None
        if m is None:
            add(UNENDED.split(text[at:], maxsplit=1)[0])
            break
        add(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if opened[name]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
            continue
        if name in CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    close(k)
                    break
                if stack[k].name not in INLINE:
                    break
        if name in SIBLINGS and any(opened[x] for x in SIBLINGS[name]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in SIBLINGS[name]:
                    close(k)
                    break
                if stack[k].name in ("ul", "ol", "dl", "table", "select"):
                    break
        node = Node(name, m[3], stack[-1].inside)
        stack[-1].children.append(node)
        if name in RAW:
            found = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(text, at)
            at = found.end() if found else end
        elif name not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[name] += 1
    return top


# An expression: [key, least, most, group, parts]. most is 1 or 2 (many); the parts of one element have different keys, and
# neighbours of one group number (not 0) are a repeated group, each part of it optional. The key # is a text slot.
def _rising(places: list[int]) -> list[int]:
    """Which of the places form a longest rising run."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(places)
    for k, place in enumerate(places):
        at = bisect_left(tops, place)
        before[k] = piles[at - 1] if at else -1
        tops[at : at + 1], piles[at : at + 1] = [place], [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _grouped(parts: list, spans: list[tuple[str, str]] = ()) -> list:
    """parts with each key once: all from the first to the last of a key, and of each span of keys, are a repeated group."""
    first, last = {}, {}
    for k, part in enumerate(parts):
        first.setdefault(part[0], k)
        last[part[0]] = k
    ends = {}
    for a, b in [*((x, x) for x in first), *spans]:
        ends[first[a]] = max(ends.get(first[a], 0), last[b])
    out: list = []
    at = group = 0
    while at < len(parts):
        end, k = ends.get(at, at), at
        while k <= end:
            end = max(end, ends.get(k, k))
            k += 1
        held: dict[str, list] = {}
        for part in parts[at : end + 1]:
            held[part[0]] = merge(held[part[0]], part, True) if part[0] in held else [*part[:3], 0, part[4]]
        if len(held) > 1:
            group += 1
            for part in held.values():
                part[1], part[3] = 0, group
        out += held.values()
        at = end + 1
    return out


def merge(a: list, b: list, both: bool = False) -> list:
    """The expression for what either of two with the same key matches, or for both one after the other."""
    return [a[0], min(a[1], b[1]), 2 if both else max(a[2], b[2]), 0, align(a[4], b[4])]


def _spans(parts: list) -> list[tuple[str, str]]:
    """(first key, last key) of each repeated group."""
    ends: dict[int, list[str]] = {}
    for part in parts:
        if part[3]:
            ends.setdefault(part[3], []).append(part[0])
    return [(keys[0], keys[-1]) for keys in ends.values()]


def align(a: list, b: list) -> list:
    """Alignment of two lists of parts by their longest common part; what only one has becomes optional, and what stands in
    another order becomes a repeated group."""
    if not a and not b:
        return []
    there = {part[0]: k for k, part in enumerate(b)}
    common = [k for k, part in enumerate(a) if part[0] in there]
    pins = [(common[k], there[a[common[k]][0]]) for k in _rising([there[a[k][0]] for k in common])]
    lone = lambda part: [part[0], 0, part[2], 0, part[4]]
    out, i, j = [], 0, 0
    for p, q in [*pins, (len(a), len(b))]:
        out += map(lone, a[i:p])
        out += map(lone, b[j:q])
        if p < len(a):
            out.append(merge(a[p], b[q]))
        i, j = p + 1, q + 1
    spans = _spans(a) + _spans(b)
    return out if len(out) == len({part[0] for part in out}) and not spans else _grouped(out, spans)


def _flat(node: Node) -> Iterator[Node | str]:
    """Texts and block elements directly inside an element, through inline elements."""
    todo = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x.name not in INLINE:
            yield x
        elif not x.skip:
            todo.extend(reversed(x.children))


def expression(top: Node) -> list:
    """The expression of an element, however deep; elements that are left out are parts without parts."""
    order, todo = [], [top]
    while todo:
        node = todo.pop()
        within = [] if node.skip and node is not top else [x for x in _flat(node) if not isinstance(x, str) or x.strip()]
        order.append((node, within))
        todo += [x for x in within if not isinstance(x, str)]
    made: dict[int, list] = {}
    for node, within in reversed(order):
        parts = [["#", 1, 1, 0, []] if isinstance(x, str) else made.pop(id(x)) for x in within]
        joined = [x for k, x in enumerate(parts) if x[0] != "#" or not k or parts[k - 1][0] != "#"]
        made[id(node)] = [node.key, 1, 1, 0, _grouped(joined)]
    return made[id(top)]


def dump(whole: list) -> str:
    """An expression as JSON, a row (depth, key, least, most, group) for each part, the outer before the inner."""
    rows, todo = [], [(whole, 0)]
    while todo:
        part, depth = todo.pop()
        rows.append([depth, *part[:4]])
        todo.extend((x, depth + 1) for x in reversed(part[4]))
    return json.dumps(rows, separators=(",", ":"))


def load(text: str) -> list:
    """The expression that dump has written."""
    path: list[list] = []
    for depth, *part in json.loads(text):
        part.append([])
        del path[depth:]
        if path:
            path[-1][4].append(part)
        path.append(part)
    return path[0]


class Slots:
    """A host's wrapper as a tree of numbered slots, with what is known of them."""

    def __init__(self, info: str):
        known = json.loads(info)
        self.tree: dict = {"at": 0, "in": {}}
        path: list[dict] = []
        for k, (depth, key, *_) in enumerate(json.loads(known["wrapper"])):
            here = {"at": k, "in": {}} if k else self.tree
            del path[depth:]
            if path:
                path[-1]["in"][key] = here
            path.append(here)
        self.main = bool(known.get("main"))
        self.links = set(known.get("links") or ())
        self.template = {(x["slot"], x["text"]) for x in known.get("template") or ()}


_slots = lru_cache(maxsize=64)(Slots)
Block = tuple[str, int, int, int]


def blocks(top: Node, tree: dict | None = None) -> list[Block]:
    """(text, characters in links, slot, area) of the block elements in page order, white space inside each as one space,
    empty ones left out. The slot is where the element lies in the wrapper, -1 if it has no place there."""
    out: list[Block] = []
    line: list[str] = []
    links, place = 0, (-1, PLAIN)

    def flush() -> None:
        nonlocal links
        found = " ".join("".join(line).split())
        line.clear()
        if found:
            out.append((found, min(links, len(found)), *place))
        links = 0

    todo: list = [(top, tree, PLAIN, False)]
    while todo:
        x, here, area, linked = todo.pop()
        if isinstance(x, str):
            place = (here["at"] if here else -1, area)
            line.append(x)
            links += len(x.strip()) if linked else 0
        elif x is None:
            flush()
        elif x.skip and x is not top:
            line.append(" ")
        else:
            if x.name not in INLINE:
                flush()
                todo.append((None, None, area, False))
                if x is not top:
                    here = here and here["in"].get(x.key)
                if not (area == ARTICLE or x.name not in ROOTS):
                    area = ARTICLE if x.name == "article" else MAIN
            elif x.name == "br":
                line.append(" ")
            linked = linked or x.name == "a"
            todo.extend((c, here, area, linked) for c in reversed(x.children))
    flush()
    return out


def _deep() -> None:
    """Let merging follow nested elements as deep as pages nest them."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _deep()
    for batch in batches:
        shapes = [dump(expression(parse(text))) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shapes, pa.string())], ["host", "shape"])


FOLD = 64


def _fold(frame: pd.DataFrame) -> pd.DataFrame:
    """One expression for all of a group's, most frequent first."""
    _deep()
    frame = frame.sort_values(["n", "shape"], ascending=[False, True])
    whole = None
    for shape in frame["shape"]:
        part = load(shape)
        whole = part if whole is None else merge(whole, part)
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "shape": [dump(whole)], "n": [int(frame["n"].sum())]})


def _fold_hosts(shapes: DataFrame) -> DataFrame:
    """One row for each host from rows (host, shape, n), in rounds of groups of about FOLD expressions."""
    while True:
        shapes = shared_checkpoint(shapes)
        sizes = shapes.groupBy("host").agg(F.count(F.lit(1)).alias("size"))
        most = sizes.agg(F.max("size")).first()[0] or 0
        salted = shapes.join(sizes, "host").withColumn("salt", F.pmod(F.xxhash64("shape"), F.ceil(F.col("size") / FOLD)))
        shapes = salted.select("host", "shape", "n", "salt").groupBy("host", "salt").applyInPandas(lambda key, x: _fold(x), "host string, shape string, n long")
        if most <= FOLD:
            return shapes


def _host(url):
    return F.coalesce(F.regexp_extract(F.lower(url), "^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, pages): for each host its expression as JSON (see dump) and its number of pages."""
    named = pages.select(_host(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    shaped = named.mapInArrow(_survey, "host string, shape string")
    whole = _fold_hosts(shaped.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n")))
    return shared_checkpoint(whole.select("host", F.col("shape").alias("wrapper"), F.col("n").alias("pages")))


BROADCAST_BYTES = 16 << 20


def _with_info(pages: DataFrame, infos: DataFrame, schema: str, use) -> DataFrame:
    """use(batch, infos of its rows) over pages (first column: host), with rows (host, info) broadcast if they have
    BROADCAST_BYTES at most, which is measured, and joined by host else."""
    size = infos.agg(F.coalesce(F.sum(F.octet_length("info") + F.octet_length("host") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["info"] for r in infos.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from use(batch, [shared.value[h] for h in batch.column(0).to_pylist()])

        return pages.mapInArrow(run, schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from use(batch, batch.column(batch.num_columns - 1).to_pylist())

    return pages.join(infos, "host").select(*pages.columns, "info").mapInArrow(joined, schema)


_FILLED = [("host", pa.string()), ("page", pa.int64()), ("slot", pa.int32()), ("area", pa.int32()), ("text", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())]


def _fill(batch: pa.RecordBatch, infos: list[str]) -> Iterator[pa.RecordBatch]:
    """What each page's slots hold: a row for each text."""
    rows = []
    for host, text, info in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), infos, strict=True):
        page, held = xxhash.xxh64_intdigest(text) >> 1, {}
        for found, links, slot, area in blocks(parse(text), _slots(info).tree):
            key = (slot, area, xxhash.xxh64_intdigest(found) >> 1)
            chars, linked = held.get(key, (0, 0))
            held[key] = (chars + len(found), linked + links)
        rows += [(host, page, *key, *sums) for key, sums in held.items()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(_FILLED)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _FILLED, strict=True)], [n for n, _ in _FILLED])


def _told(filled: DataFrame) -> DataFrame:
    """(host, slot, area, text, chars, links, fixed): the texts of all slots, and whether they fill theirs on most different pages."""
    # written, so that Spark can split a host with very many texts when they meet their slot's count
    spread = shared_checkpoint(filled.select("host", "slot", "area", "page").distinct().groupBy("host", "slot", "area").agg(F.count(F.lit(1)).alias("pages")))
    once = filled.groupBy("host", "slot", "area", "text", "page").agg(F.max("chars").alias("chars"), F.max("links").alias("links"))
    texts = once.groupBy("host", "slot", "area", "text").agg(F.count(F.lit(1)).alias("m"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    return texts.join(spread, ["host", "slot", "area"]).withColumn("fixed", (F.col("m") >= 3) & (F.col("m") * 2 > F.col("pages")))


def learn_slots(pages: DataFrame, wrappers: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, info): of each host, as JSON, its wrapper, its template (texts that fill a slot on more than half of the
    different pages that have it, three at least), the slots whose other texts are mostly links, and whether its main
    elements hold more outside their article elements than in them.

    Inside article and main elements a text is template only if it is one among the pages whose article, less all such
    texts, keeps a third of its characters: pages that share their story tell nothing of the template. Hosts of fewer than three
    different pages have no template; null urls count as host '', null html as a page without texts; no pages, no rows.
    """
    named = pages.select(_host(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    bare = wrappers.select("host", F.to_json(F.struct("wrapper")).alias("info"))
    filled = shared_checkpoint(_with_info(named, bare, "host string, page long, slot int, area int, text long, chars long, links long", _fill))
    told = shared_checkpoint(_told(filled))
    within = told.filter("fixed and area > 0").select("host", "slot", "area", "text", F.lit(True).alias("held"))
    inside = filled.filter("area > 0").join(within.select("host").distinct(), "host", "left_semi").join(within, ["host", "slot", "area", "text"], "left")
    shown = inside.groupBy("host", "page").agg(F.sum("chars").alias("whole"), F.sum(F.when(F.col("held"), F.col("chars")).otherwise(0)).alias("same")).filter("(whole - same) * 3 >= whole")
    proven = _told(inside.join(shown.select("host", "page").distinct(), ["host", "page"], "left_semi")).filter("fixed").select("host", "slot", "area", "text", F.lit(True).alias("proven"))
    told = told.join(proven, ["host", "slot", "area", "text"], "left").withColumn("fixed", F.when(F.col("area") == PLAIN, F.col("fixed")).otherwise(F.coalesce("proven", F.lit(False))))
    told = shared_checkpoint(told.drop("proven"))
    varying = told.filter("not fixed").groupBy("host", "slot", "area").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    by_host = varying.groupBy("host").agg(
        F.sum(F.when(F.col("area") == MAIN, F.col("chars")).otherwise(0)).alias("in_main"),
        F.sum(F.when(F.col("area") == ARTICLE, F.col("chars")).otherwise(0)).alias("in_article"),
        F.collect_list(F.when((F.col("area") == PLAIN) & (F.col("links") * 2 > F.col("chars")), F.col("slot"))).alias("linky"),
    )
    fixed = told.filter("fixed").groupBy("host").agg(F.collect_list(F.struct("slot", "text")).alias("template"))
    whole = wrappers.join(by_host, "host", "left").join(fixed, "host", "left")
    return shared_checkpoint(whole.select("host", F.to_json(F.struct("wrapper", (F.col("in_main") > F.col("in_article")).alias("main"), F.col("linky").alias("links"), "template")).alias("info")))


def article(found: list[Block], slots: Slots) -> list[str]:
    """The texts of a page that are its article, from the slots that they fill."""
    told = [b for b in found if b[1] * 2 <= len(b[0]) and not (b[1] and b[2] in slots.links)]
    for area in (MAIN, ARTICLE) if slots.main else (ARTICLE, MAIN):
        if within := [b for b in found if b[3] >= area]:
            told = within
            break
    return [b[0] for b in told if not slots.template or (b[2], xxhash.xxh64_intdigest(b[0]) >> 1) not in slots.template]


def _extract(batch: pa.RecordBatch, infos: list[str]) -> Iterator[pa.RecordBatch]:
    texts = []
    for text, info in zip(batch.column(1).to_pylist(), infos, strict=True):
        slots = _slots(info)
        texts.append("\n".join(article(blocks(parse(text), slots.tree), slots)))
    yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars), one row for each row of pages, from whole pages of any length and depth.

    A null html gives an empty text, a null url counts as host ''. Null ids and repeated rows are kept as they are;
    equal pages of a host count once when its template is learned. Other columns are not read. An empty table gives no
    rows.
    """
    infos = learn_slots(pages, infer_wrappers(pages, url_col, html_col), url_col, html_col)
    base = pages.select(_host(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    kind = base.schema["id"].dataType.simpleString()
    out = _with_info(base, infos, f"id {kind}, url string, text string, n_chars long", _extract)
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
