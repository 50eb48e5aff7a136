"""Main text of web pages by wrappers inferred per host (union-free regular expressions).

A page is read as a tree of block elements with text slots.  Neighbours with one label fold
into a repeated item, repeated stretches into repeated groups, so pages of one template give
few different skeletons.  The skeletons of a host are aligned one after the other into its
wrapper: equal labels merge, what only one side has becomes optional, text that differs becomes
a slot (text that never differs stays a template string, if the pages differ otherwise).  There are no alternatives: a wrapper
is a sequence of items that occur once, optionally, or repeatedly.  Items know how much text
and link text their slots held, which tells where the main text is if no element says so.

In the wrapper every slot is decided once: inside the main region and not below an element for
menus, headers, footers, sidebars, notices, adverts, forms, scripts or comments.  A page is
then matched against its host's wrapper and its kept slots, one block each, are the text.

Pages with an article or main element of their own and pages without have separate wrappers,
so a host that mixes both kinds decides the region of each kind by itself.

Every task aligns the pages it reads, two wrappers a host at most; only these move.  They are
aligned in sorted streams that hold one host at a time, first per (host, salt), then per
host, so a host with a third of all pages is spread over many tasks.  Pages meet the rules of
their host by (host, salt) too.

Defined results: null html is the empty page, whose text is empty; a null or odd url is the
host ''.  Null ids and repeated rows are kept, each with its result.  An empty table gives an
empty result.  Other columns are ignored.  Elements nested deeper than ``MAX_DEPTH`` count as
children of the element at that depth.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, prepare, written

MAX_DEPTH = 120
SALTS = 32
MAX_ITEMS = 24        # items of one element before they generalise to a repeated group of optional items
#: Without an end tag these run to the end of the page (as in browsers; a template swallows end tags too).
RAW_TEXT = {"script", "style", "textarea", "iframe", "noembed", "noframes", "xmp", "template"}
#: Skipped with what they hold; without an end tag only the start tag is.
RAW = RAW_TEXT | {"noscript", "svg", "math", "select", "button", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header html legend li main menu nav ol p pre search section summary table
tbody td tfoot th thead title tr ul""".split())
#: An open element of these ends when one of the given ones begins.
ENDS = {"p": BLOCK - {"html", "body", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
        "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "head": {"body"},
        **{f"h{i}": {f"h{j}" for j in range(1, 7)} for i in range(1, 7)}}
SCOPES = {"table", "td", "th", "ul", "ol", "dl", "article", "div", "section", "nav", "aside", "main", "body"}
NOT_MAIN = {"nav", "footer", "aside", "form", "head", "title", "menu", "dialog", "fieldset", "search"}
#: Words of class, id and role that mark what is not the article.
NOT_MAIN_WORDS = set("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment
comments consent cookie cookies disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter
notice notices notification outbrain pagination pager paywall popup promo promoted promotion related recommended reply
replies search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget
alert alerts complementary contentinfo dialog""".split())
MAIN_WORDS = set("article articlebody main story entry post content".split())
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z", re.S)
ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


# -- pages to trees -------------------------------------------------------------------------------

class Node:
    """Element: ``label`` is its tag and the words of class, id, role and itemprop."""

    __slots__ = ("tag", "label", "children")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.children = tag, label, []


class Text:
    """One block of text; ``linked`` counts its characters inside links."""

    __slots__ = ("text", "linked")

    def __init__(self, text: str, linked: int):
        self.text, self.linked = text, linked


def _label(tag: str, attrs: str) -> str:
    words = set()
    if attrs:
        for m in ATTR.finditer(attrs):
            value = m[2] or m[3] or m[4] or ""
            # numbers in names count rows, not templates
            words |= {w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if w}
    return ".".join([tag, *sorted(words)])


def parse(page: str | None) -> Node:
    """Tree of block elements; text is decoded, its white space collapsed, one node a block."""
    root = Node("#root", "#root")
    stack, pieces, links, linked = [root], [], 0, 0
    unclosed: set[str] = set()          # a page of many open elements is searched once for each tag

    def flush():
        nonlocal pieces, linked
        if pieces:
            text = " ".join(html_lib.unescape("".join(pieces)).split())
            if text:
                stack[-1].children.append(Text(text, min(linked, len(text))))
            pieces, linked = [], 0
    src, at, n = page or "", 0, len(page or "")
    while at < n:
        m = TOKEN.search(src, at)
        end = m.start() if m else n
        if end > at:
            pieces.append(src[at:end])
            if links:
                linked += end - at
        if not m:
            break
        at = m.end()
        if m[0].startswith("<![CDATA["):
            pieces.append(html_lib.escape(m[0][9:-3]))
            continue
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attrs = name.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in RAW and not closing:
            if not attrs.endswith("/") and tag not in unclosed:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(src, at)
                if close:
                    at = close.end()
                elif tag in RAW_TEXT:
                    at = n
                else:
                    unclosed.add(tag)
            pieces.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "br" or tag == "hr":
            pieces.append(" ")
            if tag == "hr":
                flush()
        elif tag in BLOCK:
            flush()
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in SCOPES and tag not in SCOPES and tag not in BLOCK - {"p", "li", "dd", "dt"}:
                        break
            else:
                links = 0
                while len(stack) > 1 and tag in ENDS.get(stack[-1].tag, ()):
                    stack.pop()
                if tag == "li":
                    # an open item ends through its open blocks, up to its list
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag == "li":
                            del stack[i:]
                            break
                        if stack[i].tag in SCOPES:
                            break
                node = Node(tag, _label(tag, attrs))
                stack[-1].children.append(node)
                if len(stack) < MAX_DEPTH:
                    stack.append(node)
    flush()
    return root


# -- wrappers ----------------------------------------------------------------------------------------
# An item is a list: [label, least, most, items, slot]; most 0 stands for any number.  Elements and
# groups ("()") have items; a text ("#") has a slot [page bodies, characters, linked, digest of the template string or None].
# Page bodies are digests of the different pages that have the text, the smallest TEMPLATE_PAGES of them: copies of a
# page, and equal texts within one, count once, however the pages are dealt.

GROUP, TEXT = "()", "#"
TEMPLATE_PAGES = 3    # different pages that a text is equal on, to be a template string


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _body(node: Node) -> str:
    """Digest of the page's texts outside menus, headers and the like."""
    texts: list[str] = []

    def take(n: Node):
        for c in n.children:
            if isinstance(c, Text):
                texts.append(c.text)
            elif not _excluded(c.label, False):
                take(c)
    take(node)
    return _digest("\n".join(texts))


def _items(node: Node, bodies: list[str]) -> list:
    out = []
    for c in node.children:
        if isinstance(c, Text):
            out.append([TEXT, 1, 1, [], [bodies, len(c.text), c.linked, _digest(c.text)]])
        else:
            out.append([c.label, 1, 1, _items(c, bodies), None])
    return fold(out)


def skeleton(page: str | None) -> list:
    """The page as the wrapper of itself."""
    root = parse(page)
    return ["#root", 1, 1, _items(root, [_body(root)]), None]


def _merge_slot(a, b):
    if a is None or b is None:
        return a or b
    bodies = a[0] if a[0] == b[0] else sorted({*a[0], *b[0]})[:TEMPLATE_PAGES]
    return [bodies, a[1] + b[1], a[2] + b[2], a[3] if a[3] == b[3] else None]


def _is_template(slot: list) -> bool:
    """The text is equal on different pages (the bodies differ, so other texts of these pages do)."""
    return slot[3] is not None and len(slot[0]) >= TEMPLATE_PAGES


def merge(a: list, b: list) -> list:
    """One item for two of equal label."""
    return [a[0], min(a[1], b[1]), 0 if 0 in (a[2], b[2]) else 1, align(a[3], b[3]), _merge_slot(a[4], b[4])]


def _key(item: list):
    return item[0] if item[0] != GROUP else (GROUP, *(_key(i) for i in item[3]))


def fold(items: list) -> list:
    """Neighbours of one label become one repeated item, repeated stretches one repeated group."""
    out: list = []
    for it in items:
        if out and _key(out[-1]) == _key(it):
            out[-1] = merge(out[-1], it)
            out[-1][2] = 0
        else:
            out.append(it)
    keys = [_key(i) for i in out]
    size = 2
    while size * 2 <= len(out) and size <= 6:
        i = 0
        while i + 2 * size <= len(out):
            if keys[i:i + size] == keys[i + size:i + 2 * size]:
                body = out[i:i + size]
                j = i + size
                while keys[j:j + size] == keys[i:i + size]:
                    body = [merge(x, y) for x, y in zip(body, out[j:j + size])]
                    j += size
                group = [GROUP, 1, 0, body, None]
                out[i:j], keys[i:j] = [group], [_key(group)]
            i += 1
        size += 1
    if len(out) > MAX_ITEMS:
        out = [_generalise(out)]
    return out


def _generalise(items: list) -> list:
    """A repeated group of optional items, one for each label: matches any order of them."""
    flat: dict = {}

    def take(its):
        for it in its:
            if it[0] == GROUP:
                take(it[3])
            else:
                k = _key(it)
                flat[k] = merge(flat[k], it) if k in flat else list(it)
    take(items)
    return [GROUP, 1, 0, [[i[0], 0, 1, i[3], i[4]] for i in flat.values()], None]


def align(a: list, b: list) -> list:
    """Longest common subsequence of two item lists; what has no partner becomes optional."""
    if not a or not b:
        return [[i[0], 0, *i[2:]] for i in a or b]
    ka, kb = [_key(i) for i in a], [_key(i) for i in b]
    if ka == kb:
        return [merge(x, y) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    if any(i[0] == GROUP for i in a + b) and (len(a) == 1 or len(b) == 1):
        # a general group takes what it can hold in any order
        for one, other in ((a, b), (b, a)):
            if len(one) == 1 and one[0][0] == GROUP and all(i[1] == 0 for i in one[0][3]):
                return [_generalise(one + other)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + 1 if ka[i] == kb[j] else 0)
    out, i, j = [], 0, 0
    while i < n and j < m:
        if ka[i] == kb[j] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], 0, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], 0, *b[j][2:]])
            j += 1
    out += [[x[0], 0, *x[2:]] for x in a[i:] + b[j:]]
    return fold(out) if out else out


def add_page(wrapper: list | None, other: list) -> list:
    return other if wrapper is None else merge(wrapper, other)


def add_pair(pair: list | None, other: list) -> list:
    """Wrappers of a host's pages without and with a main element of their own, each or None."""
    return other if pair is None else [a if b is None else add_page(a, b) for a, b in zip(pair, other)]


def page_pair(page: str | None) -> list:
    own = skeleton(page)
    return [None, own] if _has_main(own) else [own, None]


# -- what to keep ----------------------------------------------------------------------------------

def _excluded(label: str, inside_main: bool) -> bool:
    tag, *words = label.split(".")
    if tag in NOT_MAIN or (tag == "header" and not inside_main):
        return True
    found = NOT_MAIN_WORDS & set(words)
    # the article's own header holds its title
    return bool(found - {"header"} if inside_main else found) and tag not in ("html", "body", "article", "main")


def _is_main(label: str) -> bool:
    tag, *words = label.split(".")
    return tag in ("article", "main") or "articlebody" in words or ("main" in words and "content" in words)


def _mass(item: list, inside: bool = False) -> int:
    """Characters outside links in the item's slots that are not excluded (template strings do
    not count)."""
    label = item[0]
    if label == TEXT:
        _, chars, linked, _ = item[4]
        return 0 if _is_template(item[4]) else chars - linked if linked * 2 <= chars else 0
    if label != GROUP and _excluded(label, inside):
        return 0
    return sum(_mass(i, inside or _is_main(label)) for i in item[3])


def _has_main(item: list) -> bool:
    if item[0] == TEXT:
        return False
    if item[0] != GROUP:
        if _excluded(item[0], False):
            return False
        if _is_main(item[0]):
            return True
    return any(map(_has_main, item[3]))


def _mark(item: list, inside: bool, out: bool, region: list | None) -> list:
    label = item[0]
    if label == TEXT:
        _, chars, linked, _ = item[4]
        template = region is not None and _is_template(item[4])
        keep = inside and not out and not template and (region is None or linked * 2 <= chars)
        return [TEXT, item[2] == 0, [], keep, out]
    if label != GROUP:
        inside = inside or item is region or (region is None and _is_main(label))
        out = out or _excluded(label, inside)
    return [label, item[2] == 0, [_mark(i, inside, out, region) for i in item[3]], inside, out]


def decide(wrapper: list) -> list:
    """The wrapper as ``[label, repeated, items, keep, out]``: ``keep`` says of a text slot whether
    it belongs to the main text (of an element, whether it lies in the main region)."""
    region = None
    if not _has_main(wrapper):
        # the deepest element that holds most of the free text
        region = wrapper
        while True:
            inner = [i for x in region[3] for i in (x[3] if x[0] == GROUP else [x]) if i[0] not in (TEXT, GROUP)]
            top = max(inner, key=_mass, default=None)
            if top is None or _mass(top) * 5 < 4 * max(_mass(region), 1) or top[0].split(".")[0] in ("p", "li", "h1"):
                break
            region = top
    return _mark(wrapper, False, False, region)


def _flat(items: list):
    for it in items:
        if it[0] == GROUP:
            yield from ((i, True) for i, _ in _flat(it[2]))
        else:
            yield it, it[1]


def _node_has_main(node: Node) -> bool:
    """``_has_main`` of the page's own skeleton."""
    if _excluded(node.label, False):
        return False
    return _is_main(node.label) or any(_node_has_main(c) for c in node.children if isinstance(c, Node))


def extract(page: str | None, rules: list | None = None, pair: list | None = None) -> str:
    """Kept blocks of a page in order, joined by newlines; of a ``pair`` of rules, those of its kind hold."""
    root = parse(page)
    if pair is not None:
        rules = pair[_node_has_main(root)]
    if rules is None:
        rules = decide(skeleton(page))
    out: list[str] = []

    def walk(node: Node, rule: list):
        items = list(_flat(rule[2]))
        places: dict[str, list[int]] = {}
        for i, (it, _) in enumerate(items):
            places.setdefault(it[0], []).append(i)
        at = 0
        for c in node.children:
            where = places.get(TEXT if isinstance(c, Text) else c.label)
            if where:
                # the next place of this label; in a repeated group that is over, its first
                i = next((p for p in where if p >= at), where[0])
                found, again = items[i]
                at = i if again else i + 1
            elif isinstance(c, Text):
                found = [TEXT, False, [], rule[3] and not rule[4], rule[4]]
            else:           # an element that the wrapper has not seen is judged by itself
                found = _mark([c.label, 1, 1, _items(c, []), None], rule[3], rule[4], None)
            if not isinstance(c, Text):
                walk(c, found)
            elif found[3]:
                out.append(c.text)
    walk(root, rules)
    return "\n".join(out)


# -- Spark -----------------------------------------------------------------------------------------------

HELD_HOSTS = 500      # wrappers that a task holds before it passes them on


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def _dump(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _align_pages(frames):
    """(host, html) rows -> (host, pair of wrappers) rows, one for each host of the task."""
    held: dict[str, list] = {}
    for f in frames:
        for host, page in zip(f["host"], f["html"]):
            held[host] = add_pair(held.get(host), page_pair(page))
        if len(held) > HELD_HOSTS:
            yield pd.DataFrame({"host": list(held), "wrapper": [_dump(w) for w in held.values()]})
            held = {}
    if held:
        yield pd.DataFrame({"host": list(held), "wrapper": [_dump(w) for w in held.values()]})


def _align_wrappers(frames):
    """Rows sorted by (host, wrapper) -> one row a host; holds one host at a time."""
    host, wrapper = None, None
    for f in frames:
        done = []
        for h, w in zip(f["host"], f["wrapper"]):
            if h != host:
                if wrapper is not None:
                    done.append((host, _dump(wrapper)))
                host, wrapper = h, None
            wrapper = add_pair(wrapper, json.loads(w))
        if done:
            yield pd.DataFrame(done, columns=["host", "wrapper"])
    if wrapper is not None:
        yield pd.DataFrame([(host, _dump(wrapper))], columns=["host", "wrapper"])


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, wrapper)``: the pair of wrappers of every host as JSON (a written table)."""
    need(pages, url_col, html_col)
    prepare(pages.sparkSession)
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "host string, wrapper string"
    first = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    some = first.mapInPandas(_align_pages, schema)
    salted = some.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = salted.repartition(parts, "host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper")
    some = some.mapInPandas(_align_wrappers, schema)
    return written(some.repartition(parts, "host").sortWithinPartitions("host", "wrapper")
                   .mapInPandas(_align_wrappers, schema), "wrappers")


@lru_cache(maxsize=512)
def _rules(wrapper: str) -> list:
    return [w and decide(w) for w in json.loads(wrapper)]


def _texts(html: pd.Series, wrapper: pd.Series) -> pd.Series:
    return pd.Series([extract(h, pair=_rules(w)) for h, w in zip(html, wrapper)], dtype="object")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  wrappers: DataFrame | None = None) -> DataFrame:
    """One row per page: ``page_id, url, text``."""
    need(pages, id_col, url_col, html_col)
    wrappers = wrappers or infer_wrappers(pages, url_col, html_col)
    udf = F.pandas_udf(_texts, T.StringType())
    src = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                       F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    src = src.withColumn("host", host_of(F.col("url"))).withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
    spread = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return src.join(spread, ["host", "salt"]).select("page_id", "url", udf("html", "wrapper").alias("text"))
