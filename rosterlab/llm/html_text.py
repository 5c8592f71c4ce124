"""Main text of web pages by equivalence classes of template tokens.

Pages of a host are handled in groups of about ``GROUP`` pages. A page becomes a sequence of tokens: start and end tags
and text blocks, each told apart by the path of elements around it. The occurrence vector of a token counts it on every
page of the group. Tokens with equal vectors form a class; a class is valid if its tokens come in one order on every page
and large enough to be no accident. The class found once on every page is the root of the template; the other valid
classes nest in the gaps between two of its tokens. What is left of a page, outside all template tokens, are its slots.

The text of a page is what lies inside the article, or failing that the main element. On pages without either the template
tells: of its elements, which stand once on every page, the main one is found from the outside inwards, going on into an element as long as
it holds most of the text in slots, that is text which is not the same on all pages. All text inside it stays, also what
all pages share; elements beside it (menus, notices, footers of any name) go. So which text stays depends on where it stands, never on
how many pages share it, and a group needs two different pages to tell, no more. Of a page that stands alone, or whose group holds
copies only, everything is kept.

Slots inside menus, headers, footers, sidebars, notices, adverts, forms and comments are left out, told by the names and roles of
elements and by class and id words. The words count only for elements that hold no article or main element and are none, and only if
they leave some text of the page.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line end. Null
html counts as empty. Rows are kept as they are, repeated ones too; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
import sys
from collections import Counter, defaultdict

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .urls import host_and_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pages of a group; a group of any size from two different pages on tells the template.
GROUP = 48
#: Share of the slot text of an element that one inside it must hold to be the main one.
MOST = 0.6
#: Most hosts with a count of their own that are broadcast.
HOSTS = 500_000

# Elements by their meaning in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody tfoot "
    "thead title tr ul".split()
)
SPACED = frozenset("br td th img input wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe".split())
#: Elements of other languages, where a start tag with /> is a whole element.
FOREIGN = frozenset("svg math".split())
ASIDE = frozenset("nav header footer aside form head menu button select dialog fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer footer form header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup "
    "promo promoted related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "toolbar widget widgets".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(sorted(RAW)) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<svg(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<!/)>.*?</svg\s*>"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<more>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Element:
    __slots__ = ("name", "path", "aside", "strict", "parent", "inside")

    def __init__(self, name: str, attributes: str, parent):
        self.name, self.parent = name, parent
        known = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        words = re.split(r"[^a-z0-9]+", f"{known.get('class', '')} {known.get('id', '')}".lower()) if known else []
        label = known.get("class", "").lower()
        self.path = f"{parent.path if parent else ''}/{name}{'.' + label if label else ''}"
        self.inside = name if name in ("article", "main") else (parent.inside if parent else None)
        content = name in ("article", "main", "body", "html")
        self.strict = not content and (name in ASIDE or known.get("role", "").lower() in ASIDE_ROLES or "hidden" in known)
        own = self.strict or (not content and not ASIDE_WORDS.isdisjoint(words))
        # an article or main element begins anew, whatever the words of elements around it
        self.aside = own or bool(parent and parent.aside and (name not in ("article", "main") or parent.forced))

    @property
    def forced(self) -> bool:
        """Whether this element or one around it is an aside by name or role."""
        return self.strict or bool(self.parent and self.parent.forced)


def tokens(page: str) -> list[tuple]:
    """``(kind, key, text, element)`` in page order; kind is tag or text, key names the token with its path."""
    out: list[tuple] = []
    top, parts, at = None, [], 0

    def block():
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(("text", f"{where.path if where else ''}#{text}", text, where))

    where = None
    for m in [*_TOKEN.finditer(page), None]:
        stop = m.start() if m else len(page)
        if stop > at:
            if not parts or top is where:
                where = top
            parts.append(_html.unescape(page[at:stop]))
        if m is None:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in SPACED:
            parts.append(" ")
        if name in BLOCKS:
            block()
        if m["end"]:
            e = top
            while e and e.name != name:
                e = e.parent
            if e:
                while top is not e:  # elements left open end here
                    top = top.parent
                if name in BLOCKS:
                    out.append(("tag", f"{top.path}/>", "", top))
                top = top.parent
            where = top
        elif name not in VOID and not (name in FOREIGN and m["more"].endswith("/")):
            if name in BLOCKS:
                e = top
                while e and (e.name == "p" or e.name not in BLOCKS):  # a block ends an open paragraph
                    if e.name == "p":
                        top = e.parent
                    e = e.parent
                if name == "li" and top and top.name == "li":
                    top = top.parent
            if name in BLOCKS:
                top = Element(name, m["more"], top)
                out.append(("tag", top.path, "", top))
            else:
                top = _inline(name, m["more"], top)
            if not parts or name in BLOCKS:
                where = top
    block()
    return out


def _inline(name: str, attributes: str, parent):
    """An inline element: it counts as an aside by its attributes, but not in the path of what it holds."""
    e = Element(name, attributes, parent)
    e.path = parent.path if parent else ""
    return e


def template(pages: list[list[tuple]]) -> tuple[list[str], dict]:
    """Root tokens in their order, and the nested classes by the gap between root tokens that holds them."""
    n = len(pages)
    counts: dict[str, list[int]] = defaultdict(lambda: [0] * n)
    for i, page in enumerate(pages):
        for key, times in Counter(t[1] for t in page).items():
            counts[key][i] = times
    classes: dict[tuple, list[str]] = defaultdict(list)
    for key, vector in counts.items():
        if sum(v > 0 for v in vector) > n / 2:
            classes[tuple(vector)].append(key)
    root = _ordered(classes.pop((1,) * n, []), pages)
    place = {k: i for i, k in enumerate(root)}
    nested: dict[int, list] = defaultdict(list)
    for vector, keys in classes.items():
        if len(keys) < 2 or not _ordered(keys, pages, exact=True):
            continue
        gaps, members = set(), set(keys)
        for page in pages:
            gap = -1
            for t in page:
                gap = place.get(t[1], gap)
                if t[1] in members:
                    gaps.add(gap)
        if len(gaps) == 1:  # nested: all of it lies in one gap
            nested[gaps.pop()].append(keys)
    return root, dict(nested)


def _ordered(keys: list[str], pages: list[list[tuple]], exact: bool = False) -> list[str]:
    """The tokens in the order they have on every page. ``exact``: repeated as a whole, else nothing; else the
    tokens whose order differs anywhere are left out."""
    members = set(keys)
    runs = [[t[1] for t in page if t[1] in members] for page in pages]
    runs = [r for r in runs if r]
    if not runs:
        return []
    if exact:
        unit = list(dict.fromkeys(runs[0]))
        return unit if all(r == unit * (len(r) // len(unit)) for r in runs) else []
    while True:
        first = {k: i for i, k in enumerate(runs[0])}
        bad = Counter()
        for r in runs[1:]:
            high = -1
            for k in r:
                if first[k] < high:
                    bad[k] += 1
                high = max(high, first[k])
        if not bad:
            return runs[0]
        runs = [[k for k in r if k not in bad] for r in runs]


def main_element(parsed: list[list[tuple]], root: list[str], nested: dict) -> str | None:
    """Path of the template element that is the main one of a group, or None if the template tells nothing."""
    fixed = {k for k in root if "#" in k} | {k for ks in nested.values() for keys in ks for k in keys if "#" in k}
    known = {k for k in root if "#" not in k and not k.endswith("/>")}
    mass: Counter = Counter()
    for page in parsed:
        for kind, key, text, e in page:
            if kind == "text" and key not in fixed and not _left_out(e):
                while e:
                    if e.path in known:
                        mass[e.path] += len(text)
                    e = e.parent
    best = None
    for path in sorted(mass, key=lambda p: (p.count("/"), -mass[p])):  # outer elements first
        if best is None:
            best = path if mass[path] == max(mass.values()) else None
        elif path.startswith(best + "/") and mass[path] >= MOST * mass[best]:
            best = path
    return best


def extract_group(pages: list[str]) -> list[str]:
    """Main texts of the pages of one group."""
    parsed = [tokens(p) for p in pages]
    distinct = list({tuple(t[1] for t in p): p for p in parsed if p}.values())
    bare = any(all(kind != "text" or not (e and e.inside) for kind, _, _, e in page) for page in distinct)
    main = main_element(distinct, *template(distinct)) if bare and len(distinct) > 1 else None
    out = []
    for page in parsed:
        texts = [(text, e) for kind, _, text, e in page if kind == "text"]
        chosen = []
        for left_out in (_left_out, _no_text):  # class words that leave nothing are no sign of an aside
            slots = [(text, e) for text, e in texts if not left_out(e)]
            for inside in ("article", "main"):
                chosen = chosen or [text for text, e in slots if e and e.inside == inside]
            chosen = chosen or [text for text, e in slots if main and _within(e, main)] or [text for text, e in slots]
            if chosen:
                break
        out.append("\n".join(chosen))
    return out


def _within(e, path: str) -> bool:
    while e:
        if e.path == path:
            return True
        e = e.parent
    return False


def _no_text(e) -> bool:
    """Whether the element is no article text by names and roles alone."""
    return bool(e and e.forced)


def _left_out(e) -> bool:
    """Whether the element lies in a part that is no article text; a heading in the header of an article is."""
    if not (e and e.aside):
        return False
    names, x = [], e
    while x and x.aside:
        names.append(x.name)
        x = x.parent
    if e.inside == "article" and names[-1] == "header" and not _HEADING.isdisjoint(names):
        return any(n in ASIDE and n != "header" for n in names)
    return True


def _group(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"page_id": rows["page_id"], "url": rows["url"], "text": extract_group([h or "" for h in rows["html"]])})


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = GROUP) -> DataFrame:
    """One row per page: ``page_id``, ``url`` and ``text``.

    A host with more than ``group`` pages is split by a hash into as many groups as it needs, so no task gets a whole host.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", host_and_path(F.col("url"))[0])
    large = written(rows.groupBy("host").count().where(F.col("count") > group).select("host", F.ceil(F.col("count") / group).alias("parts")), "hosts")
    rows = rows.join(F.broadcast(large) if large.count() <= HOSTS else large, "host", "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1)))).drop("parts")
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType())])
    return rows.groupBy("host", "part").applyInPandas(_group, schema)
