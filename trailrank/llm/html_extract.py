"""Main text of web pages by tree scoring.

The markup is read into a tree with the usual implied end tags. Each paragraph passes points for its length and its commas to its
ancestors, whole to the parent and less with every step up; an element's points are discounted by the share of its text that stands
in links, and weighed by its name and class. The best container, its siblings of any name and size, and all their blocks are kept (beside an article element
only other articles), but for elements that are no part of an article wherever they stand (menus, page headers and footers, sidebars, notices, adverts,
forms, scripts, reader comments) and, outside article elements, menus of short links. A name or class alone ends no long text: it counts against an element, and
cuts it only where it is short, made of links or a thread of comments (see ``_cut``).

Defined results: null or empty html has no text; character references are decoded; white space in a block is one space; blocks are joined
in page order by a line feed; unclosed and truncated markup is read as far as it goes; repeated rows get equal texts; an empty table gives
no rows; other columns are not read.
"""
from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns

# Element names of the markup language by their part in a page.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3
h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math noembed noframes xmp".split())
APART = frozenset("""nav aside footer form menu dialog search button select option optgroup datalist fieldset input object embed canvas audio video
map head template""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "optgroup", "option", "legend"}
#: An element that begins ends an open one of these, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
        "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
ROLES_APART = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that speak against an article, always or unless a word of the third set stands beside them.
NEVER = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion comment comments
commentlist disqus replies reply respond discussion cookie cookies consent gdpr nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar
footer masthead newsletter subscribe signup login popup modal overlay share sharing social notice notices skip""".split())
HARDLY = frozenset("""aside header banner widget widgets related recommended recommendations alert message pager pagination toolbar search form hidden
legal side foot rail teaser teasers tags meta disclaimer topbar""".split())
THREAD = frozenset("comment comments commentlist disqus replies reply respond".split())
AMBIGUOUS = frozenset({"discussion"})  # as an id it is rather a section of a paper
#: Words for boxes, places and what lies in them, which say nothing about a text beside the words above.
GENERIC = frozenset("""area article articles bar block blog body bottom box button buttons col column container content entry form global group icon icons inner item items
left link links list module outer page panel policy post posts primary reader readers right row secondary section site slot stories story text title top unit user users
visitor wrap wrapper zone widget widgets banner header header main primary""".split())
#: Labels and headings of lists of links that belong to a text.
REFERENCES = frozenset("""bibliografía bibliografia bibliographie bibliography citations einzelnachweise enlaces footnotes fuentes literatur literature notas notes quellen reading
reference references referencias refs références source sources weblinks""".split())
MENU_LINK = 25  # mean characters of a link in a menu; titles are longer
PROSE = 60  # characters of a paragraph that a list of titles can follow
MENU_SHARE = 0.8  # of a list's text in links; the rest are separators
LIKELY = frozenset("article articles body content main post entry story text page column".split())
_TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW_END = {name: re.compile("</" + name, re.I | re.A) for name in RAW}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    __slots__ = ("name", "parent", "apart", "points", "text", "linked", "weight", "links", "doubt", "threads", "headings", "references", "titles")

    def __init__(self, name: str, parent: Element | None, apart: bool, weight: float):
        self.name, self.parent, self.apart, self.weight = name, parent, apart, weight
        self.points = self.text = self.linked = 0.0
        self.links = self.doubt = self.threads = self.headings = 0
        self.references = self.titles = False


#: Doubts about an element: by a word among others in a class, by a whole class or id, by a whole class; with THREAD_DOUBT of comments; by header alone.
SOME, WHOLE, CLASS, THREAD_DOUBT, HEADER = 1, 2, 4, 8, 16


def _judge(name: str, attributes: str) -> tuple[bool, float, int, bool]:
    """Whether an element is apart from any article, the weight of its name and class, the doubts that these raise, and whether they speak of references."""
    weight = {"article": 25.0, "main": 10.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "div": 5.0, "section": 5.0}.get(name, 0.0)
    if name in APART:
        return True, weight, 0, False
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False, weight, 0, False
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True, weight, 0, False
    role = found.get("role", "")
    if role in ROLES_APART:
        return True, weight, 0, False
    if role in ("main", "article") or "articleBody" in found.get("itemprop", ""):
        weight += 25
    labels = []
    for kind in ("class", "id"):
        for label in found.get(kind, "").split():
            said = [w.lower() for w in _WORD.findall(label)]
            if said and said[0] not in ("no", "has", "with", "without"):
                labels.append((kind, said))
    sources = any(not REFERENCES.isdisjoint(said) for _, said in labels)
    if name in ("html", "body", "main", *HEADINGS) or not labels:
        return False, weight, 0, sources
    likely = any(not LIKELY.isdisjoint(said) for _, said in labels)
    against = (NEVER if not likely or name != "article" else frozenset()) | (HARDLY if not likely and name != "article" else frozenset())
    doubt = 0
    for kind, said in labels:
        bad = against - AMBIGUOUS if kind == "id" else against
        if bad.issuperset(said) or not (NEVER & bad).isdisjoint(said) and (bad | GENERIC).issuperset(said) or {"related", "recommended"} & bad & set(said) and (bad | GENERIC).issuperset(said):
            doubt |= SOME | WHOLE | (CLASS if kind == "class" else 0) | (HEADER if said == ["header"] else 0)
        elif kind == "class" and not bad.isdisjoint(said):  # an id of several words is a slug, which says what a text is about
            doubt |= SOME
        if doubt and not THREAD.isdisjoint(said):
            doubt |= THREAD_DOUBT
    return False, weight + 25 * likely - 25 * bool(doubt), doubt, sources


def _within(e: Element, names: tuple[str, ...]) -> bool:
    up = e.parent
    while up is not None and up.name not in names:
        up = up.parent
    return up is not None


def _cut(e: Element, page: float) -> bool:
    """Whether the doubts about a block suffice to cut it, now that its text and the page's text outside links are known: a label of nothing else, a thread of
    comments, or, outside an article, a word among others where links outweigh text. A header that holds a heading of an article stays."""
    if e.text - e.linked > 0.5 * page:
        return False
    if e.doubt & HEADER:
        up = e.parent
        while up is not None and up.name not in ("article", "main", "section") and up.weight < 25:
            up = up.parent
        return not (e.headings and up is not None)
    if e.doubt & WHOLE or e.doubt & THREAD_DOUBT and e.threads:
        return True
    return not _within(e, ("article",)) and e.linked > 0.5 * e.text


def _read(source: str) -> list[tuple[Element, str, float]]:
    """The blocks of a page in order: the element that holds each, its text and how much of that stands in links."""
    root = Element("", None, False, 0.0)
    stack, blocks, run, elements = [root], [], [], []
    holder = root
    in_link = 0
    linked = 0.0

    def close() -> None:
        nonlocal linked, heading
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                e, share = holder, min(linked, len(text))
                blocks.append((holder, text, share))
                heading = text if holder.name in HEADINGS else heading
                while e is not None:
                    e.text += len(text)
                    e.linked += share
                    e = e.parent
        linked = 0.0

    def pop_to(depth: int) -> None:
        nonlocal holder, in_link
        while len(stack) > depth:
            gone = stack.pop()
            in_link -= gone.name == "a"
            if gone is holder:  # a block, or an inline element that is apart
                close()
                holder = next(e for e in reversed(stack) if e.name in BLOCKS or e is root or e.apart and not e.parent.apart)

    def say(text: str) -> None:
        nonlocal linked
        if text:
            run.append(text)
            if in_link:
                linked += len(text.strip())

    at, heading = 0, ""
    while True:
        m = _TAG.search(source, at)
        if m is None:
            say(source[at:])
            break
        say(source[at:m.start()])
        at = m.end()
        ends, name = m[1], (m[2] or "").lower()
        if not name:
            continue
        if ends:
            if name == "p" and not any(e.name == "p" for e in stack):
                close()
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    pop_to(depth)
                    break
                if name not in BLOCKS and stack[depth].name in BLOCKS:
                    break  # an inline end tag closes nothing outside its block
            continue
        if name == "br":
            run.append(" ")
            continue
        if name in RAW:
            if m[3].rstrip().endswith("/"):
                continue
            stop = _RAW_END[name].search(source, at)
            if stop is None:
                break
            at = stop.start()
            end = _TAG.match(source, at)
            at = end.end() if end else len(source)
            continue
        if name in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == "p":
                    pop_to(depth)
                    break
                if stack[depth].name in BLOCKS:
                    break
        if name in ENDS:
            old, border = ENDS[name]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in border:
                    break
                if stack[depth].name in old:
                    pop_to(depth)
                    if name not in ("tr", "tbody", "tfoot"):
                        break
        parent = stack[-1]
        apart, weight, doubt, sources = _judge(name, m[3])
        if doubt and name not in BLOCKS:  # inside a sentence, a heading or code it is text
            apart = bool(doubt & CLASS) and not any(x.name in ("p", "pre", "code", *HEADINGS) for x in stack)
            doubt = 0
        e = Element(name, parent, parent.apart or apart, weight)
        elements.append(e)
        e.references = parent.references or sources
        if name in ("ul", "ol", "dl", "table"):
            close()
            before = blocks[-1] if blocks else None
            e.titles = before is not None and before[0].name == "p" and before[0].parent is parent and len(before[1]) >= PROSE
            e.references = e.references or not REFERENCES.isdisjoint(w.lower() for w in re.findall(r"\w+", heading))
        if doubt or name in HEADINGS:
            e.doubt, up = doubt, parent
            while up is not None:
                up.threads += bool(doubt & THREAD_DOUBT)
                up.headings += name in HEADINGS
                up = up.parent
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            if name == "hr":
                close()
            continue
        if name in BLOCKS:
            close()
            holder = e
        elif e.apart and not parent.apart:
            close()
            holder = e
        if name == "a":
            in_link += 1
            up = parent
            while up is not None:
                up.links += 1
                up = up.parent
        stack.append(e)
    close()
    page = sum(len(t) - share for e, t, share in blocks if not e.apart)
    for e in elements:  # parents come first
        e.apart = e.apart or e.parent.apart or bool(e.doubt) and _cut(e, page)
    return blocks


def _kept(e: Element, top: Element) -> bool:
    """Whether a block lies below ``top`` with nothing apart, no menu of links and no page header between them."""
    heading, below, menu = False, e, False
    while below is not None and below is not top:
        heading = heading or below.name in HEADINGS
        if below.apart or below.name == "header" and not heading and not _within(below, ("article", "main", "section")):
            return False
        if below.name in ("ul", "div", "section", "table"):
            titles = below.titles and below.linked >= MENU_LINK * below.links  # a list that goes on from a paragraph beside it
            menu = menu or below.links > 1 and MENU_SHARE * below.text < below.linked and not below.references and not titles
        below = below.parent
    up = top
    while menu and up is not None and up.name != "article":
        up = up.parent
    return below is top and not (menu and up is None)


def main_text(source: str) -> str:
    """The article of a page."""
    read = _read(source)
    blocks = [(e, t) for e, t, _ in read if not e.apart]
    scored: dict[int, Element] = {}
    for e, text in blocks:
        if e.name in HEADINGS or e.name == "header":
            continue
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        up, step = (e.parent if e.name in ("p", "pre", "li", "td", "dd", "dt", "figcaption") else e), 0
        while up is not None and up.parent is not None:
            scored[id(up)] = up
            up.points += points / (1, 2, 6, 9, 12)[min(step, 4)]
            up, step = up.parent, step + 1
    value = lambda x: (x.points + x.weight) * (1 - min(1.0, x.linked / max(x.text, 1)))
    candidates = [x for x in scored.values() if not x.apart and x.name not in ("html",)]
    if not candidates:
        holders = [e for e, _ in blocks if e.name in HEADINGS]
        return "\n".join(t for e, t in blocks if e.name != "header") if holders or blocks else ""
    top = max(candidates, key=value)
    up = top
    while up is not None:  # sections of one article belong together
        if up.name in ("article", "main") or up.weight >= 30:
            top = up
            if up.name == "article":
                break
        up = up.parent
    while top.name not in ("article", "main") and top.parent.name not in ("body", "html", "") and top.parent.text == top.text:
        top = top.parent  # a wrapper of this one alone
    # beside an article element stand other articles; any other container is one of the parts of its parent, however short the others are
    told, around, tops = top.name in ("article", "main"), top.parent, {id(top): top}
    out = []
    for e, text, linked in read:
        if e.apart:
            continue
        part, up = e, e
        while up is not None and id(up) not in tops:
            part, up = up, up.parent
            if up is around and (part.name == top.name if told else part.name != "header") and not part.doubt and part.linked <= 0.5 * part.text:
                up = tops[id(part)] = part
        if up is not None:
            if _kept(e, up):
                out.append(text)
        elif e is around and not told and linked <= 0.5 * len(text):  # text of the parent's own
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rows: int = 64) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    schema = T.StructType([*source.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                texts = [main_text(h) for h in batch.column("html").to_pylist()]
                yield with_columns(batch, schema, {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]})
    return source.mapInArrow(work, schema)
