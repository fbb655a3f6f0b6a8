"""HTML extraction: the main text of pages, by templates deduced from the pages of each host.

A page is a row of tokens: its opening tags, each with the path of names, classes and ids above it, and its blocks of text, each
with its path. A block is what stands between two block-level tags.

1. Occurrence vectors. How often a token is on each page of a host is folded into 128 bits of an order-free hash, so a token
   is a row whatever the number of pages, pre-aggregated before it moves. Equal pages of a host count once.
2. Equivalence classes. Tokens of a host with one vector are a class, if there are at least two and most of the host's
   pages have them. A class is valid where each page has its tokens in whole rounds of one order.
3. Nesting. The largest valid class whose tokens are once on every page is the template's frame; other valid classes
   nest if each of their rounds lies in one gap of the frame. Classes that don't are dropped; only the frame is mended, by leaving out tokens that
   stand in another order on some page, such as rotating parts, three times over at most.
4. Slots. What is left between template tokens is a slot. Template texts are no content. A host's main slot is the deepest template
   element with most of its pages' text, without menus, headers, footers and the like.
5. A page's text comes from its article element, else its main element, else its host's main slot, else, on hosts of few
   pages, the deepest element with most of its own text; of these last two, headings just beside it belong to it. Headings in an article's header stay.

Menus, sidebars, notices, adverts, forms and comments are known by their elements, roles, and words of classes and ids; a class
doesn't count where nothing else would be left. Scripts, styles and hidden elements are never text. A line break inside a block is
white space. Character references are decoded once, also without a semicolon where HTML allows it.

Null html is an empty page, with empty text. A page without a host has no template. Repeated rows give repeated results. Broken markup is read like browsers do:
tags that are open end with what is around them. Hosts without enough different pages go by the rules alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plaitwork.llm._util import prepare, staged

#: Different pages that a host needs for a template, the share of them that a class is on, and of the text that the main slot has.
MIN_PAGES, SUPPORT, MOST = 5, 0.9, 0.6
#: Template rows that are broadcast at most, of some 40 bytes each; with more they meet their pages in a shuffle.
BROADCAST_ROWS = 200_000
#: Times that tokens out of order are taken out of a frame.
MENDED = 3

#: Elements by what they do to text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe noembed noframes xmp".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav "
    "ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = set("body div section td main article center".split())
OUT = set("nav footer aside form header button select dialog menu template svg math object canvas audio video head".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag ends, and what it doesn't look past.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of classes and ids, and roles, of what isn't the article.
WORDS = set(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion promotions banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar share sharing social related "
    "recommended recommendations comment comments commentlist disqus replies respond pagination pager search copyright outbrain taboola paywall".split()
)
#: The words that count on elements inside a line, too, and the names of headers.
INLINE, HEADER = set("ad ads adbox adslot adsbygoogle advert adverts advertisement sponsored".split()), "header"
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[A-Za-z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=\"'/>]+)")

NONE, BY_CLASS, BY_ELEMENT = 0, 1, 2


def _hash(*parts) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) - 2**63


@lru_cache(maxsize=65_536)
def _kind(name: str, attributes: str) -> tuple[str, int, bool]:
    """(name with classes and id, why an element isn't the article, whether it is a header)."""
    found = {m[1].lower() if m[1] else m[5].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
    names = " ".join(found.get(a, "") for a in ("class", "id"))
    hidden = "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", ""), re.I) or found.get("role", "").lower() in ROLES
    label = BY_ELEMENT if name in OUT or hidden else NONE
    words = set(re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower().replace("-", " ").replace("_", " ").split())
    if label == NONE and name not in BLOCK and words & INLINE:
        label = BY_ELEMENT
    if label == NONE and name in BLOCK and name not in ("html", "body", "main", "article") and words & WORDS:
        label = BY_CLASS
    return f"{name} {re.sub('[0-9]+', '0', names)}", label, name == HEADER or (label == BY_CLASS and words & WORDS == {HEADER})


class Element:
    """An open element: its token, and what it says about the text in it."""

    __slots__ = ("name", "token", "label", "article", "main", "above", "depth", "header")

    def __init__(self, name: str, attributes: str, above: Element | None) -> None:
        kind, label, header = _kind(name, attributes)
        self.name, self.above = name, above
        self.token, self.depth = _path(above.token if above else 0, kind), above.depth + 1 if above else 0
        inside = above is not None and above.article is not None
        # The header of an article, and of anything else below the page's own elements, keeps its headings.
        self.header = above.header if above else None
        if header and above.label == NONE and (inside or above.main is not None or (name != HEADER and name not in HEADINGS)):
            self.header = self
        own = name in HEADINGS and self.header is not None and self.header is not self
        self.label = NONE if own and label == NONE else max(label, above.label if above else NONE)
        self.article = above.article if inside else self if name == "article" else None
        self.main = above.main if above and above.main else self if name == "main" or "role=main" in attributes.replace('"', "").replace("'", "") else None

    def chain(self) -> list[Element]:
        out, at = [], self
        while at is not None:
            out.append(at)
            at = at.above
        return out[::-1]


@lru_cache(maxsize=65_536)
def _path(above: int, kind: str) -> int:
    return _hash(above, kind)


def parse(html: str) -> tuple[list[tuple[str, Element, int]], list[tuple[int, bool]]]:
    """(blocks, tokens): blocks as (text, element, token) and all tokens in order, with whether they are text."""
    blocks, tokens, pieces = [], [], []
    stack, begun = [Element("", "", None)], None

    def end_block() -> None:
        nonlocal begun
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                token = _hash(begun.token, text)
                blocks.append((text, begun, token))
                tokens.append((token, True))
            pieces.clear()
        begun = None

    def add(text: str) -> None:
        nonlocal begun
        own = begun or next(e for e in reversed(stack) if e.name in BLOCK or e.above is None)
        # A button inside a paragraph isn't the paragraph's text.
        if stack[-1].label != BY_ELEMENT or own.label == BY_ELEMENT:
            begun = own
            pieces.append(text)

    def close(names: set[str], stops: set[str] | None) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                del stack[k:]
                return
            if stack[k].name in stops if stops is not None else False:
                return

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                end_block()
            if name in BLOCK and name != "p":
                close({name}, None)
            else:
                close({name}, BLOCK - {name})
            continue
        if name in RAW:
            over = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = over.end() if over else size
            continue
        if name == "br":
            if pieces:
                pieces.append(" ")
            continue
        if name in BLOCK:
            end_block()
            close({"p"}, BLOCK - {"p"})
            if name in ENDS:
                close(*ENDS[name])
        opened = Element(name, m[3] or "", stack[-1])
        tokens.append((opened.token, False))
        if name not in VOID:
            stack.append(opened)
    end_block()
    return blocks, tokens


def _largest(blocks: list, of) -> list:
    """The blocks of the element, by ``of``, that has the most text; none where no block has one."""
    sizes: dict = {}
    for b in blocks:
        if (e := of(b[1])) is not None:
            sizes[id(e)] = sizes.get(id(e), 0) + len(b[0])
    if not sizes:
        return []
    top = max(sizes, key=sizes.get)  # the first of equals
    return [b for b in blocks if (e := of(b[1])) is not None and id(e) == top]


def _deepest(blocks: list) -> list:
    """The blocks of the deepest container with most of the text."""
    total, sizes, kept = sum(len(b[0]) for b in blocks), {}, {}
    for b in blocks:
        for e in b[1].chain():
            if e.name in CONTAINER:
                sizes[id(e)], kept[id(e)] = sizes.get(id(e), 0) + len(b[0]), e
    most = [e for k, e in kept.items() if sizes[k] >= MOST * total]
    if not most:
        return blocks
    top = max(most, key=lambda e: e.depth)
    return [b for b in blocks if any(e is top for e in b[1].chain())]


def _headed(live: list, own: list, template: set[int]) -> list:
    """``own`` with the headings that stand beside it: as far up as elements add nothing but headings."""
    shared: set | None = None
    for b in own:
        chain = {id(e) for e in b[1].chain()}
        shared = chain if shared is None else shared & chain
    held = {id(b) for b in own}

    def meets(element: Element) -> int:
        """The depth of the lowest element over all of ``own`` that is over this one, too."""
        while id(element) not in shared:
            element = element.above
        return element.depth

    beside = [(b, meets(b[1])) for b in live if id(b) not in held] if own else []
    limit = max((d for b, d in beside if b[2] not in template and b[1].name not in HEADINGS), default=-1)
    held |= {id(b) for b, d in beside if d > limit}
    return [b for b in live if id(b) in held]


def main_text(html: str, template: set[int], main: int | None) -> str:
    """The article of a page; ``template``: tokens of template texts, ``main``: the token of the host's main slot."""
    blocks, _ = parse(html)
    live = [b for b in blocks if b[1].label == NONE] or [b for b in blocks if b[1].label == BY_CLASS]
    own = _largest(live, lambda e: e.article) or _largest(live, lambda e: e.main)
    own = own or _headed(live, _largest(live, lambda e: next((x for x in e.chain() if x.token == main), None)) or _deepest(live), template)
    kept = [b for b in own if b[2] not in template] or own
    return "\n".join(b[0] for b in kept)


def host(url: Column) -> Column:
    """The host of a URL in lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_tokens(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, page, marks, line, blocks), a row for each different page of each host.

    marks: each token's number and first place; line: tokens in order; blocks: containers above a block that may be content, from the top, and its size.
    """
    prepare(pages.sparkSession)
    schema = StructType.fromDDL("host string, page long, marks array<struct<token: long, n: int, first: int, text: boolean>>, line array<long>, blocks array<struct<above: array<long>, size: int>>")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out = []
                for r in whole.slice(at, 256).to_pylist():
                    blocks, tokens = parse(r["html"])
                    marks: dict = {}
                    for k, (token, text) in enumerate(tokens):
                        m = marks.setdefault(token, {"token": token, "n": 0, "first": k, "text": text})
                        m["n"] += 1
                    content = [{"above": [e.token for e in b[1].chain() if e.name in CONTAINER], "size": len(b[0])} for b in blocks if b[1].label == NONE]
                    out.append({"host": r["host"], "page": r["page"], "marks": [*marks.values()], "line": [t for t, _ in tokens], "blocks": content})
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    own = pages.select(host(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("page"), F.col(html_col).alias("html")).where("host is not null and html is not null")
    return own.mapInArrow(run, schema).dropDuplicates(["host", "page"])


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def template_tokens(tokens: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """(host, token, text): the tokens of each host's valid and nested classes."""
    totals = tokens.groupBy("host").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= min_pages)
    each = tokens.select("host", "page", F.explode("marks").alias("m")).select("host", "page", "m.*")
    folded = each.groupBy("host", "token", "text").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("n").alias("n"),
        F.bit_xor(F.xxhash64("page", "n")).alias("v1"),
        F.bit_xor(F.xxhash64(F.lit(7), "n", "page")).alias("v2"),
        F.avg("first").alias("at"),
    )
    frequent = folded.where(F.col("pages") >= min_pages).join(_bounded(totals, BROADCAST_ROWS), "host").where(F.col("pages") >= support * F.col("total"))
    # At most as many tokens a host as its pages have on average, over the support.
    classes = frequent.groupBy("host", "v1", "v2").agg(
        F.array_sort(F.collect_list(F.struct("at", "token", "text"))).alias("members"), (F.max("n") == F.max("total")).alias("once"), (F.max("pages") == F.max("total")).alias("everywhere")
    )
    classes = classes.where(F.size("members") > 1).select("host", F.struct("v1", "v2").alias("class"), "members", (F.col("once") & F.col("everywhere")).alias("framing"))
    widest = classes.where("framing").groupBy("host").agg(F.max_by("class", F.struct(F.size("members"), "class")).alias("frame"))
    members = classes.join(widest, "host", "left").select("host", "class", F.col("class").eqNullSafe(F.col("frame")).alias("frame"), F.explode("members").alias("m"))
    members = staged(members.select("host", "class", "frame", "m.*"), "page-classes")
    for _ in range(MENDED):
        valid, astray = _checked(tokens, members)
        if astray.isEmpty():
            break
        members = staged(members.join(astray, ["host", "token"], "left_anti"), "page-classes")
    else:
        valid, _ = _checked(tokens, members)
    return members.join(valid, ["host", "class"]).select("host", "token", "text")


def _checked(tokens: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, class) of the valid and nested classes, and (host, token) of frames' tokens that stand out of order on some page."""
    own = Window.partitionBy("host", "class")
    placed = members.select("host", "token", "class", "frame", (F.row_number().over(own.orderBy("at", "token")) - 1).alias("rank"), F.count(F.lit(1)).over(own).alias("k"))
    seen = tokens.select("host", "page", F.posexplode("line").alias("pos", "token")).join(_bounded(placed, BROADCAST_ROWS), ["host", "token"])
    # A page's template tokens in order, with the gap of the frame that each is in: which lie out of a class's rounds, or across the frame.
    gap = F.sum(F.col("frame").cast("int")).over(Window.partitionBy("host", "page").orderBy("pos"))
    order = seen.withColumn("gap", gap).groupBy("host", "page", "class").agg(F.array_sort(F.collect_list(F.struct("pos", "rank", "gap", "k", "frame", "token"))).alias("xs"))
    in_place = lambda x, i: (x["rank"] == i % x["k"]) & (x["frame"] | (x["rank"] == 0) | (x["gap"] == F.get("xs", i - 1)["gap"]))
    fine = F.forall(F.transform("xs", in_place), lambda x: x) & (F.size("xs") % F.col("xs")[0]["k"] == 0)
    order = staged(order.select("host", "class", "xs", fine.alias("fine")), "page-order")
    valid = order.groupBy("host", "class").agg(F.min("fine").alias("valid")).where("valid").drop("valid")
    turned = lambda x, i: (F.coalesce(F.get("xs", F.greatest(i - 1, F.lit(0)))["rank"] > x["rank"], F.lit(False))) | F.coalesce(F.get("xs", i + 1)["rank"] < x["rank"], F.lit(False))
    astray = order.where(~F.col("fine") & F.col("xs")[0]["frame"]).select("host", F.explode(F.transform(F.filter("xs", turned), lambda x: x["token"])).alias("token")).distinct()
    return valid, astray


def templates(tokens: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """(host, texts, main): the tokens of each host's template texts, and that of its main slot, if it has one."""
    known = staged(template_tokens(tokens, min_pages, support), "page-template")
    texts = known.groupBy("host").agg(F.collect_list(F.when(F.col("text"), F.col("token"))).alias("texts"))
    block = tokens.select("host", F.explode("blocks").alias("b"))
    total = block.groupBy("host").agg(F.sum("b.size").alias("total"))
    under = block.select("host", F.col("b.size").alias("size"), F.posexplode("b.above").alias("depth", "token")).groupBy("host", "token").agg(F.sum("size").alias("size"), F.max("depth").alias("depth"))
    slots = under.join(known.where("not text"), ["host", "token"]).join(total, "host").where(F.col("size") >= MOST * F.col("total"))
    main = slots.groupBy("host").agg(F.max_by("token", F.struct("depth", "size", "token")).alias("main"))
    return texts.join(main, "host", "left").select("host", "texts", "main")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """(id, url, text, n_chars) for each row of ``pages``; other columns are left out."""
    prepare(pages.sparkSession)
    known = staged(templates(staged(page_tokens(pages, url_col, html_col), "page-tokens"), min_pages, support), "page-templates")
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    joined = own.join(_bounded(known, BROADCAST_ROWS // 10), "host", "left").select("id", "url", "html", "texts", "main")
    schema = StructType([*joined.select("id", "url").schema.fields, *StructType.fromDDL("text string, n_chars long").fields])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out = []
                for r in whole.slice(at, 256).to_pylist():
                    text = main_text(r["html"] or "", set(r["texts"] or ()), r["main"])
                    out.append({"id": r["id"], "url": r["url"], "text": text, "n_chars": len(text)})
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
