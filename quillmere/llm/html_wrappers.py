"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page becomes a stream of block-level tags and text; runs of like siblings fold into repeated groups. The distinct
streams of a host are aligned one after another: where they agree they match, where one has more the surplus
becomes optional or joins a repeated group, and text becomes a slot. What each slot of a host's wrapper holds on all
pages of the host (always the same text or not, links or not) and where it lies tells template from article; a page's
text is what stands in the wrapper's article slots.

Pages may nest as deep, and be as broken, as they like: trees are walked without recursion, and a page is read in time
in proportion to its length.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections.abc import Generator, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.session import prepare, store

#: Elements whose content is no text, elements inside a block, and elements that hold no content.
RAW = frozenset("script style noscript template svg math iframe object textarea canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these kinds beside it.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tbody", "tfoot"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"},
}
#: An open paragraph stays open inside these only if the closing tag comes; any other block ends it.
BOUNDARY = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
#: Elements that never hold an article's text, and words in a class, id or role that say so too.
ASIDE_TAGS = frozenset("head nav footer aside form button select fieldset dialog menu iframe".split())
ASIDE_WORDS = frozenset(
    """ad ads advert advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist contentinfo complementary consent
    cookie cookies copyright disqus dropdown footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification
    overlay pager pagination popup promo promoted promotion recommended recommendations related reply respond search share sharing sidebar signup
    skip social sponsor sponsored subscribe toolbar topbar widget widgets discussion paywall toc""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_TAGS = frozenset(["article", "main"])

#: A tag; a quote counts only where a value may begin. Then the same where such a reading finds no end.
TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)>", re.I)
BARE_TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*+)([^>]*+)>", re.I)
RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*+>?", re.I) for x in RAW}
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of tags, in order; what has no text has an empty name.

    A comment, or an element without text, that does not end reaches to the end of the page. Where no > follows, no tag
    does. Each character is looked at a bounded number of times: once a tag whose quotes do not end has been met, quotes
    no longer count on the page.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while 0 <= (start := page.find("<", at)):
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if start > last:
            return
        found = TAG.match(page, start) if quotes else None
        if found is None and page[start + 1 : start + 2].isascii() and (found := BARE_TAG.match(page, start)):
            quotes = False
        if found is None:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                at = page.find(">", start) + 1
                yield start, at, "", False, ""
            continue
        at, name = found.end(), found[2].lower()
        if name in RAW and not found[1]:
            if not found[3].endswith("/"):
                end = RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            yield start, at, "br", False, ""
        else:
            yield start, at, name, bool(found[1]), found[3]


class Node:
    """An element, or with label # a text slot; ``repeated`` and ``optional`` say how often it comes."""

    __slots__ = ("alias", "children", "label", "optional", "repeated")

    def __init__(self, label: str) -> None:
        self.label, self.children, self.repeated, self.optional, self.alias = label, [], False, False, None

    def real(self) -> Node:
        node = self
        while node.alias is not None:
            if node.alias.alias is not None:
                node.alias = node.alias.alias
            node = node.alias
        return node


@lru_cache(1 << 14)
def label_of(name: str, attributes: str) -> str:
    """Tag name, with its classes, id and role as sorted words; numbers in them count as 0."""
    if not attributes:
        return name
    words: set[str] = set()
    for key, *values in ATTRIBUTE.findall(attributes):
        for w in "".join(values).split():
            w = re.sub(r"[0-9]+", "0", re.sub(r"[()#\s.|]", "", w)).lower()
            words.add("role=" + w if key.lower() == "role" else w)
    return ".".join([name, *sorted(w for w in words if w)])


def _walk(work: Generator) -> None:
    """Run a generator that yields others to be run before it goes on: recursion without the stack."""
    stack = [work]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def _absorb(into: Node, node: Node) -> Generator:
    into.repeated |= node.repeated
    into.optional |= node.optional
    node.alias = into
    old = into.children
    if node.children or old:
        places: dict[str, list[int]] = {}
        for k, child in enumerate(old):
            places.setdefault(child.label, []).append(k)
        out: list[Node] = []
        at, fresh = 0, []

        def surplus(upto: int) -> None:
            mine = old[at:upto]
            for x in (*mine, *fresh):
                x.optional = True
            # neither side tells which comes first, so the labels decide, lest two pages put the same parts in two orders
            out.extend(fresh + mine if not mine or (fresh and fresh[0].label < mine[0].label) else mine + fresh)
            fresh.clear()

        for child in node.children:
            known = places.get(child.label, ())
            k = bisect_left(known, at)
            if k == len(known):
                fresh.append(child)
                continue
            surplus(known[k])
            same, at = old[known[k]], known[k] + 1
            if child.children or same.children:
                yield _absorb(same, child)
            else:
                child.alias, same.repeated, same.optional = same, same.repeated | child.repeated, same.optional | child.optional
            out.append(same)
        surplus(len(old))
        into.children = out
        yield _fold(into)


def _fold(node: Node) -> Generator:
    out: list[Node] = []
    for child in node.children:
        if out and out[-1].label == child.label:
            yield _absorb(out[-1], child)
            out[-1].repeated = True
        else:
            out.append(child)
    node.children = out


def absorb(into: Node, node: Node) -> None:
    """Align the children of ``node`` with those of ``into`` and merge them there; what one side lacks becomes optional."""
    _walk(_absorb(into, node))


def fold(node: Node) -> None:
    """Merge adjoining like children into one repeated group."""
    if len(node.children) > 1:
        _walk(_fold(node))


class Open:
    """The open elements of a page: nodes, and for each name where it stands in the stack."""

    def __init__(self) -> None:
        self.root = Node("")
        self.stack, self.names, self.at = [self.root], [""], {}

    def push(self, name: str, node: Node) -> None:
        self.stack[-1].children.append(node)
        self.at.setdefault(name, []).append(len(self.stack))
        self.stack.append(node)
        self.names.append(name)

    def close(self, down: int) -> None:
        while len(self.stack) > down:
            fold(self.stack.pop())
            if name := self.names.pop():
                self.at[name].pop()

    def last(self, names) -> int:
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=0)

    def make_room(self, name: str) -> None:
        """Close what the opening tag ``name`` ends: a paragraph, and items, cells and rows beside it."""
        if self.names[-1] == "p":
            self.close(len(self.stack) - 1)
        if name not in ENDS:
            return
        stop = self.last(BOUNDARY.get(name, "table").split())
        if name == "tr":  # a cell and the row around it
            first = [x[k] for x in (self.at.get(n, []) for n in ENDS[name]) if (k := bisect_right(x, stop)) < len(x)]
            if first:
                self.close(min(first))
        elif (k := self.last(ENDS[name])) > stop:
            self.close(k)


def parse(page: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """The tree of a page and its blocks in page order: text slot, text, and how many of its characters are in links."""
    held = Open()
    blocks: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked = in_link = last = 0

    def text(piece: str) -> None:
        nonlocal linked
        piece = entities.unescape(piece) if "&" in piece else piece
        parts.append(piece)
        if in_link:
            linked += len(piece)

    def flush() -> None:
        nonlocal linked
        if parts:
            whole = " ".join("".join(parts).split())
            parts.clear()
            if whole:
                top = held.stack[-1]
                if not top.children or top.children[-1].label != "#":
                    top.children.append(Node("#"))
                blocks.append((top.children[-1], whole, linked))
            linked = 0

    for start, end, name, ending, attributes in tokens(page):
        if start > last:
            text(page[last:start])
        last = end
        if name in INLINE or not name:
            if name == "a":
                in_link = 0 if ending else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        flush()
        in_link = 0
        if ending:
            if held.at.get(name):
                held.close(held.at[name][-1])
        elif name not in VOID:
            held.make_room(name)
            held.push(name, Node(label_of(name, attributes)))
    if last < len(page):
        text(page[last:])
    flush()
    held.close(0)
    return held.root, [(n.real(), t, k) for n, t, k in blocks]


def in_order(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(reversed(node.children))


def written(root: Node) -> str:
    """A tree as text: for each node in order its label, its marks (+ for a repeated and ? for an optional group) and how many children it has."""
    return " ".join(f"{n.label or '/'} {'+' * n.repeated}{'?' * n.optional}{len(n.children)}" for n in in_order(root))


def read(skeleton: str) -> tuple[Node, list[Node]]:
    """The tree that :func:`written` wrote, and its text slots in order."""
    words = skeleton.split(" ")
    top = Node("above")
    slots: list[Node] = []
    todo = [[top, 1]]
    for label, marks in zip(words[::2], words[1::2], strict=True):
        while not todo[-1][1]:
            todo.pop()
        todo[-1][1] -= 1
        node = Node("" if label == "/" else label)
        node.repeated, node.optional = "+" in marks, "?" in marks
        todo[-1][0].children.append(node)
        if label == "#":
            slots.append(node)
        todo.append([node, int(marks.lstrip("+?"))])
    return top.children[0], slots


def infer(skeletons: list[str]) -> tuple[str, list[list[int]]]:
    """Align skeletons one after another into one wrapper; for each its slots as indexes into the wrapper's slots."""
    wrapper, slots = read(skeletons[0])
    seen = [slots]
    for x in skeletons[1:]:
        tree, more = read(x)
        absorb(wrapper, tree)
        seen.append(more)
    order = {id(n): k for k, n in enumerate(x for x in in_order(wrapper) if x.label == "#")}
    return written(wrapper), [[order[id(n.real())] for n in each] for each in seen]


@lru_cache(1 << 14)
def role(label: str, within: bool = False) -> str:
    """aside, main, or nothing: what an element's tag, classes, id and role say of its content.

    ``within`` an article only a class, id or role that is such a word as a whole counts, not one that has it as a part
    (share-price, login-guide): an article's own blocks may be called anything.
    """
    name, *words = label.split(".")
    if name in ("html", "body", ""):
        return ""
    if name in ASIDE_TAGS:
        return "aside"
    parts = {w.strip("0") for w in words} if within else {p for w in words for p in re.split(r"[-_=:0]+", w)}
    if parts & ASIDE_WORDS:
        return "aside"
    if name in MAIN_TAGS or "role=main" in words:
        return "main"
    return "aside" if name == "header" else ""


def places(wrapper: Node) -> list[tuple[bool, bool, bool]]:
    """For each text slot in order: whether it lies beside the article (below an aside), whether in an article or main element, whether in a heading.

    A heading in a header within an article is no aside.
    """
    out: list[tuple[bool, bool, bool]] = []
    todo = [(wrapper, False, False, False, False)]  # node, below an aside, below a header of an article, below an article, below a heading
    while todo:
        node, aside, header, main, heading = todo.pop()
        if node.label == "#":
            out.append((aside or header, main, heading))
            continue
        name, kind = node.label.split(".")[0], role(node.label, main)
        if kind == "aside" and name == "header" and main:
            header = True
        elif kind == "aside":
            aside = True
        todo += [(x, aside, header and not (x.label == "#" and name in HEADINGS), main or kind == "main", name in HEADINGS) for x in reversed(node.children)]
    return out


def article(slots: list[dict], evidence: int) -> list[bool]:
    """Which of a page's slots hold the article, from what the wrapper knows of each: aside, main, heading, links and chars, n and same.

    Slots beside the article are out. If any slot lies in an article or main element, only such slots are in; else slots mostly
    made of links are out. Of what is left, template text (the same on all of ``evidence`` or more differing pages) is
    out if some other slot remains; but a heading in an article stays, as articles of a kind have headings in common.
    """
    keep = [not x["aside"] for x in slots]
    if any(k and x["main"] for k, x in zip(keep, slots, strict=True)):
        keep = [k and x["main"] for k, x in zip(keep, slots, strict=True)]
    else:
        keep = [k and x["links"] <= 0.6 * max(1, x["chars"]) for k, x in zip(keep, slots, strict=True)]
    own = [k and not (x["same"] and x["n"] >= evidence and not (x["main"] and x["heading"])) for k, x in zip(keep, slots, strict=True)]
    return own if any(own) else keep


HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
FOLD_AT_ONCE = 500
BROADCAST_BYTES = 16 << 20


def wrappers(observed: DataFrame, fold_at_once: int = FOLD_AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """From (host, skeleton) pairs, each once: (host, wrapper), and (host, skeleton, map): a skeleton's slots as the wrapper's.

    A host's skeletons are folded in groups of about ``fold_at_once``, the groups' wrappers again, and so on until one
    is left, so that no task aligns more than about that many, however many structures a host has.
    """

    def align(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(size=-rows["skeleton"].str.len()).sort_values(["size", "skeleton", "part"], kind="stable")  # the fullest first, as it shows the order of parts
        wrapper, maps = infer(list(rows["skeleton"]))
        return pd.DataFrame({"host": key[0], "whole": key[1], "part": list(rows["part"]), "step": maps, "wrapper": wrapper})

    schema = "host string, whole long, part long, step array<int>, wrapper string"
    level = observed.select("host", F.xxhash64("skeleton").alias("part"), "skeleton")
    maps = observed.select("host", "skeleton", F.xxhash64("skeleton").alias("part"), F.lit(None).cast("array<int>").alias("map"))
    while True:
        sizes = level.groupBy("host").agg(F.ceil(F.count("*") / fold_at_once).cast("int").alias("groups"))
        dealt = level.join(sizes, "host").withColumn("whole", F.pmod(F.xxhash64("part"), F.col("groups")).cast("long")).select("host", "whole", "part", "skeleton")
        done = store(dealt.groupBy("host", "whole").applyInPandas(align, schema), "wrappers")
        maps = maps.join(done.select("host", "part", "whole", "step"), ["host", "part"])
        maps = store(maps.select("host", "skeleton", F.col("whole").alias("part"), F.coalesce(F.expr("transform(map, x -> step[x])"), "step").alias("map")), "maps")
        level = done.select("host", F.col("whole").alias("part"), F.col("wrapper").alias("skeleton")).distinct()
        if not level.groupBy("host").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            return level.select("host", F.col("skeleton").alias("wrapper")), maps.drop("part")


def observe(pages: DataFrame) -> DataFrame:
    """Parse (page_id, url, host, html) rows: skeleton and its mark, a hash, size and link size of each slot, and the texts."""
    slot = pa.list_(pa.struct([("hash", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())]))
    block = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string())]))
    names = ["page_id", "url", "host", "mark", "skeleton", "slots", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees, facts, texts = [], [], []
            for page in b.column(3).to_pylist():
                root, found = parse(page or "")
                order = {id(n): k for k, n in enumerate(x for x in in_order(root) if x.label == "#")}
                hashes, chars, links = [xxhash.xxh64(seed=1) for _ in order], [0] * len(order), [0] * len(order)
                for n, t, k in found:
                    x = order[id(n)]
                    hashes[x].update(t.encode("utf-8", "surrogatepass") + b"\n")
                    chars[x] += len(t)
                    links[x] += k
                trees.append(written(root))
                facts.append([{"hash": h.intdigest() - (1 << 63), "chars": c, "links": k} for h, c, k in zip(hashes, chars, links, strict=True)])
                texts.append([{"slot": order[id(n)], "text": t} for n, t, _ in found])
            marks = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 5) - (1 << 63) for x in trees]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(marks, pa.int64()), pa.array(trees, pa.string()), pa.array(facts, slot), pa.array(texts, block)], names)

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "host", "html").mapInArrow(
        run, f"page_id {kind}, url string, host string, mark long, skeleton string, slots array<struct<hash:long,chars:long,links:long>>, blocks array<struct<slot:int,text:string>>"
    )


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", evidence: int = 5, fold_at_once: int = FOLD_AT_ONCE) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    All pages of a host are evidence for its wrapper. A slot of the wrapper counts as template text if it held the same
    text on all of its pages, ``evidence`` or more that differ in their texts or their structure. Null or empty html gives
    an empty text. Pages without a host in their url form a host of their own. Equal rows get equal texts, and blocks that tie stay in page order; an empty table
    gives an empty table. Other columns are not read. Each page is parsed once; what it holds is stored by slot.
    """
    prepare(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1)).alias("host"), F.col(html_col).alias("html")
    )
    seen = store(observe(rows), "parsed")
    kinds = seen.groupBy("host", "mark").agg(F.first("skeleton").alias("skeleton"))
    wrapper, maps = wrappers(kinds.select("host", "skeleton"), fold_at_once)
    texts = F.xxhash64(F.transform("slots", lambda x: x["hash"]))  # copies of a page are no evidence of a template
    differing = seen.select("host", "mark", texts.alias("texts")).distinct().groupBy("host", "mark").agg(F.count("*").alias("n"))
    maps = store(maps.join(kinds, ["host", "skeleton"]).join(differing, ["host", "mark"]).select("host", "mark", "map", "n"), "maps")
    sums = (
        seen.select("host", "mark", F.posexplode("slots").alias("k", "s"))
        .groupBy("host", "mark", "k")
        .agg(F.min("s.hash").alias("low"), F.max("s.hash").alias("high"), F.sum("s.chars").alias("chars"), F.sum("s.links").alias("links"))
    )
    placed = sums.join(maps, ["host", "mark"]).select("host", F.expr("map[k]").alias("slot"), "n", "low", "high", "chars", "links")
    slots = placed.groupBy("host", "slot").agg(*(f(c).alias(c) for f, c in ((F.sum, "n"), (F.min, "low"), (F.max, "high"), (F.sum, "chars"), (F.sum, "links"))))
    # a repeated group or an optional part merges several slots, so constant means constant in all of them
    facts = slots.groupBy("host").agg(F.collect_list(F.struct("slot", "n", (F.col("low") == F.col("high")).alias("same"), "chars", "links")).alias("slots"))  # as many as the wrapper has

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(64)
        def of(host: str, tree: str) -> list[tuple[bool, bool, bool]]:
            return places(read(tree)[0])

        for b in batches:
            masks = []
            for host, tree, indexes, known in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                where, found = of(host, tree), {x["slot"]: x for x in known or []}
                masks.append(article([found[i] | dict(zip(("aside", "main", "heading"), where[i], strict=True)) for i in indexes], evidence))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks, pa.list_(pa.bool_()))], ["host", "mark", "keep"])

    known = maps.join(wrapper, "host").join(facts, "host", "left").select("host", "mark", "wrapper", "map", "slots")
    keep = store(known.mapInArrow(decide, "host string, mark long, keep array<boolean>"), "masks")
    size = keep.agg(F.sum(F.octet_length("host") + F.size("keep") + 32)).first()[0] or 0
    kept = F.transform(F.filter("blocks", lambda x: F.get("keep", x.slot)), lambda x: x.text)
    text = F.coalesce(F.array_join(kept, "\n\n"), F.lit(""))
    return (
        seen.select("page_id", "url", "host", "mark", "blocks")
        .join(F.broadcast(keep) if size <= BROADCAST_BYTES else keep, ["host", "mark"], "left")
        .select("page_id", "url", text.alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
