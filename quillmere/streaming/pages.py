"""The page stream: one state per document carries sections, the last unit and containers from page to page."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator, MutableMapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillmere.config import DEFAULT
from quillmere.functions import text as X

PAGE = "document_id string, page int, total_pages int, units array<struct<type:string,name:string,content:string,parent_name:string,section:array<string>>>"
OUT = "document_id string, page int, carried boolean, section_before string, containers_before string, n_units int, pages_processed int, units_processed int, phase string"
#: What a document's state holds as one value; the pages that were counted are a map beside it, read and written one by one.
STATE = "last_page int, section string, last_name string, last_tail string, containers string, pages int, units int"


def advance(state: dict, page: int, total: int, units: list[dict], done: MutableMapping, keep: int = DEFAULT.containers_carried) -> dict:
    """One page's row, changing ``state`` and ``done`` (page: counted): the batch and the streaming run share this.

    State is used only on the page after the last one. The last unit's section is carried on, or the one before if
    it has none. Containers are the units that others on the page name as parent; the last ``keep`` stay, newest
    first. A page that comes again does not count twice.
    """
    parents = {u["parent_name"] for u in units if u["parent_name"]}
    last = units[-1] if units else None
    told = {"n_units": len(units), "names": [u["name"] for u in units if u["name"] in parents]}
    if last is not None:
        told |= {"section": " > ".join(last["section"]) if len(last["section"]) else None, "last_name": last["name"], "last_tail": (last["content"] or "")[-100:]}
    return advance_digest(state, page, total, told, done, keep)


#: What :func:`advance_digest` needs of a page: however long its texts are, a row of this is short.
DIGEST = ["n_units", "names", "section", "last_name", "last_tail"]


def page_digests(pages: DataFrame) -> DataFrame:
    """``pages`` (PAGE rows) to document_id, page, total_pages and :data:`DIGEST`, so that pages' texts do not go where a document's pages meet."""
    parents = F.filter(F.transform("units", lambda u: u["parent_name"]), lambda n: n.isNotNull() & (n != ""))
    pages = pages.select("document_id", "page", "total_pages", "units", parents.alias("parents"), F.try_element_at("units", F.lit(-1)).alias("last"))
    names = F.transform(F.filter("units", lambda u: F.coalesce(F.array_contains("parents", u["name"]), F.lit(False))), lambda u: u["name"])
    tail = F.when(F.length("last.content") > 100, F.substring("last.content", -100, 100)).otherwise(F.col("last.content"))
    return pages.select("document_id", "page", "total_pages", F.size("units").alias("n_units"), names.alias("names"), F.when(F.size("last.section") > 0, F.array_join("last.section", " > ")).alias("section"), F.col("last.name").alias("last_name"), F.when(F.col("last").isNotNull(), F.coalesce(tail, F.lit(""))).alias("last_tail"))


def digest_of(row) -> dict:
    """The digest in a row of pandas; absent texts as None."""
    text = lambda x: x if isinstance(x, str) else None
    return {"n_units": int(row.n_units), "names": list(row.names), "section": text(row.section), "last_name": text(row.last_name), "last_tail": text(row.last_tail)}


def advance_digest(state: dict, page: int, total: int, told: dict, done: MutableMapping, keep: int = DEFAULT.containers_carried) -> dict:
    """:func:`advance` from a page's digest."""
    carried = state.get("last_page") is not None and page == state["last_page"] + 1
    row = {"page": page, "carried": carried, "section_before": state.get("section", "") if carried else "", "containers_before": state.get("containers", "") if carried else "", "n_units": told["n_units"]}
    names = [x for x in state.get("containers", "").split("|") if x] if carried else []
    for x in told["names"]:
        names = [x, *(n for n in names if n != x)]
    some = told["n_units"] > 0
    section = told.get("section")
    if section is None:
        section = state.get("section", "") if carried else ""
    fresh = page not in done
    if fresh:
        done[page] = True
    n_pages = state.get("pages", 0) + fresh
    state.update(
        last_page=page, section=section, last_name=(told["last_name"] if some else state.get("last_name")) or "", last_tail=(told["last_tail"] if some else state.get("last_tail")) or "",
        containers="|".join(names[:keep]), pages=n_pages, units=state.get("units", 0) + told["n_units"] * fresh,
    )
    return row | {"pages_processed": n_pages, "units_processed": state["units"], "phase": "summary" if n_pages >= total else "vision"}


class _Held:
    """A map state of single values, used like a dict."""

    def __init__(self, state) -> None:
        self.state = state

    def __contains__(self, key) -> bool:
        return self.state.containsKey((key,))

    def __getitem__(self, key):
        found = self.state.getValue((key,))
        return found[0] if len(found) == 1 else tuple(found)

    def __setitem__(self, key, value) -> None:
        self.state.updateValue((key,), value if isinstance(value, tuple) else (value,))

    def __delitem__(self, key) -> None:
        self.state.removeKey((key,))

    def items(self) -> list[tuple]:
        return [(k[0], v[0] if len(v) == 1 else tuple(v)) for k, v in self.state.iterator()]


class PageProcessor(StatefulProcessor):
    """Pages of a micro-batch in order of number; what the last one leaves is the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("continuation", STATE)
        self.done = _Held(handle.getMapState("pages", "page int", "counted boolean"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        fields = [x.split()[0] for x in STATE.split(", ")]
        state = dict(zip(fields, self.state.get(), strict=True)) if self.state.exists() else {}
        pages = pd.concat(list(rows)).sort_values("page", kind="stable")
        out = [advance_digest(state, int(r.page), int(r.total_pages), digest_of(r), self.done) for r in pages.itertuples()]
        self.state.update(tuple(state[f] for f in fields))
        yield pd.DataFrame([{"document_id": key[0], **r} for r in out])

    def close(self) -> None:
        pass


def page_stream(pages: DataFrame) -> DataFrame:
    """``pages`` (a stream of PAGE rows) to OUT rows."""
    return page_digests(pages).groupBy("document_id").transformWithStateInPandas(PageProcessor(), OUT, "Append", "None")


def page_batch(pages: DataFrame) -> DataFrame:
    """The same over a table: one group per document, pages in order."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state: dict = {}
        done: dict = {}
        out = [advance_digest(state, int(r.page), int(r.total_pages), digest_of(r), done) for r in rows.sort_values("page", kind="stable").itertuples()]
        return pd.DataFrame([{"document_id": key[0], **r} for r in out])

    return page_digests(pages).groupBy("document_id").applyInPandas(run, OUT)


HTML = "document_id string, page int, html string"
PLACED = "document_id string, page int, source_order int, id string, type string, name string, content string, parent_unit_id string, section array<string>"


def placed_page(document: str, page: int, units: list[dict], section: list[str], containers: MutableMapping, e: int) -> list[dict]:
    """One page's units (as extracted) with ids, parents, types and sections; ``containers`` (name: page, id) is read and gains the page's names.

    The rules are those of :mod:`quillmere.plans.placing`: a named parent is the latest unit of that name before, on
    this page or at most ``e`` pages back.
    """
    from quillmere.plans.ingest import known_types, repaired_types

    here: dict[str, int] = {}
    local, older = [], []
    for u in units:
        k, far = u["parent_order"], None
        if k is None and u["parent_name"] is not None and u["parent_name"] != u["name"]:
            k = here.get(u["parent_name"])
            if k is None and u["parent_name"] in containers:
                at, found = containers[u["parent_name"]]
                far = found if page - at <= e else None
        local.append(k)
        older.append(far)
        if u["name"]:
            here[u["name"]] = u["source_order"]
    kinds = repaired_types(known_types([u["type"] for u in units]), local)
    prefix = {"Image": "IMG", "Rule": "RULE"}
    ids = [f"{prefix.get(t, 'TABLE')}-{hashlib.sha256(f'{document}:{page}:{k}'.encode()).hexdigest()[:32]}" for k, t in enumerate(kinds)]
    own: list[list[str]] = []
    for u, k in zip(units, local, strict=True):
        own.append(list(u["section"]) or (own[k] if k is not None else []))
    for name, k in here.items():
        containers[name] = (page, ids[k])
    last = own[-1] if own else []
    out = [
        {"page": page, "source_order": k, "id": ids[k], "type": kinds[k], "name": u["name"], "content": u["content"], "parent_unit_id": ids[local[k]] if local[k] is not None else older[k], "section": own[k] or list(section)}
        for k, u in enumerate(units)
    ]
    section[:] = last or section
    return out


class UnitProcessor(StatefulProcessor):
    """Pages' html to placed units. State of a document: the last page and its section, containers of the last pages by name, a hash of every page.

    A page that comes again with the same content gives nothing, as its units are out already. A page before the
    last one stands alone: it takes nothing from the state and leaves nothing there.
    """

    def __init__(self, carry_pages: int = DEFAULT.carry_pages) -> None:
        self.carry = carry_pages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "page int, section array<string>")
        self.containers = _Held(handle.getMapState("containers", "name string", "page int, id string"))
        self.seen = _Held(handle.getMapState("seen", "page int", "hash string"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        pages = pd.concat(list(rows)).sort_values(["page"], kind="stable")
        last, section = self.last.get() if self.last.exists() else (None, [])
        section, out = list(section), []
        # names of the last pages only: read once and written back once, as each look into a map state is a call to the JVM
        before = dict(self.containers.items())
        held = dict(before)
        for page, mark, packed in zip(pages["page"].astype(int), pages["html_hash"], pages["packed"], strict=True):
            if page in self.seen and self.seen[page] == mark:
                continue
            self.seen[page] = mark
            units = json.loads(zlib.decompress(packed))
            if last is not None and page <= last:
                out += placed_page(key[0], page, units, [], {}, self.carry)
                continue
            gap = last is not None and page != last + 1
            held = {} if gap else {name: x for name, x in held.items() if page - x[0] <= self.carry}
            section = [] if gap else section
            out += placed_page(key[0], page, units, section, held, self.carry)
            last = page
        for name in before.keys() - held.keys():
            del self.containers[name]
        for name, x in held.items():
            if before.get(name) != x:
                self.containers[name] = x
        if last is not None:
            self.last.update((last, section))
        cols = [c.split()[0] for c in PLACED.split(", ")]
        yield pd.DataFrame([{"document_id": key[0], **r} for r in out], columns=cols)

    def close(self) -> None:
        pass


def unit_stream(pages: DataFrame, carry_pages: int = DEFAULT.carry_pages) -> DataFrame:
    """``pages`` (a stream of HTML rows) to PLACED rows: what :func:`quillmere.plans.placing.placed` gives for all pages at once."""
    return read_pages(pages).groupBy("document_id").transformWithStateInPandas(UnitProcessor(carry_pages), PLACED, "Append", "None")


def read_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (HTML rows) to document_id, page, html_hash and packed: their units as :func:`page_tree.page_units` gives them, read where pages are, not where a document's pages meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillmere.sources.page_tree import page_units

        for b in batches:
            html = [h or "" for h in b.column(2).to_pylist()]
            marks = [hashlib.sha256(h.encode()).hexdigest() for h in html]
            units = [zlib.compress(json.dumps(page_units(h)).encode(), 1) for h in html]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(marks, pa.string()), pa.array(units, pa.binary())], ["document_id", "page", "html_hash", "packed"])

    return pages.select("document_id", "page", "html").mapInArrow(run, "document_id string, page int, html_hash string, packed binary")


#: More files than a delivery has: pages that meet in one micro-batch are put in order, those of several must come in order.
ALL_FILES = 2**31 - 1


def run_stream(spark: SparkSession, source: str, checkpoint: str, sink: str, files_per_trigger: int = 1, schema: str = PAGE, plan=page_stream) -> None:
    """Read files of ``schema`` from ``source`` until none is left, through ``plan``; restarting goes on from the checkpoint. The caller's settings stay."""
    key, store_ = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, store_)
    try:
        pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
        query = plan(pages).writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", sink).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def page_units(pages: DataFrame) -> DataFrame:
    """Page results to unit rows with ids that do not change when a page is delivered again."""
    each = pages.select("document_id", "page", F.posexplode("units").alias("source_order", "u"))
    kind = X.valid_type(F.col("u.type"))
    return each.select(X.unit_id(kind, F.col("document_id"), F.col("page"), F.col("source_order")).alias("id"), "document_id", "page", "source_order", kind.alias("type"), "u.name", "u.content", "u.parent_name", "u.section")
