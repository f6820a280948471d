"""The engine over a folder of tables: ingestion in steps, questions, and views of what is stored.

Tables are keyed (:mod:`quillmere.operators.keyed`): a change writes rows in proportion to itself and commits a version,
so readers see whole versions and two writers do not overwrite each other. Work is done by the operators and plans of this
package; nothing is collected but answers, counts and the pages of a view. A step writes what it derives before it moves
units on, and all its writes may be repeated: a run that was killed goes on where it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillmere.config import DEFAULT, Config
from quillmere.functions import text as X
from quillmere.operators import concepts, embedding, hierarchy, jobs, search, store
from quillmere.operators.keyed import KeyedTable
from quillmere.operators.versions import Conflict
from quillmere.plans import ingest, placing, retrieval
from quillmere.plans.retrieval import Offline
from quillmere.schemas import STATUSES, UNITS
from quillmere.session import delete_path, discard, exists, prepare
from quillmere.session import store as stored
from quillmere.sources import page_tree

#: The tables of the engine and their keys.
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "units": (UNITS, ("id",)),
    "pages": (placing.PAGES, ("document_id", "page")),
    "jobs": ("id string, document_id string, phase string, status string, pages_processed long, units_processed long, total_pages long, seq int", ("id",)),
    "vectors": ("index string, id string, vec array<double>", ("index", "id")),
    "concepts": ("id string, canonical_name string, document_id string, description string, source_unit_ids array<string>", ("id",)),
    "concept_aliases": ("concept_id string, alias string, normalized_alias string, confidence double", ("concept_id", "normalized_alias")),
    "concept_mentions": ("concept_id string, unit_id string, raw_term string, mention_type string, confidence double, method string", ("unit_id", "concept_id", "raw_term")),
    "conversations": ("conv_id string, messages string", ("conv_id",)),
}
LOG = "ts timestamp, question string, answer string, iterations int"
STAGES = ["vision", *ingest.STEPS]
PAGE = ["document_id", "page"]


def check_stage(stage: str) -> str:
    if stage not in STAGES:
        raise ValueError(f"{stage} is none of {STAGES}")
    return stage


@dataclass
class Engine:
    spark: SparkSession
    root: str
    provider: Offline = None
    cfg: Config = DEFAULT
    buckets: int = 4

    def __post_init__(self) -> None:
        self.provider = self.provider or Offline()
        prepare(self.spark)
        self.tables = {name: KeyedTable(self.spark, f"{self.root}/{name}", schema, keys, self.buckets) for name, (schema, keys) in TABLES.items()}

    # ---- tables

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def _shrink(self, name: str, after: DataFrame) -> None:
        """Take out the rows that are not in ``after``."""
        t = self.tables[name]
        t.merge(gone=t.read().join(after.select(*t.keys), list(t.keys), "left_anti"))

    def _forget(self, units: DataFrame) -> None:
        """Vectors, mentions and index rows of ``units`` (id) go."""
        self.tables["vectors"].merge(gone=self.read("vectors").join(units, "id", "left_semi"))
        self.tables["concept_mentions"].merge(gone=self.read("concept_mentions").join(units.withColumnRenamed("id", "unit_id"), "unit_id", "left_semi"))
        index = search.open_index(self.spark, f"{self.root}/index")
        if index:
            search.update_index(index, units, self.read("units").limit(0))

    # ---- ingestion

    def start(self, pages: DataFrame) -> int:
        """Take in ``pages`` (document_id, page, html); gives how many are new or changed.

        A page that is stored with the same content is passed over, so a page may be delivered any number of times; of
        different contents of one page in a batch the one of the smallest hash counts. Units get parents, sections and
        types as :mod:`quillmere.plans.placing` says, also from the stored pages before them; the units of a
        changed page are replaced. Documents' jobs begin anew.
        """
        one = pages.selectExpr("cast(document_id AS string) AS document_id", "cast(page AS int) AS page", "html").withColumn("html_hash", F.sha2(F.coalesce("html", F.lit("")), 256))
        one = one.groupBy(*PAGE).agg(F.min("html_hash").alias("html_hash"), F.min_by("html", "html_hash").alias("html"))
        known = self.read("pages")
        found = stored(page_tree.extracted(one.join(known.select(*PAGE, "html_hash"), [*PAGE, "html_hash"], "left_anti")), "extracted")
        n = found.count()
        if not n:
            return 0
        fresh = found.select(*PAGE)
        docs = fresh.select("document_id").distinct()
        old_pages = known.join(docs, "document_id", "left_semi").join(fresh, PAGE, "left_anti")
        block = F.floor(F.col("page") / self.cfg.carry_pages)
        blocks = fresh.select("document_id", F.explode(F.array(block, block - 1)).alias("block")).distinct()
        before = self.read("units")
        anchors = before.withColumn("block", block).join(blocks, ["document_id", "block"], "left_semi").join(fresh, PAGE, "left_anti").select("document_id", "page", "source_order", "id", "name")
        units, kept = placing.placed(found, old_pages, anchors, self.cfg)
        units, kept = stored(units, "placed"), stored(kept, "kept")
        stale = stored(before.join(fresh, PAGE, "left_semi").select("id"), "stale")
        if old := stale.limit(1).count():
            self._forget(stale)
        self.tables["units"].merge(units, stale.join(units, "id", "left_anti") if old else None)
        self.tables["pages"].merge(kept)
        total = self.read("units").join(docs, "document_id", "left_semi").groupBy("document_id").agg(F.count_distinct("page").alias("total_pages"))
        self.tables["jobs"].merge(jobs.started(total))
        self._advance(docs)
        for x in (found, units, kept, stale):
            discard(x)
        return n

    def _advance(self, docs: DataFrame | None = None) -> None:
        """The jobs of ``docs`` (all by default) go on to the first phase that still has work."""
        log, units = self.read("jobs"), self.read("units")
        if docs is not None:
            log, units = (x.join(docs, "document_id", "left_semi") for x in (log, units))
        self.tables["jobs"].merge(stored(jobs.advanced(log, units), "jobs"))

    def step(self, stage: str, pages: list[int] | None = None, limit: int | None = None) -> int:
        """One phase for the units that are due, on the given pages or all; gives how many.

        ``limit``: of each document at most so many, those first whose parents have gone on. What is done is observed while it is written.
        """
        check_stage(stage)
        version = self.tables["units"].version()
        units = self.tables["units"].read(version)
        scope = units.where(F.col("page").isin(pages)) if pages else units
        status = ingest.STEPS[stage][0]
        due = jobs.parent_first(scope, status, limit, "document_id").select(*units.columns) if limit else scope.where(F.col("status") == status)
        seen = Observation(f"{stage} of {self.root}")
        due = stored(due.observe(seen, F.count("*").alias("n")), "due")
        n = seen.get["n"]
        if not n:
            return 0
        after = ingest.run_phase(due, stage, None, self.provider)
        if stage == "metadata":
            text = ingest.text_columns(after)
            after = after.drop("metadata_terms_text", "section_path_text", "aliases_text").join(text, "id")
        docs = due.select("document_id").distinct()
        if stage == "embedding":
            index = search.open_index(self.spark, f"{self.root}/index")
            index = search.update_index(index, due.select("id").limit(0), due) if index else search.build_index(due, f"{self.root}/index")
            around = units.join(docs, "document_id", "left_semi")
            self.tables["vectors"].merge(ingest.learned_vectors(around, due.select("id"), "document", index))
        if stage == "concepts":
            self._resolve(due, units)
        self._put_units(after, n, units, version)
        self._advance(docs)
        discard(due)
        return n

    def _put_units(self, after: DataFrame, n: int, units: DataFrame, version: int) -> None:
        """``n`` changed units go into the table: if they are all of ``units`` as their new base, which later steps read without merging."""
        if n == units.count():
            try:
                self.tables["units"].replace(after, version)
                return
            except Conflict:  # another writer came first: a change of keys
                pass
        self.tables["units"].merge(after)

    def _resolve(self, due: DataFrame, units: DataFrame) -> None:
        """Concepts, aliases, mentions and concept vectors of the ``due`` units: terms join stored or earlier concepts, or found one."""
        rows = stored(concepts.group_terms(concepts.raw_mentions(due)), "terms")
        known = self.read("concepts").select(F.col("id").alias("concept_id"), F.col("canonical_name").alias("concept_term"))
        aliases = self.read("concept_aliases").join(known, "concept_id").select("normalized_alias", "concept_term")
        terms = rows.groupBy("term").agg(F.min("first").alias("first"))
        held = self.read("vectors").where("index = 'concepts'").select(F.col("id").alias("concept_id"), "vec").join(known, "concept_id").select(F.col("concept_term").alias("term"), "vec")
        named = stored(concepts.resolve(terms, aliases, terms.select("term", X.term_vector(F.col("term")).alias("vec")), self.cfg, held), "resolved")
        told = rows.join(named, "term").withColumn("concept_id", concepts.concept_id(F.col("concept_term")))
        old = self.read("concept_mentions").join(due.select(F.col("id").alias("unit_id")), "unit_id", "left_semi").join(told, ["unit_id", "concept_id", "raw_term"], "left_anti")
        gone = old if self.tables["concept_mentions"].version() >= 0 else None
        self.tables["concept_mentions"].merge(told.select("concept_id", "unit_id", "raw_term", "mention_type", "confidence", "method"), gone)
        every = named.select(concepts.concept_id(F.col("concept_term")).alias("concept_id"), F.col("term").alias("alias"), F.col("term").alias("normalized_alias"), F.when(F.col("method") == "manual", 1.0).otherwise(F.col("confidence")).alias("confidence"))
        self.tables["concept_aliases"].merge(every.join(self.read("concept_aliases"), ["concept_id", "normalized_alias"], "left_anti"))
        owner = told.join(due.select(F.col("id").alias("unit_id"), "document_id"), "unit_id").groupBy("concept_id").agg(F.min("document_id").alias("document_id"), F.first("concept_term").alias("canonical_name"))
        text = concepts.described(self.read("concept_mentions").join(owner.select("concept_id"), "concept_id", "left_semi").select(F.col("concept_id").alias("term"), "unit_id", "mention_type"), units)
        old = self.read("concepts").select(F.col("id").alias("concept_id"), F.col("document_id").alias("old_document"))
        now = owner.join(old, "concept_id", "left").join(text.withColumnRenamed("term", "concept_id"), "concept_id", "left")
        now = stored(now.select(F.col("concept_id").alias("id"), "canonical_name", F.coalesce("old_document", "document_id").alias("document_id"), "description", "source_unit_ids"), "concepts")
        self.tables["concepts"].merge(now)
        self.tables["vectors"].merge(now.select(F.lit("concepts").alias("index"), "id", X.term_vector(F.col("canonical_name")).alias("vec")))

    def run(self, limit: int | None = None) -> None:
        """All phases, one after another; with ``limit`` in steps of so many units a document. Run again, it goes on with what is left."""
        for stage in ingest.STEPS:
            while self.step(stage, limit=limit) and limit:
                pass

    def status(self) -> DataFrame:
        """Each document's job, and how many units each phase has left."""
        left = ingest.remaining(self.read("units")).withColumnRenamed("done", "all_done")
        return self.read("jobs").drop("seq").join(left, "document_id", "left")

    def cleanup(self, document_id: str) -> None:
        """A document and all that came from it go; logs stay."""
        gone = stored(self.read("units").where(F.col("document_id") == document_id).select("id"), "gone")
        self._forget(gone)
        names = ["concepts", "concept_aliases", "concept_mentions", "vectors", "units", "jobs"]
        after = store.cascade_delete({n: self.read(n) for n in names}, document_id)
        for name in ["concept_mentions", "concept_aliases", "vectors", "concepts", "jobs", "units"]:
            self._shrink(name, after[name])
        self.tables["pages"].merge(gone=self.read("pages").where(F.col("document_id") == document_id))

    def reset(self, stage: str, pages: list[int] | None = None) -> None:
        """Units rewound to before ``stage``, with what later phases made of them deleted."""
        check_stage(stage)
        units = self.read("units")
        scope = units.where(F.col("page").isin(pages)) if pages else units
        if stage in ("vision", "summary", "metadata", "concepts"):
            after = store.reset_concepts(*(self.read(t) for t in ("concepts", "concept_aliases", "concept_mentions")), units, pages)
            gone = self.read("concepts").join(after[0], "id", "left_anti").select(F.lit("concepts").alias("index"), "id")
            self.tables["vectors"].merge(gone=gone)
            for name, rows in zip(("concepts", "concept_aliases", "concept_mentions"), after, strict=True):
                self._shrink(name, rows)
        if stage != "concepts":
            hit = stored(scope.select("id"), "reset")
            self.tables["vectors"].merge(gone=self.read("vectors").where("index <> 'concepts'").join(hit, "id", "left_semi"))
            index = search.open_index(self.spark, f"{self.root}/index")
            if index:
                search.update_index(index, hit, units.limit(0))
        if stage == "vision":
            self.tables["units"].merge(gone=scope)
            self.tables["pages"].merge(gone=self.read("pages").where(F.col("page").isin(pages)) if pages else self.read("pages"))
        else:
            self.tables["units"].merge(stored(store.reset_stage(scope, stage), "reset"))
        self._advance()

    def compact(self) -> None:
        """Merge the deltas of all tables and delete what no recent version needs; no writer may be at work."""
        for t in self.tables.values():
            t.compact()
            t.vacuum()

    def extract(self, pages: DataFrame) -> DataFrame:
        """The units that ``pages`` (document_id, page, html) give, without storing them."""
        none = self.spark.createDataFrame([], placing.PAGES), self.spark.createDataFrame([], placing.ANCHORS)
        return placing.placed(stored(page_tree.extracted(pages), "extracted"), *none, self.cfg)[0]

    def rebuild_concepts(self) -> None:
        """Concepts of all units anew."""
        self.reset("concepts")
        self.step("concepts")

    # ---- questions

    def library(self) -> retrieval.Library:
        """What is stored, opened; nothing is built."""
        u = self.read("units").where(F.col("status").isin(STATUSES[3:]))
        v = self.read("vectors")
        of = lambda index: v.where(F.col("index") == index).select("id", "vec")
        m = self.read("concept_mentions").select("unit_id", F.col("concept_id").alias("term"), "mention_type")
        index = search.open_index(self.spark, f"{self.root}/index")
        if index is None:
            raise ValueError(f"nothing is indexed in {self.root}: run the embedding step first")
        return retrieval.Library(u, index, of("subjects"), of("content"), m)

    def embed(self, texts: list[str]) -> list[list[float]]:
        """Vectors of a few texts by the stored embedding; one without words points along the first axis."""
        index = search.open_index(self.spark, f"{self.root}/index")
        rows = self.spark.createDataFrame(list(enumerate(texts)), "id int, text string")
        found = {r.id: r.vec for r in embedding.vectors(rows, index.frequencies, index.n_units).collect()}
        return [found.get(k, [1.0] + [0.0] * (embedding.DIMENSIONS - 1)) for k in range(len(texts))]

    def ask(self, questions: list[str], conversation: str | None = None, **options) -> list[dict]:
        """Answers with citations and evidence; a conversation gains both sides, and the log a row for each question."""
        found = retrieval.run_queries(self.spark, questions, self.library, self.embed, self.provider, self.cfg, **options)
        rows = self.spark.createDataFrame([(x["question"], x["answer"], x["iterations"]) for x in found], "question string, answer string, iterations int")
        jobs.append_log(rows.withColumn("ts", F.current_timestamp()).select("ts", "question", "answer", "iterations"), f"{self.root}/logs")
        if conversation:
            said = [(conversation, 2 * k + n, role, x[key]) for k, x in enumerate(found) for n, (role, key) in enumerate((("user", "question"), ("assistant", "answer")))]
            new = self.spark.createDataFrame(said, "conv_id string, n int, role string, text string")
            t = self.tables["conversations"]
            t.update(lambda now: (jobs.appended_all(now.where(F.col("conv_id") == conversation), new), None))
        return found

    def plan(self, questions: list[str]) -> DataFrame:
        """What routing and decomposing say of each question."""
        return self.provider.planned(self.spark.createDataFrame(list(enumerate(questions)), "question_id long, question string"))

    def route(self, question: str) -> dict:
        return self.plan([question]).select("rag", "language", "question", "entities").first().asDict()

    def decompose(self, question: str) -> dict:
        return self.plan([question]).select("sub_queries", "is_list", "complex").first().asDict()

    def retrieve(self, queries: DataFrame, n_queries: int, seen: DataFrame | None = None) -> DataFrame:
        return retrieval.passing(retrieval.retrieve(self.library(), queries, n_queries, seen, self.cfg), self.cfg)

    def sufficiency(self, found: DataFrame, queries: DataFrame) -> DataFrame:
        return self.provider.sufficient(found, queries)

    def answer(self, found: DataFrame) -> DataFrame:
        return self.provider.answers(found)

    # ---- views

    def sources(self) -> DataFrame:
        return self.read("units").groupBy("document_id").agg(F.count("*").alias("n_units"), F.count_distinct("page").alias("n_pages"))

    def concepts(self) -> DataFrame:
        return concepts.overview(self.read("concepts"), self.read("concept_aliases"), self.read("concept_mentions")).orderBy("canonical_name")

    def concept(self, concept_id: str) -> DataFrame:
        return self.read("concept_mentions").where(F.col("concept_id") == concept_id).join(self.read("units").select(F.col("id").alias("unit_id"), "page", "type", "name"), "unit_id")

    def tree(self, document_id: str) -> DataFrame:
        return hierarchy.tree(self.read("units").where(F.col("document_id") == document_id))

    def unit(self, unit_id: str) -> DataFrame:
        return self.read("units").where(F.col("id") == unit_id)

    def edit(self, unit_id: str, **fields: str) -> None:
        changes = self.spark.createDataFrame([(unit_id, *fields.values())], "id string, " + ", ".join(f"{k} string" for k in fields))
        self.tables["units"].update(lambda now: (ingest.edit_units(now.where(F.col("id") == unit_id), changes, list(fields)), None))

    def logs(self, n: int = 200) -> DataFrame:
        at = f"{self.root}/logs"
        rows = self.spark.read.schema(f"{LOG}, date date").parquet(at).drop("date") if exists(self.spark, at) else self.spark.createDataFrame([], LOG)
        return rows.orderBy(F.desc("ts"), "question").limit(n)

    def clear_logs(self) -> None:
        delete_path(self.spark, f"{self.root}/logs")
