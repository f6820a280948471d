"""What the engine stores: keyed tables, index segments, jumps, placed units, the queue, steps that go on after a crash."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmere.api import Engine
from quillmere.functions import text as X
from quillmere.operators import concepts, embedding, hierarchy, jobs, search, vector_index
from quillmere.operators.keyed import KeyedTable
from quillmere.operators.versions import Conflict, Versions
from quillmere.plans import placing
from quillmere.plans.retrieval import Offline
from quillmere.sources import page_tree
from quillmere.streaming import pages, queue

KV = "k string, v int"


def size_of(path) -> int:
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def held(t, **how):
    return {r.k: r.v for r in t.read(**how).collect()}


def test_keyed_table_takes_changes_like_a_dict(spark, tmp_path):
    t, want, rng = KeyedTable(spark, str(tmp_path / "t"), KV, ("k",), buckets=4, most_deltas=3), {}, random.Random(3)
    assert held(t) == {} and t.version() == -1 and t.merge() == -1
    for _ in range(7):
        rows = {f"k{rng.randrange(30)}": rng.randrange(100) for _ in range(8)}
        gone = {f"k{rng.randrange(30)}" for _ in range(3)}
        t.merge(spark.createDataFrame(list(rows.items()), KV), spark.createDataFrame([(k,) for k in gone], "k string"))
        want = {k: v for k, v in (want | rows).items() if k not in gone}
        assert held(t) == want
    last = t.version()
    assert max(Counter(b for d in t.manifest()["deltas"] for b in d["buckets"]).values(), default=0) < 3
    t.compact()
    assert held(t) == want and not t.manifest()["deltas"] and held(t, version=last) == want
    assert t.vacuum() > 0 and held(t) == want
    t.replace(spark.createDataFrame([("a", 1), (None, 2)], KV))
    t.merge(spark.createDataFrame([(None, 3)], KV))
    assert held(t) == {"a": 1, None: 3}


def test_a_small_change_writes_little_and_touches_its_bucket_only(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k string, v string", ("k",), buckets=8)
    t.merge(spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")))
    t.compact()
    whole, base = size_of(t.path), dict(t.manifest()["base"])
    t.merge(spark.createDataFrame([("k77", "x")], "k string, v string"))
    assert size_of(t.path) - whole < 0.01 * whole and t.manifest()["base"] == base
    b = t.buckets_of([("k77",)])
    assert len(b) == 1 and t.read(only=b).where("k = 'k77'").first().v == "x"
    before = size_of(t.path)
    t.compact(b)
    assert size_of(t.path) - before < 0.3 * whole and sum(base[x] != y for x, y in t.manifest()["base"].items()) == 1


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    a, b = (KeyedTable(spark, str(tmp_path / "t"), KV, ("k",), buckets=2) for _ in range(2))
    at = a.version()
    a.merge(spark.createDataFrame([("x", 1)], KV), expected=at)
    with pytest.raises(Conflict):
        b.merge(spark.createDataFrame([("y", 2)], KV), expected=at)
    b.merge(spark.createDataFrame([("y", 2)], KV))  # a change of keys alone is put after the other's
    tries = []

    def add(now):
        tries.append(1)
        if len(tries) == 1:
            a.merge(spark.createDataFrame([("x", 5)], KV))
        return now.where("k = 'x'").select("k", (F.col("v") + 1).alias("v")), None

    b.update(add)
    assert held(a) == {"x": 6, "y": 2} and len(tries) == 2
    v = Versions(spark, str(tmp_path / "t"))
    with pytest.raises(Conflict):
        v.commit({}, v.last() - 1)


UNIT = "id string, name string, summary string, content string, section array<string>, metadata struct<defines:array<string>,mentions:array<string>,aliases:array<string>>"


def unit_rows(spark, texts):
    return spark.createDataFrame([(k, "n", None, v, [], None) for k, v in texts.items()], UNIT)


def test_index_after_many_updates_equals_a_full_build(spark, tmp_path):
    rng, texts = random.Random(8), {f"u{k:02d}": "alpha beta " + " ".join(f"w{k * j % 17}" for j in range(5)) for k in range(40)}
    index = first = search.build_index(unit_rows(spark, texts), str(tmp_path / "i"))
    written = []
    for step in range(10):
        fresh = {f"u{rng.randrange(50):02d}": f"alpha w{rng.randrange(17)} new{step}" for _ in range(2)}
        gone = {f"u{rng.randrange(50):02d}"} - fresh.keys()
        before = size_of(tmp_path / "i")
        index = search.update_index(index, spark.createDataFrame([(g,) for g in gone], "id string"), unit_rows(spark, fresh))
        written.append(size_of(tmp_path / "i") - before)
        texts = {k: v for k, v in (texts | fresh).items() if k not in gone}
    whole = search.build_index(unit_rows(spark, texts))
    for name in ("postings", "lengths"):
        rows = [sorted(map(tuple, getattr(x, name).collect())) for x in (index, whole)]
        assert rows[0] == rows[1]
    assert len(index.segments) < 8 and first.lengths.count() == 40  # an older version stays readable
    assert written[0] < 0.5 * size_of(f"{tmp_path}/i/{first.segments[0]['dir']}")
    q = spark.createDataFrame([(0, 0, "alpha w3")], "question_id long, sub_query_index int, query string")
    assert [[(r.id, round(r.score, 9)) for r in search.bm25(x, q, 1).orderBy("rank").collect()] for x in (index, whole)][0] == [(r.id, round(r.score, 9)) for r in search.bm25(whole, q, 1).orderBy("rank").collect()]
    with pytest.raises(Conflict):
        search.update_index(first, spark.createDataFrame([], "id string"), unit_rows(spark, {"z": "z"}))
    assert search.open_index(spark, str(tmp_path / "none")) is None and search.open_index(spark, str(tmp_path / "i")).version == index.version


def test_long_chains_take_the_logarithm_of_their_depth(spark, monkeypatch):
    n = 3000
    rows = [(f"c{k}", f"n{k}", f"c{k - 1}" if k else None) for k in range(n)] + [("x", "X", "y"), ("y", "Y", "z"), ("z", "Z", "y"), ("s", "S", "s"), ("o", "O", "missing"), ("b", "", "c1")]
    u = spark.createDataFrame(rows, "id string, name string, parent_unit_id string")
    jumps = hierarchy.build_jumps(u)
    assert jumps.steps <= 13
    chosen = [f"c{n - 1}", "c5", "x", "s", "o", "b", "c0"]
    found = {r.id: r for r in hierarchy.chains_of(spark.createDataFrame([(c,) for c in chosen], "id string"), u, jumps, len(chosen)).collect()}
    assert found[f"c{n - 1}"].parents == [f"n{k}" for k in range(n - 1)] and found["c5"].parents == ["n0", "n1", "n2", "n3", "n4"]
    assert found["s"].depth == found["o"].depth == found["c0"].depth == 0 and found["b"].parents == ["n0", "n1"] and found["x"].depth == 2
    rounds, keep = [], hierarchy.store
    monkeypatch.setattr(hierarchy, "store", lambda *a: rounds.append(1) or keep(*a))
    small = u.where("length(id) < 4 OR id < 'c13'")
    every = {r.id: r for r in hierarchy.parent_chains(u.where(F.expr("id NOT LIKE 'c%' OR cast(substr(id, 2) AS int) < 300"))).collect()}
    assert len(rounds) <= 11 and every["c299"].parents == [f"n{k}" for k in range(299)] and every["x"].parents == ["Z", "Y"] and every["y"].parents == ["Z"] and small is not None


def test_chosen_units_read_the_buckets_of_their_chains_only(spark):
    u = spark.range(5000).selectExpr("concat('u', id) AS id", "concat('n', id) AS name", "CASE WHEN id % 10 > 0 THEN concat('u', id - 1) END AS parent_unit_id")
    jumps = hierarchy.build_jumps(u, buckets=64)
    assert jumps.steps == 4
    plan = jumps.step(0, [3])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    got = hierarchy.chains_of(spark.createDataFrame([("u19",), ("u4",)], "id string"), u, jumps, 2)
    assert {r.id: r.depth for r in got.collect()} == {"u19": 9, "u4": 4}


def test_inverted_lists_find_most_neighbours_and_all_lists_find_all(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))).tolist()
    v = spark.createDataFrame([(str(k), r) for k, r in enumerate(x)], "id string, vec array<double>")
    q = spark.createDataFrame([(k, 0, x[20 * k]) for k in range(100)], "question_id long, sub_query_index int, query_vec array<double>")
    index = vector_index.built(v, str(tmp_path / "v"))
    assert index.vectors.count() == 3000 and len(index.centroids) == 55
    again = vector_index.opened(spark, str(tmp_path / "v"))
    exact = {(r.question_id, r.id) for r in search.vector_top_k(v, q, 100, 15).collect()}
    near = {(r.question_id, r.id) for r in again.search(q, 100, 15).collect()}
    every = {(r.question_id, r.id) for r in again.search(q, 100, 15, probes=10_000).collect()}
    assert len(exact & near) >= 0.9 * len(exact) and every == exact


def test_the_learnt_embedding_finds_texts_by_their_rare_words(spark):
    rng = random.Random(6)
    texts = [" ".join(["common", "words", "are", "everywhere"] * 5 + [f"rare{rng.randrange(400)}" for _ in range(12)]) for _ in range(150)]
    asked = [" ".join(["common", "words"] * 3 + rng.sample(t.split()[20:], 5)) for t in texts[:60]]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    index = search.build_index(docs.selectExpr("cast(id AS string) AS id", "'' AS name", "'' AS summary", "text AS content", "cast(array() AS array<string>) AS section", "cast(null AS struct<defines:array<string>,mentions:array<string>,aliases:array<string>>) AS metadata"))
    df = {r.term: r.df for r in index.frequencies.collect()}
    assert df["common"] == 150 and index.n_units == 150
    q = spark.createDataFrame(list(enumerate(asked)), "id int, text string")

    def right(embed):
        v = embed(docs).selectExpr("cast(id AS string) AS id", "vec")
        best = search.vector_top_k(v, embed(q).selectExpr("cast(id AS long) AS question_id", "0 AS sub_query_index", "vec AS query_vec"), 60, 3).collect()
        return len({r.question_id for r in best if int(r.id) == r.question_id})

    learnt = right(lambda rows: embedding.vectors(rows, index.frequencies, index.n_units))
    letters = right(lambda rows: rows.select("id", X.hashed_vector(F.col("text")).alias("vec")))
    assert learnt >= 48 and learnt > letters + 20
    one = embedding.vectors(docs, index.frequencies, index.n_units, 128).first().vec
    assert len(one) == 128 and abs(sum(x * x for x in one) - 1) < 1e-9
    assert embedding.vectors(spark.createDataFrame([(1, "?!"), (2, None)], "id int, text string"), index.frequencies, 150).count() == 0


SIX = """<nav><ul><li><a>Home</a><li>News<ul><li>Inner one<li>Inner two</ul> tail</ul></nav><script>var t="<p>no</p>"</script><h1>T &amp; U</h1><p><b>para one<br><p>two<img src="a/b.png" alt="A pic"></p>
<table><tr><th>a<th>b</tr><tr><td>1<td>2</td></tr><tr><td><p>3</p></td><td>4</table><h2>Sub</h2><div>loose</div><ol><li><p>x</p><p>y</p></ol><h1>End</h1><p>after"""


def test_a_page_gives_nested_units_of_all_six_types():
    u = page_tree.page_units(SIX)
    assert {x["type"] for x in u} == {"Rule", "Image", "DataTableHeader", "DataTableRow", "ColumnListTable", "ColumnListItem"}
    by = {x["name"]: x for x in u}
    up = lambda name: u[by[name]["parent_order"]]["name"]
    assert up("1 | 2") == up("3 | 4") == "a | b" and up("Home") == "Home News tail" and up("Inner one") == "Inner one Inner two" and up("Inner one Inner two") == "News tail"
    assert by["para one"]["parent_name"] == "T & U" and by["x y"]["section"] == ["T & U", "Sub"] and by["after"]["section"] == ["End"] and by["A pic"]["content"] == "A pic"
    assert [x["source_order"] for x in u] == list(range(len(u))) and not any("no" == x["content"] or "loose" in x["content"] for x in u)
    for odd in (None, "", "plain", "<li>", "<table><tr><td>", "</ul></p><h1>", "<ul>" * 3000 + "<li>deep" + "</ul>" * 3000):
        page_tree.page_units(odd)


def test_only_references_with_a_semicolon_are_decoded():
    u = page_tree.page_units("<h1>cut &amp;&amp;&amp</h1><p>&lt;x&gt; &copy 1 &unknown; &#65; A&B &ampfoo; <img alt='a&amp' src='/x?a=1&copy=2'></p>")
    assert [x["content"] for x in u] == ["cut &&&amp", "<x> &copy 1 &unknown; A A&B &ampfoo;", "a&amp"]
    assert u[1]["parent_name"] == "cut &&&amp"  # as page_structure, place_stream and engine_redelivery take it from their SQL



def site(seed: int, n: int = 60):
    """Pages of three documents, with gaps, names that repeat, and tables and lists that go on from page to page."""
    rng, out = random.Random(seed), []
    for d in "abc":
        for p in range(1, n):
            if rng.random() < 0.1:
                continue
            parts = []
            for _ in range(rng.randrange(4)):
                name = f"N{rng.randrange(6)}"
                parts.append(rng.choice([f"<h1>{name}</h1>", f"<h2>{name}</h2>", f"<p>{name}</p>", f"<p>remarkable adventures {rng.randrange(9)}</p>", "<ul><li>one<li>two</ul>", "<table><tr><th>h<tr><td>r</table>", "<img src=x.png>"]))
            out.append((d, p, "".join(parts) or None))
    return out


def brute_units(rows, e):
    """Units of all pages, page by page and unit by unit."""
    out, at = {}, {}
    for d, p, html in sorted(rows, key=lambda r: r[:2]):
        last, section, names = at.get(d, (None, [], {}))
        if last != p - 1:
            section, names = [], {}
        at[d] = (p, section, names)
        for u in pages.placed_page(d, p, page_tree.page_units(html), section, names, e):
            out[u["id"]] = (d, p, u["source_order"], u["type"], u["name"], u["parent_unit_id"], tuple(u["section"]))
    return out


def rows_of_units(df):
    return {r.id: (r.document_id, r.page, r.source_order, r.type, r.name, r.parent_unit_id, tuple(r.section)) for r in df.collect()}


def test_parents_and_sections_go_on_across_pages_in_batch_steps_and_stream(spark, tmp_path, monkeypatch):
    rows = site(5)
    for page in (2, 3, 4):  # what is named on one page is the parent of what stands on the next ones
        rows = [r for r in rows if r[:2] != ("a", page)]
    rows += [("a", 2, "<h1>Top</h1><p>x</p>"), ("a", 3, "<p>goes on</p>"), ("a", 4, None)]
    schema = "document_id string, page int, html string"
    want = brute_units(rows, 20)
    assert any(v[5] for v in want.values()) and [v[6] for v in want.values() if v[:3] == ("a", 3, 0)] == [("Top",)]
    df = spark.createDataFrame(rows, schema)
    engine = Engine(spark, str(tmp_path / "e"))
    assert engine.start(df.where("page < 23")) > 0 and engine.start(df) > 0 and engine.start(df) == 0
    assert rows_of_units(engine.read("units")) == want
    assert rows_of_units(engine.extract(df)) == want
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ("page < 11", "page BETWEEN 5 AND 40", "page > 35"):  # pages come again
        df.where(part).coalesce(1).write.mode("append").parquet(source)
        pages.run_stream(spark, source, str(tmp_path / "c"), out, schema=pages.HTML, plan=pages.unit_stream)
    got = spark.read.schema(pages.PLACED).parquet(out)
    assert got.count() == len(want) and rows_of_units(got) == want


def test_named_parents_across_pages_expire(spark):
    units = [("d", p, 0, f"u{p}", "box" if p in (1, 50) else f"n{p}", "box" if p in (10, 21, 22, 60) else None) for p in (1, 10, 21, 22, 50, 60)]
    u = spark.createDataFrame(units, "document_id string, page int, source_order int, id string, name string, parent_name string")
    every = spark.createDataFrame([("d", p) for p in range(1, 61) if p != 55], "document_id string, page int")
    none = spark.createDataFrame([], placing.ANCHORS)
    assert {r.page: r.parent for r in placing.named_parents(u, none, every).collect()} == {10: "u1", 21: "u1"}


class Stops(Offline):
    """A model that fails in one phase."""

    def extract(self, content):
        return F.raise_error(F.lit("model is away"))


def test_a_killed_run_goes_on_where_it_was(spark, tmp_path):
    df = spark.createDataFrame(site(9, 4), "document_id string, page int, html string")
    whole = Engine(spark, str(tmp_path / "a"))
    whole.start(df)
    whole.run()
    root = str(tmp_path / "b")
    first = Engine(spark, root, provider=Stops())
    first.start(df)
    n = first.read("units").count()
    per_doc = {r.document_id: r["count"] for r in first.read("units").groupBy("document_id").count().collect()}
    assert 0 < first.step("summary", limit=2) <= sum(min(2, x) for x in per_doc.values())  # those whose parents have gone on
    with pytest.raises(Exception, match="model is away"):
        first.run()
    second = Engine(spark, root)
    assert second.read("units").where("status = 'summary_done'").count() == n
    second.run(limit=30)
    tables = ("units", "concepts", "concept_aliases", "concept_mentions")
    for t in ("units", "concept_mentions"):
        cols = [c for c in whole.read(t).columns if c not in ("updated_at", "confidence", "method", "concept_id")]
        assert sorted(map(str, whole.read(t).select(cols).collect())) == sorted(map(str, second.read(t).select(cols).collect()))
    assert all(second.read(t).count() for t in tables) and second.status().where("NOT all_done").count() == 0
    second.compact()
    assert second.read("units").count() == n


def test_terms_that_are_spelt_alike_become_one_concept_also_in_later_steps(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    page = lambda n, text: spark.createDataFrame([("d", n, f"<p>{text}</p>")], "document_id string, page int, html string")
    e.start(page(1, "the extraordinary invisibility spell"))
    e.run()
    e.start(page(2, "the extraordinarry invisibility potions"))
    e.run()
    c = {r.canonical_name: r for r in e.read("concepts").collect()}
    assert set(c) == {"extraordinary", "invisibility"} and "extraordinary" in c["extraordinary"].description and len(c["invisibility"].source_unit_ids) == 2
    m = e.read("concept_mentions").where(F.col("concept_id") == c["extraordinary"].id).orderBy("raw_term").collect()
    assert [(r.raw_term, r.method) for r in m] == [("extraordinarry", "embedding"), ("extraordinary", "manual")]
    assert e.read("concept_aliases").count() == 3 and e.read("vectors").where("index = 'concepts'").count() == 2
    e.rebuild_concepts()
    assert e.read("concepts").count() == 2 and e.read("concept_mentions").count() == 4


def test_pages_are_fetched_by_keys_without_gaps(spark):
    u = spark.range(45).selectExpr("format_string('%03d', id) AS id")
    last, seen = None, []
    while rows := jobs.page_after(u, last, 20).collect():
        seen += [r.id for r in rows]
        last = max(r.id for r in rows)
    assert seen == [f"{k:03d}" for k in range(45)]


def fails(document: str, page: int, attempts: int, html: str | None) -> None:
    queue.read_page(document, page, attempts, html)
    if page == 2 and attempts < 2:
        raise TimeoutError("try again")
    if page == 3:
        raise ValueError("broken page")


def test_queue_tries_three_times_and_keeps_dead_letters(spark, tmp_path):
    path, check = str(tmp_path / "q"), str(tmp_path / "c")
    store = spark.createDataFrame([("d", p, f"<h1>H{p}</h1><p>text {p}") for p in (1, 2, 3)], "document_id string, page int, html string")
    messages = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3), ("d", 4), ("d", 1)], "document_id string, page int")
    engine = Engine(spark, str(tmp_path / "e"))
    assert queue.send(messages, path) == 0 and queue.send(messages.limit(0), path) == -1
    queue.consume(spark, path, store, engine.start, check, attempt=fails)
    assert {(r.page, r.attempts, r.error.split(":")[0]) for r in queue.letters(spark, path).read().collect()} == {(3, 3, "ValueError"), (4, 3, "LookupError")}
    assert Counter(r.page for r in engine.read("units").collect()) == {1: 2, 2: 2}
    assert not list(Path(path).glob("sent/*/*.parquet"))[3:]  # what was acknowledged is gone
    queue.send(messages.where("page = 1"), path)
    queue.consume(spark, path, store, engine.start, check, attempt=fails)
    assert Counter(r.page for r in engine.read("units").collect()) == {1: 2, 2: 2}


def test_postings_are_counted_where_units_are_read(spark, tmp_path):
    u = spark.createDataFrame([("a", "x y x", "é x"), ("b", "", None)], "id string, name string, content string")
    u = u.select("id", "name", F.lit("").alias("summary"), "content", F.array().cast("array<string>").alias("section"), F.lit(None).cast("struct<defines:array<string>,mentions:array<string>,aliases:array<string>>").alias("metadata"))
    lengths, lists = search.index_rows(u)
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()
    index = search.build_index(u, str(tmp_path / "i"))
    assert sorted((r.term, r.id, r.tf) for r in index.postings.collect()) == [("x", "a", 3), ("y", "a", 1), ("é", "a", 1)]
    assert {(r.term, r.bucket) for r in index.postings.collect()} == {(r.term, r.b) for r in index.postings.select("term", search.bucket(F.col("term")).alias("b")).collect()}
    assert sorted((r.id, r.len) for r in index.lengths.collect()) == [("a", 5), ("b", 0)]


def test_postings_are_written_without_a_sort_and_read_by_bucket(spark, tmp_path):
    texts = {"a": " ".join(f"w{k} w{k % 7}" for k in range(300)), "b": "w1 é", "c": "?!", "d": None}
    index = search.build_index(unit_rows(spark, texts).coalesce(1), str(tmp_path / "i"))
    files = [p for p in (tmp_path / "i").rglob("*.parquet") if p.parent.name not in ("lengths", "terms", "marks")]
    assert len(files) == 1  # a task that put postings into folders by bucket would sort all of its postings first
    want = Counter((w, i) for i, t in texts.items() for w in ["n", *(t or "").replace("?!", "").split()])
    every = {(r.term, r.id): (r.tf, r.bucket) for r in index.postings.collect()}
    assert {k: v[0] for k, v in every.items()} == want
    some = index.postings_of([3, 40])
    assert {(r.term, r.id) for r in some.collect()} == {k for k, v in every.items() if v[1] in (3, 40)} != set()
    scan = [x for x in some._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in x]
    assert scan and all("b3:" in x and "b40:" in x and "b4:" not in x for x in scan)
    q = spark.createDataFrame([(0, 0, "?"), (1, 0, "w1 w2"), (2, 0, "é")], "question_id long, sub_query_index int, query string")
    assert {(r.question_id, r.id) for r in search.bm25(index, q, 3).collect()} == {(1, "a"), (2, "b")}
    assert search.bm25(index, q.where("query = '?'"), 1).count() == 0


def test_no_task_writes_a_whole_bucket(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "id string, n long", ("id",), 2)
    t.merge(spark.range(0, 4000, 1, 4).select(F.col("id").cast("string").alias("id"), F.col("id").alias("n")))
    files = Counter(p.parent.name for p in tmp_path.rglob("*.parquet"))
    assert len(files) == 2 and min(files.values()) == 4
    assert t.read().agg(F.sum("n")).first()[0] == 3999 * 2000


def test_sparse_vectors_meet_by_the_keys_of_their_places_and_hot_keys_are_split(spark, monkeypatch):
    rng = random.Random(6)
    stems = ["".join(rng.choice("aeiolnrst") for _ in range(rng.randrange(7, 12))) for _ in range(60)]
    cut = lambda w, k: w[:k] + rng.choice("xyz") + w[k + 1 :]
    words = sorted({cut(w, rng.randrange(len(w))) + end for w in stems for end in ("", "ation", "ing") for _ in range(4)})
    t = spark.createDataFrame([(w, k % 900) for k, w in enumerate(words)], "term string, first long").select("term", "first", X.term_vector(F.col("term")).alias("vec")).repartition(4).cache()
    best = lambda met: {(r.term, r.id, r.rank) for r in search.top_k(met, 5, key="term").collect()}
    exact = best(concepts.earlier_neighbours(t, None, None, 0.55, 5))
    for few, rows in ((0, 10**9), (0, 60)):  # no key is too common, many are
        monkeypatch.setattr(vector_index, "FEW_VECTORS", few)
        monkeypatch.setattr(vector_index, "LIST_ROWS", rows)
        found = best(concepts.earlier_neighbours(t, None, 0, 0.55, 5))
        assert len({x[:2] for x in found} & {x[:2] for x in exact}) >= 0.9 * len(exact) and len(exact) > 500
    monkeypatch.setattr(vector_index, "FEW_VECTORS", 10**6)
    assert best(concepts.earlier_neighbours(t, None, 0, 0.55, 5)) == exact  # few vectors are all compared


def test_steps_over_all_units_leave_nothing_to_merge(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.start(spark.createDataFrame([("d", k, f"<h1>T{k}</h1><p>some invisibility words</p>") for k in range(3)], "document_id string, page int, html string"))
    e.run()
    assert all(not e.tables[x].manifest()["deltas"] for x in ("units", "pages", "concept_mentions", "concepts")) and e.read("units").where("status = 'done'").count() == 6
    e.start(spark.createDataFrame([("d", 3, "<p>more</p>")], "document_id string, page int, html string"))
    e.step("summary")
    assert e.tables["units"].manifest()["deltas"] and e.read("units").count() == 7


def test_the_stream_reads_pages_before_they_meet_and_containers_once(spark):
    import pandas as pd

    calls = Counter()

    class Map(dict):
        def containsKey(self, k): return k in self  # noqa: E704, N802
        def getValue(self, k): return self[k]  # noqa: E704, N802
        def updateValue(self, k, v): calls["put"] += 1; self[k] = v  # noqa: E702, E704, N802
        def removeKey(self, k): del self[k]  # noqa: E704, N802
        def iterator(self): calls["read"] += 1; return iter(list(self.items()))  # noqa: E702, E704

    class Value:
        x = None
        def exists(self): return self.x is not None  # noqa: E704
        def get(self): return self.x  # noqa: E704
        def update(self, v): self.x = v  # noqa: E704

    class Handle:
        def getValueState(self, *_): return Value()  # noqa: E704, N802
        def getMapState(self, *_): return Map()  # noqa: E704, N802

    p = pages.UnitProcessor(3)
    p.init(Handle())
    rows = spark.createDataFrame([("d", k, f"<h1>T{k % 5}</h1><p>words of {k}</p>" + "<!-- long -->" * 100) for k in range(40)], pages.HTML)
    read = pages.read_pages(rows).toPandas()
    assert read["packed"].map(len).max() < 400
    out = pd.concat(list(p.handleInputRows(("d",), iter([read]), None)))
    assert len(out) == 80 and calls["read"] == 1 and calls["put"] < 40 + 20  # a hash of each page, and what is left of the names
    assert len(pd.concat(list(p.handleInputRows(("d",), iter([read.tail(2)]), None)))) == 0
