"""The engine over a folder: ingestion, resets, questions and the command line."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillmere import __main__ as cli
from quillmere.api import Engine, check_stage
from quillmere.functions import text as X
from quillmere.plans.retrieval import Offline
from quillmere.sources import readers

PAGES = [("a", 1, "<h1>Fire Spell</h1><p>The Wizard casts a Fire Spell on extraordinary creatures.</p><ul><li>Costs mana</ul>"), ("a", 2, "<p>Wizards study extraordinary <b>Spells</b>.</p>"), ("b", 1, "<h1>Ships</h1><p>Sailing needs wind.</p>"), ("b", 2, None)]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    made = Engine(spark, str(tmp_path_factory.mktemp("engine")))
    made.start(spark.createDataFrame(PAGES, "document_id string, page int, html string"))
    made.run()
    return made


def test_ingestion_goes_through_all_phases(engine):
    got = {r.document_id: r for r in engine.status().collect()}
    assert got["a"].phase == "done" and got["a"].units_processed == 5 and got["b"].pages_processed == 1 and got["a"].all_done
    assert engine.read("vectors").where("index <> 'concepts'").count() == 14 and engine.read("concept_mentions").count() > 0


def test_questions_find_what_was_ingested(engine):
    found = engine.ask(["fire spell", "hello", "wind; extraordinary"], conversation="c1")
    assert found[1]["iterations"] == 0 and found[0]["citations"] and found[2]["evidence"]
    first = engine.unit(found[0]["evidence"][0]).first()
    assert "Fire Spell" in first.content or "Fire Spell" in first.section
    assert engine.logs().count() == 3 and len(json.loads(engine.read("conversations").first().messages)) == 6


def test_ingesting_a_page_again_replaces_it(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    rows = lambda html: spark.createDataFrame([("a", 1, html)], "document_id string, page int, html string")
    e.start(rows("<p>one</p><p>two</p>"))
    e.step("summary")
    e.start(rows("<p>one</p>"))
    assert [r.content for r in e.read("units").collect()] == ["one"] and e.read("units").first().status == "pending"
    e.step("summary")
    e.reset("summary")
    assert e.read("units").where("status = 'pending' AND summary IS NULL").count() == 1
    e.edit(e.read("units").first().id, content="edited")
    assert e.read("units").first().content_hash == spark.range(1).select(F.sha2(F.lit("edited"), 256)).first()[0]
    e.cleanup("a")
    assert e.read("units").count() == 0 and e.read("jobs").count() == 0
    with pytest.raises(ValueError):
        check_stage("nothing")


def test_command_line(spark, tmp_path, capsys):
    root, pages = str(tmp_path / "root"), str(tmp_path / "pages")
    spark.createDataFrame(PAGES, "document_id string, page int, html string").write.parquet(pages)
    run = lambda *a: cli.main([*a, "--root", root], spark)
    assert run("ingest", "--pages", pages) == 0 and run("run") == 0 and run("status") == 0
    assert '"phase":"done"' in capsys.readouterr().out.replace(" ", "")
    assert run("ask", "fire spell") == 0 and json.loads(capsys.readouterr().out)["citations"]
    assert run("reset", "nothing") == 2 and run("sources") == 0 and run("tree", "a") == 0 and run("concepts") == 0


def test_functions_at_their_edges(spark):
    row = spark.range(1).select(
        X.json_repaired(F.lit('{"a": {"b": 1,')).alias("cut"), X.json_repaired(F.lit("no json")).alias("none"), X.only_strings(F.lit("[1]")).alias("strings"), X.only_strings(F.lit(None).cast("string")).alias("null"),
        X.integer_or(F.lit("x"), 200).alias("default"), X.percent(F.lit(1), F.lit(0)).alias("zero"), X.hashed_vector(F.lit("")).alias("blank"), X.filled_template("${a}-${b}", {"a": F.lit("1")}).alias("template"),
        X.sub_queries(F.lit("a and b; c? d or e; f")).alias("parts"), X.retry_delay_ms(F.lit(3)).alias("delay"),
    ).first()
    assert row.cut == '{"a": {"b": 1}}' and row.none is None and row.strings == row.null == [] and row.default == 200 and row.zero == "0.0%"
    assert row.blank is None and row.template == "1-${b}" and row.parts == list("abcde") and row.delay == 8000
    plan = Offline().planned(spark.createDataFrame([(0, "list a and b and c"), (1, "hello"), (2, "?")], "question_id long, question string")).orderBy("question_id").collect()
    assert (plan[0].sub_queries, plan[0].is_list, plan[0].complex, plan[0].rag) == (["list a", "b", "c"], True, True, True) and not plan[1].rag and not plan[2].rag


def test_tables_in_all_formats_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    for kind in readers.FORMATS:
        readers.write_table(df, f"{tmp_path}/{kind}", kind)
        assert sorted(map(tuple, readers.read_table(spark, f"{tmp_path}/{kind}", "id int, v string", kind).collect()), key=str) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        readers.read_table(spark, "x", "id int", "xml")
