"""python -m quillmere COMMAND --root FOLDER ...: ingestion, questions and views from a shell."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from quillmere.api import STAGES, Engine
from quillmere.functions import text as X


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmere")
    p.add_argument("command", choices=["ingest", "step", "run", "status", "cleanup", "reset", "rebuild-concepts", "ask", "sources", "concepts", "tree", "logs", "clear-logs"])
    p.add_argument("argument", nargs="*", help="questions, a document or a stage")
    p.add_argument("--root", required=True, help="folder of the engine's tables")
    p.add_argument("--pages", help="page list such as 1,3,5-10; for ingest a Parquet path of document_id, page, html")
    p.add_argument("--iterations", type=int)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillmere").getOrCreate()
    engine = Engine(spark, args.root)
    pages = None
    if args.pages and args.command != "ingest":
        from pyspark.sql import functions as F

        pages = list(spark.range(1).select(X.page_range(F.lit(args.pages)).alias("p")).first().p)
    if args.command == "ingest":
        engine.start(spark.read.parquet(args.pages))
    elif args.command in ("step", "reset"):
        for stage in args.argument:
            if stage not in STAGES:
                print(f"{stage} is none of {', '.join(STAGES)}")
                return 2
            (engine.step if args.command == "step" else engine.reset)(stage, pages)
    elif args.command == "cleanup":
        for document in args.argument:
            engine.cleanup(document)
    elif args.command == "ask":
        for x in engine.ask(args.argument, max_iterations=args.iterations):
            print(json.dumps({k: x[k] for k in ("question", "answer", "citations", "iterations")}))
    elif args.command in ("run", "rebuild-concepts", "clear-logs"):
        getattr(engine, args.command.replace("-", "_"))()
    else:
        view = engine.tree(args.argument[0]) if args.command == "tree" else getattr(engine, args.command)()
        for row in view.toJSON().toLocalIterator():
            print(row)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
