"""Command line: ``python -m stelae list | run NAME DIR | export NAME DIR OUT | normalize TEXT | search DIR WORD``. Submit it with spark-submit on a cluster."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from stelae.functions.normalize import LANGUAGES, normalize
from stelae.operators.search import keyword_in_context
from stelae.plans import catalogue
from stelae.plans.base import table


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="stelae")
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list", help="names of the registered queries")
    run = verbs.add_parser("run", help="show a query's first rows")
    export = verbs.add_parser("export", help="write a query's rows")
    for v in (run, export):
        v.add_argument("name", choices=sorted(catalogue.QUERIES))
        v.add_argument("tables")
    run.add_argument("--rows", type=int, default=20)
    export.add_argument("out")
    export.add_argument("--format", choices=("parquet", "json", "csv"), default="parquet")
    norm = verbs.add_parser("normalize", help="a transcription's normal forms")
    norm.add_argument("text")
    norm.add_argument("--language", choices=sorted(LANGUAGES), default="etruscan")
    find = verbs.add_parser("search", help="a word in its contexts")
    find.add_argument("tables")
    find.add_argument("word")
    find.add_argument("--context", type=int, default=40)
    a = p.parse_args(argv)
    if a.verb == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return
    if a.verb == "normalize":
        print(json.dumps(normalize(a.text, a.language), ensure_ascii=False, indent=1))
        return
    spark = SparkSession.builder.appName("stelae").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.verb == "run":
        catalogue.QUERIES[a.name](spark, a.tables).show(a.rows, truncate=60)
    elif a.verb == "export":
        catalogue.QUERIES[a.name](spark, a.tables).write.format(a.format).save(a.out)
    else:
        keyword_in_context(table(spark, a.tables, "documents"), a.word, a.context, "doc_id").show(50, truncate=False)


if __name__ == "__main__":
    main()
