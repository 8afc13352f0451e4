"""Command line: python -m palimpsest --root DIR COMMAND ..."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="palimpsest")
    p.add_argument("--root", required=True, help="folder of the engine's tables")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in (("index", ["folder"]), ("doctor", ["folder"]), ("search", ["query"]), ("recall", ["query"]), ("cluster", []), ("sessions", []), ("projects", []), ("topics", []), ("follow", ["folder"]), ("summarize", []), ("tools", [])):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        c.add_argument("--project")
        c.add_argument("--limit", type=int, default=10)
        if name == "summarize":
            c.add_argument("--model", required=True, help="a program that reads the prompts from its input and writes the reply")
            c.add_argument("--session")
            c.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    if a.command == "tools":
        from palimpsest.tools import help_text

        print(help_text())
        return

    from pyspark.sql import SparkSession

    from palimpsest.facade import Engine
    from palimpsest.operators import sessions as se
    from palimpsest.sources import transcripts as tr

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    e = Engine(spark, a.root)
    match a.command:
        case "index":
            print(e.refresh(a.folder, lambda done, total: print(f"{done} of {total} files", flush=True)))
        case "follow":
            e.follow(a.folder).awaitTermination()
        case "summarize":
            import subprocess

            e.model = a.model
            e.complete = lambda system, user: subprocess.run(a.model, shell=True, input=f"{system}\n\n{user}", capture_output=True, text=True, check=True).stdout
            print(e.summarize(a.project, a.limit, a.force, a.session))
        case "doctor":
            parsed = tr.lines(spark, tr.discover(spark, a.folder))
            records = tr.records(parsed)
            se.doctor(records, None).show(truncate=False)
            se.type_histogram(records, unknown=True).show(truncate=False)
            tr.parse_stats(parsed).show(truncate=False)
        case "search":
            e.search(a.query, a.limit, a.project).show(a.limit, truncate=False)
        case "recall":
            e.recall(a.query, a.project, limit=a.limit)["items"].select("rank", "title", "why", "text").show(a.limit, truncate=120)
        case "cluster":
            e.cluster().show(truncate=False)
        case "sessions":
            e.list_sessions(a.project, a.limit).show(a.limit, truncate=60)
        case "projects":
            e.list_projects().show(truncate=False)
        case "topics":
            e.list_topics().show(truncate=60)


if __name__ == "__main__":
    main()
