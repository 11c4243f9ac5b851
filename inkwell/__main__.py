"""python -m inkwell {schema,structural,embed,semantic,all,status,parse-check,ask}"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from inkwell.config import Settings
from inkwell.engine import Engine


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="inkwell")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("schema", "structural", "status", "parse-check"):
        commands.add_parser(name)
    commands.add_parser("embed").add_argument("--force", action="store_true")
    semantic = commands.add_parser("semantic")
    semantic.add_argument("--limit", type=int)
    semantic.add_argument("--force", action="store_true")
    semantic.add_argument("--extract-words", type=int, default=1500)
    semantic.add_argument("--max-seconds", type=float)
    every = commands.add_parser("all")
    every.add_argument("--force", action="store_true")
    every.add_argument("--semantic", action="store_true")
    ask = commands.add_parser("ask")
    ask.add_argument("question", choices=("search", "tag", "tags", "document", "similar", "related", "path", "recent"))
    ask.add_argument("about", nargs="*")
    given = parser.parse_args(args)

    engine = Engine(SparkSession.builder.appName("inkwell").getOrCreate(), Settings.from_env())
    if given.command == "schema":
        print(f"version {engine.schema()}")
    elif given.command == "status":
        print(engine.status())
    elif given.command == "parse-check":
        print(engine.parse_check().render())
    elif given.command == "structural":
        print(engine.sync_structural().render())
    elif given.command == "embed":
        print(engine.sync_embeddings(force=given.force).render())
    elif given.command == "ask":
        print(engine.ask(given.question, *given.about))
    elif given.command == "all":
        print("\n".join(r.render() for r in engine.sync_all(given.force, given.semantic)))
    else:
        report = engine.sync_semantic(limit=given.limit, force=given.force, extract_words=given.extract_words, max_seconds=given.max_seconds)
        print(report.render())
        return int(report.counts["failed"] > 0 and report.counts["documents"] == 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
