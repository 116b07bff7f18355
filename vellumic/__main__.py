"""The library at the command line: ``python -m vellumic ROOT COMMAND ...``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from vellumic.library import Library
from vellumic.session import session
from vellumic.sources import chapters as CH


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="vellumic", description=__doc__)
    out.add_argument("root", help="folder of the library")
    out.add_argument("--vocabulary", type=Path, help="JSON file: category to terms")
    out.add_argument("--domains", type=Path, help="JSON file: domain to categories")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("ingest").add_argument("inbox")
    for name in ("index", "status", "stale", "report", "graph", "facets", "labels"):
        commands.add_parser(name)
    for name in ("search", "consult"):
        ask = commands.add_parser(name)
        ask.add_argument("questions", nargs="+", help="one question, in one or several languages")
        ask.add_argument("--most", type=int, default=6)
        cut = ask.add_mutually_exclusive_group(required=True)
        cut.add_argument("--category")
        cut.add_argument("--domain")
        cut.add_argument("--everywhere", action="store_true")
    for name in ("move", "remove", "revise"):
        change = commands.add_parser(name)
        change.add_argument("--dry", action="store_true", help="show what would change")
        change.add_argument("--no-index", action="store_true", help="leave the index as it is")
        if name != "revise":
            change.add_argument("folders", nargs="+")
        if name == "move":
            change.add_argument("--to", required=True, help="category")
    return out


def run(args: argparse.Namespace, spark: SparkSession) -> DataFrame:
    """The rows that a command shows."""
    read = lambda path: json.loads(path.read_text()) if path else None
    lib = Library(spark, args.root, read(args.vocabulary), read(args.domains))
    if args.command == "ingest":
        return lib.ingest(args.inbox).select("path", "status", "category", "n_words", "error")
    if args.command == "search":
        return lib.search(args.questions, args.most, lib.allowed(args.category, args.domain, args.everywhere)).orderBy("rank")
    if args.command == "consult":
        return lib.consult(args.questions, category=args.category, domain=args.domain, everywhere=args.everywhere, most=args.most)[0].select("rank", "document", "chapter", "pages", "card")
    if args.command == "move":
        return lib.move(args.folders, args.to, args.dry, not args.no_index).select("folder", "category", "status")
    if args.command == "remove":
        return lib.remove(args.folders, args.dry, not args.no_index).select("folder", "category", "status")
    if args.command == "revise":
        return lib.revise(args.dry, not args.no_index)
    shown = {
        "index": lib.index, "stale": lib.stale, "graph": lib.graph_report, "facets": lib.facets, "labels": lib.labels,
        "status": lambda: CH.status(lib.manifest()), "report": lambda: CH.library_report(lib.manifest()),
    }
    return shown[args.command]()


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    for row in run(args, session()).toLocalIterator():
        print(json.dumps(row.asDict(), default=str, ensure_ascii=False))


if __name__ == "__main__":
    main()
