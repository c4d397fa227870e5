"""Command line: index a repository, watch it, search it, show status, statistics, complexity and files, or remove a file."""

from __future__ import annotations

import argparse
import itertools
import json
import sys
import time

from quarry.config import Config, ProjectConfig, session
from quarry.errors import QuarryError
from quarry.plans.api import Tools
from quarry.plans.embedding import create_provider
from quarry.sources.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("--repository", help="source tree (default: REPOSITORY_PATH or the current folder)")
    p.add_argument("--project", help="project name (default: PROJECT_NAME or the folder's name)")
    p.add_argument("--store", help="folder of the index (default: STORE_PATH or ./index)")
    p.add_argument("--preset", choices=["server", "initialize"], default="initialize")
    p.add_argument("--provider", help="embedding provider (default: EMBEDDING_PROVIDER or hash)")
    loud = p.add_mutually_exclusive_group()
    loud.add_argument("--verbose", action="store_true", help="show progress and what Spark logs as information")
    loud.add_argument("--quiet", action="store_true", help="show errors only")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("--force", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("query")
    kind = s.add_mutually_exclusive_group()
    kind.add_argument("--regex", action="store_true")
    kind.add_argument("--phrase", action="store_true")
    kind.add_argument("--hybrid", action="store_true")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--language")
    sub.add_parser("stats")
    for name in ("info", "refresh", "delete"):
        sub.add_parser(name).add_argument("path")
    measured = sub.add_parser("complexity")
    measured.add_argument("path")
    measured.add_argument("--language")
    measured.add_argument("--no-metrics", action="store_true")
    sub.add_parser("status").add_argument("--log", help="folder of the log of changes")
    watch = sub.add_parser("watch", help="append changes to a log and bring the index up to date from it")
    watch.add_argument("--log", required=True)
    watch.add_argument("--checkpoint", required=True)
    watch.add_argument("--every", type=float, default=2.0, help="seconds between looks at the tree")
    watch.add_argument("--rounds", type=int, help="stop after so many looks (default: never)")
    files = sub.add_parser("files")
    files.add_argument("--category")
    files.add_argument("--limit", type=int, default=100)
    return p


def run(args: argparse.Namespace) -> dict:
    cfg = Config.from_env()
    if args.repository:
        cfg.project = ProjectConfig.from_path(args.repository)
    if args.project:
        cfg.project = ProjectConfig(args.project, cfg.project.root)
    spark = session()
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR" if args.quiet else "WARN")
    provider = args.provider or cfg.embedding.provider
    options = {"dimensions": cfg.embedding.dimensions} if provider == "hash" else {}
    tools = Tools(spark, cfg.project.root, cfg.project.name, Store(spark, args.store or cfg.store), create_provider(provider, **options), args.preset)
    match args.command:
        case "index":
            say = (lambda share, what: print(f"{share:4.0%} {what}", file=sys.stderr)) if args.verbose else None
            return tools.initialize_repository(args.force, say)
        case "status":
            return tools.indexing_status() | {"monitoring": tools.monitoring_status(args.log)}
        case "watch":
            found = 0
            for k in itertools.count():
                if args.rounds is not None and k >= args.rounds:
                    break
                if n := tools.poll(args.log):
                    tools.start_monitoring(args.log, args.checkpoint, every=None).awaitTermination()
                    found += n
                if args.rounds is None or k + 1 < args.rounds:
                    time.sleep(args.every)
            return {"changes": found}
        case "search":
            kind = "pattern" if args.regex or args.phrase else "hybrid" if args.hybrid else "semantic"
            return tools.search_code(args.query, kind, args.regex, args.limit, args.language)
        case "stats":
            return tools.get_repository_stats()
        case "info":
            return tools.get_file_info(args.path)
        case "refresh":
            return tools.refresh_file(args.path)
        case "delete":
            return tools.delete_file(args.path)
        case "complexity":
            return tools.analyze_complexity(args.path, args.language, not args.no_metrics)
        case "files":
            return tools.list_files_by_category(args.category, args.limit)
    raise ValueError(args.command)


def main(argv: list[str] | None = None) -> int:
    try:
        print(json.dumps(run(parser().parse_args(argv)), default=str, indent=1))
        return 0
    except QuarryError as e:
        print(json.dumps(e.to_dict(), default=str), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
