"""Command line: python -m tarn HOME REPO ingest PATH | query TEXT | review PATH | architect-report | autonomous-run OUT."""

from __future__ import annotations

import argparse
import json

from tarn.plans.engine import Engine
from tarn.session import local_session
from tarn.sources.files import acquire


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tarn")
    p.add_argument("home", help="folder of the repository's tables")
    p.add_argument("repo", help="the repository's name")
    commands = p.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest")
    ingest.add_argument("path")
    ingest.add_argument("--incremental", action="store_true")
    for name, arg in (("query", "text"), ("review", "path"), ("autonomous-run", "out")):
        commands.add_parser(name).add_argument(arg)
    commands.add_parser("architect-report")
    a = p.parse_args(args)
    engine = Engine(local_session(), a.home, a.repo)
    if a.command == "ingest":
        out = engine.ingest(acquire(a.path, f"{a.home}/clone"), a.incremental).__dict__
    elif a.command == "query":
        out = engine.route(a.text)
    elif a.command == "review":
        out = {"review": engine.review(a.path)}
    elif a.command == "architect-report":
        out = engine.architecture_report()
    else:
        out = {"report": engine.autonomous_scan(a.out)}
    print(json.dumps(out, indent=1, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
