"""Command line: build tables from tournament files, then report on them."""

from __future__ import annotations

import argparse
import datetime

from .operators import filters
from .operators.classify import RuleSet
from .plans import report as reports
from .session import build_session
from .sources import tournaments
from .tables import Tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="metaladder")
    top.add_argument("--tables", default="tables", help="folder of the Parquet tables")
    sub = top.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="read tournament and rule files, write the tables")
    build.add_argument("root", help="folder with Tournaments/")
    build.add_argument("rules", help="folder with Formats/")
    build.add_argument("--format", required=True, help="format whose tournaments and rules are read")
    for name in ("report", "cards"):
        p = sub.add_parser(name)
        p.add_argument("--since", default=str(datetime.date.today() - datetime.timedelta(days=90)))
        p.add_argument("--until")
        p.add_argument("--sources", nargs="*")
        p.add_argument("--scope", default="combined", choices=[*filters.SCOPES, "all"])
        p.add_argument("--out", default="report")
        p.add_argument("--bootstrap", type=int, default=100)
        if name == "report":
            p.add_argument("--top", type=int, default=15)
            p.add_argument("--min-matches", type=int, default=8)
        else:
            p.add_argument("archetype")
            p.add_argument("--board", default="main", choices=["main", "side"])
            p.add_argument("--min-decks", type=int, default=5)
    dashboard = sub.add_parser("dashboard", help="write the payload of all period and scope cells")
    dashboard.add_argument("--out", default="dashboard.json")
    dashboard.add_argument("--bootstrap", type=int, default=100)
    return top


def main(argv: list[str] | None = None, spark=None) -> None:
    args = parser().parse_args(argv)
    spark = spark or build_session()
    if args.command == "build":
        tournaments.load(spark, args.root, RuleSet.read(args.rules, args.format), args.format).write(args.tables)
        return
    tables = Tables.read(spark, args.tables)  # what ``build`` wrote
    if args.command == "dashboard":
        reports.write_payload(reports.payload(tables, bootstrap=args.bootstrap), args.out)
        return
    for scope in filters.SCOPES if args.scope == "all" else [args.scope]:
        out = f"{args.out}/{scope}" if args.scope == "all" else args.out
        if args.command == "report":
            reports.report(tables, out, args.since, args.until, args.sources, scope, top=args.top, min_matches=args.min_matches, bootstrap=args.bootstrap)
        else:
            kept = filters.restrict(tables, args.since, args.until, args.sources, scope)
            pilot = reports.pilot_of(tables, args.until or reports.last_date(tables), scope, filters.SCOPES, args.sources, args.since, args.bootstrap)
            reports.card_report(kept, args.archetype, out, args.board, args.min_decks, pilot).show(40, False)


if __name__ == "__main__":
    main()
