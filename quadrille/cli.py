"""Command line: ``python -m quadrille (-c DIR [-p NAME=VALUE;...] | -m MODEL) [-e SQL | -f FILE]``."""

from __future__ import annotations

import argparse
import sys

from quadrille.engine import Engine, connect, connect_model
from quadrille.plans.literals import split_top


def run(engine: Engine, text: str, out=None) -> None:
    """Run statements separated by semicolons; ``!tables [db]``, ``!describe t`` and ``!columns`` list the catalog."""
    out = out or sys.stdout
    for statement in filter(None, split_top(text, ";")):
        words = statement.split()
        if words[0] in ("!tables", "!table"):
            names = [words[1]] if len(words) > 1 else list(engine.known)
            print(*(f"{db}.{t}" for db in names for t in engine.tables(db)), sep="\n", file=out)
        elif words[0] == "!describe":
            print(*(f"{c}\t{k}" for c, k in engine.describe(words[1])), sep="\n", file=out)
        elif words[0] == "!columns":
            print(*("\t".join(row) for row in engine.columns()), sep="\n", file=out)
        else:
            result = engine.sql(statement)
            if isinstance(result, int):
                print(f"{result} rows affected", file=out)
            else:
                print("\t".join(result.columns), file=out)
                for row in result.toLocalIterator():
                    print("\t".join("null" if v is None else v.hex() if isinstance(v, (bytes, bytearray)) else str(v) for v in row), file=out)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quadrille")
    parser.add_argument("-c", "--catalog", action="append", default=[], metavar="[NAME=]DIR", help="folder of tables; repeat for several databases")
    parser.add_argument("-p", "--parameters", default="", metavar="NAME=VALUE;...", help="schemaCacheExpireSeconds: how long listings are kept")
    parser.add_argument("-m", "--model", help="model file of databases and tables, JSON or YAML")
    group = parser.add_mutually_exclusive_group()
    group.add_argument("-e", "--execute", metavar="SQL")
    group.add_argument("-f", "--file")
    args = parser.parse_args(argv)
    if args.model and args.catalog:
        parser.error("a model names its own catalogs")
    stores = dict(c.split("=", 1) if "=" in c else ("store", c) for c in args.catalog)
    given = dict(p.strip().split("=", 1) for p in args.parameters.split(";") if p.strip())
    engine = connect_model(args.model) if args.model else connect(stores, cache_seconds=float(given.get("schemaCacheExpireSeconds", 600)))
    if len(stores) == 1:
        engine.use(next(iter(stores)))
    if args.execute or args.file:
        text = args.execute
        if args.file:
            with open(args.file, encoding="utf-8") as f:
                text = f.read()
        run(engine, text)
        return 0
    for line in sys.stdin:
        try:
            run(engine, line)
        except Exception as e:  # a shell goes on after a failed statement
            print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
    return 0
