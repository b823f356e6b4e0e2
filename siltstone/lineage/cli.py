"""``python -m siltstone.lineage.cli analyze|batch``."""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys

from . import render
from .api import LineageAnalyzer
from .dialects import DIALECTS
from .logs import setup
from .validation import dialect_error, path_error


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siltstone-lineage", description="Provenance of SQL statements.")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("analyze", help="one statement")
    one.add_argument("--sql")
    one.add_argument("--file")
    one.add_argument("--table-only", action="store_true")
    one.add_argument("--column-only", action="store_true")
    many = sub.add_parser("batch", help="each file of a folder")
    many.add_argument("folder")
    many.add_argument("--pattern", default="*.sql")
    many.add_argument("--output-dir")
    for s in (one, many):
        s.add_argument("--dialect", default="trino", help=", ".join(DIALECTS))
        s.add_argument("--format", default="console", choices=("console", "json", "compact"))
        s.add_argument("--color", action="store_true", help="colours in console reports")
    one.add_argument("--output")
    args = p.parse_args(argv)
    setup()
    if why := dialect_error(args.dialect):
        return fail(why)
    return analyze(args) if args.command == "analyze" else batch(args)


def fail(why: str) -> int:
    print(f"Error: {why}", file=sys.stderr)
    return 1


def text(doc: dict, args, tables: bool = True, columns: bool = True) -> str:
    if args.format == "compact":
        return render.compact(doc)
    if args.format == "console":
        return render.console(doc, tables, columns, args.color)
    if tables and columns:
        return render.as_json(doc)
    return render.as_json({k: doc[k] for k in ("sql", "dialect", "table_lineage" if tables else "column_lineage", "errors", "warnings")})


def analyze(args) -> int:
    if bool(args.sql) == bool(args.file):
        return fail("give either --sql or --file")
    if args.file and (why := path_error(args.file)):
        return fail(why)
    analyzer = LineageAnalyzer(args.dialect)
    result = analyzer.analyze_file(args.file) if args.file else analyzer.analyze(args.sql)
    out = text(result.to_dict(), args, not args.column_only, not args.table_only)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(out)
    else:
        print(out)
    return int(result.has_errors())


def batch(args) -> int:
    analyzer, failed = LineageAnalyzer(args.dialect), 0
    files = sorted(glob.glob(os.path.join(args.folder, args.pattern)))
    if not files:
        return fail(f"no file matches {args.pattern} in {args.folder}")
    for path in files:
        result = analyzer.analyze_file(path)
        failed += result.has_errors()
        if args.output_dir:
            os.makedirs(args.output_dir, exist_ok=True)
            name = os.path.splitext(os.path.basename(path))[0]
            with open(os.path.join(args.output_dir, f"{name}_lineage.json"), "w", encoding="utf-8") as f:
                json.dump(result.to_dict(), f, indent=2, ensure_ascii=False, default=str)
        else:
            print(f"{path}\n{text(result.to_dict(), args)}\n")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
