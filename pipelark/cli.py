"""The command line: ``python -m pipelark [--catalog FILE] catalog|query|sample VERB ...``.

Help ends with status 0, any fault with status 1 and a message on standard error.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from . import engine, output
from .errors import CatalogError, QueryError
from .plans import parser as language
from .sources import sample
from .sources.catalog import Catalog, Entry

LOCAL, HOME = Path(".pipelark.json"), Path(".pipelark/catalog.json")


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise QueryError(f"{message}\nRun '{self.prog} --help' for usage.")


def catalog_path(chosen: str | None) -> Path:
    """The file named on the command line, else the one in this folder, else the one at home."""
    if chosen:
        return Path(chosen)
    return LOCAL if LOCAL.exists() else Path.home() / HOME


def _rows(rows: list[tuple[str, ...]], out) -> None:
    widths = [max(map(len, column)) + 3 for column in zip(*rows)]
    for row in rows:
        out.write("".join(c.ljust(w) for c, w in zip(row[:-1], widths)) + row[-1] + "\n")


def _add(args, out) -> None:
    path = catalog_path(args.catalog)
    if args.dir:
        entry = Entry(args.table, "file", dir=str(Path(args.dir).absolute()))
    elif args.account or args.container:
        entry = Entry(args.table, "blob", account=args.account, container=args.container)
    elif args.parquet:
        place = args.parquet if "://" in args.parquet else str(Path(args.parquet).absolute())
        entry = Entry(args.table, "parquet", path=place, time_column=args.time_column)
    else:
        raise CatalogError("specify --dir, --account and --container, or --parquet")
    catalog = Catalog.read(path)
    catalog.add(entry)
    catalog.write(path)
    out.write(f'added table "{args.table}" to {path}\n')


def _remove(args, out) -> None:
    path = catalog_path(args.catalog)
    catalog = Catalog.read(path)
    catalog.remove(args.table)
    catalog.write(path)
    out.write(f'removed table "{args.table}" from {path}\n')


def _list(args, out) -> None:
    catalog = Catalog.read(catalog_path(args.catalog))
    if not catalog:
        out.write("(no tables registered)\n")
    else:
        _rows([("TABLE", "MODE", "LOCATION"), *((e.table, e.mode, e.location) for e in catalog.values())], out)


def _show(args, out) -> None:
    entry = Catalog.read(catalog_path(args.catalog))[args.table]
    labels = {"dir": "Directory", "path": "Path", "time_column": "Time column"}
    _rows([(f"{labels.get(k, k.capitalize())}:", str(v)) for k, v in entry.written().items()], out)


def _load(args, out) -> None:
    path, source = catalog_path(args.catalog), Path(args.file)
    if not source.exists():
        raise CatalogError(f"{source} doesn't exist")
    catalog, more = Catalog.read(path), Catalog.read(source)
    catalog.merge(more)
    catalog.write(path)
    out.write(f"loaded {len(more)} tables into {path}\n")


def _export(args, out) -> None:
    text = Catalog.read(catalog_path(args.catalog)).text()
    if args.out:
        Path(args.out).write_text(text)
    else:
        out.write(text)


def _run(args, out, session: Callable[[], SparkSession]) -> None:
    if (args.query is None) == (args.file is None):
        raise QueryError("give a query or --file")
    try:
        text = args.query if args.file is None else Path(args.file).read_text()
    except OSError as fault:
        raise QueryError(f"cannot read {args.file}: {fault}") from fault
    catalog = Catalog.read(catalog_path(args.catalog))
    for table in sorted(language.parse(text).tables()):
        catalog[table]  # before Spark is started
    result = engine.prepare(session(), text, catalog, ordered=args.ordered)
    if args.out:
        with open(args.out, "w", newline="") as f:
            output.write(result, args.format or "csv", f)
    else:
        output.write(result, args.format or ("table" if out.isatty() else "csv"), out)


def _sample(args, out, session: Callable[[], SparkSession]) -> None:
    sample.write(session(), str(Path(args.dir).absolute()), args.files, args.rows, args.seed)
    out.write(f"wrote tables requests and users to {args.dir}\n")


def arguments() -> argparse.ArgumentParser:
    top = _Parser(prog="pipelark", description="Queries over time-stamped tables, run by Spark.", epilog="--catalog FILE may stand anywhere; without it .pipelark.json here, else ~/.pipelark/catalog.json is used.")
    nouns = top.add_subparsers(dest="noun", title="nouns", parser_class=_Parser)
    catalog = nouns.add_parser("catalog", help="manage table registrations")
    verbs = catalog.add_subparsers(dest="verb", title="commands", parser_class=_Parser)

    def verb(name: str, text: str, run) -> argparse.ArgumentParser:
        made = verbs.add_parser(name, help=text, description=text)
        made.set_defaults(run=run)
        return made

    add = verb("add", "register a table", _add)
    add.add_argument("table")
    add.add_argument("--dir", help="folder of CSV files")
    add.add_argument("--account", help="Azure storage account")
    add.add_argument("--container", help="its container")
    add.add_argument("--parquet", help="Parquet file or folder")
    add.add_argument("--time-column", default="timestamp", help="of a Parquet table")
    verb("remove", "deregister a table", _remove).add_argument("table")
    verb("list", "print all registered tables", _list)
    verb("show", "print one entry", _show).add_argument("table")
    verb("load", "merge the entries of a file into the catalog", _load).add_argument("file")
    verb("export", "write the catalog", _export).add_argument("--out", help="to this file")

    query = nouns.add_parser("query", help="run queries")
    verbs = query.add_subparsers(dest="verb", title="commands", parser_class=_Parser)
    run = verb("run", "run a query", _run)
    run.add_argument("query", nargs="?")
    run.add_argument("--file", help="read the query from this file")
    run.add_argument("--format", choices=sorted(output.FORMATS), help="table on a terminal and csv elsewhere if not given")
    run.add_argument("--out", help="write to this file")
    run.add_argument("--ordered", action="store_true", help="keep the order of files and lines")

    samples = nouns.add_parser("sample", help="make sample tables")
    verbs = samples.add_subparsers(dest="verb", title="commands", parser_class=_Parser)
    write = verb("write", "write the tables requests and users as folders of CSV files", _sample)
    write.add_argument("dir")
    for name, default in (("files", 14), ("rows", 500), ("seed", 42)):
        write.add_argument(f"--{name}", type=int, default=default)
    top.nouns = {"catalog": catalog, "query": query, "sample": samples}
    return top


def _without_catalog(words: list[str]) -> tuple[str | None, list[str]]:
    """The value of ``--catalog`` wherever it stands, and the other words."""
    chosen, rest, words = None, [], list(words)
    while words:
        word = words.pop(0)
        if word == "--catalog":
            if not words:
                raise QueryError("--catalog needs a path")
            chosen = words.pop(0)
        elif word.startswith("--catalog="):
            chosen = word.partition("=")[2]
        else:
            rest.append(word)
    return chosen, rest


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("pipelark").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(words: list[str] | None = None, out=None, session: Callable[[], SparkSession] = _session) -> int:
    """Run one command and return its status."""
    out = out or sys.stdout
    try:
        chosen, words = _without_catalog(sys.argv[1:] if words is None else words)
        top = arguments()
        args = top.parse_args(words)
        if not args.noun or not args.verb:
            out.write(top.nouns.get(args.noun, top).format_help())
            return 0
        args.catalog = chosen
        args.run(args, out, session) if args.run in (_run, _sample) else args.run(args, out)
    except SystemExit as ended:  # help
        return ended.code or 0
    except Exception as fault:  # whatever Spark finds while it runs is one, too
        sys.stderr.write(f"pipelark: {fault}\n")
        return 1
    return 0
