"""Generate Python modules for statement files: ``python -m sparkpact.generate --root DIR --tables DIR``.

``--schema FILE`` takes facts and types from schema SQL; without ``--tables`` its tables stand empty, which is enough to
analyze. ``--include GLOB`` picks statement files by their path under the root, ``--profile`` the client types, and
``--config FILE`` is a JSON object with any of these options, which the command line overrides.
"""

from __future__ import annotations

import argparse
import json
import re
import tempfile
from fnmatch import fnmatch
from pathlib import Path

from pyspark.sql import SparkSession

from .codecs import CONSERVATIVE, STANDARD, Profile, literal_union
from .schema import Schema, testdata_schema
from .source import SourceError
from .sources.files import MARKER, commit_outputs, find_statements, stale_outputs
from .sources.schema_sql import schema_from_sql
from .statement import Contract, Statement, analyze_all

SUFFIX = ".typed.sql"


def class_name(stem: str) -> str:
    return "".join(x[:1].upper() + x[1:] for x in re.split(r"\W|_", stem) if x)


def output_path(path: Path) -> Path:
    return path.with_name(re.sub(r"\W", "_", path.name[: -len(SUFFIX)]) + "_statement.py")


def render(contract: Contract, sql: str) -> str:
    """Module text: SQL, typed rows and parameters, metadata, and the runner that the row bounds allow."""
    name = class_name(contract.statement)
    fields = "\n".join(f"    {c.property}: {c.client_type}" for c in contract.columns) or "    pass"
    params = ", ".join(p.property + (" = None" if p.nullable else "") for p in contract.params)
    run = {"optional": "optional", "one": "one"}.get(contract.cardinality, "many")
    if contract.command != "select":
        run = "command"
    meta = {
        "access": contract.access, "cardinality": contract.cardinality, "rows": (contract.bounds.min, contract.bounds.max, contract.bounds.proof),
        "columns": [(c.name, c.type, c.null.kind) for c in contract.columns], "params": [(p.name, p.type, p.admission) for p in contract.params],
    }
    bind = ", ".join(f"{p.name}={p.property}" for p in contract.params)
    rows = {"many": f"[{name}Row(*r) for r in found]", "command": "found  # affected rows, where the source tells them"}
    shown = rows.get(run, f"None if found is None else {name}Row(*found)")
    return f'''{MARKER}
from __future__ import annotations

from datetime import date, datetime, timedelta  # noqa: F401
from decimal import Decimal  # noqa: F401
from typing import Literal, NamedTuple  # noqa: F401

SQL = {sql!r}
CONTRACT = {meta!r}


class {name}Row(NamedTuple):
{fields}


def run(statement{", *, " + params if params else ""}):
    """Rows by position, as {name}Row; ``statement``: sparkpact.statement.Statement of SQL."""
    found = statement.{run}({bind})
    return {shown}
'''


def render_catalog(spark: SparkSession, schema: Schema) -> str:
    """Module text with a row type for each declared table, and unions of allowed values."""
    out = [MARKER, "from __future__ import annotations", "", "from datetime import date, datetime  # noqa: F401", "from typing import Literal, NamedTuple", ""]
    for table, facts in sorted(schema.items()):
        if not spark.catalog.tableExists(table):
            raise SourceError(f"no table {table}")
        out.append(f"\nclass {class_name(table)}(NamedTuple):")
        for f in spark.table(table).schema.fields:
            kind = literal_union(facts.allowed[f.name]) if f.name in facts.allowed else STANDARD.result_type(f.dataType)
            out.append(f"    {f.name}: {kind}{'' if f.name in facts.not_null else ' | None'}")
        out.append("")
    return "\n".join(out)


def generate(spark: SparkSession, root: str | Path, schema: Schema, catalog: Path | None = None, include: str = "*", profile: Profile = STANDARD) -> list[Path]:
    """Analyze every statement file under ``root``, then write all modules or none. Gives the changed paths.

    Sources are read and scanned before any is analyzed; the first contract failure stops the run. ``include`` is a
    pattern of paths under the root; modules of files that it leaves out stay.
    """
    every = find_statements(root, SUFFIX)
    files = [p for p in every if fnmatch(p.relative_to(root).as_posix(), include)]
    names = [p.name[: -len(SUFFIX)] for p in files]
    targets = [output_path(p) for p in files]
    if len(set(targets)) < len(targets):
        raise SourceError("two statement files give one module")
    statements = [Statement(spark, p.read_text(encoding="utf-8"), schema, n, profile=profile) for p, n in zip(files, names)]
    contracts = analyze_all(statements)
    outputs = {t: render(c, s.sql) for t, c, s in zip(targets, contracts, statements)}
    if catalog is not None:
        outputs[catalog] = render_catalog(spark, schema)
    return commit_outputs(outputs, stale_outputs(root, {output_path(p) for p in every}))


_PROFILES = {p.name: p for p in (STANDARD, CONSERVATIVE)}


def _options(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="sparkpact.generate", description=__doc__.splitlines()[0])
    parser.add_argument("--config", help="JSON file with any of the other options")
    parser.add_argument("--root", help="folder with statement files")
    parser.add_argument("--tables", help="folder with one Parquet table a view")
    parser.add_argument("--schema", help="file of schema SQL")
    parser.add_argument("--catalog", help="module for the table row types")
    parser.add_argument("--include", help="pattern of paths under the root")
    parser.add_argument("--profile", choices=sorted(_PROFILES), help="client types")
    given = parser.parse_args(argv)
    known = {k for k in vars(given) if k != "config"}
    config = json.loads(Path(given.config).read_text(encoding="utf-8")) if given.config else {}
    if wrong := sorted(set(config) - known):
        parser.error(f"unknown options in {given.config}: {', '.join(wrong)}")
    for k in known:
        setattr(given, k, getattr(given, k) if getattr(given, k) is not None else config.get(k))
    if not given.root or not (given.tables or given.schema):
        parser.error("--root and one of --tables and --schema are needed")
    if given.profile not in (None, *_PROFILES):
        parser.error(f"no profile {given.profile}")
    return given


def main(argv: list[str] | None = None) -> None:
    args = _options(argv)
    spark = SparkSession.builder.getOrCreate()
    schema = schema_from_sql(Path(args.schema).read_text(encoding="utf-8")) if args.schema else testdata_schema()
    with tempfile.TemporaryDirectory() as empty:
        if args.tables:
            for table in schema:
                spark.read.parquet(f"{args.tables}/{table}.parquet").createOrReplaceTempView(table)
        else:
            schema.register(spark, f"file://{empty}")
        for path in generate(spark, args.root, schema, Path(args.catalog) if args.catalog else None, args.include or "*", _PROFILES[args.profile or "standard"]):
            print(path)


if __name__ == "__main__":
    main()
