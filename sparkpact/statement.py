"""Statements with contracts: analyze without running, then run with the cardinality enforced."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, Row, SparkSession

from .codecs import STANDARD, Profile, literal_union
from .contracts import dml
from .contracts.analysis import Analysis, access, bounds
from .contracts.lattice import Bounds, Nullability, combine_admission
from .plans.tree import Node, analyzed, mark_parameters
from .runtime import row_count
from .schema import Schema
from .source import SourceError, named_parameters, parse_source, unique_names


class ContractError(ValueError):
    pass


@dataclass(frozen=True)
class ColumnContract:
    name: str
    property: str
    type: str
    client_type: str
    null: Nullability
    source: tuple
    labels: tuple[str, ...] | None
    shape: object


@dataclass(frozen=True)
class ParamContract:
    name: str
    property: str
    type: str
    nullable: bool
    admission: str
    labels: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Contract:
    statement: str
    command: str
    access: str
    access_reasons: list[str]
    bounds: Bounds
    columns: list[ColumnContract]
    params: list[ParamContract]

    @property
    def cardinality(self) -> str:
        return self.bounds.cardinality


_UTILITY = re.compile(r"\s*(SHOW|EXPLAIN|DESCRIBE|DESC|SET|RESET|CACHE|UNCACHE|REFRESH|CREATE|DROP|ALTER|TRUNCATE|ANALYZE|USE)\b", re.I)
_COMMAND = re.compile(r"\s*(INSERT|UPDATE|DELETE|MERGE|CALL)\b", re.I)
_SENTINEL = 910_000_000


class Statement:
    """One SQL statement with ``:name`` parameters over temporary views."""

    def __init__(self, spark: SparkSession, text: str, schema: Schema, name: str = "statement", naming: str = "preserve", profile: Profile = STANDARD):
        self.spark, self.schema, self.name, self.naming, self.profile = spark, schema, name, naming, profile
        self.source = parse_source(text)
        self.sql = self.source.sql
        self.parameters = named_parameters(self.sql)
        if m := _UTILITY.match(self.sql):
            raise ContractError(f"{name}: {m[1].upper()} is not a statement with a contract")
        unknown = [p for p in self.source.nullable if p not in self.parameters]
        if unknown:
            raise SourceError(f"@nullable names unknown parameters: {', '.join(unknown)}")

    # ------------------------------------------------------------ analysis

    def _plan(self, args: dict) -> Node:
        return analyzed(self.spark, self.sql, args)

    def _parameter_types(self) -> dict[str, tuple[str, str]]:
        """name -> (type, admission). A parameter bound to an untyped NULL shows the type that its use casts it to;
        one that can't be NULL at all (LIMIT, OFFSET, sample sizes) is an integer and rejects NULL."""
        args: dict = dict.fromkeys(self.parameters)
        rejects = set()
        for _ in range(len(self.parameters) + 1):
            try:
                self._plan(args)
                break
            except (AnalysisException, ParseException) as error:
                for p in self.parameters:
                    if args[p] is None:
                        try:
                            self._plan(args | {p: 1})
                            args[p] = 1
                            rejects.add(p)
                            break
                        except (AnalysisException, ParseException):
                            continue
                else:
                    # several must be set at once
                    try:
                        self._plan(dict.fromkeys(self.parameters, 1))
                    except (AnalysisException, ParseException):
                        raise error from None
                    args = dict.fromkeys(self.parameters, 1)
                    rejects = {p for p in self.parameters if self._fails(args | {p: None})}
                    args = {p: 1 if p in rejects else None for p in self.parameters}
        out = {}
        for p in self.parameters:
            if p in rejects:
                out[p] = ("int", "rejects")
                continue
            with_null, without = _null_casts(self._plan(args)), None
            try:
                without = _null_casts(self._plan(args | {p: _SENTINEL}))
            except (AnalysisException, ParseException):
                without = _null_casts(self._plan(args | {p: "x"}))
            kinds = sorted({k for k in with_null if with_null.count(k) > without.count(k)})
            if len(kinds) > 1:
                raise ContractError(f"{self.name}: :{p} is used as {' and '.join(kinds)}")
            out[p] = (kinds[0] if kinds else "void", "accepts" if kinds else "unknown")
        return out

    def _sentinels(self, kinds: dict[str, tuple[str, str]]) -> list[dict]:
        """Two sets of values, different for every parameter. One whose type nothing tells is a string, or where no string
        will do (beside numbers in a list of values), a number."""
        for untyped in ("string", "int"):
            out = [{p: _typed_sentinel(untyped if kinds[p][0] == "void" else kinds[p][0], k, turn) for k, p in enumerate(self.parameters)} for turn in (0, 1)]
            if untyped == "int" or not self._fails(out[0]):
                return out

    def _fails(self, args: dict) -> bool:
        try:
            self._plan(args)
            return False
        except (AnalysisException, ParseException):
            return True

    def analyze(self) -> Contract:
        if m := _COMMAND.match(self.sql):
            reason = "procedureCall" if m[1].upper() == "CALL" else f"definiteDml({m[1].lower()})"
            contract = Contract(self.name, m[1].lower(), "write", [reason], Bounds(0, 0, "no_result_columns"), [], self._command_parameters(m[1].upper()))
            self._gates(contract)
            return contract
        kinds = self._parameter_types()
        sentinels, others = self._sentinels(kinds)
        root = self._plan(sentinels)
        if self.parameters:
            nulls = {p: sentinels[p] if kinds[p][1] == "rejects" else None for p in self.parameters}
            mark_parameters(root, self._plan(others), None if self._fails(nulls) else self._plan(nulls))
        analysis = Analysis(root, self.schema)
        fields = self.spark.sql(self.sql, args=sentinels).schema.fields
        found = analysis.columns()
        names = unique_names([f.name for f in fields], self.naming)
        columns = []
        for k, f in enumerate(fields):
            c = found[k] if len(found) == len(fields) else None
            null = c.null if c else Nullability("unknown", "unresolved_output")
            labels = tuple(c.labels) if c and c.labels else None
            client = literal_union(labels) if labels else self.profile.result_type(f.dataType)
            columns.append(ColumnContract(f.name, names[k], f.dataType.simpleString(), client + (" | None" if null.allows_null else ""), null, c.source if c else ("unknown", None), labels, c.shape if c else None))
        verdict, reasons = access(root)
        props = unique_names(self.parameters, self.naming)
        params = [ParamContract(p, props[k], kinds[p][0], p in self.source.nullable, combine_admission([kinds[p][1]])) for k, p in enumerate(self.parameters)]
        contract = Contract(self.name, "select", verdict, reasons, bounds(root, analysis), columns, params)
        self._gates(contract)
        return contract

    def _command_parameters(self, verb: str) -> list[ParamContract]:
        """Types, labels and NULL admission of a command's parameters, from the columns that they are written to or
        compared with. A type or a set of labels counts only where all those columns agree on it."""
        props = unique_names(self.parameters, self.naming)
        if verb == "CALL":
            return [ParamContract(p, props[k], "unknown", p in self.source.nullable, "unknown") for k, p in enumerate(self.parameters)]
        table = dml.target(self.spark, self.sql)
        kinds = self.schema.column_types(self.spark, table)
        found = dml.assignments(self.spark, self.sql, {table: list(kinds)})
        compared = dml.comparisons(self.spark, self.sql)
        admitted = dml.admissions(self.spark, self.sql, self.schema, {table: list(kinds)})
        facts = self.schema.get(table)
        out = []
        for k, p in enumerate(self.parameters):
            written = [a.column for a in found if a.param == p and a.value_preserving]
            types = {kinds.get(c, "unknown") for c in [*written, *(c for q, c in compared if q == p)]}
            kind = types.pop() if len(types) == 1 else "unknown"
            labels = {facts.allowed.get(c) for c in written if kinds.get(c) == kind} if facts else set()
            only = labels.pop() if len(labels) == 1 else None
            out.append(ParamContract(p, props[k], kind, p in self.source.nullable, admitted.get(p, "unknown"), only))
        return out

    def _gates(self, contract: Contract) -> None:
        if self.source.access == "read" and contract.access != "read":
            raise ContractError(f"{self.name}: @access read, but: {', '.join(contract.access_reasons)}")
        for p in contract.params:
            if p.nullable and p.admission != "accepts":
                raise ContractError(f"{self.name}: @nullable {p.name}, but NULL is not proved to be accepted ({p.admission})")
        have = {c.name: c.type for c in contract.columns}
        for name, kind in self.source.columns.items():
            if name not in have:
                raise ContractError(f"{self.name}: @column {name}: no such column")
            if kind is not None and kind != have[name]:
                raise ContractError(f"{self.name}: @column {name} {kind}: it is {have[name]}")

    # ------------------------------------------------------------ execution

    def dataframe(self, **params) -> DataFrame:
        missing, extra = [p for p in self.parameters if p not in params], [p for p in params if p not in self.parameters]
        if missing or extra:
            raise SourceError(f"{self.name}: missing {missing}, unknown {extra}")
        return self.spark.sql(self.sql, args=params)

    def many(self, **params) -> list[Row]:
        return self.dataframe(**params).collect()

    def optional(self, **params) -> Row | None:
        rows = self.dataframe(**params).limit(2).collect()  # two rows tell more than one
        if len(rows) > 1:
            raise ContractError(f"{self.name}: more than one row")
        return rows[0] if rows else None

    def command(self, **params) -> int | None:
        """Run a statement for its effect; gives the affected rows where the table's source tells them."""
        rows = self.dataframe(**params).collect()
        return row_count(rows[0][0]) if len(rows) == 1 and rows[0].__fields__[0].startswith("num_affected") else None

    def one(self, **params) -> Row:
        row = self.optional(**params)
        if row is None:
            raise ContractError(f"{self.name}: no row")
        return row


def _typed_sentinel(kind: str, k: int, turn: int):
    """A value of a type; the two turns differ for every type."""
    import datetime
    from decimal import Decimal

    n = _SENTINEL + 10_000_000 * turn + k
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return {"bigint": n, "int": n, "smallint": 31_000 - 1000 * turn + k, "tinyint": 100 - 50 * turn + k % 27}[kind]
    if kind in ("double", "float"):
        return float(n)
    if kind.startswith("decimal"):
        return Decimal(1 + turn)
    if kind == "boolean":
        return turn == 0
    if kind == "date":
        return datetime.date(2000 + turn, 1, 1 + k % 28)
    if kind.startswith("timestamp"):
        return datetime.datetime(2000 + turn, 1, 1, 0, 0, k % 60)
    return f"\x01parameter-{turn}-{k}"


def _null_casts(root: Node) -> list[str]:
    out = []
    for n in root.walk():
        if n.kind == "Literal" and n.fields.get("value") is None and n.fields.get("dataType") not in ("void", None):
            out.append(str(n.fields["dataType"]))  # an untyped NULL that analysis gave a type
        elif n.kind == "Cast" and n.children and n.children[0].kind == "Literal" and n.children[0].fields.get("value") is None and n.children[0].fields.get("dataType") == "void":
            kind = n.fields.get("dataType")
            out.append({"long": "bigint", "integer": "int", "short": "smallint", "byte": "tinyint"}.get(kind, kind) if isinstance(kind, str) else str(kind))
    return out


def analyze_all(statements: list[Statement]) -> list[Contract]:
    """Contracts of all statements; recoverable failures are gathered in order, a single one keeps its own form."""
    out, failures = [], []
    for s in statements:
        try:
            out.append(s.analyze())
        except (ContractError, SourceError, AnalysisException, ParseException) as error:
            failures.append((s.name, error))
    if len(failures) == 1:
        raise failures[0][1]
    if failures:
        raise ContractError("\n".join(f"{name}: {str(error).splitlines()[0]}" for name, error in failures))
    return out


def contract_rows(spark: SparkSession, contracts: list[Contract]) -> DataFrame:
    """One row a result column."""
    kinds = "statement string, command string, access string, access_reasons array<string>, cardinality string, rows_min long, rows_max long, rows_proof string, col_ordinal int, col_name string, col_type string, null_kind string, null_why string, source_kind string, source_name string, check_labels array<string>, json_shape string"
    rows = [
        (c.statement, c.command, c.access, c.access_reasons, c.cardinality, c.bounds.min, c.bounds.max, c.bounds.proof, k, x.name, x.type, x.null.kind, x.null.why, x.source[0], x.source[1], list(x.labels) if x.labels else None, repr(x.shape) if x.shape else None)
        for c in contracts
        for k, x in enumerate(c.columns)
    ]
    return spark.createDataFrame(rows, kinds)
