"""Client types of Spark types, with a chain of hooks that may replace them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import types as T

Hook = Callable[[T.DataType, Callable[[], str]], str | None]

_SCALARS = {
    T.BooleanType: "bool", T.BinaryType: "bytes", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int",
    T.FloatType: "float", T.DoubleType: "float", T.DecimalType: "Decimal", T.StringType: "str", T.DateType: "date",
    T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.DayTimeIntervalType: "timedelta", T.NullType: "None",
}


@dataclass(frozen=True)
class Profile:
    """conservative: ``object`` for every type; standard: the types that rows really hold."""

    name: str
    hooks: tuple[Hook, ...] = ()

    def result_type(self, kind: T.DataType) -> str:
        return self._resolve(kind, 0)

    def _resolve(self, kind: T.DataType, at: int) -> str:
        if at < len(self.hooks):
            own = self.hooks[at](kind, lambda: self._resolve(kind, at + 1))
            return own if own is not None else self._resolve(kind, at + 1)
        if self.name == "conservative":
            return "object"
        if isinstance(kind, T.ArrayType):
            return f"list[{self._resolve(kind.elementType, 0)}{' | None' if kind.containsNull else ''}]"
        if isinstance(kind, T.MapType):
            return f"dict[{self._resolve(kind.keyType, 0)}, {self._resolve(kind.valueType, 0)}{' | None' if kind.valueContainsNull else ''}]"
        if isinstance(kind, T.StructType):
            return "Row"
        for base, name in _SCALARS.items():
            if isinstance(kind, base):
                return name
        return "object"


CONSERVATIVE, STANDARD = Profile("conservative"), Profile("standard")


def literal_union(labels: tuple[str, ...]) -> str:
    return f"Literal[{', '.join(map(repr, labels))}]"
