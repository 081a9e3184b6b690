"""Three-state facts. A proof is established or reported as unknown, never guessed."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Nullability:
    kind: str  # nonNull, nullable, unknown
    why: str

    @property
    def allows_null(self) -> bool:
        return self.kind != "nonNull"


def non_null(why: str) -> Nullability:
    return Nullability("nonNull", why)


def nullable(why: str) -> Nullability:
    return Nullability("nullable", why)


def unknown(why: str) -> Nullability:
    return Nullability("unknown", why)


def union(values: list[Nullability]) -> Nullability:
    """A value from one of several sources: any nullable wins, then any unknown."""
    if not values:
        return unknown("no_source")
    for kind in ("nullable", "unknown"):
        for v in values:
            if v.kind == kind:
                return v
    return values[0]


def meet(values: list[Nullability]) -> Nullability:
    """A value that all sources hold: any nonNull proves it."""
    for v in values:
        if v.kind == "nonNull":
            return v
    if values and all(v.kind == "nullable" for v in values):
        return values[0]
    return unknown("intersection")


@dataclass(frozen=True)
class Bounds:
    min: int
    max: int | None
    proof: str

    @property
    def cardinality(self) -> str:
        return {(0, 0): "none", (1, 1): "one", (0, 1): "optional"}.get((self.min, self.max), "many")


#: rejects, then unknown, then accepts
def combine_admission(values: list[str]) -> str:
    for v in ("rejects", "unknown"):
        if v in values:
            return v
    return "accepts"


# ---------------------------------------------------------------- JSON shapes: ("object", fields), ("array", element), ("scalar", type), ("stringLiteral", value), ("union", shapes), ("opaque",)

OPAQUE = ("opaque",)


def _alternatives(shapes: list[tuple]) -> list[tuple]:
    flat = [y for x in shapes for y in (x[1] if x[0] == "union" else (x,))]
    return list(dict.fromkeys(flat))


def join_shapes(shapes: list[tuple | None]) -> tuple | None:
    """The shape of a value from one of several sources; None stands for a source that only gives NULL."""
    found = _alternatives([x for x in shapes if x is not None])
    if OPAQUE in found:
        return OPAQUE
    return None if not found else found[0] if len(found) == 1 else ("union", tuple(found))


def meet_shapes(shapes: list[tuple]) -> tuple:
    """The shape of a value that all sources hold: an opaque one adds nothing."""
    found = _alternatives([x for x in shapes if x != OPAQUE])
    return OPAQUE if not found else found[0] if len(found) == 1 else ("union", tuple(found))
