"""Range values as structs (lower, upper, lower_inc, upper_inc, empty); a null bound is infinite."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def make_range(lower: Column, upper: Column, lower_inc: bool = True, upper_inc: bool = False) -> Column:
    closed = F.lit(lower_inc and upper_inc)
    empty = F.coalesce((lower > upper) | ((lower == upper) & ~closed), F.lit(False))
    bound = lambda c: F.when(~empty, c)
    return F.struct(bound(lower).alias("lower"), bound(upper).alias("upper"), (F.lit(lower_inc) & ~empty & lower.isNotNull()).alias("lower_inc"), (F.lit(upper_inc) & ~empty & upper.isNotNull()).alias("upper_inc"), empty.alias("empty"))


def lower_bound(r: Column) -> Column:
    return r["lower"]


def upper_bound(r: Column) -> Column:
    return r["upper"]


def is_empty(r: Column) -> Column:
    return r["empty"]


def lower_infinite(r: Column) -> Column:
    return ~r["empty"] & r["lower"].isNull()


def upper_infinite(r: Column) -> Column:
    return ~r["empty"] & r["upper"].isNull()


def _before(a: Column, b: Column) -> Column:
    """a ends where b begins, or earlier."""
    touch = (a["upper"] == b["lower"]) & ~(a["upper_inc"] & b["lower_inc"])
    return F.coalesce((a["upper"] < b["lower"]) | touch, F.lit(False))


def strictly_left(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & _before(a, b)


def overlaps(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & ~_before(a, b) & ~_before(b, a)


def adjacent(a: Column, b: Column) -> Column:
    meet = lambda x, y: F.coalesce((x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (meet(a, b) | meet(b, a))


def contains_value(r: Column, v: Column) -> Column:
    low = r["lower"].isNull() | (v > r["lower"]) | (r["lower_inc"] & (v == r["lower"]))
    high = r["upper"].isNull() | (v < r["upper"]) | (r["upper_inc"] & (v == r["upper"]))
    return ~r["empty"] & low & high


def contains_range(a: Column, b: Column) -> Column:
    low = a["lower"].isNull() | F.coalesce((b["lower"] > a["lower"]) | ((b["lower"] == a["lower"]) & (a["lower_inc"] | ~b["lower_inc"])), F.lit(False))
    high = a["upper"].isNull() | F.coalesce((b["upper"] < a["upper"]) | ((b["upper"] == a["upper"]) & (a["upper_inc"] | ~b["upper_inc"])), F.lit(False))
    return b["empty"] | (~a["empty"] & low & high)


def _low(a: Column) -> Column:
    """Sortable lower bound: infinite first, then inclusive before exclusive."""
    return F.struct(a["lower"].isNotNull().alias("finite"), a["lower"].alias("at"), (~a["lower_inc"]).alias("open"))


def _high(a: Column) -> Column:
    """Sortable upper bound: exclusive before inclusive, infinite last."""
    return F.struct(a["upper"].isNull().alias("infinite"), a["upper"].alias("at"), a["upper_inc"].alias("closed"))


def before(a: Column, b: Column) -> Column:
    """The order of ranges: empty ones first, then by lower bound, then by upper bound."""
    key = lambda r: F.struct((~r["empty"]).alias("e"), F.when(~r["empty"], _low(r)).alias("l"), F.when(~r["empty"], _high(r)).alias("h"))
    return key(a) < key(b)


def overleft(a: Column, b: Column) -> Column:
    """a does not reach beyond b on the right."""
    return ~a["empty"] & ~b["empty"] & (_high(a) <= _high(b))


def overright(a: Column, b: Column) -> Column:
    """a does not reach beyond b on the left."""
    return ~a["empty"] & ~b["empty"] & (_low(a) >= _low(b))


def _pick(a: Column, b: Column, low_of_a: Column, high_of_a: Column) -> Column:
    """The lower bound of one range with the upper bound of another; empty where they leave nothing between."""
    low = lambda f: F.when(low_of_a, a[f]).otherwise(b[f])
    high = lambda f: F.when(high_of_a, a[f]).otherwise(b[f])
    return _range(low("lower"), high("upper"), low("lower_inc"), high("upper_inc"))


def _range(lower: Column, upper: Column, lower_inc: Column, upper_inc: Column) -> Column:
    empty = F.coalesce((lower > upper) | ((lower == upper) & ~(lower_inc & upper_inc)), F.lit(False))
    bound = lambda c: F.when(~empty, c)
    return F.struct(bound(lower).alias("lower"), bound(upper).alias("upper"), (lower_inc & ~empty & lower.isNotNull()).alias("lower_inc"), (upper_inc & ~empty & upper.isNotNull()).alias("upper_inc"), empty.alias("empty"))


def intersection(a: Column, b: Column) -> Column:
    """Values in both ranges, with bounds of any kind."""
    both = _pick(a, b, _low(a) >= _low(b), _high(a) <= _high(b))
    return F.when(a["empty"] | b["empty"] | ~overlaps(a, b), _empty(a)).otherwise(both)


def merge(a: Column, b: Column) -> Column:
    """The smallest range that holds both; a gap between them is filled."""
    whole = _pick(a, b, _low(a) <= _low(b), _high(a) >= _high(b))
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(whole)


def union(a: Column, b: Column) -> Column:
    """A multirange (array of disjoint ranges in order) of the values in either."""
    one = overlaps(a, b) | adjacent(a, b)
    return multirange(F.when(a["empty"] | b["empty"] | one, F.array(merge(a, b))).when(before(a, b), F.array(a, b)).otherwise(F.array(b, a)))


def minus(a: Column, b: Column) -> Column:
    """A multirange of the values in a and not in b: what lies left of b and what lies right of it."""
    left = _range(a["lower"], b["lower"], a["lower_inc"], ~b["lower_inc"])
    right = _range(b["upper"], a["upper"], ~b["upper_inc"], a["upper_inc"])
    has_left, has_right = b["lower"].isNotNull() & (_low(a) < _low(b)), b["upper"].isNotNull() & (_high(a) > _high(b))
    cut = F.array(F.when(has_left, left).otherwise(_empty(a)), F.when(has_right, right).otherwise(_empty(a)))
    return multirange(F.when(~overlaps(a, b), F.array(a)).otherwise(cut))


def multirange(ranges: Column) -> Column:
    """Without its empty ranges."""
    return F.filter(ranges, lambda r: ~r["empty"])


def multirange_contains(m: Column, v: Column) -> Column:
    return F.exists(m, lambda r: contains_value(r, v))


def multirange_overlaps(m: Column, r: Column) -> Column:
    return F.exists(m, lambda x: overlaps(x, r))


def multirange_intersection(m: Column, r: Column) -> Column:
    return multirange(F.transform(m, lambda x: intersection(x, r)))


def _empty(a: Column) -> Column:
    nothing = F.when(F.lit(False), a["lower"])
    return F.struct(nothing.alias("lower"), nothing.alias("upper"), F.lit(False).alias("lower_inc"), F.lit(False).alias("upper_inc"), F.lit(True).alias("empty"))


def merge_islands(df: DataFrame, keys: list[str], lower: str, upper: str) -> DataFrame:
    """Range aggregate: the fewest half-open ranges that cover the same values, for each key."""
    w = Window.partitionBy(*keys).orderBy(lower, upper)
    reach = F.max(upper).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col(lower) > reach), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(lower).alias(lower), F.max(upper).alias(upper)).drop("_island")
