"""Maps with a default for missing keys, as Column expressions over ``MapType``."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def empty(key: str = "string", value: str = "double") -> Column:
    return F.create_map().cast(f"map<{key},{value}>")


def lookup(m, key, default) -> Column:
    return F.coalesce(F.try_element_at(_c(m), key if isinstance(key, Column) else F.lit(key)), F.lit(default))


def from_entries(entries) -> Column:
    """A map of ``array<struct<key, value>>``; of equal keys the last one counts."""
    placed = F.transform(_c(entries), lambda x, i: F.struct(x["key"].alias("key"), i.alias("i"), x["value"].alias("value")))
    ordered = F.array_sort(placed, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(a["i"] - b["i"]))
    # of neighbours with equal keys only the last is not followed by its key
    runs = F.zip_with(ordered, F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), lambda x, y: F.when(y.isNull() | (x["key"] != y["key"]), x))
    return F.map_from_entries(F.transform(F.filter(runs, lambda x: x.isNotNull()), lambda x: F.struct(x["key"], x["value"])))


def keys(m) -> Column:
    return F.map_keys(_c(m))


def elems(m) -> Column:
    return F.map_values(_c(m))


def map_values(m, f: Callable[[Column], Column]) -> Column:
    """Applies ``f`` to the values; the default is left to the caller."""
    return F.transform_values(_c(m), lambda _, v: f(v))


def fold(m, start: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Folds the values (not the default) in the order of their keys."""
    ordered = F.transform(F.array_sort(F.map_entries(_c(m))), lambda e: e["value"])
    return F.aggregate(ordered, start, f)


def union_with(a, b, f: Callable[[Column, Column], Column], default_a, default_b) -> Column:
    """Over the keys of both, ``f`` of the two values, each side's default where it has none."""
    return F.map_zip_with(_c(a), _c(b), lambda _, x, y: f(F.coalesce(x, F.lit(default_a)), F.coalesce(y, F.lit(default_b))))
