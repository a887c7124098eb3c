"""Fields of service responses, from their JSON text.  A body that is no JSON, or lacks a field, gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SNAP = "snappedPoints array<map<string,string>>"
PLACE = "results array<struct<address_components:array<struct<long_name:string,types:array<string>>>>>"


def snapped_place(body: Column) -> Column:
    """The place id of the first point whose original index is 0, else of the first point.

    An index that is present but no number, null among these, counts as 0.  A point that has index 0 and no place id
    gives null: there is no further fallback.
    """
    points = F.from_json(body, SNAP)["snappedPoints"]
    zero = F.filter(points, lambda p: F.map_contains_key(p, "originalIndex") & (F.coalesce(F.floor(p["originalIndex"].try_cast("double")).cast("long"), F.lit(0)) == 0))
    return F.when(F.size(zero) > 0, F.get(zero, F.lit(0))["placeId"]).otherwise(F.get(points, F.lit(0))["placeId"])


def has_type(component: Column, kind: str) -> Column:
    return F.coalesce(F.array_contains(component["types"], kind), F.lit(False))


def route_component(body: Column) -> Column:
    """The first address component of the first result that is a route."""
    first = F.get(F.from_json(body, PLACE)["results"], F.lit(0))["address_components"]
    return F.get(F.filter(first, lambda c: has_type(c, "route")), F.lit(0))


def route_name(body: Column) -> Column:
    return route_component(body)["long_name"]


def route_without_name(body: Column) -> Column:
    """Whether the route component lacks its name: callers report this as an error, not as an unknown road."""
    found = route_component(body)
    return F.coalesce(found.isNotNull() & found["long_name"].isNull(), F.lit(False))
