"""Flattening of place-details responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Component types in order of precedence: a component counts for the first type it carries.
COMPONENT_TYPES = (
    "postal_town",
    "administrative_area_level_2",
    "administrative_area_level_1",
    "country",
)


def address_component(components: Column, wanted: str) -> Column:
    """Name of the last component whose highest-precedence type is ``wanted``; null if there is none."""
    stronger = COMPONENT_TYPES[: COMPONENT_TYPES.index(wanted)]

    def matches(component: Column) -> Column:
        hit = F.array_contains(component["types"], wanted)
        for other in stronger:
            hit = hit & ~F.array_contains(component["types"], other)
        return hit

    return F.try_element_at(F.filter(components, matches), F.lit(-1))["long_name"]
