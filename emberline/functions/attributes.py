"""Column functions over an event's attributes, a VARIANT object whose values may be of any type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The types of ``schema_of_variant`` that count as numbers; a truth value counts as 1 or 0.
NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL\(.*\))$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _at(attributes: Column | str, key: str) -> Column:
    return F.try_variant_get(_c(attributes), f"$['{key}']", "variant")


def number(attributes: Column | str, key: str) -> Column:
    """The attribute as a double where it is a number or a truth value; null for texts (``"7"`` too), lists, objects, nulls and no attribute."""
    kind = F.schema_of_variant(_at(attributes, key))
    return F.when(kind.rlike(NUMBERS), F.try_variant_get(_c(attributes), f"$['{key}']", "double"))


def text(attributes: Column | str, key: str) -> Column:
    """The attribute where it is a text; null for any other type."""
    return F.when(F.schema_of_variant(_at(attributes, key)) == "STRING", F.try_variant_get(_c(attributes), f"$['{key}']", "string"))


def values(attributes: Column | str) -> Column:
    """All attribute values, not their names, as one text with spaces between, in the order of the names; lists and objects as JSON.

    An empty text where there are no attributes or they are no object.
    """
    held = F.map_values(_c(attributes).try_cast("map<string,variant>"))
    return F.coalesce(F.array_join(F.transform(held, lambda v: v.try_cast("string")), " ", "none"), F.lit(""))


def searched(detail: Column | str, attributes: Column | str) -> Column:
    """The text that the policy test reads: an event's detail and all its attribute values."""
    return F.concat_ws(" ", _c(detail), values(attributes))
