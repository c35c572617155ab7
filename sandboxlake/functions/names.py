"""Target names of copied objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sandboxlake.functions.checks import is_generated_id, is_legacy_id, is_request_id


def _dots(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))


def has_three_parts(name: Column) -> Column:
    return _dots(name) == 2


def _second(name: Column) -> Column:
    """The second part of a name; NULL when it has only one."""
    return F.when(_dots(name) >= 1, F.substring_index(F.substring_index(name, ".", 2), ".", -1))


def request_number(dr_id: Column) -> Column:
    """Trailing digits of either id form; NULL for anything else."""
    return F.when(is_request_id(dr_id), _last_digits(dr_id))


def _last_digits(dr_id: Column) -> Column:
    return F.regexp_extract(dr_id, "([0-9]+)$", 1)


def request_tag(dr_id: Column) -> Column:
    """The part of target names that stands for a request, another one for every id; NULL for anything but an id.

    ``DR-<n>`` is ``<n>``.  The other form is itself in lower case, with an underscore behind each letter that was in
    lower case before, as names are compared without case.  It begins with a letter and ends with a digit, and no
    underscore follows a digit in it, so neither form can be taken for the other or run into what follows it.
    """
    own = F.lower(F.regexp_replace(dr_id, "([a-z])", "$1_"))
    return F.when(is_legacy_id(dr_id), _last_digits(dr_id)).when(is_generated_id(dr_id), own)


def schema_prefix(dr_id: Column, env: Column, tag: Column | None = None) -> Column:
    """``dr_<tag>`` for dev, ``qa_<tag>`` for qa; NULL for another environment.

    Here and below, ``tag`` is the ``request_tag`` of the id where it was worked out before, once per request.
    """
    letter = F.when(env == "dev", "dr_").when(env == "qa", "qa_")
    return F.concat(letter, request_tag(dr_id) if tag is None else tag)


def target_catalog(source_catalog: Column, env: Column, override: Column | None = None) -> Column:
    """Override if given; ``prod...`` becomes ``dev...``; any other catalog gets the environment added."""
    derived = F.when(
        source_catalog.startswith("prod"), F.concat(F.lit("dev"), F.substr(source_catalog, F.lit(5)))
    ).otherwise(F.concat(source_catalog, F.lit("_"), env))
    if override is None:
        return derived
    return F.coalesce(F.nullif(F.trim(override), F.lit("")), derived)


def target_schema(
    schema_fqn: Column, dr_id: Column, env: Column, override: Column | None = None, tag: Column | None = None
) -> Column:
    """``catalog.schema`` of the copy; NULL when the name has fewer than two parts."""
    return F.concat(
        target_catalog(catalog_of(schema_fqn), env, override),
        F.lit("."), schema_prefix(dr_id, env, tag), F.lit("_"), _second(schema_fqn),
    )


def target_object(
    object_fqn: Column, dr_id: Column, env: Column, override: Column | None = None, tag: Column | None = None
) -> Column:
    """``catalog.schema.object`` of the copy; NULL unless the name has exactly three parts."""
    schema = target_schema(object_fqn, dr_id, env, override, tag)
    return F.when(has_three_parts(object_fqn), F.concat(schema, F.lit("."), F.substring_index(object_fqn, ".", -1)))


def schema_of(object_fqn: Column) -> Column:
    """The first two parts of a name; NULL when it has only one."""
    return F.when(_dots(object_fqn) >= 1, F.substring_index(object_fqn, ".", 2))


def catalog_of(object_fqn: Column) -> Column:
    return F.substring_index(object_fqn, ".", 1)


def default_strategy(object_type: Column, override: Column | None = None) -> Column:
    """An override wins; a view is read through; everything else shares files.  Access mode plays no part."""
    plain = F.when(object_type == "view", "view").otherwise("shallow_clone")
    return plain if override is None else F.coalesce(F.nullif(override, F.lit("")), plain)


def formatted_id(prefix: str, number: Column, width: int) -> Column:
    """Prefix plus zero-padded number.  ``lpad`` alone would cut a number wider than ``width``."""
    if width < 1:
        raise ValueError("width must be at least 1")
    digits = number.cast("string")
    return F.concat(
        F.lit(prefix), F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    )


def revision_value(mode: Column, version: Column, timestamp: Column) -> Column:
    """The value that goes with a revision mode, as text; NULL for ``latest``."""
    return F.when(mode == "version", version.cast("string")).when(mode == "timestamp", timestamp)


__all__ = [
    "catalog_of", "default_strategy", "formatted_id", "request_number", "request_tag", "revision_value",
    "schema_of", "schema_prefix", "target_catalog", "target_object", "target_schema",
]
