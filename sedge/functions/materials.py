"""Materials of models as JSON columns, rewritten field by field. Fields are variants, so that what isn't named is kept
as it is, at any depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: texture slots of a material and of its surface, and the extension of unlit surfaces.
SLOTS = ("normalTexture", "occlusionTexture", "emissiveTexture")
SURFACE_SLOTS = ("baseColorTexture", "metallicRoughnessTexture")
SURFACE, EXTENSIONS, UNLIT = "pbrMetallicRoughness", "extensions", "KHR_materials_unlit"
FIELDS = "map<string,variant>"


def _or_none(found: Column) -> Column:
    return F.coalesce(found, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))


def fields(json: Column) -> Column:
    """The fields of a JSON object; none for null or another value."""
    return _or_none(F.from_json(json, FIELDS))


def inner(material: Column, name: str) -> Column:
    """The fields of an object inside; none if there is no such object."""
    return _or_none(F.try_variant_get(material[name], "$", FIELDS))


def put(object_: Column, **values: Column) -> Column:
    """The object with fields set to JSON values."""
    kept = F.map_filter(object_, lambda k, _: ~k.isin(*values))
    return F.map_concat(kept, F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.parse_json(v))]))


def without(object_: Column, *names: str) -> Column:
    return F.map_filter(object_, lambda k, _: ~k.isin(*names))


def has(object_: Column, name: str) -> Column:
    return F.array_contains(F.map_keys(object_), name)


def _plain(color: tuple) -> dict[str, Column]:
    return {"baseColorFactor": F.lit(f"[{', '.join(map(str, color))}]"), "metallicFactor": F.lit("0"), "roughnessFactor": F.lit("1")}


def solid(json: Column, color: tuple) -> Column:
    """One colour without textures; of the rest only alpha mode and cutoff stay, and whether both sides show (yes, if not said)."""
    material = fields(json)
    kept = F.map_filter(material, lambda k, _: k.isin("doubleSided", "alphaMode", "alphaCutoff"))
    kept = F.when(has(kept, "doubleSided"), kept).otherwise(put(kept, doubleSided=F.lit("true")))
    none = F.map_filter(material, lambda k, _: F.lit(False))
    return F.to_json(put(kept, **{SURFACE: F.to_json(put(none, **_plain(color)))}))


def unlit(json: Column) -> Column:
    """The material with the unlit extension added to those that it has."""
    material = fields(json)
    return F.to_json(put(material, **{EXTENSIONS: F.to_json(put(inner(material, EXTENSIONS), **{UNLIT: F.lit("{}")}))}))


def opaque(json: Column, color: tuple, *, keep_sides: bool = False, keep_textures: bool = False, lit: bool = True) -> Column:
    """An opaque material of one colour: no alpha mode or cutoff, one side, no textures, and the unlit extension if not lit."""
    material = without(fields(json), "alphaMode", "alphaCutoff")
    surface = inner(material, SURFACE)
    if not keep_textures:
        material, surface = without(material, *SLOTS), without(surface, *SURFACE_SLOTS)
    changes = {SURFACE: F.to_json(put(surface, **_plain(color)))}
    if not keep_sides:
        changes["doubleSided"] = F.lit("false")
    if not lit:
        changes[EXTENSIONS] = F.to_json(put(inner(material, EXTENSIONS), **{UNLIT: F.lit("{}")}))
    return F.to_json(put(material, **changes))


def textures_removed(json: Column) -> Column:
    """How many texture slots a material fills."""
    material = fields(json)
    surface = inner(material, SURFACE)
    return sum((has(material, k).cast("long") for k in SLOTS), F.lit(0).cast("long")) + sum(has(surface, k).cast("long") for k in SURFACE_SLOTS)
