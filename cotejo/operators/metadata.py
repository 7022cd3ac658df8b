"""Columns from event metadata of any shape, by the semi-structured VARIANT type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def shape_of(df: DataFrame, variant: Column) -> T.StructType:
    """The fields that the objects of a column have, merged over all rows; rows that hold no object count for nothing.

    One short row comes to the driver: as many fields as there are distinct keys."""
    objects = df.select(variant.alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    shape = objects.agg(F.schema_of_variant_agg("v")).first()[0]
    if not shape.startswith("OBJECT"):
        return T.StructType()
    return T.DataType.fromDDL(shape.replace("OBJECT<", "STRUCT<"))


def _field(variant: Column, name: str, kind: str) -> Column:
    """A path cannot escape quotes, so a key that has both kinds is taken from a map of texts."""
    quote = "'" if "'" not in name else '"'
    if quote in name:
        return F.from_json(F.to_json(variant), "map<string,string>")[name].try_cast(kind)
    return F.try_variant_get(variant, f"$[{quote}{name}{quote}]", kind)


def variant_columns(df: DataFrame, json: str, prefix: str = "", keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``json``, but with a column for each key that its objects have, typed as all rows agree (text where they
    differ or nest). ``keys`` limits the columns. Text that is no JSON object, NULL and missing keys give NULL."""
    parsed = df.withColumn("_variant", F.try_parse_json(json))
    shape = shape_of(parsed, F.col("_variant"))
    out = {}
    for field in shape:
        if keys and field.name not in keys:
            continue
        plain = not isinstance(field.dataType, (T.StructType, T.ArrayType, T.VariantType, T.NullType))
        kind = field.dataType.simpleString() if plain else "string"
        out[prefix + field.name] = _field(F.col("_variant"), field.name, kind)
    return parsed.withColumns(out).drop("_variant", json) if out else parsed.drop("_variant", json)
