"""Import of a document-store export in its typed wire form.

A document is ``{"name": ".../id", "fields": {field: {"stringValue": ...}}}``
with one entry per value naming its type. The wire schema is derived from the
declared schema of the table, so the parser reads only declared fields.
A value whose type differs from the declared one is converted. What is lost otherwise can
be kept: the paths of values that do not convert at any depth in a column of rejects, and
undeclared fields at any depth in a VARIANT column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.StringType()
#: Tags of plain values; numbers and flags are read as texts, so that a wrong one spoils only itself.
_PLAIN = ["stringValue", "integerValue", "doubleValue", "booleanValue", "timestampValue"]
#: Tags whose values are only seen to be there where another type is declared, as their JSON text.
_OTHER = ["referenceValue", "bytesValue", "geoPointValue"]


def _tags(**typed: T.DataType) -> T.StructType:
    """A value with one of the tags; ``typed`` ones are read, all others are texts."""
    names = [*_PLAIN, *_OTHER, "arrayValue", "mapValue"]
    return T.StructType([T.StructField(n, typed.get(n, _TEXT)) for n in names])


def _read_tags(kind: T.DataType) -> list[str]:
    """The tags whose values ``_decoded`` can read as ``kind``; the parser passes over all others."""
    if isinstance(kind, T.ArrayType):
        return ["arrayValue"]
    if isinstance(kind, T.StructType):
        return ["mapValue"]
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return ["stringValue", "integerValue", "doubleValue", "booleanValue"]
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return ["stringValue", "integerValue", "doubleValue", "timestampValue"]
    return [*_PLAIN, "referenceValue", "bytesValue"]


def _wire_type(kind: T.DataType, every: bool = True) -> T.StructType:
    """The wire form of ``kind`` with ``every`` tag, or with those alone that are read."""
    if isinstance(kind, T.ArrayType):
        tags = _tags(arrayValue=T.StructType([T.StructField("values", T.ArrayType(_wire_type(kind.elementType, every)))]))
    elif isinstance(kind, T.StructType):
        tags = _tags(mapValue=T.StructType([T.StructField("fields", _wire_fields(kind, every))]))
    else:
        tags = _tags()
    return tags if every else T.StructType([tags[n] for n in _read_tags(kind)])


def _wire_fields(schema: T.StructType, every: bool = True) -> T.StructType:
    return T.StructType([T.StructField(f.name, _wire_type(f.dataType, every)) for f in schema.fields])


def _decoded(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        entries = c["arrayValue"]["values"]
        # An array value without entries is an empty list, not a missing one.
        empty = F.when(c["arrayValue"].isNotNull(), F.array().cast(kind))
        return F.coalesce(F.transform(entries, lambda x: _decoded(x, kind.elementType)), empty)
    if isinstance(kind, T.StructType):
        inner = c["mapValue"]["fields"]
        return F.when(
            c["mapValue"].isNotNull(),
            F.struct(*[_decoded(inner[f.name], f.dataType).alias(f.name) for f in kind.fields]),
        )
    return F.coalesce(*_readings(c, kind))


def _number(text: Column, kind: T.DataType) -> Column:
    """A text as a number, null if it is none.

    A failing cast costs an exception each time, so texts that cannot be numbers (no digit, or a letter in a whole
    number) are told apart before.
    """
    some = "^[^A-Za-z]*[0-9][^A-Za-z]*$" if isinstance(kind, T.IntegralType) else "[0-9]|(?i:inf|nan)"
    return F.when(text.rlike(some), text.try_cast(kind))


def _readings(c: Column, kind: T.DataType) -> list[Column]:
    """What each type tag says as a value of ``kind``; one tag at most is set."""
    text, whole = c["stringValue"], c["integerValue"]
    real = _number(c["doubleValue"], T.DoubleType())
    if isinstance(kind, (T.TimestampType, T.DateType)):
        # Numbers are epoch milliseconds.
        millis = F.coalesce(_number(whole, T.LongType()), real.try_cast("bigint"))
        instants = [F.try_to_timestamp(c["timestampValue"]), F.try_to_timestamp(text), F.timestamp_millis(millis)]
        if isinstance(kind, T.DateType):
            return [F.try_to_date(text), *[x.cast("date") for x in instants]]
        return instants
    flag = c["booleanValue"].try_cast("boolean")
    if isinstance(kind, T.NumericType):
        return [_number(whole, kind), real.try_cast(kind), _number(F.trim(text), kind), flag.cast("int").try_cast(kind)]
    if isinstance(kind, T.BooleanType):
        return [flag, text.try_cast("boolean"), (_number(whole, T.DoubleType()) != 0), real != 0]
    # References and bytes are texts on the wire.
    return [text, whole, real.cast("string"), flag.cast("string"), c["timestampValue"], c["referenceValue"], c["bytesValue"]]


def _given(c: Column, *but: str) -> Column:
    """True where a value has any tag but the given ones."""
    return reduce(lambda a, b: a | b, [c[f].isNotNull() for f in _tags().names if f not in but])


def _unread(c: Column, kind: T.DataType, path: Column) -> Column:
    """The paths below ``path`` whose values have none of the declared kind, as a list."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.ArrayType):
        entries = F.transform(c["arrayValue"]["values"], lambda x, i: _unread(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.when(_given(c, "arrayValue"), F.array(path)).otherwise(F.coalesce(F.flatten(entries), none))
    if isinstance(kind, T.StructType):
        inner = c["mapValue"]["fields"]
        fields = [_unread(inner[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields]
        return F.when(_given(c, "mapValue"), F.array(path)).otherwise(F.when(c["mapValue"].isNotNull(), F.concat(none, *fields)).otherwise(none))
    return F.when(_given(c) & _decoded(c, kind).isNull(), F.array(path)).otherwise(none)


def _undeclared(fields: Column, schema: T.StructType, prefix: str = "") -> list[Column]:
    """Maps from path to wire value of the fields that ``schema`` does not name, at any depth of declared records."""
    here = F.map_filter(fields, lambda k, _: ~k.isin(*schema.names))
    named = F.transform_keys(here, lambda k, _: F.concat(F.lit(prefix), k)) if prefix else here
    out = [F.coalesce(named, F.create_map().cast("map<string,variant>"))]
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            inner = F.try_variant_get(fields[f.name], "$.mapValue.fields", "map<string,variant>")
            out += _undeclared(inner, f.dataType, f"{prefix}{f.name}.")
    return out


def decode_documents(raw: DataFrame, schema: T.StructType, column: str = "value", id_field: str = "id", rejects: str | None = None, rescue: str | None = None) -> DataFrame:
    """Plain rows of wire documents, with the id taken from the document name.

    Values are converted from the type they came in. ``rejects`` names a column for the paths (``a``, ``a.b``,
    ``a[2].b``) of values, at any depth, that are there but cannot be converted; ``$`` stands for a text that is no document.
    ``rescue`` names a VARIANT column for undeclared fields, an object from path to the value in wire form, null if
    there are none; entries of lists of records are not searched for undeclared fields.
    """
    wire = T.StructType([T.StructField("name", _TEXT), T.StructField("fields", _wire_fields(schema, every=rejects is not None))])
    parsed = {"d": F.from_json(column, wire), "text": F.col(column)}
    if rescue:
        parsed["all"] = F.from_json(column, "fields map<string, variant>")
    doc = raw.select(*[c.alias(n) for n, c in parsed.items()])
    if rescue:  # a step of its own, as Spark evaluates expressions with lambdas again at each use
        doc = doc.withColumn("extra", F.map_concat(*_undeclared(F.col("all.fields"), schema)))
    added = []
    if rejects:
        whole = F.when(F.col("text").isNotNull() & F.col("d.name").isNull() & F.col("d.fields").isNull(), F.array(F.lit("$")))
        each = [_unread(F.col(f"d.fields.`{f.name}`"), f.dataType, F.lit(f.name)) for f in schema.fields]
        added.append(F.coalesce(whole, F.concat(*each)).alias(rejects))
    if rescue:
        added.append(F.when(F.size("extra") > 0, F.to_variant_object("extra")).alias(rescue))
    return doc.select(
        F.element_at(F.split("d.name", "/"), -1).alias(id_field),
        *[_decoded(F.col(f"d.fields.`{f.name}`"), f.dataType).alias(f.name) for f in schema.fields], *added,
    )


def read_export(spark, path: str, schema: T.StructType, id_field: str = "id", rejects: str | None = None, rescue: str | None = None) -> DataFrame:
    """A newline-delimited export, one wire document per line."""
    return decode_documents(spark.read.text(path), schema, "value", id_field, rejects, rescue)
