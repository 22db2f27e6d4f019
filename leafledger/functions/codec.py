"""Tagged JSON: types that JSON lacks are marked in the key, as in ``when<!D>``.

``D`` is a timestamp in epoch milliseconds, ``S`` a set (array without repetitions),
``M`` a map, ``E`` an error (name, message, stack), ``R`` a pattern, ``P`` a pointer: the
path, with slashes, of an object that contains this place.  With a schema both directions
are column expressions.  A row cannot contain itself, so nothing is encoded as a pointer;
a decoded one becomes a copy of what it points to, as deep as the schema goes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "message", "stack")])


def _tag(kind: T.DataType) -> str:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "<!D>"
    if isinstance(kind, T.MapType):
        return "<!M>"
    if kind == ERROR:
        return "<!E>"
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.TimestampType, T.TimestampNTZType)):
        return "<![D]>"
    return ""


def _millis(c: Column, kind: T.DataType) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def _encoded(c: Column, kind: T.DataType) -> Column:
    if kind == ERROR:
        return F.array(c["name"], c["message"], c["stack"])
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_encoded(c[f.name], f.dataType).alias(f.name + _tag(f.dataType)) for f in kind.fields]))
    if _tag(kind) == "<!D>":
        return _millis(c, kind)
    if _tag(kind) == "<![D]>":
        return F.transform(c, lambda x: _millis(x, kind.elementType))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(c, lambda x: _encoded(x, kind.elementType))
    return c


def encode(schema: T.StructType) -> Column:
    """JSON string column of the whole row; null fields are left out."""
    return F.to_json(F.struct(*[_encoded(F.col(f"`{f.name}`"), f.dataType).alias(f.name + _tag(f.dataType)) for f in schema.fields]))


def _pointed(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind != ERROR


def _stored(kind: T.DataType) -> T.DataType:
    if kind == ERROR:
        return T.ArrayType(T.StringType())
    if isinstance(kind, T.StructType):
        pointers = [T.StructField(f.name + "<!P>", T.StringType()) for f in kind.fields if _pointed(f.dataType)]
        return T.StructType([T.StructField(f.name + _tag(f.dataType), _stored(f.dataType)) for f in kind.fields] + pointers)
    if _tag(kind) == "<!D>":
        return T.LongType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(T.LongType() if _tag(kind) else _stored(kind.elementType))
    return kind


def _at(body: Column, pointer: Column, kind: T.DataType) -> Column:
    """What a pointer names in the whole JSON text."""
    path = F.concat(F.lit("$['"), F.replace(pointer, F.lit("/"), F.lit("']['")), F.lit("']"))
    return _decoded(F.from_json(F.call_function("get_json_object", body, path), _stored(kind)), kind, body)


def _decoded(c: Column, kind: T.DataType, body: Column) -> Column:
    if kind == ERROR:
        return F.when(c.isNotNull(), F.struct(*[F.get(c, F.lit(i)).alias(n) for i, n in enumerate(("name", "message", "stack"))]))
    if isinstance(kind, T.StructType):
        own = []
        for f in kind.fields:
            value = _decoded(c[f.name + _tag(f.dataType)], f.dataType, body)
            if _pointed(f.dataType):
                pointer = c[f.name + "<!P>"]
                value = F.when(pointer.isNotNull(), _at(body, pointer, f.dataType)).otherwise(value)
            own.append(value.alias(f.name))
        return F.when(c.isNotNull(), F.struct(*own))
    if _tag(kind) == "<!D>":
        return F.timestamp_millis(c).cast(kind)
    if _tag(kind) == "<![D]>":
        return F.transform(c, lambda x: F.timestamp_millis(x).cast(kind.elementType))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(c, lambda x: _decoded(x, kind.elementType, body))
    return c


def decode(body: Column, schema: T.StructType) -> Column:
    """Struct of ``schema`` from a tagged JSON string."""
    return _decoded(F.from_json(body, _stored(schema)), schema, body)
