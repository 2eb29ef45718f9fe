"""Document filter (dict) -> Spark ``Column``.

Covers the forms a document-store user writes: ``{}``, field equality,
several fields (AND), dotted paths into structs, and the operators
``$eq $ne $gt $gte $lt $lte $in $nin $and $or $nor $not $exists $regex
$options $size $all $elemMatch $mod $type``.

Semantics kept from the store:
* every positive predicate is false (never NULL) on a null or missing
  field, so ``$ne``/``$nin``/``$not``/``$nor`` match null and missing;
* ``{"f": None}`` matches null or missing;
* comparisons are type-bracketed: a numeric literal compares with a text
  column through ``try_cast(.. as double)``; a text literal never matches a
  numeric column;
* equality on an array column matches any element;
* unknown operators raise.

The result is a single Column, so Catalyst pushes what it can into the scan.
"""

from __future__ import annotations

import numbers
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

KNOWN_OPS = {"$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$not", "$exists", "$regex",
             "$options", "$size", "$all", "$elemMatch", "$mod", "$type"}


class _Field:
    """A resolved path: a Column and its type, or missing (``col`` None)."""

    def __init__(self, col: Column | None, dtype: T.DataType | None):
        self.col, self.dtype = col, dtype

    @property
    def missing(self) -> bool:
        return self.col is None


def _resolve(schema: T.StructType, path: str, base: Column | None = None) -> _Field:
    if base is None and path in schema.fieldNames():
        return _Field(F.col(f"`{path}`"), schema[path].dataType)
    dtype: T.DataType = schema
    col = base
    for part in path.split("."):
        if isinstance(dtype, T.StructType) and part in dtype.fieldNames():
            col = F.col(f"`{part}`") if col is None else col.getField(part)
            dtype = dtype[part].dataType
        else:
            return _Field(None, None)
    return _Field(col, dtype)


def _is_num(v) -> bool:
    return isinstance(v, numbers.Number) and not isinstance(v, bool)


def _false() -> Column:
    return F.lit(False)


def _safe(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _scalar_cmp(f: _Field, op: str, v) -> Column:
    """Type-bracketed comparison of one field with one literal."""
    if f.missing or v is None:
        return _false()
    dt = f.dtype
    if isinstance(dt, T.ArrayType):
        elem = _Field(None, dt.elementType)
        return _safe(F.exists(f.col, lambda x: _scalar_cmp(_Field(x, elem.dtype), op, v)))
    col = f.col
    if _is_num(v):
        if isinstance(dt, _NUMERIC):
            lhs = col
        elif isinstance(dt, T.StringType):
            lhs = col.try_cast("double")
        else:
            return _false()
    elif isinstance(v, bool):
        if isinstance(dt, T.BooleanType):
            lhs = col
        elif isinstance(dt, T.StringType):
            lhs, v = col, ("true" if v else "false")
        else:
            return _false()
    elif isinstance(v, str):
        if isinstance(dt, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)):
            lhs = col
        else:
            return _false()
    else:
        raise ValueError(f"unsupported literal {v!r}")
    lit = F.lit(v)
    c = {"$eq": lhs == lit, "$gt": lhs > lit, "$gte": lhs >= lit,
         "$lt": lhs < lit, "$lte": lhs <= lit}[op]
    return _safe(c)


def _eq(f: _Field, v) -> Column:
    if v is None:
        return F.lit(True) if f.missing else f.col.isNull()
    if isinstance(v, (list, tuple)):
        if f.missing:
            return _false()
        return _safe(f.col == F.lit(list(v)) if isinstance(f.dtype, T.ArrayType) else F.lit(False))
    return _scalar_cmp(f, "$eq", v)


_TYPE_CHECK = {
    "string": lambda dt: isinstance(dt, T.StringType),
    "double": lambda dt: isinstance(dt, (T.DoubleType, T.FloatType)),
    "int": lambda dt: isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType)),
    "long": lambda dt: isinstance(dt, T.LongType),
    "decimal": lambda dt: isinstance(dt, T.DecimalType),
    "number": lambda dt: isinstance(dt, _NUMERIC),
    "bool": lambda dt: isinstance(dt, T.BooleanType),
    "date": lambda dt: isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)),
    "array": lambda dt: isinstance(dt, T.ArrayType),
    "object": lambda dt: isinstance(dt, (T.StructType, T.MapType)),
}


def _ops(f: _Field, spec: dict) -> Column:
    unknown = set(spec) - KNOWN_OPS
    if unknown:
        raise ValueError(f"unknown filter operator(s): {sorted(unknown)}")
    parts = []
    for op, v in spec.items():
        if op == "$options":
            continue
        if op == "$eq":
            parts.append(_eq(f, v))
        elif op == "$ne":
            parts.append(~_eq(f, v))
        elif op in ("$gt", "$gte", "$lt", "$lte"):
            parts.append(_scalar_cmp(f, op, v))
        elif op == "$in":
            parts.append(reduce(lambda a, b: a | b, [_eq(f, x) for x in v], _false()))
        elif op == "$nin":
            parts.append(~reduce(lambda a, b: a | b, [_eq(f, x) for x in v], _false()))
        elif op == "$not":
            if not isinstance(v, dict):
                raise ValueError("$not needs an operator expression")
            parts.append(~_ops(f, v))
        elif op == "$exists":
            parts.append((F.lit(False) if f.missing else f.col.isNotNull()) if v
                         else (F.lit(True) if f.missing else f.col.isNull()))
        elif op == "$regex":
            flags = spec.get("$options", "")
            pattern = ("(?" + "".join(ch for ch in flags if ch in "imsx") + ")" if flags else "") + v
            if f.missing or not isinstance(f.dtype, T.StringType):
                parts.append(_false())
            else:
                parts.append(_safe(f.col.rlike(pattern)))
        elif op == "$size":
            parts.append(_false() if f.missing or not isinstance(f.dtype, T.ArrayType)
                         else _safe(F.when(f.col.isNotNull(), F.size(f.col) == int(v))))
        elif op == "$all":
            if f.missing or not isinstance(f.dtype, T.ArrayType):
                parts.append(_false())
            else:
                parts.append(reduce(lambda a, b: a & b, [_safe(F.array_contains(f.col, x)) for x in v],
                                    F.lit(True)))
        elif op == "$elemMatch":
            if f.missing or not isinstance(f.dtype, T.ArrayType):
                parts.append(_false())
            else:
                et = f.dtype.elementType
                parts.append(_safe(F.exists(f.col, lambda x: _elem(x, et, v))))
        elif op == "$mod":
            d, r = v
            if f.missing or not isinstance(f.dtype, _NUMERIC):
                parts.append(_false())
            else:
                parts.append(_safe((f.col.cast("long") % int(d)) == int(r)))
        elif op == "$type":
            names = v if isinstance(v, (list, tuple)) else [v]
            checks = []
            for n in names:
                if n == "null":
                    checks.append(F.lit(True) if f.missing else f.col.isNull())
                elif n not in _TYPE_CHECK:
                    raise ValueError(f"unknown $type {n!r}")
                elif not f.missing and _TYPE_CHECK[n](f.dtype):
                    checks.append(f.col.isNotNull())
            parts.append(reduce(lambda a, b: a | b, checks, _false()))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _elem(x: Column, et: T.DataType, spec: dict) -> Column:
    if all(k.startswith("$") for k in spec):
        return _ops(_Field(x, et), spec)
    if not isinstance(et, T.StructType):
        return _false()
    return _compile(spec, et, base=x)


def _compile(filt: dict, schema: T.StructType, base: Column | None = None) -> Column:
    parts = []
    for key, v in filt.items():
        if key in ("$and", "$or", "$nor"):
            subs = [_compile(s, schema, base) for s in v]
            if not subs:
                raise ValueError(f"{key} needs a non-empty list")
            if key == "$and":
                parts.append(reduce(lambda a, b: a & b, subs))
            elif key == "$or":
                parts.append(reduce(lambda a, b: a | b, subs))
            else:
                parts.append(~reduce(lambda a, b: a | b, subs))
            continue
        if key.startswith("$"):
            raise ValueError(f"unknown top-level operator {key}")
        f = _resolve(schema, key, base) if base is None else _resolve_from(schema, key, base)
        if isinstance(v, dict) and v and all(k.startswith("$") for k in v):
            parts.append(_ops(f, v))
        else:
            parts.append(_eq(f, v))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _resolve_from(schema: T.StructType, path: str, base: Column) -> _Field:
    return _resolve(schema, path, base=base)


def compile_filter(filt: dict | None, schema: T.StructType) -> Column:
    """Compile a filter dict against a schema into one boolean Column."""
    return _compile(filt or {}, schema)


def query_documents(df: DataFrame, filt: dict | None = None, limit: int | None = 100,
                    id_col: str = "_id") -> DataFrame:
    """Filter a collection, drop the internal id, (unordered) limit: 100 as in the
    store's call, None for every match."""
    out = df.where(compile_filter(filt, df.schema))
    if id_col in out.columns:
        out = out.drop(id_col)
    return out.limit(limit) if limit is not None else out
