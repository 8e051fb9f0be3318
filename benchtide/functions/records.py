"""Message records <-> JSON text (F-1, F-2), with the required-field,
enum and timestamp checks that decide whether a message is dead-lettered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchtide.functions.times import parse_zoned, zoned_text
from benchtide.schemas import RECORD_ENUMS, RECORDS

_TS_TYPES = (T.TimestampType, T.TimestampNTZType)


def _textify(col: Column, dtype: T.DataType) -> Column:
    """Column as it is serialised: instants as zoned text, empty lists as absent."""
    if isinstance(dtype, _TS_TYPES):
        return zoned_text(col)
    if isinstance(dtype, T.StructType):
        return F.when(col.isNotNull(), F.struct(
            *[_textify(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]))
    if isinstance(dtype, T.ArrayType):
        return F.when(F.size(col) > 0,
                      F.transform(col, lambda x: _textify(x, dtype.elementType)))
    return col


def record_json(record: str, **cols) -> Column:
    """F-1: JSON text of a record in its fixed field order.

    Fields come from same-named columns unless given as keyword columns;
    null (absent) optional parts are omitted, as are empty lists.
    """
    schema = RECORDS[record][0]
    fields = []
    for f in schema.fields:
        c = cols.get(f.name, F.col(f.name))
        fields.append(_textify(c, f.dataType).alias(f.name))
    return F.to_json(F.struct(*fields))


def _text_schema(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, _TS_TYPES):
        return T.StringType()
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _text_schema(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_text_schema(dtype.elementType))
    return dtype


def _typed(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, _TS_TYPES):
        return parse_zoned(col)
    if isinstance(dtype, T.StructType):
        return F.when(col.isNotNull(), F.struct(
            *[_typed(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]))
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _typed(x, dtype.elementType))
    return col


def is_json_object_text(text) -> Column:
    """Cheap test that (valid) JSON text holds an object at the top."""
    c = F.col(text) if isinstance(text, str) else text
    return c.rlike(r"^\s*\{")


def _kind_ok(node: Column, dtype: T.DataType) -> Column:
    """Does a present VARIANT value have the JSON kind a field type wants?
    Objects and arrays are told apart by a shallow cast, so large nested
    values (log details) are not walked."""
    if isinstance(dtype, T.StructType):
        return F.try_variant_get(node, "$", "map<string,variant>").isNotNull()
    if isinstance(dtype, T.ArrayType):
        return F.try_variant_get(node, "$", "array<variant>").isNotNull()
    kind = F.schema_of_variant(node)
    if isinstance(dtype, (T.StringType, *_TS_TYPES)):
        return kind == "STRING"
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        return (kind == "BIGINT") | kind.startswith("DECIMAL(") & kind.endswith(",0)")
    return F.lit(True)


# A message longer than this can't be checked by VARIANT (Spark's own limit).
MAX_MESSAGE_BYTES = 128 * 1024 * 1024


def _record_of(dtype: T.StructType) -> str | None:
    """Name of the record a nested struct type stands for."""
    return next((name for name, (schema, _) in RECORDS.items() if schema == dtype), None)


def _first(errors: list[Column]) -> Column:
    return F.coalesce(*errors) if errors else F.lit(None).cast("string")


def _problem(record: str, raw: Column, typed: Column, node: Column, path: str = "") -> Column:
    """The first problem of a record and of the records inside it, null if
    there is none.  ``raw`` and ``typed`` are its text and typed structs,
    ``node`` its VARIANT value; ``path`` leads the field names."""
    schema, required = RECORDS[record]
    values = {f.name: F.try_variant_get(node, f"$.{f.name}", "variant") for f in schema.fields}
    present = {k: v.isNotNull() & ~F.is_variant_null(v) for k, v in values.items()}
    # from_json turns a number or an object into text (and a string into a
    # null number); the record wants the JSON kind its field declares
    errors = [F.when(present[f.name] & ~_kind_ok(values[f.name], f.dataType),
                     F.lit(f"wrong kind for {path}{f.name}")) for f in schema.fields]
    errors += [F.when(raw[name].isNull(), F.lit(f"missing field {path}{name}")) for name in required]
    errors += [F.when(raw[f.name].isNotNull() & typed[f.name].isNull(), F.lit(f"bad timestamp {path}{f.name}"))
               for f in schema.fields if isinstance(f.dataType, _TS_TYPES)]
    for name, names in RECORD_ENUMS.get(record, {}).items():
        errors.append(F.when(raw[name].isNotNull() & ~raw[name].isin(names),
                             F.concat(F.lit(f"unknown {path}{name} "), raw[name])))
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType) and _record_of(f.dataType):
            errors.append(F.when(present[f.name], _problem(
                _record_of(f.dataType), raw[f.name], typed[f.name], values[f.name], f"{path}{f.name}.")))
        elif isinstance(f.dataType, T.ArrayType) and _record_of(f.dataType.elementType):
            errors.append(F.when(present[f.name], _element_problem(
                _record_of(f.dataType.elementType), raw[f.name], typed[f.name], values[f.name],
                f"{path}{f.name}")))
    return _first(errors)


def _element_problem(record: str, raw: Column, typed: Column, node: Column, path: str) -> Column:
    """The first problem of the elements of an array of records."""
    nodes = F.try_variant_get(node, "$", "array<variant>")
    # an element of another kind makes from_json drop its neighbours as well
    odd = F.exists(nodes, lambda n: F.try_variant_get(n, "$", "map<string,variant>").isNull())

    def one(n: Column, i: Column) -> Column:
        return _problem(record, F.get(raw, i), F.get(typed, i), n, f"{path}.")

    return F.when(odd, F.lit(f"wrong kind for {path}")).otherwise(
        F.get(F.filter(F.transform(nodes, one), lambda e: e.isNotNull()), F.lit(0)))


def decode_records(df: DataFrame, text: str, record: str, out: str = "record",
                   error: str = "error") -> DataFrame:
    """F-2 (+F-7, F-8): add ``out`` (the typed record) and ``error`` for a
    column of JSON text messages.

    ``error`` is null for a good message; otherwise the first problem found:
    invalid JSON, not a JSON object, a field of the wrong JSON kind, a missing
    required field, a bad timestamp, or an unknown enum name, in the record
    and then, with their path, in the records inside it.  A message above
    ``MAX_MESSAGE_BYTES`` has the error ``message too large``.  ``out`` is null
    whenever ``error`` is set.  The JSON is parsed once in its own projection;
    the checks then read plain columns, so no branch of the check chain parses
    it again.
    """
    schema, _ = RECORDS[record]
    raw, var, typed = "_bt_raw", "_bt_var", "_bt_typed"
    staged = df.withColumn(raw, F.from_json(F.col(text), _text_schema(schema))).withColumn(
        var, F.try_parse_json(F.col(text)))
    staged = staged.withColumn(typed, _typed(F.col(raw), schema))
    r, t, v = F.col(raw), F.col(typed), F.col(var)
    err = (F.when(F.octet_length(text) > MAX_MESSAGE_BYTES, F.lit("message too large"))
           .when(v.isNull(), F.lit("invalid JSON"))
           .when(~is_json_object_text(text), F.lit("not a JSON object"))
           .otherwise(_problem(record, r, t, v)))
    return (staged.withColumn(error, err)
            .withColumn(out, F.when(F.col(error).isNull(), t))
            .drop(raw, var, typed))
