"""JSON records under a closed schema, compiled to one column expression.

A schema is a Spark ``StructType`` of any depth. Objects are closed: every key must be a
field, every field must be there, and no key may come twice, at every level and inside
arrays. A field's metadata narrows it:

* ``optional``: the key may be missing (a key with NULL is allowed by ``nullable`` alone),
* ``pattern`` (strings, matched whole), ``choices`` (strings and numbers),
* ``low`` and ``high``: bounds of a number, of a string's length in code points, or of an
  array's number of items.

Maps are objects with any keys. The first fault in reading order of the schema gives the
code and its path.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelock.functions.ladder import at_most, bind, holds

FAULT = "struct<code:string,path:string>"
WHOLE_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _fault(code: str, path: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), path.alias("path"))


def _first(faults: Sequence[Column]) -> Column:
    return F.coalesce(*faults, F.lit(None).cast(FAULT))


def _below(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit("."), name)


def _value_rules(value: Column, rules: Mapping, measured: Column) -> Column:
    """Bounds of ``measured`` and the choices of ``value``."""
    good = F.lit(True)
    if "low" in rules:
        good = good & holds(measured >= rules["low"])
    if "high" in rules:
        good = good & holds(measured <= rules["high"])
    if "choices" in rules:
        good = good & holds(value.isin(list(rules["choices"])))
    return good


def _leaf(value: Column, kind: T.DataType, rules: Mapping, path: Column) -> Column:
    found = F.schema_of_variant(value)
    wrong = _fault("RECORD_TYPE_INVALID", path)
    if isinstance(kind, T.StringType):
        text = F.try_variant_get(value, "$", "string")
        good = _value_rules(text, rules, F.char_length(text))
        if "pattern" in rules:
            good = good & holds(text.rlike(rf"\A(?:{rules['pattern']})\z"))
        fits = found == "STRING"
    elif isinstance(kind, T.BooleanType):
        fits, good = found == "BOOLEAN", F.lit(True)
    elif type(kind) in WHOLE_BITS:
        number = F.try_variant_get(value, "$", "bigint")
        most = 1 << (WHOLE_BITS[type(kind)] - 1)
        fits = (found == "BIGINT") & holds(number.between(-most, most - 1))
        good = _value_rules(number, rules, number)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        number = F.try_variant_get(value, "$", "double")
        fits = found.isin("BIGINT", "DOUBLE", "FLOAT") | found.startswith("DECIMAL")
        good = _value_rules(number, rules, number)
    else:
        raise TypeError(f"no JSON value is a {kind.simpleString()}")
    return F.when(~holds(fits), wrong).when(~good, _fault("RECORD_VALUE_INVALID", path))


def _object(value: Column, kind: T.StructType, path: Column) -> Column:
    names = F.array(*[F.lit(name) for name in kind.names])
    needed = F.array(*[F.lit(field.name) for field in kind.fields if not field.metadata.get("optional")]).cast("array<string>")

    def members(found: Column) -> Column:
        keys = F.map_keys(found)
        unknown, missing = F.array_except(keys, names.cast("array<string>")), F.array_except(needed, keys)
        faults = [
            F.when(found.isNull(), _fault("RECORD_TYPE_INVALID", path)),
            F.when(F.size(unknown) > 0, _fault("RECORD_UNKNOWN_KEY", _below(path, F.array_min(unknown)))),
            F.when(F.size(missing) > 0, _fault("RECORD_MISSING_KEY", _below(path, F.get(missing, F.lit(0))))),
        ]
        for field in kind.fields:
            member = F.try_element_at(found, F.lit(field.name))
            faults.append(F.when(member.isNotNull(), value_fault(member, field, _below(path, F.lit(field.name)))))
        return _first(faults)

    return bind(F.try_variant_get(value, "$", "map<string,variant>"), members)


def _items(faults: Column) -> Column:
    return F.get(F.filter(faults, lambda fault: fault.isNotNull()), F.lit(0))


def value_fault(value: Column, field: T.StructField, path: Column) -> Column:
    """The first fault of a variant under a field, as ``struct<code, path>``, or NULL."""
    kind, rules = field.dataType, field.metadata or {}
    if isinstance(kind, T.StructType):
        body = _object(value, kind, path)
    elif isinstance(kind, T.ArrayType):
        item = T.StructField("item", kind.elementType, kind.containsNull, rules.get("items") or {})

        def of_items(found: Column) -> Column:
            inner = F.transform(found, lambda x, i: value_fault(x, item, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            return _first(
                [
                    F.when(found.isNull(), _fault("RECORD_TYPE_INVALID", path)),
                    F.when(~_value_rules(F.lit(None), rules, F.size(found)), _fault("RECORD_VALUE_INVALID", path)),
                    _items(inner),
                ]
            )

        body = bind(F.try_variant_get(value, "$", "array<variant>"), of_items)
    elif isinstance(kind, T.MapType):
        item = T.StructField("value", kind.valueType, kind.valueContainsNull, rules.get("items") or {})

        def of_values(found: Column) -> Column:
            entries = F.transform(F.map_entries(found), lambda e: value_fault(e["value"], item, _below(path, e["key"])))
            return _first([F.when(found.isNull(), _fault("RECORD_TYPE_INVALID", path)), _items(entries)])

        body = bind(F.try_variant_get(value, "$", "map<string,variant>"), of_values)
    else:
        body = _leaf(value, kind, rules, path)
    null_fault = F.lit(None).cast(FAULT) if field.nullable else _fault("RECORD_TYPE_INVALID", path)
    return F.when(F.is_variant_null(value), null_fault).otherwise(body)


def record_fault(text: Column, schema: T.StructType, max_bytes: int | None = None) -> Column:
    """What is wrong with a JSON text under a closed schema: ``struct<code, path>``, or NULL.

    A parser may stop after the first value, so a text must also be one value inside an
    array and inside an object; what follows a value cannot end both.
    """
    root = F.lit("$")
    is_json = F.get_json_object(text, "$").isNotNull()
    repeated = F.try_parse_json(text).isNull()
    in_array = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    in_object = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit("}")))
    alone = (F.size(in_array) == 1) & in_object.isNotNull()
    whole = T.StructField("record", schema, False)

    def parsed(values: Column) -> Column:
        return value_fault(F.get(values, F.lit(0)), whole, root)

    return (
        F.when(~at_most(F.octet_length(text), max_bytes) & text.isNotNull(), _fault("RECORD_TOO_LARGE", root))
        .when(~holds(is_json), _fault("RECORD_NOT_JSON", root))
        .when(repeated, _fault("RECORD_REPEATED_KEY", root))
        .when(~holds(alone), _fault("RECORD_NOT_JSON", root))
        .otherwise(bind(in_array, parsed))
    )


def _with_required(schema: T.StructType, required: Sequence[str]) -> T.StructType:
    return T.StructType(
        [
            T.StructField(f.name, f.dataType, f.nullable, {**(f.metadata or {}), "optional": f.name not in required})
            for f in schema.fields
        ]
    )


def closed_records(
    lines: DataFrame,
    text: str,
    schema: T.StructType,
    required: Sequence[str] | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Parse JSON text under a closed schema.

    Adds ``record`` (NULL when rejected), ``failure_code`` and ``failure_path``. Codes:
    RECORD_TOO_LARGE, RECORD_NOT_JSON (also a NULL text, and text after the value),
    RECORD_REPEATED_KEY, RECORD_TYPE_INVALID, RECORD_UNKNOWN_KEY, RECORD_MISSING_KEY,
    RECORD_VALUE_INVALID. ``required`` replaces the ``optional`` marks of the top level.
    """
    closed = schema if required is None else _with_required(schema, required)
    staged = lines.withColumn("_fault", record_fault(F.col(text), closed, max_bytes))
    failed = F.col("_fault").isNotNull()
    return staged.withColumns(
        {
            "failure_code": F.col("_fault.code"),
            "failure_path": F.col("_fault.path"),
            "record": F.when(~failed, F.from_json(F.col(text), schema)),
        }
    ).drop("_fault")


def read_closed_records(
    spark: SparkSession, path: str, schema: T.StructType, **options: object
) -> DataFrame:
    """Read JSON lines from ``path`` through :func:`closed_records`."""
    return closed_records(spark.read.text(path), "value", schema, **options)
