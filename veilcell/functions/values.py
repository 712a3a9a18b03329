"""Typed values: parsing from text, numeric codes, and decoding back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type suffixes, boolean spellings, and seconds from 1800-01-01 to 1970-01-01 (UTC).
TYPE_NAMES = {"b": "boolean", "i": "integer", "r": "real", "s": "string", "t": "timestamp"}
TRUE_TEXTS = ("1", "t", "true")
FALSE_TEXTS = ("0", "f", "false")
EPOCH_OFFSET = 5364662400.0
LOOSE_TIMESTAMPS = ("yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd",
                    "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy")

SPARK_TYPES = {
    "boolean": T.BooleanType(), "integer": T.LongType(), "real": T.DoubleType(),
    "string": T.StringType(), "timestamp": T.TimestampType(),
}


def kind_of(data_type: T.DataType) -> str:
    """Value kind of a Spark column type."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "real"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    raise ValueError(f"unsupported column type: {data_type.simpleString()}")


def parse_boolean(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin(*TRUE_TEXTS), True).when(word.isin(*FALSE_TEXTS), False)


def parse_integer(text: Column) -> Column:
    word = F.trim(text)
    return F.when(word.rlike(r"^[+-]?[0-9]+$"), word.try_cast("bigint"))


def parse_real(text: Column) -> Column:
    """Decimal or exponent form, thousands separators allowed before the point."""
    word = F.trim(text)
    shape = r"^[+-]?([0-9][0-9,]*(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    number = F.regexp_replace(word, ",", "").try_cast("double")
    return F.when(word.rlike(shape) & ~F.abs(number).isin(float("inf")), number)


def parse_timestamp(text: Column) -> Column:
    word = F.trim(text)
    forms = [F.try_to_timestamp(word)]
    forms += [F.try_to_timestamp(word, F.lit(form)) for form in LOOSE_TIMESTAMPS]
    return F.coalesce(*forms)


def parse_text(kind: str, text: Column) -> Column:
    """Parse by declared kind; what does not parse becomes NULL, except strings."""
    if kind == "string":
        return text
    parsers = {"boolean": parse_boolean, "integer": parse_integer,
               "real": parse_real, "timestamp": parse_timestamp}
    if kind not in parsers:
        raise ValueError(f"unsupported kind: {kind}")
    return parsers[kind](text)


def value_text(kind: str, value: Column) -> Column:
    """Text form of a value as used in seeds."""
    if kind == "boolean":
        text = F.when(value, "t").otherwise("f")
    elif kind == "timestamp":
        text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "NULL").otherwise(text)


def list_text(texts: Column) -> Column:
    """Bracketed list of single-quoted texts."""
    quoted = F.transform(texts, lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def numeric_code(kind: str, value: Column) -> Column:
    """Number standing for a value in the cell trees (strings use dictionary ranks instead)."""
    if kind == "boolean":
        return F.when(value, 1.0).when(~value, 0.0)
    if kind == "integer":
        return value.cast("double")
    if kind == "real":
        number = value.cast("double")
        return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    if kind == "timestamp":
        return F.unix_micros(value.cast("timestamp")) / 1e6 + EPOCH_OFFSET
    raise ValueError(f"no direct code for kind: {kind}")


def decode_number(kind: str, code: Column) -> Column:
    """Numeric code as it reads after decoding: booleans and integers lose their fraction."""
    if kind == "boolean":
        return F.when(code >= 0.5, 1.0).otherwise(0.0)
    if kind in ("integer", "string"):
        return code.cast("bigint").cast("double")
    return code


def decode_value(kind: str, code: Column, data_type: T.DataType) -> Column:
    """Typed value of a drawn code; integers truncate toward zero."""
    if kind == "boolean":
        return code >= 0.5
    if kind == "integer":
        return code.cast("bigint").cast(data_type)
    if kind == "real":
        return code.cast(data_type)
    if kind == "timestamp":
        moment = F.timestamp_micros(((code - EPOCH_OFFSET) * 1e6).cast("bigint"))
        return moment.cast(data_type)
    raise ValueError(f"no direct decoding for kind: {kind}")


def common_prefix(left: Column, right: Column) -> Column:
    """Longest shared start of two texts, compared character by character."""
    same = F.zip_with(F.split(left, ""), F.split(right, ""), lambda a, b: a.eqNullSafe(b))
    first_difference = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first_difference == 0, left).otherwise(F.substring(left, F.lit(1), first_difference - 1))


def generalized_text(low: Column, high: Column, code: Column) -> Column:
    """Text for a string range: the shared prefix, a star, and a number from the range."""
    return F.concat(common_prefix(low, high), F.lit("*"), code.cast("bigint").cast("string"))
