"""Plain-value form of every Spark type, as column expressions built from the schema.

Nothing here runs Python per row: a frame is normalised by one ``select``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Longest text kept for a value without a plain form, and its mark.
LONGEST_TEXT = 4000
CUT_MARK = "…"

_AS_IS = (T.NullType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TEXT = (T.StringType, T.CharType, T.VarcharType)


def truncate_text(text: Column, width: int = LONGEST_TEXT, style: str = "cell") -> Column:
    """Cut text to ``width`` characters. ``cell`` appends the mark, ``stream`` also the total."""
    size = F.char_length(text)
    if style == "cell":
        tail = F.lit(CUT_MARK)
    elif style == "stream":
        tail = F.concat(F.lit(f"\n{CUT_MARK} [truncated, "), size.cast("string"), F.lit(" chars total]"))
    else:
        raise ValueError(f"style must be 'cell' or 'stream', not {style!r}")
    return F.when(size > width, F.concat(F.substring(text, 1, width), tail)).otherwise(text)


def iso_timestamp(ts: Column) -> Column:
    """``2024-01-31T10:00:00``, with six digits of fraction only when it is not zero."""
    text = F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))
    fraction = F.substring_index(text, ".", -1)
    padded = F.concat(F.substring_index(text, ".", 1), F.lit("."), F.rpad(fraction, 6, "0"))
    return F.when(F.contains(text, F.lit(".")), padded).otherwise(text)


def _type_is(dtype: T.DataType, name: str) -> bool:
    cls = getattr(T, name, None)  # types that only newer releases have
    return cls is not None and isinstance(dtype, cls)


def _key_text(key: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.when(key, "True").otherwise("False")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return float_text(key.cast("double"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.replace(iso_timestamp(key), F.lit("T"), F.lit(" "))
    return key.cast("string")


def plain(value: Column, dtype: T.DataType) -> Column:
    """The plain form of one column of type ``dtype``; NULL stays NULL at every depth."""
    if isinstance(dtype, _AS_IS) or isinstance(dtype, _TEXT) or isinstance(dtype, T.DoubleType):
        return value
    if isinstance(dtype, (T.FloatType, T.DecimalType)):
        return value.cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return iso_timestamp(value)
    if isinstance(dtype, T.DateType) or _type_is(dtype, "TimeType"):
        return value.cast("string")
    if isinstance(dtype, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(dtype, T.ArrayType):
        if is_plain(dtype):
            return value
        return F.transform(value, lambda item: plain(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        keyed = F.transform_keys(value, lambda k, _: _key_text(k, dtype.keyType))
        if is_plain(dtype.valueType):
            return keyed
        return F.transform_values(keyed, lambda _, v: plain(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        if is_plain(dtype):
            return value
        fields = [plain(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if _type_is(dtype, "VariantType"):
        return truncate_text(F.to_json(value))
    return truncate_text(value.cast("string"))


def is_plain(dtype: T.DataType) -> bool:
    """True when values of ``dtype`` already are in plain form."""
    if isinstance(dtype, T.ArrayType):
        return is_plain(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(is_plain(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.MapType):
        return isinstance(dtype.keyType, _TEXT) and is_plain(dtype.valueType)
    return isinstance(dtype, _AS_IS + _TEXT + (T.DoubleType,))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def normalise(df: DataFrame) -> DataFrame:
    """Every column of ``df`` in plain form, under its own name."""
    names = df.columns
    if len(set(names)) < len(names):
        # Duplicate result names are legal in SQL; address the columns by position.
        inner = [f"c{i}" for i in range(len(names))]
        renamed = normalise(df.toDF(*inner))
        return renamed.toDF(*names)
    return df.select(
        *[plain(F.col(_quoted(f.name)), f.dataType).alias(f.name) for f in df.schema.fields]
    )


def float_text(number: Column) -> Column:
    """Shortest decimal text of a double: plain notation from 1e-4 up to below 1e16.

    Spark's own cast leaves plain notation already below 1e-3 and from 1e7 on.
    """
    size = F.abs(number)
    java = number.cast("string")
    is_small = (size >= 1e-4) & (size < 1e-3)
    is_large = (size >= 1e7) & (size < 1e16)
    # 21 places after the point hold every small value, 17 + 17 every large one.
    small = F.when(is_small, number).cast("decimal(38,21)").cast("string")
    large = F.when(is_large, number).cast("decimal(38,17)").cast("string")
    spelled = F.regexp_replace(F.coalesce(small, large), "0+$", "")
    spelled = F.when(F.endswith(spelled, F.lit(".")), F.concat(spelled, F.lit("0"))).otherwise(spelled)
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), "\\.0$", "")
    power = F.substring_index(java, "E", -1)
    digits = F.replace(power, F.lit("-"), F.lit(""))
    digits = F.when(F.char_length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits)
    sign = F.when(F.startswith(power, F.lit("-")), "e-").otherwise("e+")
    return (
        F.when(number.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(number), "nan")
        .when(size == float("inf"), F.when(number > 0, "inf").otherwise("-inf"))
        .when(is_small | is_large, spelled)
        .when(F.contains(java, F.lit("E")), F.concat(mantissa, sign, digits))
        .otherwise(java)
    )
