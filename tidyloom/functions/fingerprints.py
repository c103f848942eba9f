"""Order-insensitive content fingerprints of values and records.

The canonical text of a record is compact ASCII JSON: ``[["name",value],...]`` with the names sorted
at every level and every list sorted.  Its SHA-256 (or SHA-512), in URL-safe base64, is the
fingerprint.  Everything is a native column expression but the text of variants, which follows each value
instead of a type and is written by Arrow tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import column
from .text import float_text, iso_text

_TEXT = (T.StringType, T.CharType, T.VarcharType)
# What JSON writes with a letter or a second mark; the backslash has to come first.
_ESCAPES = (
    ("\\", "\\\\"),
    ('"', '\\"'),
    ("\n", "\\n"),
    ("\r", "\\r"),
    ("\t", "\\t"),
    ("\b", "\\b"),
    ("\f", "\\f"),
)


def get_hash_str(
    col: Column, dtype: T.DataType, skip: Iterable[str] = (), sha512: bool = False
) -> Column:
    """Fingerprint of one column's value; a null has a fingerprint too."""
    return _digest(canonical_json(col, dtype, skip), sha512)


def row_hash_str(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    skip: Iterable[str] = (),
    sha512: bool = False,
) -> Column:
    """Fingerprint of a row; ``skip`` drops names at the top and inside nested records."""
    return _digest(record_json(df, columns, skip), sha512)


def record_json(
    df: DataFrame, columns: Iterable[str] | None = None, skip: Iterable[str] = ()
) -> Column:
    """The canonical text of a row."""
    skip = frozenset(skip)
    names = sorted(set(df.columns if columns is None else columns) - skip)
    pairs = [(name, column(name), df.schema[name].dataType) for name in names]
    return _pair_list([(name, _ordered(col, dtype, skip), dtype) for name, col, dtype in pairs], skip)


def canonical_json(col: Column, dtype: T.DataType, skip: Iterable[str] = ()) -> Column:
    """The canonical text of one value."""
    skip = frozenset(skip)
    return _json(_ordered(col, dtype, skip), dtype, skip)


def _digest(text: Column, sha512: bool) -> Column:
    encoded = F.base64(F.unhex(F.sha2(text, 512 if sha512 else 256)))
    # Line breaks, which some releases put into long base64 texts, are dropped.
    return F.translate(encoded, "+/\r\n", "-_")


# Step 1: sort.  Lists are sorted as values, not as texts, so that 10 comes after 9.


def _is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def _kept(dtype: T.StructType, skip: frozenset) -> list[T.StructField]:
    return sorted((field for field in dtype if field.name not in skip), key=lambda f: f.name)


def _holds_variant(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_variant(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _holds_variant(dtype.keyType) or _holds_variant(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_holds_variant(field.dataType) for field in dtype)
    return isinstance(dtype, T.VariantType)


def _is_variant(dtype: T.DataType) -> bool:
    """A variant, or lists and maps of variants: their texts are written by value."""
    if isinstance(dtype, T.ArrayType):
        return _is_variant(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return isinstance(dtype.keyType, _TEXT) and _is_variant(dtype.valueType)
    return isinstance(dtype, T.VariantType)


def _ordered(col: Column, dtype: T.DataType, skip: frozenset) -> Column:
    if _is_variant(dtype):
        return _by_value(F.to_json(col), skip)
    if isinstance(dtype, (T.ArrayType, T.MapType)) and _holds_variant(dtype):
        raise ValueError(f"variants inside records of a list have no fingerprint text: {dtype.simpleString()}")
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        if _is_nested(inner):
            col = F.transform(col, lambda item: _ordered(item, inner, skip))
        return F.array_sort(col)
    if isinstance(dtype, T.StructType):
        fields = [
            _ordered(col.getField(field.name), field.dataType, skip).alias(field.name)
            for field in _kept(dtype, skip)
        ]
        # A record with nothing left is still a record: keep one placeholder field.
        record = F.struct(*fields) if fields else F.struct(F.lit(0).alias("_"))
        return F.when(col.isNotNull(), record)
    if isinstance(dtype, T.MapType):
        entries = F.map_entries(col)
        if skip and isinstance(dtype.keyType, _TEXT):
            entries = F.filter(entries, lambda entry: ~entry["key"].isin(*skip))
        if _is_nested(dtype.valueType):
            entries = F.transform(
                entries,
                lambda entry: F.struct(
                    entry["key"].alias("key"),
                    _ordered(entry["value"], dtype.valueType, skip).alias("value"),
                ),
            )
        return F.array_sort(entries)
    return col


# Step 2: write the sorted value as JSON.


def _json(col: Column, dtype: T.DataType, skip: frozenset) -> Column:
    if _is_variant(dtype):
        text = col
    elif isinstance(dtype, T.ArrayType):
        text = _list_text(col, lambda item: _json(item, dtype.elementType, skip))
    elif isinstance(dtype, T.StructType):
        fields = [(f.name, col.getField(f.name), f.dataType) for f in _kept(dtype, skip)]
        text = F.when(col.isNotNull(), _pair_list(fields, skip))
    elif isinstance(dtype, T.MapType):
        text = _list_text(
            col,
            lambda entry: F.concat(
                F.lit("["),
                _json(entry["key"], dtype.keyType, skip),
                F.lit(","),
                _json(entry["value"], dtype.valueType, skip),
                F.lit("]"),
            ),
        )
    else:
        text = _scalar(col, dtype)
    return F.coalesce(text, F.lit("null"))


def _list_text(col: Column, write) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(col, write), ","), F.lit("]"))


def _pair_list(pairs: list[tuple[str, Column, T.DataType]], skip: frozenset) -> Column:
    pieces, before = [], "["
    for name, col, dtype in pairs:
        pieces += [F.lit(f"{before}[{json.dumps(name)},"), _json(col, dtype, skip)]
        before = "],"
    return F.concat(*pieces, F.lit("]]")) if pieces else F.lit("[]")


def _scalar(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, _TEXT):
        return F.concat(F.lit('"'), _escaped(col), F.lit('"'))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return float_text(col, dtype, nan="NaN", inf="Infinity")
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.lit('"'), iso_text(col, dtype), F.lit('"'))
    if isinstance(dtype, (T.BooleanType, T.IntegralType, T.DecimalType, T.NullType)):
        return col.cast("string")
    raise ValueError(f"a {dtype.simpleString()} value has no fingerprint text; cast or skip it")


def _escaped(col: Column) -> Column:
    """JSON string content in ASCII; plain texts are passed on untouched."""
    marked = col
    for char, escape in _ESCAPES:
        marked = F.replace(marked, F.lit(char), F.lit(escape))
    runs = F.regexp_extract_all(marked, F.lit(r"[ -~]+|[^ -~]+"), F.lit(0))
    written = F.array_join(F.transform(runs, _escaped_run), "")
    return (
        F.when(col.rlike(r"[^ -~\n\r\t\x08\f]"), written)
        .when(col.rlike(r'["\\\n\r\t\x08\f]'), marked)
        .otherwise(col)
    )


def _escaped_run(run: Column) -> Column:
    """A run of printable ASCII as it is, any other as UTF-16 units; most of those are one unit."""
    units = F.lower(F.hex(F.encode(run, "UTF-16BE")))
    return (
        F.when((run >= " ") & (run < "\x7f"), run)
        .when((F.length(run) == 1) & (run < "\U00010000"), F.concat(F.lit("\\u"), units))
        .otherwise(F.regexp_replace(units, "(.{4})", r"\\u$1"))
    )


# Variants: the same text, by value.


def _by_value(text: Column, skip: frozenset) -> Column:
    """The canonical texts of JSON values."""

    @F.pandas_udf(T.StringType())
    def write(texts: pd.Series) -> pd.Series:
        values = (None if text is None else json.loads(text, parse_float=_number, object_pairs_hook=_Record) for text in texts)
        return pd.Series([None if text is None else _value_text(value, skip) for text, value in zip(texts, values)], dtype=object)

    return write(text)


class _Record(list):
    """The pairs of a JSON object."""


class _Number(Decimal):
    """A number with a fraction or an exponent."""


def _number(text: str) -> Decimal:
    return _Number(text)


def _rank(value: object, skip: frozenset) -> tuple:
    """One order over values of all kinds: truth values, numbers, texts, lists, records, and last nulls."""
    if value is None:
        return (9,)
    if isinstance(value, bool):
        return 0, value
    if isinstance(value, (int, Decimal)):
        return 1, value, isinstance(value, Decimal)
    if isinstance(value, str):
        return 2, value.encode("utf-8", "surrogatepass")
    if isinstance(value, _Record):
        return 4, [(name.encode("utf-8", "surrogatepass"), _rank(inner, skip)) for name, inner in _pairs(value, skip)]
    return 3, sorted(_rank(inner, skip) for inner in value)


def _pairs(record: _Record, skip: frozenset) -> list[tuple[str, object]]:
    return sorted(((name, value) for name, value in record if name not in skip), key=lambda pair: pair[0])


def _value_text(value: object, skip: frozenset) -> str:
    if isinstance(value, _Record):
        return "[" + ",".join(f"[{json.dumps(name)},{_value_text(inner, skip)}]" for name, inner in _pairs(value, skip)) + "]"
    if isinstance(value, list):
        return "[" + ",".join(_value_text(inner, skip) for inner in sorted(value, key=lambda inner: _rank(inner, skip))) + "]"
    if isinstance(value, Decimal):
        # Shortest form, unless a double cannot hold the digits.
        near = float(value)
        return repr(near) if Decimal(repr(near)) == value else str(value)
    return json.dumps(value)
