"""Fixed-width text files: native string functions over a splittable text scan."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from itertools import accumulate
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_fixed_width(
    spark: SparkSession,
    path: str,
    names: Sequence[str] | None = None,
    colspecs: Sequence[Sequence[int]] | None = None,
    widths: Sequence[int] | None = None,
    schema: str | T.StructType | None = None,
    header: bool = False,
    **options: Any,
) -> DataFrame:
    """One column per ``colspecs`` pair (start from 0, end exclusive) or per width, or as inferred.

    Without either, a column is a run of positions that are not blank in every line of all files, found by one pass over
    them.  With ``header``, names that are not given are taken from the first line.

    Fields are stripped of blanks and tabs; empty ones are null, and so are those that do not fit
    their type in ``schema``.  Without a schema all columns are strings called ``names``.  Blank
    lines are skipped, and with ``header`` the first line of every file.  Other options are those of Spark's
    text reader; columns of partition folders follow the fields.
    """
    if colspecs is not None and widths is not None:
        raise ValueError("fixed-width tables take colspecs or widths, not both")
    if widths is not None:
        ends = list(accumulate(widths))
        colspecs = list(zip([0, *ends], ends))
    elif colspecs is None:
        colspecs = inferred_colspecs(spark.read.options(**options).text(path))
    if header and names is None and schema is None:
        names = _header_names(spark, path, colspecs, options)
    fields = _fields(names, schema, len(colspecs))
    lines = _lines(spark, path, header, options)
    return lines.select(
        *[
            _field(F.col("value"), start, end, field.dataType).alias(field.name)
            for (start, end), field in zip(colspecs, fields)
        ],
        *[F.col(f"`{name}`") for name in lines.columns if name != "value"],
    )


def inferred_colspecs(lines: DataFrame) -> list[tuple[int, int]]:
    """The runs of positions of ``lines (value)`` at which some line has no blank; positions are characters.

    Tasks mark the positions of their lines, and Spark joins the marks: as many rows as the longest line has characters.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(0, bool)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                texts = [t for t in batch.column(0).slice(low, 1000).to_pylist() if t]
                if not texts:
                    continue
                codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
                sizes = np.array([len(t) for t in texts])
                place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                filled = np.concatenate((filled, np.zeros(max(0, int(sizes.max()) - len(filled)), bool)))
                filled[place[(codes != 32) & (codes != 9)]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(filled))], names=["place"])

    marks = lines.select("value").mapInArrow(mark, "place bigint").distinct().toArrow()
    places = np.sort(np.asarray(marks.column("place").combine_chunks()))
    first = np.concatenate(([True], np.diff(places) > 1))[: len(places)]
    last = np.concatenate((first[1:], [True]))[: len(places)]
    return [(int(a), int(b) + 1) for a, b in zip(places[first], places[last])]


def _header_names(spark: SparkSession, path: str, colspecs, options: dict) -> list[str]:
    first = spark.read.options(**options).text(path).select("value").head()
    line = first["value"] if first else ""
    return [line[start:end].strip(" \t") or f"_c{i}" for i, (start, end) in enumerate(colspecs)]


def _fields(names, schema, count: int) -> list[T.StructField]:
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if schema is None and names is None:
        raise ValueError("fixed-width tables need names or a schema")
    fields = list(schema) if schema is not None else [T.StructField(n, T.StringType()) for n in names]
    if names is not None and [field.name for field in fields] != list(names):
        raise ValueError("names and schema disagree")
    if len(fields) != count:
        raise ValueError(f"{count} column positions for {len(fields)} columns")
    return fields


def _lines(spark: SparkSession, path: str, header: bool, options: dict) -> DataFrame:
    if header:
        # Only the csv reader knows where a file begins when it is read in splits; a separator that was just made up, and no
        # text can hold, makes it deliver whole lines.
        whole = {"sep": uuid.uuid4().hex, "quote": "", "ignoreLeadingWhiteSpace": False, "maxCharsPerColumn": -1}
        lines = spark.read.schema("value string").options(**options).csv(path, header=True, **whole)
    else:
        lines = spark.read.options(**options).text(path)
    return lines.filter(F.col("value").rlike(r"[^ \t]"))


def _field(line: Column, start: int | None, end: int | None, dtype: T.DataType) -> Column:
    start = start or 0
    length = F.length(line) if end is None else F.lit(end - start)
    text = F.trim(F.substring(line, F.lit(start + 1), length), F.lit(" \t"))
    text = F.nullif(text, F.lit(""))
    return text if isinstance(dtype, T.StringType) else text.try_cast(dtype)
