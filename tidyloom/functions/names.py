"""Canonical names: one rule, usable on a column name and on a column of labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacements applied in this order, after lower-casing and stripping.
NAME_RULES = (
    (r"[ :_\-]+", "_"),
    (r"#", "num"),
    (r"%", "pct"),
    (r"[&+]+", "and"),
    (r"[|,/;]+", "or"),
    (r"[().]+", ""),
)

# Every blank that Python's strip() removes; the last one is U+3000.
BLANKS = "".join(char for char in map(chr, range(0x3001)) if char.isspace())


def clean_column_name(name: str) -> str:
    """Canonical form of one name: ``" Total-Price (USD) "`` becomes ``"total_price_usd"``."""
    name = name.lower().strip()
    for pattern, replacement in NAME_RULES:
        name = re.sub(pattern, replacement, name)
    return name


def clean_label(col: Column | str) -> Column:
    """The same rule on the values of a string column, inside the JVM."""
    text = F.trim(F.lower(col), F.lit(BLANKS))
    for pattern, replacement in NAME_RULES:
        if len(pattern) == 1:
            text = F.replace(text, F.lit(pattern), F.lit(replacement))
        else:
            text = F.regexp_replace(text, pattern, replacement)
    return text
