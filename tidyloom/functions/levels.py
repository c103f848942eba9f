"""Names and numbers out of level texts such as ``"(2) powertrain"``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a parenthesised group and the space after it.
LEVEL_GROUP = r"\([^)]*\) "

# Fixed value: the text that stands for "no level".
NO_LEVEL = "None"


def clean_level(col: Column | str) -> Column:
    """The name: every ``"(...) "`` group is removed."""
    return F.regexp_replace(col, LEVEL_GROUP, "")


def get_num_value(col: Column | str, strict: bool = False) -> Column:
    """The number: the first digits inside the first ``"(...) "`` group, as ``bigint``.

    Texts without such a number give null, or stop the job with ``strict=True``; ``"None"`` and null
    give null in both cases.
    """
    text = F.col(col) if isinstance(col, str) else col
    digits = F.regexp_substr(F.regexp_substr(text, F.lit(LEVEL_GROUP)), F.lit(r"[0-9]+"))
    if strict:
        complaint = F.concat(F.lit("no level number in: "), text)
        no_number = digits.isNull() & text.isNotNull() & (text != NO_LEVEL)
        digits = F.when(no_number, F.raise_error(complaint)).otherwise(digits)
    return F.when(text != NO_LEVEL, digits.try_cast("bigint"))
