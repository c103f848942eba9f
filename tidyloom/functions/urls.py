"""Bucket and key of object-store URLs.

What follows a ``;`` or a ``#`` is part of the key, whatever the scheme.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?"
_AUTHORITY = r"(?://([^/?#]*))?"
# The path up to the first "?", and the query unless it is empty.  A "#" is part of either.
_KEY = r"/*([^?]*(?:\?.+)?)\??$"
_REST = r"([^?]*(?:\?.+)?)\??$"

# Characters a URL parser drops: leading control characters and blanks, and any tab or line break.
_DROPPED = r"^[\x00-\x20]+|[\t\r\n]"


def _tidy(url: Column | str) -> Column:
    return F.regexp_replace(url, _DROPPED, "")


def url_bucket(url: Column | str) -> Column:
    """``s3://bucket/hello/world`` -> ``bucket``."""
    return F.regexp_extract(_tidy(url), _SCHEME + _AUTHORITY, 2)


def url_key(url: Column | str) -> Column:
    """``s3://bucket/hello/world?v=1`` -> ``hello/world?v=1``."""
    return F.regexp_extract(_tidy(url), _SCHEME + _AUTHORITY + _KEY, 3)


def url_text(url: Column | str) -> Column:
    """The URL put together again: scheme in lower case, an empty query dropped.

    Two slashes stand before a bucket, or before a path that would look like one, and one slash
    between the two.
    """
    tidy = _tidy(url)
    scheme = F.lower(F.regexp_extract(tidy, _SCHEME, 1))
    bucket = F.regexp_extract(tidy, _SCHEME + _AUTHORITY, 2)
    rest = F.regexp_extract(tidy, _SCHEME + _AUTHORITY + _REST, 3)
    has_bucket = bucket != ""
    return F.concat(
        F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":"))),
        F.when(has_bucket | rest.startswith("//"), "//").otherwise(""),
        bucket,
        F.when(has_bucket & rest.rlike("^[^/?]"), "/").otherwise(""),
        rest,
    )


def split_url(url: Column | str) -> Column:
    """A struct of ``bucket``, ``key`` and ``url``."""
    return F.struct(
        url_bucket(url).alias("bucket"), url_key(url).alias("key"), url_text(url).alias("url")
    )
