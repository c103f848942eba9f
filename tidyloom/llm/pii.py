"""Personal data by anchor expansion: Aho-Corasick finds anchors, local parsers expand and validate spans.

One automaton finds at-signs, digits, plus signs, schemes and identifier cues in a text.  A parser of the
anchor's kind then grows the span to both sides and checks it: no pattern is searched over the whole
text, and each character is visited a bounded number of times per kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import text_parts

#: The order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "account", "url", "address")
BASE = KINDS[:4]

# Character classes and cues.
DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEMES = ("https://", "http://", "ftp://")
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn")
STREET_CUES = ("avenue", "boulevard", "lane", "road", "street")
#: Short or common words: cues only when written with a capital.
STREET_KINDS = (
    "Alley", "Ave", "Blvd", "Circle", "Close", "Court", "Crescent", "Ct", "Dr", "Drive", "Highway", "Hwy", "Ln", "Parkway",
    "Pkwy", "Place", "Plaza", "Rd", "Sq", "Square", "St", "Terrace", "Trail", "Way",
)

# Anchored matches at one place only; none of them is used to search.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
SPACED = re.compile(r"[0-9](?:[ -]?[0-9])*")
PHONE = re.compile(r"\+[0-9][ ().0-9-]*")
LINK = re.compile(r"[^\s<>\"'`{}|\\^\[\]]*")
ACCOUNT = re.compile(r"(?: ?(?:number|no\.?|#))?[ :=#]{1,3}([A-Za-z]{0,2}[0-9](?:[ -]?[0-9A-Z])*)")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){10,30}")
STREET = re.compile(r"[0-9]{1,5}[A-Za-z]? (?:[A-Z][A-Za-z]* ){1,4}$")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in DIGITS:
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    for kind, words in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("address", STREET_CUES)):
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                found.add_word(form, (kind, len(form)))
    for word in STREET_KINDS:
        for form in {word, word.upper()}:
            found.add_word(form, ("address", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def iban_checks(text: str) -> bool:
    """The remainder of an account number whose letters count from 10 on is 1."""
    compact = text.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def spans(text: str | None, found: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of every span, by start and then kind as listed in ``KINDS``.

    Spans of one kind never overlap; those of different kinds may.
    """
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    done = dict.fromkeys((*KINDS, "dotted", "spaced"), 0)

    def add(kind: str, start: int, end: int) -> None:
        out.append((start, end, kind))
        done[kind] = end

    for last, (kind, size) in found.iter(text):
        at = last + 1 - size
        if kind == "digit":
            if at >= done["dotted"]:
                chain = DOTTED.match(text, at)
                done["dotted"] = chain.end()
                parts = chain[0].split(".")
                start = at
                for i in range(0, len(parts) - 3, 4):
                    end = start + sum(map(len, parts[i : i + 4])) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                        add("ip", start, end)
                    start = end + 1
            if at >= done["spaced"]:
                chain = SPACED.match(text, at)
                done["spaced"] = chain.end()
                if 12 <= chain.end() - at:
                    digits = chain[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        add("card", at, chain.end())
        elif kind == "email":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            domain = DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                add("email", start, domain.end())
        elif kind == "phone":
            run = PHONE.match(text, at) if at >= done["phone"] else None
            if run:
                end = run.end()
                while text[end - 1] not in DIGITS:
                    end -= 1
                if end - at >= 4:
                    # A run of another number of digits is passed over as a whole.
                    if 9 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                        add("phone", at, end)
                    done["phone"] = end
        elif kind == "url":
            if at >= done["url"] and not (at and text[at - 1].isalnum()):
                end = LINK.match(text, last + 1).end()
                while end > last + 1 and text[end - 1] in ".,;:!?)":
                    end -= 1
                if end > last + 1:
                    add("url", at, end)
        elif kind == "account":
            if at >= done["account"] and not (at and text[at - 1].isalpha()):
                number = ACCOUNT.match(text, last + 1)
                iban = IBAN.match(text, number.start(1)) if number else None
                if iban and iban_checks(iban[0]):
                    add("account", *iban.span())
                elif number and sum(c in DIGITS for c in number[1]) >= 6:
                    add("account", *number.span(1))
        elif not text[last + 1 : last + 2].isalnum():
            # A house number and up to four capitalised words before the kind of street.
            begin = max(done["address"], at - 100)
            lead = next((m for i in range(begin, at) if text[i] in DIGITS and (i == begin or not text[i - 1].isalnum()) and (m := STREET.match(text[i:at]))), None)
            if lead:
                add("address", at - len(lead[0]), last + 1)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, spans array<struct<start, end, kind>>`` of every whole text, in code points, end exclusive.

    A null or empty text has no span.  Rows are treated one by one: repeated rows give equal spans, and
    other columns are not read.
    """
    schema = "doc_id bigint, spans array<struct<start:bigint,end:bigint,kind:string>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            for part in text_parts(batch, "text"):
                rows = [[dict(zip(("start", "end", "kind"), s)) for s in spans(t, found)] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, span)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scan, schema)


def redact(text: str | None, found: ahocorasick.Automaton) -> str | None:
    """The text with ``<kind>`` in place of each span; overlapping spans become one, of the first kind."""
    if not text:
        return text
    out, done = [], 0
    for start, end, kind in spans(text, found):
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind; all other columns as they are."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in batches:
            for part in text_parts(batch, "text"):
                texts = pa.array([redact(t, found) for t in part.column("text").to_pylist()], pa.string())
                yield part.set_column(part.schema.get_field_index("text"), "text", texts)

    return docs.mapInArrow(clean, docs.schema)


def pii_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``: counts and digests of ``find_pii``."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}") for kind in BASE]
    joined = F.array_join(F.transform(base, text), ",")
    return find_pii(docs).select("doc_id", *counts, F.sha2(joined, 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"))
