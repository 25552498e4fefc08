"""Column expressions on text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_decode(text: Column) -> Column:
    """Percent-decoding in which ``+`` and malformed escapes stay as they are."""
    kept = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.url_decode(F.replace(kept, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(text, F.lit("%")), decoded).otherwise(text)


def squeezed(text: Column | str) -> Column:
    """Lower case with every run of white space as one blank."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def holds_all(text: Column | str, phrases: Sequence[str]) -> Column:
    """All phrases occur, compared in squeezed form over the whole text."""
    wanted = F.array(*[F.lit(p.lower()) for p in phrases])
    return F.forall(wanted, lambda p: F.contains(squeezed(text), p))


def after_first(text: Column, mark: str) -> Column:
    """Text after the first ``mark``; the whole text if there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(text)


def iso_date(text: Column | str) -> Column:
    """DATE from a strict ``YYYY-MM-DD`` text, else NULL."""
    text = F.col(text) if isinstance(text, str) else text
    strict = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    return strict.try_cast("date")


def attribute_values(attributes: Column | str, key: str) -> Column:
    """Values of one attribute, an empty array if it is absent."""
    return F.coalesce(F.try_element_at(attributes, F.lit(key)),
                      F.expr("CAST(array() AS ARRAY<STRING>)"))


def first_value(attributes: Column | str, key: str) -> Column:
    return F.get(attribute_values(attributes, key), F.lit(0))


def attribute_true(attributes: Column | str, key: str) -> Column:
    return F.exists(attribute_values(attributes, key), lambda v: F.lower(v) == "true")


def wrapped(text: Column | str, width: int = 70) -> Column:
    """Line breaks after every ``width`` characters."""
    return F.regexp_replace(text, rf"(.{{{width}}})(?=.)", "$1\n")


def row_text(*columns: Column | str) -> Column:
    """One text per row from which every value can be told apart: the length of each, a colon, and the value; ``-`` is null."""
    parts = []
    for c in columns:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(value), F.lit(":"), value), F.lit("-")))
    return F.concat(*parts)


def multiset_digest(*columns: Column | str) -> Column:
    """Aggregate: a digest of all rows in any order, in which a doubled row counts twice.

    The four 32-bit parts of each row's MD5 are summed separately; sums add up
    in any order and combine before the shuffle.
    """
    digest = F.md5(row_text(*columns).cast("binary"))
    sums = [F.sum(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")) for k in range(4)]
    return F.concat_ws("-", *[F.coalesce(x.cast("string"), F.lit("0")) for x in sums])
