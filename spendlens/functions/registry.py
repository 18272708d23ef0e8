"""Reading stored answers of a company registry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: public page of one VAT number.
VAT_PAGE = "https://www.skatturinn.is/fyrirtaekjaskra/leit/vsk-numer/"

_ENTRIES = "vat array<map<string,string>>"
# What a JSON field holds when it says no.
_NO = ("", "false", "0", "0.0", "null")


def extract_entity_id(text: Column) -> Column:
    """First free-standing 10-digit number in a text, else NULL."""
    return F.nullif(F.regexp_extract(text, r"(?U)\b\d{10}\b", 0), F.lit(""))


def active_vat(answer: Column) -> Column:
    """VAT number of a registry answer.

    The first entry that names a number and is not deregistered (the field is
    absent, empty, null, false or 0); when every entry is deregistered, the
    number of the first entry.
    """
    entries = F.from_json(answer, _ENTRIES)["vat"]
    active = F.filter(
        entries,
        lambda e: F.map_contains_key(e, "vatNumber")
        & F.coalesce(F.try_element_at(e, F.lit("deRegistered")), F.lit("")).isin(*_NO),
    )
    chosen = F.coalesce(F.get(active, F.lit(0)), F.get(entries, F.lit(0)))
    return F.try_element_at(chosen, F.lit("vatNumber"))


def vat_link(number: Column) -> Column:
    """Registry page of a VAT number that is not missing."""
    return F.concat(F.lit(VAT_PAGE), number.cast("string"))
