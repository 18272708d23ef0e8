"""Names of suppliers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

# Labels for missing names.
UNREGISTERED = "(óskráð)"


def supplier_name(name: str = "vat_name", company: str = "company", number: str = "vat_no") -> Column:
    """First non-blank of the VAT name, the company and the VAT number."""
    return F.coalesce(
        clean(F.col(name)), clean(F.col(company)), clean(F.col(number).cast("string"))
    )


def seller_or_missing(seller: Column) -> Column:
    return F.coalesce(clean(seller), F.lit(UNREGISTERED))
