"""Column expressions, all built in and evaluated inside the JVM."""

from .dates import export_date, iso_date, year_from_name, year_label, years_label
from .measures import pct_change, safe_pct, signed_sums
from .registry import active_vat, extract_entity_id, vat_link
from .supplier import seller_or_missing, supplier_name
from .text import clean, format_amount, format_pct, parse_local_number, strip_text

__all__ = [
    "active_vat", "clean", "export_date", "extract_entity_id", "format_amount",
    "format_pct", "iso_date", "parse_local_number", "pct_change", "safe_pct",
    "seller_or_missing", "signed_sums", "strip_text", "supplier_name", "vat_link",
    "year_from_name", "year_label", "years_label",
]
