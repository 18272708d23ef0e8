"""Keeping a stored ledger current."""

from .deliveries import apply_deliveries, land_delivery, refresh
from .upkeep import follow_months, read_comparison, update_comparison

__all__ = [
    "apply_deliveries", "follow_months", "land_delivery", "read_comparison", "refresh", "update_comparison",
]
