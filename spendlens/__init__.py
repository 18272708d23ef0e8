"""Analytics over ledgers of public spending, on Spark DataFrames."""

from .spec import CITY, STATE, LedgerSpec

__all__ = ["CITY", "STATE", "LedgerSpec"]
