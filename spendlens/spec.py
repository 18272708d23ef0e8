"""What a ledger looks like.

Operators work on canonical column names; a :class:`LedgerSpec` says which of
them play the roles *type*, *buyer* and *seller*, which ones form the grain of
a year-over-year comparison, and how the columns are called in source files.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.supplier import supplier_name

AMOUNT_TYPE = T.DecimalType(18, 2)
YOY_AMOUNT_TYPE = T.DecimalType(28, 2)
MEASURES = ("actual_real", "prior_real", "yoy_real_change", "yoy_real_pct")


@dataclass(frozen=True)
class LedgerSpec:
    """Roles and names of one kind of ledger."""

    name: str
    types: tuple[str, ...]
    buyers: tuple[str, ...]
    grain: tuple[str, ...]
    schema: T.StructType
    file_names: Mapping[str, str]
    labels: Mapping[str, str]
    preview: tuple[str, ...]
    analysis_preview: tuple[str, ...]
    date: str | None = None
    seller_column: str | None = None
    type_fallback: str | None = None
    amount: str = "amount"
    year: str = "year"
    flag: str = "is_correction"

    @property
    def type(self) -> str:
        return self.types[0]

    @property
    def buyer(self) -> str:
        return self.buyers[0]

    @property
    def seller(self) -> Column:
        """The seller: a column, or the first usable supplier field."""
        if self.seller_column:
            return F.col(self.seller_column)
        return supplier_name()

    def focus(self, which: str) -> tuple[str, str]:
        """(focus, driver) columns; anything but ``buyer`` means ``type``."""
        if which == "buyer":
            return self.buyer, self.type
        return self.type, self.buyer

    def canonical(self, column: str) -> str:
        return self.file_names.get(column, column)

    def label(self, column: str) -> str:
        return self.labels.get(column, column)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_S, _B, _I, _L = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType()

# Column names of the published files and their display labels.
STATE = LedgerSpec(
    name="state",
    types=("type",),
    buyers=("buyer", "seller"),
    grain=("buyer", "seller", "type"),
    schema=_schema(
        ("buyer", _S),
        ("seller", _S),
        ("type", _S),
        ("amount", AMOUNT_TYPE),
        ("paid_on", T.DateType()),
        ("invoice", _S),
        ("is_correction", _B),
    ),
    file_names={
        "Kaupandi": "buyer",
        "Birgi": "seller",
        "Tegund": "type",
        "Upphæð línu": "amount",
        "Dags.greiðslu": "paid_on",
        "Númer reiknings": "invoice",
    },
    labels={
        "year": "Ár",
        "type": "Tegund",
        "buyer": "Stofnun (kaupandi)",
        "seller": "Birgir",
        "amount": "Upphæð",
        "paid_on": "Dags.",
        "invoice": "Reikningur",
    },
    preview=("year", "buyer", "seller", "type", "amount", "paid_on"),
    analysis_preview=("year", "buyer", "seller", "type", "amount", "paid_on"),
    date="paid_on",
    seller_column="seller",
)

CITY = LedgerSpec(
    name="city",
    types=("type0", "type1", "type2", "type3"),
    buyers=("org0", "org1", "org2", "org3"),
    grain=(
        "org0", "org1", "org2", "org3", "org4",
        "type0", "type1", "type2", "type3", "type4",
        "company", "vat_no", "vat_name",
    ),
    schema=_schema(
        ("year", _I),
        ("amount", AMOUNT_TYPE),
        *((f"org{i}", _S) for i in range(5)),
        *((f"type{i}", _S) for i in range(5)),
        ("company", _S),
        ("company_label", _S),
        ("vat_no", _L),
        ("vat_name", _S),
        ("expense_code", _S),
        ("expense_label", _S),
        ("is_correction", _B),
    ),
    file_names={
        "ar": "year",
        "raun": "amount",
        "samtala0": "org0",
        "samtala1": "org1",
        "samtala2": "org2",
        "samtala2_canonical": "org2",
        "samtala3": "org3",
        "samtala4": "org4",
        "tegund0": "type0",
        "tegund1": "type1",
        "tegund2": "type2",
        "tegund3": "type3",
        "tegund4": "type4",
        "fyrirtaeki": "company",
        "xfyrirtaeki": "company_label",
        "vm_numer": "vat_no",
        "vm_nafn": "vat_name",
        "tgr1": "expense_code",
        "xtgr1": "expense_label",
    },
    labels={
        "year": "Ár",
        "type0": "Tegundaflokkur",
        "type1": "Tegund 1",
        "type2": "Tegund 2",
        "type3": "Tegund 3",
        "org0": "Stofnun",
        "org1": "Svið",
        "org2": "Þjónusta",
        "org3": "Undireining",
        "amount": "Upphæð (raun)",
        "company": "Fyrirtæki",
        "vat_no": "VSK-númer",
        "supplier_name": "VSK-heiti",
        "vat_name": "VSK-heiti",
    },
    preview=("year", "org0", "org1", "type0", "type1", "amount", "supplier_name"),
    analysis_preview=("year", "org0", "org1", "type0", "type1", "amount", "company"),
    type_fallback="Ótilgreint",
)
