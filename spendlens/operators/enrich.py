"""VAT numbers of sellers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import active_vat, extract_entity_id, vat_link
from ..functions.supplier import UNREGISTERED, seller_or_missing, supplier_name
from ..spec import LedgerSpec


def vat_lookup(df: DataFrame) -> DataFrame:
    """Distinct (supplier, VAT number, link) of lines that carry a number."""
    number = F.col("vat_no")
    return (
        df.filter(number.isNotNull())
        .select(
            supplier_name().alias("supplier_name"),
            number,
            F.when(number > 0, vat_link(number)).alias("vsk_link"),
        )
        .distinct()
    )


def vat_coverage(df: DataFrame) -> DataFrame:
    """One row: entries of the VAT lookup and distinct suppliers.

    Both counts come from one pass over distinct (supplier, number) pairs;
    the link is a function of the number.
    """
    pairs = df.select(supplier_name().alias("supplier_name"), "vat_no").distinct()
    return pairs.agg(
        F.count("vat_no").alias("with_vat"),
        F.countDistinct("supplier_name").alias("suppliers"),
    )


def seller_template(df: DataFrame, spec: LedgerSpec) -> DataFrame:
    """Distinct sellers of a state ledger with empty VAT fields to fill."""
    nothing = F.lit(None).cast("string")
    return (
        df.select(seller_or_missing(spec.seller).alias("seller_name"))
        .distinct()
        .select("seller_name", nothing.alias("vm_numer"), nothing.alias("vsk_link"))
    )


def lookup_coverage(lookup: DataFrame, number: str = "vm_numer") -> DataFrame:
    return lookup.agg(F.count("*").alias("sellers"), F.count(number).alias("with_vat"))


def all_sellers(state: DataFrame, city: DataFrame, spec: LedgerSpec) -> DataFrame:
    """Sellers of both ledgers without duplicates, sorted.

    Each side is made distinct before the union, so the union carries names
    and not lines. A city line without any name contributes a NULL.
    """
    seller = spec.seller
    ours = state.filter(seller.isNotNull()).select(seller_or_missing(seller).alias("seller"))
    theirs = city.select(supplier_name("company_label").alias("seller"))
    names = ours.distinct().union(theirs.distinct()).distinct()
    return names.orderBy(F.col("seller").asc_nulls_last())


def registry_numbers(answers: DataFrame, name: str, answer: str) -> DataFrame:
    """One VAT number per name from stored registry answers.

    A name may have several stored answers; the smallest number is taken so
    the choice does not depend on task order.
    """
    return (
        answers.select(F.col(name).alias("seller_name"), active_vat(F.col(answer)).alias("vm_numer"))
        .filter(F.col("vm_numer").isNotNull())
        .groupBy("seller_name")
        .agg(F.min("vm_numer").alias("vm_numer"))
    )


def registry_ids(pages: DataFrame, name: str, page: str) -> DataFrame:
    """One 10-digit id per name from stored search pages (or their addresses).

    Names whose page shows no id are left out; of several pages of a name the
    smallest id counts.
    """
    return (
        pages.select(F.col(name).alias("seller_name"), extract_entity_id(F.col(page)).alias("entity"))
        .filter(F.col("entity").isNotNull())
        .groupBy("seller_name")
        .agg(F.min("entity").alias("entity"))
    )


def numbers_by_id(
    ids: DataFrame, answers: DataFrame, entity: str, answer: str
) -> DataFrame:
    """One VAT number per name, through its id, from answers stored by id.

    Several names may share an id; an answer is parsed once per id.
    """
    found = registry_numbers(answers, entity, answer).select(
        F.col("seller_name").alias("entity"), "vm_numer"
    )
    return ids.join(found, "entity").select("seller_name", "vm_numer")


def enrich_sellers(sellers: DataFrame, numbers: DataFrame) -> DataFrame:
    """Every seller with its VAT number and link, NULL when not registered.

    Sellers are distinct names, so the join has no hot key; Spark broadcasts
    the registry when its size allows.
    """
    return sellers.select(F.col("seller").alias("seller_name")).join(
        numbers, "seller_name", "left"
    ).select("seller_name", "vm_numer", vat_link(F.col("vm_numer")).alias("vsk_link"))


__all__ = [
    "UNREGISTERED", "all_sellers", "enrich_sellers", "lookup_coverage",
    "numbers_by_id", "registry_ids", "registry_numbers", "seller_template", "vat_coverage", "vat_lookup",
]
