"""Ledgers derived from a star schema of orders.

Lets every operator run on the benchmark tables: an order line is a payment
line, a returned one is negative. Each dimension is joined by its unique key
with a left join, which neither drops nor repeats lines, so a dimension none
of whose columns is asked for is left out of the plan.
"""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import AMOUNT_TYPE, CITY, STATE

_BUYER = {"_region", "_nation", "_segment", "_customer", "_priority"}
_SELLER = {"_seller", "_seller_key"}
_PART = {"_type", "_size", "_brand", "_part"}


# Columns used of each table. A stated schema saves the job that would read it
# from the files.
_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderpriority string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, "
        "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


#: Suppliers up to which their nations, two numbers each, are broadcast.
_BROADCAST_SUPPLIERS = 500_000


def _lines(spark: SparkSession, sf_dir: str, wanted: set[str], own: dict[str, Column]) -> DataFrame:
    """Order lines with columns of their ``own`` and the wanted dimension columns.

    The lines are shuffled once for each large dimension, so they take up their
    own columns before, and the widest dimension last: parts, then orders, which
    get their customer before. The small tables come one by one at the end of
    each chain, where Spark sees their true size and broadcasts them; a join of
    two of them would be estimated as their product.
    """
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    df = _table(spark, sf_dir, "lineitem").select(*keys, *(c.alias(n) for n, c in own.items()))
    nation = _table(spark, sf_dir, "nation")
    if wanted & _SELLER:
        supplier = _table(spark, sf_dir, "supplier").select(
            "s_suppkey", F.col("s_nationkey").alias("_seller_key")
        )
        if supplier.limit(_BROADCAST_SUPPLIERS + 1).count() <= _BROADCAST_SUPPLIERS:
            supplier = F.broadcast(supplier)
        df = df.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    if wanted & _PART:
        part = _table(spark, sf_dir, "part").select(
            "p_partkey",
            F.col("p_type").alias("_type"),
            F.col("p_size").alias("_size"),
            F.col("p_brand").alias("_brand"),
            F.col("p_name").alias("_part"),
        )
        df = df.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    if wanted & _BUYER:
        customer = _table(spark, sf_dir, "customer").select(
            "c_custkey",
            "c_nationkey",
            F.col("c_mktsegment").alias("_segment"),
            F.col("c_name").alias("_customer"),
        )
        orders = (
            _table(spark, sf_dir, "orders")
            .select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("_priority"))
            .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        )
        if wanted & {"_nation", "_region"}:
            home = nation.select(
                F.col("n_nationkey").alias("_home"), F.col("n_name").alias("_nation"), "n_regionkey"
            )
            orders = orders.join(home, F.col("c_nationkey") == F.col("_home"), "left")
        if "_region" in wanted:
            region = _table(spark, sf_dir, "region").select(
                "r_regionkey", F.col("r_name").alias("_region")
            )
            orders = orders.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "_seller" in wanted:
        seat = nation.select(F.col("n_nationkey").alias("_seat"), F.col("n_name").alias("_seller"))
        df = df.join(seat, F.col("_seller_key") == F.col("_seat"), "left")
    return df


def _amount() -> Column:
    """Money with two decimals. Going by whole cents is exact and avoids the
    slow general cast from a double."""
    price = F.col("l_extendedprice")
    signed = F.when(F.col("l_returnflag") == "R", -price).otherwise(price)
    cents = F.floor(signed * 100 + F.lit(0.5)).cast("decimal(18,0)")
    return (cents * F.lit(Decimal("0.01"))).cast(AMOUNT_TYPE)


def _flag() -> Column:
    """Three-valued: some lines marked, some unmarked, some unknown."""
    return F.when(F.col("l_tax") == 0.08, True).when(F.col("l_linestatus") == "O", False)


def _project(
    spark: SparkSession, sf_dir: str, recipe: dict[str, tuple[set[str], Column]],
    columns: Iterable[str] | None,
) -> DataFrame:
    names = list(recipe) if columns is None else [c for c in recipe if c in set(columns)]
    wanted = set().union(*(recipe[c][0] for c in names))
    # A copy of a key as text would be the widest column of a shuffle.
    own = {c: recipe[c][1] for c in names if not recipe[c][0] and c != "invoice"}
    lines = _lines(spark, sf_dir, wanted, own)
    return lines.select(*(F.col(c) if c in own else recipe[c][1].alias(c) for c in names))


def state_ledger(
    spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None
) -> DataFrame:
    """Order lines as a state ledger: regions buy from nations. Some lines
    name no buyer, seller or type."""
    day = F.col("l_shipdate").cast("date")

    def known(column: str, every: int) -> Column:
        return F.when(F.col("l_orderkey") % every != 0, F.col(column))

    recipe = {
        "buyer": ({"_region"}, known("_region", 97)),
        "seller": ({"_seller"}, known("_seller", 89)),
        "type": ({"_type"}, known("_type", 83)),
        "amount": (set(), _amount()),
        "paid_on": (set(), day),
        "invoice": (set(), F.col("l_orderkey").cast("string")),
        "is_correction": (set(), _flag()),
        "year": (set(), F.year(day)),
    }
    return _project(spark, sf_dir, recipe, columns)


def city_ledger(
    spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None
) -> DataFrame:
    """Order lines as a city ledger, with gaps and blanks in the names."""
    seller, key, size = F.col("_seller"), F.col("_seller_key"), F.col("_size")
    recipe = {
        "year": (set(), F.year("l_shipdate")),
        "amount": (set(), _amount()),
        "org0": ({"_region"}, F.col("_region")),
        "org1": ({"_nation"}, F.col("_nation")),
        "org2": ({"_segment"}, F.nullif(F.col("_segment"), F.lit("MACHINERY"))),
        "org3": ({"_customer"}, F.col("_customer")),
        "org4": ({"_priority"}, F.nullif(F.col("_priority"), F.lit("5-LOW"))),
        "type0": ({"_type"}, F.nullif(F.col("_type"), F.lit("PROMO"))),
        "type1": ({"_brand"}, F.nullif(F.col("_brand"), F.lit("Brand#2"))),
        "type2": ({"_part"}, F.when(F.length("_part") % 3 != 0, F.col("_part"))),
        "type3": ({"_size"}, F.when(size % 4 != 0, F.concat(F.lit("Size "), size.cast("string")))),
        "type4": (set(), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus"))),
        "company": (
            {"_seller", "_seller_key"},
            F.when(key % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit("Company of "), seller)),
        ),
        "company_label": (
            {"_seller", "_seller_key"},
            F.when(key % 2 == 0, F.concat(F.lit(" Label of "), seller, F.lit(" "))),
        ),
        "vat_no": ({"_seller_key"}, F.when(key % 7 != 3, (key * 1000).cast("bigint"))),
        "vat_name": (
            {"_seller", "_seller_key"},
            F.when(key % 4 == 0, F.lit("")).when(key % 4 != 1, F.concat(F.lit(" VAT "), seller)),
        ),
        "expense_code": (
            {"_seller_key", "_size"},
            F.when((key % 3 == 0) & (size % 10 != 0), (size % 10).cast("string")),
        ),
        "expense_label": (
            {"_seller_key", "_size"},
            F.when((key % 3 == 0) & (size % 10 > 4), F.concat(F.lit("Expense "), (size % 10).cast("string"))),
        ),
        "is_correction": (set(), _flag()),
    }
    return _project(spark, sf_dir, recipe, columns)


__all__ = ["CITY", "STATE", "city_ledger", "state_ledger"]
