"""Loading delivered files: JSON payloads and CSV with flexible headers, into ledger and merchants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.operators.predicates import REFUND_STATUS

#: Header aliases by internal name (a name is its own alias).
ALIASES: dict[str, tuple[str, ...]] = {
    "payment_id": ("txn_id", "transaction_id", "source_txn_id", "id"),
    "merchant_id": ("merchant", "merchantid"),
    "total_amount": ("amount", "txn_amount", "transaction_amount", "gross_amount"),
    "net_amount": ("net",),
    "hkt_transaction_time": ("transaction_time", "txn_time", "occurred_at", "datetime", "date", "timestamp", "time"),
    "mcc": ("merchant_category_code",),
    "mcc_description": (),
    "hashed_merchant_name": ("merchant_name",),
    "city": (),
    "merchant_area": ("area",),
    "merchant_district": ("district",),
    "merchant_subdistrict": ("subdistrict",),
    "business_plan": (),
    "business_nature": (),
    "ownership_or_business_type": (),
    "merchant_status": ("status",),
    "agent_id": (),
    "hashed_br_number": (),
    "hashed_merchant_address": (),
    "card_type": (),
    "card_origin": (),
    "card_issuing_country": ("issuing_country", "country"),
    "card_issuing_bank": (),
    "payment_gateway": ("gateway",),
    "currency": (),
    "transaction_status": (),
    "hashed_pan": ("pan_hash",),
}
REQUIRED = ("payment_id", "merchant_id", "total_amount", "hkt_transaction_time")
MERCHANT_FIELDS = (
    "mcc", "mcc_description", "agent_id", "hashed_merchant_name", "hashed_br_number", "hashed_merchant_address", "city", "merchant_area",
    "merchant_district", "merchant_subdistrict", "business_plan", "business_nature", "ownership_or_business_type", "merchant_status",
)
TXN_FIELDS = ("card_type", "card_origin", "card_issuing_country", "card_issuing_bank", "payment_gateway", "currency", "transaction_status", "hashed_pan")
WRAPPERS = ("data", "rows", "transactions", "records")
_INTERNAL = {alias: name for name, aliases in ALIASES.items() for alias in (name, *aliases)}
_FIELDS = (*REQUIRED, "net_amount", *MERCHANT_FIELDS, *TXN_FIELDS)


def header_name(raw: str) -> str | None:
    """Internal name of a CSV header, None if unknown."""
    return _INTERNAL.get(raw.lstrip("﻿").strip().lower().replace(" ", "_").replace("-", "_"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Delivered rows of a CSV file, all as text, trimmed; rows without a required value are dropped.

    Unknown columns are ignored; of two columns with one internal name the later counts. Rows that
    are too short have nulls at the end. Raises ValueError naming required columns that are missing.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').csv(path)
    places = {name: k for k, c in enumerate(raw.columns) if (name := header_name(c))}
    if missing := [c for c in REQUIRED if c not in places]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    positions = [f"_c{k}" for k in range(len(raw.columns))]
    rows = raw.toDF(*positions)
    out = rows.select(*[F.trim(positions[k]).alias(name) for name, k in places.items()])
    return out.where(reduce(Column.__and__, [F.length(F.coalesce(c, F.lit(""))) > 0 for c in REQUIRED]))


_TEXT_FIELDS = ", ".join(f"{c} string" for c in _FIELDS)


def _json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, unparsed): rows of JSON files as structs ``row``, and the lines and documents ``(file, value)`` that are none."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value").where(F.length(F.trim("value")) > 0)
    row = F.from_json("value", _TEXT_FIELDS + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    wraps = reduce(Column.__or__, [F.coalesce(F.ltrim(F.get_json_object("value", f"$.{w}")).startswith("["), F.lit(False)) for w in WRAPPERS])
    # readers stop at the end of a value; only the one behind it tells that nothing else follows
    alone = F.get_json_object(F.concat(F.lit('{"row":'), "value", F.lit(',"end":1}')), "$.end") == "1"
    ok = F.ltrim("value").startswith("{") & F.coalesce(alone, F.lit(False)) & F.col("row._corrupt").isNull()
    lines = raw.withColumn("row", row).withColumn("ok", ok).withColumn("wraps", wraps)
    first, last = (f(F.struct(F.ltrim("value").startswith("[").alias("list"), "ok", "wraps"), "place") for f in (F.min_by, F.max_by))
    files = lines.groupBy("file").agg(first.alias("first"), last.alias("last"))
    # a document starts as a list or a wrapper, or neither begins nor ends with a whole row
    maybe = files.where("first.list or first.wraps or (not first.ok and not last.ok)").select("file")
    texts = lines.join(maybe, "file", "left_semi").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v"))
    text = F.ltrim("value")
    inner = F.coalesce(F.when(text.startswith("["), text), *[F.get_json_object("value", f"$.{w}") for w in WRAPPERS], F.concat(F.lit("["), text, F.lit("]")))
    whole = texts.select("file", F.array_join(F.transform("v", lambda x: x["value"]), "\n").alias("value"))
    parsed = whole.withColumn("rows", F.from_json(inner, f"array<struct<{_TEXT_FIELDS.replace(' string', ':string')}>>"))
    documents = parsed.where("rows is not null")
    broken = parsed.where(F.col("rows").isNull() & F.ltrim("value").startswith("["))
    by_line = lines.join(documents.unionByName(broken).select("file"), "file", "left_anti")
    rows = by_line.where("ok").select(F.col("row").dropFields("_corrupt").alias("row")).unionByName(documents.select(F.explode("rows").alias("row")))
    return rows, by_line.where(~F.col("ok")).select("file", "value").unionByName(broken.select("file", "value"))


def read_json(spark: SparkSession, path: str, bad: str = "raise") -> DataFrame:
    """Delivered rows of JSON files: of each, lines, or one document (an array, an object that wraps one, or one row).

    The wrapper is the first present of WRAPPERS. Files of lines are read by line, however large; a
    document is put together from its lines, and no file names are collected. A line or a document
    that is no JSON raises an error when it is read, so that no row is lost unseen; with ``bad``
    "skip" it is left to ``unparsed``, which a delivery writes to a table of its own.
    """
    rows, lost = _json(spark, path)
    if bad == "skip":
        return rows.select("row.*")
    refused = F.raise_error(F.concat(F.lit("no JSON in "), "file", F.lit(": "), F.substring("value", 1, 200)))
    kind = rows.schema["row"].dataType
    return rows.unionByName(lost.select(refused.cast(kind).alias("row"))).select("row.*")


def unparsed(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): lines and documents of JSON files that ``read_json`` refuses."""
    return _json(spark, path)[1]


def estimated_rows(spark: SparkSession, path: str) -> int:
    """Rows of a CSV file by its lines, the header aside; quoted line breaks make it too large."""
    return max(0, spark.read.text(path).count() - 1)


def blank_to_null(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def parse_time(c: str) -> Column:
    """Local wall clock from the first 19 characters, ``T`` or space; an offset behind them is ignored."""
    text = F.substring(F.regexp_replace(F.trim(c), "T", " "), 1, 19)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")]).cast("timestamp_ntz")


def unreadable(rows: DataFrame) -> DataFrame:
    """The delivered rows whose time ``to_ledger`` would refuse, for a table of their own."""
    return rows.where(parse_time("hkt_transaction_time").isNull())


def to_ledger(rows: DataFrame) -> DataFrame:
    """Ledger rows of delivered rows: amounts without sign, refunds by status or sign, blanks as null.

    A masked card number is never among the columns. A row without a readable time raises an error,
    for no window would ever hold it; ``unreadable`` tells such rows beforehand.
    """
    have = set(rows.columns)
    text = lambda c: blank_to_null(c) if c in have else F.lit(None).cast("string")
    amount = F.col("total_amount").try_cast("double")
    refused = F.raise_error(F.concat(F.lit("no readable time in row "), F.coalesce("payment_id", F.lit(""))))
    refund = F.upper(F.coalesce(text("transaction_status"), F.lit(""))).isin(*REFUND_STATUS) | (amount < 0)
    net = F.abs(F.col("net_amount").try_cast("double")) if "net_amount" in have else F.lit(None).cast("double")
    return rows.select(
        F.trim("payment_id").alias("source_txn_id"), F.trim("merchant_id").alias("merchant_id"), F.abs(amount).alias("total_amount"), net.alias("net_amount"),
        F.coalesce(parse_time("hkt_transaction_time"), refused.cast("timestamp_ntz")).alias("occurred_at"), refund.alias("is_refund"), *[text(c).alias(c) for c in TXN_FIELDS],
    )


def new_rows(rows: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """The first row, by ``order``, of each transaction that is not stored yet."""
    first = F.row_number().over(Window.partitionBy("source_txn_id").orderBy(order))
    return rows.withColumn("__k", first).where("__k = 1").drop("__k").join(stored.select("source_txn_id"), "source_txn_id", "left_anti")


def upsert_merchants(stored: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """Merchants after ``rows(merchant_id, ..., order)``: per column the last value that is not blank, else the stored one.

    Rows of transactions that are stored already count, too. A new merchant without an MCC has an empty one.
    """
    have = [c for c in MERCHANT_FIELDS if c in rows.columns]
    latest = rows.groupBy("merchant_id").agg(*[F.max_by(blank_to_null(c), F.when(blank_to_null(c).isNotNull(), F.col(order))).alias(f"new_{c}") for c in have])
    both = stored.join(latest, "merchant_id", "full")
    value = lambda c: F.coalesce(F.col(f"new_{c}") if c in have else F.lit(None), F.col(c) if c in stored.columns else F.lit(None), F.lit("") if c == "mcc" else F.lit(None))
    return both.select("merchant_id", *[value(c).cast("string").alias(c) for c in MERCHANT_FIELDS])


def dry_run(rows: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """(counts of rows and merchants, the ``top`` merchants by rows)."""
    totals = rows.agg(F.count("*").alias("rows"), F.countDistinct("merchant_id").alias("merchants"))
    return totals, rows.groupBy("merchant_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "merchant_id").limit(top)
