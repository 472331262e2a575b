"""Scans of Parquet, CSV and JSON, and adapters from the driver's tables to panel shapes.

Missing numbers are NULL from the scan on: NaN is turned to NULL here, so that averages skip it and
comparisons with it are not true.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelworks.sources.durable import durable


def scan(spark: SparkSession, sf_dir: str, name: str, *wanted: str) -> DataFrame:
    """Projected Parquet scan; of ``wanted`` the columns that are present, all if none are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have]) if wanted else df


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def scan_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def newest_run(df: DataFrame, run: str = "run") -> DataFrame:
    """The rows of the newest run of a table laid out by run: files of older runs are pruned, not read."""
    newest = df.agg(F.max(run)).first()[0]
    return df.where(F.col(run) == newest) if newest is not None else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def computed_once(spark: SparkSession, path: str, build, rebuild: bool = False) -> DataFrame:
    """The table at ``path``, built and written first if it is not there or is to be rebuilt.

    Spark's success marker tells a whole table from one whose job was lost half-way.
    """
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if rebuild or not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def named(columns: list[str], prefix: str = "", part: str = "") -> list[str]:
    """Columns by prefix and by a part of their name, each once, in their order."""
    return list(dict.fromkeys(c for c in columns if c.startswith(prefix) and part in c))


def as_float(df: DataFrame, columns: list[str]) -> DataFrame:
    """Single precision, for tables of features to be stored."""
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds columns that a source lacks as typed NULLs."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def nan_to_null(df: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")).cast(k) for c, k in kinds.items() if isinstance(k, T.DoubleType | T.FloatType)})


def number(column: str) -> Column:
    """A number or NULL, whatever text it is in."""
    return F.nanvl(F.col(column).try_cast("double"), F.lit(None).cast("double"))


def session_day(column: str, zone: str | None = None) -> Column:
    """The day of a time stamp: by the wall clock, or in ``zone`` if given."""
    col = F.col(column)
    return F.to_date(F.from_utc_timestamp(col, zone) if zone else col)


def name_rules(columns: list[str]) -> dict[str, list[str]]:
    """Feature columns by their names: levels of outside series, macro columns, labels and the rest."""
    own = ("D_", "X_", "R_", "MKT_")
    labels = [c for c in columns if c.startswith("label_")]
    levels = [c for c in columns if c.endswith(("_close", "_stale")) and not c.startswith(own)]
    macro = [c for c in columns if c.startswith("MKT_") or c.startswith("X_rel") or (c.endswith("_ret_1d") and c[: -len("_ret_1d")].isupper())]
    keys = ("timestamp", "ts", "symbol", "open", "high", "low", "close", "volume")
    return {"labels": labels, "levels": levels, "macro": macro, "features": [c for c in columns if c not in {*labels, *levels, *keys}]}


def assert_no_label_leak(columns: list[str]) -> None:
    leaks = [c for c in columns if c.startswith("label_")]
    if leaks:
        raise ValueError(f"labels among the features: {leaks}")


# Adapters


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars (symbol, ts, open, high, low, close, volume) of part brands.

    A bar opens and closes with its first and last line by (l_shipdate, l_orderkey, l_linenumber,
    l_extendedprice, l_suppkey). Extremes by such a key are aggregated by sorting, so only lines of orders
    that open or close a day of a bar's symbol at its week's ends go that way; all lines are summed by
    hashing, into a row a symbol and ship date.
    """
    items = scan(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = scan(spark, sf_dir, "part", "p_partkey", "p_brand")
    order = F.coalesce("l_orderkey", F.lit(-(1 << 63)))  # missing ones come first; taken for that key here, they bring a few lines more
    line = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey")

    week = F.to_date(F.date_trunc("week", "l_shipdate"))  # of days and of few lines only: slow beside what a line takes otherwise

    def priced(items: DataFrame) -> DataFrame:
        return items.join(parts, items["l_partkey"] == parts["p_partkey"]).withColumns({"symbol": F.col("p_brand"), "px": F.col("l_extendedprice") / F.col("l_quantity")})

    days = priced(items).groupBy("symbol", "l_shipdate").agg(F.max("px").alias("high"), F.min("px").alias("low"), F.sum("l_quantity").alias("volume"), F.min(order).alias("first"), F.max(order).alias("last"))
    weeks = durable(days.groupBy("symbol", week.alias("ts")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"), F.min(F.struct("l_shipdate", "first"))["first"].alias("first"), F.max(F.struct("l_shipdate", "last"))["last"].alias("last")))
    orders = weeks.select(F.explode(F.array("first", "last")).alias("order")).distinct()
    ends = priced(items.join(orders, order == orders["order"], "left_semi")).groupBy("symbol", week.alias("ts")).agg(F.min_by("px", line).alias("open"), F.max_by("px", line).alias("close"))
    same = weeks["symbol"].eqNullSafe(ends["symbol"]) & weeks["ts"].eqNullSafe(ends["ts"])
    return weeks.join(ends, same).select(weeks["symbol"], weeks["ts"], "open", "high", "low", "close", "volume")


def day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, symbol, value): the mean event value of each user and day."""
    events = scan(spark, sf_dir, "events", "ts", "user_id", "value")
    return events.groupBy(F.to_date("ts").alias("ts"), F.col("user_id").alias("symbol")).agg(F.round(F.avg("value"), 9).alias("value"))


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p, y): a score in (0, 1) from the length of labelled documents, and their quality."""
    docs = scan(spark, sf_dir, "documents", "doc_id", "n_chars")
    labels = scan(spark, sf_dir, "labels", "doc_id", "quality")
    n = F.col("n_chars").cast("double")
    return docs.join(labels, "doc_id").select("doc_id", (n / (n + 1500.0)).alias("p"), F.col("quality").cast("long").alias("y"))


def sessions(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The session axis (ts, sidx from 0): sorted distinct time stamps, one row each, small by nature."""
    return df.select(ts).distinct().withColumn("sidx", F.row_number().over(Window.orderBy(ts)) - 1)
