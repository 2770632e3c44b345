"""The domain tables, derived from the given order tables.

Line items become quotes: brands are instruments, ship dates are quote dates. One scan of the line
items and one partial aggregation feed market data, references, dividends, trades, revisions and the benchmarks of the
study; everything after it works on that daily table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import quarter_end
from tidemark.functions.stats import half_up

RUN_ID = "run-1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _units(x: Column, digits: int) -> Column:
    """Whole units of the last kept digit, so that sums are exact in any order."""
    return F.floor(x * 10.0 ** digits + 0.5)


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed mapping of brand number to desk, currency, quote and proxies."""
    n = F.col("n")

    def by_number(*steps: tuple[int, object], cast: str = "string") -> Column:
        """Value of the first step whose upper brand number is not below n."""
        out = F.when(n <= steps[0][0], F.lit(steps[0][1]))
        for upper, value in steps[1:]:
            out = out.when(n <= upper, F.lit(value))
        return out.cast(cast)

    brands = (table(spark, sf_dir, "part").select("p_brand").distinct()
              .withColumn("n", F.substring_index("p_brand", "#", -1).cast("int")))
    return brands.select(
        F.col("p_brand").alias("instrument_id"),
        F.concat(F.lit("Instrument "), n).alias("name"),
        by_number((15, "equity"), (20, "rates"), (23, "fx"), (25, "commodity")).alias("asset_class"),
        by_number((10, "UK Equities"), (15, "US Equities"), (20, "Rates"), (23, "FX"), (25, "Commodities")).alias("desk"),
        by_number((10, "GBP"), (15, "USD"), (18, "GBP"), (20, "USD"), (21, "USD"), (22, "EUR"), (23, "JPY"), (25, "USD"))
        .alias("currency"),
        by_number((15, "price"), (20, "yield_pct"), (23, "fx"), (25, "price")).alias("quote"),
        by_number((15, "px"), (18, "cb"), (20, "fed"), (23, "cb"), (25, "px")).alias("source"),
        F.concat(F.lit("T"), n).alias("ticker"),
        by_number((15, None), (16, 5.0), (17, 10.0), (18, 20.0), (19, 2.0), (20, 10.0), (25, None), cast="double")
        .alias("tenor_years"),
        by_number((10, 0.01), (25, 1.0), cast="double").alias("price_scale"),
        by_number((23, None), (24, "P24"), (25, "P25")).alias("returns_proxy"),
        by_number((23, None), (24, "fed:S24"), (25, "fed:S25")).alias("stress_proxy"))


def daily_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument_id, ticker, date, status, kept, sums...): the only scan of the line items; marks and benchmarks are sums of it.

    The join shuffles by part key (AQE splits a hot part). The aggregation has few buffers per row and is combined map-side into
    brands x part types x dates x four kinds of line.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.to_date("l_shipdate").alias("date"), F.col("l_linestatus").alias("status"), (F.col("l_returnflag") != "A").alias("kept"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("traded"), "l_discount",
        _units(F.col("l_extendedprice") / F.col("l_quantity"), 4).alias("unit"), _units(F.col("l_tax"), 2).alias("tax"),
        _units(F.col("l_discount"), 2).alias("disc"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("instrument_id"), F.col("p_type").alias("ticker"))
    return (li.join(part, "l_partkey").groupBy("instrument_id", "ticker", "date", "status", "kept")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("unit").alias("unit"), F.count("unit").alias("units"), F.sum("tax").alias("tax"), F.sum("disc").alias("disc"),
                 F.max("l_discount").alias("disc_max"), F.sum("traded").alias("traded")))


def daily_marks(kinds: DataFrame) -> DataFrame:
    """(instrument_id, date, ...): the kinds of line of each brand and day spread into columns."""
    def means(tag: str, keep: Column) -> list[Column]:
        total = lambda c: F.sum(F.when(keep, F.col(c)))
        return [(total(c) / total("n") / 10.0 ** digits).alias(f"{c}_{tag}") for c, digits in (("unit", 4), ("tax", 2), ("disc", 2))]

    return kinds.groupBy("instrument_id", "date").agg(
        *means("all", F.lit(True)), *means("o", F.col("status") == "O"), *means("f", F.col("status") == "F"), *means("kept", F.col("kept")),
        F.max("disc_max").alias("disc_max"), F.max("status").alias("status_max"), F.sum("traded").alias("traded"))


def mark(tag: str) -> Column:
    """Price, yield or FX level of one group of line items, by the instrument's quote."""
    return (F.when(F.col("quote") == "price", half_up(F.col(f"unit_{tag}"), 6))
            .when(F.col("quote") == "yield_pct", half_up(1 + 100 * F.col(f"tax_{tag}"), 6))
            .otherwise(half_up(0.5 + 10 * F.col(f"disc_{tag}"), 6)))


def market_data(marks: DataFrame, dim: DataFrame, tag: str = "all") -> DataFrame:
    rows = marks.filter(F.col(f"unit_{tag}").isNotNull()).join(dim.select("instrument_id", "quote"), "instrument_id")
    return rows.select("instrument_id", "date", mark(tag).alias("close"), mark(tag).alias("adj_close"),
                       F.concat(F.lit("src-"), F.col("status_max")).alias("fetch_id"), F.lit(RUN_ID).alias("run_id"))


def raw_quotes(marks: DataFrame, dim: DataFrame) -> DataFrame:
    """(source, ticker, date, close, adj_close, dividend, fetch_id, load_seq): what a vendor file would hold.

    Home equities are quoted in pence. Every series also arrives as cross-check and proxy tickers where
    an instrument asks for them.
    """
    rows = marks.join(dim, "instrument_id")
    fetch = F.concat(F.lit("src-"), F.col("status_max")).alias("fetch_id")
    level = half_up(mark("all") / F.col("price_scale"), 6)
    paid = F.when((F.col("asset_class") == "equity") & (F.col("disc_max") >= 0.1), half_up(0.01 * level, 6)).otherwise(0.0)
    own = rows.select("source", "ticker", "date", level.alias("close"), level.alias("adj_close"), paid.alias("dividend"),
                      fetch, F.lit(1).alias("load_seq"))
    return own


def second_sources(marks: DataFrame, dim: DataFrame) -> DataFrame:
    """Raw series that serve as cross-checks and proxies, same columns as :func:`raw_quotes`."""
    rows = marks.join(dim.select("instrument_id", "quote", "returns_proxy", "stress_proxy", "asset_class"), "instrument_id")
    fetch = F.concat(F.lit("src-"), F.col("status_max")).alias("fetch_id")

    def take(keep: Column, tag: str, source: Column, ticker: Column) -> DataFrame:
        return rows.filter(keep & F.col(f"unit_{tag}").isNotNull()).select(
            source.alias("source"), ticker.alias("ticker"), "date", mark(tag).alias("close"), mark(tag).alias("adj_close"),
            F.lit(0.0).alias("dividend"), fetch, F.lit(1).alias("load_seq"))

    checks = take(F.col("asset_class") == "fx", "o", F.lit("px"), F.concat(F.lit("X"), F.substring_index("instrument_id", "#", -1)))
    proxies = take(F.col("returns_proxy").isNotNull(), "f", F.lit("px"), F.col("returns_proxy"))
    stress = take(F.col("stress_proxy").isNotNull(), "o", F.substring_index("stress_proxy", ":", 1),
                  F.substring_index("stress_proxy", ":", -1))
    return checks.unionByName(proxies).unionByName(stress)


def cross_checks(dim: DataFrame) -> DataFrame:
    """(instrument_id, source, ticker): the second source expected for each FX instrument."""
    return dim.filter(F.col("asset_class") == "fx").select(
        "instrument_id", F.lit("px").alias("source"),
        F.concat(F.lit("X"), F.substring_index("instrument_id", "#", -1)).alias("ticker"))


def trades(marks: DataFrame) -> DataFrame:
    """One net trade per instrument and date."""
    return marks.filter("traded <> 0").select(
        F.concat(F.lit("T"), F.date_format("date", "yyyyMMdd"), F.lit("-"), F.col("instrument_id")).alias("trade_id"),
        F.col("date").alias("trade_date"), "instrument_id", F.col("traded").alias("quantity"), F.lit(RUN_ID).alias("run_id"))


def lineage(marks: DataFrame) -> DataFrame:
    """One record per fetch, with the number of rows it delivered."""
    return (marks.groupBy(F.concat(F.lit("src-"), F.col("status_max")).alias("fetch_id"))
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .select("fetch_id", F.lit(RUN_ID).alias("run_id"), F.col("fetch_id").alias("source"),
                    F.sha2("fetch_id", 256).alias("sha256"), "n_rows"))


def disclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(period_end, six categories): quarter averages of four customer segments, with a diversification effect."""
    names = {"AUTOMOBILE": "interest_rates", "BUILDING": "equity_prices", "FURNITURE": "currency_rates",
             "HOUSEHOLD": "commodity_prices"}
    orders = table(spark, sf_dir, "orders").select("o_custkey", quarter_end(F.to_date("o_orderdate")).alias("period_end"), "o_totalprice")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    wide = orders.join(customers, "o_custkey").groupBy("period_end").agg(*[
        half_up(F.avg(F.when(F.col("c_mktsegment") == seg, F.col("o_totalprice"))) / 1e4, 0).alias(cat)
        for seg, cat in names.items()])
    parts = sum((F.col(c) for c in names.values()), F.lit(0.0))
    div = -half_up(parts * 0.4, 0)
    return (wide.withColumn("diversification", div).withColumn("total", parts + F.col("diversification"))
            .filter(F.col("total").isNotNull()))


# Fixed mapping of part type to benchmark category.
BENCHMARK_CATEGORY = {"STANDARD": "interest_rates", "ECONOMY": "equity_prices", "MEDIUM": "currency_rates", "PROMO": "commodity_prices"}


def benchmarks(kinds: DataFrame) -> DataFrame:
    """(date, ticker, close): daily average unit price of four part types, the benchmark of each category. Sums of :func:`daily_kinds`, which are whole units, so exact."""
    mean = F.sum("unit") / F.sum("units") / 10.0 ** 4
    return kinds.filter(F.col("ticker").isin(*BENCHMARK_CATEGORY)).groupBy("date", "ticker").agg(half_up(mean, 6).alias("close"))
