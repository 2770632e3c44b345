"""How much of disclosed VaR is market volatility.

Series are daily and few; every ordered pass is over one category's calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from tidemark.config import StudyRules, normal_quantile
from tidemark.functions import dates as D
from tidemark.functions.stats import correlation as correlate
from tidemark.functions.stats import divide, fisher_bound, slope

EXACT = "decimal(38,20)"  # of running sums


def benchmark_panel(raw: DataFrame, categories: dict[str, str]) -> DataFrame:
    """(date, category, level): mean of duplicate quotes, tickers renamed."""
    names = F.create_map(*[F.lit(v) for pair in categories.items() for v in pair])
    return (raw.groupBy("date", names[F.col("ticker")].alias("category")).agg(F.avg("close").alias("level"))
            .filter("category is not null"))


def daily_moves(levels: DataFrame, rules: StudyRules) -> DataFrame:
    """(date, category, move) on each series' own dates: points for rates, logs otherwise."""
    before = F.lag("level").over(W.partitionBy("category").orderBy("date"))
    move = F.when(F.col("category").isin(*rules.absolute_moves), F.col("level") - before).otherwise(F.ln(F.col("level") / before))
    return levels.select("date", "category", move.alias("move"))


def running(rows: DataFrame, keys: list[str], order: str, **terms: Column) -> DataFrame:
    """``rows`` with the running sum of each term over ``order``, exact: terms are decimals, so no error gathers and differences lose nothing.

    A trailing window of any length is then the difference of two rows, found by a lag: the cost is linear in the rows.
    """
    along = W.partitionBy(*keys).orderBy(order)
    return rows.select("*", *(F.sum(F.coalesce(term.cast(EXACT), F.lit(0).cast(EXACT))).over(along.rowsBetween(W.unboundedPreceding, 0)).alias(f"_{name}") for name, term in terms.items()))


def over_last(name: str, n: int, along: WindowSpec) -> Column:
    """The sum of a term of :func:`running` over the last ``n`` rows."""
    total = F.col(f"_{name}")
    return (total - F.coalesce(F.lag(total, n).over(along), F.lit(0).cast(EXACT))).cast("double")


def trailing_vol(levels: DataFrame, rules: StudyRules) -> DataFrame:
    """(window, date, category, vol): trailing sample deviation per window.

    Rows of the joint calendar count in the window even where a series is missing; the minimum counts
    real moves.
    """
    calendar = levels.select("date").distinct()
    dense = calendar.withColumn("category", F.explode(F.array(*[F.lit(c) for c in rules.categories])))
    rows = dense.join(daily_moves(levels, rules), ["date", "category"], "left")
    x, along, out = F.col("move"), W.partitionBy("category").orderBy("date"), []
    sums = running(rows, ["category"], "date", n=x.isNotNull().cast("int"), x=x, xx=x * x)
    for name, n in rules.windows:
        count, sx, sxx = (over_last(t, n, along) for t in ("n", "x", "xx"))
        deviation = F.sqrt(F.greatest(F.try_divide(sxx - F.try_divide(sx * sx, count), count - 1), F.lit(0.0)))
        out.append(F.struct(F.lit(name).alias("window"), F.when((count >= int(n * rules.min_share)) & (count > 1), deviation).alias("vol")))
    wide = sums.select("date", "category", *[c.alias(f"v{i}") for i, c in enumerate(out)])
    long = wide.select("date", "category", F.explode(F.array(*[F.col(f"v{i}") for i in range(len(out))])).alias("v"))
    return long.select(F.col("v.window").alias("window"), "date", "category", F.col("v.vol").alias("vol"))


def quarterly_vol(vol: DataFrame) -> DataFrame:
    """(window, period_end, category, vol): mean of the daily values, labelled by quarter end."""
    return vol.groupBy("window", D.quarter_end(F.col("date")).alias("period_end"), "category").agg(F.avg("vol").alias("vol"))


def long_var(quarters: DataFrame, rules: StudyRules) -> DataFrame:
    return quarters.unpivot(["period_end"], list(rules.categories), "category", "var")


def vol_fit(quarters: DataFrame, vols: DataFrame, rules: StudyRules) -> DataFrame:
    """Correlation of changes and of levels, and elasticity, per category and window (X11; J10, W14, W15, A17, A18).

    Changes count only between consecutive quarters. Where the disclosed VaR never changes, its correlations are NaN.
    """
    both = (long_var(quarters, rules).join(vols, ["period_end", "category"])
            .select("category", "window", "period_end", F.ln("var").alias("v"), F.ln("vol").alias("s"))
            .filter("v is not null and s is not null"))
    order = W.partitionBy("category", "window").orderBy("period_end")
    steps = both.withColumn("gap", F.date_diff("period_end", F.lag("period_end").over(order)))
    near = F.col("gap").between(80, 100)
    changes = steps.withColumn("dv", F.when(near, F.col("v") - F.lag("v").over(order))).withColumn(
        "ds", F.when(near, F.col("s") - F.lag("s").over(order)))
    return (changes.groupBy("category", "window")
            .agg(F.count("dv").alias("quarters"), correlate(F.col("dv"), F.col("ds")).alias("corr_changes"),
                 correlate(F.col("v"), F.col("s")).alias("corr_levels"), slope(F.col("dv"), F.col("ds")).alias("elasticity"))
            .filter(F.col("quarters") >= rules.min_quarters))


def with_interval(fit: DataFrame, rules: StudyRules) -> DataFrame:
    """Add the 95% interval of the correlation."""
    z = rules.interval_z
    return (fit.withColumn("ci_lo", fisher_bound(F.col("corr_changes"), F.col("quarters"), -z))
            .withColumn("ci_hi", fisher_bound(F.col("corr_changes"), F.col("quarters"), z)))


def best_windows(fit: DataFrame) -> DataFrame:
    """(category, window, corr_changes, overlap): best window, and whether all windows' intervals overlap.

    NaN counts as the largest; of equal correlations the window whose name sorts last is best.
    """
    return (fit.groupBy("category").agg(F.max(F.struct("corr_changes", "window")).alias("b"),
                                        (F.max("ci_lo") <= F.min("ci_hi")).alias("overlap"))
            .select("category", F.col("b.window").alias("window"), F.col("b.corr_changes").alias("corr_changes"), "overlap"))


def implied_index(quarters: DataFrame, vols: DataFrame, best: DataFrame, rules: StudyRules) -> DataFrame:
    """VaR / vol of the best window, rebased to 100 at its first quarter (X14, W16). Infinite in a quarter without volatility, NaN if that is the first."""
    ratio = (long_var(quarters, rules).join(best.select("category", "window"), "category").join(vols, ["category", "window", "period_end"])
             .select("category", "period_end", divide(F.col("var"), F.col("vol")).alias("e")).filter("e is not null"))
    first = F.first("e").over(W.partitionBy("category").orderBy("period_end").rowsBetween(W.unboundedPreceding, W.currentRow))
    return ratio.select("category", "period_end", divide(100 * F.col("e"), first).alias("implied"))


def rolling_correlation(levels: DataFrame, a: str, b: str, rules: StudyRules) -> DataFrame:
    """(date, corr): correlation of a's log returns with minus b's changes over trailing joint rows.

    Moves are row to row on the joint index here, and rows with a missing move are dropped first.
    The joint index is one row per date.
    """
    wide = levels.groupBy("date").agg(F.max(F.when(F.col("category") == a, F.col("level"))).alias("a"),
                                      F.max(F.when(F.col("category") == b, F.col("level"))).alias("b"))
    order = W.orderBy("date")
    moves = wide.select("date", F.ln(F.col("a") / F.lag("a").over(order)).alias("x"), (F.lag("b").over(order) - F.col("b")).alias("y")).filter(
        "x is not null and y is not null")
    x, y, n = F.col("x"), F.col("y"), rules.correlation_rows
    sums = running(moves, [], "date", n=F.lit(1), x=x, y=y, xx=x * x, yy=y * y, xy=x * y)
    count, sx, sy, sxx, syy, sxy = (over_last(t, n, order) for t in ("n", "x", "y", "xx", "yy", "xy"))
    spread = F.sqrt(F.greatest(count * sxx - sx * sx, F.lit(0.0))) * F.sqrt(F.greatest(count * syy - sy * sy, F.lit(0.0)))
    return sums.select("date", F.when(count >= rules.correlation_min_rows, F.try_divide(count * sxy - sx * sy, spread)).alias("corr"))


def diversification(quarters: DataFrame, correlation: DataFrame, rules: StudyRules) -> DataFrame:
    """(period_end, share, corr): cancelled share of the category sum, and the quarter's mean correlation."""
    total: Column = sum((F.col(c) for c in rules.categories), F.lit(0.0))
    shares = quarters.select("period_end", (-F.col("diversification") / total).alias("share"))
    mean = correlation.groupBy(D.quarter_end(F.col("date")).alias("period_end")).agg(F.avg("corr").alias("corr"))
    return shares.join(mean, "period_end", "left")


def diversification_summary(div: DataFrame) -> DataFrame:
    both = div.filter("share is not null and corr is not null")
    return both.agg(F.min("share").alias("lowest"), F.max("share").alias("highest"), correlate(F.col("share"), F.col("corr")).alias("corr"),
                    F.count(F.lit(1)).alias("quarters"))


def episodes(quarters: DataFrame, vols: DataFrame, pairs: DataFrame, rules: StudyRules) -> DataFrame:
    """Log change of VaR split into volatility and residual, per episode, category and window."""
    var = long_var(quarters, rules)
    side = lambda d, suffix: var.join(vols, ["period_end", "category"]).select(
        F.col("period_end").alias(d), "category", "window", F.col("var").alias(f"var_{suffix}"), F.col("vol").alias(f"vol_{suffix}"))
    both = pairs.join(side("from", "from"), "from").join(side("to", "to"), ["to", "category", "window"])
    d_var, d_vol = F.ln(F.col("var_to") / F.col("var_from")), F.ln(F.col("vol_to") / F.col("vol_from"))
    return both.select("name", "from", "to", "category", "window", "var_from", "var_to", F.expm1(d_var).alias("var_change_pct"),
                       F.expm1(d_vol).alias("vol_change_pct"), F.expm1(d_var - d_vol).alias("residual_pct"))


def residual_range(rows: DataFrame) -> DataFrame:
    """Residual range across windows."""
    return rows.groupBy("name", "category").agg(F.min("residual_pct").alias("lowest"), F.max("residual_pct").alias("highest"))


def yearly_means(quarters: DataFrame, columns: list[str]) -> DataFrame:
    """(year, columns): mean of each year's published quarters."""
    return quarters.groupBy(F.year("period_end").alias("year")).agg(*[F.avg(c).alias(c) for c in columns])


def yearly_extremes(quarters: DataFrame, rules: StudyRules, leader: str) -> DataFrame:
    """Years of the lowest and highest total, and the quarters ``leader`` is the largest category."""
    years = yearly_means(quarters, ["total"]).agg(F.min(F.struct("total", "year")).alias("lo"),
                                                  F.max(F.struct("total", (-F.col("year")).alias("y"), "year")).alias("hi"))
    rest = [c for c in rules.categories if c != leader]
    ahead = F.lit(True)
    for c in rest:
        before = rules.categories.index(c) < rules.categories.index(leader)
        ahead = ahead & ((F.col(leader) > F.col(c)) if before else (F.col(leader) >= F.col(c)))
    led = quarters.agg(F.count(F.when(ahead, 1)).alias("n"), F.count(F.lit(1)).alias("quarters"))
    return years.select(F.col("lo.year").alias("lowest_year"), F.col("lo.total").alias("lowest_total"), F.col("hi.year").alias("highest_year"),
                        F.col("hi.total").alias("highest_total"), led.select("n").scalar().alias("led"), led.select("quarters").scalar().alias("quarters"))


def normal_rescale(quarters: DataFrame, start: str, end: str, days: int = 10) -> DataFrame:
    """Mean total of exactly two quarters, rescaled from 95% one day to 99% ten days."""
    factor = normal_quantile(0.99) / normal_quantile(0.95)
    two = quarters.filter(F.col("period_end").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).agg(
        F.count(F.lit(1)).alias("n"), F.avg("total").alias("mean"))
    return two.filter("n = 2").select("mean", (F.col("mean") * factor).alias("one_day_99"), (F.col("mean") * factor * days ** 0.5).alias("rescaled"))
