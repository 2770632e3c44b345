"""Named SQL building blocks for the oracle queries, written against the given tables.

Formulated differently from the library where it matters: dense grids and as-of joins instead of
interval explodes, normalised weights instead of closed forms, plain range joins instead of laid-out ones.
"""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


def query(sql: str) -> str:
    """Prefix a statement with every building block it (transitively) uses."""
    order: list[str] = []

    def need(text: str) -> None:
        for word in re.findall(r"[a-z_][a-z_0-9]*", text):
            if word in PARTS and word not in order:
                need_one(word)

    def need_one(name: str) -> None:
        if name in order:
            return
        for word in re.findall(r"[a-z_][a-z_0-9]*", PARTS[name]):
            if word in PARTS and word != name and word not in order:
                need_one(word)
        order.append(name)

    need(sql)
    if not order:
        return half_up(sql)
    blocks = ",\n".join(f"{name} AS MATERIALIZED ({PARTS[name]})" for name in order)
    return half_up(f"WITH {blocks}\n{sql}")


def expand_calls(sql: str, name: str, write) -> str:
    """Replace every name(a, b) call by write(a, b); nested calls included."""
    i = 0
    while True:
        found = re.search(rf"(?<![a-z_]){name}\(", sql[i:])
        if not found:
            return sql
        j = i + found.start()
        depth, k, cut = 0, j + len(name), -1
        while True:
            ch = sql[k]
            depth += ch in "([{"
            depth -= ch in ")]}"
            if ch == "," and depth == 1:
                cut = k
            if depth == 0:
                break
            k += 1
        sql = sql[:j] + write(sql[j + len(name) + 1:cut].strip(), sql[cut + 1:k].strip()) + sql[k + 1:]
        i = j


def half_up(sql: str) -> str:
    """round(x, d) written out, because engines break exact ties differently."""
    return expand_calls(sql, "round", lambda x, d: f"(floor(({x}) * 1e{d} + 0.5) / 1e{d})")


def mark(tag: str) -> str:
    return (f"CASE quote WHEN 'price' THEN round(unit_{tag}, 6) WHEN 'yield_pct' THEN round(1 + 100 * tax_{tag}, 6) "
            f"ELSE round(0.5 + 10 * disc_{tag}, 6) END")


def millions(x: str) -> str:
    return f"round(({x}) / 1e6, 4)"


part("dim_t", """
SELECT p_brand AS instrument_id, 'Instrument ' || n AS name,
  CASE WHEN n <= 15 THEN 'equity' WHEN n <= 20 THEN 'rates' WHEN n <= 23 THEN 'fx' ELSE 'commodity' END AS asset_class,
  CASE WHEN n <= 10 THEN 'UK Equities' WHEN n <= 15 THEN 'US Equities' WHEN n <= 20 THEN 'Rates' WHEN n <= 23 THEN 'FX'
       ELSE 'Commodities' END AS desk,
  CASE WHEN n <= 10 THEN 'GBP' WHEN n <= 15 THEN 'USD' WHEN n <= 18 THEN 'GBP' WHEN n <= 21 THEN 'USD' WHEN n = 22 THEN 'EUR'
       WHEN n = 23 THEN 'JPY' ELSE 'USD' END AS currency,
  CASE WHEN n <= 15 THEN 'price' WHEN n <= 20 THEN 'yield_pct' WHEN n <= 23 THEN 'fx' ELSE 'price' END AS quote,
  CASE WHEN n <= 15 THEN 'px' WHEN n <= 18 THEN 'cb' WHEN n <= 20 THEN 'fed' WHEN n <= 23 THEN 'cb' ELSE 'px' END AS source,
  'T' || n AS ticker,
  CASE n WHEN 16 THEN 5.0 WHEN 17 THEN 10.0 WHEN 18 THEN 20.0 WHEN 19 THEN 2.0 WHEN 20 THEN 10.0 END::DOUBLE AS tenor_years,
  CASE WHEN n <= 10 THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END AS price_scale,
  CASE WHEN n >= 24 THEN 'P' || n END AS returns_proxy, CASE WHEN n >= 24 THEN 'fed:S' || n END AS stress_proxy,
  CASE WHEN n BETWEEN 21 AND 23 OR n <= 10 OR n BETWEEN 16 AND 18 THEN NULL ELSE 'Brand#21' END AS fx_id, n
FROM (SELECT DISTINCT p_brand, split_part(p_brand, '#', 2)::INT AS n FROM part)""")

def mean_units(x: str, digits: int, only: str = "") -> str:
    """Exact mean: whole units of the last kept digit are summed as integers."""
    keep = f" FILTER ({only})" if only else ""
    return f"sum(floor(({x}) * 1e{digits} + 0.5)::BIGINT){keep}::DOUBLE / count(*){keep} / 1e{digits}"


def means(tag: str, only: str = "") -> str:
    return (f"{mean_units('l_extendedprice / l_quantity', 4, only)} AS unit_{tag}, {mean_units('l_tax', 2, only)} AS tax_{tag}, "
            f"{mean_units('l_discount', 2, only)} AS disc_{tag}")


part("marks_t", f"""
SELECT p_brand AS instrument_id, l_shipdate::DATE AS date, {means('all')}, {means('o', "l_linestatus = 'O'")}, {means('f', "l_linestatus = 'F'")},
  {means('kept', "l_returnflag <> 'A'")}, max(l_discount) AS disc_max, max(l_linestatus) AS status_max,
  sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS traded
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")

part("raw_t", f"""
SELECT d.*, m.date, round(({mark('all')}) / price_scale, 6) AS level,
  CASE WHEN asset_class = 'equity' AND disc_max >= 0.1
       THEN round(0.01::DOUBLE * round(({mark('all')}) / price_scale, 6), 6) ELSE 0.0 END AS dividend,
  'src-' || status_max AS fetch_id
FROM marks_t m JOIN dim_t d USING (instrument_id)""")

part("market_t", """
SELECT instrument_id, date, level * price_scale AS close, level * price_scale AS adj_close, fetch_id FROM raw_t""")

part("kept_t", f"""
SELECT instrument_id, date, {mark('kept')} AS close FROM marks_t JOIN dim_t USING (instrument_id) WHERE unit_kept IS NOT NULL""")

part("refs_t", f"""
SELECT instrument_id, 'cross_check' AS purpose, 'px' AS source, 'X' || n AS ticker, date, {mark('o')} AS value
FROM marks_t JOIN dim_t USING (instrument_id) WHERE asset_class = 'fx' AND unit_o IS NOT NULL
UNION ALL SELECT instrument_id, 'return_proxy', 'px', returns_proxy, date, {mark('f')}
FROM marks_t JOIN dim_t USING (instrument_id) WHERE returns_proxy IS NOT NULL AND unit_f IS NOT NULL
UNION ALL SELECT instrument_id, 'stress_proxy', 'fed', split_part(stress_proxy, ':', 2), date, {mark('o')}
FROM marks_t JOIN dim_t USING (instrument_id) WHERE stress_proxy IS NOT NULL AND unit_o IS NOT NULL""")

part("divs_t", """
SELECT instrument_id, date AS ex_date, dividend * price_scale AS amount, fetch_id FROM raw_t WHERE dividend > 0""")

part("trades_t", """SELECT instrument_id, date AS trade_date, traded AS quantity FROM marks_t WHERE traded <> 0""")

part("days_t", """
SELECT date, row_number() OVER (ORDER BY date) - 1 AS ord FROM (
  SELECT date FROM market_t GROUP BY date HAVING count(*) >= 0.5 * (SELECT count(*) FROM dim_t) AND isodow(date) < 6)""")

part("run_t", """
SELECT max(date) AS d, max(ord) AS k, (SELECT date FROM days_t WHERE ord = (SELECT max(ord) - 1 FROM days_t)) AS prev FROM days_t""")

part("week_t", """
SELECT date, row_number() OVER (ORDER BY date) AS b FROM (
  SELECT unnest(generate_series((SELECT min(date) FROM market_t), (SELECT d FROM run_t), INTERVAL 1 DAY))::DATE AS date)
WHERE isodow(date) < 6""")

part("filled_t", """
SELECT g.instrument_id, g.date, o.close AS level
FROM (SELECT instrument_id, date, b FROM dim_t, week_t) g
ASOF JOIN (SELECT instrument_id, date, close, b FROM market_t JOIN week_t USING (date)) o
  ON g.instrument_id = o.instrument_id AND g.date >= o.date
WHERE g.b - o.b <= 5""")

part("levels_t", "SELECT ord, date, instrument_id, level FROM filled_t JOIN days_t USING (date)")

part("union_t", """
SELECT purpose, date, row_number() OVER (PARTITION BY purpose ORDER BY date) AS u FROM (
  SELECT purpose, date FROM refs_t WHERE date <= (SELECT d FROM run_t) UNION
  SELECT purpose, date FROM (SELECT unnest(['return_proxy', 'stress_proxy']) AS purpose), days_t)
WHERE purpose <> 'cross_check'""")

part("proxy_t", """
SELECT g.purpose, g.instrument_id, g.ord, g.date, o.value AS level
FROM (SELECT purpose, instrument_id, d.ord, date, u FROM union_t JOIN days_t d USING (date)
      JOIN (SELECT DISTINCT purpose, instrument_id FROM refs_t) USING (purpose)) g
ASOF JOIN (SELECT r.purpose, instrument_id, date, value, u FROM refs_t r JOIN union_t USING (purpose, date)) o
  ON g.purpose = o.purpose AND g.instrument_id = o.instrument_id AND g.date >= o.date
WHERE g.u - o.u <= 5""")


def returns_sql(proxy: str) -> str:
    return f"""
SELECT ord, date, instrument_id, r FROM (
  SELECT s.ord, s.date, s.instrument_id, CASE WHEN lag(s.ord) OVER w = s.ord - 1 THEN
    CASE WHEN own AND asset_class = 'equity' THEN ln((s.level + coalesce(amount, 0)) / lag(s.level) OVER w)
         WHEN own AND quote = 'yield_pct' THEN s.level - lag(s.level) OVER w
         ELSE ln(s.level / lag(s.level) OVER w) END END AS r
  FROM (SELECT ord, date, instrument_id, level, TRUE AS own FROM levels_t JOIN dim_t USING (instrument_id) WHERE returns_proxy IS NULL
        UNION ALL SELECT ord, date, instrument_id, level, FALSE FROM proxy_t WHERE purpose = '{proxy}') s
  JOIN dim_t USING (instrument_id)
  LEFT JOIN (SELECT instrument_id, ex_date AS date, sum(amount) AS amount FROM divs_t GROUP BY ALL) d USING (instrument_id, date)
  WINDOW w AS (PARTITION BY s.instrument_id ORDER BY s.ord)) WHERE r IS NOT NULL"""


part("rets_t", returns_sql("return_proxy"))
part("stress_rets_t", returns_sql("stress_proxy"))

part("moves_t", """
SELECT a.ord, a.date, a.instrument_id, a.r,
  CASE quote WHEN 'price' THEN a.r WHEN 'yield_pct' THEN -a.r * tenor_years / 100 ELSE -a.r END
    - CASE WHEN fx_id IS NULL THEN 0 ELSE f.r END AS x,
  (exp(CASE quote WHEN 'price' THEN 1e-4 WHEN 'yield_pct' THEN -1e-4 * tenor_years / 100 ELSE -1e-4 END) - 1) / 1e-4 * a.r
    + CASE WHEN fx_id IS NULL THEN 0 ELSE (exp(-1e-4) - 1) / 1e-4 * f.r END AS linear
FROM rets_t a JOIN dim_t USING (instrument_id) LEFT JOIN rets_t f ON f.ord = a.ord AND f.instrument_id = fx_id""")

part("cal_t", """
SELECT ord, date, complete, sum(complete::INT) OVER (ORDER BY ord) AS c FROM (
  SELECT ord, date, ord > 0 AND coalesce(n, 0) = (SELECT count(*) FROM dim_t) AS complete
  FROM days_t LEFT JOIN (SELECT ord, count(r) AS n FROM rets_t GROUP BY ord) USING (ord))""")

part("values_t", """
SELECT l.ord, l.date, l.instrument_id, l.level, d.desk,
  CASE WHEN quote = 'fx' THEN 1 / l.level
       ELSE (CASE quote WHEN 'price' THEN l.level ELSE exp(-l.level / 100 * tenor_years) END) / (CASE WHEN fx_id IS NULL THEN 1 ELSE f.level END) END
  AS unit_value
FROM levels_t l JOIN dim_t d USING (instrument_id) LEFT JOIN levels_t f ON f.ord = l.ord AND f.instrument_id = fx_id""")

part("daily_values_t", """
SELECT l.date, l.instrument_id, d.desk,
  CASE WHEN quote = 'fx' THEN 1 / l.level
       ELSE (CASE quote WHEN 'price' THEN l.level ELSE exp(-l.level / 100 * tenor_years) END) / (CASE WHEN fx_id IS NULL THEN 1 ELSE f.level END) END
  AS unit_value
FROM filled_t l JOIN dim_t d USING (instrument_id) LEFT JOIN filled_t f ON f.date = l.date AND f.instrument_id = fx_id""")

part("positions_t", """
SELECT w.date AS as_of, w.instrument_id, t.quantity
FROM (SELECT date, instrument_id FROM week_t, dim_t) w
ASOF JOIN (SELECT instrument_id, trade_date, sum(quantity) OVER (PARTITION BY instrument_id ORDER BY trade_date) AS quantity FROM trades_t) t
  ON w.instrument_id = t.instrument_id AND w.date >= t.trade_date""")

part("hold_t", """
SELECT ord, d.date, p.instrument_id, p.quantity FROM (
  SELECT ord, date, (SELECT max(as_of) FROM positions_t WHERE as_of <= date) AS as_of FROM days_t) d JOIN positions_t p USING (as_of)""")

part("book_t", """
SELECT ord AS k, g.date, instrument_id, g.desk, coalesce(quantity, 0) AS quantity, unit_value,
  CASE WHEN coalesce(quantity, 0) = 0 THEN 0 ELSE quantity * unit_value END AS mv
FROM (SELECT ord, date, instrument_id, desk FROM days_t, dim_t WHERE date <= (SELECT d FROM run_t)) g
LEFT JOIN (SELECT ord, instrument_id, quantity FROM hold_t) USING (ord, instrument_id)
LEFT JOIN (SELECT ord, instrument_id, unit_value FROM values_t) USING (ord, instrument_id)""")

part("scen_t", "SELECT m.ord AS s, m.date, instrument_id, exp(x) - 1 AS growth, linear, r FROM moves_t m JOIN cal_t USING (ord) WHERE complete")

part("today_t", "SELECT * FROM book_t WHERE k = (SELECT k FROM run_t)")

part("desk_cube_t", """
SELECT k, desk, s, date, pnl, linear, row_number() OVER (PARTITION BY desk ORDER BY s DESC) - 1 AS age, count(*) OVER (PARTITION BY desk) AS n
FROM (SELECT t.k, desk, s, min(sc.date) AS date, CASE WHEN count(mv) = count(*) THEN sum(mv * growth) END AS pnl, CASE WHEN count(mv) = count(*) THEN sum(mv * linear) END AS linear
      FROM today_t t JOIN scen_t sc USING (instrument_id) WHERE s BETWEEN greatest(1, t.k - 1259) AND t.k GROUP BY ALL)""")

part("total_cube_t", """
SELECT s, date, pnl, linear, row_number() OVER (ORDER BY s DESC) - 1 AS age FROM (
  SELECT s, min(date) AS date, CASE WHEN count(pnl) = count(*) THEN sum(pnl) END AS pnl, CASE WHEN count(pnl) = count(*) THEN sum(linear) END AS linear FROM desk_cube_t GROUP BY s)""")

part("cube_t", """
SELECT k, s, pnl, linear, row_number() OVER (PARTITION BY k ORDER BY s DESC) - 1 AS age FROM (
  SELECT b.k, s, CASE WHEN count(mv) = count(*) THEN sum(mv * growth) END AS pnl, CASE WHEN count(mv) = count(*) THEN sum(mv * linear) END AS linear
  FROM book_t b JOIN scen_t sc ON sc.instrument_id = b.instrument_id AND s BETWEEN greatest(1, b.k - 1259) AND b.k GROUP BY 1, 2)""")


def tail_sql(source: str, groups: str) -> str:
    """VaR95, VaR99, ES975 per method from (groups, s, pnl, linear, age)."""
    part_by = f"PARTITION BY {groups}, method" if groups else "PARTITION BY method"
    g = f"{groups}, " if groups else ""
    return f"""
WITH w AS (
  SELECT {g}s, pnl, linear, method, kind, pow(decay, age) / sum(pow(decay, age)) OVER ({part_by}) AS w
  FROM {source}, (VALUES ('hs_equal', 'history', 1.0::DOUBLE), ('hs_weighted', 'history', 0.995::DOUBLE), ('parametric', 'normal', 0.94::DOUBLE))
       m(method, kind, decay)),
c AS (SELECT *, -pnl AS loss, sum(w) OVER ({part_by} ORDER BY -pnl, s ROWS UNBOUNDED PRECEDING) AS cw FROM w WHERE kind = 'history'),
p AS (SELECT *, coalesce(lag(cw) OVER ({part_by} ORDER BY loss, s), 0) AS cp FROM c)
SELECT {g}method, unnest(['VaR95', 'VaR99', 'ES975']) AS measure, unnest([
  coalesce(min(CASE WHEN cw >= 0.95 - 1e-12 THEN loss END), max(loss)), coalesce(min(CASE WHEN cw >= 0.99 - 1e-12 THEN loss END), max(loss)),
  sum(loss * CASE WHEN cp >= 0.975 - 1e-12 THEN w WHEN cw >= 0.975 - 1e-12 THEN greatest(cw - 0.975, 0) ELSE 0 END) / (1 - 0.975)]) AS value
FROM p GROUP BY {g}method
UNION ALL
SELECT {g}method, unnest(['VaR95', 'VaR99', 'ES975']), unnest([1.6448536269514715::DOUBLE, 2.3263478740408408::DOUBLE,
  (0.058445069805035436::DOUBLE / (1 - 0.975))]) * sqrt(sum(w * linear * linear))
FROM w WHERE kind = 'normal' GROUP BY {g}method"""


part("totals_t", tail_sql("total_cube_t", ""))
part("forecast_t", tail_sql("cube_t", "k"))

part("desk_tail_t", """
SELECT *, coalesce(lag(cw) OVER (PARTITION BY desk ORDER BY loss, s), 0) AS cp FROM (
  SELECT *, -pnl AS loss, sum(1.0::DOUBLE / n) OVER (PARTITION BY desk ORDER BY -pnl, s ROWS UNBOUNDED PRECEDING) AS cw FROM desk_cube_t)""")

part("total_tail_t", """
SELECT *, coalesce(lag(cw) OVER (ORDER BY loss, s), 0) AS cp, 1.0::DOUBLE / n AS w FROM (
  SELECT s, date, pnl, -pnl AS loss, n, sum(1.0::DOUBLE / n) OVER (ORDER BY -pnl, s ROWS UNBOUNDED PRECEDING) AS cw
  FROM (SELECT *, count(*) OVER () AS n FROM total_cube_t))""")

part("desks_t", """
SELECT desk, a.var99 AS "VaR99_standalone", b.es AS "ES975_contribution" FROM
  (SELECT desk, min(CASE WHEN cw >= 0.99 - 1e-12 THEN loss END) AS var99 FROM desk_tail_t GROUP BY desk) a
JOIN (SELECT desk, sum(-d.pnl * CASE WHEN cp >= 0.975 - 1e-12 THEN w WHEN cw >= 0.975 - 1e-12 THEN greatest(cw - 0.975, 0) ELSE 0 END) / (1 - 0.975) AS es
      FROM desk_cube_t d JOIN total_tail_t USING (s) GROUP BY desk) b USING (desk)""")

part("risk_t", """
SELECT method, measure, 'total' AS scope, 'book' AS scope_id, value FROM totals_t
UNION ALL SELECT 'hs_equal', 'VaR99_standalone', 'desk', desk, "VaR99_standalone" FROM desks_t
UNION ALL SELECT 'hs_equal', 'ES975_contribution', 'desk', desk, "ES975_contribution" FROM desks_t""")

part("bt_t", """
SELECT d.date, f.method, max(value) FILTER (measure = 'VaR95') AS var95, max(value) FILTER (measure = 'VaR99') AS var99, min(p.pnl) AS pnl
FROM cal_t d JOIN forecast_t f ON f.k = d.ord - 1
JOIN (SELECT m.ord, CASE WHEN count(mv) = count(*) THEN sum(mv * (exp(x) - 1)) END AS pnl FROM book_t b JOIN moves_t m ON m.ord = b.k + 1 AND m.instrument_id = b.instrument_id GROUP BY 1) p
  ON p.ord = d.ord
WHERE d.complete AND d.ord - 1 IN (SELECT ord FROM hold_t) GROUP BY 1, 2""")

part("exc_t", """
SELECT method, date, pnl, var95, var99, level, p, coalesce((-pnl > CASE level WHEN '99' THEN var99 ELSE var95 END)::INT, 0) AS e
FROM bt_t, (VALUES ('99', 0.01::DOUBLE), ('95', 0.05::DOUBLE)) l(level, p)""")

part("counts_t", """
SELECT method, level, p, count(*) AS n, sum(e)::BIGINT AS exceptions,
  count(*) FILTER (b = 0 AND e = 0) AS n00, count(*) FILTER (b = 0 AND e = 1) AS n01,
  count(*) FILTER (b = 1 AND e = 0) AS n10, count(*) FILTER (b = 1 AND e = 1) AS n11
FROM (SELECT *, lag(e) OVER (PARTITION BY method, level ORDER BY date) AS b FROM exc_t) GROUP BY 1, 2, 3""")

part("lr_t", """
SELECT *, n * p AS expected,
  -2 * (xly(n - exceptions, 1 - p) + xly(exceptions, p) - xly(n - exceptions, 1 - exceptions / n) - xly(exceptions, exceptions / n)) AS kupiec_lr,
  CASE WHEN n01 + n11 = 0 THEN 0 ELSE -2 * (xly(n00 + n10, 1 - q) + xly(n01 + n11, q)
    - xly(n00, 1 - q0) - xly(n01, q0) - xly(n10, 1 - q1) - xly(n11, q1)) END AS christoffersen_lr
FROM (SELECT *, (n01 + n11) / (n00 + n01 + n10 + n11) AS q, CASE WHEN n00 + n01 > 0 THEN n01 / (n00 + n01) ELSE 0 END AS q0,
        CASE WHEN n10 + n11 > 0 THEN n11 / (n10 + n11) ELSE 0 END AS q1 FROM counts_t)""")


# xly(a, b) is a * ln(b) with 0 at a = 0, written out because a view cannot define a macro.
PARTS["lr_t"] = expand_calls(PARTS["lr_t"], "xly", lambda a, b: f"(CASE WHEN ({a}) = 0 THEN 0 ELSE ({a}) * ln({b}) END)")


def chi2_1(x: str) -> str:
    """Upper tail of chi-square(1) through the incomplete-gamma series of erf, as a list sum."""
    z = f"sqrt(({x}) / 2)"
    series = f"list_sum(list_transform(range(0, 200), lambda i: exp((2 * i + 1) * ln({z}) - ({x}) / 2 - lgamma(i + 1.5))))"
    return f"CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) <= 0 THEN 1.0 WHEN ({x}) > 70 THEN 0.0 ELSE greatest(1 - {series}, 0) END"


def binom_cdf(x: str, n: str, p: float = 0.01) -> str:
    return (f"list_sum(list_transform(range(0, ({x})::BIGINT + 1), lambda i: exp(lgamma(({n}) + 1.0) - lgamma(i + 1.0) - lgamma(({n}) - i + 1.0) "
            f"+ i * ln({p}) + (({n}) - i) * ln(1 - {p}))))")


part("last250_t", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY date DESC) AS rn FROM bt_t) WHERE rn <= 250""")

part("zone_t", f"""
SELECT method, last_n, last_exceptions, zone, CASE WHEN last_n = 250 THEN CASE zone WHEN 'green' THEN 0.0 WHEN 'red' THEN 1.0
  ELSE CASE last_exceptions WHEN 5 THEN 0.40 WHEN 6 THEN 0.50 WHEN 7 THEN 0.65 WHEN 8 THEN 0.75 WHEN 9 THEN 0.85 END END END::DOUBLE AS plus_factor
FROM (SELECT *, CASE WHEN last_exceptions > 0 AND cdf >= 0.9999 - 1e-9 THEN 'red' WHEN cdf >= 0.95 - 1e-9 THEN 'yellow' ELSE 'green' END AS zone
  FROM (SELECT *, {binom_cdf('last_exceptions', 'last_n')} AS cdf FROM (
    SELECT method, count(*) AS last_n, sum(coalesce((-pnl > var99)::INT, 0))::BIGINT AS last_exceptions FROM last250_t GROUP BY 1)))""")

part("books4_t", """
SELECT p, l, instrument_id, CASE WHEN (CASE p WHEN 1 THEN q1 ELSE q0 END) = 0 THEN 0 ELSE (CASE p WHEN 1 THEN q1 ELSE q0 END) * (CASE l WHEN 1 THEN v1 ELSE v0 END) END AS mv
FROM (SELECT d.instrument_id,
   coalesce((SELECT quantity FROM hold_t h WHERE h.instrument_id = d.instrument_id AND h.ord = (SELECT k FROM run_t)), 0) AS q1,
   coalesce((SELECT quantity FROM hold_t h WHERE h.instrument_id = d.instrument_id AND h.ord = (SELECT k - 1 FROM run_t)), 0) AS q0,
   (SELECT unit_value FROM values_t v WHERE v.instrument_id = d.instrument_id AND v.ord = (SELECT k FROM run_t)) AS v1,
   (SELECT unit_value FROM values_t v WHERE v.instrument_id = d.instrument_id AND v.ord = (SELECT k - 1 FROM run_t)) AS v0
 FROM dim_t d), (VALUES (0), (1)) a(p), (VALUES (0), (1)) b(l)""")

part("coal_t", """
SELECT p, l, w, s, sc.date, CASE WHEN count(mv) = count(*) THEN sum(mv * growth) END AS pnl
FROM books4_t JOIN scen_t sc USING (instrument_id), (VALUES (0), (1)) c(w)
WHERE s BETWEEN greatest(1, (SELECT k FROM run_t) - 1 + w - 1259) AND (SELECT k FROM run_t) - 1 + w GROUP BY ALL""")

part("coal_tail_t", """
SELECT *, coalesce(lag(cw) OVER (PARTITION BY p, l, w ORDER BY loss, s), 0) AS cp FROM (
  SELECT *, -pnl AS loss, 1.0::DOUBLE / n AS wt, sum(1.0::DOUBLE / n) OVER (PARTITION BY p, l, w ORDER BY -pnl, s ROWS UNBOUNDED PRECEDING) AS cw
  FROM (SELECT *, count(*) OVER (PARTITION BY p, l, w) AS n FROM coal_t))""")

part("coal_value_t", """
SELECT p, l, w, min(CASE WHEN cw >= 0.99 - 1e-12 THEN loss END) AS "VaR99",
  sum(loss * CASE WHEN cp >= 0.975 - 1e-12 THEN wt WHEN cw >= 0.975 - 1e-12 THEN greatest(cw - 0.975, 0) ELSE 0 END) / (1 - 0.975) AS "ES975"
FROM coal_tail_t GROUP BY 1, 2, 3""")

part("explain_t", """
SELECT measure, component, value FROM (
  WITH v AS (SELECT p, l, w, unnest(['VaR99', 'ES975']) AS measure, unnest(["VaR99", "ES975"]) AS value FROM coal_value_t),
  o AS (SELECT measure, max(value) FILTER (p = 0 AND l = 0 AND w = 0) AS e, max(value) FILTER (p = 1 AND l = 0 AND w = 0) AS a,
    max(value) FILTER (p = 0 AND l = 1 AND w = 0) AS b, max(value) FILTER (p = 0 AND l = 0 AND w = 1) AS c,
    max(value) FILTER (p = 1 AND l = 1 AND w = 0) AS ab, max(value) FILTER (p = 1 AND l = 0 AND w = 1) AS ac,
    max(value) FILTER (p = 0 AND l = 1 AND w = 1) AS bc, max(value) FILTER (p = 1 AND l = 1 AND w = 1) AS abc FROM v GROUP BY measure)
  SELECT measure, unnest(['previous', 'positions', 'levels', 'window', 'current']) AS component, unnest([e,
    ((a - e) + (a - e) + (ab - b) + (abc - bc) + (ac - c) + (abc - bc)) / 6,
    ((b - e) + (b - e) + (ab - a) + (abc - ac) + (bc - c) + (abc - ac)) / 6,
    ((c - e) + (c - e) + (ac - a) + (abc - ab) + (bc - b) + (abc - ab)) / 6, abc]) AS value FROM o)""")

part("win_t", """
SELECT scenario, name, short, f.ord AS first_ord, f.date AS first_date, e.ord AS last_ord, e.date AS last_date,
  f.ord IS NOT NULL AND e.date IS NOT NULL AND e.ord > f.ord AS available
FROM (SELECT *, (SELECT max(ord) FROM days_t WHERE date <= start_date) AS fo,
        CASE WHEN end_date IS NOT NULL THEN (SELECT max(ord) FROM days_t WHERE date <= end_date)
             ELSE (SELECT max(ord) FROM days_t WHERE date <= start_date) + market_days END AS eo
  FROM (VALUES ('before_history', 'Window before the loaded history', 'Before history', DATE '1990-03-01', NULL::DATE, 20),
    ('autumn_1998', 'Autumn sell-off, 1998', 'Autumn 1998', DATE '1998-08-14', NULL, 20),
    ('spring_2000', 'Spring reversal, 2000', 'Spring 2000', DATE '2000-03-10', DATE '2000-04-14', NULL),
    ('late_2001', 'Last weeks of the history', 'Late 2001', DATE '2001-10-06', DATE '2002-03-29', NULL))
    v(scenario, name, short, start_date, end_date, market_days))
LEFT JOIN days_t f ON f.ord = fo LEFT JOIN days_t e ON e.ord = eo""")

part("path_t", """
SELECT scenario, g.ord, g.instrument_id, r IS NULL AS gap,
  sum(coalesce(r, 0)) OVER (PARTITION BY scenario, g.instrument_id ORDER BY g.ord) AS r
FROM (SELECT scenario, ord, instrument_id FROM win_t JOIN days_t ON ord > first_ord AND ord <= last_ord, dim_t WHERE available) g
LEFT JOIN stress_rets_t s ON s.ord = g.ord AND s.instrument_id = g.instrument_id""")

part("path_pnl_t", """
SELECT a.scenario, a.ord, a.instrument_id, d.desk, a.gap, mv * (exp(CASE quote WHEN 'price' THEN a.r WHEN 'yield_pct' THEN -a.r * tenor_years / 100 ELSE -a.r END
  - CASE WHEN fx_id IS NULL THEN 0 ELSE f.r END) - 1) AS pnl
FROM path_t a JOIN dim_t d USING (instrument_id) LEFT JOIN path_t f ON f.scenario = a.scenario AND f.ord = a.ord AND f.instrument_id = fx_id
JOIN (SELECT instrument_id, mv FROM today_t) t ON t.instrument_id = a.instrument_id""")

part("path_total_t", "SELECT scenario, p.ord, d.date, CASE WHEN count(pnl) = count(*) THEN sum(pnl) END AS pnl FROM path_pnl_t p JOIN days_t d USING (ord) GROUP BY 1, 2, 3")

part("hist_t", """
SELECT w.scenario, w.name, w.short, available, first_date, last_date, e.pnl, worst.pnl AS worst_pnl, worst.date AS worst_date,
  CASE WHEN available THEN coalesce(g.n, 0) END AS n_no_data
FROM win_t w LEFT JOIN path_total_t e ON e.scenario = w.scenario AND e.ord = w.last_ord
LEFT JOIN (SELECT scenario, pnl, date FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY pnl, ord) AS rn FROM path_total_t) WHERE rn = 1) worst
  ON worst.scenario = w.scenario
LEFT JOIN (SELECT scenario, count(DISTINCT instrument_id) AS n FROM path_pnl_t WHERE gap GROUP BY 1) g ON g.scenario = w.scenario""")

part("shock_t", """
SELECT scenario, instrument_id,
  CASE scenario WHEN 'curve_falls' THEN CASE WHEN asset_class = 'rates' THEN -0.4 ELSE 0 END
    WHEN 'supply_squeeze' THEN CASE WHEN asset_class = 'commodity' THEN ln(1.3) WHEN instrument_id IN ('Brand#17', 'Brand#20') THEN 0.25 ELSE 0 END
    WHEN 'overseas_slump' THEN CASE WHEN desk = 'US Equities' THEN ln(0.78) WHEN asset_class = 'fx' THEN ln(1.03) ELSE 0 END
    ELSE CASE WHEN instrument_id = 'Brand#11' THEN ln(0.5) ELSE 0 END END::DOUBLE AS r
FROM dim_t, (VALUES ('curve_falls'), ('supply_squeeze'), ('overseas_slump'), ('one_name')) s(scenario)""")

part("hyp_t", """
SELECT a.scenario, a.instrument_id, d.desk, mv * (exp(CASE quote WHEN 'price' THEN a.r WHEN 'yield_pct' THEN -a.r * tenor_years / 100 ELSE -a.r END
  - CASE WHEN fx_id IS NULL THEN 0 ELSE f.r END) - 1) + 0.0 AS pnl
FROM shock_t a JOIN dim_t d USING (instrument_id) LEFT JOIN shock_t f ON f.scenario = a.scenario AND f.instrument_id = fx_id
JOIN (SELECT instrument_id, mv FROM today_t) t ON t.instrument_id = a.instrument_id""")

part("stress_pos_t", """
SELECT p.scenario, instrument_id, desk, pnl, 'historical' AS kind FROM path_pnl_t p JOIN win_t w ON w.scenario = p.scenario AND p.ord = w.last_ord WHERE available
UNION ALL SELECT scenario, instrument_id, desk, pnl, 'hypothetical' FROM hyp_t""")
