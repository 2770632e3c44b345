"""Oracle SQL per query key."""

from __future__ import annotations

from checks.parts import binom_cdf, chi2_1, mark, millions, query

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = query(sql)


M = millions
RUN_D = "(SELECT d FROM run_t)"

# --- stored tables
oracle("market_data_daily", "SELECT instrument_id, date, round(close, 6) AS close, fetch_id FROM market_t")
oracle("reference_fanout", "SELECT instrument_id, purpose, source, ticker, date, round(value, 6) AS value FROM refs_t")
oracle("dividend_extract", "SELECT instrument_id, ex_date, round(amount, 6) AS amount FROM divs_t")
ALL_T = f"SELECT instrument_id, date, {mark('all')} AS close FROM marks_t JOIN dim_t USING (instrument_id)"
F_T = f"SELECT instrument_id, date, {mark('f')} AS close FROM marks_t JOIN dim_t USING (instrument_id) WHERE unit_f IS NOT NULL"
oracle("dedupe_keep_last", f"""
SELECT instrument_id, date, close, load_seq FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, date ORDER BY load_seq DESC) AS rn
FROM (SELECT *, 1::INT AS load_seq FROM kept_t UNION ALL SELECT *, 2 FROM ({ALL_T}))) WHERE rn = 1""")
oracle("keyed_upsert", f"""
SELECT instrument_id, date, coalesce(i.close, s.close) AS close, CASE WHEN i.close IS NULL THEN 'stored' ELSE 'incoming' END AS origin
FROM ({ALL_T}) s FULL JOIN ({F_T}) i USING (instrument_id, date)""")
oracle("replace_date_range", """
SELECT 'T' || strftime(trade_date, '%Y%m%d') || '-' || instrument_id AS trade_id, trade_date, instrument_id,
  CASE WHEN trade_date <= DATE '1998-12-31' THEN 2 * quantity ELSE quantity END AS quantity FROM trades_t""")
oracle("append_only_results", f"SELECT run_id, method, measure, {M('value')} AS value FROM totals_t, (VALUES ('run-1'), ('run-2')) r(run_id)")
oracle("partition_overwrite", """
SELECT year(trade_date)::INT AS year, count(*) AS n, sum(CASE WHEN year(trade_date) >= 2000 THEN 0 ELSE quantity END)::DOUBLE AS quantity FROM trades_t GROUP BY 1""")
oracle("run_log_status", """
SELECT user_id AS run_id, max(ts::DATE) AS as_of, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at,
  strftime(max(ts) FILTER (event_type <> 'STARTED'), '%Y-%m-%d %H:%M:%S') AS finished_at, max_by(event_type, (ts, event_type)) AS status FROM events GROUP BY 1""")
oracle("sql_view_scan", f"SELECT instrument_id, count(*) AS n, max(date) AS last FROM market_t WHERE date <= {RUN_D} GROUP BY 1")

# --- panels and returns
oracle("ffill_panel", "SELECT date, instrument_id, round(level, 6) AS level FROM filled_t")
oracle("market_day_calendar", "SELECT ord::BIGINT AS ord, date FROM days_t")
oracle("proxy_panel", "SELECT purpose, instrument_id, date, round(level, 6) AS level FROM proxy_t")
oracle("dividend_panel", """
SELECT date, instrument_id, round(coalesce(amount, 0), 6) AS amount FROM levels_t
LEFT JOIN (SELECT instrument_id, ex_date AS date, sum(amount) AS amount FROM divs_t GROUP BY ALL) USING (instrument_id, date)""")
oracle("factor_returns", "SELECT date, instrument_id, round(r, 6) AS r FROM rets_t")
oracle("stress_factor_returns", "SELECT date, instrument_id, round(r, 6) AS r FROM stress_rets_t")
oracle("total_return", """
SELECT date, instrument_id, round(ln(level / before), 6) AS price_return, round(ln((level + amount) / before), 6) AS total_return
FROM (SELECT l.*, CASE WHEN lag(ord) OVER w = ord - 1 THEN lag(level) OVER w END AS before FROM levels_t l JOIN dim_t USING (instrument_id) WHERE asset_class = 'equity' WINDOW w AS (PARTITION BY instrument_id ORDER BY ord))
JOIN (SELECT instrument_id, ex_date AS date, amount FROM divs_t) USING (instrument_id, date) WHERE before IS NOT NULL""")
GAPS = f"""
SELECT instrument_id, date, paid, pos, CASE WHEN before - paid > 0 THEN abs(ln(close / (before - paid)) - ln(adj_close / adj_before)) END AS diff
FROM (SELECT m.instrument_id, m.date, close, adj_close, coalesce(amount, 0) AS paid, lag(close) OVER w AS before, lag(adj_close) OVER w AS adj_before,
        row_number() OVER w AS pos
      FROM market_t m JOIN dim_t USING (instrument_id) LEFT JOIN divs_t d ON d.instrument_id = m.instrument_id AND d.ex_date = m.date
      WHERE asset_class = 'equity' AND currency = 'USD' AND m.date <= {RUN_D} WINDOW w AS (PARTITION BY m.instrument_id ORDER BY m.date))"""
oracle("vendor_return_gap", f"SELECT instrument_id, date, round(paid, 6) AS paid, round(diff, 6) AS diff FROM ({GAPS}) WHERE pos > 1")
oracle("complete_scenario_days", "SELECT date, complete, c::BIGINT AS c FROM cal_t")

# --- valuation and positions
oracle("unit_values", "SELECT date, instrument_id, round(unit_value, 6) AS unit_value FROM daily_values_t WHERE unit_value IS NOT NULL")
oracle("value_moves", "SELECT date, instrument_id, round(x, 6) AS x FROM moves_t WHERE x IS NOT NULL")
oracle("shocked_levels", """
SELECT m.date, m.instrument_id, round(CASE WHEN quote = 'yield_pct' THEN level + r ELSE level * exp(r) END, 4) AS level
FROM rets_t m JOIN dim_t USING (instrument_id) JOIN (SELECT instrument_id, level FROM levels_t WHERE ord = (SELECT k FROM run_t)) USING (instrument_id)""")
oracle("positions_from_trades", "SELECT as_of, instrument_id, quantity FROM positions_t")
oracle("asof_positions", """
SELECT d.date, d.as_of, instrument_id, quantity FROM (
  SELECT date, (SELECT max(as_of) FROM positions_t WHERE as_of <= date AND isodow(as_of) = 5) AS as_of FROM (SELECT DISTINCT date FROM market_t)) d
JOIN positions_t p ON p.as_of = d.as_of""")
oracle("sized_quantities", """
SELECT instrument_id, n * 1e6 AS target, round(n * 1e6 / unit_value, 4) AS quantity FROM dim_t JOIN today_t USING (instrument_id)""")
oracle("holdings_market_value", f"SELECT date, instrument_id, quantity, {M('mv')} AS mv FROM book_t")

# --- risk today
oracle("scenario_pnl", f"SELECT date, desk, {M('pnl')} AS pnl FROM desk_cube_t")
oracle("desk_pnl_rollup", f"SELECT date, desk, {M('pnl')} AS pnl FROM desk_cube_t UNION ALL SELECT date, 'total', {M('pnl')} FROM total_cube_t")
oracle("scenario_weights", """
SELECT date, method, round(pow(decay, age) / sum(pow(decay, age)) OVER (PARTITION BY method), 9) AS weight
FROM total_cube_t, (VALUES ('hs_equal', 1.0::DOUBLE), ('hs_weighted', 0.995::DOUBLE), ('parametric', 0.94::DOUBLE)) m(method, decay)""")
for key, method in (("var_es_equal", "hs_equal"), ("var_es_weighted", "hs_weighted"), ("parametric_var", "parametric")):
    oracle(key, f"SELECT measure, {M('value')} AS value FROM totals_t WHERE method = '{method}'")
oracle("es_contrib_desk", f"""SELECT desk, {M('"ES975_contribution"')} AS es_contribution FROM desks_t""")
oracle("var_standalone_desk", f"""SELECT desk, {M('"VaR99_standalone"')} AS var99 FROM desks_t""")
oracle("tail_scenarios", f"""
SELECT date, {M('loss')} AS loss, round(t, 9) AS tail_weight FROM (
  SELECT *, CASE WHEN cp >= 0.975 - 1e-12 THEN w WHEN cw >= 0.975 - 1e-12 THEN greatest(cw - 0.975, 0) ELSE 0 END AS t FROM total_tail_t) WHERE t > 1e-12""")
oracle("risk_results_long", f"SELECT method, measure, scope, scope_id, {M('value')} AS value FROM risk_t")
oracle("var_ten_day", f"SELECT method, {M('value * sqrt(10)')} AS scaled FROM totals_t WHERE measure = 'VaR99'")
oracle("diversification_benefit", f"""
SELECT {M('a')} AS standalone, {M('b')} AS total, {M('a - b')} AS benefit FROM (SELECT (SELECT sum("VaR99_standalone") FROM desks_t) AS a,
  (SELECT value FROM totals_t WHERE method = 'hs_equal' AND measure = 'VaR99') AS b)""")
oracle("ewma_cov", """
SELECT a.instrument_id AS a_id, b.instrument_id AS b_id, round(sum(w * a.r * b.r), 6) AS cov
FROM (SELECT s, pow(0.94::DOUBLE, age) / sum(pow(0.94::DOUBLE, age)) OVER () AS w FROM total_cube_t) c JOIN scen_t a USING (s) JOIN scen_t b USING (s)
WHERE a.instrument_id <= b.instrument_id GROUP BY 1, 2""")
oracle("run_summary", """
SELECT max(date) AS as_of, min(date) AS first_scenario, count(*) FILTER (complete) AS n_scenarios, count(*) FILTER (NOT complete) AS dropped
FROM cal_t WHERE ord BETWEEN greatest(1, (SELECT k FROM run_t) - 1259) AND (SELECT k FROM run_t)""")

# --- backtest
oracle("rolling_backtest", f"SELECT date, method, {M('var95')} AS var95, {M('var99')} AS var99, {M('pnl')} AS pnl FROM bt_t")
oracle("exceptions", """
SELECT * FROM (SELECT date, method, (-pnl > var99)::INT AS exception_99, (-pnl > var95)::INT AS exception_95 FROM bt_t) WHERE exception_99 + exception_95 > 0""")
oracle("exceptions_by_method", "SELECT method, level, n, exceptions, round(n * p, 6) AS expected, round(exceptions / n, 6) AS rate FROM counts_t")
oracle("exception_transitions", "SELECT method, level, n00, n01, n10, n11 FROM counts_t")
oracle("kupiec", f"SELECT method, level, round(kupiec_lr, 4) AS lr, round({chi2_1('kupiec_lr')}, 6) AS p FROM lr_t")
oracle("christoffersen", f"SELECT method, level, round(christoffersen_lr, 4) AS lr, round({chi2_1('christoffersen_lr')}, 6) AS p FROM lr_t")
oracle("joint_coverage", "SELECT method, level, round(exp(-(kupiec_lr + christoffersen_lr) / 2), 6) AS p FROM lr_t")
oracle("traffic_light", "SELECT method, last_n, last_exceptions, zone, plus_factor FROM zone_t")
oracle("traffic_light_table", f"""
SELECT method, block::BIGINT AS block, n, x, CASE WHEN x > 0 AND cdf >= 0.9999 - 1e-9 THEN 'red' WHEN cdf >= 0.95 - 1e-9 THEN 'yellow' ELSE 'green' END AS zone
FROM (SELECT *, {binom_cdf('x', 'n', 0.05)} AS cdf FROM (SELECT method, block, count(*) AS n, sum(coalesce((-pnl > var95)::INT, 0))::BIGINT AS x FROM (
  SELECT *, (row_number() OVER (PARTITION BY method ORDER BY date) - 1) // 250 AS block FROM bt_t) GROUP BY 1, 2))""")
oracle("backtest_last_250", f"SELECT date, method, {M('var99')} AS var99, {M('pnl')} AS pnl FROM last250_t")
oracle("backtest_worst_day", f"SELECT method, arg_min(date, (pnl, date)) AS worst_day, {M('min(pnl)')} AS worst_pnl FROM bt_t WHERE pnl IS NOT NULL GROUP BY 1")
oracle("backtest_summary", f"""
SELECT c.method, n, exceptions, round(expected, 6) AS expected, round({chi2_1('kupiec_lr')}, 6) AS kupiec_p,
  round({chi2_1('christoffersen_lr')}, 6) AS christoffersen_p, last_n, last_exceptions, zone, plus_factor, worst_day, {M('worst_pnl')} AS worst_pnl,
  exceptions_95, expected_95, kupiec_p_95, christoffersen_p_95
FROM lr_t c JOIN zone_t USING (method) JOIN (SELECT method, arg_min(date, (pnl, date)) AS worst_day, min(pnl) AS worst_pnl FROM bt_t WHERE pnl IS NOT NULL GROUP BY 1) USING (method)
JOIN (SELECT method, exceptions AS exceptions_95, round(expected, 6) AS expected_95, round({chi2_1('kupiec_lr')}, 6) AS kupiec_p_95,
  round({chi2_1('christoffersen_lr')}, 6) AS christoffersen_p_95 FROM lr_t WHERE level = '95') USING (method)
WHERE level = '99'""")
oracle("mark_to_market_recheck", f"""
SELECT t.date, {M('sum(h.quantity * b.unit_value * (exp(x) - 1))')} AS revalued,
  {M('sum(h.quantity * (t.unit_value - b.unit_value + CASE WHEN asset_class = $e$equity$e$ THEN coalesce(amount, 0) * t.unit_value / t.level ELSE 0 END))')} AS marked
FROM values_t t JOIN values_t b ON b.ord = t.ord - 1 AND b.instrument_id = t.instrument_id JOIN hold_t h ON h.ord = b.ord AND h.instrument_id = t.instrument_id
JOIN moves_t m ON m.ord = t.ord AND m.instrument_id = t.instrument_id JOIN dim_t d ON d.instrument_id = t.instrument_id
LEFT JOIN divs_t v ON v.instrument_id = t.instrument_id AND v.ex_date = t.date WHERE returns_proxy IS NULL GROUP BY 1""".replace("$e$", "'"))
oracle("var_by_computed_day", f"""
SELECT method, computed_on, {M('var99')} AS var99 FROM (
  SELECT method, coalesce(lag(date) OVER (PARTITION BY method ORDER BY date), (SELECT min(date) FROM hold_t)) AS computed_on, var99 FROM bt_t) UNION ALL SELECT method, {RUN_D}, {M('value')} FROM totals_t WHERE measure = 'VaR99'""")
oracle("var_history_wide", f"""
SELECT date, {M("max(var99) FILTER (method = 'hs_equal')")} AS hs_equal, {M("max(var99) FILTER (method = 'hs_weighted')")} AS hs_weighted,
  {M("max(var99) FILTER (method = 'parametric')")} AS parametric FROM bt_t GROUP BY 1""")

# --- explain
oracle("coalition_values", f"""SELECT p, l, w, {M('"VaR99"')} AS var99, {M('"ES975"')} AS es975 FROM coal_value_t""")
oracle("var_explain", f"SELECT measure, component, {M('value')} AS value FROM explain_t")
oracle("var_setting_day", f"""
SELECT CASE WHEN p = 1 THEN 'current' ELSE 'previous' END AS state, arg_min(date, s) AS date, {M('arg_min(pnl, s)')} AS pnl
FROM coal_t JOIN coal_value_t USING (p, l, w) WHERE p = l AND l = w AND abs(-pnl - "VaR99") <= 1e-8 + 1e-5 * abs("VaR99") GROUP BY p""")
oracle("window_entered_left", f"""
SELECT CASE WHEN w = 1 THEN 'entered' ELSE 'left' END AS change, date, {M('pnl')} AS pnl FROM coal_t a WHERE p = 1 AND l = 1
AND NOT EXISTS (SELECT 1 FROM coal_t b WHERE b.p = 1 AND b.l = 1 AND b.w <> a.w AND b.s = a.s)""")
oracle("trades_since_previous", f"""
SELECT t.instrument_id, t.quantity, {M('t.quantity * unit_value')} AS value FROM (
  SELECT instrument_id, sum(quantity) AS quantity FROM trades_t WHERE trade_date > (SELECT prev FROM run_t) AND trade_date <= {RUN_D} GROUP BY 1) t
JOIN today_t USING (instrument_id)""")

# --- stress
oracle("stress_windows", "SELECT scenario, name, first_date, last_date, available FROM win_t")
oracle("stress_hist_path", f"SELECT scenario, date, {M('pnl')} AS pnl FROM path_total_t")
oracle("stress_historical", f"SELECT scenario, available, {M('pnl')} AS pnl, {M('worst_pnl')} AS worst_pnl, worst_date, n_no_data::DOUBLE AS n_no_data FROM hist_t")
oracle("stress_no_data", "SELECT scenario, instrument_id, count(*) AS days FROM path_t WHERE gap GROUP BY 1, 2")
oracle("shock_vector", "SELECT scenario, instrument_id, round(r, 6) AS r FROM shock_t")
oracle("stress_hypothetical", f"SELECT scenario, {M('sum(pnl)')} AS pnl FROM hyp_t GROUP BY 1")
oracle("stress_by_desk", f"""
SELECT scenario, desk, {M('sum(pnl)')} AS pnl FROM stress_pos_t GROUP BY 1, 2 UNION ALL SELECT scenario, 'total', {M('sum(pnl)')} FROM stress_pos_t GROUP BY 1""")
oracle("stress_top3", f"""
SELECT scenario, rank::INT AS rank, instrument_id, {M('pnl')} AS pnl FROM (
  SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY pnl, instrument_id) AS rank FROM stress_pos_t) WHERE rank <= 3""")
oracle("shock_guards", """
SELECT 'bad_unit' AS scenario, 0::INT AS shock, 'pct shock on a yield, use pp' AS error, 1::BIGINT AS n WHERE EXISTS (SELECT 1 FROM dim_t WHERE asset_class = 'rates')
UNION ALL SELECT 'bad_unit', 1, 'pp shock on a price', 1 WHERE EXISTS (SELECT 1 FROM dim_t WHERE asset_class = 'equity')
UNION ALL SELECT 'bad_selector', 0, 'selects no instruments', 1 WHERE (SELECT count(*) FROM dim_t WHERE desk = 'No such desk') = 0""")


# --- controls
def shown(items: str, limit: int = 6) -> str:
    """(n, text) of a relation with key and item."""
    return (f"(SELECT count(*) AS n, coalesce(string_agg(item, ', ' ORDER BY rn) FILTER (rn <= {limit}), '') "
            f"|| CASE WHEN count(*) > {limit} THEN ' (+' || (count(*) - {limit}) || ' more)' ELSE '' END AS text "
            f"FROM (SELECT item, row_number() OVER (ORDER BY key) AS rn FROM ({items})))")


def control(name: str, items: str, bad: str, prefix: str = "''", suffix: str = "''", passed: str = "''") -> str:
    return (f"SELECT '{name}' AS control, CASE WHEN n > 0 THEN '{bad}' ELSE 'PASS' END AS status, n AS n_affected, "
            f"CASE WHEN n > 0 THEN {prefix} || text || {suffix} ELSE {passed} END AS detail FROM {shown(items)}")


AT = "instrument_id || '@' || date::VARCHAR"


def lag_sql(market: str) -> str:
    return f"""SELECT d.instrument_id, m.last, (SELECT count(*) FROM (SELECT unnest(generate_series(m.last, {RUN_D} - 1, INTERVAL 1 DAY))::DATE AS x) WHERE isodow(x) < 6)
      AS lag FROM dim_t d LEFT JOIN (SELECT instrument_id, max(date) AS last FROM ({market}) WHERE date <= {RUN_D} GROUP BY 1) m USING (instrument_id)"""


def missing(market: str) -> str:
    return control("missing_prices", f"""SELECT instrument_id AS key, CASE WHEN last IS NULL THEN instrument_id || ' (has no price at all)'
      ELSE instrument_id || ' (newest is ' || last::VARCHAR || ')' END AS item FROM ({lag_sql(market)}) WHERE last IS NULL OR lag > 3""", "FAIL",
                   passed="'no instrument is older than 3 weekdays'")


def stale(market: str) -> str:
    return control("stale_prices", f"""SELECT instrument_id AS key, instrument_id || ' (' || lag || ' weekdays old, from ' || last::VARCHAR || ')' AS item
      FROM ({lag_sql(market)}) WHERE last IS NOT NULL AND lag BETWEEN 1 AND 3""", "WARN", suffix="'. The last value stays in use'",
                   passed=f"'each price is of ' || {RUN_D}::VARCHAR")


def fix(x: str, d: int) -> str:
    return f"printf('%.{d}f', round({x}, {d}))"


def thousands(x: str) -> str:
    return f"format('{{:,}}', floor({x} + 0.5)::BIGINT)"


def signed(x: str, d: int) -> str:
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '+' END || {fix(f'abs({x})', d)})"


def invalid(market: str) -> str:
    return control("invalid_values", f"""SELECT {AT} AS key, {AT} || '=' || {fix('close', 4)} AS item FROM ({market}) m JOIN dim_t USING (instrument_id)
      WHERE m.date <= {RUN_D} AND (close IS NULL OR isnan(close) OR (quote IN ('price', 'fx') AND close <= 0) OR (quote = 'yield_pct' AND (close < -2 OR close > 25)))""",
                   "FAIL", passed="'every value lies within its bounds'")


def scores(market: str) -> str:
    """EWMA by a literal recursion-free list fold over the ordered moves."""
    return f"""SELECT instrument_id, quote, rs[len(rs)] AS r, sqrt(list_reduce(list_transform(rs[1:len(rs) - 1], lambda v: v * v), lambda a, v: 0.94 * a + 0.06 * v)) AS sigma
      FROM (SELECT instrument_id, quote, list(r ORDER BY date) FILTER (pos > 1) AS rs, count(*) AS n, max(date) AS last FROM (
        SELECT m.instrument_id, m.date, quote, row_number() OVER w AS pos,
          CASE WHEN quote = 'yield_pct' THEN adj_close - lag(adj_close) OVER w ELSE ln(adj_close) - ln(lag(adj_close) OVER w) END AS r
        FROM ({market}) m JOIN dim_t USING (instrument_id) WHERE m.date <= {RUN_D} WINDOW w AS (PARTITION BY m.instrument_id ORDER BY m.date)) GROUP BY 1, 2)
      WHERE n >= 60 AND last = {RUN_D}"""


def outliers(market: str) -> str:
    move = f"CASE WHEN quote = 'yield_pct' THEN {signed('r', 3)} || 'pp' ELSE {signed('((exp(r) - 1) * 100)', 1)} || '%' END"
    return control("return_outliers", f"""SELECT instrument_id AS key, instrument_id || ' ' || {move} || ' (' || {signed('(r / sigma)', 1)} || ' times its volatility)' AS item
      FROM ({scores(market)}) WHERE sigma > 0 AND abs(r) > 6 * sigma""", "WARN", suffix="'. To be looked at before the figures go out'", passed="'every move is within 6.0 times its volatility'")


def gaps(have: str, lookback: int) -> str:
    since = f"coalesce((SELECT date FROM week_t ORDER BY date DESC LIMIT 1 OFFSET {lookback}), DATE '1900-01-01')"
    return f"""
    SELECT s.instrument_id, s.date, p.n / (m.n - 1) AS share FROM (
      SELECT instrument_id, source, currency, x.date FROM (SELECT h.instrument_id, source, currency, min(h.date) AS lo, max(h.date) AS hi FROM ({have}) h JOIN dim_t USING (instrument_id)
        WHERE h.date > {since} AND h.date <= {RUN_D} GROUP BY 1, 2, 3 HAVING count(*) >= 2), week_t x WHERE x.date BETWEEN lo AND hi) s
    JOIN (SELECT source, currency, count(*) AS n FROM dim_t GROUP BY 1, 2) m USING (source, currency)
    JOIN (SELECT source, currency, h.date, count(*) AS n FROM ({have}) h JOIN dim_t USING (instrument_id) GROUP BY 1, 2, 3) p
      ON p.source = s.source AND p.currency = s.currency AND p.date = s.date
    WHERE m.n - 1 >= 3 AND p.n / (m.n - 1) >= 0.75 AND NOT EXISTS (SELECT 1 FROM ({have}) h WHERE h.instrument_id = s.instrument_id AND h.date = s.date)"""


def interior(have: str, lookback: int) -> str:
    return control("interior_gaps", f"SELECT {AT} AS key, {AT} || ' (' || {fix('share * 100', 0)} || '% of its group have a price)' AS item FROM ({gaps(have, lookback)})", "WARN",
                   suffix="'. The last value stays in use'", passed=f"'no holes over {lookback} weekdays'")


CROSS = f"""SELECT * FROM (SELECT r.instrument_id, r.source, r.date, r.value, m.close, abs(r.value - m.close) / m.close * 100 AS diff,
  row_number() OVER (PARTITION BY r.instrument_id, r.source ORDER BY r.date DESC) AS rn FROM refs_t r JOIN market_t m USING (instrument_id, date)
  WHERE purpose = 'cross_check' AND r.date BETWEEN (SELECT min(date) FROM (SELECT date FROM week_t ORDER BY date DESC LIMIT 4)) AND {RUN_D}) WHERE rn = 1"""
CROSS_BREAKS = f"""SELECT instrument_id AS key, {AT} || ' primary ' || {fix('close', 4)} || ' vs ' || source || ' ' || {fix('value', 4)} || ' (' || {fix('diff', 2)} || '%)' AS item
  FROM ({CROSS}) WHERE diff > 0.75"""
CROSS_CHECKED = f"SELECT instrument_id AS key, instrument_id || ' ' || {fix('diff', 2)} || '% @' || strftime(date, '%m-%d') AS item FROM ({CROSS})"
CROSS_MISSING = f"SELECT instrument_id AS key, instrument_id AS item FROM dim_t WHERE asset_class = 'fx' AND instrument_id NOT IN (SELECT instrument_id FROM ({CROSS}))"
CROSS_CTL = f"""SELECT 'cross_source' AS control, CASE WHEN b.n > 0 THEN 'WARN' WHEN c.n = 0 THEN 'INFO' ELSE 'PASS' END AS status, b.n AS n_affected,
  CASE WHEN b.n > 0 THEN b.text WHEN c.n = 0 THEN 'the two sources have no day in common'
  ELSE c.n || ' of ' || (SELECT count(*) FROM dim_t WHERE asset_class = 'fx') || ' agree to 0.75%: ' || c.text || CASE WHEN u.n > 0 THEN '; without a second source: ' || u.text ELSE '' END END AS detail
  FROM {shown(CROSS_BREAKS)} b, {shown(CROSS_CHECKED)} c, {shown(CROSS_MISSING)} u"""
ROLL = f"""SELECT instrument_id, max(date) AS date, max(ticker) AS ticker, max(close) FILTER (rn = 1) / max(close) FILTER (rn = 2) - 1 AS f, max(value) FILTER (rn = 1) / max(value) FILTER (rn = 2) - 1 AS p
  FROM (SELECT instrument_id, date, ticker, close, value, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS rn
    FROM refs_t JOIN market_t USING (instrument_id, date) WHERE purpose = 'return_proxy' AND date <= {RUN_D}) WHERE rn <= 2 GROUP BY 1 HAVING count(*) = 2"""
ROLL_FLAG = f"SELECT instrument_id AS key, {AT} || ': contract ' || {signed('(f * 100)', 2)} || '% vs ' || ticker || ' ' || {signed('(p * 100)', 2)} || '%' AS item FROM ({ROLL}) WHERE abs(f - p) > 0.02"
ROLL_ALL = f"SELECT instrument_id AS key, instrument_id || ' ' || {signed('((f - p) * 100)', 2)} || '%' AS item FROM ({ROLL})"
ROLL_CTL = control("futures_roll", ROLL_FLAG, "WARN", suffix="'. It may be a change of contract; risk follows the proxy'",
                   passed=f"'contracts that move with their proxies: ' || (SELECT text FROM {shown(ROLL_ALL)})")
DIV_PER = f"""SELECT instrument_id, count(*) FILTER (pos > 1 AND (diff IS NULL OR diff > 1e-4)) AS bad, count(*) FILTER (paid > 0) AS paid_days, max(diff) FILTER (pos > 1) AS worst
  FROM ({GAPS}) GROUP BY 1"""
DIV_WORST = f"SELECT instrument_id AS key, instrument_id || ' ' || {fix('worst * 1e4', 2)} || 'bp' AS item FROM ({DIV_PER})"
DIV_CTL = f"""SELECT 'dividend_adjustment' AS control, CASE WHEN bad > 0 THEN 'FAIL' ELSE 'PASS' END AS status, bad AS n_affected,
  CASE WHEN bad > 0 THEN bad || ' days differ by over 1.0bp; ' ELSE '' END || divs || ' dividends abroad; widest difference: ' || text AS detail
  FROM (SELECT sum(bad)::BIGINT AS bad, sum(paid_days)::BIGINT AS divs FROM ({DIV_PER})), {shown(DIV_WORST)}"""


def revisions_of(incoming: str) -> str:
    return f"SELECT instrument_id, date, o.close AS old_close, n.close AS new_close FROM ({incoming}) n JOIN market_t o USING (instrument_id, date) WHERE abs(n.close - o.close) > abs(o.close) * 0.1 / 100"


def revisions_ctl(incoming: str) -> str:
    old = f"""SELECT date::VARCHAR || instrument_id AS key, {AT} || ' ' || {fix('old_close', 4)} || '->' || {fix('new_close', 4)} AS item FROM ({revisions_of(incoming)})
      WHERE date < (SELECT min(date) FROM (SELECT date FROM week_t ORDER BY date DESC LIMIT 6))"""
    return f"""SELECT 'revisions' AS control, CASE WHEN n > 0 THEN 'WARN' WHEN total > 0 THEN 'INFO' ELSE 'PASS' END AS status, CASE WHEN n > 0 THEN n ELSE total END AS n_affected,
      CASE WHEN n > 0 THEN 'settled for 5 weekdays, yet changed: ' || text WHEN total > 0 THEN total || ' values of the last 5 weekdays were replaced' ELSE 'stored values are as they were' END AS detail
      FROM {shown(old)}, (SELECT count(*) AS total FROM ({revisions_of(incoming)}))"""


HISTORY = control("history_sufficiency", f"""SELECT instrument_id AS key, instrument_id || ' (' || obs || ')' AS item FROM (
  SELECT d.instrument_id, count(m.date) AS obs FROM dim_t d LEFT JOIN (SELECT instrument_id, date FROM market_t WHERE date > {RUN_D} - INTERVAL 5 YEAR AND date <= {RUN_D}) m USING (instrument_id)
  GROUP BY 1) WHERE obs < 750""", "WARN", prefix="'short of 750 values in 5 years: '", passed="'all have 750 values or more in 5 years'")


def recon(positions: str) -> str:
    prior = f"(SELECT max(as_of) FROM ({positions}) WHERE as_of < {RUN_D})"
    return f"""SELECT d.instrument_id, coalesce(p.quantity, 0) AS prev, coalesce(t.quantity, 0) AS traded, coalesce(c.quantity, 0) AS cur
      FROM dim_t d LEFT JOIN (SELECT * FROM ({positions}) WHERE as_of = {RUN_D}) c USING (instrument_id)
      LEFT JOIN (SELECT * FROM ({positions}) WHERE as_of = {prior}) p USING (instrument_id)
      LEFT JOIN (SELECT instrument_id, sum(quantity) AS quantity FROM trades_t WHERE trade_date > {prior} AND trade_date <= {RUN_D} GROUP BY 1) t USING (instrument_id)
      WHERE coalesce(c.instrument_id, p.instrument_id, t.instrument_id) IS NOT NULL"""


def recon_ctl(positions: str) -> str:
    items = f"""SELECT instrument_id AS key, instrument_id || ': ' || {thousands('cur')} || ' held, ' || {thousands('prev')} || ' before, ' || {thousands('traded')} || ' traded' AS item FROM ({recon(positions)})
      WHERE abs(prev + traded - cur) > 1e-6 * greatest(1, abs(cur))"""
    return f"""SELECT 'position_reconciliation' AS control, CASE WHEN held = 0 OR n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN held = 0 THEN 0 ELSE n END AS n_affected,
      CASE WHEN held = 0 THEN 'no holdings are known on ' || {RUN_D}::VARCHAR WHEN n > 0 THEN text ELSE held || ' holdings follow from the day before and the trades' END AS detail
      FROM {shown(items)}, (SELECT count(*) AS held FROM ({positions}) WHERE as_of = {RUN_D})"""


def coverage(priced: str) -> str:
    held = f"SELECT instrument_id FROM positions_t WHERE as_of = {RUN_D} AND quantity <> 0"
    return control("position_coverage", f"SELECT instrument_id AS key, instrument_id AS item FROM ({held}) WHERE instrument_id NOT IN (SELECT instrument_id FROM ({priced}))", "FAIL",
                   prefix="'held without a price: '", passed=f"'prices exist for all ' || (SELECT count(*) FROM ({held})) || ' holdings'")


def orphans(lineage: str) -> str:
    used = f"SELECT DISTINCT fetch_id AS key, fetch_id || ' ' || substr(sha256(fetch_id), 1, 8) AS item FROM market_t WHERE date <= {RUN_D} AND fetch_id IN ({lineage})"
    listing = f"SELECT text FROM {shown(used)}"
    return f"""SELECT 'lineage_complete' AS control, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n AS n_affected,
      CASE WHEN n > 0 THEN 'rows whose file is not on record' ELSE 'files behind the rows: ' || ({listing}) END AS detail
      FROM (SELECT count(*) AS n FROM market_t WHERE date <= {RUN_D} AND fetch_id NOT IN ({lineage}))"""


MARKET = "SELECT instrument_id, date, close, adj_close FROM market_t"
LINEAGE = "SELECT DISTINCT 'src-' || status_max FROM marks_t"
PRICED = f"SELECT instrument_id FROM filled_t WHERE date = {RUN_D}"
CONTROLS = {
    "raw_duplicates": control("raw_duplicates", f"SELECT {AT} AS key, {AT} AS item FROM market_t GROUP BY instrument_id, date HAVING count(*) > 1", "FAIL",
                              passed="'each source row is alone on its day'"),
    "invalid_values": invalid(MARKET), "missing_prices": missing(MARKET), "stale_prices": stale(MARKET),
    "interior_gaps": interior("SELECT instrument_id, date FROM market_t", 20), "return_outliers": outliers(MARKET), "cross_source": CROSS_CTL,
    "futures_roll": ROLL_CTL, "dividend_adjustment": DIV_CTL, "revisions": revisions_ctl("SELECT * FROM kept_t"), "history_sufficiency": HISTORY,
    "position_reconciliation": recon_ctl("SELECT * FROM positions_t"), "position_coverage": coverage(PRICED), "lineage_complete": orphans(LINEAGE),
}
for _name, _sql in CONTROLS.items():
    oracle(f"ctl_{_name}", _sql)
#: The run's own deadline: it is done at 07:05 on the weekday after the run date.
NEXT = f"({RUN_D} + CASE isodow({RUN_D}) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::DATE::VARCHAR"
RUN_SLA = f"SELECT 'reporting_sla' AS control, 'PASS' AS status, 0::BIGINT AS n_affected, 'done ' || {NEXT} || ' 07:05 Europe/London, deadline ' || {NEXT} || ' 07:30' AS detail"
ALL_CONTROLS = " UNION ALL ".join(f"({s})" for s in [*CONTROLS.values(), RUN_SLA])
oracle("controls_overall", f"SELECT CASE max(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS status FROM ({ALL_CONTROLS})")
oracle("controls_histogram", f"SELECT status, count(*) AS n FROM ({ALL_CONTROLS}) GROUP BY 1")
LATE = f"SELECT instrument_id, m.date, close, adj_close FROM market_t m JOIN dim_t USING (instrument_id) WHERE m.date <= {RUN_D} - n AND n < 25"
oracle("ctl_reporting_sla", """
SELECT run_id, 'reporting_sla' AS control, CASE WHEN late <= 0 THEN 'PASS' WHEN late > 86400 THEN 'INFO' ELSE 'FAIL' END AS status,
  CASE WHEN late > 0 AND late <= 86400 THEN 1 ELSE 0 END::BIGINT AS n_affected,
  CASE WHEN late <= 0 THEN 'done ' || strftime(ts, '%Y-%m-%d %H:%M') || ' Europe/London, deadline ' || strftime(due, '%Y-%m-%d %H:%M')
       WHEN late > 86400 THEN 'a rerun without deadline, done ' || strftime(ts, '%Y-%m-%d %H:%M') || ', over a day later'
       ELSE 'done at ' || strftime(ts, '%H:%M') || ': ' || floor(late / 60)::BIGINT || ' minutes past ' || strftime(due, '%H:%M') END AS detail
FROM (SELECT *, epoch_us(ts) / 1e6 - epoch_us(due) / 1e6 AS late FROM (SELECT event_id AS run_id, ts,
  (as_of + CASE isodow(as_of) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::TIMESTAMP + INTERVAL 450 MINUTE AS due
  FROM (SELECT event_id, ts, ts::DATE - (event_id % 3)::INT AS as_of FROM events)))""")
oracle("fault_duplicates", control("raw_duplicates", f"""SELECT {AT} AS key, {AT} AS item FROM (SELECT instrument_id, date FROM kept_t UNION ALL SELECT instrument_id, date FROM marks_t)
  GROUP BY instrument_id, date HAVING count(*) > 1""", "FAIL", prefix="'several source rows on one day: '", passed="'each source row is alone on its day'"))
oracle("fault_invalid_values", invalid("SELECT instrument_id, date, close - 700 AS close FROM market_t"))
oracle("fault_missing", missing(LATE))
oracle("fault_stale", stale(LATE))
oracle("price_lags", f"SELECT instrument_id, last, CASE WHEN last IS NOT NULL THEN lag END::DOUBLE AS lag FROM ({lag_sql(LATE)})")
oracle("fault_outliers", outliers(f"""SELECT instrument_id, date, adj_close * CASE WHEN date = {RUN_D} AND instrument_id IN ('Brand#2', 'Brand#9', 'Brand#13') THEN 1e9 ELSE 1 END AS adj_close
  FROM market_t"""))
oracle("ewma_sigma", f"SELECT instrument_id, round(r, 6) AS r, round(sigma, 6) AS sigma FROM ({scores(MARKET)})")
oracle("fault_gaps", interior("""SELECT instrument_id, date FROM filled_t WHERE instrument_id <> 'Brand#7' UNION ALL SELECT instrument_id, date FROM market_t WHERE instrument_id = 'Brand#7'""", 500))
oracle("gap_days", f"SELECT instrument_id, date, round(share, 6) AS share FROM ({gaps('SELECT instrument_id, date FROM market_t', 5000)})")
oracle("revised_rows", f"SELECT instrument_id, date, round(old_close, 6) AS old_close, round(new_close, 6) AS new_close FROM ({revisions_of('SELECT * FROM kept_t')})")
oracle("fault_recent_revisions", revisions_ctl(f"SELECT instrument_id, date, CASE WHEN date > {RUN_D} - 5 THEN close * 1.01 ELSE close END AS close FROM market_t"))
oracle("fault_position_break", recon_ctl(f"""SELECT as_of, instrument_id, quantity + CASE WHEN as_of = {RUN_D} AND instrument_id IN ('Brand#3', 'Brand#4') THEN 500 ELSE 0 END AS quantity
  FROM positions_t"""))
oracle("position_reconcile_rows", f"SELECT instrument_id, prev, traded, cur FROM ({recon('SELECT * FROM positions_t')})")
oracle("fault_no_snapshot", recon_ctl(f"SELECT * FROM positions_t WHERE as_of < {RUN_D}"))
oracle("fault_uncovered", coverage(f"""SELECT instrument_id FROM ({LATE}) m JOIN week_t USING (date) GROUP BY 1 HAVING (SELECT max(b) FROM week_t) - max(b) <= 5"""))
oracle("fault_orphans", orphans("SELECT * FROM (" + LINEAGE + ") t(f) WHERE f <> 'src-F'"))
oracle("lineage_used", "SELECT fetch_id, sha256(fetch_id) AS sha256, count(*) AS n_rows FROM market_t GROUP BY 1")
