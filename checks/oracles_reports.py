"""Oracle SQL for files, exposures, marts, measures, filings and the volatility study."""

from __future__ import annotations

from checks.oracles import ALL_CONTROLS, M, RUN_D, oracle, signed
from checks.parts import chi2_1, mean_units, part

CATS = ("interest_rates", "equity_prices", "currency_rates", "commodity_prices")
SIX = (*CATS, "diversification", "total")
SIX_SQL = ", ".join(SIX)

# --- exposures
part("gross_t", "SELECT t.*, d.name, abs(mv) / (SELECT sum(abs(mv)) FROM today_t) AS share FROM today_t t JOIN dim_t d USING (instrument_id)")
oracle("position_table", f"SELECT instrument_id, name, desk, {M('mv')} AS mv, round(share, 6) AS share_of_gross FROM gross_t")
oracle("top_positions", f"SELECT instrument_id, {M('mv')} AS mv, round(share, 6) AS share_of_gross FROM (SELECT * FROM gross_t ORDER BY abs(mv) DESC, instrument_id LIMIT 10)")
EXPO = "{m1} AS long, {m2} AS short, {m3} AS net, count(mv) AS positions".format(
    m1=M("sum(greatest(mv, 0))"), m2=M("sum(least(mv, 0))"), m3=M("sum(mv)"))
oracle("desk_exposure", f"SELECT desk, {EXPO} FROM today_t GROUP BY 1 UNION ALL SELECT 'total', {EXPO} FROM today_t")
part("controls_t", ALL_CONTROLS)
part("ends_t", """SELECT max(value) FILTER (component = 'current') AS cur, max(value) FILTER (component = 'previous') AS prev FROM explain_t WHERE measure = 'VaR99'""")
oracle("attention_items", f"""
SELECT rule, subject, round(value, 4) AS value, threshold FROM (
SELECT 'concentration' AS rule, instrument_id AS subject, share AS value, 0.10::DOUBLE AS threshold FROM (SELECT * FROM gross_t ORDER BY share DESC, instrument_id LIMIT 1) WHERE share > 0.10
UNION ALL SELECT 'var_move', 'VaR99', (cur - prev) / prev, 0.10 FROM ends_t WHERE abs(cur - prev) > 0.10 * prev
UNION ALL SELECT 'zone_' || zone, method, last_exceptions, last_n FROM zone_t WHERE zone <> 'green'
UNION ALL SELECT 'independence', method, p, 0.05 FROM (SELECT method, {chi2_1('christoffersen_lr')} AS p FROM lr_t WHERE method = 'hs_equal' AND level = '99') WHERE p < 0.05
UNION ALL SELECT 'control_' || lower(status), control, n_affected, 0 FROM controls_t WHERE status IN ('WARN', 'FAIL'))""")
part("share_t", """SELECT desk, "ES975_contribution" / (SELECT value FROM totals_t WHERE method = 'hs_equal' AND measure = 'ES975') AS share FROM desks_t""")
part("lead_t", "SELECT desk, share, row_number() OVER (ORDER BY share DESC, desk) AS up, row_number() OVER (ORDER BY share, desk) AS down FROM share_t")
part("worst_t", "SELECT * FROM hist_t WHERE available ORDER BY pnl LIMIT 1")
part("top1_t", """SELECT instrument_id FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY pnl, instrument_id) AS rn FROM stress_pos_t WHERE kind = 'historical') WHERE rn = 1""")
oracle("headline_facts", f"""
SELECT * FROM (SELECT 'largest_driver' AS fact, component AS subject, {M('value')} AS value FROM explain_t WHERE measure = 'VaR99' AND component NOT IN ('previous', 'current') ORDER BY abs(value) DESC LIMIT 1)
UNION ALL SELECT 'largest_desk_share', desk, round(share, 4) FROM lead_t WHERE up = 1
UNION ALL SELECT 'second_desk_share', desk, round(share, 4) FROM lead_t WHERE up = 2
UNION ALL SELECT 'reducing_desk', desk, round(share, 4) FROM lead_t WHERE down = 1 AND share < 0
UNION ALL SELECT 'worst_historical', scenario, {M('pnl')} FROM worst_t
UNION ALL SELECT 'worst_historical_point', scenario, {M('worst_pnl')} FROM worst_t
UNION ALL SELECT 'worst_historical_var_multiple', scenario, round(abs(pnl) / (SELECT value FROM totals_t WHERE method = 'hs_equal' AND measure = 'VaR99'), 4) FROM worst_t
UNION ALL SELECT * FROM (SELECT 'worst_hypothetical', scenario, {M('sum(pnl)')} FROM hyp_t GROUP BY scenario ORDER BY sum(pnl) LIMIT 1)
UNION ALL SELECT 'common_top_loss', CASE WHEN count(DISTINCT instrument_id) = 1 THEN max(instrument_id) END, count(DISTINCT instrument_id)::DOUBLE FROM top1_t""")
F4 = "printf('%.4f', {})"


def payload_json(**fields: str) -> str:
    """A JSON object of texts; a null field is left out."""
    parts = ", ".join(f"""CASE WHEN ({sql}) IS NOT NULL THEN '"{name}":"' || ({sql}) || '"' END""" for name, sql in fields.items())
    return f"'{{{{' || concat_ws(',', {parts}) || '}}}}'".replace("{{", "{").replace("}}", "}")


def money(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN printf('%.4f', {M(x)}) END"


def one_of(column: str, value: str, of: str = "value") -> str:
    return f"max({of}) FILTER ({column} = '{value}')"


PAYLOAD = (
    f"""SELECT 'totals' AS section, 'totals' AS item, {payload_json(**{n.lower(): money(one_of('measure', n)) for n in ('VaR95', 'VaR99', 'ES975')})} AS payload FROM totals_t WHERE method = 'hs_equal'""",
    f"""SELECT 'explain', measure, {payload_json(**{c: money(one_of('component', c)) for c in ('previous', 'positions', 'levels', 'window', 'current')})} FROM explain_t GROUP BY measure""",
    f"""SELECT 'desk', desk, {payload_json(var=money('"VaR99_standalone"'), es=money('"ES975_contribution"'))} FROM desks_t""",
    f"""SELECT 'stress', scenario_name, {payload_json(kind='kind', window='"window"', pnl=money('pnl_base'), worst=money('worst_point_base'), largest='largest_loss')} FROM scenario_t""",
    f"""SELECT 'history', date::VARCHAR, {payload_json(pnl=money('pnl'), var99=money('var99'))} FROM bt_t WHERE method = 'hs_equal'""",
    f"""SELECT 'var_history', computed_on::VARCHAR, {payload_json(**{m: money(one_of('method', m, 'var99')) for m in ('hs_equal', 'hs_weighted', 'parametric')})} FROM (
      SELECT method, coalesce(lag(date) OVER (PARTITION BY method ORDER BY date), (SELECT min(date) FROM hold_t)) AS computed_on, var99 FROM bt_t
      UNION ALL SELECT method, {RUN_D}, value FROM totals_t WHERE measure = 'VaR99') GROUP BY computed_on""",
    f"""SELECT 'position', instrument_id, {payload_json(name='name', desk='desk', mv=money('mv'), share="printf('%.4f', round(share, 4))")} FROM (
      SELECT g.instrument_id, d.name, d.desk, mv, share FROM gross_t g JOIN dim_t d USING (instrument_id) ORDER BY abs(mv) DESC, instrument_id LIMIT 10)""",
    f"""SELECT 'control', control_label, {payload_json(status='status', affected='n_affected::VARCHAR')} FROM (SELECT *, CASE_LABEL AS control_label FROM controls_t)""")

# --- landed files
oracle("csv_named_month_dates", "SELECT ticker, date, round(level, 6) AS close FROM raw_t WHERE source = 'cb'")
oracle("csv_iso_dates", "SELECT ticker, date, round(level, 6) AS close FROM raw_t WHERE source = 'fed' AND date >= DATE '1996-07-01'")
oracle("csv_long_dividends", "SELECT ticker, date, round(level, 6) AS close, round(dividend, 6) AS dividend FROM raw_t WHERE source = 'px'")
oracle("csv_long_without_dividends", "SELECT ticker, count(*) AS n, 0.0::DOUBLE AS dividend FROM raw_t WHERE source = 'px' GROUP BY 1")
oracle("csv_long_mixed_headers", """SELECT ticker, date, round(level, 6) AS close, round(level, 6) AS adj_close,
  CASE WHEN date < DATE '1997-01-01' THEN 0.0::DOUBLE ELSE round(dividend, 6) END AS dividend FROM raw_t""")
oracle("csv_two_level_header", "SELECT ticker, date, round(level, 6) AS close, round(dividend, 6) AS dividend FROM raw_t WHERE source = 'px'")
oracle("raw_lineage", """
SELECT '20010101T000000' AS stamp, source, 'unknown' AS request, count(*) FILTER (date < DATE '2000-01-01') AS n_rows, TRUE AS hashed, TRUE AS named FROM raw_t GROUP BY source
UNION ALL SELECT '20011105T000000', source, 'unknown', count(*), TRUE, TRUE FROM raw_t GROUP BY source""")
oracle("latest_raw_files", "SELECT ticker, count(*) AS n, max(date) AS last FROM raw_t GROUP BY 1")

# --- filings
part("dsc_t", """
SELECT period_end, interest_rates, equity_prices, currency_rates, commodity_prices,
  -round((interest_rates + equity_prices + currency_rates + commodity_prices) * 0.4, 0) AS diversification,
  (interest_rates + equity_prices + currency_rates + commodity_prices) - round((interest_rates + equity_prices + currency_rates + commodity_prices) * 0.4, 0) AS total
FROM (SELECT last_day(date_trunc('quarter', o_orderdate)::DATE + INTERVAL 2 MONTH) AS period_end,
  round(avg(o_totalprice) FILTER (c_mktsegment = 'AUTOMOBILE') / 1e4, 0) AS interest_rates, round(avg(o_totalprice) FILTER (c_mktsegment = 'BUILDING') / 1e4, 0) AS equity_prices,
  round(avg(o_totalprice) FILTER (c_mktsegment = 'FURNITURE') / 1e4, 0) AS currency_rates, round(avg(o_totalprice) FILTER (c_mktsegment = 'HOUSEHOLD') / 1e4, 0) AS commodity_prices
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
WHERE interest_rates + equity_prices + currency_rates + commodity_prices IS NOT NULL""")
part("filing_t", """
SELECT 'F-' || strftime(period_end, '%Y%m') AS accession, CASE month(period_end) WHEN 12 THEN '10-K' ELSE '10-Q' END AS form, (period_end + 35)::DATE AS filed, d.*,
  CASE month(period_end) WHEN 9 THEN last_day(period_end - INTERVAL 12 MONTH) ELSE last_day(period_end - INTERVAL 3 MONTH) END AS ref FROM dsc_t d""")
HEADER = "'Three Months Ended / ' || CASE month(f.period_end) WHEN 3 THEN 'March | December' ELSE monthname(f.period_end) || ' | ' || monthname(f.ref) END"
part("parsed_t", f"""
SELECT accession, form, filed, f.period_end, 'average' AS measure, CASE form WHEN '10-K' THEN 'year' ELSE 'quarter' END AS horizon, 1::INT AS "column", {SIX_SQL}, 0.0::DOUBLE AS identity_gap,
  {HEADER} AS header FROM filing_t f
UNION ALL SELECT accession, form, filed, f.period_end, 'period_end', 'day', 1, interest_rates + 1, equity_prices, currency_rates, commodity_prices, diversification, total + 1, 0.0, {HEADER} FROM filing_t f
UNION ALL SELECT accession, form, filed, d.period_end, 'average', 'quarter', 2, {', '.join('d.' + c for c in SIX)}, 0.0, {HEADER}
FROM filing_t f JOIN dsc_t d ON d.period_end = f.ref WHERE month(f.period_end) = 3""")
part("quarters_t", f"SELECT period_end, {SIX_SQL} FROM parsed_t WHERE measure = 'average' AND horizon = 'quarter'")
oracle("filing_documents", "SELECT accession, TRUE AS same_bytes, TRUE AS complete FROM filing_t")
oracle("filings_parsed", "SELECT * FROM parsed_t")
oracle("filings_fourth_quarters", """SELECT accession, period_end, total FROM parsed_t WHERE "column" = 2""")
oracle("filings_identity_gap", "SELECT 0.0::DOUBLE AS largest_gap, count(*) AS tables FROM parsed_t")
oracle("filing_columns", """SELECT f.accession, f.period_end, f.total AS total_1, d.total AS total_2 FROM filing_t f LEFT JOIN dsc_t d ON d.period_end = f.ref WHERE form = '10-Q'""")
part("pairs_t", f"""SELECT f.period_end, ({SIX_SQL}) AS c1, (SELECT ({SIX_SQL}) FROM dsc_t d WHERE d.period_end = f.ref) AS c2 FROM filing_t f WHERE form = '10-Q'""")
oracle("reprint_check", """
SELECT a.period_end, CASE WHEN a.c2 IS NULL THEN 'no_reference' WHEN p.c1 = a.c2 THEN 'prior_quarter' WHEN y.c1 = a.c2 THEN 'same_quarter_last_year'
  WHEN month(a.period_end) = 3 OR p.period_end IS NULL OR y.period_end IS NULL THEN 'no_reference' ELSE 'unmatched' END AS class
FROM pairs_t a LEFT JOIN pairs_t p ON p.period_end = last_day(a.period_end - INTERVAL 3 MONTH) LEFT JOIN pairs_t y ON y.period_end = last_day(a.period_end - INTERVAL 12 MONTH)""")
oracle("phrase_flag", "SELECT form, count(*) AS n, count(*) FILTER (year(period_end) % 2 = 0) AS states_95 FROM filing_t GROUP BY 1")
oracle("filing_lineage", """SELECT f.accession, f.form, f.filed, count(p.accession) AS tables_parsed, TRUE AS hashed FROM filing_t f LEFT JOIN parsed_t p USING (accession) GROUP BY 1, 2, 3""")
oracle("filing_lineage_export", """SELECT f.accession, f.form, f.filed, count(p.accession) AS tables_parsed, 64 AS hash_length FROM filing_t f LEFT JOIN parsed_t p USING (accession) GROUP BY 1, 2, 3""")
oracle("filing_manifest", "SELECT accession, form, filed FROM filing_t WHERE filed >= DATE '1990-01-01'")
oracle("missing_quarters", """
SELECT period_end FROM dsc_t WHERE month(period_end) = 12 AND period_end > (SELECT min(period_end) FROM dsc_t WHERE month(period_end) <> 12)
AND period_end < (SELECT max(period_end) FROM dsc_t WHERE month(period_end) <> 12)""")

# --- volatility study
part("bench_t", f"""
SELECT l_shipdate::DATE AS date, CASE p_type WHEN 'STANDARD' THEN 'interest_rates' WHEN 'ECONOMY' THEN 'equity_prices' WHEN 'MEDIUM' THEN 'currency_rates' ELSE 'commodity_prices' END AS category,
  round({mean_units('l_extendedprice / l_quantity', 4)}, 6) AS level FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type IN ('STANDARD', 'ECONOMY', 'MEDIUM', 'PROMO') GROUP BY 1, 2""")
part("vmoves_t", """SELECT date, category, CASE category WHEN 'interest_rates' THEN level - lag(level) OVER w ELSE ln(level / lag(level) OVER w) END AS move
FROM bench_t WINDOW w AS (PARTITION BY category ORDER BY date)""")
part("vdense_t", """SELECT d.date, d.category, move, row_number() OVER (PARTITION BY d.category ORDER BY d.date) AS u
FROM (SELECT date, category FROM (SELECT DISTINCT date FROM bench_t), (SELECT DISTINCT category FROM bench_t)) d LEFT JOIN vmoves_t USING (date, category)""")
part("vol_t", " UNION ALL ".join(f"""
SELECT '{w}' AS "window", date, category, CASE WHEN count(move) OVER f >= {int(n * 0.9)} THEN stddev_samp(move) OVER f END AS vol FROM vdense_t
WINDOW f AS (PARTITION BY category ORDER BY u RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)""" for w, n in (("1y", 250), ("2y", 500), ("5y", 1260))))
part("qvol_t", """SELECT "window", last_day(date_trunc('quarter', date)::DATE + INTERVAL 2 MONTH) AS period_end, category, avg(vol) AS vol FROM vol_t GROUP BY ALL""")
part("qvar_t", f"SELECT * FROM (UNPIVOT (SELECT period_end, {', '.join(CATS)} FROM quarters_t) ON {', '.join(CATS)} INTO NAME category VALUE var)")
part("fit_t", """
SELECT *, tanh(atanh(corr_changes) - 1.96 / sqrt(quarters - 3)) AS ci_lo, tanh(atanh(corr_changes) + 1.96 / sqrt(quarters - 3)) AS ci_hi FROM (
SELECT category, "window", count(dv) AS quarters, corr(dv, ds) AS corr_changes, corr(v, s) AS corr_levels, regr_slope(dv, ds) AS elasticity FROM (
  SELECT *, CASE WHEN near THEN v - lag(v) OVER w END AS dv, CASE WHEN near THEN s - lag(s) OVER w END AS ds FROM (
    SELECT *, date_diff('day', lag(period_end) OVER (PARTITION BY category, "window" ORDER BY period_end), period_end) BETWEEN 80 AND 100 AS near FROM (
      SELECT category, "window", period_end, ln(var) AS v, ln(vol) AS s FROM qvar_t JOIN qvol_t USING (period_end, category) WHERE vol IS NOT NULL))
  WINDOW w AS (PARTITION BY category, "window" ORDER BY period_end)) GROUP BY 1, 2 HAVING count(dv) >= 8)""")
part("best_t", """SELECT category, arg_max("window", corr_changes) AS "window", max(corr_changes) AS corr_changes, max(ci_lo) <= min(ci_hi) AS overlap FROM fit_t GROUP BY 1""")
oracle("benchmark_panel", "SELECT date, category, round(level, 6) AS level FROM bench_t")
oracle("trailing_vol", """SELECT "window", date, category, round(vol, 6) AS vol FROM vol_t WHERE vol IS NOT NULL""")
oracle("quarterly_vol", """SELECT "window", period_end, category, round(vol, 6) AS vol FROM qvol_t""")
oracle("vol_fit", """SELECT category, "window", quarters, round(corr_changes, 6) AS corr_changes, round(corr_levels, 6) AS corr_levels, round(elasticity, 6) AS elasticity FROM fit_t""")
oracle("fisher_interval", """SELECT category, "window", round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi FROM fit_t""")
oracle("best_window", """SELECT category, "window", round(corr_changes, 6) AS corr_changes, overlap FROM best_t""")
oracle("implied_index", """SELECT category, period_end, round(100 * e / first_value(e) OVER (PARTITION BY category ORDER BY period_end), 4) AS implied FROM (
  SELECT category, period_end, var / vol AS e FROM qvar_t JOIN best_t USING (category) JOIN qvol_t USING (category, "window", period_end) WHERE vol IS NOT NULL)""")
part("corr_t", """
SELECT date, CASE WHEN count(*) OVER f >= 225 THEN corr(x, y) OVER f END AS corr FROM (SELECT * FROM (
  SELECT date, ln(a / lag(a) OVER (ORDER BY date)) AS x, -(b - lag(b) OVER (ORDER BY date)) AS y FROM (
    SELECT date, max(level) FILTER (category = 'equity_prices') AS a, max(level) FILTER (category = 'interest_rates') AS b FROM bench_t GROUP BY 1)) WHERE x IS NOT NULL AND y IS NOT NULL)
WINDOW f AS (ORDER BY date ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)""")
part("div_t", f"""
SELECT period_end, -diversification / ({' + '.join(CATS)}) AS share, corr FROM quarters_t LEFT JOIN (
  SELECT last_day(date_trunc('quarter', date)::DATE + INTERVAL 2 MONTH) AS period_end, avg(corr) AS corr FROM corr_t GROUP BY 1) USING (period_end)""")
oracle("rolling_correlation", "SELECT date, round(corr, 6) AS corr FROM corr_t WHERE corr IS NOT NULL")
oracle("diversification_share", "SELECT period_end, round(share, 6) AS share, round(corr, 6) AS corr FROM div_t")
oracle("diversification_summary", """SELECT round(min(share), 6) AS lowest, round(max(share), 6) AS highest, round(corr(share, corr), 6) AS corr, count(*) AS quarters FROM div_t
WHERE share IS NOT NULL AND corr IS NOT NULL""")
part("epi_t", """
SELECT name, a.category, a."window", a.var AS var_from, b.var AS var_to, b.var / a.var - 1 AS var_change_pct, b.vol / a.vol - 1 AS vol_change_pct, (b.var / a.var) / (b.vol / a.vol) - 1 AS residual_pct
FROM (VALUES ('Winter 1998', DATE '1997-12-31', DATE '1998-03-31'), ('Second half 1998', DATE '1998-06-30', DATE '1998-12-31'),
  ('Spring 2000', DATE '2000-03-31', DATE '2000-06-30'), ('Spring 2001', DATE '2001-03-31', DATE '2001-06-30')) e(name, d0, d1)
JOIN (SELECT * FROM qvar_t JOIN qvol_t USING (period_end, category)) a ON a.period_end = d0
JOIN (SELECT * FROM qvar_t JOIN qvol_t USING (period_end, category)) b ON b.period_end = d1 AND b.category = a.category AND b."window" = a."window\"""")
oracle("episodes", """SELECT name, category, "window", var_from, var_to, round(var_change_pct, 6) AS var_change_pct, round(vol_change_pct, 6) AS vol_change_pct, round(residual_pct, 6) AS residual_pct FROM epi_t""")
oracle("residual_range", "SELECT name, category, round(min(residual_pct), 6) AS lowest, round(max(residual_pct), 6) AS highest FROM epi_t GROUP BY 1, 2")
oracle("yearly_means", f"SELECT year(period_end) AS year, {', '.join(f'round(avg({c}), 6) AS {c}' for c in SIX)} FROM quarters_t GROUP BY 1")
oracle("yearly_extremes", """
WITH y AS (SELECT year(period_end) AS year, avg(total) AS total FROM quarters_t GROUP BY 1)
SELECT arg_min(year, (total, year)) AS lowest_year, round(min(total), 6) AS lowest_total, arg_max(year, (total, -year)) AS highest_year, round(max(total), 6) AS highest_total,
  (SELECT count(*) FROM quarters_t WHERE interest_rates >= greatest(equity_prices, currency_rates, commodity_prices)) AS led, (SELECT count(*) FROM quarters_t) AS quarters FROM y""".replace(
    "WITH y AS (SELECT year(period_end) AS year, avg(total) AS total FROM quarters_t GROUP BY 1)\n", "").replace(
    "AS quarters FROM y", "AS quarters FROM (SELECT year(period_end) AS year, avg(total) AS total FROM quarters_t GROUP BY 1)"))
oracle("normal_rescale", """
SELECT round(m, 6) AS mean, round(m * 2.3263478740408408::DOUBLE / 1.6448536269514715::DOUBLE, 6) AS one_day_99, round(m * 2.3263478740408408::DOUBLE / 1.6448536269514715::DOUBLE * sqrt(10), 6) AS rescaled
FROM (SELECT avg(total) AS m, count(*) AS n FROM quarters_t WHERE period_end BETWEEN DATE '1999-07-01' AND DATE '1999-12-31') WHERE n = 2""")

# --- marts
part("method_t", """SELECT * FROM (VALUES ('hs_equal', 'Historical simulation, equal weights (primary)', 1::INT, 0::INT), ('hs_weighted', 'Historical simulation, age-weighted', 0, 1),
  ('parametric', 'Parametric (delta-normal, EWMA)', 0, 2)) v(method, method_label, is_primary, method_order)""")
part("loss2_t", f"""SELECT scenario, string_agg(instrument_id || ' ' || {signed('(pnl / 1e6)', 2)} || 'm', ', ' ORDER BY rank) AS l FROM (
  SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY pnl, instrument_id) AS rank FROM stress_pos_t) WHERE rank <= 2 AND pnl < 0 GROUP BY 1""")
part("scenario_t", """
SELECT s.*, coalesce(l, 'none') AS largest_loss FROM (
  SELECT scenario, short AS scenario_name, name AS description, 'Historical' AS kind, strftime(first_date, '%d %b %Y') || ' to ' || strftime(last_date, '%d %b %Y') AS "window", pnl AS pnl_base,
    worst_pnl AS worst_point_base FROM hist_t WHERE available
  UNION ALL SELECT h.scenario, short, name, 'Hypothetical', 'Instant shock', pnl, NULL FROM (SELECT scenario, sum(pnl) AS pnl FROM hyp_t GROUP BY 1) h JOIN (VALUES
    ('curve_falls', 'Every yield falls by 40 basis points', 'Yields 40bp lower'),
    ('supply_squeeze', 'Commodities gain 30% while long yields rise by 25 basis points', 'Supply squeeze'),
    ('overseas_slump', 'Equities abroad lose 22%, foreign currencies gain 3%', 'Slump abroad'),
    ('one_name', 'A single equity loses half of its value', 'One name halves')) n(scenario, name, short) USING (scenario)) s LEFT JOIN loss2_t USING (scenario)""")
part("posfact_t", """SELECT p.as_of AS date, p.instrument_id, quantity, unit_value, quantity * unit_value AS mv FROM positions_t p
  LEFT JOIN daily_values_t v ON v.date = p.as_of AND v.instrument_id = p.instrument_id""")
part("btfact_t", "SELECT date, method, var95, var99, pnl, coalesce((-pnl > var99)::INT, 0) AS exception_99, coalesce((-pnl > var95)::INT, 0) AS exception_95 FROM bt_t")
part("stressfact_t", """SELECT scenario, kind, desk, pnl FROM (SELECT scenario, kind, desk, sum(pnl) AS pnl FROM stress_pos_t GROUP BY ALL
  UNION ALL SELECT scenario, kind, 'total', sum(pnl) FROM stress_pos_t GROUP BY ALL)""")
LABELS = {"raw_duplicates": "Duplicate source rows", "invalid_values": "Invalid values", "missing_prices": "Missing prices", "stale_prices": "Stale prices",
          "interior_gaps": "Gaps inside series", "futures_roll": "Futures roll check", "dividend_adjustment": "Dividend adjustment check",
          "return_outliers": "Unusual moves", "cross_source": "Cross-source check", "revisions": "Historical revisions", "history_sufficiency": "History for VaR",
          "position_reconciliation": "Position reconciliation", "position_coverage": "Positions priced", "lineage_complete": "Data lineage recorded", "reporting_sla": "Reporting SLA"}
LABEL_CASE = "CASE control " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " ELSE control END"
MARTS = {
    "dim_instrument": "SELECT instrument_id, name, asset_class, desk, currency, quote, source, ticker, tenor_years FROM dim_t",
    "dim_desk": "SELECT DISTINCT desk FROM dim_t",
    "dim_method": "SELECT * FROM method_t",
    "dim_scenario": f"""SELECT scenario, scenario_name, description, kind, "window", {M('pnl_base')} AS pnl_base, {M('worst_point_base')} AS worst_point_base, largest_loss FROM scenario_t""",
    "dim_date": """SELECT date, year(date)::INT AS year, quarter(date)::INT AS quarter, month(date)::INT AS month, strftime(date, '%b') AS month_name, strftime(date, '%a') AS weekday
      FROM week_t WHERE date >= (SELECT min(as_of) FROM positions_t)""",
    "fact_position_daily": f"SELECT date, instrument_id, quantity, round(unit_value, 6) AS unit_value_base, {M('mv')} AS market_value_base FROM posfact_t",
    "fact_backtest": f"SELECT date, method, {M('var95')} AS var95, {M('var99')} AS var99, {M('pnl')} AS pnl, exception_99, exception_95 FROM btfact_t",
    "fact_risk": f"SELECT {RUN_D} AS date, method, measure, scope, scope_id, {M('value')} AS value_base FROM risk_t",
    "fact_stress": f"SELECT {RUN_D} AS date, scenario, s.kind, desk, {M('pnl')} AS pnl_base, scenario_name FROM stressfact_t s JOIN scenario_t USING (scenario)",
    "fact_var_explain": f"""SELECT {RUN_D} AS date, (SELECT prev FROM run_t) AS prev_date, measure, component, {M('value')} AS value_base,
      CASE component WHEN 'previous' THEN 'Previous day' WHEN 'positions' THEN 'Trades' WHEN 'levels' THEN 'Market moves' WHEN 'window' THEN 'Scenario window rolled' ELSE 'Today' END AS component_label,
      CASE component WHEN 'previous' THEN 0 WHEN 'positions' THEN 1 WHEN 'levels' THEN 2 WHEN 'window' THEN 3 ELSE 4 END::INT AS component_order FROM explain_t""",
    "fact_controls": f"""SELECT {RUN_D} AS date, control, status, n_affected, detail, {LABEL_CASE} AS control_label,
      CASE status WHEN 'FAIL' THEN 1 WHEN 'WARN' THEN 2 WHEN 'INFO' THEN 3 WHEN 'PASS' THEN 4 ELSE 9 END::INT AS status_rank FROM controls_t""",
    "fact_disclosed_var": f"""SELECT accession, form, filed, period_end, measure, horizon, "column", {SIX_SQL}, identity_gap FROM parsed_t""",
    "fact_benchmark_vol": f"""SELECT "window", period_end, {', '.join(f"round(max(vol) FILTER (category = '{c}'), 6) AS {c}" for c in CATS)} FROM qvol_t GROUP BY 1, 2""",
}
for _name, _sql in MARTS.items():
    oracle(f"mart_{_name}", _sql)
oracle("export_counts", " UNION ALL ".join(f"SELECT '{n}' AS mart, count(*) AS n FROM ({s})" for n, s in (MARTS | {"filing_lineage": "SELECT * FROM filing_t"}).items()))
oracle("run_payload", " UNION ALL ".join(PAYLOAD).replace("CASE_LABEL", LABEL_CASE) + f"""
UNION ALL SELECT 'backtest', method, {payload_json(zone='zone', days='last_n::VARCHAR', exceptions='last_exceptions::VARCHAR')} FROM (
  SELECT method, zone, last_n, last_exceptions FROM zone_t)""")
oracle("export_round_trip", f"SELECT {RUN_D} AS date, method, measure, scope, scope_id, {M('value')} AS value FROM risk_t")

# --- measures
LATEST = "posfact_t WHERE date = (SELECT max(date) FROM posfact_t)"
PRIMARY = "btfact_t WHERE method = 'hs_equal'"
for key, name in (("total_var99", "VaR99"), ("total_var95", "VaR95"), ("total_es975", "ES975")):
    oracle(f"measure_{key}", f"SELECT {M('sum(value)')} AS value FROM risk_t WHERE method = 'hs_equal' AND measure = '{name}' AND scope = 'total'")
oracle("measure_es_contribution", f"SELECT scope_id AS desk, {M('sum(value)')} AS value FROM risk_t WHERE measure = 'ES975_contribution' AND scope = 'desk' GROUP BY 1")
oracle("measure_var_change", f"SELECT {M('cur - prev')} AS value FROM ends_t")
oracle("measure_var_change_by_cause", f"""SELECT CASE component WHEN 'positions' THEN 'Trades' WHEN 'levels' THEN 'Market moves' ELSE 'Scenario window rolled' END AS component_label, {M('sum(value)')} AS value
FROM explain_t WHERE measure = 'VaR99' AND component IN ('positions', 'levels', 'window') GROUP BY 1""")
oracle("measure_gross_exposure", f"SELECT {M('sum(abs(mv))')} AS value FROM {LATEST}")
oracle("measure_net_market_value", f"SELECT date, {M('sum(mv)')} AS value FROM posfact_t GROUP BY 1")
oracle("measure_market_value_today", f"SELECT name, {M('sum(mv)')} AS value FROM (SELECT * FROM {LATEST}) JOIN dim_t USING (instrument_id) GROUP BY 1")
oracle("measure_share_of_gross", f"SELECT desk, round(sum(abs(mv)) / (SELECT sum(abs(mv)) FROM {LATEST}), 6) AS value FROM (SELECT * FROM {LATEST}) JOIN dim_t USING (instrument_id) GROUP BY 1")
oracle("measures_by_slice", f"""
SELECT date, CASE WHEN gd = 1 THEN 'All' ELSE desk END AS desk, CASE WHEN ga = 1 THEN 'All' ELSE asset_class END AS asset_class, CASE WHEN gc = 1 THEN 'All' ELSE currency END AS currency,
  {M('gross')} AS gross, {M('net')} AS net, round(gross / whole, 6) AS share_of_gross FROM (
    SELECT date, desk, asset_class, currency, sum(abs(mv)) AS gross, sum(mv) AS net, grouping(desk) AS gd, grouping(asset_class) AS ga, grouping(currency) AS gc
    FROM posfact_t JOIN dim_t USING (instrument_id) GROUP BY date, CUBE (desk, asset_class, currency)) JOIN (SELECT date, sum(abs(mv)) AS whole FROM posfact_t GROUP BY 1) USING (date)""")
oracle("measure_scenario_pnl", f"SELECT scenario_name, {M('sum(pnl_base)')} AS value FROM scenario_t GROUP BY 1")
oracle("measure_worst_point", f"SELECT scenario_name, {M('sum(worst_point_base)')} AS value FROM scenario_t GROUP BY 1")
oracle("measure_worst_scenario", "SELECT scenario_name || ': ' || format('{:,.1f}', round(pnl_base / 1e6, 1)) || 'm' AS value FROM scenario_t ORDER BY pnl_base LIMIT 1")
oracle("measure_exceptions", f"SELECT sum(exception_99)::BIGINT AS value FROM {PRIMARY}")
oracle("measure_days_tested", f"SELECT count(*) AS value FROM {PRIMARY}")
oracle("measure_expected_exceptions", f"SELECT round(count(*) * 0.01::DOUBLE, 6) AS value FROM {PRIMARY}")
oracle("measure_exception_rate", f"SELECT round(sum(exception_99) / count(*), 6) AS value FROM {PRIMARY}")
ZONE = "CASE WHEN x <= 4 THEN 'Green' WHEN x <= 9 THEN 'Yellow' ELSE 'Red' END || ' (' || x || ' exceptions)'"
X250 = "SELECT method, sum((-pnl > var99)::INT)::BIGINT AS x FROM last250_t GROUP BY 1"
oracle("measure_zone_last_250", f"SELECT {ZONE} AS value FROM ({X250}) WHERE method = 'hs_equal'")
oracle("measure_zone_every_method", f"SELECT method, {ZONE} AS value FROM ({X250})")
oracle("measure_daily_pnl", f"SELECT date, {M('pnl')} AS value FROM {PRIMARY}")
oracle("measure_minus_var99", f"SELECT date, {M('-var99')} AS value FROM {PRIMARY}")
oracle("measure_checks_passed", "SELECT count(*) FILTER (status IN ('PASS', 'INFO')) AS value FROM controls_t")
oracle("measure_warnings", "SELECT count(*) FILTER (status = 'WARN') AS value FROM controls_t")
oracle("measure_failures", "SELECT count(*) FILTER (status = 'FAIL') AS value FROM controls_t")
oracle("measure_data_checks", """SELECT count(*) FILTER (status IN ('PASS', 'INFO')) || ' passed, ' || count(*) FILTER (status = 'WARN') || ' warnings, ' || count(*) FILTER (status = 'FAIL') || ' failed' AS value
FROM controls_t""")
for key, column in (("disclosed_total", "total"), ("disclosed_interest_rates", "interest_rates"), ("disclosed_equity_prices", "equity_prices"),
                    ("disclosed_currency_rates", "currency_rates"), ("disclosed_commodity_prices", "commodity_prices")):
    oracle(f"measure_{key}", f"SELECT period_end, sum({column}) AS value FROM quarters_t GROUP BY 1")
oracle("measure_latest_quarter_total", "SELECT sum(total) AS value FROM quarters_t WHERE period_end = (SELECT max(period_end) FROM quarters_t)")
oracle("measure_quarters_published", "SELECT count(*) AS value FROM quarters_t")

# --- the stored run
COUNTS = {"risk_results": "SELECT count(*) FROM risk_t", "backtest": "SELECT count(*) FROM bt_t", "stress_results": "SELECT count(*) FROM stressfact_t",
          "var_explain": "SELECT count(*) FROM explain_t", "control_results": "SELECT count(*) FROM controls_t"}
oracle("daily_pipeline", " UNION ALL ".join(f"SELECT '{n}' AS stored, ({s})::VARCHAR AS value" for n, s in COUNTS.items()) + """
UNION ALL SELECT 'status', CASE max(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END FROM controls_t
WHERE control <> 'revisions'""")  # nothing is stored yet that could have changed

EARLY, LATE_ON = "(SELECT prev FROM run_t)", "(SELECT d FROM run_t)"
FROM_KEPT = f"SELECT instrument_id, date, close FROM kept_t WHERE date <= {EARLY}"
STORE = {"market_data": ("market_t", "date", "instrument_id, date, (round(close * 1e6, 0)::BIGINT)"), "reference_prices": ("refs_t", "date", "instrument_id, purpose, date, (round(value * 1e6, 0)::BIGINT)"),
         "dividends": ("divs_t", "ex_date", "instrument_id, ex_date, (round(amount * 1e6, 0)::BIGINT)"), "positions": ("positions_t", "as_of", "instrument_id, as_of, quantity::BIGINT"),
         "trades": ("trades_t", "trade_date", "instrument_id, trade_date, quantity::BIGINT"), "lineage": ("(SELECT DISTINCT fetch_id FROM market_t)", None, "fetch_id"),
         "instruments": ("dim_t", None, "instrument_id, desk, currency")}


def held(step: str, name: str, cut: str, more: str = "TRUE") -> str:
    source, day, columns = STORE[name]
    if name == "market_data" and step == "first day":
        source = "kept_t"
    where = f"{day} <= {cut}" if day else "TRUE"
    return (f"SELECT '{step}' AS step, '{name}' AS stored, count(*) AS n, coalesce(sum(('0x' || substr(md5(concat_ws('|', {columns})), 1, 8))::BIGINT), 0)::BIGINT AS digest "
            f"FROM {source} x WHERE {where} AND {more}")


EMPTIED = "trade_date NOT BETWEEN DATE '1996-05-01' AND DATE '1996-05-31'"
oracle("two_day_store", " UNION ALL ".join(
    [held(step, name, cut) for step, cut in (("first day", EARLY), ("second day", LATE_ON), ("second day again", LATE_ON)) for name in STORE]
    + [held("a month empty", "trades", LATE_ON, EMPTIED)]) + f"""
UNION ALL SELECT 'first day', 'revisions', 0, 0 UNION ALL SELECT 'second day again', 'revisions', 0, 0
UNION ALL SELECT 'second day', 'revisions', count(*), 0 FROM ({FROM_KEPT}) o JOIN market_t n USING (instrument_id, date) WHERE abs(n.close - o.close) > abs(o.close) * 0.1 / 100""")
oracle("changed_months", """
SELECT strftime(date, '%Y%m')::INT AS month, count(*) AS n, sum(floor((close + (instrument_id = 'Brand#12' AND month(date) = 2)::INT) * 10000 + 0.5)::BIGINT)::BIGINT AS close FROM market_t GROUP BY 1
HAVING bool_or(instrument_id = 'Brand#12' AND month(date) = 2)""")
oracle("stored_range_replaced", f"""
SELECT strftime(trade_date, '%Y%m')::INT AS month, count(*) AS n, sum(CASE WHEN trade_date <= DATE '1998-06-15' THEN 2 * quantity ELSE quantity END)::DOUBLE AS quantity
FROM trades_t WHERE {EMPTIED} GROUP BY 1""")
oracle("rerun_without_rows", f"SELECT 'run-2' AS run_id, method, measure, {M('value')} AS value FROM totals_t")
oracle("backtest_carried", f"SELECT date, method, {M('var95')} AS var95, {M('var99')} AS var99, {M('pnl')} AS pnl FROM bt_t")
