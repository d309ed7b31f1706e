"""The catalog's results as SQL over the same tables, written independently of the operators."""

from __future__ import annotations

from shelfcast.plans.catalog import (
    CATEGORIES, CATEGORY_IDS, CHECK_END, CHECK_START, END, SKU, START, TARGET, TEST_START,
)
from shelfcast.plans.tables import UNITS

_SQL: dict[str, str] = {}

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ITEM = "lpad(substr(p.p_brand, 7), 2, '0')" + "".join(
    f" || substr('{_DIGITS}', ((p.p_partkey // {62 ** place}) % 62 + 1)::int, 1)" for place in (5, 3, 1, 4, 2, 0)
)

# Common table expressions, each with the names it needs before it.
_CTES: dict[str, tuple[list[str], str]] = {
    "sales": ([], f"""
        SELECT o.o_orderdate::date AS status_date, {_ITEM} AS item, p.p_name AS item_desc,
               l.l_quantity AS sales, l.l_extendedprice * (1 - l.l_discount) AS total_price,
               o.o_orderstatus AS order_status, p.p_type AS unit
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
        JOIN part p ON p.p_partkey = l.l_partkey"""),
    "stock": ([], f"""
        SELECT l.l_shipdate::date AS cur_date,
               CASE l.l_returnflag WHEN 'R' THEN 'return' WHEN 'A' THEN 'delivery'
                    WHEN 'N' THEN 'invoice' END AS inv_mov_type,
               {_ITEM} AS item, p.p_name AS desc_he, l.l_quantity AS quantity, p.p_type AS unit
        FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey"""),
    "supply": ([], """
        SELECT s.s_name AS supply_name, l.l_shipdate::date AS day, l.l_linestatus AS status,
               l.l_extendedprice AS total_price,
               CASE s.s_nationkey % 3 WHEN 0 THEN 1.0::double WHEN 1 THEN 3.7::double
                    ELSE 4.0::double END AS fixed_rate,
               l.l_extendedprice * CASE s.s_nationkey % 3 WHEN 0 THEN 1.0::double
                    WHEN 1 THEN 3.72::double ELSE 4.03::double END AS total_price_ILS
        FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey"""),
    "customers": ([], """
        SELECT c.c_custkey AS cust_id, n.n_name AS country, r.r_name AS state
        FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
        JOIN region r ON r.r_regionkey = n.n_regionkey"""),
    "erp": ([], """
        SELECT l.l_shipdate::date AS date, l.l_shipdate::date + 7 AS date_supply,
               l.l_partkey::varchar AS sku, l.l_quantity AS quantity,
               CASE WHEN l.l_linenumber <> 7 THEN round(l.l_discount * 100) END AS discount_percentage,
               l.l_extendedprice AS price_after_discount, p.p_retailprice AS price_per_unit,
               l.l_suppkey::varchar AS code_sales_person,
               p.p_name || ' 25 "' || p.p_type || '", loose' AS description_sku,
               p.p_brand AS code_manufacturer,
               round(l.l_extendedprice * l.l_quantity, 2)
                 + CASE WHEN l.l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS total_in_line,
               l.l_returnflag || '/' || l.l_linestatus AS delivery_type,
               l.l_extendedprice * l.l_quantity AS line_amount
        FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey"""),
    "inventory": ([], """
        SELECT l_orderkey::varchar AS doc, l_linenumber::varchar AS kline,
               CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS tquant,
               CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_extendedprice END AS cost,
               CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_returnflag END AS kind,
               l_quantity::varchar AS tquant_text, l_extendedprice::varchar AS cost_text,
               ['x1', '12d', '1.5f', '0x1p3', 'nan', 'Infinity'][l_linenumber % 6 + 1] AS no_number
        FROM lineitem"""),
    "raw_dates": ([], """
        SELECT CASE l_linenumber % 5
                 WHEN 0 THEN strftime(l_shipdate, '%-d/%-m/%y')
                 WHEN 1 THEN strftime(l_shipdate, '%-d/%-m/') || substr(strftime(l_shipdate, '%Y'), 2)
                 WHEN 2 THEN strftime(l_shipdate, '%m/%d/%Y')
                 WHEN 3 THEN strftime(l_shipdate, '%-d-%-m-%Y') END AS raw,
               count(*) AS lines
        FROM lineitem GROUP BY 1"""),
    "feed_rows": (["stock"], """
        SELECT i.item, i.desc_he, m.month, coalesce(sum(s.quantity), 0)::double AS quantity
        FROM (SELECT DISTINCT item, desc_he FROM stock) i
        CROSS JOIN (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH))::date AS month) m
        LEFT JOIN stock s ON s.item = i.item AND date_trunc('month', s.cur_date)::date = m.month
        GROUP BY 1, 2, 3"""),
    "per_month": (["stock"], """
        SELECT item, desc_he AS item_desc, strftime(cur_date, '%Y-%m') AS date,
               sum(CASE WHEN inv_mov_type = 'return' THEN -2 * quantity ELSE quantity END) AS sales
        FROM stock GROUP BY ALL"""),
    "days": ([], f"SELECT unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY))::date AS day"),
    "weeks": (["days"], "SELECT DISTINCT day - dayofweek(day)::int AS period FROM days"),
    "months": (["days"], "SELECT DISTINCT date_trunc('month', day)::date AS period FROM days"),
    "weekly_sales": (["sales", "weeks"], """
        SELECT w.period, coalesce(sum(s.sales), 0) AS sales,
               coalesce(sum(s.total_price), 0) AS total_price
        FROM weeks w LEFT JOIN sales s ON s.status_date BETWEEN w.period AND w.period + 6
        GROUP BY w.period"""),
    "daily_sales": (["sales"], """
        SELECT status_date AS day, sum(total_price) AS total FROM sales GROUP BY 1"""),
    "classed": (["sales"], """
        SELECT status_date - dayofweek(status_date)::int AS period, total_price,
               contains(item_desc, 'blue')::int + contains(item_desc, 'red')::int
                 + contains(item_desc, 'ring')::int + contains(item_desc, 'bolt')::int AS hits,
               contains(item_desc, 'blue') AS is_blue, contains(item_desc, 'red') AS is_red,
               contains(item_desc, 'ring') AS is_ring, contains(item_desc, 'bolt') AS is_bolt
        FROM sales"""),
    "item_months": (["stock"], """
        SELECT item, last_day(cur_date) AS ds, sum(quantity) AS y FROM stock GROUP BY 1, 2"""),
    "dense": (["item_months"], """
        SELECT i.item, m.ds, coalesce(x.y, 0)::double AS y
        FROM (SELECT DISTINCT item FROM item_months) i
        CROSS JOIN (SELECT DISTINCT ds FROM item_months) m
        LEFT JOIN item_months x ON x.item = i.item AND x.ds = m.ds"""),
    "panel": (["dense"], """
        SELECT unique_id, ds, sum(y)::double AS y FROM (
          SELECT item AS unique_id, ds, y FROM dense
          UNION ALL SELECT substr(item, 1, 2) || '_category', ds, y FROM dense
          UNION ALL SELECT substr(item, 3, 3) || '_catalog', ds, y FROM dense
          UNION ALL SELECT substr(item, 3, 6) || '_catalog+color', ds, y FROM dense)
        GROUP BY 1, 2"""),
    "extended": (["panel"], """
        SELECT s.unique_id, g.ds, p.y
        FROM (SELECT unique_id, min(ds) AS lo, max(ds) AS hi FROM panel GROUP BY 1) s
        JOIN (SELECT last_day(d::date) AS ds, last_day(d::date) > last.ds AS future
              FROM (SELECT max(ds) AS ds, min(ds) AS first FROM panel) last,
                   LATERAL (SELECT unnest(generate_series(date_trunc('month', last.first),
                      date_trunc('month', last.ds) + INTERVAL 12 MONTH, INTERVAL 1 MONTH)) AS d)) g
          ON g.future OR g.ds BETWEEN s.lo AND s.hi
        LEFT JOIN panel p ON p.unique_id = s.unique_id AND p.ds = g.ds"""),
    "train": (["panel"], f"""
        SELECT unique_id, list(ds ORDER BY ds) AS ds, list(y ORDER BY ds) AS y, count(*)::int AS n
        FROM panel WHERE ds < DATE '{TEST_START}' GROUP BY 1"""),
    "origins": (["train"], """
        SELECT t.*, f.fold, t.n - 40 + f.fold * 9 AS cut
        FROM train t, (SELECT unnest(range(0, 5))::int AS fold) f WHERE t.n - 40 + f.fold * 9 >= 1"""),
    "backtest": (["origins"], """
        SELECT unique_id, fold, ds[cut] AS cutoff, h, ds[cut + h] AS ds, y[cut + h] AS y, y[cut] AS Naive,
               CASE WHEN cut >= 12 THEN y[cut - 12 + (h - 1) % 12 + 1] END AS SeasonalNaive,
               CASE WHEN cut >= 6 THEN list_sum(y[cut - 5:cut]) / 6 END AS WindowAverage,
               CASE WHEN cut >= 4 THEN (y[cut - 2 + (h - 1) % 2 + 1] + y[cut - 4 + (h - 1) % 2 + 1]) / 2 END
                 AS SeasonalWindowAverage
        FROM origins, (SELECT unnest(range(1, 5))::int AS h) WHERE cut + h <= n"""),
    "indexed": (["panel"], f"""
        SELECT ds, unique_id, y, dense_rank() OVER (ORDER BY ds) - 1 AS time_idx,
               CASE WHEN ds < last_day(DATE '{TEST_START}') THEN 'train' ELSE 'test' END AS part
        FROM panel"""),
}


def _means(windows: int) -> str:
    """For every point the means of the last 1, 2, ... values, NULL unless all exist."""
    frames = [
        (w, f"(PARTITION BY unique_id ORDER BY ds ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)")
        for w in range(1, windows + 1)
    ]
    cells = [f"CASE WHEN count(y) OVER {frame} = {w} THEN avg(y) OVER {frame} END" for w, frame in frames]
    return f"SELECT unique_id, ds, y, [{', '.join(cells)}] AS means FROM extended"


_CTES["means"] = (["extended"], _means(12))
_CTES["wide_grid"] = (["means"], f"""
        SELECT unique_id, ds, y, [{', '.join(f'lag(means, {s}) OVER k' for s in range(1, 13))}] AS shifted
        FROM means WINDOW k AS (PARTITION BY unique_id ORDER BY ds)""")


def _results(grid: str, where: str = "true") -> str:
    return f"""
        SELECT unique_id, ds, y, s, w, v, abs(y - v) AS mae, abs(y - v) / nullif(y, 0) AS mape
        FROM (SELECT g.unique_id, g.ds, g.y, i.s, j.w, g.shifted[i.s][j.w] AS v
              FROM (SELECT * FROM {grid} WHERE {where}) g,
                   (SELECT unnest(range(1, 13)) AS s) i, (SELECT unnest(range(1, 13)) AS w) j)"""


_CHECK = f"ds BETWEEN DATE '{CHECK_START}' AND DATE '{CHECK_END}'"
_UPTO = f"ds BETWEEN DATE '{CHECK_START}' AND DATE '{TARGET}'"
_CTES["results"] = (["wide_grid"], _results("wide_grid"))
_CTES["checked"] = (["wide_grid"], _results("wide_grid", _CHECK))
_CTES["upto"] = (["wide_grid"], _results("wide_grid", _UPTO))
_CTES["pair_scores"] = (["upto"], f"""
        SELECT unique_id, s, w, printf('%.9e', avg(mae))::double AS score FROM upto GROUP BY 1, 2, 3
        HAVING avg(mae) IS NOT NULL
           AND NOT bool_or(ds = DATE '{TARGET}' AND v IS NULL)""")
_CTES["best_forecast"] = (["pair_scores"], """
        SELECT u.* FROM upto u JOIN (
          SELECT unique_id, s, w FROM pair_scores
          QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY score, w, s) = 1) b
        USING (unique_id, s, w)""")
_CTES["ar_rows"] = (["indexed"], """
        SELECT unique_id, time_idx, y, y - lag(y) OVER k AS d, lag(y) OVER k AS y1,
               lag(y) OVER k - lag(y, 2) OVER k AS d1
        FROM indexed WHERE part = 'train'
        WINDOW k AS (PARTITION BY unique_id ORDER BY time_idx)""")
_CTES["ar_fit"] = (["ar_rows"], """
        SELECT unique_id, count(*)::double AS n, avg(y) AS my, avg(y1) AS my1, avg(d) AS md,
               avg(d1) AS md1, regr_syy(y, y1) AS yy, regr_sxx(y, y1) AS xx, regr_sxy(y, y1) AS xy,
               regr_syy(d, d1) AS dd, regr_sxx(d, d1) AS ee, regr_sxy(d, d1) AS de,
               sum(y * y) AS scale
        FROM ar_rows WHERE d1 IS NOT NULL GROUP BY 1""")
_CTES["ar_last"] = (["ar_rows"], """
        SELECT unique_id, max(time_idx) AS last_idx, arg_max(y, time_idx) AS ly,
               arg_max(d, time_idx) AS ld
        FROM ar_rows GROUP BY 1""")
_CTES["ar_slopes"] = (["ar_fit"], """
        SELECT *, CASE WHEN n >= 5 AND xx > 0 THEN greatest(least(xy / xx, 0.999::double), -0.999::double) END AS b,
               CASE WHEN n >= 5 AND ee > 0 THEN greatest(least(de / ee, 0.999::double), -0.999::double) END AS c
        FROM ar_fit""")
_CTES["ar_scores"] = (["ar_slopes"], """
        SELECT unique_id, ord, model,
               CASE WHEN sse <= greatest(scale, 1.0) * 1e-12 THEN -1e300
                    ELSE n * ln(sse / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1) END AS aicc
        FROM (SELECT unique_id, n, scale, 0 AS ord, 'mean' AS model, yy AS sse, 2.0::double AS k FROM ar_slopes
              UNION ALL SELECT unique_id, n, scale, 1, 'drift', dd, 2.0 FROM ar_slopes
              UNION ALL SELECT unique_id, n, scale, 2, 'ar1', yy - 2 * b * xy + b * b * xx, 3.0 FROM ar_slopes
              UNION ALL SELECT unique_id, n, scale, 3, 'diff_ar1', dd - 2 * c * de + c * c * ee, 3.0 FROM ar_slopes)
        WHERE n >= 5 AND sse IS NOT NULL""")
_CTES["ar_best"] = (["ar_scores"], """
        SELECT unique_id, model FROM ar_scores
        QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY aicc, ord) = 1""")

_CTES["sar_past"] = (["indexed"], """
        SELECT unique_id, list(y ORDER BY time_idx) AS past, max(time_idx) AS last_idx, count(*) AS n
        FROM indexed WHERE part = 'train' GROUP BY 1""")
_CTES["sar_forms"] = (["sar_past"], """
        SELECT unique_id, d, past, x, len(x) AS m, list_sum(x) / len(x) AS mean
        FROM (SELECT unique_id, past, d, list_transform(range(13, n + 1),
                       lambda t: past[t] - CASE WHEN d = 1 THEN past[t - 12] ELSE 0 END) AS x
              FROM sar_past, (VALUES (0), (1)) v(d) WHERE n - 12 >= 20)""")
_CTES["sar_cov"] = (["sar_forms"], """
        SELECT *, list_transform(range(0, 13), lambda k: list_sum(list_transform(range(1, m - k + 1),
                    lambda t: (x[t] - mean) * (x[t + k] - mean))) / m) AS c
        FROM sar_forms""")
_CTES["sar_models"] = (["sar_cov"], """
        SELECT unique_id, d, 0 AS p, c[1] AS v, []::double[] AS phi, c FROM sar_cov
        UNION ALL
        SELECT unique_id, d, p + 1, v * (1 - r * r),
               list_append(list_transform(range(1, p + 1), lambda j: phi[j] - r * phi[p + 1 - j]), r), c
        FROM (SELECT *, (c[p + 2] - coalesce(list_sum(list_transform(range(1, p + 1),
                        lambda j: phi[j] * c[p + 2 - j])), 0)) / v AS r
              FROM sar_models WHERE p < 12 AND v > c[1] * 1e-9)""")
_CTES["sar_best"] = (["sar_models"], """
        SELECT f.unique_id, f.d, s.p, s.phi, f.past, f.x, f.mean
        FROM sar_forms f JOIN sar_models s ON s.unique_id = f.unique_id AND s.d = f.d
        WHERE s.p < f.m - 3
        QUALIFY row_number() OVER (PARTITION BY f.unique_id ORDER BY
          CASE WHEN s.v > 0 THEN printf('%.9e', f.m * ln(s.v) + 2 * (s.p + 2.0)
               + 2 * (s.p + 2.0) * (s.p + 3.0) / nullif(f.m - s.p - 3.0, 0))::double
               ELSE '-inf'::double END NULLS LAST, f.d, s.p) = 1""")
_CTES["sar_steps"] = (["sar_best"], """
        SELECT unique_id, d, p, phi, mean, 0 AS h, x, past FROM sar_best
        UNION ALL
        SELECT unique_id, d, p, phi, mean, h + 1, list_append(x, z),
               list_append(past, z + CASE WHEN d = 1 THEN past[len(past) - 11] ELSE 0 END)
        FROM (SELECT *, mean + coalesce(list_sum(list_transform(range(1, p + 1),
                        lambda j: phi[j] * (x[len(x) + 1 - j] - mean))), 0) AS z
              FROM sar_steps WHERE h < (SELECT count(DISTINCT time_idx) FROM indexed WHERE part = 'test'))""")


def _collect(names: list[str], seen: dict[str, str]) -> None:
    for name in names:
        if name not in seen:
            needs, body = _CTES[name]
            _collect(needs, seen)
            seen[name] = body


def _add(name: str, ctes: list[str], body: str) -> None:
    seen: dict[str, str] = {}
    _collect(ctes, seen)
    head = ",\n".join(f"{n} AS ({b})" for n, b in seen.items())
    recursive = "RECURSIVE " if any(f"FROM {n}" in b for n, b in seen.items()) else ""
    _SQL[name] = f"WITH {recursive}{head}\n{body}" if head else body


def statements() -> dict[str, str]:
    return dict(_SQL)


def _day(column: str, alias: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d') AS {alias or column.split('.')[-1]}"


# ---------------------------------------------------------------- ingestion and cleaning

_add("load_delimited", ["erp"], """
    SELECT description_sku, delivery_type, count(*) AS lines,
           round(sum(price_after_discount), 4) AS price, round(sum(quantity), 4) AS quantity
    FROM erp GROUP BY 1, 2""")
_add("write_csv", ["sales", "months"], f"""
    SELECT {_day('m.period')}, round(coalesce(sum(s.sales), 0), 4)::double AS sales
    FROM months m LEFT JOIN sales s ON date_trunc('month', s.status_date) = m.period
    GROUP BY m.period""")
_add("load_json_envelope", ["inventory"], """
    SELECT doc AS "DOC", kline AS "KLINE", coalesce(CASE WHEN tquant IS NOT NULL THEN tquant_text END, 'None') AS "TQUANT",
           coalesce(CASE WHEN cost IS NOT NULL THEN cost_text END, no_number) AS "COST", coalesce(kind, 'None') AS "TYPE"
    FROM inventory""")
_SQL["load_pretty_envelope"] = _SQL["load_json_envelope"]
_add("explode_order_items", [], """
    SELECT l_linenumber * 10 + part AS "KLINE", l_quantity * sign AS "TQUANT",
           l_orderkey::varchar AS "ORDNAME"
    FROM lineitem JOIN (VALUES ('R', 1, 1), ('R', 2, -1), ('A', 1, 1)) v(flag, part, sign)
      ON flag = l_returnflag""")
_add("order_headers", [], """
    SELECT o_orderkey::varchar AS "ORDNAME", o_orderstatus AS "STATUS" FROM orders""")
_add("normalize_null_tokens", ["inventory"], """
    SELECT doc AS "DOC", kline AS "KLINE", CASE WHEN tquant IS NOT NULL THEN tquant_text END AS "TQUANT",
           coalesce(CASE WHEN cost IS NOT NULL THEN cost_text END, no_number) AS "COST", kind AS "TYPE"
    FROM inventory""")
_add("coerce_numeric", ["inventory"], """
    SELECT doc AS "DOC", kline AS "KLINE", round(tquant, 4) AS "TQUANT", round(cost, 4) AS "COST",
           coalesce(kind, 'None') AS "TYPE"
    FROM inventory""")
_add("normalize_dmy_date", ["raw_dates"], """
    SELECT raw, lines,
           CASE WHEN len(string_split(raw, '/')) = 3 THEN
             lpad(string_split(raw, '/')[1], 2, '0') || '/' || lpad(string_split(raw, '/')[2], 2, '0')
             || '/' || CASE len(string_split(raw, '/')[3]) WHEN 2 THEN '20' WHEN 3 THEN '2' ELSE '' END
             || string_split(raw, '/')[3] ELSE raw END AS normalized
    FROM raw_dates""")
_add("parse_date_or_null", ["raw_dates"], """
    SELECT raw, lines, strftime(d, '%Y-%m-%d') AS parsed, strftime(d, '%d-%m-%Y') AS dashed,
           strftime(dd, '%d-%m-%Y') AS from_dashes
    FROM (SELECT raw, lines,
            CASE WHEN regexp_full_match(raw, '[0-9]+/[0-9]+/[0-9]{4}') THEN try_strptime(raw, '%d/%m/%Y') END AS d,
            CASE WHEN regexp_full_match(raw, '[0-9]+-[0-9]+-[0-9]{4}') THEN try_strptime(raw, '%d-%m-%Y') END AS dd
          FROM raw_dates)""")
_add("normalize_item_code", [], """
    SELECT p_partkey, CASE p_size % 6 WHEN 3 THEN 'A-' || p_partkey
             WHEN 4 THEN (-p_partkey)::varchar WHEN 5 THEN 'nan' ELSE p_partkey::varchar END AS sku
    FROM part""")
_add("clean_amount", ["erp"], """
    SELECT round(price_after_discount, 4) AS price, round(discount_percentage, 4) AS discount,
           count(*) AS lines
    FROM erp GROUP BY price_after_discount, discount_percentage""")
_add("conform_erp_lines", ["erp"], f"""
    SELECT {_day('date')}, {_day('date_supply')}, sku, round(quantity, 4) AS quantity,
           round(discount_percentage, 4) AS discount_percentage,
           round(price_after_discount, 4) AS price_after_discount,
           round(price_per_unit, 4) AS price_per_unit, code_sales_person, description_sku,
           code_manufacturer, round(total_in_line, 4) AS total_in_line, delivery_type,
           round(line_amount, 4) AS line_amount
    FROM erp""")
_add("yearly_amount", ["erp"], f"""
    SELECT strftime(make_date(y.y, 1, 1), '%Y-%m-%d') AS period,
           round(coalesce(sum(e.line_amount), 0), 4)::double AS line_amount
    FROM (SELECT unnest(range({START[:4]}, 2004))::int AS y) y
    LEFT JOIN erp e ON year(e.date) = y.y GROUP BY y.y""")
_add("unpivot_month_columns", ["feed_rows"], """
    SELECT item, desc_he, strftime(month, '%Y-%m-%d') AS date, quantity
    FROM feed_rows""")
_add("representative_unit", ["stock"], "SELECT item, min(unit) AS unit FROM stock GROUP BY 1")
_add("conform_stock_log", ["feed_rows"], """
    SELECT strftime(month, '%Y-%m-%d') AS cur_date,
           'דאטה מסאפ' AS inv_mov_type, NULL::varchar AS doc_no, NULL::varchar AS cust_id,
           NULL::varchar AS cust_name, NULL::varchar AS supply_id, NULL::varchar AS supply_name,
           NULL::varchar AS warehouse_name, f.item, f.desc_he, f.quantity, u.unit,
           0.0::double AS "UCOST", 0.0::double AS "COST", 0.0::double AS "USECONDCOST",
           0.0::double AS "SECONDCOST", NULL::varchar AS coin, NULL::varchar AS to_warehouse_name,
           NULL::varchar AS general_item,
           strftime(month, '%Y-%m-%d') AS update_date,
           '0' AS trans_id, NULL::varchar AS line_id, NULL::varchar AS type
    FROM feed_rows f LEFT JOIN (SELECT item, min(unit) AS unit FROM stock GROUP BY 1) u USING (item)""")
_add("append_table", ["stock"], """
    SELECT inv_mov_type, unit, CASE WHEN inv_mov_type = 'invoice' THEN 2 ELSE 1 END * count(*) AS lines,
           round(CASE WHEN inv_mov_type = 'invoice' THEN 2 ELSE 1 END * sum(quantity), 4) AS quantity
    FROM stock GROUP BY 1, 2""")
_add("append_once", ["stock"], """
    SELECT inv_mov_type, unit, count(*) AS lines, round(sum(quantity), 4) AS quantity
    FROM stock GROUP BY 1, 2""")
_add("publish_once", ["panel"], f"""
    SELECT {_day('ds')}, unique_id, round(y, 4) AS y FROM panel WHERE unique_id LIKE '%\\_category' ESCAPE '\\'""")
_add("load_delimited_rescued", [], """
    SELECT CASE l_linenumber WHEN 7 THEN 'not a number' WHEN 6 THEN 'a field too many' ELSE 'fits' END AS kind,
           count(*) AS lines, round(sum(l_quantity) FILTER (l_linenumber < 6), 4) AS quantity
    FROM lineitem GROUP BY 1""")
_add("filter_and_publish", ["panel"], f"""
    SELECT {_day('ds')}, unique_id, round(y, 4) AS y FROM panel WHERE unique_id LIKE '%\\_category' ESCAPE '\\'""")

# ---------------------------------------------------------------- filters and dimensions

_add("in_filter", ["sales"], """
    SELECT order_status, count(*) AS lines, round(sum(sales), 4) AS sales
    FROM sales WHERE order_status IN ('F', 'O') GROUP BY 1""")
_add("code_part_filter", ["sales"], """
    SELECT item, count(*) AS lines, round(sum(sales), 4) AS sales FROM sales
    WHERE substr(item, 3, 3) IN ('000', '001', '009') AND substr(item, 1, 2) IN ('01', '02', '11', '25')
    GROUP BY 1""")
_add("item_dimension_filter", ["sales"], """
    SELECT item, unit, count(*) AS lines, round(sum(sales), 4) AS sales FROM sales
    WHERE substr(item, 1, 2) IN ('03', '17') OR substr(item, 6, 3) IN ('007', '00K') GROUP BY 1, 2""")
_add("date_range_filter", [], """
    SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS orders FROM orders
    WHERE o_orderdate::date BETWEEN DATE '1996-02-29' AND DATE '1999-12-31' GROUP BY 1""")
_add("measure", ["sales"], """
    SELECT order_status, round(sum(total_price), 4) AS income, round(sum(sales), 4) AS sales
    FROM sales GROUP BY 1""")
_add("period_start", [], """
    SELECT strftime(day, '%Y-%m-%d') AS day, orders, strftime(day, '%Y-%m-%d') AS "start_D",
           strftime(day - dayofweek(day)::int, '%Y-%m-%d') AS "start_W",
           strftime(day, '%Y-%m-01') AS "start_M",
           strftime(date_trunc('quarter', day), '%Y-%m-%d') AS "start_Q",
           strftime(day, '%Y-01-01') AS "start_Y",
           strftime(date_trunc('week', day)::date + 6, '%Y-%m-%d') AS "end_W"
    FROM (SELECT o_orderdate::date AS day, count(*) AS orders FROM orders GROUP BY 1)""")
_add("period_label", [], """
    SELECT strftime(day, '%Y-%m-%d') AS day, orders,
           strftime(day - dayofweek(day)::int, '%Y-%m-%d') AS "label_W",
           strftime(day, '%Y-%m') AS "label_M", strftime(day, '%Y') AS "label_Y"
    FROM (SELECT o_orderdate::date AS day, count(*) AS orders FROM orders GROUP BY 1)""")
_add("calendar_fill", ["sales", "weeks"], f"""
    SELECT u.unit, {_day('w.period')}, round(coalesce(sum(s.sales), 0), 4)::double AS sales,
           round(coalesce(sum(s.total_price), 0), 4)::double AS total_price
    FROM weeks w CROSS JOIN (SELECT DISTINCT unit FROM sales) u
    LEFT JOIN (SELECT *, status_date - dayofweek(status_date)::int AS period FROM sales) s
      ON s.period = w.period AND s.unit = u.unit
    GROUP BY 1, 2""")

# ---------------------------------------------------------------- reports

_add("period_totals", ["weekly_sales"], f"""
    SELECT {_day('period')}, round(total_price, 4)::double AS total_price FROM weekly_sales""")
_add("topk_item_series", ["sales", "weeks"], f"""
    SELECT {_day('w.period')}, t.item, round(coalesce(sum(s.total_price), 0), 4)::double AS total_price
    FROM weeks w CROSS JOIN (SELECT item FROM sales GROUP BY item
                             ORDER BY sum(total_price) DESC, item LIMIT 7) t
    LEFT JOIN sales s ON s.item = t.item AND s.status_date BETWEEN w.period AND w.period + 6
    GROUP BY 1, 2""")
_add("topk_and_others", ["sales"], """
    SELECT item_bucket, round(total_price, 4) AS total_price,
           round(100.0 * total_price / sum(total_price) OVER (), 4) AS share
    FROM (SELECT CASE WHEN item IN (SELECT item FROM sales GROUP BY item
                                    ORDER BY sum(total_price) DESC, item LIMIT 10)
                      THEN item ELSE 'others' END AS item_bucket, sum(total_price) AS total_price
          FROM sales GROUP BY 1)""")
_add("avg_by_weekday", ["daily_sales"], """
    SELECT n.name AS day_of_week, round(coalesce(avg(d.total), 0), 4)::double AS avg_total_price
    FROM (VALUES ('Sunday'), ('Monday'), ('Tuesday'), ('Wednesday'), ('Thursday'), ('Friday'),
                 ('Saturday')) n(name)
    LEFT JOIN daily_sales d ON dayname(d.day) = n.name GROUP BY 1""")
_add("avg_by_day_of_month", ["daily_sales"], """
    SELECT n.n::int AS day_of_month, round(coalesce(avg(d.total), 0), 4)::double AS avg_total_price
    FROM (SELECT unnest(range(1, 32)) AS n) n LEFT JOIN daily_sales d ON day(d.day) = n.n GROUP BY 1""")
_add("avg_by_month", ["sales"], """
    SELECT month(status_date)::int AS month, round(avg(total_price), 4) AS avg_total_price
    FROM sales GROUP BY 1""")
_add("material_mix_series", ["sales", "weeks"], f"""
    SELECT {_day('w.period')},
      round(coalesce(sum(total_price) FILTER (item_desc LIKE '%ring%' AND item_desc NOT LIKE '%red%'), 0), 4)::double AS only_ring,
      round(coalesce(sum(total_price) FILTER (item_desc LIKE '%red%' AND item_desc NOT LIKE '%ring%'), 0), 4)::double AS only_red,
      round(coalesce(sum(total_price) FILTER (item_desc LIKE '%ring%' AND item_desc LIKE '%red%'), 0), 4)::double AS ring_and_red,
      round(coalesce(sum(total_price) FILTER (item_desc NOT LIKE '%ring%' AND item_desc NOT LIKE '%red%'), 0), 4)::double AS neither_ring_nor_red
    FROM weeks w LEFT JOIN sales s ON s.status_date BETWEEN w.period AND w.period + 6
    GROUP BY w.period""")


def _color_sum(condition: str, alias: str) -> str:
    return f"round(coalesce(sum(total_price) FILTER ({condition}), 0), 4)::double AS {alias}"


_add("color_mix_series", ["classed", "weeks"], f"""
    SELECT {_day('w.period')},
      {', '.join(_color_sum(f'hits = 1 AND is_{c}', c) for c in ('blue', 'red', 'ring', 'bolt'))},
      {_color_sum('hits > 1', 'more_than_1_color')}, {_color_sum('hits = 0', 'other')}
    FROM weeks w LEFT JOIN classed c ON c.period = w.period GROUP BY w.period""")
_add("color_totals", ["classed"], """
    SELECT CASE WHEN hits > 1 THEN 'more than 1 color' WHEN is_blue THEN 'blue' WHEN is_red THEN 'red'
             WHEN is_ring THEN 'ring' WHEN is_bolt THEN 'bolt' ELSE 'other' END AS color,
           round(sum(total_price), 4) AS total_price
    FROM classed GROUP BY 1""")
_add("qty_vs_income", ["weekly_sales"], f"""
    SELECT {_day('period')}, round(sales, 4)::double AS sales, round(total_price, 4)::double AS total_price
    FROM weekly_sales""")
_add("supply_spend_by_status", ["supply"], """
    SELECT status, round(sum(total_price * fixed_rate), 4) AS "total_expense_ILS" FROM supply GROUP BY 1""")
_add("income_vs_expense", ["weekly_sales", "supply"], f"""
    SELECT {_day('period')}, round(total_price, 4)::double AS total_price,
           round(expense, 4)::double AS "total_expense_ILS",
           (round(total_price - expense, 4) + 0.0)::double AS diff
    FROM (SELECT w.period, w.total_price, coalesce(sum(s.total_price * s.fixed_rate), 0) AS expense
          FROM weekly_sales w LEFT JOIN supply s ON s.day BETWEEN w.period AND w.period + 6
          GROUP BY 1, 2)""")
_add("order_value_histogram", [], """
    SELECT (b.b * 2000)::double AS bin_start, ((b.b + 1) * 2000)::double AS bin_end,
           count(o.o_orderkey) AS count
    FROM (SELECT unnest(range(0, 249)) AS b) b
    LEFT JOIN orders o ON o.o_totalprice >= b.b * 2000
      AND (o.o_totalprice < (b.b + 1) * 2000 OR (b.b = 248 AND o.o_totalprice = 498000))
    GROUP BY b.b""")
_add("income_by_country", ["customers"], """
    SELECT c.country AS cust_country, round(sum(o.o_totalprice), 4) AS total_price_with_discount
    FROM orders o LEFT JOIN customers c ON c.cust_id = o.o_custkey GROUP BY 1""")
_add("orders_per_day", ["days"], """
    SELECT strftime(d.day, '%Y-%m-%d') AS status_date, count(o.o_orderkey) AS order_count
    FROM days d LEFT JOIN orders o ON o.o_orderdate::date = d.day GROUP BY 1""")
_add("rolling_variance", ["weekly_sales"], f"""
    SELECT {_day('period')}, round(total_price, 4)::double AS total_price,
           CASE WHEN count(*) OVER k = 7 THEN round(var_samp(total_price) OVER k, -3) END AS price_variance
    FROM weekly_sales WINDOW k AS (ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
_add("rolling_mean", ["weekly_sales"], f"""
    SELECT {_day('period')}, round(total_price, 4)::double AS total_price,
           CASE WHEN count(*) OVER k = 7 THEN round(avg(total_price) OVER k, 4) END AS moving_average
    FROM weekly_sales WINDOW k AS (ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
_add("stock_movement_series", ["stock", "weeks"], f"""
    SELECT {_day('w.period')}, round(coalesce(sum(s.quantity), 0), 4)::double AS total_quantity
    FROM weeks w LEFT JOIN stock s ON s.cur_date BETWEEN w.period AND w.period + 6
      AND s.inv_mov_type IN ('return', 'invoice') GROUP BY 1""")
_add("net_outgoing", ["stock", "weeks"], f"""
    SELECT {_day('w.period')},
           (round_even(CASE WHEN count(s.quantity) FILTER (s.inv_mov_type <> 'return') > 0
             THEN sum(s.quantity) FILTER (s.inv_mov_type <> 'return')
                  - coalesce(sum(s.quantity) FILTER (s.inv_mov_type = 'return'), 0)
             ELSE 0 END, 2) + 0.0)::double AS net_quantity
    FROM weeks w LEFT JOIN stock s ON s.cur_date BETWEEN w.period AND w.period + 6 GROUP BY 1""")
_add("supply_spend_by_supplier", ["supply"], """
    SELECT supply_name, round(sum(total_price_ILS), 4) AS "total_price_ILS",
           round(100.0 * sum(total_price_ILS) / sum(sum(total_price_ILS)) OVER (), 4) AS share
    FROM supply GROUP BY 1""")
_add("supply_spend_series", ["supply", "weeks"], f"""
    SELECT {_day('w.period')}, round_even(coalesce(sum(s.total_price_ILS), 0), 0)::double AS "total_price_ILS"
    FROM weeks w LEFT JOIN supply s ON s.day BETWEEN w.period AND w.period + 6 GROUP BY 1""")
_add("income_by_state", ["customers"], """
    SELECT cust_city, round(total, 4) AS total_price_with_discount,
           format('{} - {:.2f} ILS', cust_city, total) AS label
    FROM (SELECT c.state AS cust_city, sum(o.o_totalprice) AS total
          FROM orders o LEFT JOIN customers c ON c.cust_id = o.o_custkey GROUP BY 1)""")
_add("unique_customers_series", ["weeks"], f"""
    SELECT {_day('w.period')}, count(DISTINCT o.o_custkey) AS unique_customers
    FROM weeks w LEFT JOIN orders o ON o.o_orderdate::date BETWEEN w.period AND w.period + 6 GROUP BY 1""")
_add("unique_customers_rollup", [], f"""
    WITH o AS (SELECT o_orderdate::date AS day, o_custkey FROM orders
               WHERE o_orderdate::date BETWEEN DATE '{START}' AND DATE '{END}')
    SELECT freq, strftime(period, '%Y-%m-%d') AS period, count(DISTINCT o_custkey) AS unique_customers
    FROM (SELECT 'D' AS freq, day AS period, o_custkey FROM o
          UNION ALL SELECT 'W', day - dayofweek(day)::int, o_custkey FROM o
          UNION ALL SELECT 'M', date_trunc('month', day)::date, o_custkey FROM o
          UNION ALL SELECT 'Q', date_trunc('quarter', day)::date, o_custkey FROM o
          UNION ALL SELECT 'Y', date_trunc('year', day)::date, o_custkey FROM o)
    GROUP BY 1, 2""")
_add("total_income", ["sales"], "SELECT round(sum(total_price), 4) AS total_income FROM sales")
_add("share_of_total", ["sales"], """
    SELECT unit, order_status, round(sum(total_price), 4) AS total_price,
           round(100.0 * sum(total_price) / sum(sum(total_price)) OVER (), 4) AS share
    FROM sales GROUP BY 1, 2""")

# ---------------------------------------------------------------- data quality

_add("profile_columns", [], " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
           round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min,
           round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
           round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
))
_add("schema_and_nulls", ["inventory"], """
    SELECT v.position::int AS position, v.name AS "column", 'string' AS type, v.non_null,
           (SELECT count(*) FROM lineitem) - v.non_null AS nulls
    FROM (SELECT 0 AS position, 'DOC' AS name, count(doc) AS non_null FROM inventory
          UNION ALL SELECT 1, 'KLINE', count(kline) FROM inventory
          UNION ALL SELECT 2, 'TQUANT', count(tquant) FROM inventory
          UNION ALL SELECT 3, 'COST', count(*) FROM inventory
          UNION ALL SELECT 4, 'TYPE', count(kind) FROM inventory) v""")
_add("line_total_mismatch", ["erp"], f"""
    SELECT {_day('date')}, sku, round(total_in_line, 4) AS total_in_line, round(line_amount, 4) AS line_amount
    FROM erp WHERE total_in_line <> line_amount""")
_add("line_total_summary", ["erp"], """
    SELECT count(*) FILTER (total_in_line <> line_amount) AS mismatched,
           count(*) FILTER (total_in_line = line_amount) AS matched FROM erp""")
_add("distinct_counts", ["erp"], """
    SELECT count(*) AS rows, count(DISTINCT sku) AS distinct_sku,
           count(DISTINCT description_sku) AS distinct_description_sku FROM erp""")
_add("topn_by_count", ["erp"], """
    SELECT sku, count(quantity) AS count_quantity FROM erp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
_add("value_counts", ["erp"], "SELECT delivery_type, count(*) AS count FROM erp GROUP BY 1")
_add("histogram", ["erp"], """
    SELECT b.b::double AS bin_start, (b.b + 1)::double AS bin_end, count(e.quantity) AS count
    FROM (SELECT unnest(range(-100, 999)) AS b) b
    LEFT JOIN erp e ON floor(e.quantity) = b.b OR (b.b = 998 AND e.quantity = 999) GROUP BY b.b""")
_add("equal_bin_histogram", ["erp"], """
    SELECT b.b::int AS bin, round(any_value(m.lo) + b.b * (any_value(m.hi) - any_value(m.lo)) / 2000, 6) AS bin_start,
           count(e.p) AS count
    FROM (SELECT unnest(range(0, 2000)) AS b) b
    CROSS JOIN (SELECT min(price_per_unit) AS lo, max(price_per_unit) AS hi FROM erp) m
    LEFT JOIN (SELECT price_per_unit AS p, least(floor((price_per_unit - min(price_per_unit) OVER ()) * 2000.0::double
                 / (max(price_per_unit) OVER () - min(price_per_unit) OVER ())), 1999) AS bin FROM erp) e
      ON e.bin = b.b
    GROUP BY b.b""")
_add("monthly_amount", ["erp"], """
    SELECT strftime(date, '%Y-%m-01') AS month, round(sum(line_amount), 4) AS line_amount
    FROM erp GROUP BY 1""")
_add("yearly_split", ["erp"], f"""
    SELECT strftime(date, '%Y-01-01') AS period,
           round(coalesce(sum(line_amount) FILTER (sku = '{SKU}'), 0), 4)::double AS own_amount,
           round(coalesce(sum(line_amount) FILTER (sku <> '{SKU}'), 0), 4)::double AS other_amount
    FROM erp GROUP BY 1""")
_add("descriptions_of_sku", ["erp"], f"""
    SELECT description_sku, count(quantity) AS count_quantity, description_sku LIKE '%loose%' AS has_word
    FROM erp WHERE sku = '{SKU}' GROUP BY 1, 3 ORDER BY 2 DESC, 1 LIMIT 50""")
_add("positive_item_totals", ["per_month"], """
    SELECT item, round(sum(sales), 4) AS sales FROM per_month GROUP BY 1 HAVING sum(sales) > 0""")
_add("seasonal_totals", ["per_month"], """
    SELECT string_split(date, '-')[2] AS part, round(sum(sales), 4) AS sales FROM per_month GROUP BY 1
    UNION ALL SELECT string_split(date, '-')[1], round(sum(sales), 4) FROM per_month GROUP BY 1""")
_add("top_item_series", ["per_month"], """
    SELECT item, item_desc, date, round(sales, 4) AS sales FROM per_month
    WHERE item IN (SELECT item FROM per_month GROUP BY item HAVING sum(sales) > 0
                   ORDER BY sum(sales) DESC, item LIMIT 10)""")
_add("null_measure_items", ["sales"], "SELECT DISTINCT item FROM sales WHERE sales = 50")

_CATEGORY_LIST, _UNIT_LIST = (", ".join(f"'{x}'" for x in xs) for xs in (CATEGORIES, UNITS))
_SCOPED = f"substr(item, 1, 2) IN ({_CATEGORY_LIST}) AND unit IN ({_UNIT_LIST})"
_RANGE = "BETWEEN DATE '1996-02-29' AND DATE '2000-10-31'"
_CTES["scoped_weeks"] = ([], """
        SELECT DISTINCT day - dayofweek(day)::int AS period FROM (
          SELECT unnest(generate_series(DATE '1996-02-29', DATE '2000-10-31', INTERVAL 1 DAY))::date AS day)""")
_add("period_totals_scoped", ["sales", "scoped_weeks"], f"""
    SELECT {_day('w.period')}, round(coalesce(sum(s.sales), 0), 4)::double AS sales
    FROM scoped_weeks w LEFT JOIN (
      SELECT * FROM sales WHERE {_SCOPED} AND order_status IN ('F', 'P') AND status_date {_RANGE}) s
      ON s.status_date BETWEEN w.period AND w.period + 6 GROUP BY 1""")
_add("period_totals_week_end", ["sales", "days"], f"""
    SELECT {_day('w.period')}, round(coalesce(sum(s.sales), 0), 4)::double AS sales
    FROM (SELECT DISTINCT day + (7 - isodow(day))::int AS period FROM days) w
    LEFT JOIN sales s ON s.status_date BETWEEN w.period - 6 AND w.period GROUP BY 1""")
_add("net_outgoing_scoped", ["stock", "scoped_weeks"], f"""
    SELECT {_day('w.period')}, (round_even(coalesce(sum(
             CASE s.inv_mov_type WHEN 'return' THEN -s.quantity ELSE s.quantity END), 0), 2) + 0.0)::double AS net_quantity
    FROM scoped_weeks w LEFT JOIN (
      SELECT * FROM stock WHERE {_SCOPED} AND inv_mov_type IN ('delivery', 'return') AND cur_date {_RANGE}) s
      ON s.cur_date BETWEEN w.period AND w.period + 6 GROUP BY 1""")
_add("supply_spend_scoped", ["supply"], f"""
    SELECT status, round(sum(total_price * CASE fixed_rate WHEN 4.0 THEN NULL ELSE fixed_rate END), 4) AS "total_expense_ILS"
    FROM supply WHERE status = 'F' AND day {_RANGE} GROUP BY 1""")
_add("rows_by_description", ["erp"], f"""
    SELECT {_day('date')}, sku, description_sku, round(quantity, 4) AS quantity
    FROM erp WHERE sku = '{SKU}' AND contains(description_sku, 'loose')""")
_add("rows_by_presence", ["inventory"], """
    SELECT CASE WHEN cost IS NULL THEN 'missing' ELSE 'set' END AS part, kind AS "TYPE", count(*) AS lines,
           round(sum(cost), 4) AS cost
    FROM inventory GROUP BY 1, 2""")
_add("topn_by_sum", ["erp"], """
    SELECT sku, round(sum(quantity), 4) AS sum_quantity FROM erp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
_add("discount_histogram", ["erp"], """
    SELECT b.b::double AS bin_start, (b.b + 1)::double AS bin_end, count(e.discount_percentage) AS count
    FROM (SELECT unnest(range(0, 100)) AS b) b
    LEFT JOIN erp e ON floor(e.discount_percentage) = b.b OR (b.b = 99 AND e.discount_percentage = 100)
    GROUP BY b.b""")
_add("inventory_to_table", ["inventory"], """
    SELECT kind AS "TYPE", count(*) AS lines, count(cost) AS costs, round(sum(tquant), 4) AS "TQUANT",
           min(doc::double) AS first_doc, max(kline::double) AS last_line
    FROM inventory GROUP BY 1""")

# ---------------------------------------------------------------- forecasting

_add("densify_panel", ["dense"], f"SELECT item, {_day('ds')}, round(y, 4) AS y FROM dense")
_add("hierarchy_rollup", ["panel"], f"SELECT unique_id, {_day('ds')}, round(y, 4) AS y FROM panel")
_add("extend_series", ["extended"], f"""
    SELECT unique_id, {_day('ds')}, round(y, 4) AS y FROM extended""")
_add("swa_grid", ["results"], """
    SELECT CASE WHEN unique_id LIKE '%category' THEN 'category' WHEN unique_id LIKE '%catalog' THEN 'catalog'
             WHEN unique_id LIKE '%color' THEN 'catalog+color' ELSE 'item' END AS level, s::int AS s, w::int AS w,
           count(*) AS points, count(v) AS predicted, round(avg(v), 4) AS mean_prediction
    FROM results GROUP BY 1, 2, 3""")
_add("forecast_errors", ["results"], """
    SELECT unique_id, count(mae) AS errors, round(avg(mae), 4) AS "MAE", count(mape) AS ratios,
           round(avg(mape), 4) AS "MAPE"
    FROM results GROUP BY 1""")
_add("best_window", ["checked"], """
    SELECT unique_id, s::int AS s, w::int AS w, round(score, 4) AS "MAE_mean"
    FROM (SELECT unique_id, s, w, printf('%.9e', avg(mae))::double AS score FROM checked GROUP BY 1, 2, 3
          HAVING avg(mae) IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY score, s, w) = 1""")
_add("best_window_mape", ["checked"], """
    SELECT unique_id, s::int AS s, w::int AS w, round(score, 4) AS "MAPE_mean"
    FROM (SELECT unique_id, s, w, printf('%.9e', avg(mape))::double AS score FROM checked GROUP BY 1, 2, 3
          HAVING avg(mape) IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY score, w, s) = 1""")
_CTES["demand_months"] = (["stock"], f"""
        SELECT item, last_day(cur_date) AS ds, sum(quantity) AS y FROM stock
        WHERE inv_mov_type IN ('return', 'delivery') AND substr(item, 1, 2) IN ({_CATEGORY_LIST})
          AND cur_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY 1, 2""")
_CTES["demand_ids"] = (["demand_months"], """
        SELECT item AS unique_id, ds, y FROM demand_months
        UNION ALL SELECT substr(item, 1, 2) || '_category', ds, y FROM demand_months
        UNION ALL SELECT substr(item, 3, 3) || '_catalog', ds, y FROM demand_months
        UNION ALL SELECT substr(item, 3, 6) || '_catalog+color', ds, y FROM demand_months""")
_add("demand_panel", ["demand_ids"], f"""
    SELECT i.unique_id, {_day('m.ds')}, round(coalesce(sum(x.y), 0), 4)::double AS y
    FROM (SELECT DISTINCT unique_id FROM demand_ids) i CROSS JOIN (SELECT DISTINCT ds FROM demand_ids) m
    LEFT JOIN demand_ids x ON x.unique_id = i.unique_id AND x.ds = m.ds GROUP BY 1, 2""")
_add("best_window_forecast", ["best_forecast"], f"""
    SELECT unique_id, {_day('ds')}, s::int AS s, w::int AS w, round(y, 4) AS y,
           round(v, 4) AS "SWA_value", round(mae, 4) AS "MAE", round(mape, 4) AS "MAPE"
    FROM best_forecast""")
_add("actual_vs_forecast_wide", ["best_forecast"], f"""
    SELECT strftime(ds, '%Y-%m') AS month,
      {', '.join(
          f'''round(max(v) FILTER (unique_id = '{u}'), 4) AS "{u}_SWA_value",
              round(max(y) FILTER (unique_id = '{u}'), 4) AS "{u}_y"''' for u in CATEGORY_IDS)}
    FROM best_forecast WHERE unique_id LIKE '%\\_category' ESCAPE '\\' GROUP BY 1""")
_add("reshape_forecast_columns", ["results"], f"""
    SELECT unique_id, s::int AS s, w::int AS w, count(*) AS points, count(v) AS predicted,
           {_day('min(ds)', 'first_ds')}, {_day('max(ds)', 'last_ds')},
           round(avg(v) * (1 + 1e-9::double), 4) AS "SWA_value", round(avg(mae) * (1 + 1e-9::double), 4) AS "MAE",
           round(avg(mape) * (1 + 1e-9::double), 4) AS "MAPE"
    FROM results GROUP BY 1, 2, 3""")
_add("baseline_backtest", ["backtest"], f"""
    SELECT unique_id, fold::int AS fold, {_day('cutoff')}, h::int AS h, {_day('ds')}, round(y, 4) AS y,
           round(Naive, 4) AS "Naive", round(SeasonalNaive, 4) AS "SeasonalNaive",
           round(WindowAverage, 4) AS "WindowAverage",
           round(SeasonalWindowAverage, 4) AS "SeasonalWindowAverage"
    FROM backtest""")
_SQL["backtest_stored"] = _SQL["baseline_backtest"]
_add("backtest_rmse", ["backtest"], """
    SELECT unique_id, model, round(avg(rmse), 4) AS mean_rmse
    FROM (SELECT unique_id, fold, model, sqrt(avg((v - y) * (v - y))) AS rmse
          FROM (SELECT unique_id, fold, y, 'Naive' AS model, Naive AS v FROM backtest
                UNION ALL SELECT unique_id, fold, y, 'SeasonalNaive', SeasonalNaive FROM backtest
                UNION ALL SELECT unique_id, fold, y, 'WindowAverage', WindowAverage FROM backtest
                UNION ALL SELECT unique_id, fold, y, 'SeasonalWindowAverage', SeasonalWindowAverage FROM backtest)
          GROUP BY 1, 2, 3)
    GROUP BY 1, 2""")
_add("time_index_split", ["indexed"], f"""
    SELECT {_day('ds')}, unique_id, round(y, 4) AS y, time_idx::int AS time_idx, part FROM indexed""")
_add("auto_ar_forecast", ["ar_best", "ar_slopes", "ar_last"], """
    SELECT l.unique_id, (l.last_idx + h.h)::int AS time_idx, h.h::int AS h, b.model,
      round(CASE b.model
        WHEN 'mean' THEN f.my
        WHEN 'drift' THEN l.ly + h.h * f.md
        WHEN 'ar1' THEN (f.my - f.b * f.my1) / (1 - f.b)
             + pow(f.b, h.h) * (l.ly - (f.my - f.b * f.my1) / (1 - f.b))
        WHEN 'diff_ar1' THEN l.ly + h.h * (f.md - f.c * f.md1) / (1 - f.c)
             + (l.ld - (f.md - f.c * f.md1) / (1 - f.c)) * f.c * (1 - pow(f.c, h.h)) / (1 - f.c)
        END, 4) + 0.0 AS forecast
    FROM ar_last l
    CROSS JOIN (SELECT unnest(range(1, 1 + (SELECT count(DISTINCT time_idx) FROM indexed
                                           WHERE part = 'test'))) AS h) h
    LEFT JOIN ar_best b ON b.unique_id = l.unique_id
    LEFT JOIN ar_slopes f ON f.unique_id = l.unique_id""")
_add("seasonal_ar_forecast", ["sar_past", "sar_steps"], """
    SELECT l.unique_id, (l.last_idx + h.h)::int AS time_idx, h.h::int AS h,
           CASE s.d WHEN 1 THEN 'seasonal' WHEN 0 THEN 'plain' END AS form, s.p::int AS "order",
           round(s.past[len(s.past)], 4) + 0.0 AS forecast
    FROM sar_past l
    CROSS JOIN (SELECT unnest(range(1, 1 + (SELECT count(DISTINCT time_idx) FROM indexed
                                           WHERE part = 'test'))) AS h) h
    LEFT JOIN sar_steps s ON s.unique_id = l.unique_id AND s.h = h.h""")
