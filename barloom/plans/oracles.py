"""DuckDB SQL that gives the registered queries' rows, written from their definitions."""

from __future__ import annotations

CTES = {
    "lines": """SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || '.SZ' AS htsc_code, CAST(l_shipdate AS DATE) AS "time",
        l_extendedprice / l_quantity AS px, * FROM lineitem""",
    "bars": """SELECT htsc_code, "time", first(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS "open", max(px) AS high, min(px) AS low,
        last(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS "close", sum(l_quantity) AS volume FROM lines GROUP BY ALL""",
    "wide": """SELECT htsc_code, "time", CAST(nullif(count(*) FILTER (l_returnflag = 'A'), 0) AS DOUBLE) AS "A", CAST(nullif(count(*) FILTER (l_returnflag = 'N'), 0) AS DOUBLE) AS "N",
        CAST(nullif(count(*) FILTER (l_returnflag = 'R'), 0) AS DOUBLE) AS "R", CAST(nullif(count(*) FILTER (l_linestatus = 'F'), 0) AS DOUBLE) AS "F",
        CAST(nullif(count(*) FILTER (l_linestatus = 'O'), 0) AS DOUBLE) AS "O" FROM lines GROUP BY ALL""",
    "frame": """SELECT b.*, coalesce("A", 0) AS "A", coalesce("N", 0) AS "N", coalesce("R", 0) AS "R", coalesce("F", 0) AS "F", coalesce("O", 0) AS "O"
        FROM bars b LEFT JOIN wide w USING (htsc_code, "time")""",
    "segments": """SELECT DISTINCT htsc_code, make_date(year("time"), 1, 1) AS begin_date, make_date(year("time"), 12, 31) AS end_date,
        1 + (year("time") + l_suppkey) % 5 / 100.0::DOUBLE AS xdy FROM lines""",
    "products": """SELECT *, product(xdy) OVER (PARTITION BY htsc_code ORDER BY begin_date ROWS UNBOUNDED PRECEDING) AS cum,
        coalesce(product(xdy) OVER (PARTITION BY htsc_code ORDER BY begin_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS suffix FROM segments""",
    "factored": """SELECT b.*, CASE WHEN isodow("time") < 6 THEN coalesce(cum, 1) ELSE 1 END AS cum, CASE WHEN isodow("time") < 6 THEN coalesce(suffix, 1) ELSE 1 END AS suffix
        FROM bars b LEFT JOIN products p ON p.htsc_code = b.htsc_code AND b."time" BETWEEN begin_date AND end_date""",
    "ranked": """SELECT *, year("time") AS y, row_number() OVER (PARTITION BY htsc_code, year("time") ORDER BY "time") AS rn FROM bars""",
    "halved": """SELECT a.htsc_code, a.y FROM ranked a JOIN ranked b ON a.htsc_code = b.htsc_code AND b.y = a.y + 1 AND a.rn = 5 AND b.rn = 5 WHERE a."close" > 0 AND b."close" <= 0.5 * a."close" """,
    "mask": """SELECT htsc_code, "time", CAST((rn > 5 AND EXISTS (FROM halved h WHERE h.htsc_code = r.htsc_code AND h.y = r.y)) OR (rn <= 5 AND EXISTS (FROM halved h WHERE h.htsc_code = r.htsc_code AND h.y = r.y - 1)) AS DOUBLE) AS block_halving_future_buy FROM ranked r""",
    "days": """SELECT DISTINCT "time" FROM bars""",
    "closes": """SELECT g.htsc_code, g."time", last_value(b."close" IGNORE NULLS) OVER (PARTITION BY g.htsc_code ORDER BY g."time" ROWS UNBOUNDED PRECEDING) AS "close"
        FROM (SELECT htsc_code, d."time" FROM (SELECT htsc_code, min("time") AS a FROM bars GROUP BY 1) s JOIN days d ON d."time" >= a) g LEFT JOIN bars b USING (htsc_code, "time")""",
    "vals": """SELECT htsc_code AS code, "time" AS "date", 1e7 + CAST(sum(cents) OVER (PARTITION BY htsc_code ORDER BY "time") AS BIGINT) / 100.0::DOUBLE AS "value" FROM (
        SELECT htsc_code, "time", sum(CAST(round((CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END) * 100) AS BIGINT)) AS cents FROM lines GROUP BY ALL)""",
    "rets": """SELECT code, "date", "value" / p - 1 AS ret FROM (SELECT *, lag("value") OVER (PARTITION BY code ORDER BY "date") AS p FROM vals) WHERE abs(p) > 1e-12""",
    "olog": """SELECT htsc_code AS code, "time" AS "date", CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, CASE WHEN o_orderstatus = 'P' THEN 'Margin' ELSE 'Completed' END AS status,
        l_extendedprice AS executed_value, l_extendedprice * 0.0003::DOUBLE AS commission FROM lines JOIN orders ON l_orderkey = o_orderkey""",
    "ordinals": """SELECT htsc_code, "time", row_number() OVER (PARTITION BY htsc_code ORDER BY "time") AS bar FROM (SELECT DISTINCT htsc_code, "time" FROM lines)""",
    "tlog": """SELECT t.*, CAST(c.bar - coalesce(o.bar, 0) AS INTEGER) AS barlen FROM (
        SELECT htsc_code AS code, CAST(o_orderdate AS DATE) AS date_open, "time" AS date_close, (0.05::DOUBLE - l_discount) * l_extendedprice AS pnlcomm FROM lines JOIN orders ON l_orderkey = o_orderkey) t
        JOIN ordinals c ON c.htsc_code = code AND c."time" = date_close ASOF LEFT JOIN ordinals o ON o.htsc_code = code AND date_open >= o."time" """,
    "acts": """SELECT htsc_code, "time", row_number() OVER (PARTITION BY htsc_code ORDER BY "time") AS bar, "close", CASE WHEN "A" >= 3 THEN 0 WHEN "R" >= 2 THEN 1 END AS act FROM frame""",
    "changes": """SELECT * FROM (SELECT *, coalesce(lag(act) OVER (PARTITION BY htsc_code ORDER BY "time"), 0) AS was FROM acts WHERE act IS NOT NULL) WHERE act <> was""",
    "sized": """SELECT *, coalesce(sz, lag(sz) OVER (PARTITION BY htsc_code ORDER BY "time")) AS size FROM (SELECT *, CASE WHEN act = 1 THEN CAST(floor(1e6 / ("close" * 1.0003::DOUBLE)) AS BIGINT) END AS sz FROM changes)""",
    "slog": """SELECT "time" AS "date", htsc_code AS code, CASE WHEN act = 1 THEN 'BUY' ELSE 'SELL' END AS side, size AS executed_size, "close" AS executed_price, size * "close" AS executed_value,
        size * "close" * 0.0003::DOUBLE AS commission, CASE WHEN act = 1 THEN size ELSE 0 END AS position_after, bar FROM sized WHERE size > 0""",
    "strades": """SELECT code, "date" AS date_open, nd AS date_close, CAST(nb - bar AS INTEGER) AS barlen, nv - executed_value AS pnl, nv - executed_value - commission - nc AS pnlcomm FROM (
        SELECT *, lead("date") OVER w AS nd, lead(bar) OVER w AS nb, lead(executed_value) OVER w AS nv, lead(commission) OVER w AS nc FROM slog WINDOW w AS (PARTITION BY code ORDER BY "date")) WHERE side = 'BUY' AND nd IS NOT NULL""",
    "held": """SELECT c.htsc_code AS code, c."time" AS "date", c."close", coalesce(last_value(position_after IGNORE NULLS) OVER w, 0) AS size,
        coalesce(last_value(CASE WHEN side = 'BUY' THEN executed_price END IGNORE NULLS) OVER w, 0) AS paid
        FROM closes c LEFT JOIN slog s ON s.code = c.htsc_code AND s."date" = c."time" WINDOW w AS (PARTITION BY c.htsc_code ORDER BY c."time" ROWS UNBOUNDED PRECEDING)""",
    "flows": """SELECT "date", sum(CASE WHEN side = 'BUY' THEN -executed_value - commission ELSE executed_value - commission END) AS flow FROM slog GROUP BY 1""",
    "daily": """SELECT "date", 1e7 + sum(coalesce(flow, 0)) OVER (ORDER BY "date") AS cash_value, positions_value FROM (SELECT "date", sum(size * "close") AS positions_value FROM held GROUP BY 1) LEFT JOIN flows USING ("date")""",
    "bought": """SELECT c.*, floor(1e7 / 1.0003::DOUBLE / n / first_value("close") OVER w) AS shares, first_value("close") OVER w AS c0
        FROM closes c, (SELECT max(a) AS start, count(*) AS n FROM (SELECT htsc_code, min("time") AS a FROM bars GROUP BY 1)) WHERE "time" >= start WINDOW w AS (PARTITION BY htsc_code ORDER BY "time")""",
    "bench": """SELECT "time" AS "date", 1e7 - sum(shares * c0 * 1.0003::DOUBLE) + sum(shares * "close") AS "value" FROM bought GROUP BY 1""",
    "trial_masks": "SELECT CAST(t AS INTEGER) AS trial, t // 3 + 1 AS bm, t % 3 + 1 AS sm FROM range(21) r(t)",
    "dv": """SELECT "date", cash_value, cash_value + positions_value AS pv FROM daily""",
    "pr": """SELECT "date", r, b FROM (SELECT "date", pv / lag(pv) OVER (ORDER BY "date") - 1 AS r FROM dv) LEFT JOIN
        (SELECT "date", "value" / lag("value") OVER (ORDER BY "date") - 1 AS b FROM bench) USING ("date") WHERE r IS NOT NULL""",
    "rbars": """SELECT * FROM bars WHERE "time" >= DATE '1992-12-27' AND "time" < DATE '1999-03-01'""",
    "rprod": """SELECT htsc_code, begin_date, end_date, product(xdy) OVER (PARTITION BY htsc_code ORDER BY begin_date ROWS UNBOUNDED PRECEDING) AS cum FROM segments
        WHERE end_date >= DATE '1992-12-27' AND begin_date <= DATE '1999-02-28'""",
    "radj": """SELECT b.htsc_code, b."time", "open" * f AS "open", high * f AS high, low * f AS low, "close" * f AS "close", volume FROM (SELECT b.*, CASE WHEN isodow("time") < 6 THEN coalesce(cum, 1) ELSE 1 END AS f
        FROM rbars b LEFT JOIN rprod p ON p.htsc_code = b.htsc_code AND b."time" BETWEEN begin_date AND end_date) b""",
    "rranked": """SELECT *, year("time") AS y, row_number() OVER (PARTITION BY htsc_code, year("time") ORDER BY "time") AS rn FROM radj""",
    "rhalved": """SELECT a.htsc_code, a.y FROM rranked a JOIN rranked b ON a.htsc_code = b.htsc_code AND b.y = a.y + 1 AND a.rn = 5 AND b.rn = 5 WHERE a."close" > 0 AND b."close" <= 0.5 * a."close" """,
    "yrs": """SELECT CAST(y AS VARCHAR) AS run, make_date(y, 1, 1) AS s, make_date(y + 1, 1, 1) AS e, make_date(y, 1, 1) - 60 AS ra, make_date(y + 2, 2, 1) AS rb FROM range(1996, 2001) t(y)""",
    "ybars": """SELECT run, s, e, b.* FROM bars b JOIN yrs ON "time" >= ra AND "time" < rb""",
    "yprod": """SELECT run, htsc_code, begin_date, end_date, product(xdy) OVER (PARTITION BY run, htsc_code ORDER BY begin_date ROWS UNBOUNDED PRECEDING) AS cum FROM segments JOIN yrs ON end_date >= ra AND begin_date < rb""",
    "yadj": """SELECT b.run, s, e, b.htsc_code, b."time", year(b."time") AS y, row_number() OVER (PARTITION BY b.run, b.htsc_code, year(b."time") ORDER BY b."time") AS rn, "close" * CASE WHEN isodow(b."time") < 6 THEN coalesce(cum, 1) ELSE 1 END AS "close"
        FROM ybars b LEFT JOIN yprod p ON p.run = b.run AND p.htsc_code = b.htsc_code AND b."time" BETWEEN begin_date AND end_date""",
    "yhalved": """SELECT a.run, a.htsc_code, a.y FROM yadj a JOIN yadj b ON a.run = b.run AND a.htsc_code = b.htsc_code AND b.y = a.y + 1 AND a.rn = 5 AND b.rn = 5 WHERE a."close" > 0 AND b."close" <= 0.5 * a."close" """,
    "yframe": """SELECT r.run, r.htsc_code, r."time", r."close", "A", "R", (rn > 5 AND EXISTS (FROM yhalved h WHERE h.run = r.run AND h.htsc_code = r.htsc_code AND h.y = r.y)) OR (rn <= 5 AND EXISTS (FROM yhalved h WHERE h.run = r.run AND h.htsc_code = r.htsc_code AND h.y = r.y - 1)) AS blocked
        FROM yadj r JOIN frame f ON f.htsc_code = r.htsc_code AND f."time" = r."time" WHERE r."time" >= s AND r."time" < e""",
    "yacts": """SELECT *, row_number() OVER (PARTITION BY run, htsc_code ORDER BY "time") AS bar, CASE WHEN "A" >= 3 THEN 0 WHEN "R" >= 2 AND NOT blocked THEN 1 END AS act FROM yframe""",
    "ychanges": """SELECT * FROM (SELECT *, coalesce(lag(act) OVER (PARTITION BY run, htsc_code ORDER BY "time"), 0) AS was FROM yacts WHERE act IS NOT NULL) WHERE act <> was""",
    "ysized": """SELECT *, coalesce(sz, lag(sz) OVER (PARTITION BY run, htsc_code ORDER BY "time")) AS size FROM (SELECT *, CASE WHEN act = 1 THEN CAST(floor(1e5 / ("close" * 1.0003::DOUBLE)) AS BIGINT) END AS sz FROM ychanges)""",
    "ylog": """SELECT run, "time" AS "date", htsc_code AS code, act, bar, "close" AS executed_price, size * "close" AS executed_value, size * "close" * 0.0003::DOUBLE AS commission, CASE WHEN act = 1 THEN size ELSE 0 END AS position_after FROM ysized WHERE size > 0""",
    "ytrades": """SELECT run, nb - bar AS barlen, nv - executed_value - commission - nc AS pnlcomm FROM (SELECT *, lead(bar) OVER w AS nb, lead(executed_value) OVER w AS nv, lead(commission) OVER w AS nc FROM ylog WINDOW w AS (PARTITION BY run, code ORDER BY "date")) WHERE act = 1 AND nb IS NOT NULL""",
    "ycloses": """SELECT g.run, g.htsc_code, g."time", last_value(b."close" IGNORE NULLS) OVER (PARTITION BY g.run, g.htsc_code ORDER BY g."time" ROWS UNBOUNDED PRECEDING) AS "close"
        FROM (SELECT run, htsc_code, d."time" FROM (SELECT run, htsc_code, min("time") AS a FROM yframe GROUP BY ALL) s JOIN (SELECT DISTINCT run, "time" FROM yframe) d USING (run) WHERE d."time" >= a) g LEFT JOIN yframe b USING (run, htsc_code, "time")""",
    "yheld": """SELECT c.run, c."time" AS "date", c."close", coalesce(last_value(position_after IGNORE NULLS) OVER w, 0) AS size FROM ycloses c LEFT JOIN ylog l ON l.run = c.run AND l.code = c.htsc_code AND l."date" = c."time"
        WINDOW w AS (PARTITION BY c.run, c.htsc_code ORDER BY c."time" ROWS UNBOUNDED PRECEDING)""",
    "ybench": """SELECT run, "time" AS "date", 1e7 - sum(shares * c0 * 1.0003::DOUBLE) + sum(shares * "close") AS b FROM (SELECT c.*, floor(1e7 / 1.0003::DOUBLE / n / first_value("close") OVER w) AS shares, first_value("close") OVER w AS c0
        FROM ycloses c JOIN (SELECT run, max(a) AS start, count(*) AS n FROM (SELECT run, htsc_code, min("time") AS a FROM yframe GROUP BY ALL) GROUP BY 1) USING (run) WHERE "time" >= start WINDOW w AS (PARTITION BY run, htsc_code ORDER BY "time")) GROUP BY ALL""",
    "yday": """SELECT run, "date", 1e7 + sum(coalesce(flow, 0)) OVER (PARTITION BY run ORDER BY "date") AS cash_value, p FROM (SELECT run, "date", sum(size * "close") AS p FROM yheld GROUP BY ALL)
        LEFT JOIN (SELECT run, "date", sum(CASE WHEN act = 1 THEN -executed_value - commission ELSE executed_value - commission END) AS flow FROM ylog GROUP BY ALL) USING (run, "date")""",
    "ydv": """SELECT run, "date", cash_value, cash_value + p AS pv, max(cash_value + p) OVER (PARTITION BY run ORDER BY "date") AS peak, (cash_value + p) / lag(cash_value + p) OVER (PARTITION BY run ORDER BY "date") - 1 AS r FROM yday""",
    "ypr": """SELECT run, r, x FROM ydv LEFT JOIN (SELECT run, "date", b / lag(b) OVER (PARTITION BY run ORDER BY "date") - 1 AS x FROM ybench) USING (run, "date") WHERE r IS NOT NULL""",
    "ordinal": """SELECT *, row_number() OVER (PARTITION BY htsc_code ORDER BY "time") AS bar FROM frame""",
    "fold": """SELECT htsc_code, 0 AS bar, 0::BIGINT AS size, 0.0::DOUBLE AS paid, NULL::DATE AS first, 0.0::DOUBLE AS first_paid, FALSE AS blocked, 0::BIGINT AS signed, '' AS signal, NULL::DATE AS "time", 0.0::DOUBLE AS "close" FROM (SELECT DISTINCT htsc_code FROM ordinal)
        UNION ALL
        SELECT htsc_code, bar, size + signed, CASE WHEN signal = 'BUY' THEN "close" ELSE paid END, coalesce(first, CASE WHEN signal = 'BUY' THEN "time" END), CASE WHEN first IS NULL AND signal = 'BUY' THEN "close" ELSE first_paid END, stop, signed, signal, "time", "close" FROM (
            SELECT *, CASE WHEN size > 0 AND sells AND gain > 0.5::DOUBLE THEN -size WHEN size > 0 AND sells AND gain > 0.3::DOUBLE THEN -(size // 2) WHEN size = 0 AND buys AND NOT stop AND wanted > 0 THEN wanted ELSE 0 END AS signed,
                CASE WHEN size > 0 AND sells AND gain > 0.5::DOUBLE THEN 'FULL_SELL_PROFIT_GT_50' WHEN size > 0 AND sells AND gain > 0.3::DOUBLE THEN 'HALF_SELL_PROFIT_GT_30' WHEN size = 0 AND buys AND NOT stop AND wanted > 0 THEN 'BUY' ELSE '' END AS signal FROM (
                SELECT f.htsc_code, o.bar, size, paid, first, first_paid, blocked OR coalesce(size > 0 AND o."time" >= first + 365 AND o."close" <= first_paid * 0.5, FALSE) AS stop, o."time", o."close", o."close" / nullif(paid, 0) - 1 AS gain, "A" >= 1 AS sells, "R" >= 2 AS buys,
                    CAST(floor(1e6 / (o."close" * 1.0003::DOUBLE)) AS BIGINT) AS wanted FROM fold f JOIN ordinal o ON o.htsc_code = f.htsc_code AND o.bar = f.bar + 1))""",
    "bits": """SELECT htsc_code, "time", "close", ("R" >= 2)::INTEGER + 2 * ("F" >= 3)::INTEGER + 4 * ("N" >= 2)::INTEGER AS b, ("A" >= 3)::INTEGER + 2 * ("O" >= 4)::INTEGER AS s FROM frame""",
    "tacts": """SELECT trial, htsc_code, "time", "close", CASE WHEN (s & sm) <> 0 THEN 0 WHEN (b & bm) = bm THEN 1 END AS act FROM bits, trial_masks WHERE b > 0 OR s > 0""",
    "tsized": """SELECT *, coalesce(sz, lag(sz) OVER w) AS size FROM (SELECT *, CASE WHEN act = 1 THEN CAST(floor(1e6 / ("close" * 1.0003::DOUBLE)) AS BIGINT) END AS sz FROM (
        SELECT *, coalesce(lag(act) OVER (PARTITION BY trial, htsc_code ORDER BY "time"), 0) AS was FROM tacts WHERE act IS NOT NULL) WHERE act <> was) WINDOW w AS (PARTITION BY trial, htsc_code ORDER BY "time")""",
    "tprofit": """SELECT trial, count(*) AS n_trades, sum(nx - x - (nx + x) * 0.0003::DOUBLE) AS profit FROM (
        SELECT trial, act, size * "close" AS x, lead(size * "close") OVER (PARTITION BY trial, htsc_code ORDER BY "time") AS nx FROM tsized WHERE size > 0) WHERE act = 1 AND nx IS NOT NULL GROUP BY 1""",
    "trials": """SELECT trial, CAST(bm AS INTEGER) AS buy_mask, CAST(sm AS INTEGER) AS sell_mask, coalesce(n_trades, 0) AS n_trades, round(coalesce(profit, 0), 2) AS profit FROM trial_masks LEFT JOIN tprofit USING (trial)""",
}


def _sql(ctes: str, body: str) -> str:
    """body with the named tables before it."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in ctes.split()) + "\n" + body


B = "lines bars"
W = f"{B} wide frame"
SEG = f"{B} segments products factored"
LOG = f"{W} acts changes sized slog"
HELD = f"{LOG} days closes held"
PRICE = 'htsc_code, "time", round("open", 8) AS "open", round(high, 8) AS high, round(low, 8) AS low, round("close", 8) AS "close", volume'
MARKET = 'size * "close"'

ORACLES = {
    "price_scan": _sql(B, f"""SELECT {PRICE} FROM bars WHERE "time" >= DATE '1996-01-01' AND "time" < DATE '2000-01-01'"""),
    "factor_wide": _sql("lines wide", "SELECT * FROM wide"),
    "signal_frame": _sql(f"{W} ranked halved mask", """SELECT htsc_code, "time", round("close", 8) AS "close", "A", "N", "R", "F", "O", block_halving_future_buy,
        CAST("R" >= 2 AND "F" >= 3 AND "N" >= 2 AS DOUBLE) AS strong_buy_signal, CAST("A" >= 3 OR "O" >= 4 AS DOUBLE) AS strong_sell_signal FROM frame JOIN mask USING (htsc_code, "time")"""),
    "segment_products": _sql("lines segments", """SELECT htsc_code, begin_date, end_date, round(xdy, 8) AS xdy, round(product(xdy) OVER (PARTITION BY htsc_code ORDER BY begin_date ROWS UNBOUNDED PRECEDING), 8) AS cum,
        round(coalesce(product(xdy) OVER (PARTITION BY htsc_code ORDER BY begin_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1), 8) AS suffix FROM (
            FROM segments UNION ALL SELECT 'X' || htsc_code, begin_date, end_date, xdy FROM segments WHERE year(begin_date) = 1998 UNION ALL SELECT replace(htsc_code, '.SZ', '.YKRS'), begin_date, end_date, xdy FROM segments
            UNION ALL SELECT htsc_code, NULL, end_date, xdy FROM segments WHERE year(begin_date) = 1997)
        WHERE end_date >= DATE '1996-01-01' AND begin_date <= DATE '2000-12-31' AND htsc_code NOT LIKE '%.YKRS' AND htsc_code IN (SELECT htsc_code FROM lines WHERE "time" BETWEEN DATE '1996-01-01' AND DATE '2000-12-31')"""),
    "adjusted_backward": _sql(SEG, 'SELECT htsc_code, "time", round("open" * cum, 8) AS "open", round(high * cum, 8) AS high, round(low * cum, 8) AS low, round("close" * cum, 8) AS "close", volume FROM factored'),
    "adjusted_forward": _sql(SEG, 'SELECT htsc_code, "time", round("open" / suffix, 8) AS "open", round(high / suffix, 8) AS high, round(low / suffix, 8) AS low, round("close" / suffix, 8) AS "close", volume FROM factored'),
    "halving_mask": _sql(f"{B} ranked halved mask", "SELECT * FROM mask"),
    "initial_backscan": _sql(W, """SELECT htsc_code, lb AS last_buy, round(least(0.05::DOUBLE, 1.0::DOUBLE / count(*) OVER ()), 8) AS weight FROM (SELECT htsc_code, max("time") FILTER ("R" >= 1) AS lb, max("time") FILTER ("O" >= 1) AS ls
        FROM frame WHERE "time" < DATE '2000-01-01' GROUP BY 1 HAVING lb IS NOT NULL AND (ls IS NULL OR lb > ls) ORDER BY lb DESC, htsc_code LIMIT 50)"""),
    "move_gate": _sql(B, """SELECT htsc_code, "time", coalesce(abs("close" / lag("close") OVER (PARTITION BY htsc_code ORDER BY "time") - 1) <= 0.098::DOUBLE, TRUE) AS tradable FROM bars"""),
    "last_known_close": _sql(f"{B} days closes", 'SELECT htsc_code, "time", round("close", 8) AS "close" FROM closes'),
    "daily_returns": _sql("lines vals rets", 'SELECT code, "date", round(ret, 9) AS ret FROM rets'),
    "risk_metrics": _sql("lines vals rets", """SELECT code, round(sharpe, 5) AS sharpe, round(sortino, 5) AS sortino, round(ir, 5) AS information_ratio, round(mdd, 5) AS max_drawdown_pct, round(money, 5) AS max_drawdown_money,
        round(ann, 5) AS annual_pct, round(calmar, 5) AS calmar, round(total, 5) AS total_return, round(sign(x) * ln(1 + abs(x)), 5) AS excess_score, round(0.45::DOUBLE * calmar + 0.4::DOUBLE * sortino + 0.15::DOUBLE * sharpe, 5) AS score
        FROM (SELECT *, CASE WHEN abs(mdd / 100) > 1e-12 THEN ann / mdd END AS calmar, CASE WHEN down > 0 THEN (total - bt) / down END AS x FROM (
            SELECT *, 100 * (exp(ln(l / f) / n * 252) - 1) AS ann, l / f - 1 AS total FROM
            (SELECT code, CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(252) END AS sharpe,
                CASE WHEN sqrt(avg(least(ret, 0) ** 2)) > 1e-12 THEN avg(ret) / sqrt(avg(least(ret, 0) ** 2)) * sqrt(252) END AS sortino,
                CASE WHEN stddev_samp(ret - b) > 1e-12 THEN avg(ret - b) / stddev_samp(ret - b) * sqrt(252) END AS ir, avg(least(ret - b, 0) ** 2) AS down, product(1 + b) - 1 AS bt, count(*) AS n
             FROM rets JOIN (SELECT "date", avg(ret) AS b FROM rets GROUP BY 1) USING ("date") GROUP BY 1)
            JOIN (SELECT code, arg_min("value", "date") AS f, arg_max("value", "date") AS l FROM vals GROUP BY 1) USING (code)
            JOIN (SELECT code, max(p) AS mdd, arg_max(m, (p, m)) AS money FROM (SELECT code, (peak - "value") / peak * 100 AS p, peak - "value" AS m FROM (SELECT *, max("value") OVER (PARTITION BY code ORDER BY "date") AS peak FROM vals)) GROUP BY 1) USING (code)))"""),
    "trade_metrics": _sql("lines ordinals tlog", """SELECT code, round(avg((pnlcomm > 0)::INTEGER), 4) AS win_rate, round(sum(p) FILTER (p > 0) / abs(sum(p) FILTER (p < 0)), 4) AS profit_loss_ratio, round(avg(barlen), 4) AS mean_bars,
        round(median(barlen), 4) AS median_bars, count(*) AS n_trades, round(sum(pnlcomm), 4) AS realised_pnl FROM (SELECT *, round(pnlcomm, 4) AS p FROM tlog) GROUP BY 1"""),
    "buy_costs": _sql("lines olog", "SELECT code, round(sum(abs(executed_value) + commission), 2) AS buy_cost FROM olog WHERE side = 'buy' AND status = 'Completed' GROUP BY 1"),
    "closed_trades": _sql("lines olog ordinals tlog", """SELECT code, round(pnl, 4) AS pnl, trades, first_open, last_close, CAST(bars AS BIGINT) AS bars, round(buy_cost, 4) AS buy_cost, round(pnl / buy_cost, 4) AS return_pct, round(pnl / 1e6, 4) AS contribution FROM (
        SELECT code, sum(pnlcomm) AS pnl, count(*) AS trades, min(date_open) AS first_open, max(date_close) AS last_close, sum(barlen) AS bars FROM tlog
        WHERE code NOT IN (SELECT code FROM (SELECT code, sum(CASE WHEN side = 'buy' THEN 1 ELSE -1 END) AS n FROM olog GROUP BY 1) QUALIFY n > avg(n) OVER ()) GROUP BY 1)
        LEFT JOIN (SELECT code, sum(executed_value + commission) AS buy_cost FROM olog WHERE side = 'buy' AND status = 'Completed' GROUP BY 1) USING (code)"""),
    "turnover": _sql("lines olog vals", """SELECT code, round(moved / m / (greatest(d, 1) / 365.25::DOUBLE), 6) AS turnover, round(c, 6) AS cash_ratio FROM
        (SELECT code, sum(abs(executed_value)) AS moved, datediff('day', min("date"), max("date")) AS d FROM olog GROUP BY 1) JOIN (SELECT code, avg("value") AS m, avg(1e6 / "value") AS c FROM vals GROUP BY 1) USING (code)"""),
    "signal_orders": _sql(LOG, 'SELECT "date", code, side, executed_size, round(executed_price, 8) AS executed_price, round(executed_value, 8) AS executed_value, round(commission, 8) AS commission, position_after FROM slog'),
    "signal_trades": _sql(f"{LOG} strades", "SELECT code, date_open, date_close, barlen, round(pnl, 8) AS pnl, round(pnlcomm, 8) AS pnlcomm FROM strades"),
    "daily_log": _sql(f"{HELD} flows daily", 'SELECT "date", round(cash_value, 2) AS cash_value, round(positions_value, 2) AS positions_value, round(cash_value + positions_value, 2) AS portfolio_value FROM daily'),
    "position_log": _sql(f"{HELD} flows daily", f"""SELECT "date", code, CAST(size AS DOUBLE) AS position_size, round(paid, 8) AS position_price, round("close", 8) AS "close", round({MARKET}, 8) AS market_value, round(size * ("close" - paid), 8) AS unrealized_pnl,
        round(cash_value, 2) AS cash_value, round(pv, 2) AS portfolio_value, round(size * paid, 8) AS cost_basis, round(size * ("close" - pc), 8) AS daily_pnl,
        round(size * ("close" - paid) / (size * paid), 8) AS unrealized_return_pct, round({MARKET} / pv, 8) AS weight_pct, round(CASE WHEN abs(pm) > 1e-12 THEN size * ("close" - pc) / pm END, 8) AS daily_pnl_pct,
        round(size * ("close" - pc) / pv, 8) AS contribution_pct, 'run' AS run_tag FROM (SELECT h.*, cash_value, cash_value + positions_value AS pv, lag("close") OVER w AS pc, lag({MARKET}) OVER w AS pm
        FROM held h JOIN daily USING ("date") WINDOW w AS (PARTITION BY code ORDER BY "date")) WHERE size <> 0"""),
    "open_positions": _sql(f"{HELD} flows daily strades", f"""SELECT code, "date", CAST(size AS DOUBLE) AS position_size, round("close", 2) AS "close", round(m, 2) AS market_value, round(gain, 2) AS unrealized_pnl, round(r, 2) AS realised_pnl, round(r + gain, 2) AS total_pnl,
        round(m / pv, 8) AS weight, round(gain / (size * paid), 8) AS "return", round((r + gain) / (pv - 1e7), 8) AS contribution FROM (
        SELECT code, "date", size, paid, "close", {MARKET} AS m, size * ("close" - paid) AS gain, coalesce(r, 0) AS r, cash_value + positions_value AS pv FROM held JOIN daily USING ("date")
        LEFT JOIN (SELECT code, sum(pnlcomm) AS r FROM strades GROUP BY 1) USING (code) WHERE size <> 0 AND "date" = (SELECT max("date") FROM daily))"""),
    "order_account": _sql(f"{HELD} flows daily", """SELECT "date", code, side, round(executed_value, 2) AS executed_value, round(cash_value, 2) AS cash_after, round(cash_value + positions_value, 2) AS portfolio_value_after
        FROM slog LEFT JOIN daily USING ("date")"""),
    "run_summary": _sql(f"{HELD} flows daily bought bench strades dv pr", """SELECT round(f, 2) AS final_value, round(cr, 6) AS average_cash_ratio, round(bv, 2) AS benchmark_value, round(mdd, 6) AS max_drawdown_pct, round(money, 2) AS max_drawdown_money,
        round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(ir, 6) AS information_ratio, round(com, 2) AS total_commission, round(win, 6) AS win_rate, round(plr, 6) AS profit_loss_ratio, n_trades, round(mean_bars, 6) AS mean_bars,
        round(median_bars, 6) AS median_bars, round(f + com, 2) AS gross_final_value, round(f / 1e7 - 1, 6) AS net_return, round((f + com) / 1e7 - 1, 6) AS gross_return, round(bv / 1e7 - 1, 6) AS benchmark_return, round(ann, 6) AS annual_pct,
        round(ann / mdd, 6) AS calmar, round(moved / mv / (greatest(days, 1) / 365.25::DOUBLE), 6) AS turnover, round(sign((f - bv) / down) * ln(1 + abs((f - bv) / 1e7 / down)), 6) AS excess_score,
        round(0.45::DOUBLE * ann / mdd + 0.4::DOUBLE * sortino + 0.15::DOUBLE * sharpe, 6) AS score FROM (SELECT *, 100 * (exp(ln(f / f0) / n * 252) - 1) AS ann FROM
            (SELECT arg_max(pv, "date") AS f, arg_min(pv, "date") AS f0, avg(cash_value / pv) AS cr, avg(pv) AS mv, datediff('day', min("date"), max("date")) AS days FROM dv),
            (SELECT arg_max("value", "date") AS bv FROM bench),
            (SELECT max(p) AS mdd, arg_max(m, (p, m)) AS money FROM (SELECT (peak - pv) / peak * 100 AS p, peak - pv AS m FROM (SELECT *, max(pv) OVER (ORDER BY "date") AS peak FROM dv))),
            (SELECT avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, avg(r) / sqrt(avg(least(r, 0) ** 2)) * sqrt(252) AS sortino, avg(r - b) / stddev_samp(r - b) * sqrt(252) AS ir,
                avg(CASE WHEN b IS NOT NULL THEN least(r - b, 0) ** 2 END) AS down, count(*) AS n FROM pr),
            (SELECT sum(commission) AS com, sum(executed_value) AS moved FROM slog),
            (SELECT avg((pnlcomm > 0)::INTEGER) AS win, CASE WHEN min(pnlcomm) < 0 THEN coalesce(sum(pnlcomm) FILTER (pnlcomm > 0), 0) / abs(sum(pnlcomm) FILTER (pnlcomm < 0)) WHEN max(pnlcomm) > 0 THEN 'inf'::DOUBLE END AS plr, count(*) AS n_trades, avg(barlen) AS mean_bars, median(barlen) AS median_bars FROM strades))"""),
    "yearly_runs": _sql(f"{W} segments yrs ybars yprod yadj yhalved yframe yacts ychanges ysized ylog ytrades ycloses yheld ybench yday ydv ypr", """SELECT run, round(f, 2) AS final_value, round(cr, 6) AS average_cash_ratio, round(bv, 2) AS benchmark_value, round(mdd, 6) AS max_drawdown_pct, round(money, 2) AS max_drawdown_money,
        round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(ir, 6) AS information_ratio, round(com, 2) AS total_commission, round(win, 6) AS win_rate, round(plr, 6) AS profit_loss_ratio, coalesce(n_trades, 0) AS n_trades, round(mean_bars, 6) AS mean_bars,
        round(median_bars, 6) AS median_bars, round(f + com, 2) AS gross_final_value, round(f / 1e7 - 1, 6) AS net_return, round((f + com) / 1e7 - 1, 6) AS gross_return, round(bv / 1e7 - 1, 6) AS benchmark_return, round(ann, 6) AS annual_pct,
        round(CASE WHEN mdd > 1e-10 THEN ann / mdd END, 6) AS calmar, round(moved / mv / (greatest(days, 1) / 365.25::DOUBLE), 6) AS turnover, round(sign((f - bv) / down) * ln(1 + abs((f - bv) / 1e7 / down)), 6) AS excess_score,
        round(0.45::DOUBLE * CASE WHEN mdd > 1e-10 THEN ann / mdd END + 0.4::DOUBLE * sortino + 0.15::DOUBLE * sharpe, 6) AS score FROM (SELECT *, 100 * (exp(ln(f / f0) / n * 252) - 1) AS ann FROM
            (SELECT run, arg_max(pv, "date") AS f, arg_min(pv, "date") AS f0, avg(cash_value / pv) AS cr, avg(pv) AS mv, datediff('day', min("date"), max("date")) AS days, max((peak - pv) / peak * 100) AS mdd, arg_max(peak - pv, ((peak - pv) / peak * 100, peak - pv)) AS money FROM ydv GROUP BY 1)
            LEFT JOIN (SELECT run, arg_max(b, "date") AS bv FROM ybench GROUP BY 1) USING (run)
            LEFT JOIN (SELECT run, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, avg(r) / sqrt(avg(least(r, 0) ** 2)) * sqrt(252) AS sortino, avg(r - x) / stddev_samp(r - x) * sqrt(252) AS ir, avg(CASE WHEN x IS NOT NULL THEN least(r - x, 0) ** 2 END) AS down, count(*) AS n FROM ypr GROUP BY 1) USING (run)
            LEFT JOIN (SELECT run, sum(commission) AS com, sum(executed_value) AS moved FROM ylog GROUP BY 1) USING (run)
            LEFT JOIN (SELECT run, avg((pnlcomm > 0)::INTEGER) AS win, CASE WHEN min(pnlcomm) < 0 THEN coalesce(sum(pnlcomm) FILTER (pnlcomm > 0), 0) / abs(sum(pnlcomm) FILTER (pnlcomm < 0)) WHEN max(pnlcomm) > 0 THEN 'inf'::DOUBLE END AS plr, count(*) AS n_trades, avg(barlen) AS mean_bars, median(barlen) AS median_bars FROM ytrades GROUP BY 1) USING (run))"""),
    "path_exits": _sql(f"{W} ordinal fold", """SELECT "time" AS "date", htsc_code AS code, signal, CASE WHEN signed > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(signed) AS executed_size, round("close", 8) AS executed_price, size AS position_after, CAST(bar AS INTEGER) AS bar FROM fold WHERE signed <> 0"""),
    "bar_gaps": _sql(f"{B} days", """SELECT htsc_code, "time", CAST(row_number() OVER w AS INTEGER) AS bar, CAST(k - lag(k) OVER w - 1 AS INTEGER) AS missed FROM bars JOIN (SELECT "time", row_number() OVER (ORDER BY "time") AS k FROM days) USING ("time") WINDOW w AS (PARTITION BY htsc_code ORDER BY "time")"""),
    "bar_look_back": _sql(B, f"""SELECT {PRICE} FROM (SELECT *, row_number() OVER (PARTITION BY htsc_code ORDER BY "time" DESC) AS back, count(*) FILTER ("time" >= DATE '1997-01-01') OVER (PARTITION BY htsc_code) AS since FROM bars) WHERE back <= since + 20"""),
    "range_frame": _sql(f"{W} segments rbars rprod radj rranked rhalved", """SELECT r.htsc_code, r."time", round(r."open", 6) AS "open", round(r.high, 6) AS high, round(r.low, 6) AS low, round(r."close", 6) AS "close", r.volume,
        CAST((rn > 5 AND EXISTS (FROM rhalved h WHERE h.htsc_code = r.htsc_code AND h.y = r.y)) OR (rn <= 5 AND EXISTS (FROM rhalved h WHERE h.htsc_code = r.htsc_code AND h.y = r.y - 1)) AS DOUBLE) AS block_halving_future_buy,
        "A", "N", "R", "F", "O" FROM rranked r JOIN frame f ON f.htsc_code = r.htsc_code AND f."time" = r."time" WHERE r."time" < DATE '1998-01-01'"""),
    "legacy_frame": _sql(W, """SELECT htsc_code, "time", round("open", 8) AS "open", round(high, 8) AS high, round(low, 8) AS low, round("close", 8) AS "close", volume,
        "A" AS mac_total, "N" AS kdj_signal, "R" AS obv_bullish, "F" AS bottom_score FROM frame"""),
    "seven_factor_frame": _sql(W, """SELECT htsc_code, "time", round("open", 8) AS "open", round(high, 8) AS high, round(low, 8) AS low, round("close", 8) AS "close", volume,
        "A" AS total_buy_signal, "N" AS total_buy_signal_adjusted, "R" AS sell_combo_signal, "F" AS rsi_sell_combo, "O" AS bottom_fishing_score, 0.0::DOUBLE AS mac_total, 0.0::DOUBLE AS total_sell_signal FROM frame"""),
    "strong_signals": _sql(W, """SELECT htsc_code, "time", CAST("R" >= 2 OR "F" >= 3 AS DOUBLE) AS total_buy_signal, CAST("R" >= 2 OR "F" >= 3 AS DOUBLE) AS strong_buy_signal, "O" AS total_sell_signal, CAST("A" >= 3 AS DOUBLE) AS strong_sell_signal FROM frame"""),
    "buy_and_hold": _sql(f"{B} days closes bought bench", 'SELECT "date", round("value", 2) AS "value" FROM bench'),
    "equity_curves": _sql(f"{HELD} flows daily bought bench", """SELECT c AS htsc_code, "date" AS "time", round(v, 6) AS "open", round(v, 6) AS high, round(v, 6) AS low, round(v, 6) AS "close", 0.0::DOUBLE AS volume, 'run' AS name, k AS security_type,
        strftime("date", '%Y') AS "year", strftime("date", '%m') AS "month" FROM (
        SELECT '000000.YKRS' AS c, "date", (cash_value + positions_value) / 1e7 AS v, 'portfolio_curve' AS k FROM daily
        UNION ALL SELECT '0000000.YKRS', "date", cash_value / (cash_value + positions_value), 'cash_ratio_curve' FROM daily
        UNION ALL SELECT '000001.YKRS', "date", "value" / 1e7, 'buy_hold_curve' FROM bench)"""),
    "curve_upsert": _sql(f"{B} segments days closes".replace(" days closes", ""), f"""SELECT {PRICE} FROM (
        SELECT b.htsc_code, b."time", "open" * f AS "open", high * f AS high, low * f AS low, "close" * f AS "close", volume FROM (SELECT b.*, CASE WHEN year(b."time") >= 1998 AND isodow(b."time") < 6 THEN cum ELSE 1 END AS f
        FROM bars b JOIN (SELECT *, product(xdy) OVER (PARTITION BY htsc_code ORDER BY begin_date ROWS UNBOUNDED PRECEDING) AS cum FROM segments) s ON s.htsc_code = b.htsc_code AND b."time" BETWEEN begin_date AND end_date) b)"""),
    "rule_sweep": _sql(f"{W} trial_masks bits tacts tsized tprofit trials", "SELECT * FROM trials"),
    "study_states": _sql(f"{W} trial_masks bits tacts tsized tprofit trials", """SELECT trial, buy_mask, sell_mask, CASE WHEN buy_mask >= 4 THEN 'FAIL' ELSE 'COMPLETE' END AS state,
        CASE WHEN buy_mask < 4 THEN n_trades END AS n_trades, CASE WHEN buy_mask < 4 THEN profit END AS profit FROM trials"""),
    "best_trial": _sql(f"{W} trial_masks bits tacts tsized tprofit trials", "SELECT * FROM trials ORDER BY profit DESC, trial LIMIT 1"),
    "rule_subsets": _sql("lines", """SELECT htsc_code, CAST(row_number() OVER (PARTITION BY htsc_code ORDER BY bit_count(m), m) - 1 AS INTEGER) AS "at", CAST(bit_count(m) AS INTEGER) AS size,
        array_to_string(list_filter(n, lambda x, i: ((m >> (i - 1)) & 1) = 1), '+') AS names FROM (SELECT htsc_code, n, unnest(range(1, 1 << len(n))) AS m FROM (
        SELECT htsc_code, list_sort(list(DISTINCT f)) AS n FROM (SELECT htsc_code, unnest([l_returnflag, l_linestatus]) AS f FROM lines) GROUP BY 1))"""),
    "run_names": """SELECT o_custkey, (CASE WHEN b > a + INTERVAL 12 MONTH THEN year(a) || '_to_' || year(b) WHEN year(a) = year(b) THEN strftime(a, '%Y%m') || '_to_' || strftime(b, '%m') ELSE strftime(a, '%Y%m') || '_to_' || strftime(b, '%Y%m') END)
        || (CASE WHEN len(p) > 0 THEN '_买' || array_to_string(p[1:2], '_') ELSE '' END) || (CASE WHEN len(p) > 2 THEN '_卖' || p[3] ELSE '' END) AS name, q AS stripped, 'a_b_' || q AS path FROM (
        SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b, list_sort(list(DISTINCT replace(o_orderpriority, ' ', '_'))) AS p, min(o_orderpriority) AS q FROM orders GROUP BY 1)""",
    "month_partitions": _sql(B, """SELECT htsc_code, strftime(m, '%Y') AS "year", strftime(m, '%m') AS "month" FROM (SELECT htsc_code, unnest(generate_series(date_trunc('month', min("time")), date_trunc('month', max("time")), INTERVAL 1 MONTH)) AS m FROM bars GROUP BY 1)"""),
    "profit_json": _sql("lines ordinals tlog", """SELECT code, '{"code":"' || code || '","pnl":' || CAST(sum(CAST(round(pnlcomm * 10000) AS BIGINT)) AS BIGINT) || '}' AS json FROM tlog GROUP BY 1"""),
    "top_trades": _sql("lines ordinals tlog", """SELECT code, CAST(rn AS INTEGER) AS rank, p AS pnlcomm, date_open, date_close FROM (SELECT *, round(pnlcomm, 4) AS p, row_number() OVER (PARTITION BY code ORDER BY round(pnlcomm, 4) DESC, date_open, date_close) AS rn FROM tlog) WHERE rn <= 10"""),
    "top_trades_json": _sql("lines ordinals tlog", """SELECT code, '[' || string_agg('{"rank":' || rn || ',"pnl":' || p || ',"date_open":"' || date_open || '","date_close":"' || date_close || '"}', ',' ORDER BY rn) || ']' AS json FROM (
        SELECT *, row_number() OVER (PARTITION BY code ORDER BY p DESC, date_open, date_close) AS rn FROM (SELECT *, CAST(round(pnlcomm * 10000) AS BIGINT) AS p FROM tlog)) WHERE rn <= 3 GROUP BY 1"""),
    "summary_format": """SELECT l_suppkey, regexp_replace(printf('%.2f', round(r / n * 100, 2)), '0$', '') || '%' AS share, round(n / 3.5::DOUBLE, 2) AS scaled FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS r, count(*) AS n FROM lineitem GROUP BY 1)""",
    "user_bars": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS "start", event_type, count(*) AS n, round(sum("value"), 4) AS total FROM events GROUP BY ALL""",
}
