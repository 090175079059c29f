"""DuckDB twins of the views, for the result checks."""

from __future__ import annotations

BAR_AGG = """arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ticks": ((), "SELECT event_type AS token, ts, value AS price, 1.0::DOUBLE AS qty, event_id AS tick_id FROM events"),
    "bars_1h": (
        ("ticks",),
        """SELECT token, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(price, tick_id) AS open, max(price) AS high,
        min(price) AS low, arg_max(price, tick_id) AS close, sum(qty) AS volume FROM ticks GROUP BY 1, 2""",
    ),
    "bars_4h": (("bars_1h",), f"SELECT token, time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS ts_, {BAR_AGG} FROM bars_1h GROUP BY 1, 2"),
    "bars_1d": (("bars_1h",), f"SELECT token, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS ts_, {BAR_AGG} FROM bars_1h GROUP BY 1, 2"),
    "bars_7d": (("bars_1h",), f"SELECT token, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS ts_, {BAR_AGG} FROM bars_1h GROUP BY 1, 2"),
    "bars": (
        ("bars_1h", "bars_4h", "bars_1d", "bars_7d"),
        """SELECT token, '1h' AS tf, ts, open, high, low, close, volume FROM bars_1h
        UNION ALL SELECT token, '4h', ts_, open, high, low, close, volume FROM bars_4h
        UNION ALL SELECT token, '1d', ts_, open, high, low, close, volume FROM bars_1d
        UNION ALL SELECT token, '7d', ts_, open, high, low, close, volume FROM bars_7d""",
    ),
    "econ_events": (
        (),
        "SELECT ts, CASE WHEN event_id % 2 = 0 THEN 'High ' ELSE 'low' END AS impact FROM events WHERE event_type = 'error'",
    ),
    "trades": (
        (),
        """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT) AS trade_id, l_orderkey * 10 + l_linenumber AS trade_no, o_custkey AS account, l_returnflag AS token,
        CASE WHEN l_linestatus = 'F' THEN 'long' ELSE 'short' END AS direction, l_extendedprice / l_quantity AS entry_price,
        l_quantity AS position_size, l_extendedprice / l_quantity * (1 + l_tax - l_discount) AS exit_price, l_tax * 10 AS fees,
        o_orderdate AS entry_ts, CASE WHEN l_shipdate >= o_orderdate THEN l_shipdate END AS exit_ts, l_orderkey AS signal_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "closed": (
        ("trades",),
        """SELECT *, (exit_price - entry_price) * position_size * CASE WHEN direction = 'short' THEN -1 ELSE 1 END - fees AS pnl_usd
        FROM trades WHERE exit_ts IS NOT NULL""",
    ),
    "positions": (
        ("ticks",),
        """SELECT token || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS position_id, token,
        CASE WHEN day(ts) % 2 = 0 THEN 'long' ELSE 'short' END AS direction, price AS entry_price, ts AS entry_ts,
        price * CASE WHEN day(ts) % 2 = 0 THEN 0.25 ELSE 4.0 END::DOUBLE AS stop_loss,
        price * CASE WHEN day(ts) % 2 = 0 THEN 4.0 ELSE 0.25 END::DOUBLE AS take_profit
        FROM ticks QUALIFY row_number() OVER (PARTITION BY token, CAST(ts AS DATE) ORDER BY tick_id) = 1""",
    ),
    "signals": (
        (),
        """SELECT o_orderkey AS signal_id, o_orderdate AS ts, o_orderstatus AS token,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'OPEN_LONG' WHEN '2-HIGH' THEN 'OPEN_SHORT' WHEN '3-MEDIUM' THEN 'EXIT_LONG'
        WHEN '4-NOT SPECIFIED' THEN 'EXIT_SHORT' WHEN '5-LOW' THEN 'HOLD' END AS label, (o_orderkey % 100)::DOUBLE / 100 AS prob,
        CASE WHEN o_custkey % 4 > 0 THEN 'run-' || (o_custkey % 4) END AS run_id, o_totalprice AS price FROM orders""",
    ),
    "preds": (
        ("signals",),
        """SELECT signal_id, token, ts, model, label, ((signal_id * 7 + mi * 3 + li * (signal_id % 11 + 13)) % 97)::DOUBLE / 100 AS prob,
        CASE WHEN signal_id % 10 > 0 THEN price END AS entry_price, li
        FROM (SELECT signal_id, token, ts, price FROM signals),
        (VALUES ('model_a', 0), ('model_b', 1), ('model_c', 2)) m(model, mi),
        (VALUES ('OPEN_LONG', 0), ('OPEN_SHORT', 1), ('EXIT_LONG', 2), ('EXIT_SHORT', 3), ('HOLD', 4)) l(label, li)""",
    ),
}


def with_views(*names: str, recursive: bool = False, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause with the named views, those they need, and extra ones after them."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in ordered:
            return
        for dep in VIEWS[name][0]:
            need(dep)
        ordered.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in ordered] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


def indicator_views(source: str) -> dict[str, str]:
    """Sequential indicators of a view (token, grp, nr, na, nd, ts, high, low, close, ...):
    state machines over the row number, independent of the block layout under test."""
    return {
        "num": f"""SELECT *, row_number() OVER w - 1 AS i, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl
            FROM {source} WINDOW w AS (PARTITION BY token, grp ORDER BY ts)""",
        "stp": """SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
            CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS up,
            CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS dn,
            CASE WHEN close > pc THEN close - pc ELSE 0 END AS gain, CASE WHEN close < pc THEN pc - close ELSE 0 END AS loss FROM num""",
        "run": """SELECT token, grp, i, nr, na, nd, gain::DOUBLE AS g, loss::DOUBLE AS l, tr AS s, CASE WHEN na = 1 THEN tr ELSE 0 END::DOUBLE AS a,
            0::DOUBLE AS st, 0::DOUBLE AS sp, 0::DOUBLE AS sm, 0::DOUBLE AS t, 0::DOUBLE AS p, 0::DOUBLE AS m FROM stp WHERE i = 0
            UNION ALL
            SELECT n.token, n.grp, n.i, n.nr, n.na, n.nd, r.g * (n.nr - 1) / n.nr + n.gain / n.nr, r.l * (n.nr - 1) / n.nr + n.loss / n.nr, r.s + n.tr,
            CASE WHEN n.i < n.na - 1 THEN 0 WHEN n.i = n.na - 1 THEN (r.s + n.tr) / n.na ELSE (r.a * (n.na - 1) + n.tr) / n.na END,
            r.st + n.tr, r.sp + n.up, r.sm + n.dn,
            CASE WHEN n.i < n.nd THEN 0 WHEN n.i = n.nd THEN r.st + n.tr ELSE r.t - r.t / n.nd + n.tr END,
            CASE WHEN n.i < n.nd THEN 0 WHEN n.i = n.nd THEN r.sp + n.up ELSE r.p - r.p / n.nd + n.up END,
            CASE WHEN n.i < n.nd THEN 0 WHEN n.i = n.nd THEN r.sm + n.dn ELSE r.m - r.m / n.nd + n.dn END
            FROM run r JOIN stp n ON n.token = r.token AND n.grp = r.grp AND n.i = r.i + 1""",
        "dxs": """SELECT *, CASE WHEN t > 0 THEN 100 * p / t ELSE 0 END AS plus, CASE WHEN t > 0 THEN 100 * m / t ELSE 0 END AS minus,
            CASE WHEN i >= nd AND t > 0 AND p + m > 0 THEN 100 * abs(p / t - m / t) / (p / t + m / t) ELSE 0 END AS dx FROM run""",
        "adr": """SELECT token, grp, i, nd, dx AS sd, CASE WHEN i = 2 * nd - 1 THEN dx / nd ELSE 0 END AS ad FROM dxs WHERE i = 0
            UNION ALL
            SELECT d.token, d.grp, d.i, d.nd, r.sd + d.dx,
            CASE WHEN d.i < 2 * d.nd - 1 THEN 0 WHEN d.i = 2 * d.nd - 1 THEN (r.sd + d.dx) / d.nd ELSE (r.ad * (d.nd - 1) + d.dx) / d.nd END
            FROM adr r JOIN dxs d ON d.token = r.token AND d.grp = r.grp AND d.i = r.i + 1""",
        "ind": """SELECT n.*, CASE WHEN n.i >= n.nr - 1 THEN CASE WHEN d.l = 0 THEN 100 ELSE 100 - 100 / (1 + d.g / d.l) END END AS rsi,
            d.a AS atr, a.ad AS adx, CASE WHEN n.i > n.nd THEN d.plus ELSE 0 END AS adx_pos, CASE WHEN n.i > n.nd THEN d.minus ELSE 0 END AS adx_neg
            FROM num n JOIN dxs d USING (token, grp, i) JOIN adr a USING (token, grp, i)""",
    }


def ewm_view(source: str, value: str, window: int, name: str = "ewm") -> str:
    """Sequential exponential mean of a numbered view (token, i, value)."""
    return f"""SELECT token, i, {value} AS {name} FROM {source} WHERE i = 0
        UNION ALL SELECT n.token, n.i, r.{name} * ({window} - 1) / {window} + n.{value} / {window}
        FROM ew r JOIN {source} n ON n.token = r.token AND n.i = r.i + 1"""
