"""Technical indicators over blocked series; one job for any number of keys and windows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.numeric import nan_to_null
from tickloom.operators import series
from tickloom.operators.series import POS


def true_range(high, low, previous_close) -> Column:
    """The largest of the three ranges; the first row has only high - low."""
    high, low, previous_close = (F.col(c) if isinstance(c, str) else c for c in (high, low, previous_close))
    return F.greatest(high - low, F.abs(high - previous_close), F.abs(low - previous_close))


def with_true_range(bars: DataFrame, keys: Sequence[str] = ("token",), name: str = "tr") -> DataFrame:
    keys = [*keys, OK]
    previous = F.lag("close").over(series.block_window(keys))
    made = series.halo_windowed(whole_bars(bars), keys, {name: true_range("high", "low", previous)}, before=1).drop(POS)
    return of_whole(made, name)


def atr_normalized(atr: str | Column, close: str | Column) -> Column:
    atr = F.col(atr) if isinstance(atr, str) else atr
    close = F.col(close) if isinstance(close, str) else close
    return atr / (close + F.lit(1e-9)) * F.lit(100.0)


def _blocks(df: DataFrame, keys: Sequence[str], windows: Sequence[int], ts: str = "ts", valid: Column | None = None, lead_in: int = 2):
    size, before = series.layout(windows, lead_in)
    rebase = size + before > min(series.reach(w) for w in windows)
    return series.blocked(series.position(df, keys, ts, valid=valid), size, before), size, before, rebase


def ewm(
    df: DataFrame,
    value: str,
    window: int,
    name: str = "ewm",
    keys: Sequence[str] = ("token",),
    min_periods: int = 0,
    ts: str = "ts",
) -> DataFrame:
    """Exponential mean with alpha = 1/window, started at the first value.

    A missing value carries the previous mean.
    """
    x = nan_to_null(F.col(value))
    laid, size, before, rebase = _blocks(df.withColumn("_x", x), keys, [window], ts, valid=F.col("_x").isNotNull())
    u = f"CASE WHEN {POS} = 0 THEN _x ELSE _x / {window} END"
    scanned = series.decay_scan(laid, keys, {name: (u, f"{series.keep(window)!r}D")}, size, before, rebase)
    return series.own(
        scanned.withColumn(name, F.when(F.col(POS) >= max(min_periods - 1, 0), F.col(name))), POS, "_x"
    )


# ------------------------------------------------------------------ RSI, ATR, ADX


def indicator_columns(
    laid: DataFrame,
    keys: Sequence[str],
    size: int | str,
    before: int | str,
    rsi: int | str | None = None,
    atr: int | str | None = None,
    adx: int | str | None = None,
    rebase: bool = False,
    null_head: bool = False,
) -> DataFrame:
    """Add rsi / atr / adx, adx_pos, adx_neg to blocked bars. The windows may be columns, so
    every parameter row has its own. Rows before the first full window are 0.0 for ATR and
    ADX (NULL with ``null_head``) and NULL for RSI."""
    add = lambda df, **columns: df.withColumns({k: F.expr(v) for k, v in columns.items()})
    here, running = series.over(keys), series.over(keys, series.RUNNING)
    head = "CAST(NULL AS DOUBLE)" if null_head else "0D"
    kept = lambda n: f"(1D - 1D / {n})"
    df = add(laid, _pc=f"lag(close) {here}", _ph=f"lag(high) {here}", _pl=f"lag(low) {here}")
    steps, sums, scans, done = {}, {}, {}, {}
    if rsi is not None:
        for name, part in (("_gain", "close - _pc"), ("_loss", "_pc - close")):
            x = f"greatest(coalesce({part}, 0D), 0D)"
            scans[name] = (f"CASE WHEN {POS} = 0 THEN {x} ELSE {x} / {rsi} END", kept(rsi))
        done["rsi"] = f"CASE WHEN {POS} >= {rsi} - 1 THEN CASE WHEN _loss = 0D THEN 100D ELSE 100D - 100D / (1D + try_divide(_gain, _loss)) END END"
    if atr is not None or adx is not None:
        steps["_tr"] = "greatest(high - low, abs(high - _pc), abs(low - _pc))"
    if atr is not None:
        sums["_tr_sum"] = f"sum(_tr) {running}"
        scans["_atr"] = (f"CASE WHEN {POS} = {atr} - 1 THEN _tr_sum / {atr} WHEN {POS} >= {atr} THEN _tr / {atr} END", kept(atr))
        done["atr"] = f"CASE WHEN {POS} >= {atr} - 1 THEN _atr ELSE {head} END"
    if adx is not None:
        steps["_up"] = "CASE WHEN high - _ph > _pl - low AND high - _ph > 0D THEN high - _ph ELSE 0D END"
        steps["_dn"] = "CASE WHEN _pl - low > high - _ph AND _pl - low > 0D THEN _pl - low ELSE 0D END"
        steps["_mv"] = f"CASE WHEN {POS} >= 1 THEN greatest(high - low, abs(high - _pc), abs(low - _pc)) ELSE 0D END"
        for c in ("_up", "_dn", "_mv"):
            sums[f"{c}_sum"] = f"sum({c}) {running}"
            scans[f"{c}_w"] = (f"CASE WHEN {POS} = {adx} THEN {c}_sum WHEN {POS} > {adx} THEN {c} END", kept(adx))
    if steps:
        df = add(add(df, **steps), **sums)
    df = series.decay_scan(df, keys, scans, size, before, rebase)
    if adx is not None:
        df = add(df, _plus="coalesce(100D * try_divide(_up_w, _mv_w), 0D)", _minus="coalesce(100D * try_divide(_dn_w, _mv_w), 0D)")
        # no movement at all in the window counts as no trend
        df = add(df, _dx=f"CASE WHEN {POS} >= {adx} THEN coalesce(100D * try_divide(abs(_plus - _minus), _plus + _minus), 0D) ELSE 0D END")
        df = add(df, _dx_sum=f"sum(_dx) {running}")
        u = f"CASE WHEN {POS} = 2 * {adx} - 1 THEN _dx_sum / {adx} WHEN {POS} >= 2 * {adx} THEN _dx / {adx} END"
        df = series.decay_scan(df, keys, {"_adx": (u, kept(adx))}, size, before, rebase)
        done["adx"] = f"CASE WHEN {POS} >= 2 * {adx} - 1 THEN _adx ELSE {head} END"
        done["adx_pos"] = f"CASE WHEN {POS} > {adx} THEN _plus ELSE {head} END"
        done["adx_neg"] = f"CASE WHEN {POS} > {adx} THEN _minus ELSE {head} END"
    kept_columns = [c for c in laid.columns]
    return df.select(*kept_columns, *[F.expr(v).alias(k) for k, v in done.items()])


OUTPUTS = ("rsi", "atr", "adx", "adx_pos", "adx_neg")
PRICES = ("open", "high", "low", "close", "volume")
OK = "_whole"


def clean_bars(bars: DataFrame) -> DataFrame:
    """NaN prices and volumes as NULL."""
    kinds = dict(bars.dtypes)
    return bars.withColumns({c: nan_to_null(F.col(c)) for c in PRICES if kinds.get(c) in ("double", "float")})


def whole_bars(bars: DataFrame) -> DataFrame:
    """Clean bars marked whole or not. Bars without a price form a series of their own beside
    the whole ones: they take no part in any state and get no indicator."""
    whole = F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    return clean_bars(bars).withColumn(OK, whole)


def of_whole(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(F.col(OK), F.col(c)) for c in columns}).drop(OK)


def indicators(
    bars: DataFrame,
    rsi: int | None = None,
    atr: int | None = None,
    adx: int | None = None,
    keys: Sequence[str] = ("token",),
    null_head: bool = False,
) -> DataFrame:
    """The chosen indicators with one window each."""
    windows = [w for w in (rsi, atr, adx) if w is not None]
    if not windows:
        raise ValueError("choose at least one of rsi, atr, adx")
    keys = [*keys, OK]
    laid, size, before, rebase = _blocks(whole_bars(bars), keys, windows)
    added = indicator_columns(laid, keys, size, before, rsi, atr, adx, rebase, null_head)
    made = [c for c in OUTPUTS if c in added.columns and c not in bars.columns]
    return of_whole(series.own(added, POS), *made)


def sweep(
    bars: DataFrame,
    params: Sequence[dict],
    keys: Sequence[str] = ("token", "tf"),
    null_head: bool = False,
    more: dict[str, str] | None = None,
) -> DataFrame:
    """Many parameter rows over many timeframes as one job.

    ``params`` rows are ``{"param_id", "tf", "rsi", "atr", "adx"}``; a window may be None. ``more`` adds window expressions of
    bar columns by name, with ``{n}``, ``{over}`` (the ordered series) and ``{rows}`` (its last n rows) in them; a row's ``more`` has
    the n of each it wants. They share the blocks of the indicators.
    They are configuration, so they travel as literals, and every row has its own block layout.
    Bars of a timeframe without parameters are pruned.
    """
    if not params:
        raise KeyError("missing parameter rows: params")
    more = more or {}
    names = [k for k in ("rsi", "atr", "adx") if any(p.get(k) for p in params)]
    rows, rebase = [], False
    for p in params:
        for need in ("param_id", "tf"):
            if need not in p:
                raise KeyError(f"missing parameter: params/{need}")
        windows = [int(p[k]) for k in names if p.get(k)]
        back = max((int(n) for n in p.get("more", {}).values()), default=0)
        if windows:
            size, before = series.layout(windows)
            size, before = size, max(before, back)
            rebase |= size + before > min(series.reach(w) for w in windows)
        else:
            size, before = max(4096, 16 * back), back
        rows.append((p, size, before))
    number = lambda n: "CAST(NULL AS INT)" if n is None else str(int(n))
    choices = ", ".join(
        f"named_struct('param_id', '{p['param_id']}', '_ptf', '{p['tf']}', '_size', {size}L, '_before', {before}L"
        + "".join(f", '_n_{k}', {number(p.get(k))}" for k in names)
        + "".join(f", '_m_{k}', {number(p.get('more', {}).get(k))}" for k in more)
        + ")"
        for p, size, before in rows
    )
    tfs = sorted({p["tf"] for p in params})
    keys = [*keys, OK]
    placed = series.position(whole_bars(bars.filter(F.col("tf").isin(tfs))), keys)
    fanned = placed.selectExpr("*", f"inline(filter(array({choices}), s -> s._ptf = tf))").drop("_ptf")
    laid = series.blocked(fanned, "_size", "_before")
    all_keys = [*keys, "param_id"]
    column = lambda k: f"_n_{k}" if k in names else None
    added = laid
    for name, expression in more.items():
        wanted = sorted({int(p["more"][name]) for p in params if p.get("more", {}).get(name)})
        frames = {n: {"n": n, "over": series.over(all_keys), "rows": series.over(all_keys, f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")} for n in wanted}
        cases = " ".join(f"WHEN _m_{name} = {n} AND {POS} >= {n - 1} THEN {expression.format(**frame)}" for n, frame in frames.items())
        added = added.withColumn(name, F.expr(f"CASE {cases} END") if cases else F.lit(None).cast("double"))
    if names:
        added = indicator_columns(added, all_keys, "_size", "_before", column("rsi"), column("atr"), column("adx"), rebase, null_head)
    outputs = {"rsi": ["rsi"], "atr": ["atr"], "adx": ["adx", "adx_pos", "adx_neg"]}
    optional = [k for k in names if any(not p.get(k) for p in params)]
    if optional:
        added = added.withColumns({c: F.expr(f"CASE WHEN _n_{k} IS NOT NULL THEN {c} END") for k in optional for c in outputs[k]})
    done = series.own(added, POS, "_size", "_before", *[f"_n_{k}" for k in names], *[f"_m_{k}" for k in more])
    return of_whole(done, *[c for k in names for c in outputs[k]], *more)


def lag_features(df: DataFrame, columns: Sequence[str], lags: Sequence[int] = (1, 2, 4), keys: Sequence[str] = ("token",)) -> DataFrame:
    w = series.block_window(keys)
    made = {f"{c}_lag_{n}": F.lag(c, n).over(w) for c, n in chain.from_iterable([(c, n) for n in lags] for c in columns)}
    return series.halo_windowed(df, keys, made, before=max(lags)).drop(POS)
