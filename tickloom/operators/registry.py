"""Features by name: what each one reads, which setting gives its window, and what it adds.

All features of all horizons and timeframes resolve to parameter rows of one sweep, so they share one block layout
and one shuffle however many there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from tickloom.operators.indicators import OUTPUTS

ROLES = ("15m", "1h", "4h", "1d")
ENGINES = {"rsi": ("close",), "atr": ("high", "low", "close"), "adx": ("high", "low", "close")}


@dataclass(frozen=True)
class Feature:
    """A feature of one timeframe role.

    Its window stands at ``[horizon][role][name][setting]`` of the settings. ``engine`` names an indicator of the sweep (rsi,
    atr, adx) and ``outputs`` map columns to expressions over what the sweep makes. Without an engine the feature is a window
    expression of bar columns, ``expression``: ``{n}`` is the window, ``{over}`` the window clause of the ordered series, ``{rows}``
    that of the last n rows. Rows before the first full window are NULL.
    """

    name: str
    role: str
    outputs: Mapping[str, str] = field(default_factory=dict)
    engine: str | None = None
    expression: str | None = None
    inputs: tuple[str, ...] = ()
    setting: str = "window"

    def __post_init__(self) -> None:
        if (self.engine is None) == (self.expression is None):
            raise ValueError(f"feature {self.name}: give an engine or an expression")
        if self.engine is not None and self.engine not in ENGINES:
            raise ValueError(f"feature {self.name}: unknown engine {self.engine!r}")

    @property
    def columns(self) -> dict[str, str]:
        """Output columns and where they come from; a window expression is named after its feature."""
        return dict(self.outputs) if self.engine or self.outputs else {self.name: self.name}

    @property
    def reads(self) -> tuple[str, ...]:
        return self.inputs or ENGINES.get(self.engine or "", ())


def standard_features(roles: Iterable[str] = ROLES) -> tuple[Feature, ...]:
    """RSI of the base timeframe, and ATR and ADX of all."""
    made = [Feature("rsi_15m", "15m", {"rsi_15m": "rsi"}, "rsi")]
    for r in roles:
        made.append(Feature(f"adx_{r}", r, {f"{c}_{r}": c for c in ("adx", "adx_pos", "adx_neg")}, "adx"))
        made.append(Feature(f"atr_{r}", r, {f"atr_normalized_{r}": "atr_normalized"}, "atr"))
    return tuple(made)


STANDARD = standard_features()


def settings_of(windows: Mapping[str, Mapping[str, tuple]]) -> dict:
    """Settings of a table horizon -> role -> (rsi, atr, adx)."""
    return {
        horizon: {role: {f"{k}_{role}": {"window": n} for k, n in zip(("rsi", "atr", "adx"), three) if n is not None} for role, three in per_role.items()}
        for horizon, per_role in windows.items()
    }


def setting(settings: Mapping, path: Sequence[str]) -> int:
    """The window at a path of the settings; what is missing or no whole number of at least 1 is an error that names the path."""
    at = settings
    for k, key in enumerate(path):
        if not isinstance(at, Mapping) or key not in at:
            raise KeyError(f"missing setting {'/'.join(path)} (no {'/'.join(path[: k + 1])})")
        at = at[key]
    try:
        value = int(at)
    except (TypeError, ValueError) as e:
        raise ValueError(f"setting {'/'.join(path)} must be a whole number, got {at!r}") from e
    if isinstance(at, bool) or value < 1 or value != float(at):
        raise ValueError(f"setting {'/'.join(path)} must be a whole number of at least 1, got {at!r}")
    return value


@dataclass(frozen=True)
class Resolved:
    """``params`` and ``more`` for the sweep; ``outputs`` by role: column -> expression."""

    params: list[dict]
    more: dict[str, str]
    outputs: dict[str, dict[str, str]]


def resolve(features: Sequence[Feature], settings: Mapping, roles: Mapping[str, str], columns: Iterable[str], horizons: Sequence[str] | None = None) -> Resolved:
    """Check the features against settings and bar columns and turn them into one sweep. ``roles`` maps roles to timeframes."""
    columns = set(columns)
    params: dict[tuple[str, str], dict] = {}
    outputs: dict[str, dict[str, str]] = {}
    more: dict[str, str] = {}
    seen: set[str] = set()
    for f in features:
        if f.role not in roles:
            raise KeyError(f"feature {f.name}: no timeframe for role {f.role}")
        lacking = [c for c in f.reads if c not in columns]
        if lacking:
            raise KeyError(f"feature {f.name}: missing input columns {lacking}")
        twice = seen & set(f.columns)
        if twice:
            raise ValueError(f"feature {f.name}: columns made twice: {sorted(twice)}")
        seen |= set(f.columns)
        if f.expression is not None:
            if f.name in OUTPUTS or f.name in more:
                raise ValueError(f"feature {f.name}: the name is taken")
            more[f.name] = f.expression
        outputs.setdefault(f.role, {}).update(f.columns)
        for horizon in horizons or list(settings):
            n = setting(settings, [horizon, f.role, f.name, f.setting])
            row = params.setdefault((horizon, f.role), {"param_id": horizon, "tf": roles[f.role], "rsi": None, "atr": None, "adx": None, "more": {}})
            if f.expression is not None:
                row["more"][f.name] = n
            elif row[f.engine] not in (None, n):
                raise ValueError(f"feature {f.name}: {f.engine} of {horizon}/{f.role} has two windows, {row[f.engine]} and {n}")
            else:
                row[f.engine] = n
    return Resolved(list(params.values()), more, outputs)
