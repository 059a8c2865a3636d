"""Run parameters and their validation."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date
from typing import Any

# Accepted ranges of the parameters.
MAX_PERIOD = 5000
MAX_FEE_BPS = 100.0
MAX_SLIPPAGE_BPS = 500.0
MAX_ODD_LOT_EXTRA_BPS = 500.0

WARMUP_MARGIN = 10


@dataclass(frozen=True)
class Costs:
    """Trading costs in basis points, and the starting cash."""

    initial_cash: float = 1000.0
    fee_bps: float = 3.25
    slippage_bps: float = 10.0
    odd_lot_extra_bps: float = 5.0

    def __post_init__(self):
        limits = {"fee_bps": MAX_FEE_BPS, "slippage_bps": MAX_SLIPPAGE_BPS, "odd_lot_extra_bps": MAX_ODD_LOT_EXTRA_BPS}
        if not (math.isfinite(self.initial_cash) and self.initial_cash > 0):
            raise ValueError("initial_cash must be finite and positive")
        for name, most in limits.items():
            if not 0 <= getattr(self, name) <= most:  # false for NaN too
                raise ValueError(f"{name} must be within 0 and {most}")

    @property
    def rates(self) -> tuple[float, float, float]:
        """Fee, slippage and odd-lot slippage as fractions."""
        return self.fee_bps / 10000.0, self.slippage_bps / 10000.0, self.odd_lot_extra_bps / 10000.0


@dataclass(frozen=True)
class Grid:
    """Lists of periods whose product is searched."""

    gaps: tuple[int, ...]
    signals: tuple[int, ...]
    momenta: tuple[int, ...]
    vols: tuple[int, ...] = (21,)

    def __post_init__(self):
        for name in ("gaps", "signals", "momenta", "vols"):
            values = getattr(self, name)
            if not values or len(set(values)) != len(values):
                raise ValueError(f"{name} must be distinct and not empty")
            for v in values:
                if isinstance(v, bool) or not isinstance(v, int) or not 1 <= v <= MAX_PERIOD:
                    raise ValueError(f"{name}: {v!r} is not a period from 1 to {MAX_PERIOD}")
        if min(self.vols) < 2:
            raise ValueError("a sample variance needs a vol period of 2 at least")

    @property
    def size(self) -> int:
        return len(self.gaps) * len(self.signals) * len(self.momenta) * len(self.vols)

    def shard(self, number: int, shards: int) -> Grid | None:
        """Every ``shards``-th gap from the ``number``-th on; None if there is none."""
        if shards < 1 or not 0 <= number < shards:
            raise ValueError(f"no shard {number} of {shards}")
        own = self.gaps[number::shards]
        return Grid(own, self.signals, self.momenta, self.vols) if own else None


def ranges(gap: tuple[int, int], signal: tuple[int, int], momentum: tuple[int, int], vol: tuple[int, int] = (21, 21)) -> Grid:
    """A grid of whole ranges, both ends included."""
    for low, high in (gap, signal, momentum, vol):
        if high < low:
            raise ValueError(f"range {low}..{high} is reversed")
    return Grid(*(tuple(range(a, b + 1)) for a, b in (gap, signal, momentum, vol)))


def check_dates(start: str, end: str | None) -> tuple[date, date | None]:
    """Both as dates; an empty end is open."""
    first, last = date.fromisoformat(start), date.fromisoformat(end) if end else None
    if last is not None and first >= last:
        raise ValueError(f"start {start} isn't before end {end}")
    return first, last


def required_warmup(gap: int, signal: int, momentum: int, vol: int, margin: int = WARMUP_MARGIN) -> int:
    """Sessions a ticker needs before the start for every indicator to be defined."""
    Grid((gap,), (signal,), (momentum,), (vol,))
    return max(gap + signal + 2, momentum + 1, vol + 2) + margin


@dataclass(frozen=True)
class Setting:
    """A value, and the layer that it comes from."""

    value: Any
    source: str


def layered(name: str, cast: Callable[[Any], Any], argument: Any, variable: str, environment: Mapping[str, str], metadata: Mapping[str, Any]) -> Setting:
    """The first layer that has a value: the argument, the environment's variable (an
    empty one is none), the metadata's field of that name. A value that can't be cast
    fails where it stands, and so does a setting without any."""
    layers = (("argument", argument), ("environment", environment.get(variable) or None), ("metadata", metadata.get(name)))
    for source, value in layers:
        if value is not None:
            try:
                return Setting(cast(value), source)
            except (TypeError, ValueError) as e:
                raise ValueError(f"{name}: {value!r} of the {source} can't be used") from e
    raise ValueError(f"{name} is in neither argument, environment ({variable}) nor metadata")


# What the metadata of a snapshot must tell, and the environment's variables.
SNAPSHOT_FIELDS = ("upstream_sha", "universe_sha256", "requested_end")
VARIABLES = {"shards": "SHARDS", "fee_bps": "FEE_BPS", "slippage_bps": "SLIPPAGE_BPS", "odd_lot_extra_bps": "ODD_LOT_EXTRA_BPS"}
RUN_VARIABLES = {"github_run_id": "GITHUB_RUN_ID", "optimizer_sha": "GITHUB_SHA", "github_repository": "GITHUB_REPOSITORY"}


def expected_provenance(environment: Mapping[str, str], snapshot: Mapping[str, Any]) -> dict[str, str]:
    """What all shards of the run at hand must tell, from the environment and the
    snapshot's metadata, which must have passed their own audit."""
    if snapshot.get("status") != "PASS":
        raise ValueError("the snapshot's metadata aren't in PASS")
    if absent := [k for k in SNAPSHOT_FIELDS if not str(snapshot.get(k) or "")]:
        raise ValueError(f"the snapshot's metadata have no {', '.join(absent)}")
    out = {k: environment.get(v, "") for k, v in RUN_VARIABLES.items()}
    return out | {f"snapshot_{k}": str(snapshot[k]) for k in SNAPSHOT_FIELDS}
