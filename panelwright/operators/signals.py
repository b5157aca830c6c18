"""Signal stacks: wide measures of a node become rows (node, type, firing, score, direction)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Signal:
    """Fires where |measure| exceeds limit; scores |measure| / scale, at most 1. lean: 1 with the measure's sign, -1 against
    it, 0 neutral, or a column whose sign it takes. scale may be a column."""

    measure: str
    limit: float
    scale: float | str
    lean: int | str = 0


BASKET_SIGNALS = {
    "pair": Signal("pair_z", 1.5, 3.0, 1),
    "residual": Signal("n_stretched", 1.5, "stretch_scale", "stretch_balance"),
    "gap": Signal("gap", 0.02, 0.15, -1),
    "regime": Signal("regime_z", 2.0, 4.0),
    "dispersion": Signal("dispersion", 0.5, 1.0),
    "momentum": Signal("momentum", 0.1, 0.3, 1),
}
STOCK_SIGNALS = {"residual": Signal("residual_z", 1.5, 3.0, -1), "attribution": Signal("dispersion", 0.6, 1.0), "peer": Signal("peer_gap", 0.1, 0.3, 1)}


def stack(wide: DataFrame, node: list[str], signals: dict[str, Signal]) -> DataFrame:
    """One row per node and signal: type, firing, score, direction (1, -1, or 0 where it doesn't fire or is neutral). A null
    measure doesn't fire and scores 0; a measure that the table lacks is an error."""
    lacking = {s.measure for s in signals.values()} - set(wide.columns)
    if lacking:
        raise ValueError(f"no column for {', '.join(sorted(lacking))}")

    def row(kind: str, s: Signal) -> Column:
        x = F.col(s.measure).cast("double")
        firing = F.coalesce(F.abs(x) > s.limit, F.lit(False))
        scale = F.col(s.scale) if isinstance(s.scale, str) else F.lit(s.scale)
        side = F.signum(F.col(s.lean).cast("double")) if isinstance(s.lean, str) else F.signum(x) * s.lean
        score = F.when(x.isNull(), 0.0).otherwise(F.least(F.abs(x) / scale, F.lit(1.0)))  # least() would pass over a null
        return F.struct(F.lit(kind).alias("type"), firing.alias("firing"), score.alias("score"), F.when(firing, side.cast("int")).otherwise(0).alias("direction"))

    return wide.select(*node, F.explode(F.array(*(row(t, s) for t, s in signals.items()))).alias("s")).select(*node, "s.*")
