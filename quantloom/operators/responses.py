"""What a factor's realised ICs lead to: watch, reduce, take offline, recover. One step, used by the batch fold and by the stream."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import fold

RECORDS = "factor string, trade_date date, signal_date date, ic double, status string, weight double, negatives int, positives int, changed boolean"


@dataclass(frozen=True)
class Limits:
    # fixed values
    offline: float = -0.03
    watch_after: int = 5
    reduce_after: int = 10
    offline_after: int = 15
    recover_after: int = 20


def respond(state: dict, ic: float, limits: Limits = Limits()) -> bool:
    """One more observation: a state gets worse at once, better step by step. True where the status changed.

    Offline turns into reserve with the next observation that isn't bad enough by itself, and reserve stays; reduced stays too; only
    watch recovers, after `recover_after` observations above 0 in a row. An observation of 0 ends both kinds of streak.
    """
    status, weight = state.get("status", "ACTIVE"), state.get("weight", 1.0)
    down = state.get("negatives", 0) + 1 if ic < 0 else 0
    up = state.get("positives", 0) + 1 if ic > 0 else 0
    if ic < limits.offline or (down >= limits.offline_after and status != "OFFLINE"):
        new = "OFFLINE", 0.0
    elif down >= limits.reduce_after and status not in ("OFFLINE", "REDUCED"):
        new = "REDUCED", 0.5
    elif down >= limits.watch_after and status == "ACTIVE":
        new = "WATCH", weight
    elif up >= limits.recover_after and status == "WATCH":
        new = "ACTIVE", 1.0
    else:
        new = {"OFFLINE": ("RESERVE", 0.0), "RESERVE": ("RESERVE", 0.0), "REDUCED": ("REDUCED", 0.5), "WATCH": ("WATCH", weight)}.get(status, ("ACTIVE", 1.0))
    state.update(status=new[0], weight=new[1], negatives=down, positives=up)
    return new[0] != status


def observed(state: dict, factor: str, rows: pd.DataFrame, limits: Limits) -> pd.DataFrame:
    """Rows (trade_date, signal_date, ic) in the order given: signals seen before, and unknown ICs, are passed over."""
    seen, out = set(state.get("seen", [])), []
    for date, signal, ic in zip(rows["trade_date"], rows["signal_date"], rows["ic"], strict=True):
        if pd.isna(ic) or str(signal) in seen:
            continue
        seen.add(str(signal))
        changed = respond(state, float(ic), limits)
        out.append((factor, date, signal, float(ic), state["status"], state["weight"], state["negatives"], state["positives"], changed))
    state["seen"] = sorted(seen)  # a date a signal
    return pd.DataFrame(out, columns=[x.split()[0] for x in RECORDS.split(", ")])


def factor_responses(ics: DataFrame, limits: Limits = Limits(), known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """ics: factor, trade_date (when the IC became known), signal_date, ic. Records, and each factor's state for a later call."""
    rows = ics.select("factor", "trade_date", "signal_date", F.col("ic").cast("double").alias("ic"))

    def step(state, factor, date, own):
        return observed(state, factor, own.assign(trade_date=date), limits)

    both = fold(rows, "factor", "trade_date", ["signal_date"], step, RECORDS, known)
    return both.where("state is null").drop("state"), both.where("state is not null").select("factor", "trade_date", "state")
