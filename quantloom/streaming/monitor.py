"""Factor responses on a stream of realised ICs: repeats are passed over, and a factor's state goes on from micro-batch to micro-batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.responses import RECORDS, Limits, observed


def monitored(ics: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """ics: a stream of factor, trade_date, signal_date, ic. A row a new observation.

    Labels become known late, so an IC comes when its label does: observations of one micro-batch are taken by trade and signal date, those of a later
    one after them. An IC of a signal that was counted before, in this or an earlier micro-batch, changes nothing.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["trade_date", "signal_date"], kind="stable")  # a factor's rows of one micro-batch
        out = observed(known, key[0], rows, limits)
        state.update((json.dumps(known),))
        yield out

    rows = ics.select("factor", "trade_date", "signal_date", "ic")
    return rows.groupBy("factor").applyInPandasWithState(update, RECORDS, "state string", "append", GroupStateTimeout.NoTimeout)
