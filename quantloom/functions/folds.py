"""Ordered folds: a state for each key that goes from date to date, with no more in memory than one date of one key.

Rows are dealt by key and sorted by key and date inside their partitions, and each partition is then one pass in Arrow batches. A
date's rows may lie across batches: what isn't complete yet waits for the next one. A partition may hold many keys, and a key's
history may be longer than memory.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(df: DataFrame, by: str, date: str, order: list[str], step: Callable[[dict, object, object, pd.DataFrame], pd.DataFrame | None], schema: str, known: DataFrame | None = None) -> DataFrame:
    """step(state, key, date, rows) for every key and date, dates ascending: changes the state, returns rows of `schema`.

    The result has also `state`: at the last date of a key a row with only by, date and state (JSON) set, for a later call to go on from.
    known: by, state of an earlier call. Rows with a null key or date take no part.
    """
    rows = df.where(F.col(by).isNotNull() & F.col(date).isNotNull())
    columns = [c for c in df.columns if c not in (by, date)]
    if known is None:
        rows = rows.withColumn("_state", F.lit(None).cast("string"))
    else:  # a key's state comes as a row before its first date
        first = known.select(by, F.col("state").alias("_state"))
        rows = rows.withColumn("_state", F.lit(None).cast("string")).unionByName(first, allowMissingColumns=True)
    names = [x.strip().split()[0].strip("`") for x in schema.split(",")]
    whole = [c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint") and c in columns]

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, waiting = None, {}, None

        def ended() -> pd.DataFrame:
            row = {by: key[0], date: key[1], "state": json.dumps(state)}
            return pd.DataFrame([[row.get(n) for n in (*names, "state")]], columns=[*names, "state"], dtype=object)

        def told(own: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal key, state
            at = own.iloc[0]
            if key is None or at[by] != key[0]:
                if key is not None and key[1] is not None:
                    yield ended()
                key, state = (at[by], None), {}
            given = own["_state"].dropna()
            if len(given):
                state = json.loads(given.iloc[0])
                own = own[own[date].notna()]
            if len(own):
                key = (key[0], own[date].iloc[0])
                # a null anywhere in a batch turns its whole numbers into floating ones
                own = own[columns].astype({c: "int64" for c in whole if own[c].dtype.kind == "f" and own[c].notna().all()})
                found = step(state, key[0], key[1], own)
                if found is not None and len(found):
                    yield found.assign(**{by: key[0], date: key[1], "state": None})[[*names, "state"]]

        for b in batches:
            if not len(b):
                continue
            b = b if waiting is None else pd.concat([waiting, b], ignore_index=True)
            last = b.iloc[-1]
            tail = (b[by] == last[by]) & ((b[date] == last[date]) | (b[date].isna() & pd.isna(last[date])))
            waiting, b = b[tail], b[~tail]
            for _, own in b.groupby([by, date], sort=False, dropna=False):
                yield from told(own)
        if waiting is not None:
            for _, own in waiting.groupby([by, date], sort=False, dropna=False):
                yield from told(own)
            if key[1] is not None:
                yield ended()

    dealt = rows.repartition(by).sortWithinPartitions(by, F.asc_nulls_first(date), *order)
    return dealt.mapInPandas(folded, f"{schema}, state string")
