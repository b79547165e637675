"""The review queue as a stream: decisions fold into items by a state per item, in the order in which they come."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmark.operators.review import Item

OUTPUT = "item_id string, seq long, status string, result string, reviewer string, corrected_value string"
STATE = "item string"


def _apply(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    item = Item(**json.loads(state.get[0])) if state.exists else Item()
    rows = pd.concat(list(parts)).sort_values("seq")
    out = []
    for r in rows.itertuples():
        if not state.exists and item.status == "pending" and not item.approvals and r.required_approvals:
            item.required = int(r.required_approvals)
        result = item.decide(r.decision, r.reviewer, r.value)
        out.append((key[0], r.seq, item.status, result, item.reviewer, item.entered))
    state.update((json.dumps(item.__dict__),))
    yield pd.DataFrame(out, columns=["item_id", "seq", "status", "result", "reviewer", "corrected_value"])


def apply_decisions(decisions: DataFrame) -> DataFrame:
    """A stream (item_id, seq, decision, reviewer, value, required_approvals) -> what each decision came to.

    Decisions of one micro-batch go by seq; later ones find the state they meet. One that comes after an item is closed is
    refused as already_decided."""
    return decisions.groupBy("item_id").applyInPandasWithState(_apply, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type in tumbling windows; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
