"""Sliding-window rate limit as an ordered fold of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accepted(requests: DataFrame, window: float, most: int) -> DataFrame:
    """(key, id, at) -> the same with ``accepted``: fewer than ``most`` accepted requests lie in the ``window`` seconds before.

    The fold's state is the last ``most`` accepted times, whatever a key's history; a key's
    requests are sorted by Spark and stream through one task.
    """
    import pandas as pd

    rows = requests.repartition("key").sortWithinPartitions("key", "at", "id")

    def run(batches):
        state: dict = {}
        for pdf in batches:
            verdicts = []
            for key, at in zip(pdf["key"], pdf["at"], strict=True):
                if key not in state:
                    state = {key: []}  # keys come one after another
                kept = [t for t in state[key] if t > at - window]
                ok = len(kept) < most
                state[key] = [*kept, at] if ok else kept
                verdicts.append(ok)
            yield pd.DataFrame({"key": pdf["key"], "id": pdf["id"], "accepted": verdicts})

    return rows.mapInPandas(run, "key long, id long, accepted boolean")
