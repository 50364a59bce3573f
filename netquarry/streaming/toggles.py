"""An extension: toggles counted on a stream of value changes, the state being the last known level and count of each net."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

KNOWN = {"0": 0, "l": 0, "L": 0, "1": 1, "h": 1, "H": 1}


def toggle_stream(changes: DataFrame) -> DataFrame:
    """A streaming frame (net, seq, value) -> net, n_toggles after each batch that has changes of the net.

    Within a batch changes are taken in the order of seq; a change that comes in a later batch counts as later."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for v in rows["value"]:
            level = KNOWN.get(v)
            if level is None:
                continue
            n += last not in (-1, level)
            last = level
        state.update((last, n))
        yield pd.DataFrame({"net": [key[0]], "n_toggles": [n]})

    return changes.groupBy("net").applyInPandasWithState(step, "net string, n_toggles long", "last int, n long", "update", "NoTimeout")
