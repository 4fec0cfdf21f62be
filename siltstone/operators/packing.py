"""Next-fit packing: a record opens a sector when it does not fit the current one.

The rule is a fold over a series.  It is split three times, so that no task sees a series: chunks of the order column tell what they do
to any level they may start at, groups of chunks compose that, the groups of a series are folded in order, and each group and
then each chunk is worked out from its known start.

What a chunk does depends on its start only through the first record that does not fit: from there on it opens sectors as any other
would.  So a summary holds one entry for each record that the first sector may still take, not one for each level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import CHUNK

#: Chunks that a group composes.
GROUP = 512


class Steps:
    """What a run of records does to a fill level: for levels up to each `upper`, how many sectors are opened and the level left.

    Where none is opened, the level rises by `total`.
    """

    def __init__(self, upper: np.ndarray, opened: np.ndarray, level: np.ndarray, total: int):
        self.upper, self.opened, self.level, self.total = upper, opened, level, total

    def __call__(self, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.upper, fill, side="left")
        return self.opened[at], np.where(self.opened[at] == 0, fill + self.total, self.level[at])

    def then(self, other: Steps) -> Steps:
        """This run and then the other.  Only starts that this run leaves in their sector meet the other at different levels."""
        cuts = other.upper - self.total
        cuts = cuts[(cuts >= 0) & (cuts < self.upper[0])] if self.opened[0] == 0 else cuts[:0]
        upper = np.concatenate([cuts, self.upper])
        opened, level = self(upper)
        more, level = other(level)
        return Steps(upper, opened + more, level, self.total + other.total)

    def pack(self) -> bytes:
        return np.concatenate([[self.total], self.upper, self.opened, self.level]).astype(np.int64).tobytes()

    @staticmethod
    def unpack(raw: bytes) -> Steps:
        total, rest = np.split(np.frombuffer(raw, np.int64), [1])
        return Steps(*np.split(rest, 3), int(total[0]))


def hops(sizes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums, and for each record the first that no longer fits a sector that it opens."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return upto, np.searchsorted(upto, upto[:-1] + cap, side="right") - 1


def steps_of(sizes: np.ndarray, cap: int) -> Steps:
    upto, following = hops(sizes, cap)
    n, total = len(sizes), int(upto[-1])
    # each record that may be the first not to fit, from the last such one to the first; the chain of sectors from there
    first = np.arange(min(int(np.searchsorted(upto, cap, side="right")) - 1, n - 1), -1, -1)
    opened, at = np.ones(len(first), np.int64), first.copy()
    while (on := following[at] < n).any():
        at, opened = np.where(on, following[at], at), opened + on
    upper, level = cap - upto[first], total - upto[at]
    if total <= cap:
        upper, opened, level = (np.concatenate([[x], y]) for x, y in ((cap - total, upper), (0, opened), (0, level)))
    return Steps(upper, opened, level, total)


def place_from(sizes: np.ndarray, cap: int, sector: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Sector and offset (from the sector's first byte for records) of each record: a hop for each sector."""
    upto, following = hops(sizes, cap)
    opens = []
    at = int(np.searchsorted(upto, cap - fill, side="right")) - 1
    while at < len(sizes):
        opens.append(at)
        at = int(following[at])
    opens = np.array(opens, np.int64)
    run = np.searchsorted(opens, np.arange(len(sizes)), side="right")
    base = np.concatenate([[-fill], upto[opens]])
    return sector + run, upto[:-1] - base[run]


def next_fit(log: DataFrame, order: str, size: str, cap: int, start: int, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """Adds sector and offset to log (series, epoch, ...) in ascending `order`; each epoch begins in a new sector, an empty one included."""
    keys = ["series", "epoch", "_g", "_c"]
    log = log.withColumn("_c", F.expr(f"`{order}` div {chunk}")).withColumn("_g", F.expr(f"_c div {group}"))
    named = lambda pdf, names: {k: [pdf[k].iloc[0]] for k in names}

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values(order, kind="stable")[size].to_numpy(np.int64)
        return pd.DataFrame(named(pdf, keys) | {"steps": [steps_of(sizes, cap).pack()]})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for raw in pdf.sort_values("_c")["steps"]:
            one = Steps.unpack(raw)
            whole = one if whole is None else whole.then(one)
        return pd.DataFrame(named(pdf, keys[:3]) | {"steps": [whole.pack()]})

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        sector, fill, out, epoch = 0, 0, [], 0
        for row in pdf.sort_values(["epoch", "_g"]).itertuples(index=False):
            if row.epoch != epoch:
                sector, fill, epoch = sector + int(row.epoch) - int(epoch), 0, row.epoch
            out.append((row.series, row.epoch, row[2], sector, fill))
            opened, level = Steps.unpack(row.steps)(np.array([fill]))
            sector, fill = sector + int(opened[0]), int(level[0])
        return pd.DataFrame(out, columns=["series", "epoch", "_g", "_sector", "_fill"])

    def unfold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sector, fill, out = int(right["_sector"].iloc[0]), int(right["_fill"].iloc[0]), []
        for row in left.sort_values("_c").itertuples(index=False):
            out.append((row.series, row.epoch, row[2], row[3], sector, fill))
            opened, level = Steps.unpack(row.steps)(np.array([fill]))
            sector, fill = sector + int(opened[0]), int(level[0])
        return pd.DataFrame(out, columns=[*keys, "_sector", "_fill"])

    def lay(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(order, kind="stable")
        sector, offset = place_from(left[size].to_numpy(np.int64), cap, int(right["_sector"].iloc[0]), int(right["_fill"].iloc[0]))
        return pd.DataFrame({"series": left["series"], order: left[order], "sector": sector, "offset": start + offset})

    at = "series string, epoch int, _g long"
    narrow = log.select(*keys, order, size)
    chunks = narrow.groupBy(*keys).applyInPandas(summary, f"{at}, _c long, steps binary")
    groups = chunks.groupBy(*keys[:3]).applyInPandas(compose, f"{at}, steps binary")
    starts = groups.groupBy("series").applyInPandas(fold, f"{at}, _sector long, _fill long")
    each = chunks.groupBy(*keys[:3]).cogroup(starts.groupBy(*keys[:3])).applyInPandas(unfold, f"{at}, _c long, _sector long, _fill long")
    places = narrow.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInPandas(lay, f"series string, `{order}` long, sector long, `offset` long")
    return log.drop("_c", "_g").join(places, ["series", order])
