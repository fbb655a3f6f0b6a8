"""Chaining of anchors that arrive over time, by order of arrival or by event time.

``chain_scores_online``: a chain's state is its last ``lookback`` anchors with their scores. Within a trigger a chain's anchors are sorted;
an anchor that comes in a later trigger than one of a greater idx is scored after it, by order of arrival. With
``idle_ms``, chains without anchors for that long are forgotten, and start anew if they come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plaitwork.operators._workers import prepare
from plaitwork.operators.chain import scored_runs


def chain_scores_online(anchors: DataFrame, lookback: int, idle_ms: int | None = None) -> DataFrame:
    """A streaming (chain_id long, idx long, x long, y long) with score, in append mode."""
    if lookback < 1:
        raise ValueError("lookback is 1 or more")
    prepare(anchors.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        got = pd.concat(batches).sort_values(["idx", "x", "y"])
        carry = None
        if state.exists:
            x, y, there, score = state.get
            carry = (0, np.array(x, np.int64), np.array(y, np.int64), np.array(there, bool), np.array(score, np.int64))
        there = (got["x"].notna() & got["y"].notna()).to_numpy(bool)
        whole = lambda c: got[c].astype("Int64").fillna(0).to_numpy(np.int64)
        score, carry = scored_runs(np.zeros(len(got), np.int64), whole("x"), whole("y"), there, carry, lookback)
        state.update(([*map(int, carry[1])], [*map(int, carry[2])], [*map(bool, carry[3])], [*map(int, carry[4])]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"chain_id": key[0], "idx": got["idx"], "x": got["x"], "y": got["y"], "score": score.astype(np.int32)})

    return anchors.groupBy("chain_id").applyInPandasWithState(
        step,
        "chain_id long, idx long, x long, y long, score int",
        "x array<long>, y array<long>, there array<boolean>, score array<long>",
        "append",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def chain_scores_in_order(anchors: DataFrame, lookback: int, delay: str, idle_ms: int | None = None) -> DataFrame:
    """A streaming (chain_id long, at timestamp, idx long, x long, y long) with score, each chain's in order of (at, idx, x, y), in append mode.

    Anchors may come ``delay`` late: they wait until the watermark, which is that far behind the latest, has passed them, and are then scored in order,
    so the scores are those of ``chain_scores`` whatever the order of arrival. Later ones are dropped by the watermark. A chain's state
    is what waits and its last ``lookback`` anchors; with ``idle_ms``, chains that have had no anchor for that long by the watermark are
    forgotten, and start anew. Rows without a time never pass a watermark and are left out. Needs the RocksDB state store:
    spark.sql.streaming.stateStore.providerClass.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    if lookback < 1:
        raise ValueError("lookback is 1 or more")
    prepare(anchors.sparkSession)
    wanted = ["chain_id", "at", "idx", "x", "y", "score"]

    class Chains(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "ms long, at timestamp, idx long, x long, y long")
            self.last = handle.getListState("last", "x long, y long, there boolean, score long")
            self.timer = handle.getValueState("timer", "ms long")

        def _wake(self, ms: int) -> None:
            """One timer a chain, at the least time that something waits for."""
            known = self.timer.get()[0] if self.timer.exists() else None
            if known is None or ms < known:
                if known is not None:
                    self.handle.deleteTimer(known)
                self.handle.registerTimer(ms)
                self.timer.update((ms,))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            least = None
            for got in rows:
                whole = lambda c: [None if pd.isna(v) else int(v) for v in got[c]]  # noqa: B023, E731
                ms = [int(pd.Timestamp(t).value // 1_000_000) for t in got["at"]]
                self.waiting.appendList([*zip(ms, (pd.Timestamp(t).to_pydatetime() for t in got["at"]), whole("idx"), whole("x"), whole("y"), strict=True)])
                least = min(ms) if least is None else min(least, *ms)
            if least is not None:
                self._wake(least)
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            mark = timerValues.getCurrentWatermarkInMs()
            held = [*self.waiting.get()] if self.waiting.exists() else []
            now, later = [r for r in held if r[0] <= mark], [r for r in held if r[0] > mark]
            self.timer.clear()
            if not held:  # nothing came since the last anchors were scored: the chain is idle
                self.last.clear()
                return
            # Nulls come first, as in a batch.
            now.sort(key=lambda r: (r[1], *((v is not None, v or 0) for v in r[2:])))
            carry = None
            if self.last.exists():
                x, y, there, score = (np.array(v) for v in zip(*self.last.get(), strict=True))
                carry = (0, x.astype(np.int64), y.astype(np.int64), there.astype(bool), score.astype(np.int64))
            x, y = (np.array([0 if r[k] is None else r[k] for r in now], np.int64) for k in (3, 4))
            there = np.array([r[3] is not None and r[4] is not None for r in now], bool)
            score, carry = scored_runs(np.zeros(len(now), np.int64), x, y, there, carry, lookback)
            if carry is not None:
                self.last.put([(int(a), int(b), bool(c), int(d)) for a, b, c, d in zip(*carry[1:], strict=True)])
            if later:
                self.waiting.put(later)
                self._wake(min(r[0] for r in later))
            else:
                self.waiting.clear()
                if idle_ms is not None:
                    self._wake(now[-1][0] + idle_ms)
            if now:
                columns = [[key[0]] * len(now), [r[1] for r in now], *([r[k] for r in now] for k in (2, 3, 4)), score.astype(np.int32)]
                out = pd.DataFrame(dict(zip(wanted, columns, strict=True)))
                yield out.astype({c: "Int64" for c in ("idx", "x", "y")})

        def close(self) -> None:
            pass

    marked = anchors.select("chain_id", "at", "idx", "x", "y").where("at is not null").withWatermark("at", delay)
    schema = "chain_id long, at timestamp, idx long, x long, y long, score int"
    return marked.groupBy("chain_id").transformWithStateInPandas(Chains(), schema, "Append", "EventTime")
