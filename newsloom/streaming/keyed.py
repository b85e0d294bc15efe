"""State per key, kept by Spark between micro-batches: rejections, story anchors, known versions, last digests.

Every processor reads one key's rows of one micro-batch and that key's state, never an earlier batch.  Its order is the order of
processing: batch by batch, and by (t, id) inside a batch.  Times are event times, so the result does not depend on when a job
runs: a timer clears state once the watermark shows that no row can arrive any more that would need it, hence clearing never
changes a result.  A row older than the watermark is dropped by Spark (the late-data rule).

Rejections and versions have as many keys as there are users or entries, and a state call per key costs more than its rows.  Their
processors therefore serve a bucket of keys at a time (jobs.py): its memory is one packed table, read and written once per
micro-batch and worked on by columns.  Whatever is forgotten is forgotten at its own time, not at its bucket's.

The rows of one key, or bucket, in one micro-batch are held together; the size of a batch (files per trigger) bounds them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICROS_A_DAY = 86_400_000_000


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), ignore_index=True)


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(states: Iterable[tuple], schema: pa.Schema) -> pa.Table:
    """Packed tables of a state, one after the other."""
    return pa.concat_tables([schema.empty_table(), *[pa.ipc.open_stream(bytes(blob)).read_all() for (blob,) in states]])


class _Expiring(StatefulProcessor):
    """A processor with one timer per key or bucket, at the time when its oldest state has done its work."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = self.open(handle)

    def wake_after(self, micros: int | None) -> None:
        """The only timer: the first millisecond after ``micros``."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if micros is not None:
            self.handle.registerTimer(int(micros) // 1000 + 1)

    def close(self) -> None:
        pass


class RejectionMemory(_Expiring):
    """Rows (key, t, id, rejected) of some entry ids to the ids that pass.

    An entry is held back if its key was turned down at most ``days`` days before the entry's own day; the last of these days
    still counts.  Held entries do not prolong the memory.
    """

    SCHEMA = pa.schema([("key", pa.string()), ("day", pa.int64())])

    def __init__(self, days: int) -> None:
        self.days = days

    def open(self, handle: StatefulProcessorHandle):
        return handle.getValueState("rejected", "days binary")

    def _keep(self, memory: dict) -> None:
        """Remember these days and wake when the first of them has done its work."""
        if not memory:
            self.state.clear()
            return
        self.state.update((_packed(pa.table([list(memory), list(memory.values())], schema=self.SCHEMA)),))
        self.wake_after((min(memory.values()) + self.days + 1) * MICROS_A_DAY - 1)

    def _memory(self) -> dict:
        known = _unpacked([self.state.get()] if self.state.exists() else [], self.SCHEMA)
        return dict(zip(known["key"].to_pylist(), known["day"].to_pylist(), strict=True))

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True)
        code, keys = pd.factorize(batch["key"], use_na_sentinel=False)
        batch = batch.assign(code=code).sort_values(["code", "t", "id"], ignore_index=True)
        day = (batch["t"] // MICROS_A_DAY).to_numpy()
        rejected = batch["rejected"].fillna(False).to_numpy(dtype=bool)
        bounds = np.searchsorted(batch["code"].to_numpy(), np.arange(len(keys) + 1))
        memory, passed = self._memory(), np.zeros(len(batch), bool)
        for n, own in enumerate(keys):
            own = None if pd.isna(own) else own
            a, b = bounds[n], bounds[n + 1]
            last = self._pass(memory.get(own), day[a:b], rejected[a:b], passed[a:b])
            if last is not None:
                memory[own] = last
        if memory:
            self._keep(memory)
        yield pd.DataFrame({"id": batch["id"][passed]})

    def _pass(self, memory: int | None, day: np.ndarray, rejected: np.ndarray, passed: np.ndarray) -> int | None:
        """Mark the rows of one key that pass, and return the day it was last turned down."""
        turned, at = np.flatnonzero(rejected), 0
        while at < len(day):
            if memory is not None:
                at = max(at, int(np.searchsorted(day, memory + self.days, "right")))
            following = turned[np.searchsorted(turned, at) :]
            stop = int(following[0]) if len(following) else len(day)
            passed[at:stop] = True
            if stop < len(day):
                memory = int(day[stop])
            at = stop + 1
        return memory

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self._keep({k: day for k, day in self._memory().items() if (day + self.days + 1) * MICROS_A_DAY - 1 >= passed})
        yield pd.DataFrame({"id": pd.Series([], dtype="int64")})


class StoryAnchors(_Expiring):
    """Rows (t, id) of one headline to (id, story): the id of the anchor whose story they belong to.

    Cards first join the earliest anchor of earlier batches within ``window`` microseconds on either side; the others form new
    stories: the first card is an anchor, and holds all cards up to ``window`` after it.  An anchor never moves.
    """

    def __init__(self, window: int) -> None:
        self.window = window

    def open(self, handle: StatefulProcessorHandle):
        return handle.getListState("anchors", "t long, id long")

    def handleInputRows(self, key, rows, timerValues):
        batch = _in_order(rows, "t", "id")
        t, ids = batch["t"].to_numpy(), batch["id"].to_numpy()
        anchors = sorted(tuple(a) for a in self.state.get())
        story = np.full(len(batch), -1, np.int64)
        open_ = np.ones(len(batch), bool)
        if anchors:
            at = np.array([a[0] for a in anchors])
            first = np.searchsorted(at, t - self.window)
            hit = (first < len(at)) & (at[np.minimum(first, len(at) - 1)] <= t + self.window)
            story[hit] = np.array([a[1] for a in anchors])[first[hit]]
            open_ = ~hit
        rest = np.flatnonzero(open_)
        new, begin = [], 0
        while begin < len(rest):
            anchor = rest[begin]
            end = int(np.searchsorted(t[rest], t[anchor] + self.window, "right"))
            story[rest[begin:end]] = ids[anchor]
            new.append((int(t[anchor]), int(ids[anchor])))
            begin = end
        if new:
            self.state.appendList(new)
        self.wake_after(min(a[0] for a in [*anchors, *new]) + self.window)
        yield pd.DataFrame({"id": ids, "story": story})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        left = [tuple(a) for a in self.state.get() if a[0] + self.window >= passed]
        if left:
            self.state.put(left)
            self.wake_after(min(a[0] for a in left) + self.window)
        else:
            self.state.clear()
        yield pd.DataFrame({"id": pd.Series([], dtype="int64"), "story": pd.Series([], dtype="int64")})


class VersionMemory(_Expiring):
    """Rows (entry_id, t, id, fingerprint) of some entries to their unseen versions: id, fingerprint, t, revision_of.

    Of equal versions in a batch the newest stays (ties: the smallest id).  ``revision_of`` is the entry's newest version of
    earlier batches (ties: the largest id).  Versions are forgotten ``days`` days after they were observed.
    """

    SCHEMA = pa.schema([("entry_id", pa.string()), ("fingerprint", pa.string()), ("t", pa.int64()), ("id", pa.int64())])

    def __init__(self, days: int) -> None:
        self.days = days

    def open(self, handle: StatefulProcessorHandle):
        return handle.getListState("versions", "rows binary")

    def _known(self) -> pd.DataFrame:
        return _unpacked(self.state.get(), self.SCHEMA).to_pandas()

    def _as_known(self, rows: pd.DataFrame) -> pa.Table:
        return pa.Table.from_pandas(rows[self.SCHEMA.names], self.SCHEMA, preserve_index=False)

    def handleInputRows(self, key, rows, timerValues):
        batch = self._as_known(pd.concat(list(rows), ignore_index=True)).to_pandas().sort_values(["t", "id"], ascending=[False, True])
        batch = batch[~batch.duplicated(["entry_id", "fingerprint"])]
        known = self._known()
        latest = known.sort_values(["t", "id"]).drop_duplicates("entry_id", keep="last")[["entry_id", "id"]].astype({"id": "Int64"})
        new = batch.merge(known[["entry_id", "fingerprint"]].assign(seen=1), "left", ["entry_id", "fingerprint"])
        new = new[new["seen"].isna()].merge(latest.rename(columns={"id": "revision_of"}), "left", "entry_id").sort_values(["t", "id"], ignore_index=True)
        if len(new):
            self.state.appendValue((_packed(self._as_known(new)),))
        self.wake_after(min([*known["t"], *new["t"]]) + self.days * MICROS_A_DAY)
        yield new[["id", "fingerprint", "t", "revision_of"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        known = self._known()
        left = known[known["t"] + self.days * MICROS_A_DAY >= passed]
        if len(left):
            self.state.put([(_packed(self._as_known(left)),)])
            self.wake_after(int(left["t"].min()) + self.days * MICROS_A_DAY)
        else:
            self.state.clear()
        yield pd.DataFrame({"id": pd.Series([], dtype="int64"), "fingerprint": pd.Series([], dtype="str"), "t": pd.Series([], dtype="int64"), "revision_of": pd.Series([], dtype="Int64")})


class LastDigest(StatefulProcessor):
    """Rows (seq, digest) of one article to seq, digest, outcome and the digest before: new, changed, duplicate or invalid.

    A row without digest is invalid and leaves the state alone.  One digest per article is kept for good.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "digest string")

    def handleInputRows(self, key, rows, timerValues):
        batch = _in_order(rows, "seq", "digest")
        valid = batch["digest"].notna() & (key[0] is not None)
        before = self.last.get()[0] if self.last.exists() else None
        filled = batch["digest"].where(valid).infer_objects(copy=False).ffill().shift(1)
        filled = filled.where(filled.notna(), before)
        outcome = np.where(~valid, "invalid", np.where(filled.isna(), "new", np.where(filled == batch["digest"], "duplicate", "changed")))
        if valid.any():
            self.last.update((batch["digest"][valid].iloc[-1],))
        yield pd.DataFrame({"article_id": [key[0]] * len(batch), "seq": batch["seq"], "digest": batch["digest"], "outcome": outcome, "previous": filled.astype(object).where(filled.notna(), None)})

    def close(self) -> None:
        pass
