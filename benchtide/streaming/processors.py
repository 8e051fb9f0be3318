"""Keyed streaming state for the build bookkeeping.

``BuildFoldProcessor`` (J-1, with the J-3 publish flags) keeps one build per
grouping key, (ref, build id): its state and its number of final events, so
the builds of one busy ref spread over all tasks.  ``LiveCountProcessor`` is
the second step, keyed by ref alone: it only sees a build's beginning and end
and keeps how many builds of the ref are live.  ``DispatchProcessor`` (J-2,
latest-wins) keeps a busy flag and the newest waiting request per key.

Rows of a key inside one micro-batch arrive unordered, so each handler sorts
them by ``(ts, seq)`` first; across micro-batches arrival order rules.  State
can end: with ``retention_ms`` an event-time timer drops a finished build's
record, and a build that never finishes, that long after its last event.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from benchtide.operators.builds import fold_table
from benchtide.operators.decide import DISPATCH_TABLE, IDLE
from benchtide.schemas import BUILD_STATES, FINAL_STATES, PREV_STATE, UPDATE_SUCCESS_STATES

_NAMES = np.array([None] + BUILD_STATES, dtype=object)
_CODES = {s: i for i, s in enumerate(BUILD_STATES)}
_DISPATCHED, _OTHER = len(BUILD_STATES), len(BUILD_STATES) + 1
# per event code: the map over fold states, the state that must precede, its class
_MAPS = np.vstack([fold_table(), np.arange(len(BUILD_STATES) + 1)])
_PREV = np.array([_CODES[PREV_STATE[s]] + 1 if PREV_STATE[s] else -1 for s in BUILD_STATES] + [-1, -1])
_UPDATE = np.array([s in UPDATE_SUCCESS_STATES for s in BUILD_STATES] + [False, False])
_FINAL = np.array([s in FINAL_STATES for s in BUILD_STATES] + [False, False])
_REQUESTING, _REQUESTED = _CODES["REQUESTING"] + 1, _CODES["REQUESTED"] + 1


def _ts_micros(v) -> int:
    return int(pd.Timestamp(v).value // 1000)


def _frame(rows) -> pd.DataFrame:
    frames = list(rows)
    return frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)


def in_order(pdf: pd.DataFrame, ts: str, seq: str) -> pd.DataFrame:
    """Rows by (ts, seq); a null time comes first, as in batch."""
    at = pdf[ts].to_numpy().astype("datetime64[us]").astype(np.int64)
    number = pd.to_numeric(pdf[seq]).to_numpy()
    return pdf.take(np.lexsort((number, at)))


def walk(codes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """States before and after each event: the events' maps composed in
    log2(n) steps, then looked up at the start state."""
    comp = _MAPS[codes]
    step = 1
    while step < len(comp):
        comp[step:] = np.take_along_axis(comp[step:], comp[:-step], axis=1)
        step *= 2
    after = comp[:, start]
    return np.concatenate([[start], after[:-1]]), after


class BuildFoldProcessor(StatefulProcessor):
    """J-1: apply state events to one build; emits one trace row per event.

    A build whose state returns to "none" is kept as a tombstone (state 0,
    finals > 0) so a second final event is flagged ``out_of_order``, as in
    the batch fold; ``keep_tombstones=False`` deletes it at once.

    With ``retention_ms`` the record ends that long after the build's last
    event by the ``clock`` column, the one with the watermark.  A build that is
    still live then gives one row more, ``expired``, with ``state_after`` null.
    A final event of a build without a record counts as ``out_of_order`` if its
    own time is that far behind the watermark: its record may have ended.
    """

    def __init__(self, key_cols, ts, seq, state, keep_tombstones=True, dispatched=None,
                 clock=None, retention_ms=None, columns=()):
        self.key_cols, self.ts, self.seq, self.state = list(key_cols), ts, seq, state
        self.keep_tombstones, self.dispatched = keep_tombstones, dispatched
        self.clock, self.retention_ms, self.columns = clock, retention_ms, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.build = handle.getValueState("build", "state int, finals long, due long")

    def handleInputRows(self, key, rows, timerValues):
        pdf = in_order(_frame(rows), self.ts, self.seq)
        state, finals = (int(v) for v in self.build.get()[:2]) if self.build.exists() else (0, 0)
        known = state != 0 or finals != 0
        codes = pdf[self.state].map(_CODES).fillna(_OTHER).to_numpy().astype(np.int64)
        if self.dispatched:
            codes = np.where(pdf[self.dispatched].fillna(False).to_numpy().astype(bool), _DISPATCHED, codes)
        before, after = walk(codes, state)
        final = _FINAL[codes]
        earlier = finals + np.cumsum(final) - final
        late = np.zeros(len(pdf), bool)
        if self.retention_ms is not None and not known:
            at = pdf[self.ts].to_numpy().astype("datetime64[ms]").astype(np.int64)
            late = at + self.retention_ms <= timerValues.getCurrentWatermarkInMs()
        out = pdf.assign(
            state_before=_NAMES[before], state_after=_NAMES[after],
            accepted=np.where(codes == _DISPATCHED, before <= _REQUESTING,
                              (_UPDATE[codes] | final) & ((before == 0) | (before == _PREV[codes]))),
            publish=final, out_of_order=final & ((earlier > 0) | late))
        state, finals = int(after[-1]), int(finals + final.sum())
        if state == 0 and (finals == 0 or not self.keep_tombstones):
            self.build.clear()
        else:
            due = 0
            if self.retention_ms is not None:
                last = pdf[self.clock].max()
                due = max(timerValues.getCurrentWatermarkInMs() + 1,
                          int(pd.Timestamp(last).value // 10 ** 6) + self.retention_ms)
                self.handle.registerTimer(due)
            self.build.update((state, finals, due))
        if self.retention_ms is not None:
            out["expired"] = False
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.build.exists():
            return
        state, _, due = self.build.get()
        if due > expiredTimerInfo.getExpiryTimeInMs():
            return      # a later event has put the end off
        self.build.clear()
        if state == 0:
            return
        row = dict.fromkeys(self.columns)
        row.update(zip(self.key_cols, key))
        now = pd.Timestamp(timerValues.getCurrentWatermarkInMs() + 1, unit="ms")
        row.update({self.ts: now, self.clock: now, "state_before": _NAMES[state], "state_after": None,
                    "accepted": False, "publish": False, "out_of_order": False, "expired": True})
        yield pd.DataFrame([row])

    def close(self) -> None:
        pass


class LiveCountProcessor(StatefulProcessor):
    """Builds of a ref that are live, after each beginning (+1) or end (-1)."""

    def __init__(self, ts, seq):
        self.ts, self.seq = ts, seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getValueState("live", "n long")

    def handleInputRows(self, key, rows, timerValues):
        pdf = in_order(_frame(rows), self.ts, self.seq)
        before = int(self.live.get()[0]) if self.live.exists() else 0
        step = pdf["state_after"].notna().astype(int) - pdf["state_before"].notna().astype(int)
        live = before + step.to_numpy().cumsum()
        if live[-1]:
            self.live.update((int(live[-1]),))
        else:
            self.live.clear()
        yield pdf.assign(live=live)

    def close(self) -> None:
        pass


class DispatchProcessor(StatefulProcessor):
    """J-2 latest-wins: emits a decision row when a request's fate is known:
    ``dispatch`` on arrival, ``dispatch_backlog`` at the completion that
    starts it, ``drop`` when a newer request replaces it (or it is older
    than the waiting one).  A request still waiting is not emitted."""

    def __init__(self, key_cols, ts, seq, kind):
        self.key_cols, self.ts, self.seq, self.kind = list(key_cols), ts, seq, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.busy = handle.getValueState("busy", "state int")
        self.pending = handle.getValueState("pending", "ts_us long, seq long")

    def handleInputRows(self, key, rows, timerValues):
        pdf = in_order(_frame(rows), self.ts, self.seq)
        state = self.busy.get()[0] if self.busy.exists() else IDLE
        pend = tuple(self.pending.get()) if self.pending.exists() else None
        out_seq, out_ts, out_action, out_at = [], [], [], []

        def emit(seq_v, ts_us, action, at_us):
            out_seq.append(seq_v)
            out_ts.append(ts_us)
            out_action.append(action)
            out_at.append(at_us)

        for ts_v, seq_v, kind in zip(pdf[self.ts], pdf[self.seq], pdf[self.kind]):
            t = _ts_micros(ts_v)
            if kind == "request":
                if state == IDLE:
                    emit(int(seq_v), t, "dispatch", t)
                elif pend is None or t > pend[0]:
                    if pend is not None:
                        emit(pend[1], pend[0], "drop", None)
                    pend = (t, int(seq_v))
                else:
                    emit(int(seq_v), t, "drop", None)
                state = DISPATCH_TABLE[0][state]
            elif kind == "completion":
                if pend is not None:
                    emit(pend[1], pend[0], "dispatch_backlog", t)
                    pend = None
                state = DISPATCH_TABLE[1][state]
        self.busy.update((int(state),))
        if pend is None:
            self.pending.clear()
        else:
            self.pending.update(pend)
        if out_seq:
            to_ts = lambda v: pd.NaT if v is None else pd.Timestamp(v, unit="us")
            out = pd.DataFrame({
                **{k: [v] * len(out_seq) for k, v in zip(self.key_cols, key)},
                self.seq: pd.Series(out_seq, dtype="int64"),
                self.ts: [pd.Timestamp(v, unit="us") for v in out_ts],
                "action": out_action,
                "dispatched_at": [to_ts(v) for v in out_at],
            })
            yield out

    def close(self) -> None:
        pass


class OrchestratorProcessor(StatefulProcessor):
    """J-1 and J-2 together, per ref, as one keyed state machine.

    Input rows have ``kind`` 'request' (a build request with its id) or
    'state' (a build-state event for a build id).  State per ref: the
    recorded builds (id -> state, finals), how many are live, and the one
    waiting request.  A request is sent at once when no build of the ref is
    live (mode 'all': always); otherwise only the newest waiting request is
    kept.  After a final event, when the ref has become idle, the waiting
    request is sent.  Sent requests are recorded as REQUESTED builds.

    Emits one row per state event (fold trace) and one per request once its
    fate is known (dispatch / dispatch_backlog / drop).  A decision depends on
    every earlier row of the ref, so this step is sequential per ref.

    With ``retention_ms`` the builds of a batch are forgotten that long after
    its latest ``clock``, unless later rows named them again.  A live one that
    ends so frees the ref: its waiting request is sent then.
    """

    def __init__(self, key_cols, id_col, ts, seq, kind, state, mode="latest", clock=None, retention_ms=None):
        self.key_cols = list(key_cols)
        self.id_col, self.ts, self.seq, self.kind, self.state = id_col, ts, seq, kind, state
        self.mode, self.clock, self.retention_ms = mode, clock, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.builds = handle.getMapState("builds", "id string", "state int, finals long, due long")
        self.live = handle.getValueState("live", "n long")
        self.pending = handle.getValueState("pending", "id string, ts_us long, seq long")

    # a null id is no text: it must not meet the build named "None"
    @staticmethod
    def _entry(bid):
        return ("s" + bid if bid is not None else "n",)

    def _load(self) -> None:
        self.n_live = int(self.live.get()[0]) if self.live.exists() else 0
        self.wait = tuple(self.pending.get()) if self.pending.exists() else None
        self.cache, self.out = {}, []

    def _get(self, bid):
        if bid not in self.cache:
            entry = self._entry(bid)
            v = self.builds.getValue(entry) if self.builds.containsKey(entry) else None
            self.cache[bid] = (int(v[0]), int(v[1])) if v is not None else (0, 0)
        return self.cache[bid]

    def _put(self, bid, state, finals):
        self.n_live += int(state != 0) - int(self._get(bid)[0] != 0)
        self.cache[bid] = (state, finals)

    def _decide(self, bid, ts_us, seq, action, at_us=None):
        if at_us is not None:
            cur, finals = self._get(bid)
            if cur in (0, _REQUESTING):
                self._put(bid, _REQUESTED, finals)
        self.out.append((bid, ts_us, seq, "request", None, action, at_us) + (None,) * 5)

    def _release(self, at_us):
        if self.wait is not None and self.n_live == 0:
            self._decide(*self.wait, "dispatch_backlog", at_us)
            self.wait = None

    def _save(self, due):
        for bid, (state, finals) in self.cache.items():
            entry = self._entry(bid)
            if state == 0 and finals == 0:
                if self.builds.containsKey(entry):
                    self.builds.removeKey(entry)
            else:
                self.builds.updateValue(entry, (int(state), int(finals), int(due)))
        if due and self.cache:
            self.handle.registerTimer(due)
        self.live.update((int(self.n_live),))
        if self.wait is None:
            self.pending.clear()
        else:
            self.pending.update(self.wait)

    def _rows(self, key):
        if not self.out:
            return
        cols = [self.id_col, self.ts, self.seq, self.kind, self.state, "action", "dispatched_at",
                "state_before", "state_after", "accepted", "publish", "out_of_order"]
        frame = pd.DataFrame(self.out, columns=cols)
        frame[self.ts] = pd.to_datetime(frame[self.ts], unit="us")
        frame["dispatched_at"] = pd.to_datetime(frame["dispatched_at"], unit="us")
        for i, (k, v) in enumerate(zip(self.key_cols, key)):
            frame.insert(i, k, v)
        yield frame

    def handleInputRows(self, key, rows, timerValues):
        pdf = in_order(_frame(rows), self.ts, self.seq)
        codes = pdf[self.state].map(_CODES).fillna(_OTHER).to_numpy().astype(np.int64)
        at = pdf[self.ts].to_numpy().astype("datetime64[us]").astype(np.int64).tolist()
        self._load()
        for bid, t, seq, kind, state, code in zip(pdf[self.id_col], at, pdf[self.seq], pdf[self.kind],
                                                  pdf[self.state], codes.tolist()):
            bid, seq = None if pd.isna(bid) else str(bid), int(seq)
            if kind == "request":
                if self.mode == "all" or self.n_live == 0:
                    self._decide(bid, t, seq, "dispatch", t)
                elif self.wait is None or t > self.wait[1]:
                    if self.wait is not None:
                        self._decide(*self.wait, "drop")
                    self.wait = (bid, t, seq)
                else:
                    self._decide(bid, t, seq, "drop")
            elif kind == "state":
                before, finals = self._get(bid)
                after, final = int(_MAPS[code, before]), bool(_FINAL[code])
                accepted = bool((_UPDATE[code] or final) and (before == 0 or before == _PREV[code]))
                self._put(bid, after, finals + int(final))
                self.out.append((bid, t, seq, "state", state, None, None, _NAMES[before], _NAMES[after],
                                 accepted, final, final and finals > 0))
                if final:
                    self._release(t)
        due = 0
        if self.retention_ms is not None:
            due = max(timerValues.getCurrentWatermarkInMs() + 1,
                      int(pd.Timestamp(pdf[self.clock].max()).value // 10 ** 6) + self.retention_ms)
        self._save(due)
        yield from self._rows(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        self._load()
        ended = [(entry[0], v) for entry, v in self.builds.iterator() if v[2] <= now]
        for name, v in ended:
            bid = name[1:] if name[0] == "s" else None
            self.cache[bid] = (int(v[0]), int(v[1]))
            self._put(bid, 0, 0)
        self._release(now * 1000)
        self._save(timerValues.getCurrentWatermarkInMs() + self.retention_ms)
        yield from self._rows(key)

    def close(self) -> None:
        pass
