"""Live sessions as keyed state: operations in, a changelog of records out.

An operation has ``session, pos, event_id, op, key, kind, text, offset, complete``:

* ``upsert`` replaces a key's value; a value equal to the one held says nothing;
* ``append`` continues a key's text.  With ``offset`` (UTF-16 code units) what overlaps
  must agree and nothing may be left out: a missing start, a gap or a conflict breaks
  the session off.  Without ``offset`` it is joined on, and a missing start is a gap;
* ``remove`` takes a key away, ``reset`` all keys (the next generation begins, also
  after a break), ``end`` ends the observation.

``pos`` orders a session; an operation at or before the last one seen, or with an
``event_id`` seen before, is a second delivery and says nothing; a session remembers its
last ``SEEN`` ids.  A session shows at most ``limit`` keys; the oldest goes first, as a
``remove`` with a reason.

Records have ``session, seq, generation, type, key, kind, text, complete, gap, truncated,
reason``; ``seq`` numbers them from 1.  Each operation gives its records on its own, so
however a session is cut into batches, the records are the same; only the ``checkpoint``
that closes each session's part of a batch (with the last ``seq`` and in ``reason`` the
last ``pos``) depends on the cut.  :func:`follow` keeps the state between batches of a
stream, :func:`replay` does the same for a finished table.

Defined results: a null session is a session; operations without a ``pos``, of an unknown
kind, or on a null key (but ``reset`` and ``end``) are left out; a null text is no text
for an upsert and empty for an append; equal places are ordered by their other columns;
more columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import MapState

OPERATIONS = ("upsert", "append", "remove", "reset", "end")
COLUMNS = ("pos", "event_id", "op", "key", "kind", "text", "offset", "complete")
RECORDS = "session string, seq long, generation long, type string, key string, kind string, text string, complete boolean, gap boolean, truncated boolean, reason string"
NAMES = [c.split()[0] for c in RECORDS.split(", ")]
LIMIT = 200
#: Ids that a session remembers.
SEEN = 4096
#: Longest text of a key.
LONGEST = 1 << 20


@dataclass
class Shown:
    """What a key shows; ``seq`` is the record that first showed it."""

    seq: int
    kind: str | None
    text: str | None
    complete: bool | None


@dataclass
class Session:
    """One session's counters; the keys it shows are held beside them."""

    seq: int = 0
    generation: int = 1
    pos: int = -1
    gap: bool = False
    truncated: bool = False
    broken: bool = False
    ended: bool = False
    noted: int = 0
    shown: dict[str, Shown] = field(default_factory=dict)

    def record(self, what: str, **more: object) -> dict:
        self.seq += 1
        return {"seq": self.seq, "generation": self.generation, "type": what, "gap": self.gap, "truncated": self.truncated, **more}

    def fail(self, key: str, reason: str) -> list[dict]:
        self.gap = self.broken = True
        return [self.record("error", key=key, reason=reason)]

    def put(self, key: str, kind: str | None, text: str | None, complete: bool | None, limit: int) -> list[dict]:
        old = self.shown.get(key)
        if text is not None and len(text) > LONGEST:
            return self.fail(key, "text_limit")
        if old and (old.kind, old.text, old.complete) == (kind, text, complete):
            return []
        out = [self.record("upsert", key=key, kind=kind, text=text, complete=complete)]
        self.shown[key] = Shown(old.seq if old else self.seq, kind, text, complete)
        while len(self.shown) > limit:
            oldest = min(self.shown, key=lambda k: self.shown[k].seq)
            del self.shown[oldest]
            self.truncated = True
            out.append(self.record("remove", key=oldest, reason="window_limit"))
        return out

    def append(self, op: dict, limit: int) -> list[dict]:
        key, old, more = op["key"], self.shown.get(op["key"]), op["text"] or ""
        kind = op["kind"] if op["kind"] is not None else old.kind if old else None
        if op["offset"] is None:
            self.gap |= old is None
            return self.put(key, kind, ((old.text if old else None) or "") + more, op["complete"], limit)
        if old is None:
            return self.fail(key, "append_without_start")
        before, chunk, at = (old.text or "").encode("utf-16-le", "surrogatepass"), more.encode("utf-16-le", "surrogatepass"), 2 * int(op["offset"])
        if not 0 <= at <= len(before):
            return self.fail(key, "append_gap")
        shared = min(len(chunk), len(before) - at)
        if before[at : at + shared] != chunk[:shared]:
            return self.fail(key, "append_conflict")
        if len(chunk) == shared:
            return []
        return self.put(key, kind, (before[:at] + chunk).decode("utf-16-le", "surrogatepass"), op["complete"], limit)

    def first(self, event_id: str, places: MutableMapping, ring: MutableMapping) -> bool:
        """Notes an event's id and tells whether it is new; ``ring`` has the id at each place, ``places`` the place of each id."""
        if event_id in places:
            return False
        place = self.noted % SEEN
        if (old := ring.get(place)) is not None:
            del places[old]
        ring[place], places[event_id] = event_id, place
        self.noted += 1
        return True

    def step(self, op: dict, places: MutableMapping, ring: MutableMapping, limit: int) -> list[dict]:
        """The records of one operation."""
        if op["pos"] is None or op["pos"] <= self.pos:
            return []
        self.pos = int(op["pos"])
        if op["op"] not in OPERATIONS or op["event_id"] is not None and not self.first(op["event_id"], places, ring) or self.ended:
            return []
        if op["op"] == "reset":
            self.generation, self.shown, self.gap, self.truncated, self.broken = self.generation + 1, {}, False, False, False
            return [self.record("reset")]
        if op["op"] == "end":
            self.ended = True
            return [self.record("end", reason=op["text"])]
        if self.broken or op["key"] is None:
            return []
        if op["op"] == "remove":
            return [self.record("remove", key=op["key"])] if self.shown.pop(op["key"], None) else []
        if op["op"] == "upsert":
            return self.put(op["key"], op["kind"], op["text"], op["complete"], limit)
        return self.append(op, limit)

    def checkpoint(self) -> dict:
        return {"seq": self.seq, "generation": self.generation, "type": "checkpoint", "gap": self.gap, "truncated": self.truncated, "reason": str(self.pos)}


def _operations(frame: pd.DataFrame) -> Iterator[dict]:
    held = frame[list(COLUMNS)].astype(object)
    yield from held.where(held.notna(), None).to_dict("records")


def _frame(session: str | None, records: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame([{"session": session, **r} for r in records], columns=NAMES, dtype=object)
    return frame.astype({"seq": "int64", "generation": "int64", "gap": "bool", "truncated": "bool"})


_META = [f"{name} {'boolean' if kind == 'bool' else 'long'}" for name, kind in Session.__annotations__.items() if name != "shown"]


class _Held:
    """A map in the state store, by single values."""

    def __init__(self, state: MapState) -> None:
        self.state = state

    def __contains__(self, key: object) -> bool:
        return self.state.containsKey((key,))

    def get(self, key: object) -> object:
        return self.state.getValue((key,))[0] if key in self else None

    def __setitem__(self, key: object, value: object) -> None:
        self.state.updateValue((key,), (value,))

    def __delitem__(self, key: object) -> None:
        self.state.removeKey((key,))


class LiveProcessor(StatefulProcessor):
    """Keeps a session's counters as a value, what it shows and the ids it has seen as maps."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meta = handle.getValueState("meta", ", ".join(_META))
        self.shown = handle.getMapState("shown", "key string", "seq long, kind string, text string, complete boolean")
        self.places = _Held(handle.getMapState("places", "id string", "place long"))
        self.ring = _Held(handle.getMapState("ring", "place long", "id string"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        live = Session()
        if self.meta.exists():
            live = Session(*self.meta.get())
            live.shown = {k[0]: Shown(*v) for k, v in self.shown.iterator()}
        before = dict(live.shown)
        frame = pd.concat(list(rows)).sort_values(["pos", "op", "key", "text"], kind="stable", na_position="first")
        records = [r for op in _operations(frame) for r in live.step(op, self.places, self.ring, self.limit)]
        for name in before.keys() - live.shown.keys():
            self.shown.removeKey((name,))
        for name, value in live.shown.items():
            if before.get(name) != value:
                self.shown.updateValue((name,), tuple(asdict(value).values()))
        self.meta.update(tuple(v for k, v in asdict(live).items() if k != "shown"))
        yield _frame(key[0], [*records, live.checkpoint()])

    def close(self) -> None:
        pass


def _typed(operations: DataFrame) -> DataFrame:
    kinds = {"pos": "long", "offset": "long", "complete": "boolean"}
    return operations.select(F.col("session").cast("string").alias("session"), *[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def follow(operations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The records of a stream of operations; needs the RocksDB state store."""
    return _typed(operations).groupBy("session").transformWithStateInPandas(LiveProcessor(limit), RECORDS, "Append", "None")


def replay(operations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The records of a finished table of operations, with one checkpoint for each session.

    Sessions are sorted by place in Spark and walked through one after another, so a task
    holds what one session shows and the ids it has seen.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, live, places, ring = None, None, {}, {}
        for frame in frames:
            owner = frame["session"].astype(object).where(frame["session"].notna(), None)
            for session, part in frame.groupby((owner != owner.shift()).cumsum(), sort=False):
                own = owner.loc[part.index[0]]
                if live is None or own != name:
                    if live is not None:
                        yield _frame(name, [live.checkpoint()])
                    name, live, places, ring = own, Session(), {}, {}
                yield _frame(name, [r for op in _operations(part) for r in live.step(op, places, ring, limit)])
        if live is not None:
            yield _frame(name, [live.checkpoint()])

    order = ["session", "pos", "op", "key", "text"]
    return _typed(operations).repartition("session").sortWithinPartitions(*order).mapInPandas(run, RECORDS)


def state(records: DataFrame) -> DataFrame:
    """``session, key, kind, text, complete``: what each session shows after its records; an aggregation, in any order and with repeats."""
    newest = records.groupBy("session").agg(F.max("generation").alias("_newest"))
    kept = records.filter(F.col("type").isin("upsert", "remove")).select("session", "seq", "generation", "type", "key", "kind", "text", "complete")
    kept = kept.join(newest, kept["session"].eqNullSafe(newest["session"])).filter("generation = _newest").drop(newest["session"])
    last = kept.groupBy("session", "key").agg(F.max_by(F.struct("type", "kind", "text", "complete"), "seq").alias("r"))
    return last.filter("r.type = 'upsert'").select("session", "key", "r.kind", "r.text", "r.complete")


def follow_to(operations: DataFrame, folder: str, checkpoint: str, **more: int):
    """A writer of the records to ``folder``, one folder for each batch; a batch that runs again replaces its own."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return follow(operations, **more).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
