"""Finite automata over sessions, as maps that can be put together in any grouping.

A symbol takes every state to a state; so does a run of symbols, and two runs that
follow one another are the composition of their maps.  A session is cut into buckets,
each bucket's symbols become one map (an array: where each state leads, and at which
place the state was last set on that way), and the maps of neighbouring buckets are
put together, ``FAN`` at a time, until one is left for each session.  No task holds
more than a bucket's symbols or ``FAN`` maps, however long a session is.

Defined results: a null session is a session; rows without a symbol, or with one that
the table doesn't have, change nothing; rows tied in ``seq`` are taken in the order of
their symbols; a session without a symbol keeps the first state, at no place; an
empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols of a bucket, and maps that are put together at once.
BUCKET, FAN = 1 << 12, 256


@dataclass(frozen=True)
class Automaton:
    """``states``, the first is where sessions begin; ``moves[symbol][state]`` is the next state, of states not named the state itself.

    A symbol in ``everywhere`` leads to one state from all of them.
    """

    states: tuple[str, ...]
    everywhere: dict[str, str] = field(default_factory=dict)
    moves: dict[str, dict[str, str]] = field(default_factory=dict)

    def target(self, symbol: str, state: str) -> str | None:
        """The next state; None where the symbol leaves the state, and its place, alone."""
        return self.everywhere.get(symbol, self.moves.get(symbol, {}).get(state))

    def symbols(self) -> list[str]:
        return sorted({*self.everywhere, *self.moves})

    def table(self) -> Column:
        """For each symbol an array over states: the next state's number, or null."""
        number = {s: k for k, s in enumerate(self.states)}
        rows = [F.array(*[F.lit(number.get(self.target(symbol, state))).cast("int") for state in self.states]) for symbol in self.symbols()]
        return F.create_map(*[x for symbol, row in zip(self.symbols(), rows, strict=True) for x in (F.lit(symbol), row)])


def _compose(maps: Column, n: int) -> Column:
    """The composition of an array of maps; a map is an array over states of ``to`` and ``at``."""
    start = F.array(*[F.struct(F.lit(k).alias("to"), F.lit(None).cast("long").alias("at")) for k in range(n)])
    step = lambda acc, m: F.transform(acc, lambda q: F.struct(F.get(m, q["to"])["to"].alias("to"), F.coalesce(F.get(m, q["to"])["at"], q["at"]).alias("at")))
    return F.aggregate(maps, start, step)


def run(rows: DataFrame, machine: Automaton, session: str = "session", seq: str = "seq", symbol: str = "symbol", bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """``session, state, at``: the state in which each session ends and the place that set it.

    ``bucket`` is the width of a bucket in ``seq``.
    """
    n = len(machine.states)
    known = rows.select(F.col(session).alias("session"), F.col(seq).cast("long").alias("seq"), F.when(F.col(symbol).isin(machine.symbols()), F.col(symbol)).alias("symbol"))
    every = known.groupBy("session").agg(F.min("seq").alias("lowest"), F.max("seq").alias("highest"))
    span = every.agg(F.coalesce(F.min("lowest"), F.lit(0)), F.coalesce(F.max("highest"), F.lit(0))).first()
    lowest, buckets = span[0], (span[1] - span[0]) // bucket + 1
    inner = F.sort_array(F.collect_list(F.struct("seq", "symbol")))
    single = lambda x: F.transform(F.element_at(machine.table(), x["symbol"]), lambda to, k: F.struct(F.coalesce(to, k).alias("to"), F.when(to.isNotNull(), x["seq"]).alias("at")))
    parts = known.filter("symbol is not null").groupBy("session", F.floor((F.col("seq") - lowest) / bucket).alias("b")).agg(inner.alias("inner"))
    parts = parts.select("session", "b", _compose(F.transform("inner", single), n).alias("m"))
    while buckets > 1:
        buckets = -(-buckets // fan)
        together = F.transform(F.sort_array(F.collect_list(F.struct("b", "m"))), lambda x: x["m"])
        parts = parts.groupBy("session", F.floor(F.col("b") / fan).alias("b")).agg(together.alias("maps")).select("session", "b", _compose(F.col("maps"), n).alias("m"))
    names = F.array(*[F.lit(s) for s in machine.states])
    ended = parts.select(F.col("session").alias("s"), F.get("m", 0).alias("q"))
    joined = every.join(ended, every["session"].eqNullSafe(ended["s"]), "left")
    return joined.select("session", F.get(names, F.coalesce("q.to", F.lit(0))).alias("state"), F.col("q.at").alias("at"))
