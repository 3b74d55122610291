"""States of items, repeated failures and coalesced changes, on tables and on streams alike (Y-05, Y-06, Y-08).

An item lives through facts: item, at (microseconds), seq (tells facts of one moment apart), kind and flag.

    found      the file was added; failures before it are forgotten
    row        whether its row is among the chosen ones; a null flag: the row is not known
    analysed   the analysis ended; flag: the recording fits
    cut        the recording was cut
    music      background music was found; a recording that is cut must be cut again
    failed     an attempt failed; flag: it may pass when repeated

Its state is one of eight: waits for its row, out of the chosen rows, queued, done, unfit, cut, recut, error. Whatever
was reached last counts; before that, the row. A failed attempt is repeated after 2, 4, 8 and 16 s if nothing happens
before; the fifth failure since the last success, or one that repeating cannot mend, is an error.

``item_log`` says it with windows for a table, ``streamed_log`` with one state and its timers for a stream; both give the
same rows: a ``state`` row where the state changes, a ``retry`` row where a pause ends (item, at, what, state, attempt).
Facts without item, time or known kind are left out, those of equal item, at and seq count once, of which any one is
taken; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

WAITS, OUT, QUEUED, DONE, UNFIT, CUT, RECUT, ERROR = "waits", "out", "queued", "done", "unfit", "cut", "recut", "error"
KINDS = ("found", "row", "analysed", "cut", "music", "failed")
#: Kinds that end a row of failures.
FRESH = ("found", "analysed", "cut")
RETRIES, PAUSE_S = 4, 2
LOG = "item long, at long, what string, state string, attempt int"


def known_facts(facts: DataFrame) -> DataFrame:
    """item, at, seq, kind, flag of the facts that count."""
    known = facts.filter(F.col("item").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(*KINDS))
    return known.select(F.col("item").cast("long"), F.col("at").cast("long"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), "kind", F.col("flag").cast("boolean"))


def pause_us(attempt: Column, pause_s: int = PAUSE_S) -> Column:
    """How long the pause after the given failure is."""
    return (F.lit(pause_s * 1_000_000) * F.pow(F.lit(2.0), F.least(attempt, F.lit(30)) - 1)).cast("long")


def _state(inside: Column, reached: Column, fits: Column, music: Column, attempt: Column, hopeless: Column, retries: int) -> Column:
    return (
        F.when(hopeless | (attempt > retries), ERROR)
        .when(reached == "cut", F.when(music, RECUT).otherwise(CUT))
        .when(reached == "analysed", F.when(fits, DONE).otherwise(UNFIT))
        .when(inside.isNull(), WAITS)
        .otherwise(F.when(inside, QUEUED).otherwise(OUT))
    )


def item_log(facts: DataFrame, retries: int = RETRIES, pause_s: int = PAUSE_S) -> DataFrame:
    """The log of a table of facts. One sort by item; windows hold one row at a time, so a hot item only sorts longer."""
    kind = F.col("kind")
    order = Window.partitionBy("item").orderBy("at", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda kinds: F.last(F.when(kind.isin(*kinds), F.struct("kind", "flag")), ignorenulls=True).over(so_far)
    steps = known_facts(facts).dropDuplicates(["item", "at", "seq"])
    steps = steps.select(
        "*",
        latest(["row"])["flag"].alias("inside"),
        latest(["analysed", "cut"]).alias("reached"),
        F.coalesce(latest(["analysed", "cut", "music"])["kind"] == "music", F.lit(False)).alias("music"),
        F.count(F.when(kind.isin(*FRESH), 1)).over(so_far).alias("era"),
        F.lead("at").over(order).alias("next_at"),
    )
    # the same sort serves: rows of an era stand together
    in_era = Window.partitionBy("item", "era").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns(
        {
            "attempt": F.count(F.when(kind == "failed", 1)).over(in_era).cast("int"),
            "hopeless": F.coalesce(F.max(F.when(kind == "failed", ~F.coalesce("flag", F.lit(False)))).over(in_era), F.lit(False)),
        }
    )
    fits = F.coalesce(F.col("reached.flag"), F.lit(False))
    steps = steps.withColumn("state", _state(F.col("inside"), F.col("reached.kind"), fits, F.col("music"), F.col("attempt"), F.col("hopeless"), retries))
    due = F.col("at") + pause_us(F.col("attempt"), pause_s)
    again = (kind == "failed") & (F.col("state") != ERROR) & (F.col("next_at").isNull() | (F.col("next_at") > due))
    steps = steps.withColumn("changed", ~F.col("state").eqNullSafe(F.lag("state").over(order)))
    row = lambda what, at: F.struct(at.alias("at"), F.lit(what).alias("what"))
    rows = F.array_compact(F.array(F.when(F.col("changed"), row("state", F.col("at"))), F.when(again, row("retry", due))))
    return steps.select("item", F.explode(rows).alias("r"), "state", "attempt").select("item", "r.at", "r.what", "state", "attempt")


class ItemStates(StatefulProcessor):
    """One item: facts that the watermark has not passed wait in order, what has been reached is one small row."""

    def __init__(self, retries: int, pause_s: int):
        self.retries, self.pause = retries, pause_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, kind string, flag boolean")
        self.reached = handle.getValueState("reached", "inside boolean, kind string, fits boolean, music boolean, attempt int, hopeless boolean, state string, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            facts = [(int(r.at), int(r.seq), r.kind, None if pd.isna(r.flag) else bool(r.flag)) for r in frame.itertuples()]
            self.waiting.appendList(facts)
            for at in {at for at, *_ in facts}:
                self.handle.registerTimer(_ceil_ms(at))
        yield _log([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        facts = sorted(self.waiting.get(), key=lambda f: (f[0], f[1]))
        ready = [f for f in facts if _ceil_ms(f[0]) <= passed]
        later = facts[len(ready) :]
        inside, kind, fits, music, attempt, hopeless, state, due = self.reached.get() if self.reached.exists() else (None, None, False, False, 0, False, None, None)
        log, before = [], None
        for at, seq, what, flag in ready:
            if (at, seq) == before:
                continue
            before = (at, seq)
            if due is not None and due < at:
                log.append((key[0], due, "retry", state, attempt))
            due = None
            if what in FRESH:
                attempt, hopeless = 0, False
            if what == "row":
                inside = flag
            elif what in ("analysed", "cut"):
                kind, fits, music = what, bool(flag), False
            elif what == "music":
                music = True
            elif what == "failed":
                attempt, hopeless = attempt + 1, hopeless or not flag
            old, state = state, self._state(inside, kind, fits, music, attempt, hopeless)
            if what == "failed" and state != ERROR:
                due = at + (self.pause << (attempt - 1))
                self.handle.registerTimer(_ceil_ms(due))
            if state != old:
                log.append((key[0], at, "state", state, attempt))
        if due is not None and _ceil_ms(due) <= passed:
            log.append((key[0], due, "retry", state, attempt))
            due = None
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        self.reached.update((inside, kind, fits, music, attempt, hopeless, state, due))
        yield _log(log)

    def _state(self, inside, kind, fits, music, attempt, hopeless) -> str:
        if hopeless or attempt > self.retries:
            return ERROR
        if kind == "cut":
            return RECUT if music else CUT
        if kind == "analysed":
            return DONE if fits else UNFIT
        return WAITS if inside is None else QUEUED if inside else OUT

    def close(self) -> None:
        pass


def _log(rows: list[tuple]) -> pd.DataFrame:
    # as objects, since strings of pandas' own type come in chunks, which the state worker does not take
    return pd.DataFrame(rows, columns=["item", "at", "what", "state", "attempt"], dtype=object)


def _ceil_ms(us: int) -> int:
    return -(-us // 1000)


def streamed_log(facts: DataFrame, late: str = "10 seconds", retries: int = RETRIES, pause_s: int = PAUSE_S) -> DataFrame:
    """The log of a stream of facts, which may come out of order by ``late``; what comes later still is left out.

    A row is given out once the watermark has passed it. The state lives in the query's checkpoint, so a restart
    neither forgets a pause nor repeats a row. Needs the RocksDB state store.
    """
    timed = known_facts(facts).withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", late)
    return timed.groupBy("item").transformWithStateInPandas(ItemStates(retries, pause_s), LOG, "append", "eventTime")


def coalesced(changes: DataFrame, keys: list[str], quiet: str = "3 seconds", late: str = "10 seconds") -> DataFrame:
    """Y-06: changes (keys, ts) that follow each other within ``quiet`` are one save: keys, first_ts, save_ts, n_changes.

    On a stream a save is given out when the watermark has passed its end, on a table all are.
    """
    timed = changes.withWatermark("ts", late)
    grouped = timed.groupBy(*keys, F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n_changes"))
    return grouped.select(*keys, F.col("w.start").alias("first_ts"), F.col("w.end").alias("save_ts"), "n_changes")


class Transient(Exception):
    """A failure that may pass when the action is repeated."""


def repeating(action: Callable[[DataFrame, int], None], retries: int = RETRIES, pause_s: float = PAUSE_S, wait: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, int], None]:
    """Y-08: an action for ``foreachBatch`` that repeats transient failures after doubling pauses and raises the last one.

    The batch is the same each time, and actions key their writes by its number, so repeating changes nothing twice.
    """

    def act(batch: DataFrame, number: int) -> None:
        for attempt in range(retries + 1):
            try:
                return action(batch, number)
            except Transient:
                if attempt == retries:
                    raise
                wait(pause_s * 2**attempt)

    return act
