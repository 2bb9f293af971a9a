"""Event-time windows and check state, the same functions for tables and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Which status may follow which.
TRANSITIONS = {"receiving": {"uploaded", "error"}, "uploaded": {"pending", "error"}, "pending": {"done", "error"}, "done": set(), "error": {"pending"}}
STALE_SECONDS = {"sync": 330, "local": 1800}


def tumbling(events: DataFrame, ts: str, every: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums of windows; with a watermark where the input is a stream."""
    if events.isStreaming:
        events = events.withWatermark(ts, late or every)
    return events.groupBy(F.window(ts, every).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, ts: str, length: str, step: str, keys: list[str], late: str | None = None) -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark(ts, late or length)
    return events.groupBy(F.window(ts, length, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark(ts, late or gap)
    return events.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def follow(status: str | None, wanted: list[str]) -> tuple[str, int, int]:
    """Status after a row of wished-for statuses: a wish that may not follow loses."""
    taken = refused = 0
    for want in wanted:
        if status is None and want == "receiving" or status is not None and want in TRANSITIONS[status]:
            status, taken = want, taken + 1
        else:
            refused += 1
    return status or "", taken, refused


#: A check's possible statuses; the first is that of a check without events.
STATUSES = ["", *TRANSITIONS]


def pieces(events: DataFrame) -> DataFrame:
    """Folds ordered ranges of checks' events: check_id, piece (place in order), rows, and for each of the six statuses
    at its start the status at its end (ends), and the numbers of taken and refused wishes.

    Events are sorted over all tasks, so those of one check may stand in several; equal ones are one row with a count.
    """

    def after(want: str) -> list[tuple[int, int]]:
        """From each status, where a wish leads and whether it is taken."""
        moves = [follow(status or None, [want]) for status in STATUSES]
        return [(STATUSES.index(status), taken) for status, taken, _ in moves]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, columns = TaskContext.get().partitionId(), ["check_id", "piece", "rows", "ends", "taken", "refused"]
        known: dict = {}
        held = None  # the check that goes on, its rows and its three lists
        for batch in batches:
            out = []
            for check, want, n in zip(batch["check_id"], batch["wanted"], batch["n"].tolist(), strict=True):
                check = check if isinstance(check, str) else None
                if held is None or held[0] != check:
                    if held is not None:
                        out.append((held[0], number, *held[1:]))
                    held = [check, 0, list(range(len(STATUSES))), [0] * len(STATUSES), [0] * len(STATUSES)]
                held[1] += n
                moves = known[want] if want in known else known.setdefault(want, after(want))
                for k, at in enumerate(held[2]):
                    # the first of equal wishes, and one more, as all others go as that one
                    end, first = moves[at]
                    taken = first + (n - 1) * moves[end][1]
                    held[2][k] = moves[end][0]
                    held[3][k] += taken
                    held[4][k] += n - taken
            yield pd.DataFrame(out, columns=columns)
        if held is not None:
            yield pd.DataFrame([(held[0], number, *held[1:])], columns=columns)

    order = ["check_id", "ts", "wanted"]
    counted = events.groupBy(*order).agg(F.count("*").alias("n")).withColumns({"_ts": F.col("ts").isNull(), "_wanted": F.col("wanted").isNull()})
    order = ["check_id", "_ts", "ts", "_wanted", "wanted"]  # null times and wishes last
    dealt = counted.repartitionByRange(*order).sortWithinPartitions(*order).select("check_id", "wanted", "n")
    return dealt.mapInPandas(fold, "check_id string, piece int, rows long, ends array<int>, taken array<long>, refused array<long>")


def lifecycle(events: DataFrame) -> DataFrame:
    """check_id, status, taken, refused after all events (check_id string, ts timestamp, wanted string); a table.

    A check has at most one piece in each task of the sort; they are put together in order.
    """
    of_check = pieces(events).groupBy("check_id").agg(F.array_sort(F.collect_list(F.struct("piece", "ends", "taken", "refused"))).alias("p"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("refused"))
    add = lambda s, p: F.struct(F.get(p["ends"], s["at"]).alias("at"), (s["taken"] + F.get(p["taken"], s["at"])).alias("taken"), (s["refused"] + F.get(p["refused"], s["at"])).alias("refused"))
    end = of_check.select("check_id", F.aggregate("p", start, add).alias("s"))
    return end.select("check_id", F.get(F.array(*map(F.lit, STATUSES)), F.col("s.at")).alias("status"), "s.taken", "s.refused")


#: Statuses that nothing may follow.
FINAL = {status for status, following in TRANSITIONS.items() if not following}


def lifecycle_stream(events: DataFrame, idle: str = "1 hour", late: str | None = None) -> DataFrame:
    """The same over a stream: the state of a check is its status.

    Events of one batch apply in order of time, equal times in the order in which they may follow each other; batches
    apply as they come, and with `late` events that come later than that are dropped. A check that is idle and in a
    final status loses its state, as nothing may follow; others keep theirs, so a late step is still judged rightly.
    """
    patience = int(pd.Timedelta(idle).total_seconds() * 1000)
    steps = list(TRANSITIONS)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, taken, refused = state.get if state.exists else (None, 0, 0)
        if state.hasTimedOut:
            if status in FINAL:
                state.remove()
            else:
                state.setTimeoutDuration(patience)
            return
        rows = pd.concat(list(batches))
        rows["_step"] = [steps.index(w) if w in steps else len(steps) for w in rows["wanted"]]
        status, more, less = follow(status or None, rows.sort_values(["ts", "_step"], kind="stable")["wanted"].tolist())
        state.update((status, taken + more, refused + less))
        state.setTimeoutDuration(patience)
        yield pd.DataFrame({"check_id": [key[0]], "status": [status], "taken": [taken + more], "refused": [refused + less]})

    timely = events.withWatermark("ts", late) if late else events
    schema = "check_id string, status string, taken long, refused long"
    return timely.groupBy("check_id").applyInPandasWithState(step, schema, "status string, taken long, refused long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def stale(checks: DataFrame, now, mode: str = "sync") -> DataFrame:
    """Pending checks that have waited too long count as failed."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("changed_at")
    return checks.withColumn("status", F.when((F.col("status") == "pending") & (age > STALE_SECONDS[mode]), "error").otherwise(F.col("status")))


def expired(checks: DataFrame, now, days: int = 7) -> DataFrame:
    return checks.where(F.col("created_at") + F.make_interval(days=F.lit(days)) <= F.lit(now).cast("timestamp"))


def requests_taken(requests: DataFrame, most: int = 5, day: int = 86_400) -> DataFrame:
    """email, request, taken of a table: a request is taken if fewer than `most` were taken in the day before it.

    Only taken requests count, so a request's answer hangs on those before it; rows of an address are read in order and in
    batches, and what is remembered of an address are the times of at most `most` requests.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[str | None, list[int]] = (None, [])
        for batch in batches:
            answers = []
            for email, at in zip(batch["email"], batch["at"].tolist(), strict=True):
                recent = [t for t in held[1] if t > at - day * 1_000_000] if email == held[0] else []
                answers.append(len(recent) < most)
                held = (email, [*recent, at] if answers[-1] else recent)
            yield pd.DataFrame({"email": batch["email"], "request": batch["request"], "taken": answers})

    known = requests.where("email is not null and ts is not null").select("email", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("request").cast("long"))
    dealt = known.repartition("email").sortWithinPartitions("email", "at", "request")
    return dealt.mapInPandas(run, "email string, request long, taken boolean")


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The last review of each finding; an empty last review takes the review away."""
    last = reviews.groupBy("check_id", "finding").agg(F.max(F.struct("ts", "verdict", "comment")).alias("r")).select("check_id", "finding", "r.*")
    return last.where(F.col("verdict").isNotNull() | (F.coalesce("comment", F.lit("")) != ""))
