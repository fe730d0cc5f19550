"""Tool behaviour of a session: baseline, call pairs and the change around a pivot turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnsift.config import ScanConfig
from turnsift.operators.durable import durable
from turnsift.operators.ordered import CHUNK_ROWS, chunk_of, with_previous, with_running

# Name parts of tools with side effects.
SENSITIVE_PARTS = (
    "send", "email", "post", "write", "delete", "execute", "run", "upload", "forward",
)


def is_sensitive(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SENSITIVE_PARTS))


def tool_names(events: DataFrame) -> DataFrame:
    """session_id, turn_index, names (tools of the turn in call order, maybe empty)."""
    names = F.transform(F.coalesce("tool_calls", F.array()), lambda call: call["name"])
    return events.select("session_id", "turn_index", names.alias("names"))


def tool_calls(turns: DataFrame) -> DataFrame:
    """One row per call: session_id, turn_index, call_no, name."""
    return turns.select(
        "session_id", "turn_index", F.posexplode("names").alias("call_no", "name")
    )


def _pairs(turns: DataFrame, previous_last: Column) -> DataFrame:
    names = F.col("names")
    inside = F.transform(
        F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))),
        lambda second, i: F.struct(F.get(names, i).alias("first"), second.alias("second")),
    )
    crossing = F.when(
        previous_last.isNotNull() & (F.size(names) > 0),
        F.array(F.struct(previous_last.alias("first"), F.get(names, F.lit(0)).alias("second"))),
    )
    pairs = F.concat(F.coalesce(crossing, F.array().cast(_PAIRS)), inside)
    return turns.select(
        "session_id", "turn_index", F.posexplode(pairs).alias("pair_no", "_pair")
    ).select("session_id", "turn_index", "pair_no", "_pair.first", "_pair.second")


_PAIRS = "array<struct<first:string,second:string>>"


def sequential_pairs(turns: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Consecutive calls: inside a turn, and from the last call of one stored turn to the
    first of the next; a turn without calls breaks the link."""
    ends = turns.withColumn("last_name", F.try_element_at("names", F.lit(-1)))
    linked = with_previous(
        ends, ["session_id"], ["turn_index"],
        chunk_of(F.col("turn_index"), chunk_rows), ["last_name"],
    )
    return _pairs(linked, F.col("previous.last_name"))


def baseline_turns(turns: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """The first turns of every session; the rank limit is applied before the shuffle."""
    by_turn = Window.partitionBy("session_id").orderBy("turn_index")
    return turns.withColumn("nth", F.row_number().over(by_turn)).filter(
        F.col("nth") <= cfg.baseline_turns
    )


def tool_distribution(turns: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """Share of every tool among the baseline calls of its session."""
    counts = tool_calls(baseline_turns(turns, cfg)).groupBy("session_id", "name").agg(
        F.count(F.lit(1)).alias("calls")
    )
    total = F.sum("calls").over(Window.partitionBy("session_id"))
    return counts.withColumn("share", F.round(F.col("calls") / total, 4))


def tools_per_turn(turns: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    return baseline_turns(turns, cfg).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum(F.size("names")).alias("calls"),
        F.round(F.sum(F.size("names")) / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias(
            "avg_tools_per_turn"
        ),
    )


def common_pairs(turns: DataFrame, top: int = 5, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """Most frequent baseline pairs per session, ties to the pair seen first."""
    base = baseline_turns(turns, cfg)
    by_turn = Window.partitionBy("session_id").orderBy("turn_index")
    before = F.lag(F.try_element_at("names", F.lit(-1))).over(by_turn)
    pairs = _pairs(base.withColumn("_before", before), F.col("_before"))
    counts = pairs.groupBy("session_id", "first", "second").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("turn_index", "pair_no")).alias("_seen")
    )
    ranked = Window.partitionBy("session_id").orderBy(F.desc("n"), "_seen")
    return (
        counts.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= top)
        .drop("_seen")
    )


def pivots(signals: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """Distinct turns with a strong signal."""
    strong = signals.filter(F.col("score") >= cfg.pivot_score)
    return strong.select("session_id", F.col("turn_index").alias("pivot_turn")).distinct()


def first_uses(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session_id", "name").agg(
        F.min(F.struct("turn_index", "call_no")).alias("first_use")
    )


def behavior_diffs(
    pivot_turns: DataFrame,
    calls: DataFrame,
    cfg: ScanConfig = ScanConfig(),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Anomaly of every (session, pivot): calls before and after, number of new tools.

    No pivot is joined with its calls: a tool is new after a pivot if its first use is not
    before it, so everything follows from running counts over one row per turn (stored once,
    read for the totals and for the two levels of the running counts). The action
    lists are the first ``before_calls`` and the other calls of the session in order.
    """
    uses = first_uses(calls).select(
        "session_id",
        F.col("first_use.turn_index").alias("turn_index"),
        is_sensitive(F.col("name")).cast("long").alias("sensitive"),
    )
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")

    def counted(df: DataFrame, calls=zero, fresh=zero, risky=zero, pivot=zero) -> DataFrame:
        return df.select(
            "session_id", F.col("turn_index").cast("long").alias("turn_index"),
            calls.alias("calls"), fresh.alias("fresh"), risky.alias("risky"), pivot.alias("pivot"),
        )

    marks = pivot_turns.withColumnRenamed("pivot_turn", "turn_index")
    per_turn = durable(
        counted(calls, calls=one)
        .unionByName(counted(uses, fresh=one, risky=F.col("sensitive")))
        .unionByName(counted(marks, pivot=one))
        .groupBy("session_id", "turn_index")
        .agg(*[F.sum(c).alias(c) for c in ("calls", "fresh", "risky", "pivot")])
    )
    chunk = chunk_of(F.col("turn_index"), chunk_rows)
    running = with_running(
        per_turn, ["session_id"], ["turn_index"], chunk,
        {f"{c}_so_far": (F.sum, F.col(c)) for c in ("calls", "fresh", "risky")},
    )
    totals = per_turn.groupBy("session_id").agg(
        *[F.sum(c).alias(f"{c}_total") for c in ("calls", "fresh", "risky")]
    )
    at_pivot = running.filter(F.col("pivot") > 0).join(totals, "session_id")

    def earlier(name: str) -> Column:
        return F.col(f"{name}_so_far") - F.col(name)

    fresh = F.col("fresh_total") - earlier("fresh")
    ratio = fresh / F.greatest(earlier("calls"), F.lit(1))
    risky = F.col("risky_total") - earlier("risky") > 0
    weighted = F.when(risky, ratio * cfg.sensitive_factor).otherwise(ratio)
    return at_pivot.select(
        "session_id",
        F.col("turn_index").cast("int").alias("pivot_turn"),
        earlier("calls").alias("before_calls"),
        (F.col("calls_total") - earlier("calls")).alias("after_calls"),
        fresh.alias("n_new"),
        risky.alias("sensitive"),
        F.round(F.least(F.lit(1.0), weighted), 4).alias("anomaly_score"),
    )


def new_actions(pivot_turns: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per (pivot, tool never called before it), ordered by first_turn, first_call."""
    return (
        pivot_turns.select("session_id", "pivot_turn")
        .join(first_uses(calls), "session_id")
        .filter(F.col("first_use.turn_index") >= F.col("pivot_turn"))
        .select(
            "session_id",
            "pivot_turn",
            "name",
            F.col("first_use.turn_index").alias("first_turn"),
            F.col("first_use.call_no").alias("first_call"),
        )
    )
