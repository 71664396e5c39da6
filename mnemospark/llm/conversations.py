"""Rebuilding conversations from message rows.

Messages become nodes of reply graphs: a user message answers the last
assistant step of the turn before, an assistant step answers the step before it
or, as the first, the turn's user message. Each graph is sorted topologically
with Kahn's algorithm, the timestamp (then the id) breaking ties; nodes that are
left over lie on or behind a cycle, and their session is dropped, as is one whose
graph isn't a single chain: a message with two answers, or a second beginning. Role
alternation and completeness are checked on aggregates per turn and session, so
the check never holds a session in one place.

Kahn's algorithm runs in a stream of sorted sessions (`kahn_in_stream`), one
session in memory at a time. Sessions of more than `STREAM_LIMIT` messages go
another, exact way: pointer doubling over the reply links (`kahn_by_doubling`),
whose joins spread one session over all tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

#: Sessions with more messages than this are ordered by distributed pointer doubling.
STREAM_LIMIT = 20_000


def latest_deliveries(raw: DataFrame) -> DataFrame:
    """One row per msg_id, that of the latest received_at; rows without msg_id or session are no messages.

    Ties are broken by the row's values. Repeats vanish before the shuffle.
    """
    fields = ["received_at", "session", "type", "source_kind", "turn", "step", "at", "text"]
    best = F.max(F.struct(*fields)).alias("m")
    return (
        raw.where(F.col("msg_id").isNotNull() & F.col("session").isNotNull())
        .groupBy("msg_id").agg(best).select("msg_id", *[f"m.{f}" for f in fields])
    )


def with_turns(speech: DataFrame) -> DataFrame:
    """Gives a user message without turn the turn of the first assistant row at or after it.

    Two levels, so that a long session isn't one window: within the session's
    day, then over one row for each of its days.
    """
    key = F.when(F.col("is_user"), None).otherwise(F.col("turn"))
    day = F.to_date("at")
    back = Window.partitionBy("session", "day").orderBy(F.col("at").desc(), F.col("is_user"), F.col("msg_id"))
    within = speech.withColumn("day", day).withColumn(
        "next_turn", F.last(key, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    )
    firsts = (
        speech.where(~F.col("is_user") & F.col("turn").isNotNull()).groupBy("session", day.alias("day"))
        .agg(F.min_by("turn", F.struct("at", "msg_id")).alias("day_turn"))
    )
    lost = within.where(F.col("is_user") & F.col("turn").isNull() & F.col("next_turn").isNull())
    after = (
        lost.join(firsts.withColumnRenamed("day", "other"), "session")
        .where(F.col("other") > F.col("day"))
        .groupBy("msg_id").agg(F.min_by("day_turn", "other").alias("later_turn"))
    )
    open_users = within.where(F.col("is_user") & F.col("turn").isNull())
    filled = open_users.join(after, "msg_id", "left").withColumn("turn", F.coalesce("next_turn", "later_turn"))
    known = within.where(~(F.col("is_user") & F.col("turn").isNull()))
    return known.drop("day", "next_turn").unionByName(filled.drop("day", "next_turn", "later_turn"))


def complete_sessions(turned: DataFrame, barred: DataFrame) -> DataFrame:
    """Sessions whose turns run from 1 without gap and are each complete, without those in ``barred``."""
    spoken = F.col("has_text")
    per_turn = turned.groupBy("session", "turn").agg(
        F.count(F.when(F.col("is_user"), 1)).alias("users"),
        F.count(F.when(F.col("is_user") & spoken, 1)).alias("users_text"),
        F.count(F.when(~F.col("is_user"), 1)).alias("steps"),
        F.count(F.when(~F.col("is_user") & spoken, 1)).alias("steps_text"),
        F.count_distinct(F.when(~F.col("is_user"), F.col("step"))).alias("steps_distinct"),
        F.min(F.when(~F.col("is_user"), F.col("step"))).alias("first_step"),
        F.max(F.when(~F.col("is_user"), F.col("step"))).alias("last_step"),
    )
    fine = (
        F.col("turn").isNotNull() & (F.col("users") == 1) & (F.col("users_text") == 1) & (F.col("steps_text") >= 1)
        & (F.col("first_step") == 1) & (F.col("last_step") == F.col("steps"))
        & (F.col("steps_distinct") == F.col("steps"))
    )
    per_session = per_turn.groupBy("session").agg(
        F.bool_and(F.coalesce(fine, F.lit(False))).alias("fine"),
        F.count("*").alias("turns"), F.min("turn").alias("first"), F.max("turn").alias("last"),
        F.sum(F.col("users") + F.col("steps")).alias("messages"),
    )
    kept = per_session.where(F.col("fine") & (F.col("first") == 1) & (F.col("last") == F.col("turns")))
    return kept.join(barred, "session", "left_anti").select("session", "messages")


def reply_edges(turned: DataFrame) -> DataFrame:
    """(session, msg_id, at, reply_to): whom each message answers; null for a conversation's first."""
    steps = Window.partitionBy("session", "turn").orderBy(F.col("is_user").desc(), "step", "at", "msg_id")
    linked = turned.withColumn("before", F.lag("msg_id").over(steps))
    ends = turned.groupBy("session", (F.col("turn") + 1).alias("turn")).agg(
        F.max_by("msg_id", F.struct(~F.col("is_user"), "step", "at", "msg_id")).alias("turn_before")
    )
    return linked.join(ends, ["session", "turn"], "left").select(
        "session", "msg_id", "at", "has_text",
        F.when(F.col("before").isNull(), F.col("turn_before")).otherwise(F.col("before")).alias("reply_to"),
    )


def kahn(ids: list, times: list, parents: list) -> list[int]:
    """Order of the nodes (positions) by Kahn's algorithm; nodes on or behind a cycle are left out.

    A parent that isn't among the nodes counts as none.
    """
    at = {x: k for k, x in enumerate(ids)}
    children: dict[int, list[int]] = {}
    ready = []
    for k, parent in enumerate(parents):
        p = at.get(parent)
        if p is None:
            ready.append((times[k], ids[k], k))
        else:
            children.setdefault(p, []).append(k)
    heapq.heapify(ready)
    order = []
    while ready:
        _, _, k = heapq.heappop(ready)
        order.append(k)
        for c in children.get(k, ()):
            heapq.heappush(ready, (times[c], ids[c], c))
    return order


ORDERED = "session string, msg_id string, has_text boolean, pos long"


def is_chain(ids: list, parents: list) -> bool:
    """Whether there is one beginning and no message is answered twice."""
    known = set(ids)
    inside = [p for p in parents if p in known]
    return len(inside) == len(ids) - 1 and len(set(inside)) == len(inside)


def kahn_in_stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Orders sessions that come as consecutive rows; holds one session at a time."""
    rest: pd.DataFrame | None = None

    def ordered(group: pd.DataFrame) -> pd.DataFrame | None:
        ids, marks = group["msg_id"].tolist(), group["has_text"].tolist()
        order = kahn(ids, group["micros"].tolist(), group["reply_to"].tolist())
        if len(order) < len(ids) or not is_chain(ids, group["reply_to"].tolist()):
            return None
        return pd.DataFrame({
            "session": group["session"].iloc[0], "msg_id": [ids[k] for k in order],
            "has_text": [marks[k] for k in order], "pos": range(1, len(order) + 1),
        })

    def flush(rows: pd.DataFrame) -> list[pd.DataFrame]:
        return [x for _, g in rows.groupby("session", sort=False) if (x := ordered(g)) is not None]

    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        last = rows["session"].iloc[-1]
        done, rest = rows[rows["session"] != last], rows[rows["session"] == last]
        if len(done) and (out := flush(done)):
            yield pd.concat(out, ignore_index=True)
    if rest is not None and len(rest) and (out := flush(rest)):
        yield pd.concat(out, ignore_index=True)


def kahn_by_doubling(edges: DataFrame) -> DataFrame:
    """The same order by pointer doubling: a node's depth is the number of its ancestors.

    After k rounds each node knows its ancestor 2^k steps up and how far it is,
    or its whole depth. When no node reaches a root any more, those without one
    lie on or behind a cycle and their session is dropped. In a chain every depth
    occurs once, and is the position; a session in which one doesn't is dropped.
    """
    parents = edges.select("session", F.col("msg_id").alias("reply_to"), F.lit(True).alias("there"))
    state = edges.join(parents, ["session", "reply_to"], "left").select(
        "session", "msg_id", "at", "has_text", F.when(F.col("there"), F.col("reply_to")).alias("up"),
        F.when(F.col("there"), 1).otherwise(0).alias("depth"),
    )
    state = cut(state)
    open_before = -1
    while True:
        left = state.where(F.col("up").isNotNull()).count()
        if left in (0, open_before):
            break
        open_before = left
        hop = state.select("session", F.col("msg_id").alias("up"), F.col("up").alias("up2"),
                           F.col("depth").alias("more"))
        state = cut(state.join(hop, ["session", "up"], "left").select(
            "session", "msg_id", "at", "has_text", F.col("up2").alias("up"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
        ))
    cyclic = state.where(F.col("up").isNotNull()).select("session").distinct()
    chains = state.groupBy("session", "depth").agg(F.count("*").alias("n")).groupBy("session").agg(F.max("n").alias("n")).where(F.col("n") == 1)
    return state.join(cyclic, "session", "left_anti").join(chains.select("session"), "session", "left_semi").select(
        "session", "msg_id", "has_text", (F.col("depth") + 1).cast("long").alias("pos"))


def order_messages(edges: DataFrame, sizes: DataFrame, stream_limit: int = STREAM_LIMIT) -> DataFrame:
    """(session, msg_id, has_text, pos) of every session without a cycle.

    ``sizes`` has (session, messages); a session above ``stream_limit`` is
    ordered by pointer doubling, the others in a stream.
    """
    sized = edges.join(sizes, "session")
    streamed = (
        sized.where(F.col("messages") <= stream_limit)
        .select("session", "msg_id", "has_text", "reply_to", F.unix_micros("at").alias("micros"))
        .repartition("session").sortWithinPartitions("session", "micros", "msg_id")
        .mapInPandas(kahn_in_stream, ORDERED)
    )
    if not sizes.where(F.col("messages") > stream_limit).limit(1).count():
        return streamed
    large = sized.where(F.col("messages") > stream_limit).select("session", "msg_id", "at", "has_text", "reply_to")
    return streamed.unionByName(kahn_by_doubling(large))


def conversations(raw: DataFrame, stream_limit: int = STREAM_LIMIT) -> DataFrame:
    """(session, pos, msg_id, role) of each complete conversation in session_messages.

    Assistant messages of blank or null text count as steps but don't come out.
    A user message without turn and without a later assistant row stays without
    turn and breaks its session, as does an assistant row without turn or step.
    An empty table gives an empty result.
    """
    messages = latest_deliveries(raw)
    user = (F.col("type") == "user/message") & F.coalesce(F.col("source_kind") == "user", F.lit(False))
    assistant = F.col("type") == "assistant/message"
    barred = messages.where(F.col("type") == "subagent/descriptor").select("session").distinct()
    speech = messages.where(user | assistant).select(
        "session", "msg_id", "turn", "step", "at", user.alias("is_user"),
        F.coalesce(F.regexp_replace("text", r"[\s\p{Z}\x{200B}\x{FEFF}]+", "") != "", F.lit(False)).alias("has_text"),
    )
    turned = cut(with_turns(speech))
    kept = cut(complete_sessions(turned, barred))
    chosen = turned.join(kept.select("session"), "session", "left_semi")
    ordered = order_messages(reply_edges(chosen), kept, stream_limit)
    roles = chosen.select("session", "msg_id", F.when(F.col("is_user"), "user").otherwise("assistant").alias("role"))
    by_pos = Window.partitionBy("session").orderBy("pos")
    return (
        ordered.where(F.col("has_text"))
        .select("session", F.row_number().over(by_pos).alias("pos"), "msg_id")
        .join(roles, ["session", "msg_id"])
    )
