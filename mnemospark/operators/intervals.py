"""Joins over stretches of time, split by time so that a hot project is no single group, and curves fitted to them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..session import small

DAY = 86_400_000_000
#: Key under which every project's rows are met by rows that hold for all projects.
ALL = "*"


def _stretch(at: Column, micros: int) -> Column:
    """The number of the stretch of time that holds ``at``."""
    return F.floor(F.unix_micros(at) / F.lit(micros))


def _word_set(column: str) -> Column:
    """Distinct words of two characters or more, and Chinese bigrams."""
    return F.filter(text.token_set(F.col(column)), lambda w: F.length(w) >= 2)


def gold_pairs(turns: DataFrame, entries: DataFrame, minutes: int = 120) -> DataFrame:
    """(turn_id, id), distinct: entries of a turn's project asserted within ``minutes`` after it that share a word with it.

    ``turns`` is (turn_id, project, at, text), ``entries`` (id, project,
    asserted_at, content). The join is on project, word and stretch of time, so a
    frequent word of a hot project meets a stretch's rows only. Rows with a null
    in any column meet nothing.
    """
    width = minutes * 60_000_000
    asked = turns.select("turn_id", "project", "at", _stretch(F.col("at"), width).alias("stretch"), F.explode(_word_set("text")).alias("word"))
    given = entries.where(F.col("id").isNotNull()).select("id", "project", "asserted_at", F.explode(_word_set("content")).alias("word"))
    near = given.withColumn("stretch", F.explode(F.array(_stretch(F.col("asserted_at"), width), _stretch(F.col("asserted_at"), width) - 1)))
    wait = F.unix_micros("asserted_at") - F.unix_micros("at")
    return asked.join(near, ["project", "word", "stretch"]).where((wait >= 0) & (wait <= width) & F.col("turn_id").isNotNull()).select("turn_id", "id").distinct()


def counted_before(points: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """``points`` (key, at, other columns) with ``n``: how many of ``events`` (key, at) of the key are earlier.

    Days are summed first, and only a day's own rows are ordered, so a hot key is
    split by day.
    """
    day = _stretch(F.col("at"), DAY)
    upto = Window.partitionBy(key).orderBy("day")
    there = F.lit(True)
    days = points.select(key, day.alias("day")).distinct().withColumn("c", F.lit(0)).unionByName(
        events.select(key, day.alias("day"), F.lit(1).alias("c"))).groupBy(key, "day").agg(F.sum("c").alias("c"))
    days = days.withColumn("earlier", F.sum("c").over(upto) - F.col("c")).select(key, "day", "earlier")
    both = points.withColumn("point", there).unionByName(events.select(key, "at"), allowMissingColumns=True).withColumn("day", day)
    # a point stands before an event of the same time, which isn't earlier
    within = Window.partitionBy(key, "day").orderBy("at", F.col("point").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = both.withColumn("today", F.count(F.when(F.col("point").isNull(), 1)).over(within)).where(F.col("point"))
    return marked.join(days, [key, "day"]).withColumn("n", F.col("today") + F.col("earlier")).select(*points.columns, "n")


def recurrence(rules: DataFrame, messages: DataFrame, sessions: DataFrame, days: int = 14, skip_hours: int = 2, shared: int = 2) -> DataFrame:
    """(id, pre, post, pre_sessions, post_sessions): corrections like a rule in the ``days`` before it and after it.

    ``rules`` is (id, project, at, content), ``messages`` (msg_id, project, at,
    text) the corrections, ``sessions`` (project, at) the starts. A message is
    like a rule if ``shared`` terms are equal. Before is [at - days, at -
    skip_hours), after (at, at + days]. A rule without project holds for all;
    rules without time, or with fewer than ``shared`` terms, are left out.
    """
    width = days * DAY
    t = F.unix_micros("at")
    known = rules.where(F.col("at").isNotNull() & F.col("id").isNotNull()).select(
        "id", F.coalesce("project", F.lit(ALL)).alias("project"), "at", text.token_set(F.col("content")).alias("t")).where(F.size("t") >= shared)
    place = _stretch(F.col("at"), width)
    rule_terms = known.select("id", "project", t.alias("rule_at"), F.explode("t").alias("term"), F.array(place - 1, place, place + 1).alias("near"))
    rule_terms = rule_terms.withColumn("stretch", F.explode("near")).drop("near")
    said = messages.where(F.col("at").isNotNull()).select("msg_id", F.explode(F.array(F.col("project"), F.lit(ALL))).alias("project"), "at", "text")
    said = said.where(F.col("project").isNotNull()).select("msg_id", "project", t.alias("said_at"), place.alias("stretch"), F.explode(text.token_set(F.col("text"))).alias("term"))
    apart = F.col("said_at") - F.col("rule_at")
    before = (apart >= -width) & (apart < -skip_hours * 3_600_000_000)
    after = (apart > 0) & (apart <= width)
    alike = said.join(rule_terms, ["project", "term", "stretch"]).where(before | after).groupBy("id", "msg_id", after.alias("after")).agg(
        F.count("*").alias("n")).where(F.col("n") >= shared)
    per = alike.groupBy("id").agg(F.count_if(~F.col("after")).alias("pre"), F.count_if(F.col("after")).alias("post"))

    ends = {"a": -width, "b": -skip_hours * 3_600_000_000, "c": 1, "d": width + 1}
    points = known.select("id", "project", F.explode(F.array(*[
        F.struct(F.lit(name).alias("end"), F.timestamp_micros(t + F.lit(shift).cast("long")).alias("at")) for name, shift in ends.items()])).alias("p")).select(
        "id", "project", "p.end", "p.at")
    starts = sessions.where(F.col("at").isNotNull()).select(F.explode(F.array(F.col("project"), F.lit(ALL))).alias("project"), "at").where(F.col("project").isNotNull())
    counts = counted_before(points, starts, "project").groupBy("id").agg(*[F.max(F.when(F.col("end") == e, F.col("n"))).alias(e) for e in ends])
    return counts.select("id", (F.col("b") - F.col("a")).alias("pre_sessions"), (F.col("d") - F.col("c")).alias("post_sessions")).join(per, "id", "left").select(
        "id", F.coalesce("pre", F.lit(0)).alias("pre"), F.coalesce("post", F.lit(0)).alias("post"), "pre_sessions", "post_sessions")


def reduction(per_rule: DataFrame) -> DataFrame:
    """One row (n_rules, n_used, reduction): 1 less the rate per session after over that before.

    Rules with sessions on both sides count; of them those that had a like
    correction before. Null without any.
    """
    judged = per_rule.where((F.col("pre_sessions") > 0) & (F.col("post_sessions") > 0))
    pre, post = F.col("pre") / F.col("pre_sessions"), F.col("post") / F.col("post_sessions")
    used = F.col("pre") > 0
    return judged.agg(F.count("*").alias("n_rules"), F.count_if(used).alias("n_used"),
                      F.round(1 - F.try_divide(F.sum(F.when(used, post)), F.sum(F.when(used, pre))), 6).alias("reduction"))


def without_repeats(rows: DataFrame, column: str, at: str) -> DataFrame:
    """``rows`` without those whose text was said within a day before, whether or not that one was kept; equal times count once.

    Rows of one text are ordered within their day; the last of the day before is
    joined, so a text that holds a third of the rows is split by day. Rows
    without text or time are left out.
    """
    known = rows.where(F.col(column).isNotNull() & F.col(at).isNotNull()).dropDuplicates([column, at]).withColumn("_day", _stretch(F.col(at), DAY))
    last = known.groupBy(F.col(column), (F.col("_day") + 1).alias("_day")).agg(F.max(at).alias("_before"))
    lag = F.lag(at).over(Window.partitionBy(column, "_day").orderBy(at))
    joined = known.withColumn("_lag", lag).join(last, [column, "_day"], "left").withColumn("_said", F.coalesce("_lag", "_before"))
    fresh = F.col("_said").isNull() | (F.unix_micros(at) - F.unix_micros("_said") > DAY)
    return joined.where(fresh).select(rows.columns)


def activity_curve(messages: DataFrame, days: list[int]) -> DataFrame:
    """(d, n, alive): of the messages (project, at) with ``d`` days left to the end, the share whose project speaks ``d`` days later still."""
    known = messages.where(F.col("project").isNotNull() & F.col("at").isNotNull()).select("project", F.unix_micros("at").alias("t"))
    last = known.groupBy("project").agg(F.max("t").alias("last"))
    end = last.agg(F.max("last").alias("end"))
    wide = known.join(small(last), "project").join(F.broadcast(end))  # one row
    sums = wide.agg(*[F.count_if(F.col("end") - F.col("t") >= d * DAY).alias(f"n{d}") for d in days],
                    *[F.count_if((F.col("end") - F.col("t") >= d * DAY) & (F.col("last") >= F.col("t") + d * DAY)).alias(f"a{d}") for d in days])
    points = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"n{d}").alias("n"), F.col(f"a{d}").alias("a")) for d in days]))
    return sums.select(points.alias("p")).select("p.d", "p.n", F.round(F.try_divide("p.a", "p.n"), 6).alias("alive"))


def half_life(curve: DataFrame, least: int = 1000) -> DataFrame:
    """One row (n_points, half_life): least squares through the origin of -log2(alive) on d; null without a point.

    Points of fewer than ``least`` rows, and those at 0 or 1, say nothing.
    """
    fall = -F.log("alive") / F.lit(math.log(2))
    used = curve.where((F.col("alive") > 0) & (F.col("alive") < 1) & (F.col("n") >= least))
    return used.agg(F.count("*").alias("n_points"), F.round(F.try_divide(F.sum(F.col("d") * F.col("d")).cast("double"), F.sum(F.col("d") * fall)), 4).alias("half_life"))
