"""Links between entries: shared tags and entities, and newer entries that supersede older ones.

Both take a stated set of asked entries against all others; the asked side is
counted before it is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..session import cut, small, stored
from .blocks import Best, Block, Others, against, places


#: What a text says that revises an earlier one; fixed values.
REVISION_MARKERS = ("改为|改成|换成|改用|不再|取消|作废|废弃|以后|今后|从现在起|从今天起|最终|而是|代替|取代|替换|新定|更正|纠正"
                    "|instead|no longer|from now on|replace")


def hundredth(id_: str):
    """Whether an id is divisible by 100: text ids by the number their hex digits make."""
    return F.pmod(F.conv(F.substring(id_, 2, 10), 16, 10).cast("long"), F.lit(100)) == 0


def structural_links(tags: DataFrame, entities: DataFrame, asked: DataFrame, most: int = 3, hot: float = 0.02) -> DataFrame:
    """(id, other, score): per asked entry (id) the entries that share most; an entity counts 2, a tag 1, ties by id.

    Exact whatever the skew. Pairs are made from the lists of items that at most
    a share ``hot`` of the entries hold, and scored over all items. An entry that
    shares hot items only is told by its set of hot items: of each such set the
    first ids are enough, since all members score alike and ties go by id. So a
    hot item's list never meets the asked entries. Null ids and items are left
    out; repeated rows count once.
    """
    both = tags.select(F.col("memory_id").alias("id"), F.concat(F.lit("t:"), F.lower(F.trim("tag"))).alias("item"), F.lit(1).alias("weight")).unionByName(
        entities.select(F.col("memory_id").alias("id"), F.concat(F.lit("e:"), F.lower(F.trim("entity"))).alias("item"), F.lit(2).alias("weight")))
    items = cut(both.where(F.col("id").isNotNull() & F.col("item").isNotNull()).distinct())
    bound = items.select("id").distinct().count() * hot
    hot_items = small(items.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") > bound).select("item", F.lit(True).alias("hot")))
    marked = items.join(hot_items, "item", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    mine = cut(marked.join(small(asked), "id", "left_semi"))
    rare = marked.where(~F.col("hot")).select(F.col("id").alias("other"), "item", "weight").join(
        small(mine.where(~F.col("hot")).select("id", "item")), "item").where(F.col("id") != F.col("other"))
    rare = rare.groupBy("id", "other").agg(F.sum("weight").alias("rare"))

    # of the pairs with a rare item the hot ones count too; both sides carry them as a short list
    hot_set = F.array_sort(F.collect_list(F.when(F.col("hot"), F.struct("item", "weight"))))
    sets = cut(marked.groupBy("id").agg(hot_set.alias("s")).where(F.size("s") > 0))
    asked_sets = sets.join(small(mine.select("id").distinct()), "id", "left_semi")
    common = F.aggregate(F.array_intersect("s", "u"), F.lit(0).cast("long"), lambda n, x: n + x["weight"])
    met = rare.join(asked_sets, "id", "left").join(sets.select(F.col("id").alias("other"), F.col("s").alias("u")), "other", "left")
    near = met.select("id", "other", (F.col("rare") + F.coalesce(common, F.lit(0))).alias("score"))

    first = F.row_number().over(Window.partitionBy("s").orderBy("id"))
    heads = sets.withColumn("k", first).where(F.col("k") <= most + 1).select(F.col("id").alias("other"), F.col("s").alias("u"))
    kinds = asked_sets.select("s").distinct()
    by_item = kinds.select("s", F.explode("s.item").alias("item"))
    meet = heads.select("other", "u", F.explode("u.item").alias("item")).join(small(by_item), "item").select("s", "other", "u").distinct()
    place = F.row_number().over(Window.partitionBy("s").orderBy(F.col("score").desc(), "other"))
    best = meet.select("s", "other", common.alias("score")).withColumn("k", place).where(F.col("k") <= most + 1)
    far = asked_sets.join(best.drop("k"), "s").where(F.col("id") != F.col("other")).select("id", "other", "score")

    scored = near.unionByName(far).groupBy("id", "other").agg(F.max("score").alias("score"))
    order = Window.partitionBy("id").orderBy(F.col("score").desc(), "other")
    return scored.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most).select("id", "other", "score")


def later_overlaps(entries: DataFrame, asked: DataFrame, groups: list[str], least: float, marked: float | None = None, gap_seconds: int = 0) -> DataFrame:
    """(id, newer, at, overlap): per asked entry each later one with equal ``groups`` whose terms overlap by ``least``.

    ``entries`` is (id, groups, at, content); later means by more than
    ``gap_seconds``, or by any time where that is 0. An overlap of ``marked`` is
    enough if the newer text holds a revision marker. An entry has one row per
    id; whole repeats count once, and one without group, text or time has no
    partner.

    Candidates come from lists of (groups, token), not from all pairs of a
    group. The overlap is counted against the smaller set, of whose n tokens
    ceil(share * n) must be met, so one of its n - ceil(share * n) + 1 rarest
    stands in the other: either the asked entry's rarest tokens or the newer
    one's are looked up, never the frequent ones.
    """
    rows = cut(entries.where(F.col("content").isNotNull() & F.col("at").isNotNull()).select(
        "id", *groups, "at", text.token_set(F.col("content")).alias("t"), F.col("content").rlike(f"(?i){REVISION_MARKERS}").alias("revises")).distinct())
    key = [*groups, "token"]
    mine = rows.join(small(asked), "id", "left_semi").withColumnRenamed("at", "since")
    wanted = cut(mine.select("id", *groups, "since", F.size("t").alias("n"), F.explode("t").alias("token")))
    held = rows.select(F.col("id").alias("newer"), *groups, "at", "revises", F.size("t").alias("m"), F.explode("t").alias("token"))
    # only lists of tokens that an asked entry holds can give a pair; a token no list has is rarest of all
    held = cut(held.join(small(wanted.select(*key).distinct()), key, "left_semi"))
    df = held.groupBy(*key).agg(F.count("*").alias("df"))

    def rarest(tokens: DataFrame, who: str, size: str, keep: list[str], share: Column) -> DataFrame:
        """The tokens among the rarest n - ceil(share * n) + 1; those without a list come first, so that ``size`` less the listed ones are used up."""
        order = Window.partitionBy(who).orderBy("df", "token")
        listed = F.count("*").over(Window.partitionBy(who))
        place = F.row_number().over(order) + F.col(size) - listed
        needed = F.ceil(F.col(size) * (share - 5e-7))
        return tokens.join(df, key).withColumn("place", place).where(F.col("place") <= F.col(size) - needed + 1).select(*keep, *key, "place")

    low = least if marked is None else min(least, marked)
    later = F.unix_micros("at") - F.unix_micros("since") >= max(1, gap_seconds * 1_000_000)
    a = rarest(wanted, "id", "n", ["id", "since", "n"], F.lit(low))
    strict = F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(least - 5e-7)) + 1
    one = held.select("newer", *key, "at", "revises").join(small(cut(a)), key).where(later & (strict | F.col("revises"))).select("id", "newer")
    b = rarest(held, "newer", "m", ["newer", "at"], F.when(F.col("revises"), low).otherwise(least))
    two = b.join(small(wanted.select("id", "since", *key)), key).where(later).select("id", "newer")
    pairs = cut(one.unionByName(two).distinct())

    right = rows.select(F.col("id").alias("newer"), "at", F.col("t").alias("u"), "revises")
    met = right.join(small(pairs), "newer").join(small(cut(mine.select("id", "t"))), "id")
    scored = met.select("id", "newer", "at", "revises", F.round(text.overlap(F.col("t"), F.col("u")), 6).alias("overlap"))
    enough = F.col("overlap") >= least
    if marked is not None:
        enough = enough | (F.col("revises") & (F.col("overlap") >= marked))
    return scored.where(enough).drop("revises")


def superseded(entries: DataFrame, asked: DataFrame, least: float = 0.5, marked: float | None = 0.35) -> DataFrame:
    """(id, newer, overlap): per asked entry the newer one of the same kind and project whose terms overlap most.

    An overlap of ``marked`` is enough if the newer text holds a revision marker;
    None leaves that tier out. Ties go to the later, then to the smaller id. A
    null project is a project of its own; an entry without kind has no partner.
    """
    rows = entries.select("id", "kind", F.coalesce("project", F.lit("")).alias("project"), F.col("valid_at").alias("at"), "content")
    order = Window.partitionBy("id").orderBy(F.col("overlap").desc(), F.col("at").desc(), "newer")
    return later_overlaps(rows, asked, ["kind", "project"], least, marked).withColumn("pos", F.row_number().over(order)).where(
        F.col("pos") == 1).select("id", "newer", "overlap")


def first_later(entries: DataFrame, asked: DataFrame, least: float = 0.3, gap_seconds: int = 60) -> DataFrame:
    """(id, newer, overlap, days): per asked entry the first of its project, a minute or more later, that overlaps by ``least``.

    Of equal times the smaller id is taken; ``days`` is the time between. Shared
    tokens are counted in the tasks, and only an entry's first of a task leaves
    it. An entry has one row per id; whole repeats count once, and one without
    text or time has no partner.
    """
    rows = stored(entries.where(F.col("id").isNotNull() & F.col("content").isNotNull() & F.col("asserted_at").isNotNull()).select(
        "id", F.coalesce("project", F.lit("")).alias("project"), F.unix_micros("asserted_at").alias("at"), text.token_set(F.col("content")).alias("t")).distinct().where(F.size("t") > 0))
    mine = cut(rows.join(small(asked), "id", "left_semi"))
    found = against(mine, rows, "project", _first_later(least, gap_seconds * 1_000_000), "id string, newer string, at long, since long, overlap double")
    first = found.groupBy("id").agg(F.min(F.struct("at", "newer", "overlap", "since")).alias("m"))
    return first.select("id", "m.newer", F.round("m.overlap", 6).alias("overlap"), F.round((F.col("m.at") - F.col("m.since")) / 86_400_000_000, 4).alias("days"))


def _first_later(least: float, gap: int):
    """The function that ``against`` calls for a block of asked rows."""

    def of_block(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, overlap = Best(block.n), np.zeros(block.n)
            for batch in batches:
                others = Others(batch, block)
                for project, held in places(others.column["project"]).items():
                    lo, end = block.slices.get(project, (0, 0))
                    for some in others.pieces(np.array(held), end - lo):
                        ids = others.column["id"][some]
                        order = np.lexsort((ids, others.at[some]))
                        some, ids = some[order], ids[order]
                        at, size = others.at[some], others.size[some]
                        hi = lo + np.searchsorted(block.at[lo:end], at[-1] - gap, "right")  # later ones have no partner here
                        if lo == hi:
                            continue
                        shared = block.shared(np.arange(lo, hi), others, some)
                        fewer = np.minimum(block.size[lo:hi, None], size)
                        enough = (shared >= fewer * (least - 5e-7)) & (at >= block.at[lo:hi, None] + gap)
                        rows = np.flatnonzero(enough.any(axis=1))
                        place = enough[rows].argmax(axis=1)  # of the earliest, and of the smallest id
                        first.offer(lo + rows, -at[place].astype(float), ids[place])
                        mine = first.tie[lo + rows] == ids[place]
                        overlap[lo + rows[mine]] = (shared[rows, place] / fewer[rows, place])[mine]
            rows = np.flatnonzero(first.score > -np.inf)
            if len(rows):
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array([block.column["id"][i] for i in rows], pa.string()), "newer": pa.array(first.tie[rows], pa.string()),
                    "at": pa.array((-first.score[rows]).astype(np.int64)), "since": pa.array(block.at[rows]), "overlap": pa.array(overlap[rows])})

        return run

    return of_block
