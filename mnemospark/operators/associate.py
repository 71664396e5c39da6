"""What becomes of a new entry beside the earlier ones: a duplicate, linked, or added."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import BROADCAST_ROWS, cut, small, stored
from .blocks import Best, Block, Others, against, likeness, places

#: Share of a new entry's tokens that an earlier one must hold for a duplicate; likeness for a link; tokens below which nothing is a duplicate.
MERGE, LINK, EVIDENCE = 0.75, 0.3, 5
#: Share of an earlier text's words without numbers that makes two texts be about one thing, and of a new text for it to be decisive.
FRAME = 0.5
#: What signals an update, what denies, and what is a number; fixed values.
UPDATES = ("(改为|改成|更新为|修正为|纠正为|替换为|不再|别再|废弃|弃用|作废|取而代之|迁移到|切换到"
           "|renamed to|changed to|no longer|deprecated|migrated to|replaced by)")
NEGATIONS = r"(不|别|无需|不再|避免|禁止|拒绝|never|avoid|not\b|without)"
NUMBER = r"\d+(?:\.\d+)?%?"


def contenders(asked: DataFrame, others: DataFrame, by_kind: bool) -> DataFrame:
    """(id, other): of the earlier others that hold ``LINK`` of an asked row's tokens the one of best coverage and the one of best likeness.

    Both have (id, at, t, f, kind). With ``by_kind`` that is the best coverage of
    all, and the best coverage and likeness among those of the asked row's kind.
    Equal fingerprints count as full cover; ties go to the smaller id.
    """
    found = against(asked, others, None, _contending(by_kind), "id string, role string, score double, other string")
    best = found.groupBy("id", "role").agg(F.min_by("other", F.struct(-F.col("score"), F.col("other"))).alias("other"))
    return best.select("id", "other").distinct()


def _contending(by_kind: bool):
    """The function that ``against`` calls for a block of asked rows."""

    def of_block(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            need = np.ceil(np.round(block.size * LINK, 9))
            names = np.array(block.column["id"], dtype=object)
            in_order = np.sort(names)
            rank = np.searchsorted(in_order, names)
            prints, kinds = ({x: np.array(rows) for x, rows in places(block.column[c]).items()} for c in ("f", "kind"))
            best = {role: Best(block.n) for role in (("cover", "kind cover", "like") if by_kind else ("cover", "like"))}

            def offer(role: str, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, least: np.ndarray | float, divide: bool) -> None:
                first = scores.argmax(axis=1)  # the smallest id of equal scores
                top = scores[np.arange(len(rows)), first].astype(float)
                keep = np.flatnonzero(top >= least)
                top = top[keep] / block.size[rows[keep]] if divide else top[keep]
                best[role].offer(rows[keep], np.round(top, 6), ids[first[keep]])

            for batch in batches:
                others = Others(batch, block)
                for some in others.pieces(np.arange(batch.num_rows), block.n):
                    ids = others.column["id"][some]
                    order = np.argsort(ids, kind="stable")
                    some, ids = some[order], ids[order]
                    at = others.at[some]
                    lo, hi = np.searchsorted(block.at, at.min(), "left"), np.searchsorted(block.at, at.max(), "right")
                    if lo == block.n:
                        continue
                    # exact: an asked row with a better one in hand than its tokens here allow can't find its best among these
                    most = block.at_most(others, some)
                    in_hand = np.minimum.reduce([np.maximum(b.score, LINK if role == "like" else need / block.size) for role, b in best.items()])
                    able = (most >= need) & (most / block.size >= in_hand - 2e-6)
                    equal = [(rows, j) for j, x in enumerate(others.column["f"][some]) if (rows := prints.get(x)) is not None]
                    for rows, _ in equal:
                        able[rows] = True
                    every = np.flatnonzero(able[lo:]) + lo
                    if not len(every):
                        continue
                    line = np.full(block.n, -1)
                    line[every] = np.arange(len(every))
                    shared = block.shared(every, others, some)
                    # asked rows after hi are later than all of these
                    near = every[every < hi]
                    since = block.at[near, None]
                    earlier = at < since
                    if (same_time := at == since).any():
                        earlier |= same_time & (rank[near, None] >= np.searchsorted(in_order, ids, "right"))
                    shared[:len(near)][~earlier] = -1
                    equal = [(r[shared[line[r], j] >= need[r]], j) for rows, j in equal if len(r := rows[rows >= lo])]

                    def alike(rows: np.ndarray, columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
                        return likeness(counts, block.size[rows], others.size[some[columns]])

                    groups = [(every, np.arange(len(some)))]
                    if by_kind:
                        groups = [(mine[line[mine] >= 0], np.array(columns)) for x, columns in places(others.column["kind"][some]).items() if (mine := kinds.get(x)) is not None]
                    likes = [(rows, columns, alike(rows, columns, shared[np.ix_(line[rows], columns)] if by_kind else shared)) for rows, columns in groups if len(rows)]
                    for r, j in equal:
                        shared[line[r], j] = block.size[r]
                    offer("cover", every, shared, ids, need[every], True)
                    for rows, columns, like in likes:
                        for r, j in equal:
                            k = np.searchsorted(columns, j)
                            if k < len(columns) and columns[k] == j:
                                like[np.isin(rows, r), k] = 1
                        offer("like", rows, like, ids[columns], LINK - 1e-6, False)
                        if by_kind:
                            offer("kind cover", rows, shared[np.ix_(line[rows], columns)], ids[columns], need[rows], True)
            for role, b in best.items():
                rows = np.flatnonzero(b.score > -np.inf)
                if len(rows):
                    yield pa.RecordBatch.from_pydict({
                        "id": pa.array(names[rows], pa.string()), "role": pa.array([role] * len(rows), pa.string()),
                        "score": pa.array(b.score[rows], pa.float64()), "other": pa.array(b.tie[rows], pa.string())})

        return run

    return of_block


def compared(entries: DataFrame, asked: DataFrame, by_kind: bool = False) -> tuple[DataFrame, DataFrame]:
    """(asked rows, pairs): each asked entry (id) beside those earlier active ones that can decide, see ``contenders``.

    Pairs are (id, other, n, coverage, likeness, adds_name, same_kind, later,
    signals, conflicts). Earlier is by (asserted_at, id). Equal fingerprints
    count as full cover. Entries have one row per id.
    """
    content = F.col("content")
    rows = stored(entries.where(F.col("id").isNotNull() & content.isNotNull() & F.col("asserted_at").isNotNull()).select(
        "id", "status", "asserted_at", "kind", "valid_at", "content", text.token_set(content).alias("t"), text.fingerprint(content).alias("f")))
    mine = cut(rows.join(small(asked), "id", "left_semi"))
    others = rows.where(F.col("status") == "active")
    met_by = [F.col("id"), F.unix_micros("asserted_at").alias("at"), F.col("t"), F.col("f"), F.col("kind")]
    pairs = cut(contenders(mine.where(F.size("t") > 0).select(*met_by), others.where(F.size("t") > 0).select(*met_by), by_kind))
    # what costs a regular expression is read from the texts of the pairs only
    facts = ["kind", "valid_at", "t", "f", "content"]
    b = others.select(F.col("id").alias("other"), *facts).join(small(pairs, 5 * BROADCAST_ROWS), "other").select("id", "other", F.struct(*facts).alias("b"))
    met = b.join(small(mine.select("id", F.struct(*facts).alias("a"))), "id")
    t, u, same = F.col("a.t"), F.col("b.t"), F.col("a.f") == F.col("b.f")
    frame = F.filter(u, lambda x: ~x.rlike("^[0-9.]+%?$"))
    shared = F.try_divide(F.size(F.array_intersect(frame, t)), F.size(frame))
    numbers = [F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(f"({NUMBER})"), F.lit(1)))) for x in ("a.content", "b.content")]
    denies = [F.col(x).rlike(f"(?i){NEGATIONS}") for x in ("a.content", "b.content")]
    conflicts = F.when(numbers[0] != numbers[1], F.coalesce(shared >= FRAME, F.lit(False))).otherwise(denies[0] != denies[1])
    return mine, met.select(
        "id", "other", F.size(t).alias("n"), F.when(same, 1.0).otherwise(F.round(F.size(F.array_intersect(t, u)) / F.size(t), 6)).alias("coverage"),
        F.when(same, 1.0).otherwise(F.round(text.jaccard(t, u), 6)).alias("likeness"),
        (~same & F.exists(F.array_except(t, u), lambda x: x.rlike("[0-9a-zA-Z]"))).alias("adds_name"),
        F.col("a.kind").eqNullSafe(F.col("b.kind")).alias("same_kind"), F.coalesce(F.col("a.valid_at") >= F.col("b.valid_at"), F.lit(False)).alias("later"),
        F.col("a.content").rlike(f"(?i){UPDATES}").alias("signals"), conflicts.alias("conflicts"))


def decided(pairs: DataFrame) -> DataFrame:
    """(id, decision, other, coverage) of ``compared`` pairs; a null decision where no pair is enough."""
    best = pairs.groupBy("id").agg(
        F.min_by(F.struct("other", "coverage", "adds_name", "n"), F.struct(-F.col("coverage"), F.col("other"))).alias("c"),
        F.min_by(F.struct("other", "likeness", "coverage"), F.struct(-F.col("likeness"), F.col("other"))).alias("l"))
    covered = (F.col("c.coverage") >= MERGE) & (F.col("c.n") >= EVIDENCE) & ~F.col("c.adds_name")
    linked = F.col("l.likeness") >= LINK
    return best.select(
        "id", F.when(covered, "duplicate").when(linked, "link").alias("decision"),
        F.when(covered, F.col("c.other")).when(linked, F.col("l.other")).alias("other"),
        F.when(covered, F.col("c.coverage")).when(linked, F.col("l.coverage")).alias("coverage"))


def decisions(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, decision, other, coverage): per asked entry (id) what it is beside all earlier active ones.

    ``duplicate``: an earlier entry covers three quarters of its tokens, which
    are at least five, and what it adds names nothing in Latin letters or digits;
    ``link``: an earlier one is alike by three tenths; else ``add``. Ties go to
    the smaller id. An entry without tokens is added.
    """
    mine, pairs = compared(entries, asked)
    return mine.select("id").join(decided(pairs), "id", "left").select("id", F.coalesce("decision", F.lit("add")).alias("decision"), "other", "coverage")


def evolutions(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, action, other): per asked entry what it does to the earlier active ones.

    A rule is only added. Else the earlier entry that covers most of it, by half
    of at least five tokens, decides: ``supersede`` if the new text signals an
    update, is of the same kind and no earlier in validity; ``contradict`` if
    they are about one thing and differ in numbers or in denial. Otherwise it is
    a ``duplicate``, ``link`` or ``add`` as ``decisions`` has it among entries of
    its kind. Ties go to the smaller id.
    """
    mine, pairs = compared(entries, asked, by_kind=True)
    pairs = cut(pairs)
    best = pairs.groupBy("id").agg(F.min_by(F.struct("other", "coverage", "n", "same_kind", "later", "signals", "conflicts"), F.struct(-F.col("coverage"), F.col("other"))).alias("m"))
    enough = (F.col("m.coverage") >= FRAME) & (F.col("m.n") >= EVIDENCE)
    action = F.when(enough & F.col("m.signals") & F.col("m.same_kind") & F.col("m.later"), "supersede").when(enough & F.col("m.conflicts"), "contradict")
    strong = best.select("id", action.alias("action"), F.col("m.other").alias("target"))
    rule = F.coalesce(F.col("kind") == "rule", F.lit(False))
    out = mine.select("id", "kind").join(strong, "id", "left").join(decided(pairs.where("same_kind")), "id", "left")
    return out.select("id", F.when(rule, "add").otherwise(F.coalesce("action", "decision", F.lit("add"))).alias("action"),
                      F.when(~rule, F.when(F.col("action").isNotNull(), F.col("target")).otherwise(F.col("other"))).alias("other"))


def evidence(entries: DataFrame, origins: DataFrame) -> DataFrame:
    """(id, n_found, n_missing, first_at, last_at): what an entry was derived from, by (id, origin), and what of it is gone."""
    known = entries.select(F.col("id").alias("origin"), "valid_at", F.lit(1).alias("there"))
    return origins.distinct().join(known, "origin", "left").groupBy("id").agg(
        F.count("there").alias("n_found"), F.count_if(F.col("there").isNull()).alias("n_missing"),
        F.min("valid_at").alias("first_at"), F.max("valid_at").alias("last_at"))


def themes(entries: DataFrame, tags: DataFrame, lexicons: dict[str, str], least: int = 2) -> DataFrame:
    """(theme, n): entries by the first theme whose words they hold; the rest by each tag that ``least`` of them share."""
    label = text.first_label(F.col("content"), lexicons, "")
    marked = entries.select("id", label.alias("theme"))
    named = marked.where(F.col("theme") != "").groupBy("theme").agg(F.count("*").alias("n"))
    tag = F.lower(F.trim("tag"))
    rest = tags.where(tag != "").select(F.col("memory_id").alias("id"), F.concat(F.lit("#"), tag).alias("theme")).distinct().join(
        marked.where(F.col("theme") == "").select("id"), "id", "left_semi")
    return named.unionByName(rest.groupBy("theme").agg(F.count("*").alias("n")).where(F.col("n") >= least))


def removed(entries: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, edges) after the entries ``gone`` (id) are taken out, with every edge that ends in one."""
    left = entries.join(gone, "id", "left_anti")
    cut_off = edges.join(gone.select(F.col("id").alias("from_id")), "from_id", "left_anti")
    return left, cut_off.join(gone.select(F.col("id").alias("to_id")), "to_id", "left_anti").select(edges.columns)
