"""Ranked retrieval for many queries at once: postings, BM25, vectors, fusion, diversity, budget.

Queries are a DataFrame (query_id, text). Documents are (doc_id, text) with any
id type. A search is a join of the queries' terms with the postings on the term,
so its cost follows the postings of the terms asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..session import cut, small

#: Parameters of BM25; fixed values.
K1, B = 1.2, 0.75
#: Constant of reciprocal rank fusion.
RRF_K = 20


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf). Nothing else is computed beside the explode, or Spark would split the text again for each term."""
    return docs.select("doc_id", F.explode(text.terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, most: int = 64) -> DataFrame:
    """(query_id, term): the first ``most`` distinct terms of each query."""
    return queries.select("query_id", F.explode(F.slice(text.token_set(F.col("text")), 1, most)).alias("term"))


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, matched) of every document with a term of the query.

    Only postings of asked terms are kept (semi join) before document
    frequencies are counted; lengths come from the documents themselves. What a
    term adds to a document doesn't depend on the query, so it is computed once,
    before the queries' terms meet it.
    """
    asked = cut(query_terms(queries))
    sizes = docs.select("doc_id", F.size(text.terms(F.col("text"))).alias("length"))
    stats = sizes.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length")).first()
    wanted = cut(postings(docs).join(small(asked.select("term").distinct()), "term", "left_semi"))
    n_docs, average = F.lit(stats["n_docs"]), F.lit(float(stats["avg_length"] or 1.0))
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / average))
    scored = wanted.join(sizes, "doc_id").join(small(idf), "term").select("doc_id", "term", (F.col("idf") * tf).alias("s"))
    return scored.join(small(asked), "term").groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"), F.count("*").alias("matched"))


def top(scored: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The n best documents per query with ``rank`` from 1; ties by doc_id."""
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def qualifies(matched: Column, n_terms: Column, floor: float = 0.5, low: float = 0.15) -> Column:
    """Coverage gate: enough of the query's terms, or two of them and a little coverage."""
    share = matched / n_terms
    return (share >= floor) | ((matched >= 2) & (share >= low))


def fuse(lists: list[tuple[str, DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (channel, ranked list, weight): (query_id, doc_id, score, channels)."""
    every = None
    for channel, ranked, weight in lists:
        part = ranked.select("query_id", "doc_id", (F.lit(weight) / (k + F.col("rank"))).alias("s"), F.lit(channel).alias("channel"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"), F.array_sort(F.collect_set("channel")).alias("channels"))


def tag_channel(asked: DataFrame, tags: DataFrame, docs: DataFrame, n: int = 16) -> DataFrame:
    """Documents whose tags are terms of the query, most shared first; ``asked`` is (query_id, term), ``tags`` (memory_id, tag)."""
    named = tags.select(F.col("memory_id").alias("doc_id"), F.lower(F.trim("tag")).alias("term")).distinct()
    met = named.join(small(asked), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("score"))
    return top(met.join(docs.select("doc_id"), "doc_id", "left_semi"), n)


def graph_channel(seeds: DataFrame, edges: DataFrame, docs: DataFrame, per_seed: int = 3) -> DataFrame:
    """Neighbours of each query's seeds, in either direction, that are no seeds: ``per_seed`` by id, in order of their seed.

    ``seeds`` is (query_id, doc_id, rank), ``edges`` (from_id, to_id).
    """
    both = edges.select(F.col("from_id").alias("seed"), F.col("to_id").alias("doc_id")).unionByName(
        edges.select(F.col("to_id").alias("seed"), F.col("from_id").alias("doc_id"))).distinct()
    near = both.join(small(seeds.select("query_id", F.col("doc_id").alias("seed"), F.col("rank").alias("seed_rank"))), "seed")
    new = near.join(docs.select("doc_id"), "doc_id", "left_semi").join(seeds.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id", "seed").orderBy("doc_id"))
    first = new.withColumn("place", place).where(F.col("place") <= per_seed).groupBy("query_id", "doc_id").agg(F.min("seed_rank").alias("seed_rank"))
    w = Window.partitionBy("query_id").orderBy("seed_rank", "doc_id")
    return first.withColumn("rank", F.row_number().over(w)).select("query_id", "doc_id", "rank")


def demoted(hits: DataFrame, entries: DataFrame, factor: float = 0.1, least: float = 0.5) -> DataFrame:
    """``hits`` (query_id, doc_id, score) with ``superseded`` and the score cut where a newer hit of the same query overlaps.

    Only a query's own hits meet, which the caller has limited. ``entries`` is
    (doc_id, kind, project, valid_at, t).
    """
    full = hits.join(entries, "doc_id").withColumn("project", F.coalesce("project", F.lit("")))
    newer = full.select("query_id", "kind", "project", F.col("valid_at").alias("at"), F.col("t").alias("u"))
    beaten = full.join(newer, ["query_id", "kind", "project"]).where(
        (F.col("at") > F.col("valid_at")) & (F.round(text.overlap(F.col("t"), F.col("u")), 6) >= least))
    flags = beaten.select("query_id", "doc_id").distinct().withColumn("superseded", F.lit(True))
    out = hits.join(flags, ["query_id", "doc_id"], "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))
    return out.withColumn("score", F.when(F.col("superseded"), F.col("score") * factor).otherwise(F.col("score")))


#: Queries that meet all vectors in one pass; a block goes to the tasks as a matrix.
BLOCK = 5_000
#: Cells of the score matrix a task holds at once.
CELLS = 4_000_000


def unit_rows(vectors: list) -> np.ndarray:
    """Vectors of one length as the rows of a matrix, at length 1; zero vectors stay."""
    m = np.array([np.asarray(v, dtype=float) for v in vectors])
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=m, where=norm > 0)


def best_of_batches(asked: dict[int, tuple[list, np.ndarray]], n: int, floor: float):
    """Per batch of (doc_id, v) each query's n + 1 best documents; of a document's vectors the best counts.

    ``asked`` has for each vector length the queries' ids and unit matrix. A
    document that is among the n best of all is so in the batch that holds its
    best vector. Scores are rounded to 12 places, so that equal vectors tie.
    """

    def part(docs: pd.Series, vectors: list, ids: list, q: np.ndarray) -> pd.DataFrame:
        scores = np.nan_to_num(np.round(unit_rows(vectors) @ q.T, 12), nan=-np.inf)
        codes, names = pd.factorize(docs)
        order = np.argsort(codes, kind="stable")
        scores = np.maximum.reduceat(scores[order], np.flatnonzero(np.diff(codes[order], prepend=-1)), axis=0)
        k = min(n + 1, len(names))
        edge = np.maximum(np.partition(scores, len(names) - k, axis=0)[len(names) - k], floor)
        row, col = np.nonzero((scores >= edge) & np.isfinite(scores))
        out = pd.DataFrame({"query_id": np.array(ids, dtype=object)[col], "doc_id": np.array(names, dtype=object)[row], "score": scores[row, col], "q": col})
        return out.sort_values(["q", "score", "doc_id"], ascending=[True, False, True]).groupby("q").head(n + 1)[["query_id", "doc_id", "score"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lengths = b["v"].map(len, na_action="ignore")
            for length, (ids, q) in asked.items():
                rows = b[lengths == length]
                step = max(1, CELLS // len(ids))
                for i in range(0, len(rows), step):
                    some = rows.iloc[i:i + step]
                    yield part(some["doc_id"], some["v"].tolist(), ids, q)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, n: int, floor: float = -1.0, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank): the n documents of highest cosine per query, the query's own id left out.

    ``vectors`` is (doc_id, v), ``queries`` (query_id, v). A document may have
    several vectors; its best one counts, and repeated rows count once. Null
    ids, null vectors and vectors of another length than the query's have no
    score; ties go by doc_id. The stated queries are met with all rows in blocks
    of about ``block`` queries, hashed by id: a block goes to the tasks as a
    matrix, and only the n best per batch are shuffled. Exact, one pass of the
    vectors a block.
    """
    kinds = {**dict(vectors.dtypes), **dict(queries.dtypes)}
    schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double"
    # null vectors are left to the tasks: Spark can't filter by a vector that a Python function makes
    known = vectors.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("v").cast("array<double>").alias("v"))
    asked = queries.where(F.col("query_id").isNotNull()).select("query_id", F.col("v").cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // block))
    best = known.sparkSession.createDataFrame([], schema)
    for b in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        by_length: dict[int, dict] = {}
        for r in some.collect():  # one block
            by_length.setdefault(len(r["v"] or ()), {})[r["query_id"]] = r["v"]
        matrices = {k: (list(rows), unit_rows(list(rows.values()))) for k, rows in by_length.items() if k}
        best = best.unionByName(known.mapInPandas(best_of_batches(matrices, n, floor), schema))
    met = best.where(F.col("doc_id").cast("string") != F.col("query_id").cast("string"))
    return top(met.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), n)


def diversify(lam: float, pick: int):
    """Maximal marginal relevance within one query's candidates, which the caller has limited."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "doc_id"], ascending=[False, True], ignore_index=True)
        sets = [set(t) for t in rows["terms"]]
        best = rows["score"].max() or 1.0
        left, chosen = list(range(len(rows))), []
        closest = [0.0] * len(rows)
        while left and len(chosen) < pick:
            k = max(left, key=lambda i: (lam * rows["score"][i] / best - (1 - lam) * closest[i], -i))
            left.remove(k)
            chosen.append(k)
            for i in left:
                union = len(sets[i] | sets[k])
                closest[i] = max(closest[i], len(sets[i] & sets[k]) / union if union else 0.0)
        out = rows.loc[chosen, ["query_id", "doc_id", "score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return run


def mmr(candidates: DataFrame, lam: float = 0.7, pick: int = 8) -> DataFrame:
    """(query_id, doc_id, score, rank) of the picked ones; ``candidates`` is limited per query and has ``terms``."""
    kind = dict(candidates.dtypes)
    schema = f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, score double, rank long"
    return candidates.select("query_id", "doc_id", "score", "terms").groupBy("query_id").applyInPandas(
        diversify(lam, pick), schema)


def abstains(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, abstain): true if the query names something in Latin script that stands in no hit as a whole word.

    ``hits`` is (query_id, text); a query without such a name never abstains.
    """
    names = queries.select(
        "query_id", F.explode(F.filter(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)),
                                       lambda x: x.rlike("^([A-Z][a-z]{3,}|[A-Z]{2,})$"))).alias("name")).distinct()
    seen = names.join(hits, "query_id").groupBy("query_id").agg(
        F.bool_or(F.array_contains(text.words(F.col("text")), F.lower("name"))).alias("seen"))
    asked = names.select("query_id").distinct().withColumn("named", F.lit(True))
    return queries.select("query_id").join(asked, "query_id", "left").join(seen, "query_id", "left").select(
        "query_id", (F.coalesce("named", F.lit(False)) & ~F.coalesce("seen", F.lit(False))).alias("abstain"))
