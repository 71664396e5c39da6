"""Budget fills look at every entry of a project."""

from pyspark.sql import functions as F

from mnemospark.operators import store
from mnemospark.plans import store_queries

SCHEMA = ("id string, kind string, content string, source string, scope string, project string, valid_at timestamp, asserted_at timestamp, "
          "expires_at timestamp, importance int, confidence double, reinforcement int, last_hit_at timestamp, file string, status string, "
          "merged_from array<string>")


def memories(spark, path, entries):
    rows = [(id_, "fact", content, None, "project", "p", None, None, None, importance, None, None, None, None, None, None)
            for id_, content, importance in entries]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/memories.parquet")
    return str(path)


def test_greedy_fill_takes_a_late_entry_that_fits(spark, tmp_path):
    long = [(f"m{k:03d}", "x" * 4768, 9) for k in range(60)]  # 1200 tokens each: one fills the budget, none fits beside another
    d = memories(spark, tmp_path, [("a", "x" * 400, 10), *long, ("z1", "x" * 4, 2), ("z2", None, 2), ("z3", "x" * 4, 1)])
    got = sorted(tuple(x) for x in store_queries.budget_greedy(spark, d).collect())
    assert got == [("p", "a", 1, 108), ("p", "z1", 62, 9), ("p", "z3", 64, 9)]


def test_prefix_fill_takes_more_than_fifty_short_entries(spark, tmp_path):
    d = memories(spark, tmp_path, [(f"m{k:03d}", "abcd", 5) for k in range(200)])
    got = store_queries.budget_prefix(spark, d).collect()
    assert len(got) == 133 and max(x.used for x in got) == 1197


def test_a_stream_equals_the_array_form(spark):
    df = spark.range(300).selectExpr("concat('g', id % 3) as g", "format_string('%04d', id) as id", "cast(id * 37 % 91 + 8 as long) as cost")
    got = {(x.g, x.id) for x in store.greedy_stream(df, "g", ["id"], "cost", 500).collect()}
    arrays = df.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("id", "cost"))).alias("items"))
    want = {(r.g, x.id) for r in arrays.select("g", store.greedy_fill(F.col("items"), "cost", 500).alias("t")).collect() for x in r.t}
    assert got == want
