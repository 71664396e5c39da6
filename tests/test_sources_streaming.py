"""Files in and out, and the streaming forms against their batch forms."""

import json

from pyspark.sql import functions as F

from mnemospark.operators import ledger
from mnemospark.sources import jsonl, markdown
from mnemospark.streaming import episodes

BLOCKS = """---
id: m1
kind: fact
tags: ["#Config", "42", "null", "a b"]
mood: calm
---
First line
second line

---
id: m2
kind: lesson
tags: x, y
---
Other
---
kind: fact
---
no id
"""


def test_blocks_fields_tags_and_unknown_lines(spark, tmp_path):
    (tmp_path / "daily").mkdir()
    (tmp_path / "daily" / "a.md").write_bytes(BLOCKS.replace("\n", "\r\n").encode())
    (tmp_path / "daily" / "b.txt").write_text("---\nid: no\n---\nx\n")
    rows = markdown.parse_entries(markdown.read_files(spark, str(tmp_path)))
    got = {r.id: (r.content, r.tags, r.extra, r.valid) for r in rows.collect()}
    assert got["m1"] == ("First line\nsecond line", ["config", "a b"], ["mood: calm"], True)
    assert got["m2"] == ("Other", ["x", "y"], [], True)
    assert got[None][3] is False
    assert sorted(r.id for r in markdown.latest_of_ids(rows).collect()) == ["m1", "m2"]


def test_pages_are_cut_at_headings(spark):
    files = spark.createDataFrame([("f", "# Page\nintro\n## One\na\n## Two\nb"), ("g", "\n \n"), ("h", None)], "file string, body string")
    got = [(r.id[-3:], r.title) for r in markdown.slices(files).orderBy("id").collect()]
    assert got == [("-s0", "Page"), ("-s1", "One"), ("-s2", "Two")]
    later = spark.createDataFrame([("f", "# Page\nintro\n## One\nchanged")], "file string, body string")
    change = markdown.changed_slices(markdown.slices(files), markdown.slices(later))
    assert sorted(r.change for r in change.collect()) == ["removed", "unchanged", "updated"]


LINES = [
    {"id": "e1", "session": "s", "turn": 1, "role": "user", "text": "hi", "at": "2026-01-01T00:00:00Z"},
    {"id": "e1", "session": "s", "turn": 1, "role": "user", "text": "again", "at": "2026-01-01T00:00:09Z"},
    {"id": "e2", "session": "s", "turn": 1, "role": "system", "text": "x", "at": "2026-01-01T00:00:01Z"},
    {"id": "e3", "session": "s", "turn": 1, "role": "assistant", "text": "yo", "at": "2026-01-01T01:00:00Z"},
]


def write_lines(folder):
    folder.mkdir()
    (folder / "2026-01-01.jsonl").write_text("\n".join(map(json.dumps, LINES)) + "\n{broken\n")


def test_episode_files(spark, tmp_path):
    write_lines(tmp_path / "log")
    got = jsonl.read_episodes(spark, str(tmp_path / "log"))
    assert sorted((r.id, r.text) for r in got.collect()) == [("e1", "hi"), ("e3", "yo")]
    jsonl.append(got, str(tmp_path / "out"))
    assert jsonl.read_episodes(spark, str(tmp_path / "out")).count() == 2
    assert jsonl.capped_per_day(got, "at", 1, "id").count() == 1


def test_import_states(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, content string")
    new = spark.createDataFrame([("a", "x"), ("b", "z"), ("c", "n"), (None, "q"), ("d", " ")], "id string, content string")
    got = sorted((r.id or "", r.state) for r in jsonl.import_states(old, new, "id", "content").collect())
    assert got == [("", "malformed"), ("a", "unchanged"), ("b", "updated"), ("c", "new"), ("d", "malformed")]
    assert json.loads(jsonl.export(new.limit(1)).first().value) == {"content": "x", "id": "a"}


def run(stream, path, tmp_path, mode="append"):
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{path}")).trigger(availableNow=True).start(
        str(tmp_path / path)).awaitTermination(120)


def test_stream_takes_each_episode_once(spark, tmp_path):
    write_lines(tmp_path / "log")
    run(episodes.episode_stream(spark, str(tmp_path / "log")), "seen", tmp_path)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "seen")).collect()) == ["e1", "e3"]


def test_stream_coalesces_as_the_batch_does(spark, tmp_path):
    times = [0, 40, 70, 100, 131, 500]
    rows = spark.createDataFrame([("u", t * 1_000_000) for t in times] + [("v", 5)], "key string, us long")
    rows.write.parquet(str(tmp_path / "hits"))
    stream = spark.readStream.schema("key string, us long").parquet(str(tmp_path / "hits"))
    run(episodes.coalesced_stream(stream), "counted", tmp_path)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "counted")).collect())
    batch = ledger.coalesced(rows.select("key", F.timestamp_micros("us").alias("at")), "key", "at", 60)
    assert got == sorted((r.key, r.us) for r in batch.select("key", F.unix_micros("at").alias("us")).collect())


def test_merge_appends_new_keys_only(spark, tmp_path):
    write = episodes.merge_into(str(tmp_path / "t"), "id")
    for batch in ([("a",), ("a",)], [("a",), ("b",)]):
        write(spark.createDataFrame(batch, "id string"), 0)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b"]
