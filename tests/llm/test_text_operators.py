"""Leaks, tokenisation, reading level, co-occurrence, percentiles, personal items: small cases and brute force."""

import datetime as dt
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemospark.llm import cooccurrence, leaks, personal, quantiles, reading, tokenise

LONG = "In the hollow rehearsal at Bririn station a speckled miller traded 8607 violins for a pair of almanacs"
HAN = "制图师第5158次路过Dramere的鸟舍，摆渡人清点出3190件象牙白灯笼，于是绯红的顶针改由热气球送往Draska"


def leaked(spark, docs, cases=((("c", LONG, None)), ("h", None, HAN), ("s", "too short", None), ("n", None, None)), **more):
    d = spark.createDataFrame([(k, t, "x") for k, t in enumerate(docs)], "doc_id long, text string, case_id string")
    c = spark.createDataFrame([(*x, 1) for x in cases], "case_id string, query string, fragment string, doc_id int")
    return sorted(tuple(r) for r in leaks.leaked(d, c, **more).collect())


def test_leaks_in_any_dress_and_not_below_ten_words(spark):
    w = LONG.split()
    docs = ["so " + " ".join(w[3:13]) + " indeed", " ".join(w[3:12]), LONG.upper(), "&nbsp;".join(w), "> " + "\n> ".join([" ".join(w[:6]), " ".join(w[6:])]),
            LONG.replace("miller", "mil­ler").replace("pair", "pa​ir"), "**" + ", ".join(w) + "**", None, "", "ｉｎ" + LONG[2:],
            HAN[2:30].replace("，", ""), HAN[:12], "x " * 300000 + LONG]
    assert leaked(spark, docs) == [("c", k) for k in (0, 2, 3, 4, 5, 6, 9, 12)] + [("h", 10)]
    assert leaked(spark, []) == []
    assert leaked(spark, [LONG], cases=()) == []


def test_edits_are_found_with_a_tolerance(spark):
    w = LONG.split()
    near = " ".join(w[:5] + ["changed"] + w[6:10])
    assert leaked(spark, [near]) == [] and leaked(spark, [near], max_edits=1) == [("c", 0)]
    assert leaks.edit_distance(list("kitten"), list("sitting"), 3) == 3 and leaks.edit_distance(list("abc"), list("xyz"), 2) == 3


def edited(draw, tokens):
    """One token changed, left out or put in, not at the ends, where a shorter window could match."""
    out, p = list(tokens), draw.randrange(1, len(tokens) - 1)
    kind = draw.randrange(3)
    if kind == 0:
        out[p] = "xx" if len(tokens[p]) > 1 else "囧"
    elif kind == 1:
        del out[p]
    else:
        out.insert(p, "yy" if len(tokens[p]) > 1 else "囧")
    return out


def test_near_passages_against_brute_force(spark):
    draw = random.Random(4)
    han = [chr(0x4E00 + k) for k in range(3000)]
    items = [[f"w{draw.randrange(999)}" for _ in range(leaks.WORDS)] for _ in range(150)]
    items += [[draw.choice(han) for _ in range(leaks.CHARS)] for _ in range(150)]
    joined = [(" " if k < 150 else "").join for k in range(300)]
    cases = [(f"c{k}", joined[k](t), None) for k, t in enumerate(items)]
    docs = [joined[k](edited(draw, t)) for k, t in enumerate(items)] + ["nothing of the kind " * 9]

    def distance_ok(k):
        kind = leaks.words if k < 150 else leaks.characters
        near, item, width = kind(docs[k]), items[k], len(items[k])
        return any(leaks.edit_distance(near[p:p + width], item, 1) <= 1 for p in range(max(1, len(near) - width + 1)) if len(near[p:p + width]) == width)

    possible = {(f"c{k}", k) for k in range(300) if distance_ok(k)}
    got = set(leaked(spark, docs, cases, max_edits=1))
    assert got <= possible
    for low, high in ((0, 150), (150, 300)):
        some = {x for x in possible if low <= x[1] < high}
        assert len(some) > 30 and len(got & some) >= 0.9 * len(some)
    assert set(leaked(spark, docs, cases, max_edits=1, broadcast=False)) == got  # by salted keys
    assert leaked(spark, [" ".join(items[0])] * 50, cases, broadcast=False) == [("c0", k) for k in range(50)]


def test_fragments_concatenate_to_the_whole_encoding(spark):
    draw = random.Random(3)
    words = ["don't", "'s", "日本語", "naïve", "\n\n", "   ", "e.g.", "12345", "🙂", "\u00a0", "\u3000", "!!'re", "ﬁ", "x\ty", "Straße", "a\r\n", "中文。", "\x85", "''ll", ")'s", "\u2028"]
    own = tokenise.encoder(tokenise.VOCABULARY)
    for n in (3, 40, 900):
        for _ in range(20):
            text = draw.choice(["", " "]).join(draw.choice(words) for _ in range(n)) + "".join(draw.choice(words) for _ in range(n))
            parts = tokenise.fragments(text)
            assert "".join(parts) == text
            assert [t for p in parts for t in own.encode_ordinary(p)] == own.encode_ordinary(text)
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, "long text " * 50), (4, "<|endoftext|>"), (None, "no id"), (2**60 + 1, "big id")]
    rows += [(5, "x y " * 300_000)] * 2  # equal long rows stay apart
    df = spark.createDataFrame([(*r, [0]) for r in rows], "doc_id long, text string, ids array<int>")
    got = sorted((r.doc_id or 0, r.ids) for r in tokenise.encode_corpus(df).collect())
    assert got == sorted((i or 0, [] if not t else own.encode_ordinary(t)) for i, t in rows)
    assert tokenise.encode_corpus(df.limit(0)).count() == 0


@given(st.text(alphabet=st.sampled_from("ab'sdtl .\n\u00a0\u3000é1中文🙂)-"), max_size=40))
def test_cuts_are_certain(text):
    own = tokenise.encoder(tokenise.VOCABULARY)
    assert [t for p in tokenise.fragments(text) for t in own.encode_ordinary(p)] == own.encode_ordinary(text)


def test_nearly_every_document_is_cut_into_its_words(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text and r.text.strip()]
    own = tokenise.encoder(tokenise.VOCABULARY)
    assert sum(len(tokenise.fragments(t)) > 1 for t in texts) >= 0.9 * len(texts)
    assert sum(len(tokenise.fragments(t)) for t in texts) >= 0.3 * sum(len(own.encode_ordinary(t)) for t in texts)


def test_same_ids_as_the_other_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    own = tokenise.encoder(tokenise.VOCABULARY)
    for text in ("Don't stop — 日本語 🙂\n\n  x", "<|endoftext|> a", "  lead", "tail  \n"):
        assert own.encode_ordinary(text) == other.encode(text, add_special_tokens=False).ids


def test_pairs_against_brute_force(spark):
    draw = random.Random(5)
    rows = [("tag", f"m{draw.randrange(80)}", draw.choice(["#A", "a ", "Ｂ", "b", "c", "d", "none", "42", "", None, "##e"])) for _ in range(600)]
    rows += [("tag", None, "a"), ("entity", "m1", "a"), ("entity", "m1", "b")]
    norm = {"#A": "a", "a ": "a", "Ｂ": "b", "b": "b", "c": "c", "d": "d", "##e": "e", "a": "a"}
    sets = {}
    for kind, m, v in rows:
        if m and v in norm:
            sets.setdefault((kind, m), set()).add(norm[v])
    want = {}
    for (kind, _), items in sets.items():
        for a in items:
            for b in items:
                if a < b:
                    want[kind, a, b] = want.get((kind, a, b), 0) + 1
    df = spark.createDataFrame([(*r, "x") for r in rows], "kind string, record string, value string, item string")
    for heavy in (1, 3, 10_000):  # nearly no, some, and all items heavy
        got = {(r.kind, r.item_a, r.item_b): r.n_ab for r in cooccurrence.pair_counts([df], min_count=1, support_share=10**9, heavy_share=heavy).collect()}
        assert got == want
    assert cooccurrence.pair_counts([df.limit(0)]).count() == 0


def test_percentiles_keep_their_bound_and_combine(spark):
    draw = random.Random(7)
    values = [draw.lognormvariate(3, 2) for _ in range(4000)] + [0.0] * 500
    t = dt.datetime(2026, 1, 1)
    rows = [(f"s{k}", k % 7, " Quill " if k % 2 else "quill", t + dt.timedelta(hours=k % 2000), v, k % 50, t, "x") for k, v in enumerate(values)]
    rows += rows[:300] + [("z", 1, "quill", t, float("nan"), -1, t, "x"), ("z", 2, None, None, -3.0, None, t, "x"), ("z", 3, None, None, 1.0, None, t, "x")]
    df = spark.createDataFrame(rows, "session string, turn int, project string, at timestamp, enrichMs double, episodeMs long, logged_at timestamp, metric string")
    eps = 0.02
    rows = quantiles.latest_rows(df).repartition(3)
    table = quantiles.percentile_table(quantiles.combine_days(quantiles.day_summaries(rows, eps), eps), ["project", "metric"], [0.01, 0.5, 0.9, 0.99])
    got = {(r.project, r.metric, r.q): r for r in table.collect()}
    order = sorted(values)
    for q in (0.01, 0.5, 0.9, 0.99):
        r = got["quill", "enrichMs", q]
        assert r.n == len(order) and r.rank_error <= eps
        low, high = sum(v < r.value for v in order), sum(v <= r.value for v in order)
        assert low + 1 - eps * r.n - 1 <= q * r.n <= high + eps * r.n + 1
    assert got[None, "enrichMs", 0.5].value == 1.0 and (None, "episodeMs", 0.5) not in got
    assert quantiles.project_percentiles(df.limit(0), [0.5]).count() == 0


def test_a_hot_day_is_summarised_in_every_task_and_stays_within_its_bound(spark, monkeypatch):
    n, eps = 1_000_000, 0.01
    value = F.pmod(F.xxhash64("id"), F.lit(10**6)).cast("double")
    rows = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 1000 > 0, "hot").otherwise("cold").alias("project"), F.lit(20000).alias("day"), value.alias("enrichMs"),
        F.when(F.col("id") % 2 == 0, value).alias("episodeMs"))
    tasks = quantiles.task_summaries(rows, eps)
    assert tasks.where("project = 'hot'").count() == 8 * 2  # a summary of each metric from each task
    assert tasks.agg(F.max(F.size("vals"))).first()[0] <= 2 / eps + 2
    days = quantiles.day_summaries(rows, eps)
    assert days.count() == 4 and days.agg(F.max(F.size("vals"))).first()[0] <= 1 / eps + 2
    got = {(r.project, r.metric, r.q): r for r in quantiles.percentile_table(quantiles.combine_days(days, eps), ["project", "metric"], [0.1, 0.5, 0.999]).collect()}
    hot = rows.where("project = 'hot'")
    for q in (0.1, 0.5, 0.999):
        r = got["hot", "enrichMs", q]
        below = hot.where(F.col("enrichMs") < r.value).count()
        assert r.n == n * 999 // 1000 and r.rank_error <= eps and abs(below - q * r.n) <= eps * r.n + 2
    assert got["cold", "enrichMs", 0.5].n == 1000
    whole = sorted(map(str, days.orderBy("project", "metric").collect()))
    monkeypatch.setattr(quantiles, "BUFFER", 500)  # groups are flushed one by one
    again = quantiles.merge(quantiles.task_summaries(rows, eps), ["project", "metric", "day"], quantiles.SHARES["day"] * eps)
    assert {(r.project, r.metric): r.n for r in again.collect()} == {(r.project, r.metric): r.n for r in days.collect()} and whole


def test_reading_bands_are_learned_and_held_out(spark):
    draw = random.Random(9)
    kinds = {"basic": ["the door is red", "we look at the box", "you can stop the map"],
             "intermediate": ["the script updates the summary", "the session record checks the index", "the list filters the entries"],
             "advanced": ["epistemic reconciliation presupposes heterogeneous calibration", "adjudication exacerbates observational equivalence"]}
    docs, truth = [], {}
    for k in range(240):
        band = draw.choice(list(kinds))
        truth[k] = band
        body = ". ".join(draw.choice(kinds[band]) for _ in range(5)) + "."
        docs.append((k, f"## Heading\n```\nconst x = load(1);\n```\n{body}\n- {draw.choice(kinds[draw.choice(list(kinds))])}"))
    docs += [(900, None), (901, ""), (902, " \n"), (903, "const a = load(\"x\", 1);\n[2026-01-01] WARN x: waited 5 ms on y\nSELECT id, status FROM memories WHERE reinforcement > 8;"), (904, "# Only a heading")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, band string")
    labels = spark.createDataFrame([(k, b, "r") for k, b in truth.items() if k < 120] + [(5, None, "r")], "doc_id long, band string, rater string")
    got = {r.doc_id: r.band for r in reading.reading_levels(df, labels).collect()}
    held = [k for k in truth if k >= 120]
    assert set(got) == set(truth) and sum(got[k] == truth[k] for k in held) >= 0.95 * len(held)
    joined = {r.doc_id: r for r in reading.reading_levels(df.union(df.limit(20)), labels, most_listed=3).collect()}  # a list too long to send
    assert {k: r.band for k, r in joined.items()} == got
    assert {r.band for r in reading.reading_levels(df, labels.limit(0)).collect()} == {"intermediate"}
    assert reading.reading_levels(df.limit(0), labels).count() == 0


def personal_items(spark, texts, names=(("Marta", "given"), ("Velquist", "family"), ("陈", "family"), ("林", "family"), ("周", "family"))):
    rows = [("t", str(k), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "src string, row_id string, text string, start_at int")
    lex = spark.createDataFrame(list(names), "name string, kind string")
    return df, personal.items(df, lex)


def test_certain_forms_and_decoys(spark):
    texts = ["mail a.b+c@x.example or d_e (at) y.example, f at mail dot z dot example; clone git@h.example:p/q.git, pin @p/core@v1.2.3",
             "call +44 (0)20 7946 0677, 030/23125-987, １００８６５１３６５５, (690) 555-0159; run 555-3542, port 127.0.0.1:7815, build 2026.03.85 checksum 4155-550-8023",
             "SSN 666-51-5522, QQ 78 24 35 D, 996468199912049208, 2 95 99 99 817 786 73; epoch 1772923600",
             "at Flat 3, 960 Saltmarsh Court, Wexholm; in der Birkenstraße 4, 00685 Altmoor; 寄到临枫市河湾区采薇路237号1280单元; section 12 Lane Protocol",
             None, "", "x" * 100000]
    _, found = personal_items(spark, texts)
    got = sorted((int(r.row_id), texts[int(r.row_id)][r.start_at:r.start_at + 6], r.pii_type) for r in found.collect())
    assert [x for x in got if x[0] == 0] == [(0, "a.b+c@", "email"), (0, "d_e (a", "email"), (0, "f at m", "email")]
    assert [x[1] for x in got if x[0] == 1] == ["(690) ", "+44 (0", "030/23", "１００８６５"]
    assert [x[2] for x in got if x[0] == 2] == ["id_number"] * 4
    assert sorted(x[1] for x in got if x[0] == 3) == ["Birken", "Flat 3", "临枫市河湾区"]


def test_unlisted_names_are_discovered_by_their_contexts(spark):
    given, family = ["Marta", "Priya", "Otis", "Kofi", "Ines"], ["Velquist", "Zandermeer", "O'Hallisk", "Brunsvelt", "Varga-Lind"]
    draw = random.Random(2)
    texts = []
    for k in range(400):
        g, f = draw.choice(given), draw.choice(family)
        if g != "Marta" and f != "Velquist" and k % 3:
            g = "Marta"
        texts.append(draw.choice([f"please ask for {g} {f} today", f"{g} {f} said in standup", f"Ping {g} {f} (now)", f"as Dr. {g} {f} signed off",
                                  f"the owner {g} {f} left", f"Maven Central and Nimbus Relay on {k}"]))
    texts += ["please ask for Priya Zandermeer today", "form of Brunsvelt, Otis", "Ping K. Brunsvelt (now)", "May release moved", "Main Road is closed"]
    df, found = personal_items(spark, texts)
    got = {}
    for r in found.where("pii_type = 'name'").collect():
        got.setdefault(int(r.row_id), []).append(texts[int(r.row_id)][r.start_at:r.end_at])
    assert got[400] == ["Priya Zandermeer"] and got[401] == ["Brunsvelt, Otis"] and got[402] == ["K. Brunsvelt"]
    assert 403 not in got and 404 not in got
    assert not any("Maven" in x or "Nimbus" in x or "Ping" in x for v in got.values() for x in v)
    clean = {int(r.row_id): r.text for r in personal.redact(df, found).collect()}
    assert clean[400] == "please ask for [NAME] today"


def test_unlisted_chinese_families_are_discovered(spark):
    given = ["知榆", "闻笙", "澈", "栖迟", "叙白"]
    texts = [f"收件人{f}{g}。" for f in "陈林周邵贺" for g in given] * 3 + ["林间模式和周报开关无关", "找不到文件。"]
    _, found = personal_items(spark, texts)
    hits = {int(r.row_id) for r in found.collect()}
    assert hits == set(range(len(texts) - 2))


def test_contexts_of_brackets_spaces_and_latin_words_match():
    import re

    for left, right, text, name in (("人", "(", "收件人陈知榆 (晚)", "陈知榆"), ("please ask", "today", "Please ask 陈知榆 today", "陈知榆"),
                                    ("^", "said", "陈知榆 said so", "陈知榆"), ("owner", "^", "owner: 陈澈", "陈澈")):
        found = re.search(personal.han_form(left, right), text)
        assert left == "人" or found.group() == name
    assert re.search(personal.han_form("件人", "("), "收件人陈知榆 (晚)").group() == "陈知榆"
    assert not re.search(personal.han_form("件人", "("), "收件人陈知榆说")


def test_empty_tables(spark):
    df, found = personal_items(spark, [])
    assert found.count() == 0 and personal.redact(df, found).count() == 0
    empty = spark.createDataFrame([], "name string, kind string")
    assert personal.items(spark.createDataFrame([("t", "1", "a@b.example")], "src string, row_id string, text string"), empty).count() == 1
