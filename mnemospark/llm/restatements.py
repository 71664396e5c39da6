"""Deduplicating new batches against all accepted history, by an inverted index of rare-token prefixes.

An entry's *index tokens* are those that carry its facts: numbers, paths,
identifiers and long words. Sorted from rare to frequent, the first
|x| - ceil(T * |x|) + 1 of them are its prefix: two entries whose token sets
have a Jaccard similarity of T or more share a token of their prefixes. The
postings of prefix tokens, partitioned by token, are the index. A batch probes
it with its own prefixes, sizes are filtered, the overlap and then the statement
are verified, and the batch's postings are appended (`PrefixIndex`).

A list of postings is split by a hash of the facts in which a pair must agree, so
that a frequent token's list is many. Entries that are equal after normalisation
are one entry of the index. To keep a long list with very many restatements of one
thing linear, probing starts with *leader rounds*: such a list's entries are
compared with its earliest one only, and what matches leaves the list. In the
last step every entry meets those entries of its whole lists that come before
the match it has; since a match isn't transitive, nothing leaves the side that
is met.

Two entries make the same statement if they have the same strong tokens
(numbers, paths, identifiers, as a multiset), the same polarity, the same strong
tokens in the same order in each sentence, the same names in camel case, and
enough of their other words in common, slips of spelling aside.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, shared_folder, small

#: Jaccard similarity of index tokens that a pair must reach.
SIMILARITY = 0.6
#: Words from this length on are index tokens, too.
LONG_WORD = 11
#: Rounds in which lists of more than LONG_LIST entries are compared with their earliest entry only.
LEADER_ROUNDS, LONG_LIST = 4, 64
#: Share of the smaller entry's other words that must be found again.
SOFT_SHARE = 0.5

_HAN = "㐀-鿿豈-﫿"
_TOKEN = re.compile(rf"[^\W{_HAN}]+(?:[-_./:@+][^\W{_HAN}]+)*|[{_HAN}]")
_SENTENCE = re.compile(r"[;；。！？\n]+|[.!?]+(?=\s|$)")
_CAMEL = re.compile(r"(?<![\w/.-])[A-Za-z]*[a-z][A-Z][A-Za-z]*(?![\w/-])")
_LEAD = re.compile(r"(?m)^[\s>#*+-]*(?:\(?\d{1,3}[.)]\s+)?")
#: Format characters: fixed ranges of the Unicode category Cf.
_INVISIBLE = re.compile("[\xad\u0600-\u0605\u061c\u06dd\u070f\u08e2\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufff9-\ufffb]")
_DASHES = str.maketrans({c: "-" for c in "‐‑‒–—−"} | {c: None for c in "*`"})
#: Polarity and direction words, by what they say; fixed values.
POLARITY = {
    "not": ["not", "never", "cannot", "nicht", "kein", "keine", "keinen", "nie", "niemals"],
    "without": ["without", "ohne"],
    "up": ["larger", "bigger", "greater", "higher", "above", "über", "größer"],
    "down": ["smaller", "lower", "fewer", "below", "unter", "kleiner", "weniger"],
}
#: The same in Chinese; 不然 and 别名 deny nothing.
HAN_POLARITY = {
    "not": re.compile("不(?!然)|别(?!名)|没有|未|勿"), "up": re.compile("超过|大于|高于|多于"),
    "down": re.compile("低于|小于|少于|不足"),
}
_SHORT_NOT = re.compile(r"\b(?:do|does|did|is|was|are|were|must|should|can|could|wo|would|has|have|had|need)n\W?t\b")
#: Real words that are one slip away from a polarity word.
_OTHER_WORDS = {"ever", "lager", "large", "small", "owe", "einen", "eine", "ein", "kleine", "keiner", "keine", "keinen"}


def _slips(word: str) -> set[str]:
    """The word with one letter left out or two neighbours swapped."""
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    return out | {word[:i] + word[i + 1] + word[i] + word[i + 2:] for i in range(len(word) - 1)}


_MEANING = {
    form: says
    for says, forms in POLARITY.items() for word in forms
    for form in ({word} | ({x for x in _slips(word) if len(x) > 3} - _OTHER_WORDS if len(word) > 4 else set()))
}


def normal(text: str) -> str:
    """NFKC without invisible characters, list marks and emphasis; white space within lines folded."""
    text = unicodedata.normalize("NFKC", text).translate(_DASHES)
    text = _INVISIBLE.sub("", text)
    return "\n".join(" ".join(line.split()) for line in _LEAD.sub("", text).splitlines() if line.strip())


def is_strong(token: str) -> bool:
    return not token.isalpha()


def polarity(lower: str, tokens: list[str]) -> str:
    """Counts of denial, lack and direction words, slips of spelling allowed for."""
    counts = Counter(m for t in tokens if (m := _MEANING.get(t)))
    counts["not"] += len(_SHORT_NOT.findall(lower))
    for says, pattern in HAN_POLARITY.items():
        counts[says] += len(pattern.findall(lower))
    return " ".join(f"{says}{counts[says]}" for says in POLARITY)


FEATURES = "id string, at long, exact binary, body string, camel string, facts long, tokens array<long>"


def hash64(text: str) -> int:
    """A signed 64-bit hash."""
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))).view(np.int64))


def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What an entry is compared by; entries without any word are left out.

    ``facts`` is a hash of the strong tokens and the polarity, in which a pair
    must agree; ``tokens`` are hashes of the index tokens.
    """
    for batch in batches:
        rows = []
        for id_, at, content in zip(batch["id"], batch["at"], batch["content"]):
            text = normal(content)
            lower = text.lower()
            sentences = [t for s in _SENTENCE.split(lower) if (t := _TOKEN.findall(s))]
            every = [t for s in sentences for t in s]
            if not every:
                continue
            strong = sorted(t for t in every if is_strong(t))
            camel = sorted({x.lower() for x in _CAMEL.findall(text)})
            index = {*strong, *camel, *(t for t in every if len(t) >= LONG_WORD)}
            if len(index) < 3:
                index |= {t for t in every if t.isascii()} | {a + b for a, b in zip(every, every[1:])}
            exact = hashlib.md5(" ".join(every).encode("utf-8", "surrogatepass")).digest()
            rows.append((id_, at, exact, "\n".join(" ".join(s) for s in sentences), " ".join(camel),
                         hash64(" ".join(strong) + "\n" + polarity(lower, every)), [hash64(t) for t in index]))
        yield pd.DataFrame(rows, columns=["id", "at", "exact", "body", "camel", "facts", "tokens"])


def close(a: str, b: str) -> bool:
    """Equal but for one slip: a letter left out, doubled or changed, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    if len(a) == len(b):
        wrong = [i for i in range(len(a)) if a[i] != b[i]]
        return len(wrong) == 1 or (
            len(wrong) == 2 and wrong[1] == wrong[0] + 1 and a[wrong[0]] == b[wrong[1]] and a[wrong[1]] == b[wrong[0]])
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def shared(a: set[str], b: set[str]) -> int:
    """How many words of the smaller set stand in the other, slips allowed for."""
    if len(a) > len(b):
        a, b = b, a
    rest = b - a
    return sum(1 for x in a if x in b or any(close(x, y) for y in rest))


def same_statement(body_a: str, camel_a: str, body_b: str, camel_b: str) -> bool:
    """The checks on two entries whose polarity is equal."""
    a = [s.split(" ") for s in body_a.split("\n")]
    b = [s.split(" ") for s in body_b.split("\n")]
    all_a, all_b = {t for s in a for t in s}, {t for s in b for t in s}
    if Counter(t for s in a for t in s if is_strong(t)) != Counter(t for s in b for t in s if is_strong(t)):
        return False
    names = {*camel_a.split(), *camel_b.split()}
    if not (names <= all_a and names <= all_b):
        return False

    hard_a, hard_b = (sorted(h for s in side if (h := [t for t in s if is_strong(t) or t in names])) for side in (a, b))
    if len(hard_a) == len(hard_b):  # cut alike: each sentence must have its own
        if hard_a != hard_b:
            return False
    else:  # cut in another way: no two may stand in reverse order within a sentence

        def ordered(sentences: list[list[str]]) -> set[tuple[str, str]]:
            return {(x, y) for s in sentences for i, x in enumerate(s) for y in s[i + 1:] if x != y}

        before, after = ordered(hard_a), ordered(hard_b)
        if any((y, x) in after and (x, y) not in after and (y, x) not in before for x, y in before):
            return False

    def soft(sentences: list[list[str]]) -> tuple[set[str], set[str]]:
        words = {t for s in sentences for t in s if t.isalpha() and t not in names and not ("㐀" <= t[0] <= "鿿")}
        han = {x + y for s in sentences for x, y in zip(s, s[1:]) if "㐀" <= x[0] <= "鿿" and "㐀" <= y[0] <= "鿿"}
        return words, han

    words_a, han_a = soft(a)
    words_b, han_b = soft(b)
    for x, y, found in ((words_a, words_b, shared(words_a, words_b)), (han_a, han_b, len(han_a & han_b))):
        if min(len(x), len(y)) > 2 and found < SOFT_SHARE * min(len(x), len(y)):
            return False
    return True


def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = [same_statement(*x) for x in zip(b["body"], b["camel"], b["body_e"], b["camel_e"])]
        yield b.loc[keep, ["id", "at", "earlier", "earlier_at"]]


def one_per_id(entries: DataFrame) -> DataFrame:
    """(id, at, content): rows of one id are one entry, of its earliest asserted_at, in microseconds.

    Rows without id or content are left out; an entry without time comes last.
    """
    at = F.coalesce(F.unix_micros("asserted_at"), F.lit(2**62)).alias("at")
    return (
        entries.where(F.col("id").isNotNull() & F.col("content").isNotNull())
        .groupBy("id").agg(F.min(F.struct(at, "content")).alias("e")).select("id", "e.at", "e.content")
    )


#: Token frequencies are kept for so many classes of a token's hash: a table of fixed size.
FREQUENCY_CLASSES = 1 << 16


def token_frequencies(entries: DataFrame) -> DataFrame:
    """(class, df): the order of the prefixes. A stored index keeps the one it was begun with."""
    token = F.explode("tokens").alias("token")
    return entries.select(token).groupBy(F.pmod("token", F.lit(FREQUENCY_CLASSES)).cast("int").alias("class")).agg(F.count("*").alias("df"))


def prefix_postings(entries: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(token, facts, at, id, size): the postings of each entry's rare-token prefix.

    Tokens are ordered by the frequency of their class, then by their hash. The
    frequencies, of fixed size, go to the tasks: the prefix is cut where the
    entry is, without a shuffle.
    """
    df = np.zeros(FREQUENCY_CLASSES, dtype=np.int64)
    for row in frequencies.collect():
        df[row["class"]] = row["df"]

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def prefix(lists: pd.Series) -> pd.Series:
        def one(tokens):
            order = np.lexsort((tokens, df[tokens % FREQUENCY_CLASSES]))
            return tokens[order[:len(tokens) - int(np.ceil(len(tokens) * SIMILARITY)) + 1]]

        return lists.map(one)

    return entries.select(F.explode(prefix("tokens")).alias("token"), "facts", "at", "id", F.size("tokens").alias("size"))


LIST = ["token", "facts"]


def order() -> Column:
    return F.struct("at", "id")


def size_filter(size: Column, other: Column) -> Column:
    return (other >= size * F.lit(SIMILARITY)) & (size >= other * F.lit(SIMILARITY))


def probe(batch: DataFrame, index: DataFrame) -> DataFrame:
    """(id, at, earlier, earlier_at, facts): pairs of a batch's entries with earlier ones of the index that share a list and a like size.

    If the batch has a column ``bound``, with those before it.
    """
    e = index.select(*LIST, F.col("at").alias("earlier_at"), F.col("id").alias("earlier"), F.col("size").alias("size_e"))
    bound = F.col("bound") if "bound" in batch.columns else order()
    met = batch.join(e, LIST).where(
        (F.struct(F.col("earlier_at").alias("at"), F.col("earlier").alias("id")) < bound) & size_filter(F.col("size"), F.col("size_e")))
    return met.select("id", "at", "earlier", "earlier_at", "facts").distinct()


def matches(pairs: DataFrame, own: DataFrame, known: DataFrame) -> DataFrame:
    """Of candidate pairs those that make the same statement: (id, at, earlier, earlier_at).

    ``own`` has the later entries, ``known`` the earlier ones. Both are met in
    the bucket of the pair's facts.
    """
    def side(entries: DataFrame, id_: str, end: str) -> DataFrame:
        return entries.select("bucket", F.col("id").alias(id_), *[F.col(c).alias(f"{c}{end}") for c in ("body", "camel", "tokens")])

    pairs = small(pairs.withColumn("bucket", bucket_of("facts")))
    full = side(own, "id", "").join(pairs, ["bucket", "id"]).join(side(known, "earlier", "_e").hint("merge"), ["bucket", "earlier"])
    shared_tokens = F.size(F.array_intersect("tokens", "tokens_e"))
    enough = shared_tokens >= F.lit(SIMILARITY) * (F.size("tokens") + F.size("tokens_e") - shared_tokens)
    return full.where(enough).select("id", "at", "earlier", "earlier_at", "body", "camel", "body_e", "camel_e").mapInPandas(verify, EDGE)


EDGE = "id string, at long, earlier string, earlier_at long"
#: Postings and entries are stored in so many buckets.
BUCKETS = 32
#: The stored tables.
STORED = {
    "postings": "token long, facts long, at long, id string, size int, bucket int",
    "entries": f"{FEATURES}, bucket int",
    "edges": EDGE,
    "frequencies": "class int, df long",
    "done": "name string",
}


def bucket_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def before_match(probes: DataFrame, index: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(probes with their bound, index): what may hold an earlier match than those found.

    An entry's ``bound`` is its earliest match so far, else the entry itself. It
    probes the lists that have an entry before that; a list is met up to the
    highest bound of its probes. In a list of copies that matched its leader
    nothing is left.
    """
    best = found.groupBy("id").agg(F.min(F.struct(F.col("earlier_at").alias("at"), F.col("earlier").alias("id"))).alias("match"))
    probes = probes.join(best, "id", "left").withColumn("bound", F.coalesce("match", order())).drop("match")
    firsts = index.groupBy(*LIST).agg(F.min(order()).alias("first"))
    probes = cut(probes.join(firsts, LIST).where(F.col("bound") > F.col("first")).drop("first"))
    ends = probes.groupBy(*LIST).agg(F.max("bound").alias("end"))
    return probes, index.join(ends, LIST).where(order() < F.col("end")).select(*index.columns)


def earliest(edges: DataFrame) -> DataFrame:
    """(id, root): follows each entry's earliest match until an entry that has none."""
    best = cut(edges.groupBy("id").agg(F.min(F.struct("earlier_at", "earlier")).alias("m")).select("id", F.col("m.earlier").alias("root")))
    while True:
        up = best.select(F.col("id").alias("root"), F.col("root").alias("above"))
        moved = cut(best.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"),
                                                         F.col("above").isNotNull().alias("moved")))
        best = moved.select("id", "root")
        if not moved.where("moved").limit(1).count():
            return best


class PrefixIndex:
    """The index as stored tables in a shared folder: one batch after the other probes it and is appended.

    - ``frequencies`` of the first batch give the order of the prefixes for good;
    - ``postings``, by batch and by bucket of the token;
    - ``entries``, by batch and by bucket of the facts, to verify pairs;
    - ``edges``, by batch: each entry with earlier ones that it restates.

    A batch reads the buckets of its own tokens and facts only. It is in once
    ``done`` names it; a batch that failed on its way is taken again under its
    id, and overwrites what it left. The object holds no state: another process
    may open the folder. A batch may hold entries that are earlier than stored
    ones: stored entries that restate them come out, too. An id that is stored is
    not taken again.
    """

    def __init__(self, spark: SparkSession, path: str, leader_rounds: int = LEADER_ROUNDS, long_list: int = LONG_LIST):
        self.spark, self.path, self.leader_rounds, self.long_list = spark, path, leader_rounds, long_list

    def _read(self, name: str, batches: list[str] | None = None) -> DataFrame:
        """A stored table, of the given batches only; empty if nothing is there yet."""
        schema = STORED[name] + (", batch string" if batches is not None else "")
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            rows = self.spark.createDataFrame([], schema)
        return rows if batches is None else rows.where(F.col("batch").isin([f"b{x}" for x in batches])).drop("batch")

    def _write(self, df: DataFrame, name: str, batch: str) -> None:
        writer = df.repartition("bucket").write.partitionBy("bucket") if "bucket" in df.columns else df.write
        writer.mode("overwrite").parquet(f"{self.path}/{name}/batch=b{batch}")

    def batches(self) -> list[str]:
        """The batches that are in."""
        return sorted(r[0] for r in self._read("done").distinct().collect())

    def check(self, batch: DataFrame, name: str) -> DataFrame:
        """Takes the batch ``name`` of (id, content, asserted_at) in; (id, at, earlier, earlier_at) that it brought to light."""
        return self.take(one_per_id(batch), name)

    def take(self, batch: DataFrame, name: str) -> DataFrame:
        """`check` for entries that are already (id, at, content), one row for an id."""
        before = [x for x in self.batches() if x != name]
        entries = batch.mapInPandas(features, FEATURES).withColumn("bucket", bucket_of("facts"))
        stored, history = self._read("entries", before), None
        entries = cut(entries.join(stored.select("id"), "id", "left_anti") if before else entries)
        if not before:
            token_frequencies(entries).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/frequencies")
        stored = stored.where(F.col("bucket").isin([r[0] for r in entries.select("bucket").distinct().collect()]))

        # equal texts: all but the first restate it, and aren't posted
        texts = entries.select("bucket", "exact", order().alias("o"))
        if before:
            texts = texts.unionByName(stored.select("bucket", "exact", order().alias("o")).join(
                entries.select("bucket", "exact").distinct(), ["bucket", "exact"], "left_semi"))
        marked = cut(entries.join(texts.groupBy("bucket", "exact").agg(F.min("o").alias("first")), ["bucket", "exact"]))
        is_first = F.col("first.id") == F.col("id")
        members = marked.where(~is_first).select("id", "at", F.col("first.id").alias("earlier"), F.col("first.at").alias("earlier_at"))
        reps = marked.where(is_first).select(entries.columns)
        known = reps.unionByName(stored.select(reps.columns)) if before else reps

        own = cut(prefix_postings(reps, self._read("frequencies")))
        index = own
        if before:
            lists = own.select(bucket_of("token").alias("bucket"), *LIST).distinct()
            history = self._read("postings", before).where(F.col("bucket").isin([r[0] for r in lists.select("bucket").distinct().collect()]))
            history = cut(history.join(lists, ["bucket", *LIST], "left_semi").select(own.columns))
            index = own.unionByName(history)
        edges = self._earlier(own, index, reps, known)
        if before:
            newest = history.agg(F.max("at")).first()[0]
            late = own.where(F.col("at") <= newest) if newest is not None else own.limit(0)
            if late.limit(1).count():
                edges = edges.unionByName(matches(cut(probe(history, late)), stored, reps))
        edges = cut(edges.unionByName(members).distinct())

        self._write(own.withColumn("bucket", bucket_of("token")), "postings", name)
        self._write(marked.select(entries.columns), "entries", name)
        self._write(edges, "edges", name)
        self.spark.createDataFrame([(name,)], STORED["done"]).coalesce(1).write.mode("append").parquet(f"{self.path}/done")
        return edges

    def _earlier(self, own: DataFrame, index: DataFrame, reps: DataFrame, known: DataFrame) -> DataFrame:
        """Edges from a batch's entries to earlier ones: the earliest of all that there are is among them."""
        found, probes, pool = None, own, index
        for _ in range(self.leader_rounds):
            lists = pool.groupBy(*LIST).agg(F.min(F.struct("at", "id", "size")).alias("l"), F.count("*").alias("n"))
            leaders = cut(lists.where(F.col("n") > self.long_list).select(*LIST, "l.*"))
            if not leaders.limit(1).count():
                break
            new = cut(matches(cut(probe(probes, leaders)), reps, known))
            found = new if found is None else found.unionByName(new)
            matched = new.select("id").distinct()
            probes = cut(probes.join(leaders.select(*LIST), LIST, "left_semi").join(matched, "id", "left_anti"))
            rest = pool.join(leaders.select(*LIST), LIST, "left_semi").join(matched, "id", "left_anti")
            pool = cut(rest.join(leaders.select(*LIST, "at", "id"), [*LIST, "at", "id"], "left_anti"))
        if found is None:
            return matches(cut(probe(own, index)), reps, known)
        return found.unionByName(matches(cut(probe(*before_match(own, index, found))), reps, known))

    def restatements(self) -> DataFrame:
        """(id, root) of all batches: each entry that restates an earlier one, with the earliest that makes the statement."""
        return earliest(self._read("edges", self.batches()))


#: Batches of consecutive days in which `restatements` takes a whole table in.
DAY_BATCHES = 2


def day_batches(entries: DataFrame, batches: int) -> list[tuple[int, int]]:
    """Consecutive UTC days, from and up to but without, of about equal numbers of entries."""
    days = sorted(tuple(r) for r in entries.groupBy(F.floor(F.col("at") / 86_400_000_000).alias("day")).count().collect())  # a row a day
    total, sum_, out = sum(n for _, n in days), 0, []
    for day, n in days:
        if not out or sum_ * batches >= len(out) * total:
            out.append(day)
        sum_ += n
    return list(zip(out, [*out[1:], days[-1][0] + 1])) if out else []


def restatements(
    entries: DataFrame, leader_rounds: int = LEADER_ROUNDS, batches: int = DAY_BATCHES, long_list: int = LONG_LIST
) -> DataFrame:
    """(id, root): each entry that restates an earlier one, with the earliest that makes the statement.

    The days are taken into a `PrefixIndex` one batch of days after the other.
    Neither their number nor that of the leader rounds changes the result. An
    empty table gives an empty result.
    """
    spark = entries.sparkSession
    every = cut(one_per_id(entries))
    index = PrefixIndex(spark, f"{shared_folder(spark)}/restatements-{uuid.uuid4().hex}", leader_rounds, long_list)
    day = F.floor(F.col("at") / 86_400_000_000)
    for k, (first, end) in enumerate(day_batches(every, batches)):
        index.take(every.where((day >= first) & (day < end)), f"b{k:06d}")
    return index.restatements()


def ordered_pairs(roots: DataFrame) -> DataFrame:
    """(id_a, id_b) with the smaller id first."""
    return roots.select(F.least("id", "root").alias("id_a"), F.greatest("id", "root").alias("id_b"))
