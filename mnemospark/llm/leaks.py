"""Evaluation texts inside corpus documents: CGK embedding, bit-sampling LSH, edit verification.

Both sides are cut into item-sized windows: `WORDS` consecutive words, or for a
Chinese item `CHARS` consecutive characters. A CGK walk turns each window into a
longer string so that few edits become few unequal positions: at step j it
writes the token under its pointer and moves on if a random bit of (j, token)
says so. An LSH key hashes a random sample of the positions; windows that share
any of the repeats' keys are candidates, and a banded edit distance decides. Each
repeat walks with bits of its own. Equal windows share every key, so for
`max_edits` 0 one repeat has recall 1; for more edits `repeats_for` takes as many
as `TARGET_RECALL` needs.

The corpus streams past once, whatever the number of items. A bit table of fixed
size, which says what the items' keys end in, rejects nearly all windows in the
task that cut them; the rest meets the items' windows in a join by key.
"""

from __future__ import annotations

import html
import math
import random
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut, spread

WORDS, CHARS = 10, 20
#: Sampled positions of a key.
SAMPLED = 6
TARGET_RECALL = 0.97
#: The bit table has 2 ** TABLE_BITS places, however many items there are.
TABLE_BITS = 22
#: If the items' windows are too many to broadcast, a key's windows in the corpus go to so many places.
SALTS = 16
#: Windows handled by one vector step, so that a very long text stays small in memory.
WINDOWS_AT_ONCE = 1 << 18
#: Texts tokenised together.
TEXTS_AT_ONCE = 256

CJK = re.compile(r"[㐀-鿿豈-﫿]")
#: Format characters: fixed ranges of the Unicode category Cf.
_INVISIBLE = re.compile("[\xad\u0600-\u0605\u061c\u06dd\u070f\u08e2\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufff9-\ufffb]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>")
_SPLIT_WORD = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>]*(?=[^\W\d_])")
_JOINED = str.maketrans("", "", "*_~`'’ʼ")
_TOKEN = re.compile(r"[㐀-鿿豈-﫿]|[^\W_㐀-鿿豈-﫿]+")
_CHAR = re.compile(r"[^\W_]")


def plain(text: str) -> str:
    """The text without what doesn't matter: width, letter case, mark-up, invisible characters, entities."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = _INVISIBLE.sub("", text)
    return _SPLIT_WORD.sub("", text).translate(_JOINED).casefold()


def words(text: str) -> list[str]:
    return _TOKEN.findall(text)


def characters(text: str) -> list[str]:
    return _CHAR.findall(text)


def is_chinese(text: str) -> bool:
    """Whether an item is compared by characters: if it holds more CJK characters than other words."""
    n = len(CJK.findall(text))
    return n > 0 and n >= len(words(text)) - n


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def token_ids(tokens: list[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each token; its bits also drive the walk."""
    for t in set(tokens).difference(known):
        raw = t.encode("utf-8", "surrogatepass")
        known[t] = zlib.crc32(raw) | zlib.crc32(raw, 0x5BD1E995) << 32
    x = np.fromiter((known[t] for t in tokens), dtype=np.uint64, count=len(tokens))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def repeats_for(width: int, max_edits: int) -> int:
    """How many keys reach the target recall: an edit is taken to spoil 2.2 of ``width`` positions of the walk's output (measured)."""
    if not max_edits:
        return 1
    one = max(0.02, 1 - 2.2 * max_edits / width) ** SAMPLED
    return math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - one))


def samples(width: int, max_edits: int, seed: int = 7) -> list[list[int]]:
    """The sampled positions of each repeat, of the 2 * width first positions of the embedding."""
    draw = random.Random(seed * 1000 + width)
    return [sorted(draw.sample(range(2 * width), SAMPLED)) for _ in range(repeats_for(width, max_edits))]


def lsh_keys(tokens: np.ndarray, width: int, chosen: list[list[int]]) -> np.ndarray:
    """[repeat, window]: LSH keys of all windows of a token array, by one CGK walk a repeat."""
    n = len(tokens) - width + 1
    start = np.arange(n)
    keys = np.zeros((len(chosen), n), dtype=np.uint64)
    for r, positions in enumerate(chosen):
        own = tokens if not r else (tokens ^ np.uint64(r)) * _M2
        own = own ^ (own >> np.uint64(29))
        moved = np.zeros(n, dtype=np.int64)
        for j in range(positions[-1] + 1):
            here = own[start + np.minimum(moved, width - 1)]
            if j in positions:
                keys[r] = (keys[r] ^ np.where(moved < width, here, np.uint64(0))) * _M1 + np.uint64(j)
            moved += ((here >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
    return keys


def edit_distance(a: list, b: list, limit: int) -> int:
    """Edit distance of two token lists, or limit + 1 if it is more; only a band of the table is filled."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if a == b:
        return 0
    if not limit:
        return 1
    before = {j: j for j in range(limit + 1)}
    for i, x in enumerate(a, 1):
        now = {}
        for j in range(max(0, i - limit), min(len(b), i + limit) + 1):
            best = before.get(j, limit) + 1
            if j:
                best = min(best, now.get(j - 1, limit) + 1, before.get(j - 1, limit + 1) + (x != b[j - 1]))
            now[j] = best
        before = now
    return min(before.get(len(b), limit + 1), limit + 1)


KINDS = {"word": (WORDS, words), "char": (CHARS, characters)}
WINDOWS = "kind string, repeat int, key long, window string"


def windows_of(tokens: list[str], ids: np.ndarray, width: int, chosen: list[list[int]]) -> Iterator[tuple[int, int, str]]:
    """(repeat, key, window) of a token list, the tokens of a window with a space between."""
    if len(tokens) >= width:
        keys = lsh_keys(ids, width, chosen).view(np.int64)
        for p in range(keys.shape[1]):
            window = " ".join(tokens[p:p + width])
            yield from ((r, int(keys[r, p]), window) for r in range(len(chosen)))


def item_windows(max_edits: int):
    """A function for mapInPandas over (case_id, item): the keys of all windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, known = [], {}
            for case, raw in zip(batch["case_id"], batch["item"]):
                text = plain(raw)
                kind = "char" if is_chinese(text) else "word"
                width, cut_up = KINDS[kind]
                tokens = cut_up(text)
                out += [(case, kind, *w) for w in windows_of(tokens, token_ids(tokens, known), width, samples(width, max_edits))]
            yield pd.DataFrame(out, columns=["case_id", "kind", "repeat", "key", "window"])

    return run


def bit_table(words_: list[tuple[int, int]]) -> np.ndarray:
    """The table as 64-bit words, of which those that aren't 0 are given as (number, bits)."""
    table = np.zeros(1 << (TABLE_BITS - 6), dtype=np.int64)
    for number, bits in words_:
        table[number] = bits
    return table.view(np.uint64)


def in_table(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    end = keys & np.uint64((1 << TABLE_BITS) - 1)
    return (table[(end >> np.uint64(6)).astype(np.int64)] >> (end & np.uint64(63))) & np.uint64(1) > 0


def likely_windows(texts: list[list[str]], known: dict[str, int], width: int, chosen: list[list[int]], table: np.ndarray) -> list[set]:
    """For each text the (repeat, key, window) whose key the bit table holds."""
    found: list[set] = [set() for _ in texts]
    flat = [t for tokens in texts for t in tokens]
    if len(flat) < width:
        return found
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    ids = token_ids(flat, known)
    for offset in range(0, len(ids) - width + 1, WINDOWS_AT_ONCE):
        keys = lsh_keys(ids[offset:offset + WINDOWS_AT_ONCE + width - 1], width, chosen)
        for r in range(len(chosen)):
            hits = offset + np.flatnonzero(in_table(keys[r], table))
            for p in hits[owner[hits] == owner[hits + width - 1]]:
                found[owner[p]].add((r, int(keys[r, p - offset].view(np.int64)), " ".join(flat[p:p + width])))
    return found


def corpus_windows(tables: dict[str, list[tuple[int, int]]], max_edits: int):
    """A function for mapInPandas over (doc_id, text): the windows that may be an item's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        ready = {kind: (width, cut_up, samples(width, max_edits), bit_table(tables[kind]))
                 for kind, (width, cut_up) in KINDS.items() if tables.get(kind)}
        for batch in batches:
            rows = batch[batch["text"].str.len() > 0]
            for first in range(0, len(rows), TEXTS_AT_ONCE):
                some = rows.iloc[first:first + TEXTS_AT_ONCE]
                texts = [plain(t) for t in some["text"]]
                hits = []
                for kind, (width, cut_up, chosen, table) in ready.items():
                    tokens = [cut_up(t) if kind == "word" or CJK.search(t) else [] for t in texts]
                    for doc, mine in zip(some["doc_id"], likely_windows(tokens, known, width, chosen, table)):
                        hits += [(doc, kind, *w) for w in mine]
                if len(known) > 500_000:
                    known.clear()
                yield pd.DataFrame(hits, columns=["doc_id", "kind", "repeat", "key", "window"])

    return run


def within_edits(max_edits: int):
    """A function for mapInPandas over pairs of windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = [edit_distance(x.split(" "), y.split(" "), max_edits) <= max_edits for x, y in zip(b["window"], b["item_window"])]
            yield b.loc[near, ["case_id", "doc_id"]]

    return run


def leaked(documents: DataFrame, cases: DataFrame, max_edits: int = 0, broadcast: bool = True) -> DataFrame:
    """(case_id, doc_id), distinct: documents that hold a window of a case's query or fragment, up to ``max_edits`` edits.

    Null or short items and null texts match nothing; rows without doc_id or
    case_id are left out. Any number of cases is taken in one pass of the corpus.
    ``broadcast`` False joins by salted keys even if the items are few.
    """
    items = cases.where(F.col("case_id").isNotNull()).select(
        "case_id", F.explode(F.array_compact(F.array("query", "fragment"))).alias("item")).distinct()
    wanted = cut(items.mapInPandas(item_windows(max_edits), f"case_id string, {WINDOWS}").distinct()).withColumnRenamed("window", "item_window")
    end = F.col("key").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    ends = wanted.select("kind", F.shiftright(end, 6).alias("number"), F.expr("shiftleft(1L, CAST(key & 63 AS INT))").alias("bit"))
    tables: dict[str, list[tuple[int, int]]] = {}
    for row in ends.groupBy("kind", "number").agg(F.bit_or("bit").alias("bits")).collect():  # at most 2 ** (TABLE_BITS - 6) of each kind
        tables.setdefault(row["kind"], []).append((row["number"], row["bits"]))
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    likely = spread(texts, "doc_id").mapInPandas(corpus_windows(tables, max_edits), f"doc_id long, {WINDOWS}")
    by = ["kind", "repeat", "key"]
    if broadcast and wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = likely.join(F.broadcast(wanted), by)
    else:
        salted = wanted.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
        met = likely.withColumn("salt", F.pmod(F.hash("doc_id", "window"), F.lit(SALTS))).join(salted, [*by, "salt"])
    pairs = met.select("case_id", "doc_id", "window", "item_window")
    if not max_edits:
        return pairs.where(F.col("window") == F.col("item_window")).select("case_id", "doc_id").distinct()
    unlike = [F.size(F.array_except(F.split(x, " "), F.split(y, " "))) for x, y in (("window", "item_window"), ("item_window", "window"))]
    near = pairs.where((unlike[0] <= max_edits) & (unlike[1] <= max_edits)).distinct()
    return near.mapInPandas(within_edits(max_edits), "case_id string, doc_id long").distinct()
