"""Encoding of a corpus with a public byte-pair tokenizer, by forced-boundary splitting.

A pair of bytes that stands side by side in no token of the vocabulary can't be
crossed by any merge: between the two a cut is certain. Every text, short or
long, is cut at all such places; the fragments, mostly single words, are encoded
each for itself and their ids concatenated. Since a fragment's ids depend on
nothing but the fragment, a task encodes each distinct one once and remembers it.

The tokenizer first splits a text by a pattern, so a cut must keep that view,
too: none stands behind white space, where the pattern looks ahead, and none
before an apostrophe or inside a contraction.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The tokenizer's published pre-tokenizer pattern; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pairs inside that pattern's contractions.
CONTRACTIONS = ("'s", "'t", "'r", "re", "'v", "ve", "'m", "'l", "ll", "'d")
#: Characters cut by one vector step, so that a very long text stays small in memory.
STEP = 1 << 20
#: Fragments a task remembers; beyond that it forgets all and begins anew. Longer ones aren't remembered.
REMEMBERED, REMEMBERED_CHARS = 500_000, 64


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


@cache
def encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@cache
def certain(path: str) -> np.ndarray:
    """certain[a, b]: bytes a, b stand side by side in no token of the vocabulary and in no contraction."""
    free = np.ones((256, 256), dtype=bool)
    for token in ranks(path):
        for a, b in zip(token, token[1:]):
            free[a, b] = False
    for a, b in CONTRACTIONS:
        free[ord(a), ord(b)] = False
    free[:, ord("'")] = False
    return free


@cache
def character_bytes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, last byte, is white space) of each code point in UTF-8."""
    c = np.arange(0x110000, dtype=np.uint32)
    first = np.select([c < 0x80, c < 0x800, c < 0x10000], [c, 0xC0 | c >> 6, 0xE0 | c >> 12], 0xF0 | c >> 18)
    last = np.where(c < 0x80, c, 0x80 | (c & 0x3F))
    white = np.fromiter((chr(x).isspace() for x in range(0x110000)), dtype=bool, count=0x110000)
    return first.astype(np.uint8), last.astype(np.uint8), white


def cuts(text: str, path: str = VOCABULARY) -> list[int]:
    """The positions of all certain boundaries of the text, its end among them."""
    free = certain(path)
    first, last, white = character_bytes()
    found: list[int] = []
    for start in range(0, len(text), STEP):
        points = np.frombuffer(text[start:start + STEP + 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        left, right = points[:-1], points[1:]
        found += (np.flatnonzero(free[last[left], first[right]] & ~white[left]) + (start + 1)).tolist()
    found.append(len(text))
    return found


def fragments(text: str, path: str = VOCABULARY) -> list[str]:
    """The text in pieces between certain boundaries."""
    ends = cuts(text, path)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def encode(texts: Iterator[str | None], path: str, known: dict[str, array]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of the texts, each the concatenation of its fragments' ids; ``known`` remembers fragments."""
    own = encoder(path)
    ids, offsets = array("i"), [0]
    for text in texts:
        for part in fragments(text, path) if text else ():
            part_ids = known.get(part)
            if part_ids is None:
                part_ids = array("i", own.encode_ordinary(part))
                if len(part) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = part_ids
            ids.extend(part_ids)
        offsets.append(len(ids))
    return np.array(offsets, dtype=np.int32), np.frombuffer(ids, dtype=np.int32) if ids else np.array([], dtype=np.int32)


def encode_corpus(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of each row, without special tokens; empty and null texts have no ids: an empty list.

    Only the text goes to Python, so repeated and null doc_ids stay as they are:
    one row comes out for each row that goes in. An empty table gives an empty
    result.
    """

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, array] = {}
        for batch in batches:
            yield pa.ListArray.from_arrays(*map(pa.array, encode(batch.to_pylist(), path, known)))

    rows = spread(documents.select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", ids("text").alias("ids"))
