"""Reading level of documents, by a familiar-word formula.

The formula has the two classic parts: the share of words outside a list of
familiar words, and the sentence length. The list comes from document
frequencies over the whole corpus: the words that stand in at least
`LIST_SHARE` of the documents with prose. Frequency alone doesn't say for whom
a word is familiar (learned and technical words are as frequent here as everyday
ones), so the list is graded by document frequencies, too: among the rated
documents of each band. A word belongs to the readers' lists of a band in the
part that band has of it; the share of words outside the basic readers' list and
that outside the intermediate readers' list add up to the score,

    score = outside_basic + outside_intermediate + w * sentence length,

between 0 and 2 for w = 0. Two thresholds part the bands; they and w are those
that agree with most ratings. A document has the band of most of its clauses, so
that a passage of another level doesn't move the rest.

Each text is parsed once, in Python; its clauses are stored, and frequencies and
scores are taken from the stored table.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, small, spread, stored

BANDS = ("basic", "intermediate", "advanced")
#: A listed word stands in at least this share of the documents with prose.
LIST_SHARE = 0.0005
#: Longest list that is sent to the tasks; a longer one is joined instead, with the same result.
MOST_LISTED = 500_000
#: At most so many ratings are used to grade the list; more are sampled by hash. The corpus side has no bound.
MOST_RATINGS = 200_000
#: The thresholds and weights of sentence length that are tried.
LOWER, UPPER, WEIGHTS = np.arange(0.3, 1.101, 0.05), np.arange(0.6, 1.801, 0.05), (0.0, 0.005, 0.01)
#: Taken where nothing is rated.
UNFITTED = (0.7, 1.4, 0.0)

#: Control and format characters: fixed ranges of the Unicode categories Cc (but tab and line feed) and Cf.
_INVISIBLE = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f\xad\u0600-\u0605\u061c\u06dd\u070f\u08e2\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufff9-\ufffb]")
_FRONT = re.compile(r"(?s)\A\s*---[ \t]*\n.*?\n---[ \t]*(?:\n|\Z)")
_FENCE = re.compile(r"(?s)(?:```|~~~).*?(?:```|~~~|\Z)")
_HEADING = re.compile(r"\s*#{1,6}\s")
_MARK = re.compile(r"^\s*(?:[-*+>•]\s*|\d+[.)]\s+)+")
_ROLE = re.compile(r"^\s*(?:user|assistant|用户|助手|nutzer|assistent|assistentin)\s*:\s*", re.I)
_SIGN = re.compile(r"[{}()\[\]<>=;|$\"_/\\]")
_LOG = re.compile(r"\[?\d{4}-\d\d-\d+|\$ |at \S+ \(|(?:WARN|INFO|ERROR|DEBUG)\b")
_STATEMENT = re.compile(r"(?:const|let|var|def|if|for|while|return|function|class)\b.*[({=].*[)};\]]\s*(?://.*)?$")
_SQL = re.compile(r"(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|WITH)\s.*;\s*$")
_NAME = re.compile(r"[!-~]*[0-9_/\\@`][!-~]*|(?<![A-Za-z])[A-Za-z]*[a-z][A-Z][A-Za-z]*")
_TAIL = re.compile(r"[.!?,:;)\]\"']+$")
_PIECE = re.compile(r"[^\W\d_㐀-鿿]+|[㐀-鿿]+|[.!?]+$|[。！？；;]+|[,，、:](?=$|[㐀-鿿])")
#: Words that begin a clause; fixed values.
_JOINS = frozenset({"so", "and", "und"})
_SENTENCE_END, _CLAUSE_END = "\n", ","
_UMLAUT = re.compile("[äöüß]")
#: Frequent function words by which a sentence's language is told; fixed values.
_FUNCTION = {
    "de": set("der die das und ist nicht wir wenn weil den dem ein eine man es sich mit sobald bevor zu auf du ich dann war wo gibt davon seit was".split()),
    "en": set("the is a of and to it in that they you we this which are for by i can not on with without".split()),
}
#: Distinct strings between spaces a task remembers the words of; then it begins anew.
REMEMBERED = 300_000


def is_code(bare: str) -> bool:
    """Whether a stripped line is code, a statement of a query language or log rather than prose."""
    if _LOG.match(bare) or _STATEMENT.match(bare) or _SQL.match(bare) or (bare[0] in "{[" and bare[-1] in "}]"):
        return True
    return len(_SIGN.findall(bare)) > 0.12 * len(bare)


def is_han(word: str) -> bool:
    return "㐀" <= word[0] <= "鿿"


def pieces(token: str) -> list[str]:
    """Words in lower case (of Chinese, pairs of characters) and ends in a string between spaces; no names of files or code."""
    tail = _TAIL.search(token)
    at = tail.start() if tail else len(token)
    out = []
    for p in _PIECE.findall(_NAME.sub(" ", token[:at]) + token[at:]):
        if not p[0].isalpha():
            out.append(_CLAUSE_END if p[0] in ",，、:" else _SENTENCE_END)
        elif is_han(p):
            out += [p[k:k + 2] for k in range(max(1, len(p) - 1))]
        else:
            out.append(p.lower())
    return out


def prose_lines(text: str) -> Iterator[str]:
    """The lines of running prose and dialogue: no front matter, code, log lines or headings."""
    if "&" in text:
        text = html.unescape(text)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _INVISIBLE.sub("", text)
    if "---" in text:
        text = _FRONT.sub("", text)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    for line in text.split("\n"):
        if line and not line.isspace() and not _HEADING.match(line):
            line = _ROLE.sub("", _MARK.sub("", line)).strip()
            if line and not is_code(line):
                yield line


def sentences(text: str, known: dict[str, list[str]]) -> list[list[list[str]]]:
    """The sentences, as lists of clauses, which are lists of words."""
    out, sentence, words = [], [], []

    def end(whole: bool) -> None:
        nonlocal sentence, words
        if words:
            sentence.append(words)
            words = []
        if whole and sentence:
            out.append(sentence)
            sentence = []

    for line in prose_lines(text):
        for token in line.split():
            found = known.get(token)
            if found is None:
                found = pieces(token)
                if len(token) <= 32:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[token] = found
            for p in found:
                if p == _SENTENCE_END or p == _CLAUSE_END:
                    end(p == _SENTENCE_END)
                    continue
                if p in _JOINS and words:
                    end(False)
                words.append(p)
        end(True)
    return out


def language(words: list[str]) -> tuple[str, int]:
    """(language, size) of a sentence; a Chinese character counts for three letters."""
    letters = "".join(words)
    han = sum(map(is_han, words))
    if han and 4 * han >= len(letters):
        return "zh", 3 * han
    de, en = len(_FUNCTION["de"].intersection(words)), len(_FUNCTION["en"].intersection(words))
    return ("de" if de > en or (de == en and _UMLAUT.search(letters)) else "en"), len(letters)


def main_prose(text: str, known: dict[str, list[str]]) -> tuple[list[str], list[int]] | None:
    """(clauses, words of each clause's sentence) in the language most of the prose is in; none without prose."""
    found, sizes = [], {}
    for sentence in sentences(text, known):
        words = [w for clause in sentence for w in clause]
        tongue, size = language(words)
        sizes[tongue] = sizes.get(tongue, 0) + size
        found.append((tongue, len(words), sentence))
    if not found:
        return None
    main = max(sizes, key=sizes.get)
    mine = [(" ".join(clause), n) for tongue, n, sentence in found if tongue == main for clause in sentence]
    return [c for c, _ in mine], [n for _, n in mine]


PARSED = "doc_id long, clauses array<string>, lengths array<int>"


def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, list[str]] = {}
    for batch in batches:
        rows = [(d, *p) for d, t in zip(batch["doc_id"], batch["text"]) if (p := main_prose(t, known))]
        yield pd.DataFrame(rows, columns=["doc_id", "clauses", "lengths"])


def parsed_prose(documents: DataFrame) -> DataFrame:
    """(doc_id, clauses, lengths), stored: the only time the texts are read."""
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    return stored(spread(texts, "doc_id").mapInPandas(parse, PARSED))


def usable_ratings(ratings: DataFrame) -> DataFrame:
    """(doc_id, b0, b1, b2): how many raters gave each band; at most MOST_RATINGS ratings."""
    kept = ratings.where(F.col("doc_id").isNotNull() & F.col("band").isin(*BANDS)).select("doc_id", "band")
    kept = kept.orderBy(F.xxhash64("doc_id", "band")).limit(MOST_RATINGS)
    return kept.groupBy("doc_id").agg(*[F.count(F.when(F.col("band") == b, 1)).alias(f"b{k}") for k, b in enumerate(BANDS)])


def graded_list(prose: DataFrame, ratings: DataFrame, share: float = LIST_SHARE) -> DataFrame:
    """(word, df, outside_basic, outside_intermediate): the familiar words with the parts in which they are none.

    A band's part in a word is the word's part in the distinct words of the
    band's rated documents, against the other bands. A document with several
    ratings counts for each. A word that no rated document holds is shared
    equally.
    """
    marked = prose.select("doc_id", "clauses").join(small(ratings), "doc_id", "left")
    words = F.explode(F.array_distinct(F.split(F.array_join("clauses", " "), " "))).alias("word")
    counts = cut(marked.select(words, "b0", "b1", "b2").groupBy("word").agg(
        F.count("*").alias("df"), *[F.coalesce(F.sum(f"b{k}"), F.lit(0)).alias(f"c{k}") for k in range(3)]))
    listed = counts.where(F.col("df") >= share * prose.count())
    totals = listed.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"t{k}") for k in range(3)]).first()
    part = [(F.col(f"c{k}") + 0.5) / F.lit(totals[k] + 1000.0) for k in range(3)]
    rated, third = F.col("c0") + F.col("c1") + F.col("c2") > 0, F.lit(1 / 3)
    whole = part[0] + part[1] + part[2]
    return listed.select(
        "word", "df", (1 - F.when(rated, part[0] / whole).otherwise(third)).alias("outside_basic"),
        F.when(rated, part[2] / whole).otherwise(third).alias("outside_intermediate"))


SCORED = "doc_id long, scores array<double>, lengths array<int>, words long, listed long, sentences double"


def score_clauses(listed: dict[str, float]):
    """A function for mapInPandas over parsed prose: the list's part of each clause's score; NaN without a listed word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, clauses, lengths in zip(batch["doc_id"], batch["clauses"], batch["lengths"]):
                scores, sizes, words, met = [], [], 0, 0
                for clause in clauses:
                    own = clause.split(" ")
                    out = [x for w in own if (x := listed.get(w)) is not None]
                    scores.append(sum(out) / len(out) if out else float("nan"))
                    words, met = words + len(own), met + len(out)
                    sizes.append(len(own))
                rows.append((doc_id, scores, lengths, words, met, sum(s / n for s, n in zip(sizes, lengths))))
            yield pd.DataFrame(rows, columns=["doc_id", "scores", "lengths", "words", "listed", "sentences"])

    return run


def score_by_join(prose: DataFrame, listed: DataFrame) -> DataFrame:
    """The same by a join of the words with the list, whatever its length."""
    clauses = prose.select("doc_id", F.posexplode(F.arrays_zip("clauses", "lengths")).alias("pos", "x"))
    words = clauses.select("doc_id", "pos", F.col("x.lengths").alias("n"), F.explode(F.split("x.clauses", " ")).alias("word"))
    outside = listed.select("word", (F.col("outside_basic") + F.col("outside_intermediate")).alias("out"))
    scored = words.join(outside, "word", "left").groupBy("doc_id", "pos").agg(
        F.first("n").alias("n"), F.coalesce(F.avg("out"), F.lit(float("nan"))).alias("score"),
        F.count("*").alias("words"), F.count("out").alias("listed"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "score", "n")))
    return scored.groupBy("doc_id").agg(
        ordered.alias("c"), F.sum("words").alias("words"), F.sum("listed").alias("listed"), F.sum(F.col("words") / F.col("n")).alias("sentences"),
    ).select("doc_id", F.col("c.score").alias("scores"), F.col("c.n").alias("lengths"), "words", "listed", "sentences")


#: All settings as arrays: indices of the lower and upper threshold, and of the weight.
_PAIRS = np.array([(i, j) for i, a in enumerate(LOWER) for j, b in enumerate(UPPER) if b > a + 0.1])
SETTINGS = [(float(LOWER[i]), float(UPPER[j]), w) for w in WEIGHTS for i, j in _PAIRS]


def clause_scores(scores: np.ndarray, lengths: np.ndarray, weight: float) -> np.ndarray:
    """The whole score of each clause; those without a listed word say nothing."""
    return (scores + weight * lengths)[~np.isnan(scores)]


def bands_of(easy: np.ndarray, middle: np.ndarray, hard: np.ndarray) -> np.ndarray:
    """The band of most clauses; a tie goes to the easier one, no clause at all to the middle."""
    band = np.where((easy >= middle) & (easy >= hard), 0, np.where(middle >= hard, 1, 2))
    return np.where(easy + middle + hard == 0, 1, band)


def agreement(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(setting, agreed): for each setting of thresholds and weight, how many ratings it agrees with."""
    agreed = np.zeros(len(SETTINGS), dtype=np.int64)
    for batch in batches:
        for scores, lengths, *given in zip(batch["scores"], batch["lengths"], batch["b0"], batch["b1"], batch["b2"]):
            for k, weight in enumerate(WEIGHTS):
                own = np.sort(clause_scores(np.asarray(scores), np.asarray(lengths), weight))
                easy = np.searchsorted(own, LOWER)[_PAIRS[:, 0]]
                hard = len(own) - np.searchsorted(own, UPPER)[_PAIRS[:, 1]]
                agreed[k * len(_PAIRS):(k + 1) * len(_PAIRS)] += np.asarray(given)[bands_of(easy, len(own) - easy - hard, hard)]
    yield pd.DataFrame({"setting": np.arange(len(SETTINGS)), "agreed": agreed})


def fitted(scored: DataFrame, ratings: DataFrame) -> tuple[float, float, float]:
    """The thresholds and the weight that agree with most ratings; of equally good ones the middle one of the least weight."""
    rated = scored.join(small(ratings), "doc_id")
    sums = rated.mapInPandas(agreement, "setting int, agreed long").groupBy("setting").agg(F.sum("agreed").alias("agreed")).collect()
    most = max((r["agreed"] for r in sums), default=0)
    if not most:
        return UNFITTED
    best = [SETTINGS[r["setting"]] for r in sums if r["agreed"] == most]
    best = sorted(x for x in best if x[2] == min(y[2] for y in best))
    return best[len(best) // 2]


LEVELS = (
    "doc_id long, band string, unfamiliar double, sentence_words double, n_basic long, n_intermediate long, n_advanced long"
)


def rater(lower: float, upper: float, weight: float):
    """A function for mapInPandas over scored clauses: the bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [clause_scores(np.asarray(s), np.asarray(n), weight) for s, n in zip(b["scores"], b["lengths"])]
            easy = np.array([np.count_nonzero(s < lower) for s in own], dtype=np.int64)
            hard = np.array([np.count_nonzero(s >= upper) for s in own], dtype=np.int64)
            middle = np.array([len(s) for s in own], dtype=np.int64) - easy - hard
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "band": np.array(BANDS, dtype=object)[bands_of(easy, middle, hard)],
                "unfamiliar": 1 - b["listed"] / b["words"], "sentence_words": b["words"] / b["sentences"],
                "n_basic": easy, "n_intermediate": middle, "n_advanced": hard})

    return run


def reading_levels(documents: DataFrame, ratings: DataFrame, most_listed: int = MOST_LISTED) -> DataFrame:
    """The band of each document of prose, with the plain formula's parts and the clauses per band.

    ``unfamiliar`` is the share of words outside the frequent list,
    ``sentence_words`` the mean sentence length. Null, empty and blank texts and
    texts of only code, log lines or headings don't come out, nor do rows without
    doc_id; a repeated row comes out once. Without ratings every band is
    intermediate. An empty table gives an empty result.
    """
    prose = parsed_prose(documents)
    given = cut(usable_ratings(ratings))
    listed = cut(graded_list(prose, given))
    rows = listed.limit(most_listed + 1).collect()
    weights = {r["word"]: r["outside_basic"] + r["outside_intermediate"] for r in rows}

    def scored(some: DataFrame) -> DataFrame:
        if len(rows) > most_listed:
            return score_by_join(some, listed)
        return some.mapInPandas(score_clauses(weights), SCORED)

    setting = fitted(scored(prose.join(small(given.select("doc_id")), "doc_id", "left_semi")), given)
    return scored(prose).mapInPandas(rater(*setting), LEVELS).distinct()
