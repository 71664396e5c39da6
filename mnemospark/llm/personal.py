"""Personal information in free text, by bootstrapped contextual extraction.

One pass over the texts cuts out *candidates*: spans of the shape of an item,
each with the words left and right of it. Some are certain by their form (an
email address, an identity number); those and the names of the seed lexicon are
seed instances. Contexts of seeds are *patterns*. Patterns and instances make a
bipartite graph that Spark scores in rounds: a pattern is as good as its
instances, an instance as good as its patterns. Good patterns then discover
what no seed names: unlisted given and family names, unlisted number forms, and
Chinese names of unlisted families.

- Latin names: instance nodes are the tokens in their role (given, family); a
  span needs both roles known, or an initial and a known family name.
- Numbers: the nodes are the digit shape and the words before it.
- Chinese names: a pattern is the pair of characters on each side; it is taken if
  many families and many given names stand in it. The second pass reads the
  texts again with the taken patterns, whose number is bounded: each must hold
  `PATTERN_SHARE` of all seed occurrences.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut

ROUNDS = 3
#: A token, pattern or number context counts as good from this score on.
GOOD, GOOD_CONTEXT = 0.5, 0.9
#: A Chinese pattern must hold this share of all seed occurrences: at most 1 / share can.
PATTERN_SHARE = 1e-4
MIN_FAMILIES, MIN_GIVEN = 3, 3

HAN = "㐀-鿿"
_NO_WORD = r"(?<![A-Za-z0-9_À-ɏ])"
_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+/@-])[A-Za-z0-9][A-Za-z0-9._%+-]*"
    r"(?:@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-]|:[A-Za-z0-9~/])"
    r"|\s?[(\[]\s?at\s?[)\]]\s?[A-Za-z0-9-]+(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?)[A-Za-z0-9-]+)*"
    r"(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?)[A-Za-z]{2,}"
    r"|\s(?:at|AT)\s[A-Za-z0-9-]+(?:\s(?:dot|DOT)\s[A-Za-z0-9-]+)+)"
)
_BEFORE, _AFTER = r"(?<![\w.+/:-])", r"(?![\w/]|[.:-]\d)"
_BEFORE_HAN = rf"(?<![A-Za-z0-9_.+/:-])"
_AFTER_HAN = r"(?![A-Za-z0-9_/]|[.:-]\d)"
#: Forms of identity numbers: fixed values of public formats.
_ID = re.compile(
    _BEFORE_HAN + r"(?:\d{6} ?(?:18|19|20)\d{6} ?\d{3}[\dXx]|[12] \d\d \d\d \d\d \d{3} \d{3} \d\d|\d{3}-\d\d-\d{4}|\d{3} \d\d \d{4}"
    r"|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]{2}\d{7})" + _AFTER_HAN
)
#: Forms of telephone numbers: fixed values of public numbering plans.
_PHONE = re.compile(
    r"(?<![A-Za-z0-9_.+/:(-])(?:\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d[\d /-]{4,14}\d|\(\d{3}\) ?\d{3}[-. ]\d{4}"
    r"|\d{3}([-. ])\d{3}\1\d{4}|00\d\d(?: \d{2,5}){2,4}|0\d(?:[. ]\d\d){4}|0\d{2,4}[ /]\d{3,6}(?:[ -]\d{3,4})?"
    r"|1\d\d([- ]?)\d{4}\2\d{4})" + _AFTER_HAN
)
_LOOSE = re.compile(r"(?<![A-Za-z0-9_.+/:(-])[+(]?\d(?:[\d ()./-]{5,18})\d" + _AFTER_HAN)
_STREET = "Street|St\\.|Road|Rd\\.?|Lane|Ln\\.?|Avenue|Ave\\.?|Court|Ct\\.?|Way|Drive|Place|Boulevard|Blvd\\.?|Square|Close|Terrace"
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9_.-])(?:(?:Flat|Apt|Unit|Suite) \d+[A-Za-z]?, ?)?\d{{1,5}}[A-Za-z]? (?:[A-Z][A-Za-z'’-]+ ){{1,3}}(?:{_STREET})(?![A-Za-z])"
    r"(?:, ?(?:Flat|Apt|Unit|Suite) \d+[A-Za-z]?)?(?:, ?[A-Z][a-z]+(?: [A-Z][a-z]+)?(?![A-Za-z]))?"
    r"|(?<![\w-])[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer) ?\d{1,4} ?[a-z]?(?![\w])"
    r"(?:, ?\d{5} [A-ZÄÖÜ][a-zäöüß]+)?"
    r"|(?<![\w-])(?:Am|Im|Zum|Zur|An der|Auf dem|Auf der) (?:[A-ZÄÖÜ][a-zäöüß]+ ){1,3}\d{1,4}[a-z]?(?!\w)(?:, ?\d{5} [A-ZÄÖÜ][a-zäöüß]+)?"
    rf"|(?:[{HAN}]{{2}}市)?[{HAN}]{{2}}区[{HAN}]{{1,5}}?(?:大道|路|街|巷|道|弄)\d+号(?:\d+(?:号楼|单元|室|栋|楼))*"
    rf"|[{HAN}]{{2}}市[{HAN}]{{1,5}}?(?:大道|路|街|巷|道|弄)\d+号(?:\d+(?:号楼|单元|室|栋|楼))*"
)
_TITLES = {"dr", "mr", "mrs", "ms", "mx", "prof", "herr", "frau", "sir", "miss"}
_CAP = r"[A-ZÀ-Þ](?:[a-zß-ÿ]+|['’][A-Z](?:[a-z]+|[A-Z]+)|[A-ZÀ-Þ]+)(?:-[A-ZÀ-Þ](?:[a-zß-ÿ]+|[A-ZÀ-Þ]+))*"
_RUN = re.compile(rf"{_NO_WORD}(?<![@./#-]){_CAP}|{_NO_WORD}(?<![@./#-])[A-Z]\.(?= )")
_END = re.compile(r"[A-Za-z0-9_À-ɏ@/]")


def folded(text: str) -> str:
    """The text with every character that NFKC maps to one other character replaced; offsets stay."""
    if text.isascii():
        return text
    return "".join(n if len(n := unicodedata.normalize("NFKC", c)) == 1 else c for c in text)


def left_of(text: str, start: int) -> str:
    """What stands left: up to two Chinese characters or two words; ^ after a stop or at the beginning."""
    part = text[max(0, start - 40):start].rstrip(" ")
    if m := re.search(rf"[{HAN}]{{1,2}}$", part):
        return m.group()
    m = re.search(r"([A-Za-zÀ-ɏ]+)[.:]?$", part)
    if not m or (part.endswith(".") and m.group(1).lower() not in {*_TITLES, "no", "tel"}):
        return "^"
    two = re.search(r"([A-Za-zÀ-ɏ]+) +[A-Za-zÀ-ɏ]+[.:]?$", part)
    last = m.group(1).lower()
    return last if last in _TITLES or not two else f"{two.group(1).lower()} {last}"


def right_of(text: str, end: int) -> str:
    """What stands right, likewise; ( for an opening bracket."""
    part = text[end:end + 40].lstrip(" ")
    if m := re.match(rf"[{HAN}]{{1,2}}", part):
        return m.group()
    if part[:1] in "([":
        return "(" if part else "^"
    m = re.match(r"([a-zß-ÿ]+)(?: +([a-zß-ÿ]+))?", part)
    return "^" if not m else " ".join(x for x in m.groups() if x)


SPANS = (
    "src string, row_id string, kind string, start_at int, end_at int, strict boolean, shape string, "
    "given string, family string, l string, r string"
)


def name_spans(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str | None, str]]:
    """(start, end, given or None for an initial, family) of each span of a name's shape, overlapping ones too."""
    runs = [m.span() for m in _RUN.finditer(text)]
    free = [s for s in runs if not any(a < s[1] and s[0] < b for a, b in taken) and not _END.match(text[s[1]:s[1] + 1])]
    for k, (a, b) in enumerate(free):
        first = text[a:b]
        if first.rstrip(".").lower() in _TITLES:
            continue
        for c, d in free[k + 1:k + 2]:
            gap, second = text[b:c], text[c:d]
            if second.rstrip(".").lower() in _TITLES:
                break
            if gap == " " and first.endswith("."):
                if not second.endswith("."):
                    yield a, d, None, second
            elif gap == " " and second.endswith("."):
                for e, f in free[k + 2:k + 3]:
                    if text[d:e] == " " and not text[e:f].endswith("."):
                        yield a, f, first, text[e:f]
            elif gap == " ":
                yield a, d, first, second
            elif gap == ", " and not first.endswith("."):
                if second.endswith("."):
                    yield a, d, None, first
                else:
                    yield a, d, second, first


def candidates(seed_families: set[str]):
    """A function for mapInPandas: cuts the candidates out of (src, row_id, text)."""
    han_seed = re.compile(f"[{''.join(sorted(seed_families))}]") if seed_families else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for src, row_id, raw in zip(batch["src"], batch["row_id"], batch["text"]):
                text = folded(raw)
                taken: list[tuple[int, int]] = []

                def add(kind, m, strict=True):
                    a, b = m.span()
                    if any(x < b and a < y for x, y in taken):
                        return
                    if kind == "phone" and strict and sum(c.isdigit() for c in m.group()) < 9:
                        return
                    taken.append((a, b))
                    shape = re.sub("[A-Za-z]", "A", re.sub(r"\d", "9", m.group())) if kind in ("phone", "id_number", "loose") else None
                    out.append((src, row_id, kind, a, b, strict, shape, None, None, left_of(text, a), right_of(text, b)))

                for kind, form in (("email", _EMAIL), ("address", _ADDRESS), ("id_number", _ID), ("phone", _PHONE)):
                    for m in form.finditer(text):
                        add(kind, m)
                for m in _LOOSE.finditer(text):
                    add("loose", m, False)
                for a, b, given, family in name_spans(text, [t for t in taken]):
                    out.append((src, row_id, "name", a, b, False, None, given and given.lower(), family.lower().replace("’", "'"),
                                left_of(text, a), right_of(text, b)))
                if han_seed:
                    for m in han_seed.finditer(text):
                        a = m.start()
                        for b in (a + 2, a + 3):
                            name = text[a:b]
                            if len(name) == b - a and all("㐀" <= c <= "鿿" for c in name):
                                out.append((src, row_id, "han", a, b, False, None, name[1:], name[0],
                                            left_of(text, a), right_of(text, b)))
            yield pd.DataFrame(out, columns=["src", "row_id", "kind", "start_at", "end_at", "strict", "shape",
                                             "given", "family", "l", "r"])

    return run


def score_tokens(names: DataFrame, lexicon: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, score): how sure a token is a given (g:) or family (f:) name.

    A context's score is the mean over its spans of the surer token. A given
    name's is the mean over the contexts left of it, a family name's the better
    of the means over the contexts of either side. A context without words (^)
    says nothing, one with fewer than three families counts 0. Means are
    smoothed, so that single finds count little. Who stands where is aggregated
    once; a round only joins scores to it.
    """
    edges = (
        names.select(F.concat(F.lit("g:"), "given").alias("g"), F.concat(F.lit("f:"), "family").alias("f"),
                     F.explode(F.array(F.concat(F.lit("l:"), "l"), F.concat(F.lit("r:"), "r"))).alias("c"))
        .where(~F.col("c").isin("l:^", "r:^")).groupBy("g", "f", "c").agg(F.count("*").alias("n"))
    )
    supported = edges.groupBy("c").agg((F.count_distinct("f") >= 3).alias("supported"))
    edges = cut(edges.join(supported, "c"))
    nodes = F.explode(F.array_compact(F.array(F.when(F.startswith("c", F.lit("l:")), F.col("g")), F.col("f")))).alias("node")
    places = cut(edges.select(nodes, "c", "n").groupBy("node", "c").agg(F.sum("n").alias("n")))
    seeds = lexicon.select(
        F.concat(F.when(F.col("kind") == "given", "g:").otherwise("f:"), F.lower("name")).alias("node"), F.lit(1.0).alias("score"))
    scores = seeds

    def mean(value: Column) -> Column:
        return F.sum(F.col("n") * value) / (F.sum("n") + 1)

    zero = F.lit(0.0)
    for _ in range(rounds):
        known = edges.where("supported").join(scores.withColumnsRenamed({"node": "g", "score": "sg"}), "g", "left").join(
            scores.withColumnsRenamed({"node": "f", "score": "sf"}), "f", "left")
        contexts = known.groupBy("c").agg(mean(F.greatest(F.coalesce("sg", zero), F.coalesce("sf", zero))).alias("s"))
        sides = places.join(contexts, "c", "left").groupBy("node", F.substring("c", 1, 1).alias("side")).agg(
            mean(F.coalesce("s", zero)).alias("score"))
        scores = cut(sides.select("node", "score").unionByName(seeds).groupBy("node").agg(F.max("score").alias("score")))
    return scores


def latin_names(names: DataFrame, scores: DataFrame) -> DataFrame:
    """Name spans whose tokens are known in their roles; of overlapping ones the first, then the longest."""
    good = scores.where(F.col("score") >= GOOD).select("node")
    g = good.select(F.substring("node", 3, 1000).alias("given"), F.substring("node", 1, 2).alias("role_g"))
    f = good.select(F.substring("node", 3, 1000).alias("family"), F.substring("node", 1, 2).alias("role_f"))
    known = names.join(f.where(F.col("role_f") == "f:"), "family", "left_semi")
    known = known.where(F.col("given").isNull()).unionByName(
        known.where(F.col("given").isNotNull()).join(g.where(F.col("role_g") == "g:"), "given", "left_semi").select(known.columns)
    )
    order = Window.partitionBy("src", "row_id").orderBy("start_at", F.col("end_at").desc())
    reach = F.max("end_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return known.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("reach") <= F.col("start_at")))


def discovered_numbers(spans: DataFrame) -> DataFrame:
    """Loose numbers in contexts that nearly only hold certain numbers of one kind."""
    numbers = spans.where(F.col("kind").isin("phone", "id_number", "loose") & (F.col("l") != "^"))
    context = numbers.groupBy("l").agg(
        F.count("*").alias("n"), F.count_distinct(F.when(F.col("strict"), F.col("shape"))).alias("shapes"),
        F.count(F.when(F.col("kind") == "phone", 1)).alias("phone"),
        F.count(F.when(F.col("kind") == "id_number", 1)).alias("id_number"),
    )
    best = F.greatest("phone", "id_number")
    sure = context.where((best >= GOOD_CONTEXT * F.col("n")) & (F.col("shapes") >= 3)).select(
        "l", F.when(F.col("phone") >= F.col("id_number"), "phone").otherwise("id_number").alias("as_kind"))
    return spans.where(F.col("kind") == "loose").join(sure, "l").select("src", "row_id", "as_kind", "start_at", "end_at")


def han_patterns(spans: DataFrame) -> DataFrame:
    """(l, r): contexts in which many seed families and many given names stand."""
    seeds = spans.where(F.col("kind") == "han")
    total = seeds.count()
    by_context = seeds.where((F.col("l") != "^") | (F.col("r") != "^")).groupBy("l", "r").agg(
        F.count("*").alias("n"), F.count_distinct("family").alias("families"), F.count_distinct("given").alias("givens"))
    return by_context.where(
        (F.col("families") >= MIN_FAMILIES) & (F.col("givens") >= MIN_GIVEN) & (F.col("n") >= F.lit(max(5.0, PATTERN_SHARE * total)))
    ).select("l", "r")


def han_form(left: str, right: str) -> str:
    """The regular expression of a name in a context as `left_of` and `right_of` write it: spaces at the name are free, Latin words match in either case."""
    def han(side: str) -> bool:
        return "㐀" <= side[0] <= "鿿"

    own, other = re.escape(left), re.escape(right)
    if left == "^":
        before = rf"(?<![{HAN}])"
    elif han(left):
        edge = "" if len(left) == 2 else rf"(?<![{HAN}])"
        before = f"(?:(?<={edge}{own})|(?<={edge}{own} ))"
    else:
        before = "(?:" + "|".join(f"(?<=(?<![A-Za-z]){own}{gap})" for gap in ("", " ", ":", ": ", "\\.", "\\. ")) + ")"
    if right == "^":
        after = rf"(?![{HAN}])"
    elif han(right):
        after = f"(?= *{other})" if len(right) == 2 else rf"(?= *{other}(?![{HAN}]))"
    elif right == "(":
        after = r"(?= *[(\[])"
    else:
        after = rf"(?= *{other}(?![A-Za-z]))"
    form = f"{before}[{HAN}]{{2,3}}{after}"
    return f"(?i:{form})" if re.search("[a-z]", left + right) else form


def han_names(texts: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Names of two or three Chinese characters in the taken patterns, whatever their family."""
    forms = [han_form(left, right) for left, right in patterns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [re.compile(f) for f in forms]
        for batch in batches:
            out = []
            for src, row_id, raw in zip(batch["src"], batch["row_id"], batch["text"]):
                text = folded(raw)
                for form in compiled:
                    out += [(src, row_id, m.start(), m.end(), text[m.start()], m.group()[1:]) for m in form.finditer(text)]
            yield pd.DataFrame(out, columns=["src", "row_id", "start_at", "end_at", "family", "given"])

    return texts.mapInPandas(run, "src string, row_id string, start_at int, end_at int, family string, given string")


def known_families(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """Finds whose family is a seed, or stands before as many given names as MIN_GIVEN, most of which seeds bear, too."""
    seeded = found.join(seeds, "family", "left_semi").select("given").distinct().withColumn("borne", F.lit(True))
    new = found.join(seeds, "family", "left_anti").join(seeded, "given", "left").groupBy("family").agg(
        F.count_distinct("given").alias("givens"), F.avg(F.coalesce(F.col("borne").cast("int"), F.lit(0))).alias("share"))
    discovered = new.where((F.col("givens") >= MIN_GIVEN) & (F.col("share") >= GOOD)).select("family")
    return found.join(seeds.select("family").unionByName(discovered).distinct(), "family", "left_semi")


def items(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(src, row_id, pii_type, start_at, end_at), distinct, of (src, row_id, text).

    Offsets are 0-based code points, ends exclusive. Null texts and rows without
    id hold nothing; repeated rows count once. An empty table or lexicon gives
    what the certain forms find.
    """
    texts = texts.where(F.col("row_id").isNotNull() & F.col("text").isNotNull()).select("src", "row_id", "text").distinct()
    lexicon = lexicon.where(F.col("name").isNotNull())
    han_seeds = lexicon.where((F.col("kind") == "family") & F.col("name").rlike(f"^[{HAN}]$")).select(F.col("name").alias("family")).distinct()
    families = {r[0] for r in han_seeds.collect()}  # single characters of the range HAN: there are 27,584
    spans = cut(texts.mapInPandas(candidates(families), SPANS))
    certain = spans.where(F.col("strict")).select("src", "row_id", F.col("kind").alias("pii_type"), "start_at", "end_at")
    names = spans.where(F.col("kind") == "name")
    latin = latin_names(names, score_tokens(names, lexicon)).select(
        "src", "row_id", F.lit("name").alias("pii_type"), "start_at", "end_at")
    numbers = discovered_numbers(spans).withColumnRenamed("as_kind", "pii_type")
    patterns = [tuple(r) for r in han_patterns(spans).collect()]  # at most 1 / PATTERN_SHARE
    found = certain.unionByName(latin).unionByName(numbers.select(certain.columns))
    if patterns:
        han = known_families(cut(han_names(texts, sorted(patterns))), han_seeds)
        found = found.unionByName(han.select("src", "row_id", F.lit("name").alias("pii_type"), "start_at", "end_at"))
    return found.distinct()


def redact(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(src, row_id, text) with [EMAIL], [PHONE] and so on in place of the items; other rows as they are."""
    per_row = found.groupBy("src", "row_id").agg(
        F.array_sort(F.collect_list(F.struct("start_at", "end_at", "pii_type"))).alias("spans"))

    @F.pandas_udf(T.StringType())
    def replace(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, list_):
            if t is None or list_ is None:
                return t
            out, at = [], 0
            for s in list_:
                if s["start_at"] >= at:
                    out += [t[at:s["start_at"]], f"[{s['pii_type'].upper()}]"]
                    at = s["end_at"]
            return "".join(out) + t[at:]

        return pd.Series([one(t, s) for t, s in zip(text, spans)])

    return texts.join(per_row, ["src", "row_id"], "left").select("src", "row_id", replace("text", "spans").alias("text"))
