"""Keyword-stuffed and link-list pages (problem 8).

Each page is read once into counts of its words and of the kinds of token that sell (links, tags, prices). Per language
the distinct texts give a word model; every page's rank-frequency curve (SQL windows) gives a slope and a residual, and
its counts a divergence from the model, with the part of it that comes from what the page repeats. A page is named when
these lie beyond the fences of prose of the same language and comparable length; what counts as prose, as a common word
and as extreme all comes from the data.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.llm.tasks import per_slice, spread
from codelake.session import cut

#: Words of each language that its model keeps, most widely used first, and how many of these count as its common words.
MODEL_WORDS, COMMON_WORDS = 2_000, 60
#: A page is prose for the comparison if its share of common words is at least this part of its language's own.
PROSE_PART = 0.5
#: Uses from which a word is repeated.
REPEATED = 3
#: Fences, in interquartile ranges beyond the quartiles of prose: divergence and its repeated part where these decide
#: alone, the same where the curve is extreme too, and what makes slope or residual extreme.
ALONE, WITH_CURVE, CURVE = (0.5, 4.0), (2.0, 0.7), 2.0
#: Interquartile range, in nats, that a divergence is taken to have at least: prose that is all alike makes no other text extreme.
LEAST_SPREAD = 0.4
#: Pages of prose a comparison needs; with fewer, all languages' prose of that length stands in.
LEAST_PROSE = 20
#: Share of numbers and code signs from which a page is a record (log, table, code), whatever it repeats, unless links, tags and prices outnumber these.
RECORDS = 0.2

# Endings of file names, which are no host names.
FILE_ENDINGS = "py pyw js jsx mjs cjs ts tsx php go rs java cpp cc cxx hpp hh hxx h c cs md json yml yaml toml txt html css lock sh cfg ini xml sql log csv".split()
#: Tokens that stand for kinds in the counts; no word looks like them.
LINK, TAG, PRICE = KINDS = ("<link>", "<tag>", "<price>")

DOT = r"(?:\.|\s*[\[({]\s*(?:\.|dot|punkt|punto|point)\s*[\])}]\s*|\s+(?:dot|punkt|punto|point)\s+)"
URL = re.compile(rf"[(\[<]*(?:https?://|www{DOT})[^\s)\[\]>\"'<]+(?:{DOT}[^\s)\[\]>\"'<]+)*[)\]>]*")
HOST = re.compile(rf"(?<![\w./@`-])(?:[a-z0-9-]+{DOT})+(?!(?:{'|'.join(FILE_ENDINGS)})\b)[a-z]{{2,}}(?![\w(.])(?:/[^\s)\]>]*)?")
#: What a text with a bare host has at least: a dot before a name that is no file's ending, or a dot written out.
NAME_DOT = re.compile(rf"\.(?!(?:{'|'.join(FILE_ENDINGS)})\b)[a-z]{{2}}")
WRITTEN_DOTS = ("dot", "punkt", "punto", "point", "[.", "(.", "{.", "[ .", "( .", "{ .")
ANCHOR = re.compile(r"<a\b[^<>]*?href\s*=\s*[\"']?([^\"'\s<>]+)[^<>]*>")
MARKUP = re.compile(r"</?[a-z][^<>]*>")
TOKEN = re.compile(r"#?\w+(?:[.,]\d\d\b(?![.,]\d))?|\(#?|[){}=`~<>$*]")


def language(column: str | Column) -> Column:
    """Two-letter code of a language label; ``und`` for null, blank or odd ones."""
    code = F.regexp_extract(F.lower(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))), r"^\s*([a-z]{2})[a-z]?(?:[-_].*)?\s*$", 1)
    return F.when((code == "") | (code == "un"), F.lit("und")).otherwise(code)


def hosted(text: str) -> bool:
    """Whether a bare host can be in the text at all."""
    return NAME_DOT.search(text) is not None or any(map(text.__contains__, WRITTEN_DOTS))


def read(text: str) -> tuple[Counter, int]:
    """(uses of each word and kind, number of records' signs) of a text: numbers, compound names and code signs are these.

    A link counts once, whatever its address.
    """
    text = text.lower()
    links = 0
    if "<" in text:
        text = MARKUP.sub(" ", ANCHOR.sub(r" \1 ", text))
    if "://" in text or "www" in text:
        text, links = URL.subn(" ", text)
    if hosted(text):
        text, hosts = HOST.subn(" ", text)
        links += hosts
    uses = Counter(TOKEN.findall(text))
    records = 0
    for token in [t for t in uses if not t.isalpha()]:
        n = uses.pop(token)
        if token[0] == "#" and token[1].isalpha():
            uses[TAG] += n
        elif token[-3:-2] in (".", ",") and token[0].isdigit():
            uses[PRICE] += n
        else:
            records += n
    if links:
        uses[LINK] = links
    return uses, records


def is_record(uses: Counter, records: int) -> bool:
    """Whether a page with these counts is a record rather than a text."""
    return records > RECORDS * (records + uses.total()) and records > sum(uses[kind] for kind in KINDS)


def page_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, label, content, n_tokens, record, tokens, uses, spectrum) per row: spectrum lists how many tokens occur how often, content is a hash of the text."""
    kind = dict(documents.dtypes)[key]
    pairs = pa.list_(pa.struct([("times", pa.int32()), ("words", pa.int32())]))

    def work():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [read(t or "") for t in batch.column(3).to_pylist()]
            ends = pa.array(np.cumsum([0, *(len(u) for u, _ in made)], dtype=np.int32))
            tokens = pa.array(list(itertools.chain.from_iterable(u for u, _ in made)), pa.string())
            uses = pa.array(list(itertools.chain.from_iterable(u.values() for u, _ in made)), pa.int32())
            spectra = [[{"times": k, "words": c} for k, c in Counter(u.values()).items()] for u, _ in made]
            columns = [
                pa.array([u.total() for u, _ in made], pa.int64()), pa.array([is_record(u, r) for u, r in made], pa.bool_()),
                pa.ListArray.from_arrays(ends, tokens), pa.ListArray.from_arrays(ends, uses), pa.array(spectra, pairs),
            ]
            return pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=[key, "label", "content", "n_tokens", "record", "tokens", "uses", "spectrum"])

        return apply

    source = documents.select(F.col(key), language(lang).alias("__lang"), F.xxhash64(F.col(text).cast("string")).alias("__content"), F.col(text).cast("string").alias("__text"))
    schema = f"{key} {kind}, label string, content bigint, n_tokens bigint, record boolean, tokens array<string>, uses array<int>, spectrum array<struct<times int, words int>>"
    return per_slice(spread(source), work, schema)


def word_use(pages: DataFrame) -> DataFrame:
    """(label, word, uses, pages) over the distinct texts of each label: no number of copies outweighs other texts."""
    distinct = pages.where("n_tokens > 0").dropDuplicates(["label", "content"])
    words = distinct.select("label", F.inline(F.arrays_zip(F.col("tokens").alias("word"), F.col("uses").alias("n"))))
    return words.groupBy("label", "word").agg(F.sum("n").alias("uses"), F.count("*").alias("pages"))


class Language:
    """Log probabilities of a language's most widely used tokens, that of any other one, its common words and their share."""

    def __init__(self, size: int, best: list[tuple[str, int]]):
        self.known = {word: math.log(uses / size) for word, uses in best}
        self.other = -math.log(10.0 * (size + 1))
        words = [(word, uses) for word, uses in best if word not in KINDS][:COMMON_WORDS]
        self.common = frozenset(word for word, _ in words)
        self.share = sum(uses for _, uses in words) / size


def languages(used: DataFrame) -> dict[str, Language]:
    """The model of each label and of all texts together (``und``): two-letter codes by MODEL_WORDS words, whatever the corpus."""
    whole = used.groupBy("word").agg(F.sum("uses").alias("uses"), F.sum("pages").alias("pages")).withColumn("label", F.lit("und"))
    both = used.where("label != 'und'").unionByName(whole)
    sizes = {r.label: r.size for r in both.groupBy("label").agg(F.sum("uses").alias("size")).collect()}
    widest = Window.partitionBy("label").orderBy(F.desc("pages"), "word")
    best: defaultdict[str, list[tuple[str, int]]] = defaultdict(list)
    for r in both.withColumn("n", F.row_number().over(widest)).where(F.col("n") <= MODEL_WORDS).orderBy("label", "n").collect():
        best[r.label].append((r.word, r.uses))
    return {label: Language(size, best[label]) for label, size in sizes.items()}


class Reader:
    """Measures pages against the languages' models."""

    def __init__(self, models: dict[str, Language]):
        self.models = models
        self.owners: defaultdict[str, list[str]] = defaultdict(list)
        for label, model in models.items():
            for word in model.common if label != "und" else ():
                self.owners[word].append(label)

    def language(self, label: str, uses: dict[str, int]) -> str:
        """The label, unless the page has more of another language's common words and is nearer to that one's model."""
        hits: Counter = Counter()
        for word in self.owners.keys() & uses.keys():
            for owner in self.owners[word]:
                hits[owner] += uses[word]
        if not hits:
            return label if label in self.models else "und"
        most = max(hits.values())
        best = min(owner for owner, n in hits.items() if n == most)
        if label == "und" or label not in self.models:
            return best
        if best == label or hits[label] == most:
            return label
        return min((label, best), key=lambda x: self.divergence(x, uses)[0])

    def divergence(self, language: str, uses: dict[str, int]) -> tuple[float, float]:
        """Kullback-Leibler divergence of a page's tokens from the language's model, and the part of it that repeated words and the kinds make."""
        model = self.models[language]
        known, other, n = model.known.get, model.other, sum(uses.values())
        whole = repeated = 0.0
        for word, c in uses.items():
            part = c * (math.log(c / n) - known(word, other))
            whole += part
            if c >= REPEATED or word in KINDS:
                repeated += part
        return whole / n, repeated / n

    def measure(self, label: str, tokens: list[str], counts: list[int]) -> tuple[str, float, float, bool]:
        """(language, divergence, its repeated part, whether the page is prose)."""
        uses = dict(zip(tokens, counts, strict=True))
        language = self.language(label, uses)
        model = self.models[language]
        common = sum(map(uses.__getitem__, model.common & uses.keys()))
        return language, *self.divergence(language, uses), common >= PROSE_PART * model.share * sum(counts) > 0


def page_measures(pages: DataFrame, models: dict[str, Language], key: str = "doc_id") -> DataFrame:
    """(key, language, content, length, divergence, repeated, prose, record) of each page with tokens; lengths go by powers of 2."""
    shared = pages.sparkSession.sparkContext.broadcast(models)

    def work():
        reader = Reader(shared.value)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [reader.measure(*page) for page in zip(*(batch.column(c).to_pylist() for c in (4, 5, 6)), strict=True)]
            columns = list(zip(*made, strict=True)) or [[]] * 4
            types = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, "content", "length", "record", "language", "divergence", "repeated", "prose"])

        return apply

    length = F.floor(F.log2("n_tokens")).cast("int").alias("length")
    source = pages.where("n_tokens > 0").select(key, "content", length, "record", "label", "tokens", "uses")
    return per_slice(source, work, f"{key} {dict(pages.dtypes)[key]}, content bigint, length int, record boolean, language string, divergence double, repeated double, prose boolean")


def rank_frequency(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, slope, residual) of each page's curve ln(times) against ln(rank), tokens of equal frequency at their middle rank; null for a single point."""
    falling = Window.partitionBy(key).orderBy(F.desc("times")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = pages.select(key, F.inline("spectrum")).withColumn("last", F.sum("words").over(falling))
    x, y = F.log(F.col("last") - (F.col("words") - 1) / 2), F.log("times")
    points = ranked.select(key, x.alias("x"), y.alias("y"))
    return points.groupBy(key).agg(
        F.regr_slope("y", "x").alias("slope"), ((F.lit(1.0) - F.regr_r2("y", "x")) * F.var_pop("y")).alias("residual")
    )


MEASURES = ("divergence", "repeated", "slope", "residual")


def prose_fences(measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(language, length, fences) and (length, fences of all languages): quartiles of each measure over distinct texts of prose, n of them.

    Lengths are compared with their neighbours as well, so a page meets prose of half to twice its length and more.
    """
    texts = measured.where("prose and not record").groupBy("language", "length", "content").agg(*(F.min(m).alias(m) for m in MEASURES))
    near = texts.select("language", F.explode(F.array(F.col("length") - 1, F.col("length"), F.col("length") + 1)).alias("length"), *MEASURES)
    quartiles = [F.percentile_approx(m, [0.25, 0.75], 1000).alias(m) for m in MEASURES]

    def fences(*by: str) -> DataFrame:
        return near.groupBy(*by).agg(F.count("*").alias("n"), *quartiles).where(F.col("n") >= LEAST_PROSE).select(*by, F.struct(*MEASURES).alias(f"by_{by[0]}"))

    return fences("language", "length"), fences("length")


def beyond(measure: str, fences: str, times: float) -> tuple[Column, Column]:
    """Whether a measure lies so many interquartile ranges (above, below) the quartiles of prose."""
    low, high = F.col(f"{fences}.{measure}")[0], F.col(f"{fences}.{measure}")[1]
    width = F.greatest(high - low, F.lit(LEAST_SPREAD)) if measure in ("divergence", "repeated") else high - low
    return F.col(measure) > high + times * width, F.col(measure) < low - times * width


def extreme_pages(pages: DataFrame, models: dict[str, Language], key: str = "doc_id") -> DataFrame:
    """The measures of each page with ``curve`` (slope or residual is extreme) and ``extreme``.

    A page is extreme if it is no record and its divergence is, and so is the repeated part of that: by itself, or
    less so together with the curve. Pages that no prose is comparable to are not extreme. Repeated keys count once.
    """
    curves = rank_frequency(pages.select(key, "spectrum").dropDuplicates([key]), key)
    measured = cut(page_measures(pages, models, key).dropDuplicates([key]).join(curves, key))  # read for the fences and against them
    own, pooled = prose_fences(measured)
    found = measured.join(F.broadcast(own), ["language", "length"], "left").join(F.broadcast(pooled), "length", "left")  # two-letter languages by powers of 2: under 30,000 rows
    found = found.withColumn("fences", F.coalesce("by_language", "by_length")).drop("by_language", "by_length")
    bent = F.lit(False)
    for measure in ("slope", "residual"):
        above, below = beyond(measure, "fences", CURVE)
        bent = bent | above | below
    curve = F.coalesce(bent, F.lit(False))
    alone, with_curve = (beyond("divergence", "fences", whole)[0] & beyond("repeated", "fences", part)[0] for whole, part in (ALONE, WITH_CURVE))
    extreme = ~F.col("record") & (alone | (with_curve & curve))
    return found.select("*", curve.alias("curve"), F.coalesce(extreme, F.lit(False)).alias("extreme")).drop("fences")


def spam_pages(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, language, length, slope, residual, divergence, repeated) of each page that is for the greater part no text for readers.

    Null, empty and blank texts are never named; each row of a repeated text is judged alike. A language most of whose
    distinct texts are such pages has no prose to tell them from.
    """
    pages = cut(page_counts(documents, key, text, lang))  # each text is read once
    found = extreme_pages(pages, languages(cut(word_use(pages))), key)
    return found.where("extreme").select(key, "language", "length", "slope", "residual", "divergence", "repeated")
