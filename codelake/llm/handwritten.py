"""Generated, minified or vendored source files (problem 5).

Every file is read once into its names. Character trigram models, one per language, are trained on the distinct names of
all files that are not packed. A file is minified when most of its names are mangled by their cross-entropy and it is
packed; generated when its names are a few stems with numbers put in (low diversity); bulk data when hardly a name stands
among its literals. It is vendored when its place, a banner or the namespace it declares shows a name that is foreign by
its language's model and, as an exact check, is that of a known package; or when it lies where copies are kept and the
shapes of its names are foreign to the rest of its repository. Short files are judged with shrinkage, not by switches.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.parsing import read_grammar
from codelake.llm.sourcefiles import EXTENSIONS, language_of
from codelake.llm.tasks import Totals, per_slice, spread, tally
from codelake.session import cut

#: Bits per character above a language's own entropy from which a name is mangled, and share of mangled uses of a minified file.
MANGLED_BITS, MANGLED_SHARE = 1.0, 0.35
#: A minified file has at most this share of blanks.
PACKED = 0.13
#: Uses by which a file's mangled share is shrunk towards none, and names by which its diversity is towards all.
SHRUNK_USES, SHRUNK_NAMES = 20, 1
#: Share of names left once numbers in them are taken as one, below which a file is a filled-in template.
DIVERSITY = 0.3
#: A data file has at most this share of its code in names, and at least this one in literals, shrunk by so many characters.
DATA_NAMES, DATA_SHARE, SHRUNK_SIZE = 0.02, 0.5, 50
#: Names whose trigrams a worker remembers.
REMEMBERED = 100_000
#: Bits per character beyond its language's mean from which a name is foreign, in a folder for copies and elsewhere, and letters it has elsewhere.
FOREIGN_BITS, LEAST_LETTERS = {"folder": -1.0, "text": 0.0}, 3
#: Divergence in nats of a file's name shapes from its repository's from which its style is foreign, and the names by which both are shrunk.
STYLE_NATS, SHRUNK_STYLE = 0.2, 20

# Folders that package managers own, and folders that hold copies of packages by custom.
MANAGED = {"node_modules", "site-packages", "dist-packages", "bower_components", "jspm_packages"}
CUSTOMARY = {"vendor", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "extern", "deps", "plugins", "themes"}

_LITERAL = r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\'|`(?:[^`\\]|\\[\s\S])*`'
_CODE = r"[^\W\d][\w$]*|\$[\w$]+|\d[\w.]*|[^\s\w]"
TOKENS = {hashes: re.compile("|".join([_LITERAL, r"/\*[\s\S]*?\*/", r"//[^\n]*", *([r"#(?!\[)[^\n]*"] if hashes else []), _CODE])).findall for hashes in (False, True)}
HASH_COMMENTS = {"python", "php"}
COMMENT = re.compile(r"/\*[\s\S]*?\*/|(?:(?<=\n)|\A)[ \t]*(?://|#)[^\n]*")
BANNER = re.compile(r"licen[cs]e|copyright|\(c\)|@package|distribution|all rights reserved|\bMIT\b|\bBSD\b|^\W*[\w-]+ v?\d+\.\d+\.\d+\W*$", re.IGNORECASE | re.MULTILINE)
STATED = re.compile(r"copyright (?:\(c\)|©|\d)|\(c\) ?\d{4}|@licen[cs]e|@package|SPDX-License|all rights reserved|(?:licensed|released|distributed) under|\A/\*!", re.IGNORECASE)
NAMESPACE = re.compile(r"^[ \t]*(?:package|namespace)[ \t]+([\w.\\]+)", re.MULTILINE)
#: Literals and comments, in which nothing is declared.
ASIDE = re.compile(rf"{_LITERAL}|/\*[\s\S]*?\*/|//[^\n]*")
DIGITS = re.compile(r"\d+")
GRAM = re.compile(r"[^a-z0-9_^$]")


def package_name(column):
    """Comparable form of a package name: lower case, no blanks, scope or vendor part, ``_`` as ``-``."""
    return F.translate(F.regexp_replace(F.lower(F.btrim(column)), r"^.*/", ""), "_", "-")


def known_packages(dependencies: DataFrame, *scanned: DataFrame) -> DataFrame:
    """(name) of third-party packages from the inventory and the dependency_name of files and chunks, each once."""
    named = [dependencies.select(package_name(F.col(c)).alias("name")) for c in ("name", "slug")] + [t.select(package_name(F.col("dependency_name")).alias("name")) for t in scanned]
    return reduce(DataFrame.union, named).where("name != ''").distinct()


def keywords(language: str) -> frozenset[str]:
    directives = read_grammar(language).directives
    words = " ".join([directives.get("reserved", ""), *(v for k, v in directives.items() if k.startswith("class_"))]).split()
    return frozenset(w for w in words if w[0].isalpha())


def tokens_of(language: str, text: str) -> Counter:
    return Counter(TOKENS[language in HASH_COMMENTS](text))


def names_in(tokens: Counter, reserved: frozenset[str]) -> Counter:
    """Uses by name; a variable's ``$`` is no part of it."""
    names: Counter = Counter()
    for token, n in tokens.items():
        if (token[0].isalpha() or token[0] in "_$") and token[-1] not in "\"'`" and token not in reserved:
            names[token.lstrip("$") or token] += n
    return names


@lru_cache(REMEMBERED)
def grams(name: str) -> tuple[str, ...]:
    """Character trigrams of a name between its ends, over a fixed alphabet of 40 signs."""
    padded = "^^" + GRAM.sub("?", name.lower()) + "$"
    return tuple(padded[i : i + 3] for i in range(len(padded) - 2))


def packed(text: str) -> bool:
    """Whether the text has as few blanks as minified code."""
    return len(text) - len("".join(text.split())) <= PACKED * len(text)


SHAPES = ("low", "camel", "snake", "pascal", "upper", "one")


def shape_of(name: str) -> str:
    """How a name is put together."""
    if len(name) == 1:
        return "one"
    if name.isupper():
        return "upper"
    if "_" in name:
        return "snake"
    if name[0].isupper():
        return "pascal"
    return "camel" if any(map(str.isupper, name)) else "low"


def places(path: str) -> tuple[bool, list[str]]:
    """(whether a package manager owns a folder of the path, the names inside folders where copies are kept)."""
    folders = [f.strip().lower().replace("_", "-") for f in path.replace("\\", "/").split("/")[:-1]]
    inside = []
    for at, folder in enumerate(folders[:-1]):
        if folder.replace("-", "_") in MANAGED or folder in MANAGED:
            return True, []
        if folder.replace("-", "_") in CUSTOMARY or folder in CUSTOMARY:
            scoped = folders[at + 1].startswith("@") and at + 2 < len(folders)
            inside.append(folders[at + 2 if scoped else at + 1])
    return False, inside


def stated_names(text: str) -> set[str]:
    """Words of the comments that state terms or whose rights they are, and the names of declared namespaces, at any place of the text.

    The comments at the head may name terms in any way; further down a banner must claim rights.
    """
    stated: set[str] = set()
    leading, end = True, 0
    for found in COMMENT.finditer(text):
        comment = found[0]
        leading = leading and not text[end : found.start()].strip()
        end = found.end()
        if (BANNER if leading else STATED).search(comment):
            stated.update(re.findall(r"[a-z][\w-]*", comment.lower().replace("_", "-")))
    if NAMESPACE.search(text):
        for name in NAMESPACE.findall(ASIDE.sub(" ", text)):
            parts = re.split(r"[.\\]", name.lower().replace("_", "-"))
            stated.update(parts[:2] if parts[0] in ("org", "com", "net", "io", "de") else parts[:1])
    return {name for name in stated if len(name) >= LEAST_LETTERS}


FILE = "repo_name string, file_path string, language string, is_packed boolean, managed boolean, size bigint, literal bigint, names array<string>, uses array<int>, inside array<string>, stated array<string>, " + ", ".join(f"{x} int" for x in SHAPES)


def file_names(files: DataFrame) -> DataFrame:
    """One row per input row: the distinct names of a file with their uses and shapes, and what else of it the judgement needs."""
    reserved = {language: keywords(language) for language in EXTENSIONS}

    def look(path: str, language: str | None, text: str) -> tuple:
        managed, inside = places(path)
        tokens = tokens_of(language, text) if language else Counter()
        names = names_in(tokens, reserved[language]) if language else Counter()
        size = literal = 0
        for token, n in tokens.items():
            if not token.startswith(("//", "/*")) and not (token[0] == "#" and len(token) > 1):
                size += n * len(token)
                if token[0].isdigit() or (len(token) > 1 and token[-1] in "\"'`"):
                    literal += n * len(token)
        shapes = Counter(map(shape_of, names))
        return packed(text), managed, size, literal, list(names), list(names.values()), inside, list(stated_names(text)), *(shapes[x] for x in SHAPES)

    def work():
        strings = pa.list_(pa.string())
        types = [pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), strings, pa.list_(pa.int32()), strings, strings, *([pa.int32()] * len(SHAPES))]
        labels = [column.split()[0] for column in FILE.split(", ")]

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [look(path or "", language, text or "") for path, language, text in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)]
            columns = list(zip(*made, strict=True)) or [[]] * len(types)
            return pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=labels)

        return apply

    return per_slice(spread(files.select("repo_name", "file_path", language_of("file_path").alias("language"), "content")), work, FILE)


def name_grams(read: DataFrame) -> DataFrame:
    """(language, gram, n) over the distinct names of each language: at most 40^3 grams a language whatever the corpus.

    A name counts once, whatever the number of files or copies it stands in; packed texts teach no names.
    """

    def split():
        def add(batch: pa.RecordBatch, counts: Totals) -> None:
            for language, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[language].update(grams(name))

        return add

    names = read.where("language is not null and not is_packed").select("language", F.explode("names").alias("name")).distinct()
    return tally(names, split, "language string, gram string, n bigint", 1).groupBy("language", "gram").agg(F.sum("n").alias("n"))


class NameModel:
    """Bits per character of names in one language, and the language's own mean."""

    def __init__(self, counts: dict[str, int]):
        context: Counter = Counter()
        for gram, n in counts.items():
            context[gram[:2]] += n
        self.bits = {gram: -math.log2((n + 0.1) / (context[gram[:2]] + 4)) for gram, n in counts.items()}
        self.unseen = {start: -math.log2(0.1 / (n + 4)) for start, n in context.items()}
        self.mean = sum(self.bits[g] * n for g, n in counts.items()) / max(1, sum(counts.values()))

    def cross_entropy(self, name: str) -> float:
        own = grams(name)
        return sum(self.bits.get(g) or self.unseen.get(g[:2], 5.3) for g in own) / len(own)

    def mangled(self, name: str) -> bool:
        return self.cross_entropy(name) > self.mean + MANGLED_BITS


def verdict(is_packed: bool, size: int, literal: int, names: list[str], uses: list[int], model: NameModel) -> str | None:
    """Why a file of names like these was written by a program or holds only data, or None."""
    stems = {DIGITS.sub("0", name) for name in names}
    template = len(stems) + SHRUNK_NAMES < DIVERSITY * (len(names) + SHRUNK_NAMES)
    if is_packed:
        mangled = {name for name in names if model.mangled(name)}
        if sum(n for name, n in zip(names, uses, strict=True) if name in mangled) >= MANGLED_SHARE * (sum(uses) + SHRUNK_USES):
            return "generated" if template and sum(map(model.mangled, stems)) < 0.5 * len(stems) else "minified"
    if template:
        return "generated"
    in_names = sum(n * len(name) for name, n in zip(names, uses, strict=True))
    return "data" if in_names <= DATA_NAMES * size and literal >= DATA_SHARE * (size + SHRUNK_SIZE) else None


def judged(read: DataFrame) -> DataFrame:
    """(repo_name, file_path, reason, foreign) of each row with a reason or with foreign names where a package would put its own."""
    counts: defaultdict[str, dict[str, int]] = defaultdict(dict)
    for r in name_grams(read).collect():  # bounded by the alphabet
        counts[r.language][r.gram] = r.n
        counts[""][r.gram] = counts[""].get(r.gram, 0) + r.n
    shared = read.sparkSession.sparkContext.broadcast({language: NameModel(own) for language, own in counts.items()})

    def work():
        models = shared.value
        whole = models.get("") or NameModel({})

        def judge(language, is_packed, managed, size, literal, names, uses, inside, stated):
            model = models.get(language) or whole
            foreign = [x for where, own in (("folder", inside), ("text", stated)) for x in own if model.cross_entropy(x) > model.mean + FOREIGN_BITS[where]]
            return "vendored" if managed else verdict(is_packed, size, literal, names, uses, model) if language else None, foreign

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [judge(*row) for row in zip(*(batch.column(c).to_pylist() for c in range(2, 11)), strict=True)]
            reasons, foreign = pa.array([r for r, _ in made], pa.string()), pa.array([f for _, f in made], pa.list_(pa.string()))
            found = pa.array([r is not None or bool(f) for r, f in made], pa.bool_())
            return pa.RecordBatch.from_arrays([c.filter(found) for c in (batch.column(0), batch.column(1), reasons, foreign)], names=["repo_name", "file_path", "reason", "foreign"])

        return apply

    columns = [column.split()[0] for column in FILE.split(", ")][:11]
    return per_slice(read.select(*columns), work, "repo_name string, file_path string, reason string, foreign array<string>")


def foreign_styles(read: DataFrame) -> DataFrame:
    """(repo_name, file_path) of the files where copies are kept whose names' shapes diverge from those of the rest of their repository.

    Both are shrunk, the repository's shares towards its language's and the file's towards the repository's, so that few
    names tell little. Packed files form no style.
    """
    styled = read.where("language is not null and not is_packed")
    sums = [F.sum(x).alias(x) for x in SHAPES]
    language = styled.groupBy("language").agg(*sums).select("language", *(((F.col(x) + 1) / (sum(map(F.col, SHAPES)) + len(SHAPES))).alias(f"{x}_all") for x in SHAPES))
    repository = styled.groupBy(F.col("repo_name").alias("r"), F.col("language").alias("l")).agg(*(F.sum(x).alias(f"{x}_repo") for x in SHAPES))
    placed = styled.where("size(inside) > 0").join(F.broadcast(language), "language")  # a row a language
    placed = placed.join(repository, F.col("repo_name").eqNullSafe(F.col("r")) & (F.col("language") == F.col("l")))
    total = lambda suffix: sum((F.col(f"{x}{suffix}") for x in SHAPES), F.lit(0))
    rest = {x: (F.col(f"{x}_repo") - F.col(x) + SHRUNK_STYLE * F.col(f"{x}_all")) / (total("_repo") - total("") + SHRUNK_STYLE) for x in SHAPES}
    own = {x: (F.col(x) + SHRUNK_STYLE * rest[x]) / (total("") + SHRUNK_STYLE) for x in SHAPES}
    return placed.where(sum((own[x] * F.log(own[x] / rest[x]) for x in SHAPES), F.lit(0.0)) > STYLE_NATS).select("repo_name", "file_path")


def unwritten_files(files: DataFrame, dependencies: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(repo_name, file_path, reason) of each file that was generated, minified, vendored or holds only data.

    Reasons: vendored (a package's name), foreign (style), data, generated, minified. A language whose files are all
    packed is judged by the names of all languages. Null texts are judged by their place alone, as empty ones; a file with
    differing repeated rows is named if one row is, a package's name first, then the first reason in alphabetical order.
    """
    packages = known_packages(dependencies, files, *([] if chunks is None else [chunks]))
    read = cut(file_names(files))  # each text is read once
    found = cut(judged(read))
    named = found.select("repo_name", "file_path", F.explode("foreign").alias("name")).join(packages, "name", "left_semi")
    rows = (
        found.where("reason is not null").select("repo_name", "file_path", "reason")
        .unionByName(named.select("repo_name", "file_path", F.lit("vendored").alias("reason")))
        .unionByName(foreign_styles(read).withColumn("reason", F.lit("foreign")))
    )
    return rows.groupBy("repo_name", "file_path").agg(F.coalesce(F.max(F.when(F.col("reason") == "vendored", F.col("reason"))), F.min("reason")).alias("reason"))
