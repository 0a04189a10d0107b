"""Source files that do not parse (problem 4)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.llm.lexing import Lexer, one_branch
from codelake.llm.parsing import NEWLINE, Tables, read_grammar
from codelake.llm.tasks import per_slice, spread

# Extensions of the languages, `.h` being C.
EXTENSIONS = {
    "python": "py pyw",
    "javascript": "js jsx mjs cjs",
    "typescript": "ts tsx",
    "php": "php php3 php4 php5 phtml",
    "go": "go",
    "rust": "rs",
    "java": "java",
    "cpp": "cpp cc cxx hpp hh hxx",
    "c": "c h",
    "csharp": "cs",
}
#: A conditional of the preprocessor with more than one branch.
CONDITIONAL = re.compile(r"^[ \t]*#[ \t]*(?:else|elif)\b", re.MULTILINE)
#: States of a language's tables from which a worker makes them anew.
MOST_STATES = 1_000_000


def language_of(path: str | Column) -> Column:
    """The language a path's extension stands for, in any case; null for others."""
    extension = F.lower(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"\.([^./]+)\s*$", 1))
    known = [x for language, own in EXTENSIONS.items() for e in own.split() for x in (F.lit(e), F.lit(language))]
    return F.create_map(*known)[extension]


class Parsers:
    """The lexer and tables of each language, made when first needed."""

    def __init__(self, grammars: dict):
        self.grammars, self.ready = grammars, {}

    def first_error(self, language: str, text: str, markup: bool = False) -> int | None:
        """None for a text of the language or one without tokens, else the share of its tokens, in per mille, before the first that cannot stand there.

        Of conditionals of the preprocessor the first branches are read together, and then the last ones. Markup or
        templates nested beyond what a parser of expressions takes make an error at the beginning.
        """
        if language in ("c", "cpp") and CONDITIONAL.search(text):
            errors = (self.first_error_of(language, one_branch(text, last), markup) for last in (False, True))
            return next((e for e in errors if e is not None), None)
        try:
            return self.first_error_of(language, text, markup)
        except RecursionError:
            return 0

    def first_error_of(self, language: str, text: str, markup: bool) -> int | None:
        tables, lexer = self.ready.get(language, (None, None))
        if tables is None or len(tables.moves) > MOST_STATES:
            tables = Tables(self.grammars[language])
            lexer = Lexer(language, tables, self.grammars[language])
            self.ready[language] = tables, lexer
        tokens = lexer(text, markup)
        if not tokens.strip(NEWLINE):  # nothing but comments
            return None
        at = tables.accepts(tokens)
        return None if at < 0 else 1000 * at // max(1, len(tokens))


def invalid_files(files: DataFrame) -> DataFrame:
    """(repo_name, file_path, language, error_at) of each file with a text that its extension's grammar does not accept.

    error_at is the place of the first unrecoverable error in per mille of the file's tokens. Null texts and unknown
    extensions are no case, an empty text is valid wherever its grammar allows it; repeated rows count once.
    """
    grammars = {language: read_grammar(language) for language in EXTENSIONS}

    def work():
        parsers = Parsers(grammars)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)
            errors = pa.array([parsers.first_error(x, t, p.rstrip()[-1:] in "xX") if t.strip() else None for p, x, t in rows], pa.int32())  # .jsx, .tsx
            wrong = errors.is_valid()
            return pa.RecordBatch.from_arrays([c.filter(wrong) for c in (*batch.columns[:3], errors)], names=["repo_name", "file_path", "language", "error_at"])

        return apply

    source = files.select("repo_name", "file_path", language_of("file_path").alias("language"), "content").where("content is not null and language is not null")
    found = per_slice(spread(source), work, "repo_name string, file_path string, language string, error_at int")
    return found.groupBy("repo_name", "file_path", "language").agg(F.min("error_at").alias("error_at"))


def reported_failures(jobs: DataFrame) -> DataFrame:
    """(repo_name, path) that indexing jobs list as failed: one spelling a path (no workspace prefix, note or blanks, lower case)."""
    path = F.regexp_replace(F.btrim(F.col("f")), r":\s.*$", "")
    path = F.regexp_replace(F.regexp_replace(path, r"^(?:/workspace/(?!$))", ""), r"^\./+", "")
    return (
        jobs.select("repo_name", F.explode("progress.failed_files").alias("f")).select("repo_name", F.lower(F.btrim(path)).alias("path")).where("path != ''").distinct()
    )


def failure_rates(files: DataFrame, invalid: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per repository and language: files with a text, invalid ones, their share, and how many of them a job reported."""
    all_files = (
        files.where("content is not null").select("repo_name", "file_path", language_of("file_path").alias("language")).where("language is not null").distinct()
    )
    reported = reported_failures(jobs).select(F.col("repo_name").alias("r"), "path")
    same = F.col("repo_name").eqNullSafe(F.col("r")) & (F.lower("file_path") == F.col("path"))
    flagged = invalid.join(reported, same, "left").select("repo_name", "language", F.col("path").isNotNull().alias("reported"))
    wrong = flagged.groupBy("repo_name", "language").agg(F.count("*").alias("n_invalid"), F.count_if("reported").alias("n_reported"))
    total = all_files.groupBy("repo_name", "language").agg(F.count("*").alias("n_files"))
    both = total["repo_name"].eqNullSafe(wrong["repo_name"]) & (total["language"] == wrong["language"])
    count = lambda c: F.coalesce(wrong[c], F.lit(0)).alias(c)
    joined = total.join(wrong, both, "left").select(total["repo_name"], total["language"], "n_files", count("n_invalid"), count("n_reported"))
    return joined.withColumn("invalid_share", F.round(F.col("n_invalid") / F.col("n_files"), 6))
