"""Splitting oversized chunks at natural boundaries (problem 2).

Between every two lines the words of the lines before and after are compared; the valleys of that similarity mark where
the subject changes. Each piece ends at the deepest valley of the size window it may fill, raised where the code itself
pauses (blank lines, closed blocks), and the next piece begins some lines earlier.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.tasks import per_slice

#: Lines on either side of a gap that are compared, and the share of the limit a piece fills at least before it may end.
BLOCK, LEAST_FILL = 6, 0.5
#: How much a pause of the code counts against the depth of a valley (which is at most 2).
PAUSE = 0.5
#: Chunk types that may have limits of their own; they travel with every task.
MOST_TYPES = 10_000

WORD = re.compile(r"[^\W\d]\w*")
LINE = re.compile(r"[^\n]*\n|[^\n]+")
BREAK = re.compile(r"[\s,;(){}\[\]]")


def cohesion(lines: list[str]) -> list[float]:
    """Cosine similarity of the words in the BLOCK lines before and after each gap; gap g lies before line g, the ends count as 0."""
    words = [Counter(WORD.findall(line)) for line in lines]
    before, after = Counter(), sum(words[:BLOCK], Counter())

    def drop(block: Counter, line: Counter) -> None:
        for word, n in line.items():
            if block[word] == n:
                del block[word]
            else:
                block[word] -= n

    similar = [0.0]
    for gap in range(1, len(lines)):
        before.update(words[gap - 1])
        drop(after, words[gap - 1])
        if gap > BLOCK:
            drop(before, words[gap - 1 - BLOCK])
        if gap + BLOCK <= len(lines):
            after.update(words[gap + BLOCK - 1])
        dot = sum(n * after[w] for w, n in before.items() if w in after)
        norm = math.sqrt(sum(n * n for n in before.values()) * sum(n * n for n in after.values()))
        similar.append(dot / norm if norm else 0.0)
    return [*similar, 0.0]


def depths(similar: list[float]) -> list[float]:
    """How far the similarity at each gap lies below the nearest peaks on both sides."""

    def peaks(values: list[float]) -> list[float]:
        found: list[float] = []
        for at, value in enumerate(values):
            found.append(max(value, found[-1]) if at and values[at - 1] >= value else value)
        return found

    left, right = peaks(similar), peaks(similar[::-1])[::-1]
    return [a + b - 2 * s for a, b, s in zip(left, right, similar, strict=True)]


def pause(lines: list[str], gap: int) -> float:
    """1 before or after a blank line, up to 1 the further left the line behind the gap begins, less inside deep blocks."""
    here, last = lines[gap], lines[gap - 1]
    if not last.strip():
        return 1.0
    indent = len(here) - len(here.lstrip())
    closed = len(last) - len(last.lstrip()) >= indent
    return (0.8 if closed else 0.0) / (1 + indent / 4)


def long_line(line: str, limit: int) -> list[str]:
    """A line in parts within the limit, cut behind the last blank or bracket of the second half where there is one."""
    parts, at = [], 0
    while len(line) - at > limit:
        cuts = [m.end() for m in BREAK.finditer(line, at + limit // 2, at + limit)]
        cut = cuts[-1] if cuts else at + limit
        parts.append(line[at:cut])
        at = cut
    return [*parts, line[at:]]


def split(text: str, limit: int, overlap: int, first_line: int = 1) -> list[tuple[int, int, str]]:
    """(start_line, end_line, text) of the pieces, each within the limit; a text within it is one piece.

    Line ends belong to their lines. Consecutive pieces share ``overlap`` whole lines, fewer where these and the next
    line would not fit together; parts of a line that is too long for a piece are not shared. Without the shared lines
    the pieces make up the text.
    """
    units: list[tuple[int, str, bool]] = []
    for number, line in enumerate(LINE.findall(text), first_line):
        parts = [line] if len(line) <= limit else long_line(line, limit)
        units += [(number, part, len(parts) == 1) for part in parts]
    if not units:
        return []
    texts = [u[1] for u in units]
    valley = depths(cohesion(texts)) if len(text) > limit else []
    pieces, start, fresh = [], 0, 0  # fresh: the first unit that no piece has yet
    while True:
        end, size = start, 0
        while end < len(units) and size + len(texts[end]) <= limit:
            size += len(texts[end])
            end += 1
        if end < len(units):
            best, score, at = end, -1.0, size
            for gap in range(end, fresh, -1):
                if at < LEAST_FILL * limit and gap < end:
                    break
                value = valley[gap] + PAUSE * pause(texts, gap) + (1.0 if gap < len(units) and units[gap][0] != units[gap - 1][0] else -1.0)
                if value > score:
                    best, score = gap, value
                at -= len(texts[gap - 1])
            end = best
        pieces.append((units[start][0], units[end - 1][0], "".join(texts[start:end])))
        if end == len(units):
            return pieces
        begun, start, shared = start, end, len(texts[end])
        while end - start < overlap and start - 1 > begun and units[start - 1][2] and shared + len(texts[start - 1]) <= limit:
            start -= 1
            shared += len(texts[start])
        fresh = end


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """The distinct (repo_name, id, start_line, content, max_chars, overlap_lines) of chunks longer than their type's limit.

    ``*`` is the limit of every other or null type; without one these have none. Null limits and contents are no case, a
    limit below 1 counts as 1, a missing overlap as 0; a type listed twice keeps its smallest limit and overlap.
    """
    rows = limits.where("chunk_type is not null and max_chars is not null").groupBy("chunk_type").agg(F.min("max_chars").alias("m"), F.min(F.coalesce("overlap_lines", F.lit(0))).alias("o"))
    by_type = {r.chunk_type: (max(1, r.m), max(0, r.o)) for r in rows.limit(MOST_TYPES + 1).collect()}
    if len(by_type) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} chunk types")
    other = by_type.pop("*", (None, None))

    def limit(part: int):
        fallback = F.lit(other[part]).cast("int")
        known = F.create_map(*(F.lit(x) for t, pair in by_type.items() for x in (t, pair[part]))) if by_type else None
        return F.coalesce(known[F.col("chunk_type")], fallback) if known is not None else fallback

    wanted = chunks.select("repo_name", "id", F.coalesce("start_line", F.lit(1)).alias("start_line"), "content", limit(0).alias("max_chars"), limit(1).alias("overlap_lines"))
    return wanted.where(F.length("content") > F.col("max_chars")).dropDuplicates(["repo_name", "id", "start_line", "content"])


def split_chunks(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(repo_name, id, piece, start_line, end_line, content) of every chunk that must be split, pieces numbered from 1."""

    def work():
        def apply(batch: pa.RecordBatch) -> pa.Table:
            out: list[tuple] = []
            for repo, key, first, text, limit, overlap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(repo, key, n, *piece) for n, piece in enumerate(split(text, limit, overlap, first), 1)]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["repo_name", "id", "piece", "start_line", "end_line", "content"])

        return apply

    return per_slice(oversized(chunks, limits), work, "repo_name string, id string, piece int, start_line int, end_line int, content string")


def split_ids(pieces: DataFrame) -> DataFrame:
    """The (repo_name, id) of the chunks that came out in more than one piece."""
    return pieces.where("piece = 2").select("repo_name", "id").distinct()
