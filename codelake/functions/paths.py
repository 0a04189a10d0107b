"""Predicates and fields of paths, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to language; `.h` is C.
LANGUAGE_OF_EXTENSION = {
    "py": "python", "pyw": "python",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript",
    "php": "php", "php3": "php", "php4": "php", "php5": "php", "phtml": "php",
    "go": "go",
    "rs": "rust",
    "java": "java",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
    "c": "c", "h": "c",
    "cs": "csharp",
}
# Folders that are never indexed, and those a dependency's own files are skipped in.
ALWAYS_EXCLUDED = ("vendor/**", "node_modules/**")
WATCH_EXCLUDED = ("node_modules", "vendor", "__pycache__", "venv", "env", "dist", "build", "target", "coverage", "bin", "obj")
DEPENDENCY_SKIPPED = ("vendor", "node_modules", "tests", "test", "docs", "examples", "dist", "build")


def extension(path: Column) -> Column:
    """Lower-case suffix without its dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """Language of a path by its suffix in any case; null where unsupported."""
    return F.create_map(*(F.lit(x) for pair in LANGUAGE_OF_EXTENSION.items() for x in pair))[extension(path)]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def segments(path: Column) -> Column:
    return F.split(path, "/")


def is_minified_name(path: Column) -> Column:
    name = basename(path)
    return name.contains(".min.") | name.endswith(".min")


def is_hidden(path: Column) -> Column:
    """Whether a part of the path begins with a dot."""
    return F.exists(segments(path), lambda part: part.startswith("."))


def in_folder(path: Column, names: tuple[str, ...]) -> Column:
    """Whether a folder of the path (not the file itself) has one of the names."""
    parts = segments(path)
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, names)))


def gitignored(path: Column, patterns: list[str]) -> Column:
    """First match excludes; ``!x`` is passed over; ``dir/*`` and ``dir/`` are prefixes; a bare name matches any segment; no globs."""
    hit = F.lit(False)
    for pattern in (p.strip() for p in patterns):
        if not pattern or pattern.startswith(("#", "!")):
            continue
        if pattern.endswith("/*"):
            hit |= path.startswith(pattern[:-1])
        elif "/" in pattern:
            folder = pattern.rstrip("/")
            hit |= path.startswith(folder + "/") | (path == folder)
        else:
            hit |= F.array_contains(segments(path), pattern)
    return hit


def excluded(path: Column, patterns: tuple[str, ...] | list[str] = ()) -> Column:
    """``dir/**`` is recursive, ``dir/*`` one level, another ``*`` matches the last parts of the path, else equal or below."""
    hit = F.lit(False)
    for pattern in dict.fromkeys([*patterns, *ALWAYS_EXCLUDED]):
        if pattern.endswith("/**"):
            hit |= path.startswith(pattern[:-2]) | (path == pattern[:-3])
        elif pattern.endswith("/*"):
            rest = re.escape(pattern[:-1])
            hit |= path.rlike(f"^{rest}[^/]+$")
        elif "*" in pattern:
            glob = re.escape(pattern).replace(r"\*", "[^/]*")
            hit |= path.rlike(f"(^|/){glob}$")
        else:
            hit |= (path == pattern) | path.startswith(pattern.rstrip("/") + "/")
    return hit


def watched(path: Column) -> Column:
    """Whether a change to the path concerns the index."""
    return ~in_folder(path, WATCH_EXCLUDED) & ~is_hidden(path) & language(path).isNotNull()


def indexable(path: Column, size: Column, patterns: tuple[str, ...] | list[str] = (), ignored: list[str] | None = None, max_bytes: int = 500_000) -> Column:
    """Supported, not excluded, not minified, not too large; an unknown size counts as small."""
    keep = language(path).isNotNull() & ~excluded(path, patterns) & ~is_minified_name(path) & (F.coalesce(size, F.lit(0)) <= max_bytes)
    return keep & ~gitignored(path, ignored) if ignored else keep
