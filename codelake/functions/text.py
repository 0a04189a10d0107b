"""Scalar functions over ids, texts and documents' headers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(path: Column, start_line: Column, content: Column) -> Column:
    """First 16 hex digits of the digest of ``path:line:content``; null parts count as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (path, start_line, content)]
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def point_uuid(hexadecimal: Column) -> Column:
    """A hex id, padded with zeros to 32 digits, in the form of a UUID."""
    return F.regexp_replace(F.rpad(hexadecimal, 32, "0"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def cache_key(model: str, text: Column) -> Column:
    """Digest of ``model:text`` over the whole text."""
    return F.sha2(F.concat(F.lit(model + ":"), text), 256)


def embedder_text(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def header_field(text: Column, name: str, chars: int = 8192) -> Column:
    """The value behind ``name:`` up to its line's end within the first characters; null where blank or missing."""
    return F.nullif(F.trim(F.regexp_extract(F.substring(text, 1, chars), rf"(?i){name}:[ \t]*([^\r\n]*)", 1)), F.lit(""))


def unquoted(text: Column, quotes: str = "\"'<>") -> Column:
    return F.btrim(text, F.lit(quotes))


def bare_import(text: Column, keyword: str) -> Column:
    """An import statement's target: without its keyword and its end."""
    return F.trim(F.replace(F.replace(text, F.lit(keyword + " "), F.lit("")), F.lit(";"), F.lit("")))


def is_interface_name(name: Column) -> Column:
    """By custom an interface's name is I and another capital."""
    return name.rlike("^I[A-Z]")


def framework(dependency_type: Column, name: Column) -> Column:
    """Framework a dependency belongs to, by its type, else by its name."""
    lower = F.lower(name)
    return (
        F.when(dependency_type.isin("wordpress_plugin", "wordpress_theme"), "wordpress")
        .when(lower.contains("symfony"), "symfony")
        .when(lower.contains("laravel"), "laravel")
        .when(lower.contains("drupal"), "drupal")
        .when(dependency_type == "npm_package", "nodejs")
        .when(dependency_type == "composer_package", "php")
        .otherwise("unknown")
    )


def percent(part: Column, whole: Column) -> Column:
    """Part of whole in percent to two places; 0 where the whole is 0 or unknown."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)) * 100, 2)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end; null while either is unknown."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000


def comma_list(text: Column) -> Column:
    """The trimmed, non-empty parts of a comma-separated text."""
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")
