"""Mixing sources to target weights (problem 7).

Weights: temperature mixing relative to the targets. The sources' own token shares are raised to an exponent and the
targets to what is left of it, w = target^(1-a) * own^a normalised; with equal targets this is the plain own^a. The
exponent is bisected to the smallest that keeps every source within its repetition limit at the wanted size, so targets
are left only as far as the limits demand. ``tempered_to_targets`` has the other criterion, own^a of the targets' entropy.
Realisation: each source's budget is laid out as whole permutations of its documents, one per repeat, and the start of a
last one; blocks cut these permutations so that every block holds each source in its weight.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelake.operators.running import running_before

#: Sources one mix may have: their sizes are gathered at the driver.
MAX_SOURCES = 10_000
#: Size of a mix, as part of the tokens its sources have, where none is wanted.
FILL = 0.5
#: Documents of a permutation that one window holds, about: a source is laid out in as many hash buckets as it needs.
BUCKET_ROWS = 50_000
#: Exponent beyond which shares that differ at all have nothing but the largest left.
MAX_EXPONENT = 2.0**40


def entropy(weights: list[float]) -> float:
    total = sum(weights)
    return -sum(w / total * math.log(w / total) for w in weights if w > 0)


def tempered(shares: list[float], exponent: float) -> list[float]:
    """The shares to the power of ``exponent``, summing to 1; shares of 0 stay 0."""
    largest = max(shares, default=0.0)
    raised = [(s / largest) ** exponent if s > 0 else 0.0 for s in shares]
    return [r / sum(raised) for r in raised] if sum(raised) else raised


def exponent_for_entropy(shares: list[float], target: float) -> float:
    """The exponent from 0 whose tempered shares have the target entropy, or the nearest that bisection can tell.

    Entropy falls from log(n) at 0 to that of the shares themselves at 1 and to log(number of largest shares) without end.
    """
    low, high = 0.0, 1.0
    while high < MAX_EXPONENT and entropy(tempered(shares, high)) > target:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(tempered(shares, middle)) > target else (low, middle)
    return high


def weights_within_limits(targets: list[float], tokens: list[float], repeats: list[float], size: float | None) -> tuple[list[float], float, float]:
    """(weights, size, exponent) of a mix of sources with so many tokens, each to be used so many times at most.

    Without a size the mix is the largest that meets every target exactly, by exponent 0. With one, weights move from the
    targets (0) to the sources' own shares (1) by the smallest exponent that keeps every source within its limit; a size
    that even the own shares cannot fill comes down to what they can. Sources without tokens, repeats or target get no
    weight and the targets of the others keep their proportions.
    """
    room = [n * r for n, r in zip(tokens, repeats, strict=True)]
    usable = tempered([t if c > 0 else 0.0 for t, c in zip(targets, room, strict=True)], 1)
    if not sum(usable):
        return [0.0] * len(targets), 0.0, 0.0
    own = tempered([n if t > 0 else 0.0 for t, n in zip(usable, tokens, strict=True)], 1)

    def at(a: float) -> list[float]:
        return tempered([t ** (1 - a) * o**a if t > 0 else 0.0 for t, o in zip(usable, own, strict=True)], 1)

    def largest(weights: list[float]) -> float:
        return min(c / w for w, c in zip(weights, room, strict=True) if w > 0)

    if size is None or size <= largest(usable):
        return usable, largest(usable) if size is None else size, 0.0
    size = max(min(size, largest(own)), largest(usable))
    if size == largest(usable):  # the own shares have less room than the targets
        return usable, size, 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if largest(at(middle)) >= size * (1 - 1e-12) else (middle, high)
    return at(high), size, high


def source_sizes(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of ``targets``: source, target_share, max_repeats, n_docs, n_tokens (0 where nothing is found).

    Null targets count as 0, null or negative repeats as 0; a source named twice keeps its largest values. Documents
    without tokens, with a null source or one outside the targets take no part.
    """
    wanted = targets.where("source is not null").groupBy("source").agg(
        F.greatest(F.max(F.coalesce("target_share", F.lit(0.0))), F.lit(0.0)).alias("target_share"), F.greatest(F.max(F.coalesce("max_repeats", F.lit(0))), F.lit(0)).alias("max_repeats")
    )
    sizes = counted.where("n_tokens > 0").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return wanted.join(sizes, "source", "left").fillna(0, ["n_docs", "n_tokens"])


def _few(sizes: DataFrame) -> list:
    rows = sizes.orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return rows


def _planned(counted: DataFrame, rows: list, weights: list[float], total: float, exponent: float) -> DataFrame:
    budgets = [min(math.floor(w * total + 1e-6), r.n_tokens * r.max_repeats) for w, r in zip(weights, rows, strict=True)]
    made = [(r.source, r.target_share, r.max_repeats, r.n_docs, r.n_tokens, w, b, b / r.n_tokens if r.n_tokens else 0.0, exponent) for r, w, b in zip(rows, weights, budgets, strict=True)]
    schema = "source string, target_share double, max_repeats int, n_docs bigint, source_tokens bigint, weight double, budget bigint, epochs double, exponent double"
    return counted.sparkSession.createDataFrame(made, schema)


def plan(counted: DataFrame, targets: DataFrame, size: float | None = None, exact: bool = False) -> DataFrame:
    """The sizes with weight, budget (tokens), epochs (budget by tokens) and exponent, a row per source.

    The wanted size in tokens is FILL of what the sources have unless given; ``exact`` takes the largest mix that meets
    every target.
    """
    rows = _few(source_sizes(counted, targets))
    size = None if exact else FILL * sum(r.n_tokens for r in rows if r.target_share > 0) if size is None else size
    return _planned(counted, rows, *weights_within_limits([r.target_share for r in rows], [float(r.n_tokens) for r in rows], [float(r.max_repeats) for r in rows], size))


def tempered_to_targets(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """As ``plan``, with the sources' own token shares raised to the one exponent from 0 at which their entropy is that of the target shares.

    The mix is as large as the repetition limits let these weights be. Sources without tokens or repeats get no weight.
    """
    rows = _few(source_sizes(counted, targets))
    room = [float(r.n_tokens * r.max_repeats) for r in rows]
    own = tempered([float(r.n_tokens) if c > 0 else 0.0 for r, c in zip(rows, room, strict=True)], 1)
    wanted = [r.target_share for r, c in zip(rows, room, strict=True) if c > 0]
    exponent = exponent_for_entropy(own, entropy(wanted)) if sum(wanted) else 1.0
    weights = tempered(own, exponent)
    total = min((c / w for w, c in zip(weights, room, strict=True) if w > 0), default=0.0)
    return _planned(counted, rows, weights, total, exponent)


def realise(counted: DataFrame, planned: DataFrame, blocks: int = 100, seed: int = 1) -> DataFrame:
    """(doc_id, source, repeat, n_tokens, block): a row for each use of a document, repeat from 1.

    Repeat r of a source is a permutation of all its documents by a hash of (seed, r, doc_id); the last one stops before
    it would pass the budget, so a source misses its budget by less than one document. Block b holds the documents
    between b and b + 1 of ``blocks`` equal parts of the source's budget. A permutation is laid out in hash buckets of
    about BUCKET_ROWS documents, so a source of any size spreads.
    """
    active = F.broadcast(planned.where("budget > 0").select("source", "n_docs", "source_tokens", "budget", "epochs"))  # at most MAX_SOURCES rows
    uses = (
        counted.where("n_tokens > 0")
        .select("doc_id", "source", "n_tokens")
        .join(active, "source")
        .withColumn("repeat", F.explode(F.sequence(F.lit(1), F.ceil("epochs").cast("int"))))
        .withColumn("__h", F.xxhash64(F.lit(seed), "repeat", "doc_id"))
    )
    spread = F.floor((F.col("__h") / F.lit(2.0**63) + 1) * F.ceil(F.col("n_docs") / BUCKET_ROWS) / 2)
    laid = running_before(uses, ["source", "repeat"], ["__h", "doc_id"], "n_tokens", spread, "before")
    start = (F.col("repeat") - 1) * F.col("source_tokens") + F.col("before")
    return laid.where(start + F.col("n_tokens") <= F.col("budget")).select(
        "doc_id", "source", "repeat", "n_tokens", F.least(F.floor(start / F.col("budget") * blocks), F.lit(blocks - 1)).cast("int").alias("block")
    )


def report(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """Per source: what was wanted, what is there and what the mix reached."""
    reached = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.countDistinct("doc_id").alias("docs_used"), F.max("repeat").alias("most_repeats"))
    return (
        planned.join(reached, "source", "left")
        .fillna(0, ["mixed_tokens", "docs_used", "most_repeats"])
        .withColumn("total", F.sum("mixed_tokens").over(Window.partitionBy()))  # at most MAX_SOURCES rows
        .select(
            "source", "target_share", "exponent", "weight", "max_repeats", "n_docs", "source_tokens", "budget", "mixed_tokens", "docs_used", "most_repeats",
            F.coalesce(F.col("mixed_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"),
        )
    )
