"""Mixing sources to target weights by iterative proportional fitting, with built-in functions alone.

Tokens are summed in cells of source, language and topic. Weights of the cells are raked to the
targets of each marginal in turn until every marginal fits, then turned into probabilities that
take ``keep`` of all tokens, none over 1, and each document is taken or left by a hash of its
id. Cells are as many as there are combinations, not rows; they are split over tasks by
``CELLS_OF_TASK``, and each round of raking is written to the shared folder.

Defined results: a null or absent value of a marginal is a value of its own; a document without
words has weight 0 tokens and its cell's probability, in a cell without any words ``keep``, so far
as its values have targets; a cell whose value has no target is left out (probability 0), a target without cells is spread over the others; repeated rows share
their fate; a null id counts as 0; an empty table gives no rows.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import Scratch

MARGINALS = ("source", "lang", "topic")
ROUNDS, CLOSE, CELLS_OF_TASK = 40, 1e-6, 50_000
KEEP, TEMPER = 0.7, 0.7
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"


def topic(text: Column) -> Column:
    """A topic by form: tables, markup and symbols, numbers, or prose by its length."""
    body = F.greatest(F.length(text), F.lit(1))
    part = lambda p: F.length(text) - F.length(F.regexp_replace(text, p, ""))
    return (
        F.when(part(r"[|#*$%&<>{}=_]+") * 50 > body, "markup")
        .when(part("[0-9]+") * 20 > body, "numbers")
        .when(F.length(text) < 600, "short")
        .when(F.length(text) < 6000, "prose")
        .otherwise("long")
    )


def tempered(cells: DataFrame, column: str, power: float = TEMPER) -> DataFrame:
    """Target shares that flatten those found: tokens to a power under 1."""
    sums = cells.groupBy(F.col(column).alias("value")).agg(F.sum("tokens").alias("tokens"))
    return sums.select(F.lit(column).alias("marginal"), "value", F.pow(F.greatest("tokens", F.lit(1.0)), power).alias("share"))


def deviations(cells: DataFrame, marginals: tuple[str, ...], sums: dict[str, float], whole: float) -> dict[str, float]:
    """Of each marginal the largest part by which the weight of a value misses its goal."""
    out = {}
    for m in marginals:
        found = cells.groupBy(m).agg(F.sum("weight").alias("w"), F.first(f"goal_{m}").alias("g"))
        out[m] = found.agg(F.max(F.abs(F.col("w") / (F.col("g") / F.lit(sums[m]) * F.lit(whole)) - 1))).first()[0] or 0.0
    return out


def raked(cells: DataFrame, targets: DataFrame, marginals: tuple[str, ...] = MARGINALS, scratch: Scratch | None = None) -> DataFrame:
    """``cells`` with a ``weight`` whose sums by each marginal are as ``targets (marginal, value, share)``.

    Weights sum to the tokens of all cells. Targets that contradict each other can't all be met: a warning
    then names the deviation of each marginal that is left. ``scratch`` takes over the result's table."""
    own = Scratch(cells.sparkSession)
    parts = max(1, -(-cells.count() // CELLS_OF_TASK))
    now = cells.where("tokens > 0")
    for m in marginals:
        share = targets.where((F.col("marginal") == m) & (F.col("share") > 0)).select(F.col("value").alias(m), F.col("share").alias(f"goal_{m}"))
        now = now.join(share, m, "left")
    now = now.where(" AND ".join(f"goal_{m} IS NOT NULL" for m in marginals)).coalesce(parts)
    now = own.write(now.withColumn("weight", F.col("tokens").cast("double")), "start")
    sums = {m: now.groupBy(m).agg(F.first(f"goal_{m}").alias("g")).agg(F.sum("g")).first()[0] for m in marginals}
    whole = now.agg(F.sum("weight")).first()[0]
    for turn in range(ROUNDS):
        off = []
        for m in marginals:
            goal = F.col(f"goal_{m}") / F.lit(sums[m]) * F.lit(whole)
            now = now.withColumn("factor", goal / F.sum("weight").over(Window.partitionBy(m)))
            off.append(F.max(F.abs(F.col(f"off_{m}"))))
            now = now.withColumns({f"off_{m}": F.col("factor") - 1, "weight": F.col("weight") * F.col("factor")})
        now = own.write(now, f"raked{turn}")
        own.drop(f"raked{turn}")
        if max(abs(x or 0.0) for x in now.agg(*off).first()) < CLOSE:
            break
        now = now.drop(*[f"off_{m}" for m in marginals])
    else:
        off = deviations(now, marginals, sums, whole)
        if max(off.values()) >= CLOSE:
            warnings.warn(f"after {ROUNDS} rounds marginals still miss their targets, by at most these parts: {off}", stacklevel=2)
    if scratch:
        scratch.paths.update(own.paths)
    return now.select(*marginals, "tokens", "weight")


def probabilities(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """``cells`` with the ``probability`` in proportion to weight by token, 1 at most, that takes ``keep`` of
    all tokens: what cells at 1 cannot give is taken from the others."""
    ratio = F.col("weight") / F.col("tokens")
    goal = cells.agg(F.sum("tokens")).first()[0]
    if goal is None:
        return cells.withColumn("probability", F.lit(0.0))
    scale, last = 0.0, -1.0
    while scale != last:
        full = ratio * scale >= 1
        taken, open_weight = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        last, scale = scale, scale if not open_weight else max(scale, (keep * goal - taken) / open_weight)
    return cells.withColumn("probability", F.round(F.least(F.lit(1.0), ratio * scale), 9))


def _named(docs: DataFrame, text: str, marginals: dict[str, Column] | None) -> dict[str, Column]:
    """The marginals of a row, under names that no column of the table has."""
    whole = F.coalesce(F.col(text), F.lit(""))
    how = marginals or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(whole)}
    return {m: F.coalesce(c.cast("string"), F.lit(NONE)) for m, c in how.items()}


def fitted(rows: DataFrame, names: tuple[str, ...], targets: DataFrame | None, keep: float) -> DataFrame:
    """Of rows with the marginals and ``tokens``: the cells with ``weight`` of a token and ``probability``."""
    scratch = Scratch(rows.sparkSession)
    cells = scratch.write(rows.groupBy(*names).agg(F.sum("tokens").cast("double").alias("tokens")), "cells")
    if targets is None:
        for m in names:
            goal = tempered(cells, m)
            targets = goal if targets is None else targets.unionByName(goal)
    targets = scratch.write(targets, "targets")
    done = probabilities(raked(cells, targets, names, scratch), keep)
    done = done.select(*names, F.round(F.col("weight") / F.col("tokens"), 9).alias("weight"), "probability")
    blank = cells.where("tokens = 0")
    for m in names:
        aimed = targets.where((F.col("marginal") == m) & (F.col("share") > 0)).select(F.col("value").alias(m))
        blank = blank.join(aimed, m, "left_semi")
    blank = blank.select(*names, F.lit(0.0).alias("weight"), F.lit(float(keep)).alias("probability"))
    done = scratch.write(done.unionByName(blank), "fitted")
    scratch.drop("fitted")
    return done


def _draw(id: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(id.cast("long"), F.lit(0)), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def mixed(
    docs: DataFrame, targets: DataFrame | None = None, id: str = "doc_id", text: str = "text", keep: float = KEEP,
    marginals: dict[str, Column] | None = None, seed: int = 17,
) -> DataFrame:
    """``doc_id``, the marginals, ``tokens``, ``weight`` (of a token, relative to all), ``probability``, ``sampled``."""
    how = _named(docs, text, marginals)
    tokens = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), *[c.alias(m) for m, c in how.items()], tokens.alias("tokens"))
    rows = Scratch(docs.sparkSession).write(rows, "tokens")
    cells = fitted(rows, tuple(how), targets, keep)
    p = F.coalesce("probability", F.lit(0.0))
    return rows.join(cells, list(how), "left").select(
        "doc_id", *how, "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), p.alias("probability"), (_draw(F.col("doc_id"), seed) < p).alias("sampled")
    )


def sampled_documents(
    docs: DataFrame, targets: DataFrame | None = None, id: str = "doc_id", text: str = "text", keep: float = KEEP,
    marginals: dict[str, Column] | None = None, seed: int = 17,
) -> DataFrame:
    """The rows of ``docs`` that ``mixed`` samples, with all their columns and no others."""
    how = _named(docs, text, marginals)
    tokens = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(*[c.alias(m) for m, c in how.items()], tokens.alias("tokens"))
    cells = fitted(rows, tuple(how), targets, keep)
    inner = [f"_mix_{m}" for m in how]
    cells = cells.select(*[F.col(m).alias(x) for m, x in zip(how, inner)], F.col("probability").alias("_mix_p"))
    marked = docs.withColumns({x: c for x, c in zip(inner, how.values())})
    return marked.join(cells, inner).where(_draw(F.col(id), seed) < F.col("_mix_p")).select(*docs.columns)
