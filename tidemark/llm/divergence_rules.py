"""Quality rules by how far a document is from its language, with built-in functions alone.

Two histograms of each document, of character classes and of the common words of its language,
are compared with the mean histograms of all documents of that language by Jensen-Shannon
distance (base 2, 0 to 1). A document is kept if neither distance is over its limit, which is wider for short texts; one with
fewer than ``LEAST_WORDS`` words is too short to judge and is kept. Before that, base rules fail
texts of under ten words and those with more than a fifth of their words in repeated windows.

Histograms are made in one pass over the texts; the references are one row per language.

Defined results: a null or empty text has no words and fails; a null or unknown language is
a language of its own, judged by the common words of all; repeated rows are judged alike; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

BLANK = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_BASE, REPEAT_PERCENT, RUN = 30, 10, 20, 5
#: Limits of both distances: a part for every text, and one that shrinks with the root of its words.
CHARS_LIMIT, WORDS_LIMIT = (0.18, 0.3), (0.2, 0.5)

# Twelve of the most common words of four languages.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
}
CLASSES = {"upper": "[A-Z]+", "digit": "[0-9]+", "mark": r"[.,;:?'\"()-]+", "call": "!+"}


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    half = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: (half(a, (a + b) / 2) + half(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), _total(parts)))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: F.when(total > 0, c / total).otherwise(0.0))


def histograms(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The base counts of each document and its two histograms as shares."""
    names = sorted(COMMON)
    every = sorted({w for words in COMMON.values() for w in words})
    lists = F.create_map(*[x for n in names for x in (F.lit(n), F.array(*map(F.lit, COMMON[n])))])
    rows = docs.select(
        F.col(id).alias("doc_id"),
        F.coalesce(F.col(lang), F.lit("")).alias("lang"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = rows.select(
        "*",
        F.filter(F.split("text", BLANK), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.when(F.col("lang").isin(*names), lists[F.col("lang")]).otherwise(F.array(*map(F.lit, every))).alias("common"),
        F.length("text").alias("n_chars"),
        F.length(F.regexp_replace("text", BLANK, "")).alias("word_chars"),
        *[(F.length("text") - F.length(F.regexp_replace("text", p, ""))).alias(c) for c, p in CLASSES.items()],
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).alias("n_symbols"),
    ).drop("text")
    rows = rows.select(
        "*",
        F.size("words").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.filter("words", lambda w: F.array_contains("common", w)).alias("found"),
        F.when(
            F.size("words") > RUN,
            F.transform(F.sequence(F.lit(1), F.size("words") - RUN + 1), lambda i: F.xxhash64(*[F.element_at("words", i + k) for k in range(RUN)])),
        ).otherwise(F.array().cast("array<long>")).alias("runs"),
    ).drop("words", "lines")
    # Only texts with a repeated window sort theirs; neighbours in that order with one hash are repeats.
    rows = rows.withColumn(
        "ordered",
        F.when(
            F.size(F.array_distinct("runs")) < F.size("runs"),
            F.array_sort(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("runs")
    twin = lambda x, k: (F.get("ordered", k - 1)["h"] == x["h"]) | (F.get("ordered", k + 1)["h"] == x["h"])
    rows = rows.withColumn(
        "repeats", F.array_sort(F.transform(F.filter("ordered", lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"]))
    ).drop("ordered")
    step = F.transform("repeats", lambda p, k: F.least(F.lit(RUN), F.coalesce(F.get("repeats", k + 1) - p, F.lit(RUN))))
    others = F.col("n_chars") - (F.col("n_chars") - F.col("word_chars")) - F.col("n_symbols")
    counts = F.array(
        F.col("n_chars") - F.col("word_chars"), "n_symbols", *CLASSES, others - sum((F.col(c) for c in CLASSES), F.lit(0))
    ).cast("array<double>")
    hits = F.transform("common", lambda w: F.size(F.filter("found", lambda x: x == w)).cast("double"))
    return rows.select(
        "doc_id", "lang", F.col("n_words").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"), F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(step, F.lit(0), lambda acc, x: acc + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        _shares(counts, F.col("n_chars")).alias("chars"),
        _shares(F.concat(hits, F.array((F.col("n_words") - F.size("found")).cast("double"))), F.col("n_words")).alias("commons"),
    )


def judged(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts, both distances, ``base_failed`` and ``kept`` of each document."""
    rows = materialise(histograms(docs, id, text, lang), "histograms")
    known = rows.where(F.col("n_words") >= LEAST_WORDS)
    means = None
    for name in ("chars", "commons"):
        each = known.select("lang", F.posexplode(name).alias("i", "share")).groupBy("lang", "i").agg(F.round(F.avg("share"), 9).alias("share"))
        each = each.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "share"))), lambda x: x["share"]).alias(f"mean_{name}"))
        means = each if means is None else means.join(each, "lang")
    rows = rows.join(materialise(means, "means"), "lang", "left")
    rows = rows.withColumns({
        "base_failed": (F.col("n_words") < LEAST_BASE) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
        "chars_distance": F.round(F.coalesce(distance(F.col("chars"), F.col("mean_chars")), F.lit(0.0)), 6),
        "words_distance": F.round(F.coalesce(distance(F.col("commons"), F.col("mean_commons")), F.lit(0.0)), 6),
    })
    limit = lambda x: F.lit(x[0]) + F.lit(x[1]) / F.sqrt(F.greatest("n_words", F.lit(1)))
    near = (F.col("chars_distance") <= limit(CHARS_LIMIT)) & (F.col("words_distance") <= limit(WORDS_LIMIT))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ((F.col("n_words") < LEAST_WORDS) | near)).alias("kept"), "chars_distance", "words_distance",
    )
