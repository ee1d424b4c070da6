"""Splitting texts into overlapping chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import constants as C

SEPARATORS = ["\n\n", "\n", " ", ""]
#: What Python's ``strip`` takes off.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def chunk_fixed(
    df: DataFrame, text: str, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP
) -> DataFrame:
    """Chunks of ``size`` characters every ``size - overlap``, with their position.

    The text is cut once into pieces of one stride; a chunk is a piece and the head of
    what follows, so the work grows with the length of the text, not its square.
    """
    stride = size - overlap
    if not 0 <= overlap <= stride:
        raise ValueError("overlap must be at most half of size")
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{stride}}}"), 0)
    last = F.element_at(F.col("pieces__c"), -1)
    n = F.size("pieces__c") - F.when(
        (F.size("pieces__c") > 1) & (F.length(last) <= overlap), 1
    ).otherwise(0)
    chunks = F.transform(
        F.slice(F.col("pieces__c"), F.lit(1), n),
        lambda p, i: F.concat(
            p, F.coalesce(F.substring(F.get("pieces__c", i + 1), 1, overlap), F.lit(""))
        ),
    )
    keep = [c for c in df.columns if c != text]
    # A text that is not empty has a chunk, so the outer form adds no row; the plain form
    # would add a filter on the number of chunks and cut every text twice for it.
    return (
        df.where(F.length(text) > 0)
        .withColumn("pieces__c", pieces)
        .select(*keep, F.posexplode_outer(chunks).alias("chunk_no", "chunk"))
    )


def _split_keep(text: str, sep: str) -> list[str]:
    """Pieces of ``text``; each piece after the first starts with the separator."""
    if not sep:
        return list(text)
    head, *rest = text.split(sep)
    return [p for p in [head, *(sep + r for r in rest)] if p]


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Greedy packing; each chunk repeats the trailing pieces that fit in ``overlap``."""
    out: list[str] = []
    start = total = 0
    for i, piece in enumerate(pieces):
        if total + len(piece) > size and i > start:
            out.append("".join(pieces[start:i]))
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(pieces[start])
                start += 1
        total += len(piece)
    if start < len(pieces):
        out.append("".join(pieces[start:]))
    return [c for c in (chunk.strip() for chunk in out) if c]


def split_recursive(
    text: str, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP,
    separators: list[str] | None = None,
) -> list[str]:
    """Split at paragraphs, else lines, else words, else characters, then pack: the chunks of
    one text in plain Python."""
    separators = SEPARATORS if separators is None else separators
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    sep, finer = separators[at], separators[at + 1 :]
    chunks: list[str] = []
    run: list[str] = []
    for piece in _split_keep(text, sep):
        if len(piece) < size or not finer:
            run.append(piece)
            continue
        chunks += _pack(run, size, overlap)
        run = []
        chunks += split_recursive(piece, size, overlap, finer)
    return chunks + _pack(run, size, overlap)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def _pieces(text: Column, sep: str, size: int) -> Column:
    """(s, n, cut) of each piece of ``text``, which starts with the separator; ``cut`` where a
    piece isn't packed with the one before: at the first, at long ones and after them."""
    parts = F.transform(
        F.split(text, sep.replace("\n", "\\n"), -1), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(sep), p))
    )
    sized = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(p.alias("s"), F.length(p).alias("n")))

    def flagged(own: Column) -> Column:
        # Of the array moved by one, so that each piece meets the length before it; it ends one later.
        before = F.concat(F.array(F.lit(size)), F.transform(own, lambda p: p["n"]))
        return F.zip_with(
            own, F.slice(before, F.lit(1), F.size(own)),
            lambda p, n: F.struct(p["s"], p["n"], ((p["n"] >= size) | (n >= size)).alias("cut")),
        )

    return _let(sized, flagged)


def _finer(pieces: Column, sep: str, size: int) -> Column:
    """Pieces of ``size`` and more split at the next separator."""
    split = lambda p: F.when(p["n"] < size, F.array(p)).otherwise(_pieces(p["s"], sep, size))
    return F.flatten(F.transform(pieces, split))


def _repeated(pieces: Column, at: Column, start: Column, length: Column, size: int, overlap: int) -> Column:
    """How many pieces before ``at`` the next chunk repeats, and their length."""
    room = F.least(F.lit(overlap), F.lit(size) - length)
    first = F.greatest(start, at - overlap)
    none = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def back(acc: Column, p: Column) -> Column:
        fits = acc["open"] & (acc["n"] + p["n"] <= room)
        return F.struct(
            (acc["k"] + fits.cast("int")).alias("k"),
            (acc["n"] + F.when(fits, p["n"]).otherwise(0)).alias("n"), fits.alias("open"),
        )

    return F.aggregate(F.reverse(F.slice(pieces, first + 1, at - first)), none, back)


def _packed(pieces: Column, size: int, overlap: int) -> Column:
    """Chunks of consecutive pieces: a fold whose state is the open chunk. A piece of ``size`` and
    more is a chunk by itself."""
    closed = F.array().cast("array<struct<start:int,n:int>>")
    zero = F.struct(closed.alias("out"), F.lit(0).alias("start"), F.lit(0).alias("at"), F.lit(0).alias("total"))

    def with_open(acc: Column) -> Column:
        return F.concat(
            acc["out"], F.array(F.struct(acc["start"].alias("start"), (acc["at"] - acc["start"]).alias("n")))
        )

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"]
        state = lambda out, start, total: F.struct(
            out.alias("out"), start.alias("start"), (at + 1).alias("at"), total.alias("total")
        )
        packed = _let(
            _repeated(pieces, at, acc["start"], p["n"], size, overlap),
            lambda r: state(with_open(acc), at - r["k"], r["n"] + p["n"]),
        )
        return (
            F.when((at > 0) & p["cut"], state(with_open(acc), at, p["n"]))
            .when((at > 0) & (acc["total"] + p["n"] > size), packed)
            .otherwise(state(acc["out"], acc["start"], acc["total"] + p["n"]))
        )

    text = lambda c: F.array_join(F.transform(F.slice(pieces, c["start"] + 1, c["n"]), lambda p: p["s"]), "")
    return F.transform(F.aggregate(pieces, zero, step, with_open), text)


def _sliding(text: Column, size: int, overlap: int) -> Column:
    """``size`` characters every ``size - overlap``: what is left where no separator splits."""

    def chunks(parts: Column) -> Column:
        with_next = F.transform(
            parts, lambda p, i: F.concat(p, F.coalesce(F.substring(F.get(parts, i + 1), 1, overlap), F.lit("")))
        )
        short = (F.size(parts) > 1) & (F.length(F.element_at(parts, -1)) <= overlap)
        return F.slice(with_next, F.lit(1), F.size(parts) - short.cast("int"))

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size - overlap}}}"), 0), chunks)


def _word_windows(line: Column, size: int, overlap: int) -> Column:
    """Words packed as by ``_packed``, for a line without long words: the fold goes from chunk to
    chunk, and a chunk is the longest stretch that ends before a blank."""
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"), F.length(line).alias("end"))
    # A chunk and the word after it are longer than ``size``, so two steps go on by over half of it.
    steps = F.sequence(F.lit(0), F.floor(F.length(line) * 4 / size).cast("int") + 2)

    def after(acc: Column, ahead: Column, chunk: Column) -> Column:
        n = F.length(chunk)
        word = F.length(F.regexp_extract(F.substr(ahead, n + 1), "^ [^ ]*", 0))
        room = F.when(word > 0, F.least(F.lit(overlap), F.lit(size) - word)).otherwise(0)
        blank = _let(room, lambda r: F.struct(r.alias("room"), F.instr(F.substr(chunk, n - r + 1, r), " ").alias("i")))
        kept = _let(blank, lambda b: F.when(b["i"] > 0, b["room"] - b["i"] + 1).otherwise(0))
        out = F.concat(acc["out"], F.array(chunk)).alias("out")
        return F.struct(out, (acc["at"] + n - kept).alias("at"), acc["end"].alias("end"))

    def chunks(blocks: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            first = F.floor(acc["at"] / size).cast("int")
            near = F.array_join(F.slice(blocks, first + 1, F.lit(3)), "")
            found = _let(
                F.substr(near, acc["at"] % size + 1, F.lit(2 * size)),
                lambda w: _let(F.regexp_extract(w, f"(?s)^.{{1,{size}}}(?= |\\z)", 0), lambda c: after(acc, w, c)),
            )
            return F.when(acc["at"] < acc["end"], found).otherwise(acc)

        return F.aggregate(steps, zero, step, lambda acc: acc["out"])

    return _let(F.regexp_extract_all(line, F.lit(f"(?s).{{1,{size}}}"), 0), chunks)


def _words(line: Column, size: int, overlap: int) -> Column:
    """Chunks of a line of more than ``size`` characters."""
    pieces = _let(_pieces(line, " ", size), lambda p: _packed(p, size, overlap))
    cut = lambda c: F.when(F.length(c) <= size, F.array(c)).otherwise(_sliding(c, size, overlap))
    return F.when(line.rlike(f"[^ ]{{{max(1, size - 1)}}}"), F.flatten(F.transform(pieces, cut))).otherwise(
        _word_windows(line, size, overlap)
    )


def _native_chunks(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """Each separator splits the pieces that are still too long; a fold packs what is between them."""
    keep = [c for c in df.columns if c != text]
    paragraphs = _pieces(F.col(text), "\n\n", size)
    out = df.where(F.length(text) > 0).select(*keep, _finer(paragraphs, "\n", size).alias("pieces__c"))
    packed = _packed(F.col("pieces__c"), size, overlap)
    whole = lambda c: F.when(F.length(c) <= size, F.array(c)).otherwise(_words(c, size, overlap))
    stripped = F.transform(F.flatten(F.transform(packed, whole)), lambda c: F.btrim(c, F.lit(BLANKS)))
    return out.select(*keep, F.filter(stripped, lambda c: c != "").alias("chunks__c"))


def _arrow_chunks(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: split_recursive(t, size, overlap) if t else [])

    keep = [c for c in df.columns if c != text]
    return df.select(*keep, cut.asNondeterministic()(F.col(text)).alias("chunks__c"))


def chunk_recursive(
    df: DataFrame, text: str, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, native: bool = False
) -> DataFrame:
    """Separator-aware chunks with their position, as ``split_recursive`` gives them; no shuffle.

    On Arrow batches, or with ``native`` on built-in functions only, which gives the same rows and
    needs no Python workers, but takes two to three times as long on texts of long lines. A chunk
    repeats at most ``overlap`` characters of the one before. Null and empty texts have no chunks,
    repeated rows are chunked each.
    """
    if not 0 <= 2 * overlap <= size:
        raise ValueError("overlap must be at most half of size")
    out = (_native_chunks if native else _arrow_chunks)(df, text, size, overlap)
    # The outer form and the test of the row keep the optimizer from computing the chunks twice.
    rows = out.select(*[c for c in out.columns if c != "chunks__c"], F.posexplode_outer("chunks__c").alias("chunk_no", "chunk"))
    return rows.where(F.col("chunk").isNotNull())
