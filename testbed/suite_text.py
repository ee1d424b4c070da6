"""Documents, chunks, embeddings and batch retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from testbed.registry import query
from testbed.roles import KEYS, annual, indicators, mart, table
from testbed.sqlparts import D, M, QT, V, Y, q, sql
from tidemark import constants as C
from tidemark.operators import chunks, tfidf
from tidemark.operators.embed import embed_text
from tidemark.operators.filters import derived_k_column
from tidemark.operators.monthly import with_balance
from tidemark.operators.stats import trend
from tidemark.plans import index, reports
from tidemark.session import shared_dir, spread_scan

_ALL = [*C.INDICATORS, C.VALUE, C.BALANCE]


def _number(c: str) -> str:
    return f"'{c} était de ' || regexp_replace(printf('%.2f', {q(c)}), '0$', '')"


def _doc_sql(name: str, parts: list[str]) -> str:
    return f"concat_ws('. ', '[{name}] En ' || {Y} || ' :', {', '.join(parts)}) || '.'"


_GLOBAL_DOC = _doc_sql(
    "global",
    [
        "'series : ' || series", f"'{C.DATE} : ' || {D}", f"'{C.QUARTER} était de ' || {QT}",
        f"'{C.MONTH} : ' || {M}", *[_number(c) for c in _ALL], "'type : global'",
    ],
)


def _global_rows(spark, sf):
    return reports.filtered(mart(spark, sf)).select(
        C.SERIES, C.DATE, C.YEAR, C.QUARTER, C.MONTH, *[f"`{c}`" for c in _ALL]
    )


@query(
    "row_documents",
    sql(f"SELECT series, {D}, {Y}, 'global' AS type, {_GLOBAL_DOC} AS text FROM filt", "filt"),
)
def row_documents(spark, sf):
    return index.row_documents(_global_rows(spark, sf), C.DOC_TYPES["global"], [C.SERIES, C.DATE])


_STRIDE = C.CHUNK_SIZE - C.CHUNK_OVERLAP


@query(
    "chunk_fixed",
    f"""SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substr(text, CAST(i * {_STRIDE} + 1 AS BIGINT), {C.CHUNK_SIZE}) AS chunk
        FROM (SELECT doc_id, text, unnest(generate_series(0,
            greatest(CAST(ceil((length(text) - {C.CHUNK_OVERLAP}) / {_STRIDE}.0) AS BIGINT), 1) - 1)) AS i
            FROM documents WHERE length(text) > 0)""",
)
def chunk_fixed(spark, sf):
    return chunks.chunk_fixed(table(spark, sf, "documents").select("doc_id", "text"), "text")


def _split_sql(source: str, text: str, keys: str, sep: str, at: str, where: str) -> str:
    """Pieces of a text with their number; each after the first starts with the separator."""
    return f"""SELECT {keys}, {at}, CASE WHEN {at} > 1 THEN {sep} ELSE '' END || part AS s FROM (
        SELECT {keys}, unnest(parts) AS part, CAST(generate_subscripts(parts, 1) AS INTEGER) AS {at}
        FROM (SELECT {keys}, string_split({text}, {sep}) AS parts FROM {source} WHERE {where})) WHERE {at} > 1 OR part <> ''"""


_LONG = f"length(s) >= {C.CHUNK_SIZE}"
_SHORT = f"length(s) < {C.CHUNK_SIZE}"
# Each piece knows the end of the chunk that would start with it and, as one that comes next, how far
# back the next chunk starts; the recursion only follows from chunk to chunk.
_RECURSIVE_SQL = f"""WITH RECURSIVE
    p1 AS ({_split_sql("documents", "text", "doc_id", "chr(10) || chr(10)", "i1", "length(text) > 0")}),
    p2 AS (SELECT doc_id, i1, 0 AS i2, s FROM p1 WHERE {_SHORT} UNION ALL
           {_split_sql("p1", "s", "doc_id, i1", "chr(10)", "i2", _LONG)}),
    p3 AS (SELECT doc_id, i1, i2, 0 AS i3, s FROM p2 WHERE {_SHORT} UNION ALL
           {_split_sql("p2", "s", "doc_id, i1, i2", "' '", "i3", _LONG)}),
    placed AS (SELECT *, length(s) AS n, CASE WHEN i3 > 0 THEN i1 || '-' || i2 WHEN i2 > 0 THEN i1 || '-' ELSE '' END AS parent,
               row_number() OVER (PARTITION BY doc_id ORDER BY i1, i2, i3) AS i FROM p3),
    cut AS (SELECT *, CASE WHEN n >= {C.CHUNK_SIZE} OR lag(n) OVER d >= {C.CHUNK_SIZE} OR lag(parent) OVER d <> parent
            THEN 1 ELSE 0 END AS starts FROM placed WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    runs AS (SELECT doc_id, i, s, n, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM cut),
    pieces AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, run ORDER BY i) AS e,
               sum(n) OVER (PARTITION BY doc_id, run ORDER BY i) - n AS b FROM runs),
    reach AS (SELECT doc_id, run, n, b, max(e) OVER (PARTITION BY doc_id, run ORDER BY e
                  RANGE BETWEEN CURRENT ROW AND greatest({C.CHUNK_SIZE} - n, 0) FOLLOWING) AS e,
              min(b) OVER (PARTITION BY doc_id, run ORDER BY b
                  RANGE BETWEEN greatest(least({C.CHUNK_OVERLAP}, {C.CHUNK_SIZE} - n), 0) PRECEDING AND CURRENT ROW) AS back FROM pieces),
    jumps AS (SELECT r.doc_id, r.run, r.b, r.e, x.back AS following FROM reach r
              LEFT JOIN reach x ON x.doc_id = r.doc_id AND x.run = r.run AND x.b = r.e),
    walk AS (SELECT doc_id, run, b, e, following FROM jumps WHERE b = 0 UNION ALL
             SELECT j.doc_id, j.run, j.b, j.e, j.following FROM walk w
             JOIN jumps j ON j.doc_id = w.doc_id AND j.run = w.run AND j.b = w.following),
    whole AS (SELECT doc_id, run, string_agg(s, '' ORDER BY i) AS text FROM pieces GROUP BY 1, 2),
    chunked AS (SELECT w.doc_id, w.run, w.b, unnest(generate_series(0, greatest(CAST(ceil((w.e - w.b - {C.CHUNK_OVERLAP}) / {_STRIDE}.0)
                    AS BIGINT), 1) - 1)) AS slice, substr(t.text, CAST(w.b + 1 AS BIGINT), CAST(w.e - w.b AS BIGINT)) AS chunk
                FROM walk w JOIN whole t ON t.doc_id = w.doc_id AND t.run = w.run),
    stripped AS (SELECT doc_id, run, b, slice,
                 trim(substr(chunk, slice * {_STRIDE} + 1, {C.CHUNK_SIZE}), '{chunks.BLANKS}') AS chunk FROM chunked)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run, b, slice) - 1 AS INTEGER) AS chunk_no, chunk
    FROM stripped WHERE chunk <> ''"""


@query("chunk_recursive", _RECURSIVE_SQL)
def chunk_recursive(spark, sf):
    docs = spread_scan(table(spark, sf, "documents").select("doc_id", "text"))
    return chunks.chunk_recursive(docs, "text")


@query("chunk_recursive_native", _RECURSIVE_SQL)
def chunk_recursive_native(spark, sf):
    """The same on built-in functions only."""
    docs = spread_scan(table(spark, sf, "documents").select("doc_id", "text"))
    return chunks.chunk_recursive(docs, "text", native=True)


def _embed_sql(key: str, text: str, source: str, dim: int = 64) -> str:
    """Long form (key, slot, weight) of the hashed bag of words, unit length."""
    return f"""SELECT {key}, slot, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM (
        SELECT {key}, CAST(('0x' || substr(md5(word), 1, 8))::UBIGINT % {dim} AS INTEGER) AS slot, CAST(count(*) AS DOUBLE) AS n
        FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '\\S+')) AS word FROM {source}) GROUP BY 1, 2)"""


@query(
    "embed_text",
    f"SELECT doc_id, slot, round(w, 9) AS weight FROM ({_embed_sql('doc_id', 'text', 'documents')})",
)
def embed(spark, sf):
    """Embeddings of all documents, shown as their non-zero slots."""
    out = embed_text(spread_scan(table(spark, sf, "documents").select("doc_id", "text")), "text")
    return (
        out.select("doc_id", F.posexplode("values").alias("slot", "weight"))
        .where("weight <> 0")
        .withColumn("weight", F.round("weight", 9))
    )


_WORDS_SQL = "regexp_extract_all(lower(text), '\\S+')"


@query(
    "embed_tfidf",
    f"""WITH counts AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS n FROM (
            SELECT doc_id, unnest({_WORDS_SQL}) AS term FROM documents) GROUP BY 1, 2),
        terms AS (SELECT term, CAST(count(*) AS DOUBLE) AS n_texts FROM counts GROUP BY 1),
        ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY n_texts DESC, term) - 1 AS INTEGER) AS slot FROM terms),
        weights AS (SELECT doc_id, slot, n * (ln(((SELECT count(*) FROM documents) + 1) / (n_texts + 1)) + 1) AS w
                    FROM counts JOIN ranked USING (term) WHERE slot < {tfidf.MAX_TERMS})
        SELECT doc_id, slot, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM weights""",
)
def embed_tfidf(spark, sf):
    """Weights of all documents by a vocabulary fitted on them, shown as their entries."""
    docs = spread_scan(table(spark, sf, "documents").select("doc_id", "text"))
    out = tfidf.embed_tfidf(docs, "doc_id", "text", tfidf.fit_vocabulary(docs, "text"))
    # The plain form would add a filter on the number of entries and compute them twice for it.
    entries = out.select("doc_id", F.inline_outer("terms")).where(F.col("slot").isNotNull())
    return entries.withColumn("weight", F.round("weight", 9))


# Questions of the conversations against the documents of the mart and its trends -------


def _documents(spark, sf):
    """(id, Année, type, text): monthly rows, arrivals trend and annual balances."""
    arrivals = trend(annual(spark, sf), KEYS, [C.VALUE], 4, noise=0).withColumn(
        C.VALUE, F.round(C.VALUE, 4)
    )
    balances = with_balance(indicators(spark, sf)).select(
        F.concat(F.lit("solde-"), F.col(C.YEAR).cast("string")).alias("key"),
        C.YEAR,
        F.round(C.BALANCE, 2).alias(C.BALANCE),
    )
    keyed = lambda df, *cols: df.select(F.concat_ws("-", *cols).alias("key"), *df.columns)
    tables = {
        C.DOC_TYPES["global"]: keyed(_global_rows(spark, sf), C.SERIES, C.DATE),
        C.DOC_TYPES["arrivals"]: keyed(arrivals, C.SERIES, C.YEAR),
        C.DOC_TYPES["balance"]: balances,
    }
    return index.all_documents(tables, ["key"])


def _questions(spark, sf):
    """User turns: a third without ranges, a third with a quarter filter; the others and these have a
    range of past years of monthly rows and a later one of forecasts, from which k follows."""
    lo = (F.lit(1995) + F.col("conv_id") % 5).cast("int")
    ranges = F.array(
        F.struct(lo.alias("lo"), (lo + 1).alias("hi"), F.lit(C.DOC_TYPES["global"]).alias("type")),
        F.struct(
            F.lit(2002).alias("lo"), F.lit(2003).alias("hi"), F.lit(C.DOC_TYPES["arrivals"]).alias("type")
        ),
    )
    kind = F.col("conv_id") % 3
    return (
        table(spark, sf, "conversations")
        .where(F.col("role") == "user")
        .select(
            F.concat_ws("-", "conv_id", "turn").alias("qid"), F.col("text").alias("question"),
            F.when(kind == 0, F.slice(ranges, 1, 0)).otherwise(ranges).alias("ranges"),
            derived_k_column(F.when(kind == 0, F.slice(ranges, 1, 0)).otherwise(ranges), kind == 1).alias("k"),
        )
    )


_KEYED_DOC = _GLOBAL_DOC.replace(
    "'series : '", f"'key : ' || series || '-' || {D}, 'series : '"
)
_ARR = C.DOC_TYPES["arrivals"]
_ARR_DOC = _doc_sql(
    _ARR,
    ["'key : ' || series || '-' || " + Y, "'series : ' || series", _number(C.VALUE), f"'type : {_ARR.lower()}'"],
)


_BAL = C.DOC_TYPES["balance"]
_BAL_DOC = _doc_sql(_BAL, ["'key : solde-' || " + Y, _number(C.BALANCE), f"'type : {_BAL.lower()}'"])


@query(
    "rag_prompts",
    sql(
        f"""WITH tr AS (SELECT series, CAST(y AS INTEGER) AS {Y}, round(slope * y + intercept, 4) AS {V} FROM (
            SELECT series, regr_slope({V}, {Y}) AS slope, regr_intercept({V}, {Y}) AS intercept,
                unnest(generate_series(max({Y}) + 1, max({Y}) + 4)) AS y FROM annual GROUP BY 1)),
        docs AS (SELECT 'wbdata-' || series || '-' || {D} AS id, {Y} AS y, 'global' AS type, {_KEYED_DOC} AS text FROM filt
            UNION ALL SELECT 'wbdata-' || series || '-' || {Y}, {Y}, '{_ARR.lower()}', {_ARR_DOC} FROM tr
            UNION ALL SELECT 'wbdata-solde-' || {Y}, {Y}, '{_BAL.lower()}', {_BAL_DOC}
                FROM (SELECT {Y}, round({q(C.RECEIPTS)} - {q(C.EXPENSES)}, 2) AS {q(C.BALANCE)} FROM indic)),
        asked AS (SELECT conv_id || '-' || turn AS qid, text AS question, 1995 + conv_id % 5 AS lo, conv_id % 3 AS kind,
            CASE conv_id % 3 WHEN 0 THEN 20 WHEN 1 THEN 5 ELSE 4 END AS k FROM conversations WHERE role = 'user'),
        dv AS (SELECT id, slot, w::FLOAT::DOUBLE AS w FROM ({_embed_sql('id', 'text', 'docs')})),
        qv AS ({_embed_sql('qid', 'question', 'asked')}),
        dn AS (SELECT id, sqrt(sum(w * w)) AS n FROM dv GROUP BY 1),
        dots AS (SELECT qid, id, sum(qv.w * dv.w) AS s FROM qv JOIN dv ON qv.slot = dv.slot GROUP BY 1, 2),
        pairs AS (SELECT qid, k, d.id, d.text FROM asked JOIN docs d ON kind = 0 OR (d.type = 'global' AND d.y BETWEEN lo AND lo + 1)
            OR (d.type = '{_ARR.lower()}' AND d.y BETWEEN 2002 AND 2003)),
        ranked AS (SELECT p.qid, k, text, row_number() OVER (PARTITION BY p.qid
                ORDER BY round(coalesce(s, 0) / n, 9) DESC, p.id) AS rank
            FROM pairs p JOIN dn ON dn.id = p.id LEFT JOIN dots ON dots.qid = p.qid AND dots.id = p.id),
        ctx AS (SELECT qid, string_agg('WBData : ' || text, E'\\n' ORDER BY rank) AS context FROM ranked WHERE rank <= k GROUP BY 1)
        SELECT asked.qid, question, CASE WHEN context IS NULL
            THEN E'Tu es un assistant économique et touristique.\\nQuestion : ' || question || E'\\nJe ne dispose pas de cette information.'
            ELSE E'\\nTu es un assistant économique et touristique intelligent.\\nQuestion : ' || question || E'\\n' || context
                || E'\\nRéponds uniquement sur les données disponibles.\\n' END AS prompt
        FROM asked LEFT JOIN ctx ON asked.qid = ctx.qid""",
        "filt", "annual", "indic",
    ),
)
def rag_prompts(spark, sf):
    """Build the collection in one bulk write, then answer all questions from its scan."""
    id_ = F.concat_ws("-", C.SOURCE, "key")
    sources = F.explode(F.array(F.lit(C.VECTOR_SOURCE), F.lit("other")))
    docs = _documents(spark, sf).withColumn(C.SOURCE, sources)
    records = index.build_index(spark, docs, id_, shared_dir(spark, "index"))
    return index.answer_prompts(_questions(spark, sf), records).select("qid", "question", "prompt")
