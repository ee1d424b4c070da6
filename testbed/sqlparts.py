"""Oracle SQL building blocks: named CTEs put together with what they depend on."""

from __future__ import annotations

from tidemark import constants as C


def q(name: str) -> str:
    return f'"{name}"'


Y, QT, M, D, V, TOT, P = (q(c) for c in (C.YEAR, C.QUARTER, C.MONTH, C.DATE, C.VALUE, C.TOTAL, C.SHARE))
IND = [q(c) for c in C.INDICATORS]

_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
_EXP = f"{_PRICE} * (1 - CAST(l_discount AS DECIMAL(4,2)))"


def _total(x: str, flag: str | None = None) -> str:
    cond = f" FILTER (WHERE l_returnflag = '{flag}')" if flag else ""
    return f"CAST(sum({x}){cond} AS DOUBLE)"


def indicator_exprs() -> str:
    exprs = {
        C.RECEIPTS: _total(_PRICE),
        C.RECEIPTS_PCT: f"{_total(f'{_PRICE} * CAST(l_discount AS DECIMAL(4,2))')} / {_total(_PRICE)} * 100",
        C.RECEIPTS_TRANSPORT: _total(_PRICE, "A"),
        C.RECEIPTS_TRAVEL: _total(_PRICE, "N"),
        C.EXPENSES_TRANSPORT: _total(_EXP, "A"),
        C.EXPENSES_TRAVEL: _total(_EXP, "N"),
        C.EXPENSES: _total(_EXP),
        C.EXPENSES_PCT: f"{_total(f'{_PRICE} * CAST(l_tax AS DECIMAL(4,2))')} / {_total(_PRICE)} * 100",
    }
    return ", ".join(f"{e} AS {q(c)}" for c, e in exprs.items())


def calendar(d: str) -> str:
    return (
        f"CAST(year({d}) AS INTEGER) AS {Y}, CAST(quarter({d}) AS INTEGER) AS {QT}, "
        f"strftime({d}, '%b') AS {M}"
    )


# name -> (dependencies, body)
PARTS: dict[str, tuple[list[str], str]] = {
    "monthly": (
        [],
        f"""SELECT series, {D}, {V}, {calendar(D)} FROM (
            SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS {D},
                   CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS {V}
            FROM orders GROUP BY 1, 2)""",
    ),
    "shared": (
        ["monthly"],
        f"""SELECT *, {V} / nullif({TOT}, 0) AS {P} FROM (
            SELECT *, CAST(sum(CAST({V} AS DECIMAL(18,2))) OVER (PARTITION BY series, {Y}) AS DOUBLE) AS {TOT} FROM monthly)""",
    ),
    "segments": (
        [],
        f"""SELECT series, segment, {D}, {V}, {calendar(D)} FROM (
            SELECT o_orderpriority AS series, c_mktsegment AS segment,
                   CAST(date_trunc('month', o_orderdate) AS DATE) AS {D},
                   CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS {V}
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)""",
    ),
    "indic": (
        [],
        f"SELECT CAST(year(l_shipdate) AS INTEGER) AS {Y}, {indicator_exprs()} FROM lineitem GROUP BY 1",
    ),
    "mart": (
        ["shared", "indic"],
        f"SELECT series, {D}, s.{Y}, {QT}, {M}, {V}, "
        + ", ".join(f"i.{c} * {P} AS {c}" for c in IND)
        + f" FROM shared s LEFT JOIN indic i ON s.{Y} = i.{Y}",
    ),
    "filt": (
        ["mart"],
        f'SELECT *, {q(C.RECEIPTS)} - {q(C.EXPENSES)} AS "Solde" FROM mart WHERE '
        + " AND ".join(f"{c} IS NOT NULL" for c in [*IND, V]),
    ),
    "annual": (
        ["monthly"],
        f"SELECT series, {Y}, CAST(sum(CAST({V} AS DECIMAL(18,2))) AS DOUBLE) AS {V} FROM monthly GROUP BY 1, 2",
    ),
    "points": (
        ["annual", "filt"],
        f"""SELECT a.series, a.{Y}, a.{V}, r."Recettes" FROM annual a JOIN (
            SELECT series, {Y}, sum({q(C.RECEIPTS)}) AS "Recettes" FROM filt GROUP BY 1, 2) r
            ON a.series = r.series AND a.{Y} = r.{Y}""",
    ),
    "fits": (
        ["points"],
        f"""SELECT series, regr_slope("Recettes", {V}) AS slope,
            regr_intercept("Recettes", {V}) AS intercept FROM points GROUP BY 1""",
    ),
    "gaps": (
        ["points", "fits"],
        f"""SELECT p.*, slope * {V} + intercept AS fitted, "Recettes" - (slope * {V} + intercept) AS gap
            FROM points p JOIN fits f ON p.series = f.series""",
    ),
    "flagged": (
        ["gaps"],
        f"""SELECT series, {Y}, {V}, "Recettes", fitted, gap, CASE WHEN gap < -s THEN '{C.ANOMALY_LOW.replace("'", "''")}'
            WHEN gap > s THEN '{C.ANOMALY_HIGH.replace("'", "''")}' ELSE 'Normal' END AS kind
            FROM (SELECT *, stddev_samp(gap) OVER (PARTITION BY series) AS s FROM gaps)""",
    ),
    "vectors": (
        [],
        f"""SELECT 'wbdata-' || vec_id AS id, 1995 + vec_id % 7 AS {Y}, 't' || label AS type,
            'doc ' || vec_id AS text, embedding FROM embeddings""",
    ),
    "centroids": (
        [],
        """SELECT label, list(m ORDER BY pos) AS vector FROM (
            SELECT label, pos, avg(x) AS m FROM (
                SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
                FROM embeddings) GROUP BY 1, 2) GROUP BY 1""",
    ),
    "knn": (
        ["centroids"],
        """SELECT label AS qid, rank, id, score FROM (
            SELECT label, id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rank
            FROM (SELECT c.label, e.vec_id AS id, round(list_dot_product(c.vector, e.embedding::DOUBLE[])
                    / sqrt(list_dot_product(c.vector, c.vector))
                    / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 9) AS score
                  FROM centroids c, embeddings e)) WHERE rank <= 20""",
    ),
}


def sql(body: str, *parts: str) -> str:
    """``body`` preceded by the named CTEs and all they depend on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in PARTS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for p in parts:
        visit(p)
    if not order:
        return body
    ctes = ", ".join(f"{n} AS ({PARTS[n][1]})" for n in order)
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes}, {body.lstrip()[5:]}"
    return f"WITH {ctes} {body}"


def rnd(column: str, digits: int, name: str | None = None) -> str:
    return f"round({column}, {digits}) AS {name or column}"
