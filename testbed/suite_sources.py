"""Sources, sinks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from testbed.registry import query
from testbed.roles import (
    FRENCH,
    STEMS,
    french_month,
    indicator_columns,
    indicator_units,
    locale_text,
    money,
    monthly,
    orders,
    table,
    vector_records,
    date_bounds,
    year_bounds,
)
from testbed.sqlparts import D, M, V, Y, calendar, indicator_exprs, sql
from tidemark import constants as C
from tidemark.functions import calendar as cal
from tidemark.functions import numbers as num
from tidemark.functions import text as txt
from tidemark.operators.filters import metadata_predicate
from tidemark.operators.monthly import exact_sums
from tidemark.operators.reshape import calendar_spine, melt, month_headers, unpivot_months
from tidemark.session import shared_dir
from tidemark.sources import charts, log, tables, vectors
from tidemark.streaming.log_stream import stream_log

_FR_LIST = "[" + ", ".join(f"'{m}'" for m in FRENCH) + "]"
_STEM_LIST = "[" + ", ".join(f"'{m}'" for m in STEMS) + "]"


@query(
    "scan_csv_long",
    sql(
        f"""SELECT {Y}, {_FR_LIST}[month({D})] AS {M}, CAST(sum(CAST({V} AS DECIMAL(18,2))) AS DOUBLE) AS "Valeur"
        FROM monthly GROUP BY {Y}, month({D})""",
        "monthly",
    ),
)
def scan_csv_long(spark, sf):
    path = shared_dir(spark, "long")
    rows = monthly(spark, sf).groupBy(C.YEAR, french_month(F.col(C.DATE), FRENCH).alias(C.MONTH)).agg(
        F.sum(money(C.VALUE)).cast("double").alias(C.RAW_VALUE)
    )
    tables.write_long_csv(rows, path)
    return tables.read_long_csv(spark, path)


@query(
    "sink_csv",
    f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS {Y}, {_FR_LIST}[month(o_orderdate)] AS {M},
        CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS "Valeur" FROM orders""",
)
def sink_csv(spark, sf):
    path = shared_dir(spark, "sink")
    rows = orders(spark, sf).select(
        F.year("o_orderdate").alias(C.YEAR),
        french_month(F.col("o_orderdate"), FRENCH).alias(C.MONTH),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias(C.RAW_VALUE),
    )
    tables.write_long_csv(rows, path)
    return tables.read_long_csv(spark, path)


def _wide_sheet(spark, sf):
    """Monthly values as an exported sheet: one row per series, headers like ``janv. 1995``."""
    path = shared_dir(spark, "wide")
    m = monthly(spark, sf)
    lo, hi = date_bounds(orders(spark, sf), "o_orderdate")
    headers = [f"{stem}. {y}" for y in range(lo, hi + 1) for stem in STEMS]
    cells = m.select(
        C.SERIES,
        F.concat(
            french_month(F.col(C.DATE), STEMS), F.lit(". "), F.col(C.YEAR).cast("string")
        ).alias("header"),
        locale_text(F.col(C.VALUE)).alias("cell"),
    )
    wide = cells.groupBy(C.SERIES).agg(
        *[F.max(F.when(F.col("header") == h, F.col("cell"))).alias(h) for h in headers]
    )
    wide.write.option("header", True).csv(path)
    return tables.read_wide(spark, path)


@query(
    "scan_wide",
    sql(
        f"""SELECT s.series, {_STEM_LIST}[m] || '. ' || y AS {M},
            replace(replace(format('{{:,.2f}}', {V}), ',', ' '), '.', ',') AS {V}
            FROM (SELECT DISTINCT series FROM monthly) s
            CROSS JOIN (SELECT unnest(generate_series((SELECT min({Y}) FROM monthly), (SELECT max({Y}) FROM monthly))) AS y)
            CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS m)
            LEFT JOIN monthly v ON v.series = s.series AND v.{Y} = y AND month(v.{D}) = m""",
        "monthly",
    ),
)
def scan_wide(spark, sf):
    wide = _wide_sheet(spark, sf)
    return melt(wide, [C.SERIES], list(month_headers(wide)), C.MONTH, C.VALUE)


@query(
    "unpivot_wide",
    sql(
        f"""SELECT s.series, d AS {D}, {V}, {calendar('d')}
            FROM (SELECT DISTINCT series FROM monthly) s
            CROSS JOIN (SELECT CAST(unnest(generate_series(make_date((SELECT min({Y}) FROM monthly), 1, 1),
                make_date((SELECT max({Y}) FROM monthly), 12, 1), INTERVAL 1 MONTH)) AS DATE) AS d)
            LEFT JOIN (SELECT series AS ser, {D} AS dd, {V} FROM monthly) v ON ser = s.series AND dd = d""",
        "monthly",
    ),
)
def unpivot_wide(spark, sf):
    return unpivot_months(_wide_sheet(spark, sf))


@query(
    "indicator_pivot",
    f"""SELECT n_name AS country, CAST(year(l_shipdate) AS INTEGER) AS {Y}, {indicator_exprs()}
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY 1, 2""",
)
def indicator_pivot(spark, sf):
    """The long feed of all countries, back to one column per indicator."""
    nations = (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("country"))
    )
    # Summed per supplier before the join: one row per supplier and year is shuffled.
    year = F.year("l_shipdate").alias("y")
    per_supplier = exact_sums(table(spark, sf, "lineitem"), ["l_suppkey", year], indicator_units(), few_keys=False)
    per_country = exact_sums(
        per_supplier.join(nations, "l_suppkey"),
        ["country", "y"],
        {n: (F.col(n), d) for n, (_, d) in indicator_units().items()},
    )
    values = indicator_columns()
    feed = per_country.select(
        "country",
        F.concat(F.lit("YR"), F.col("y").cast("string")).alias("date"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(code).alias("indicator"), values[name].alias("value"))
                    for code, name in C.INDICATOR_CODES.items()
                ]
            )
        ),
    )
    return tables.load_indicators(feed, country=None)


def _chart_pages(spark, sf, dataset=None):
    """One page per series whose script holds its monthly sums as chart literals."""
    year_cells = (
        monthly(spark, sf)
        .groupBy(C.SERIES, C.YEAR)
        .agg(
            *[
                F.coalesce(
                    F.max(F.when(F.col(C.MONTH) == m, money(C.VALUE).cast("string"))), F.lit("null")
                ).alias(m)
                for m in C.MONTHS
            ]
        )
    )
    if dataset is None:
        dataset = F.concat(
            F.lit("{label: '"), F.col(C.YEAR).cast("string"), F.lit("', data: ["),
            F.concat_ws(", ", *C.MONTHS), F.lit("]}"),
        )
    labels = ", ".join(f'"{m}"' for m in C.MONTHS)
    return year_cells.groupBy(C.SERIES).agg(
        F.concat(
            F.lit("<html><script>track(1);</script><p>x</p><script>var myChart = new Chart(c, {labels: ["),
            F.lit(labels),
            F.lit("], datasets: ["),
            F.array_join(F.array_sort(F.collect_list(dataset)), ", "),
            F.lit("]});</script></html>"),
        ).alias("html")
    )


@query(
    "chart_extract",
    sql(
        f"""SELECT s.series, CAST(s.{Y} AS VARCHAR) AS {Y}, strftime(make_date(2000, m, 1), '%b') AS {M}, {V} AS "Valeur"
            FROM (SELECT DISTINCT series, {Y} FROM monthly) s
            CROSS JOIN (SELECT CAST(unnest(generate_series(1, 12)) AS INTEGER) AS m)
            LEFT JOIN monthly v ON v.series = s.series AND v.{Y} = s.{Y} AND month(v.{D}) = m""",
        "monthly",
    ),
)
def chart_extract(spark, sf):
    return charts.extract_series(_chart_pages(spark, sf), [C.SERIES])


_NESTED_NAME = f"""CASE CAST(s.{Y} AS INTEGER) % 4 WHEN 0 THEN s.{Y} || '}} ]' WHEN 1 THEN s.{Y} || ' l''an' WHEN 2 THEN '{{' || s.{Y} ELSE CAST(s.{Y} AS VARCHAR) END"""


@query(
    "chart_nested",
    sql(
        f"""SELECT s.series, {_NESTED_NAME} AS {Y}, strftime(make_date(2000, m, 1), '%b') AS {M}, {V} AS "Valeur"
            FROM (SELECT DISTINCT series, CAST({Y} AS VARCHAR) AS {Y} FROM monthly) s
            CROSS JOIN (SELECT CAST(unnest(generate_series(1, 12)) AS INTEGER) AS m)
            LEFT JOIN monthly v ON v.series = s.series AND CAST(v.{Y} AS VARCHAR) = s.{Y} AND month(v.{D}) = m""",
        "monthly",
    ),
)
def chart_nested(spark, sf):
    """Names with brackets and escaped quotes, nested objects, keys in both orders, comments."""
    y, data = F.col(C.YEAR).cast("string"), F.concat(F.lit("data: ["), F.concat_ws(", ", *C.MONTHS), F.lit("]"))
    style = "options: {pad: [1, 2], font: {label: 'none', data: 3}}, /* label: 'x' */ "
    dataset = F.when(F.col(C.YEAR) % 4 == 0, F.concat(F.lit("{label: '"), y, F.lit("} ]', "), data, F.lit("}")))
    dataset = dataset.when(F.col(C.YEAR) % 4 == 1, F.concat(F.lit("{" + style + "label: '"), y, F.lit(" l\\'an', "), data, F.lit("}")))
    dataset = dataset.when(F.col(C.YEAR) % 4 == 2, F.concat(F.lit("{"), data, F.lit(", " + style + 'label: "{'), y, F.lit('"}')))
    dataset = dataset.otherwise(F.concat(F.lit("{'label': \""), y, F.lit("\", " + style + '"data": ['), F.concat_ws(" , ", *C.MONTHS), F.lit("]}")))
    return charts.extract_series(_chart_pages(spark, sf, dataset), [C.SERIES])


@query(
    "script_filter",
    r"""SELECT page_id, array_to_string(list_filter(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1),
        lambda x: contains(x, 'Chart') OR contains(x, 'track')), '') AS js FROM pages""",
)
def script_filter(spark, sf):
    js = charts.script_text(F.col("html"), ("Chart", "track"))
    return table(spark, sf, "pages").select("page_id", js.alias("js"))


@query(
    "marker_count",
    """SELECT page_id, CAST((length(html) - length(replace(html, '<p>', ''))) / 3 AS INTEGER) AS n FROM pages""",
)
def marker_count(spark, sf):
    return table(spark, sf, "pages").select("page_id", txt.count_of(F.col("html"), "<p>").alias("n"))


_UPSERTED = f"""SELECT id, CAST({Y} AS DOUBLE) AS year,
    CASE WHEN embedding[2] > 0 THEN 'late' WHEN embedding[1] > 0 THEN 'moved' ELSE type END AS type,
    CASE WHEN embedding[2] > 0 THEN 'third ' || id WHEN embedding[1] > 0 THEN 'second ' || id ELSE text END AS text,
    CAST(len(embedding) AS INTEGER) AS dims FROM vectors"""


@query("vector_upsert", sql(_UPSERTED, "vectors"))
def vector_upsert(spark, sf):
    """First load, then a batch that changes some ids twice, then one more: the last version wins."""
    base = vector_records(spark, sf)
    path = shared_dir(spark, "vectors")
    vectors.upsert_vectors(spark, base, path)

    def changed(slot, word, type_, n):
        text = F.concat(F.lit(f"{word} "), F.col("id"))
        meta = F.col("metadata").withField("text", text).withField("type", F.lit(type_))
        return base.where(F.get("values", F.lit(slot)) > 0).withColumns({"metadata": meta, "type": F.lit(type_), "v": F.lit(n)})

    twice = changed(0, "first", "moved", 1).unionByName(changed(0, "second", "moved", 2))
    vectors.upsert_vectors(spark, twice, path, version=[F.col("v")])
    out = vectors.upsert_vectors(spark, changed(1, "third", "late", 3), path)
    return out.select(
        "id", F.col(f"metadata.{C.YEAR}").alias("year"), F.col("metadata.type").alias("type"),
        F.col("metadata.text").alias("text"), F.size("values").alias("dims"),
    )


_RANGES = [(1996, 1998, "t1"), (2000, 2001, "T2")]
_META_SQL = f"""SELECT id, CAST({Y} AS DOUBLE) AS year, type, text FROM vectors
    WHERE ({Y} BETWEEN 1996 AND 1998 AND type = 't1') OR ({Y} BETWEEN 2000 AND 2001 AND type = 't2')"""


def _meta(df):
    return df.select(
        "id", F.col(f"metadata.{C.YEAR}").alias("year"), F.col("metadata.type").alias("type"),
        F.col("metadata.text").alias("text"),
    )


@query("vector_scan", sql(_META_SQL, "vectors"))
def vector_scan(spark, sf):
    path = shared_dir(spark, "vectors")
    vectors.upsert_vectors(spark, vector_records(spark, sf), path)
    pred = metadata_predicate(_RANGES, type_=F.col("type"))
    return _meta(vectors.scan_vectors(spark, path, pred, with_values=False))


@query("metadata_filter", sql(_META_SQL, "vectors"))
def metadata_filter(spark, sf):
    return _meta(vector_records(spark, sf).where(metadata_predicate(_RANGES)))


_PAIRS = """SELECT a.text AS question, coalesce(b.text, 'None') AS response,
    '2026-01-01T00:00:00' AS timestamp FROM conversations a
    LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant'
    WHERE a.role = 'user'"""


def _records(spark, sf):
    return log.log_records(
        log.pair_turns(table(spark, sf, "conversations")), "question", "response",
        F.lit("2026-01-01T00:00:00"),
    )


@query("log_read", _PAIRS)
def log_read(spark, sf):
    """Records written as pretty-printed JSON arrays, files dealt by the key of the question's turn."""
    path = shared_dir(spark, "log")
    pairs = log.pair_turns(table(spark, sf, "conversations"))
    stamp = F.lit("2026-01-01T00:00:00")
    records = log.log_records(pairs, "question", "response", stamp, keep=("conv_id", "turn"))
    files = records.count() // 500 + 1
    row = F.struct("timestamp", "question", "response")
    (
        records.groupBy(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(files)).alias("file"))
        .agg(F.to_json(F.collect_list(row), {"pretty": "true"}).alias("value"))
        .select("value")
        .write.option("maxRecordsPerFile", 1)
        .text(path)
    )
    return log.read_log_array(spark, path)


@query("log_append", _PAIRS)
def log_append(spark, sf):
    path = shared_dir(spark, "log")
    records = _records(spark, sf)
    answered = F.col("response") != C.EMPTY_RESPONSE
    log.append_log(records.where(answered), path)
    log.append_log(records.where(~answered), path)
    return log.read_log(spark, path)


@query("log_stream", _PAIRS)
def log_stream(spark, sf):
    """Two triggers with a restart between them; the second meets the files of the first again, and
    copies of their records under other names."""
    root = shared_dir(spark, "stream")
    pairs = log.pair_turns(table(spark, sf, "conversations"))
    records = log.log_records(pairs, "question", "response", F.lit("2026-01-01T00:00:00"), keep=("conv_id", "turn"))
    first = F.col("conv_id") % 2 == 0
    for delivered in (records.where(first), records):
        delivered.write.mode("append").json(f"{root}/in")
        stream = spark.readStream.schema(records.schema).json(f"{root}/in")
        running = stream_log(stream, f"{root}/out", f"{root}/checkpoint", once=["conv_id", "turn"])
        running.awaitTermination()
    return log.read_log(spark, f"{root}/out")


@query(
    "calendar_spine",
    sql(
        f"""SELECT series, d AS {D}, {calendar('d')} FROM (SELECT DISTINCT series FROM monthly)
            CROSS JOIN (SELECT CAST(unnest(generate_series(make_date((SELECT min({Y}) FROM monthly), 1, 1),
                make_date((SELECT max({Y}) FROM monthly), 12, 1), INTERVAL 1 MONTH)) AS DATE) AS d)""",
        "monthly",
    ),
)
def spine(spark, sf):
    m = monthly(spark, sf)
    return calendar_spine(m.select(C.SERIES).distinct(), *year_bounds(m))


# Scalar functions over whole tables --------------------------------------------

_MAP_SQL = "map([" + ", ".join(f"'{k}'" for k in C.FULL_MONTHS_FR) + "], [" + ", ".join(
    f"'{v}'" for v in C.FULL_MONTHS_FR.values()
) + "])"


@query(
    "month_map",
    f"""WITH t AS (SELECT o_orderkey, replace({_FR_LIST}[month(o_orderdate)], 'é', CASE WHEN o_orderstatus = 'F' THEN 'e' ELSE 'é' END) AS name,
            strftime(o_orderdate, '%b') AS folded FROM orders)
        SELECT o_orderkey, name, {_MAP_SQL}[name] AS exact, folded FROM t""",
)
def month_map(spark, sf):
    name = french_month(F.col("o_orderdate"), FRENCH)
    plain = F.when(F.col("o_orderstatus") == "F", F.translate(name, "é", "e")).otherwise(name)
    return (
        orders(spark, sf)
        .select("o_orderkey", plain.alias("name"))
        .withColumn("exact", cal.month_from_french(F.col("name")))
        .withColumn("folded", cal.month_from_french(F.col("name"), fold_accents=True))
    )


@query(
    "drop_null_date",
    f"""SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS {D} FROM orders
        WHERE NOT (o_orderstatus = 'F' AND month(o_orderdate) IN (2, 12))""",
)
def drop_null_date(spark, sf):
    """Unaccented month names do not map, so those rows have no date and are dropped."""
    name = french_month(F.col("o_orderdate"), FRENCH)
    long = orders(spark, sf).select(
        "o_orderkey",
        F.year("o_orderdate").alias(C.YEAR),
        F.when(F.col("o_orderstatus") == "F", F.translate(name, "é", "e")).otherwise(name).alias(C.MONTH),
        F.col("o_totalprice").alias(C.RAW_VALUE),
    )
    return tables.clean_long(long).select("o_orderkey", C.DATE)


@query(
    "clean_header",
    """SELECT o_orderkey, strftime(o_orderdate, '%b %Y') AS header FROM orders""",
)
def clean_header(spark, sf):
    stem = french_month(F.col("o_orderdate"), STEMS)
    text = F.concat(
        F.lit(" "),
        F.when(F.col("o_orderstatus") == "F", F.upper(stem)).otherwise(stem),
        F.lit(". "),
        F.year("o_orderdate").cast("string"),
    )
    return orders(spark, sf).select("o_orderkey", cal.clean_header(text).alias("header"))


@query(
    "parse_number",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS value FROM lineitem""",
)
def parse_number(spark, sf):
    text = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("n/a "), F.col("l_linenumber"))).otherwise(
        locale_text(F.col("l_extendedprice"))
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", num.parse_number(text).alias("value")
    )


@query(
    "parse_month",
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS {D}
        FROM orders""",
)
def parse_month(spark, sf):
    text = F.concat(
        F.when(F.col("o_orderstatus") == "P", F.lit("Janier")).otherwise(F.date_format("o_orderdate", "MMM")),
        F.lit(" "),
        F.year("o_orderdate").cast("string"),
    )
    return orders(spark, sf).select("o_orderkey", cal.parse_month(text).alias(C.DATE))


@query("calendar_parts", f"SELECT o_orderkey, {calendar('o_orderdate')} FROM orders")
def calendar_parts(spark, sf):
    return cal.with_calendar(orders(spark, sf), "o_orderdate").select(
        "o_orderkey", C.YEAR, C.QUARTER, C.MONTH
    )


@query("parse_year", f"SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS INTEGER) AS {Y} FROM lineitem")
def parse_year(spark, sf):
    y = F.year("l_shipdate").cast("string")
    text = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("YR"), y)).otherwise(y)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", cal.parse_year(text).alias(C.YEAR)
    )


@query(
    "parse_int_list",
    """SELECT o_orderkey, year(o_orderdate) || '|' || o_custkey || CASE WHEN o_orderstatus = 'P' THEN '|?' ELSE '' END AS parsed,
        o_orderstatus <> 'P' AS ok FROM orders""",
)
def parse_int_list(spark, sf):
    text = F.concat(
        F.year("o_orderdate").cast("string"), F.lit(", "), F.col("o_custkey").cast("string"),
        F.when(F.col("o_orderstatus") == "P", F.lit(" x")).otherwise(F.lit(" ")),
    )
    got = txt.parse_int_list(text)
    shown = F.array_join(F.transform(F.col("p.values"), lambda x: x.cast("string")), "|", "?")
    return (
        orders(spark, sf)
        .select("o_orderkey", got.alias("p"))
        .select("o_orderkey", shown.alias("parsed"), F.col("p.ok").alias("ok"))
    )


@query(
    "kpi_format",
    """SELECT c_custkey, format('{:,.0f}', c_acctbal) AS comma, replace(format('{:,.0f}', c_acctbal), ',', ' ') AS blank
       FROM customer""",
)
def kpi_format(spark, sf):
    x = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        "c_custkey", num.thousands(x).alias("comma"), num.thousands(x, " ").alias("blank")
    )


@query("pct_label", "SELECT event_id, printf('%.1f%%', value / 8 * 5) AS label FROM events")
def pct_label(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.col("value") / 8 * 5).alias("x"))
    return rows.select("event_id", num.pct_label("x").alias("label"))


@query(
    "array_align",
    """SELECT o_orderkey, array_to_string(list_transform(
            list_resize([o_custkey, o_orderkey, NULL, 4], CAST(month(o_orderdate) AS BIGINT)),
            lambda x: coalesce(CAST(x AS VARCHAR), '?')), '|') AS aligned,
        CAST(month(o_orderdate) AS INTEGER) AS n FROM orders""",
)
def array_align(spark, sf):
    values = F.array("o_custkey", "o_orderkey", F.lit(None).cast("bigint"), F.lit(4).cast("bigint"))
    n = F.month("o_orderdate")
    shown = F.array_join(F.transform(txt.align(values, n), lambda x: x.cast("string")), "|", "?")
    return orders(spark, sf).select("o_orderkey", shown.alias("aligned"), n.alias("n"))


@query(
    "array_zip",
    sql(f"SELECT series, {Y}, {M}, {V} FROM monthly", "monthly"),
)
def array_zip(spark, sf):
    """Two parallel arrays per (series, year), at most twelve long, back to rows."""
    cells = F.sort_array(F.collect_list(F.struct(C.DATE, C.MONTH, C.VALUE)))
    packed = monthly(spark, sf).groupBy(C.SERIES, C.YEAR).agg(cells.alias("c"))
    zipped = F.arrays_zip(F.col(f"c.{C.MONTH}").alias(C.MONTH), F.col(f"c.{C.VALUE}").alias(C.VALUE))
    return packed.select(C.SERIES, C.YEAR, F.inline(zipped))


@query(
    "prompt_build",
    r"""WITH t AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS ctx FROM conversations a
        LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant'
        WHERE a.role = 'user')
    SELECT conv_id, turn, CASE WHEN trim(coalesce(ctx, ''), E' \t\n\r') = ''
        THEN E'Tu es un assistant économique et touristique.\nQuestion : ' || question || E'\nJe ne dispose pas de cette information.'
        ELSE E'\nTu es un assistant économique et touristique intelligent.\nQuestion : ' || question || E'\n'
            || trim(ctx, E' \t\n\r') || E'\nRéponds uniquement sur les données disponibles.\n' END AS prompt,
        E'\nTu es un assistant spécialisé dans l''analyse des ventes.\nRéponds de manière claire et précise.\n\nQUESTION :\n'
            || question || E'\n\nRÉPONSE :\n' AS sales_prompt FROM t""",
)
def prompt_build(spark, sf):
    pairs = log.pair_turns(table(spark, sf, "conversations"))
    return pairs.select(
        "conv_id", "turn",
        txt.prompt(F.col("question"), F.col("response")).alias("prompt"),
        txt.sales_prompt(F.col("question")).alias("sales_prompt"),
    )


@query("nonempty_text", r"""SELECT doc_id, length(trim(text, E' \t\n\r')) AS n FROM documents WHERE trim(text, E' \t\n\r') <> ''""")
def nonempty_text(spark, sf):
    body = txt.strip(F.col("text"))
    return (
        table(spark, sf, "documents")
        .where(F.length(body) > 0)
        .select("doc_id", F.length(body).cast("bigint").alias("n"))
    )
