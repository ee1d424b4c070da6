"""Sources, sinks, documents, chunks, embeddings and retrieval."""

import datetime as dt
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark import schemas
from tidemark.operators import chunks, embed, retrieve, tfidf
from tidemark.plans import index
from tidemark.session import materialise, shared_dir
from tidemark.sources import charts, log, tables, vectors
from tidemark.streaming.log_stream import stream_log


def test_long_csv_and_cleaning(spark, tmp_path):
    df = spark.createDataFrame(
        [(2019, "Janvier", 1.0), (2019, "Fevrier", 2.0), (2019, "Décembre", None)], schemas.LONG_CSV
    )
    path = str(tmp_path / "csv")
    tables.write_long_csv(df, path)
    back = tables.read_long_csv(spark, path)
    assert back.schema == schemas.LONG_CSV
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    kept = {r[C.MONTH]: r[C.VALUE] for r in tables.clean_long(back).collect()}
    assert kept == {"Jan": 1.0, "Dec": None}
    folded = {r[C.MONTH]: r[C.VALUE] for r in tables.clean_long(back, fold_accents=True).collect()}
    assert folded == {"Jan": 1.0, "Feb": 2.0, "Dec": None}


def test_wide_scan_reads_text(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.createDataFrame([("a", 5)], "id string, `janv. 2015` int").write.parquet(path)
    assert [t for _, t in tables.read_wide(spark, path, "parquet").dtypes] == ["string", "string"]


def test_indicator_feed(spark):
    codes = list(C.INDICATOR_CODES)
    feed = spark.createDataFrame(
        [("MDG", codes[0], "YR2019", 1.0), ("MDG", codes[1], "2019", float("nan")), ("FRA", codes[0], "2019", 9.0),
         ("MDG", codes[2], "2020", None), ("MDG", "OTHER", "2021", 3.0)],
        schemas.INDICATOR_FEED,
    )
    out = tables.load_indicators(feed, "MDG").collect()
    assert [(r[C.YEAR], r[C.RECEIPTS], r[C.RECEIPTS_PCT]) for r in out] == [(2019, 1.0, None)]
    assert {r["country"] for r in tables.load_indicators(feed, None).collect()} == {"MDG", "FRA"}


def test_chart_label_after_data(spark):
    page = """<script>new Chart(c, {labels: [a, b], datasets: [{data: [1, 2], label: '2020'}, {"data": [3], "label": "x, y"}]})</script>"""
    pages = spark.createDataFrame([(1, page)], "id int, html string")
    assert [tuple(r)[1:] for r in charts.extract_series(pages, ["id"]).collect()] == [
        ("2020", "a", 1.0), ("2020", "b", 2.0), ("x, y", "a", 3.0), ("x, y", "b", None),
    ]


def test_chart_literals_by_hand():
    read = charts.chart_literals
    assert read("{label:'20}21',data:[5,6]}") == ([], [("20}21", ["5", "6"])])
    assert read("labels: ['a', \"b, c\", d]") == (["a", "b, c", "d"], [])
    js = """var u = 'http://x/[{'; // labels: [no]
    cfg = {labels: ["J'an", 'F\\'ev', `M]`], datasets: [
      {label: "x", style: {label: 'inner', data: [9, 9], f: function(a) { return a[0]; }}, data: [1, -2.5e3, null, , 4,],},
      {"data" : [ [1, 2], {x: 1}, 7 ], 'label': 2020}, /* {label: 'z', data: [1]} */
      {data: JSON.parse('[1]'), label: 'calls'}, {label: 'none'}]}, more"""
    assert read(js)[0] == ["J'an", "F'ev", "M]"]
    assert sorted(read(js)[1]) == [("2020", ["", "", "7"]), ("inner", ["9", "9"]), ("x", ["1", "-2.5e3", "null", "", "4"])]
    assert read("{data:[1]},{data:[2]}") == ([], [("Dataset_1", ["1"]), ("Dataset_2", ["2"])])
    for broken in ("", "]]}}", "{label:'x", "{label:'x',data:[1", "[[[{{{", "data:[1]}]", "'", "labels:[", "{label 'x' data [1]}"):
        read(broken)
    assert read("{label:'x',data:[1") == ([], [("x", ["1"])])
    long = "{label:'a',data:[" + ",".join("1" * 50000) + "]}"
    assert len(read(long)[1][0][1]) == 50000 and read("{" * 5000 + "}" * 5000) == ([], [])


def test_chart_extraction(spark):
    named = (
        "<script>x</script><script>new Chart(c,{labels:['Jan', \"Fev\",'Mar'],datasets:["
        "{label:'2019',data:[1, null,undefined]},{label: \"2023\", data: [4.5,x]}]})</script>"
    )
    plain = "<SCRIPT type='a'>var myChart; labels: [a,b]; data: [1,2,3]; data:[7]</SCRIPT>"
    pages = spark.createDataFrame(
        [(1, named), (2, plain), (3, "<script>Chart data:[1]</script>"), (4, "<p>labels:[a] data:[1]</p>")],
        "id int, html string",
    )
    got = [tuple(r) for r in charts.extract_series(pages, ["id"]).collect()]
    assert got == [
        (1, "2019", "Jan", 1.0), (1, "2019", "Fev", None), (1, "2019", "Mar", None),
        (1, "2023", "Jan", 4.5), (1, "2023", "Fev", None), (1, "2023", "Mar", None),
        (2, "Dataset_1", "a", 1.0), (2, "Dataset_1", "b", 2.0),
        (2, "Dataset_2", "a", 7.0), (2, "Dataset_2", "b", None),
    ]


def test_upsert(spark, tmp_path):
    def batch(rows):
        df = spark.createDataFrame(
            rows, f"id string, values array<float>, source string, text string, `{C.YEAR}` int, type string, v int"
        )
        return vectors.to_records(df, F.col("id")).join(df.select("id", "v", F.col("text").alias("t")), "id").where(
            F.col("metadata.text") == F.col("t")
        ).drop("t")

    first = batch([("a", [1.0], "s", "a1", 2010, "x", 1), ("b", [2.0], "s", "b1", 2011, "y", 1)])
    second = batch([("b", [3.0], "s", "b2", 2012, "x", 1), ("b", [4.0], "s", "b3", 2013, "z", 2), ("c", [5.0], "s", "c1", None, "x", 1)])
    path = str(tmp_path / "v")
    vectors.upsert_vectors(spark, first, path)
    out = vectors.upsert_vectors(spark, second, path, version=[F.col("v")])
    got = sorted((r["id"], r["metadata"]["text"], r["type"]) for r in out.collect())
    assert got == [("a", "a1", "x"), ("b", "b3", "z"), ("c", "c1", "x")]
    before = sorted(map(str, out.collect()))
    again = vectors.upsert_vectors(spark, second, path, version=[F.col("v")])
    assert sorted(map(str, again.collect())) == before
    scan = vectors.scan_vectors(spark, path, F.col("type") == "x", with_values=False)
    assert sorted(r["id"] for r in scan.collect()) == ["a", "c"] and "values" not in scan.columns
    # The first version of b is of type y: a condition must not bring it back.
    assert vectors.scan_vectors(spark, path, F.col("type") == "y").count() == 0
    with pytest.raises(Exception, match="duplicate key"):
        vectors.upsert_vectors(spark, second, path)
    assert sorted(map(str, vectors.scan_vectors(spark, path).collect())) == before


def records(spark, rows):
    df = spark.createDataFrame(rows, f"id string, values array<float>, text string, `{C.YEAR}` int, type string")
    return vectors.to_records(df.withColumn(C.SOURCE, F.lit("s")), F.col("id"))


def stored(df):
    return {r["id"]: r["metadata"]["text"] for r in df.collect()}


def files_of(path):
    return {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_small_batches_on_a_large_collection(spark, tmp_path, monkeypatch):
    """Appends touch no file; buckets with many parts are merged, those alone, and split as they fill."""
    monkeypatch.setattr(vectors, "BUCKETS", 4)
    monkeypatch.setattr(vectors, "MOST_PARTS", 3)
    path, want = str(tmp_path / "v"), {f"i{k}": "first" for k in range(300)}
    vectors.upsert_vectors(spark, records(spark, [(i, [1.0], t, 2000, "x") for i, t in want.items()]), path)
    base = files_of(tmp_path / "v")
    merges = 0
    for turn in range(6):
        new = {f"i{(turn * 7 + k) % 320}": f"turn {turn}" for k in range(5)}
        before, known = files_of(tmp_path / "v"), vectors.read_manifest(spark, path)
        if turn == 3:
            monkeypatch.setattr(vectors, "BUCKET_ROWS", 20)
        out = vectors.upsert_vectors(spark, records(spark, [(i, [2.0], t, 2001, "y") for i, t in new.items()]), path)
        want |= new
        assert stored(out) == want
        after = files_of(tmp_path / "v")
        assert before.items() <= after.items()  # nothing is rewritten in place
        now = vectors.read_manifest(spark, path)
        if now["version"] == known["version"] + 1:
            assert base.items() <= after.items() and [s for s in now["segments"] if s["base"]] == [s for s in known["segments"] if s["base"]]
        else:
            merges += 1
            coarse = min(s["buckets"] for s in known["segments"])
            merged = {int(b) % coarse for b in now["segments"][0]["live"]}
            for s in known["segments"]:  # buckets that were not due are still read from where they were
                left = next((x for x in now["segments"] if x["name"] == s["name"]), {"live": {}})
                assert {b for b in s["live"] if int(b) % coarse not in merged} == set(left["live"])
    assert merges >= 1 and vectors.read_manifest(spark, path)["buckets"] > 4
    assert sum(sum(s["live"].values()) for s in vectors.read_manifest(spark, path)["segments"]) >= len(want)
    vectors.vacuum_vectors(spark, path)
    assert stored(vectors.scan_vectors(spark, path)) == want
    assert len(files_of(tmp_path / "v")) < len(after) and len(list((tmp_path / "v" / "_manifest").glob("[0-9]*"))) == 1


def test_crash_between_the_writes_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    vectors.upsert_vectors(spark, records(spark, [("a", [1.0], "old", 1, "x"), ("b", [1.0], "old", 1, "x")]), path)
    commit = vectors._commit
    batch = records(spark, [("b", [2.0], "new", 1, "x"), ("c", [2.0], "new", 1, "x")])

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(vectors, "_commit", crash)
    with pytest.raises(OSError):
        vectors.upsert_vectors(spark, batch, path)
    assert stored(vectors.scan_vectors(spark, path)) == {"a": "old", "b": "old"}
    (tmp_path / "v" / "_manifest" / "000000000009").write_text('{"version": 9, "seg')  # a manifest cut off in the middle
    assert stored(vectors.scan_vectors(spark, path)) == {"a": "old", "b": "old"}
    monkeypatch.setattr(vectors, "_commit", commit)
    monkeypatch.setattr(vectors, "MOST_PARTS", 1)  # append and merge, the merge fails
    monkeypatch.setattr(vectors, "_merged", lambda *_: crash())
    with pytest.raises(OSError):
        vectors.upsert_vectors(spark, batch, path)
    want = {"a": "old", "b": "new", "c": "new"}
    assert stored(vectors.scan_vectors(spark, path)) == want
    vectors.vacuum_vectors(spark, path)
    assert stored(vectors.scan_vectors(spark, path)) == want


def test_two_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "v")
    vectors.upsert_vectors(spark, records(spark, [("a", [1.0], "old", 1, "x")]), path)
    seen = vectors.read_manifest(spark, path)
    vectors.upsert_vectors(spark, records(spark, [("b", [1.0], "old", 1, "x")]), path)
    with pytest.raises(RuntimeError, match="another writer"):
        vectors._commit(spark, path, {**seen, "version": seen["version"] + 1})
    assert stored(vectors.scan_vectors(spark, str(tmp_path / "none"))) == {}


def test_log(spark, tmp_path):
    array = tmp_path / "log.json"
    array.write_text(json.dumps([{"timestamp": "t", "question": "é", "response": "None"}] * 2, indent=4))
    assert log.read_log_array(spark, str(array)).count() == 2
    (tmp_path / "bad.json").write_text("{")
    assert log.read_log_array(spark, str(tmp_path / "bad.json")).count() == 0
    assert log.read_log_array(spark, str(tmp_path / "missing.json")).count() == 0
    turns = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"),
         (2, 0, "user", "q3"), (2, 1, "user", "q4"), (2, 2, "assistant", "a4")],
        "conv_id long, turn long, role string, text string",
    )
    rec = log.log_records(log.pair_turns(turns), "question", "response")
    path = str(tmp_path / "lines")
    log.append_log(rec, path)
    log.append_log(rec, path)
    got = sorted((r["question"], r["response"]) for r in log.read_log(spark, path).collect())
    assert got == sorted([("q1", "a1"), ("q2", "None"), ("q3", "None"), ("q4", "a4")] * 2)
    assert all(dt.datetime.fromisoformat(r["timestamp"]) for r in log.read_log(spark, path).collect())
    stream = spark.readStream.schema(schemas.LOG).json(path)
    out = str(tmp_path / "out")
    stream_log(stream, out, str(tmp_path / "ckpt")).awaitTermination(60)
    assert log.read_log(spark, out).count() == 8


def test_one_array_is_read_by_many_tasks(spark, tmp_path):
    """Cut anywhere: braces, quotes, escapes and brackets in strings, nested objects, each layout."""
    rng = random.Random(4)
    bits = ["}", "{", '"', "\\", "]", "[", ",", "},{", '"},\n  {"', "é", " ", "word", "\n", '\\"', "漢"]
    text = lambda: "".join(rng.choices(bits, k=rng.randrange(12)))
    records = [{"timestamp": str(i), "question": text(), "response": text()} for i in range(1500)]
    for r in records[::7]:
        r["more"] = {"a": [{"}": text()}, {}], "b": {"c": {}}}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, layout in ((16_000, {"indent": 4}), (16_000, {"separators": (",", ":")}), (64, {"indent": 1, "ensure_ascii": False})):
            path = tmp_path / f"{size}_{len(layout)}.json"
            many = records[:20] if size == 64 else records
            expected = sorted((r["timestamp"], r["question"], r["response"]) for r in many)
            path.write_text(json.dumps(many, **layout), encoding="utf-8")
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 4
            got = log.read_log_array(spark, str(path))
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            assert sorted(tuple(r) for r in got.collect()) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_broken_arrays_give_no_rows(spark, tmp_path):
    good = json.dumps([{"question": "q", "response": "}"}, {"question": "r"}])
    broken = [
        good[:-1], good[1:], good + "]", good + "{}", good.replace("}, {", "} {"), good.replace("}, {", "},, {"),
        good.replace('"r"', '"r'), good.replace('"q"', "q"), "[", "", "{}", "[1]", good + good, good.replace("[", "[1,"), "null", '["}"]',
    ]
    for i, text in enumerate(broken):
        (tmp_path / f"{i}.json").write_text(text)
    for name, text in (("good", good), ("empty", " [ \n ] "), ("blank", "[{}]")):
        (tmp_path / f"{name}.json").write_text(text)
    got = log.read_log_array(spark, str(tmp_path)).collect()
    assert sorted((r["question"] or "", r["response"] or "") for r in got) == [("", ""), ("q", "}"), ("r", "")]


def test_stream_counts_a_record_once(spark, tmp_path):
    """Restarts, a file delivered again under another name, equal records with other keys."""
    schema = "timestamp string, question string, response string, id int"
    source, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    at = "2026-01-01T00:00:00"
    batches = [
        [(at, "q", "r", 1), (at, "q", "r", 2), (at, "q", "r", 2)],
        [(at, "q", "r", 1), (at, "late", None, 3), ("no time", "lost", "r", 4), (None, "lost", "r", 5)],
        [],
        [("2026-01-02T00:00:00", "q", "r", 2), ("2026-01-02T00:00:00", "next", "r", 6)],
    ]
    counts = []
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(source)
        stream_log(spark.readStream.schema(schema).json(source), out, state, once=["id"]).awaitTermination(120)
        counts.append(log.read_log(spark, out).count())
    assert counts == [2, 3, 3, 4]
    assert sorted(r["question"] for r in log.read_log(spark, out).collect()) == ["late", "next", "q", "q"]


def test_chunk_fixed_is_a_sliding_slice(spark):
    texts = ["", "a" * 10, "é" * 500, "x" * 501, "".join(chr(97 + i % 26) for i in range(2345)), "a\nb" * 400, "😀" * 951]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in chunks.chunk_fixed(df, "t").orderBy("id", "chunk_no").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
    for i, t in enumerate(texts):
        want = [t[s : s + 500] for s in range(0, len(t), 450) if s == 0 or s + 50 < len(t)] if t else []
        assert got.get(i, []) == want


def test_chunk_recursive(spark):
    assert chunks.split_recursive("aaa bbb ccc\n\nddd eee fff ggg hhh\niii jjj", 12, 4) == [
        "aaa bbb ccc", "ddd eee fff", "fff ggg hhh", "iii jjj",
    ]
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcde"), rng.integers(1, 12))) for _ in range(3000)]
    text = "".join(w + rng.choice([" ", "\n", "\n\n", " "]) for w in words)
    got = chunks.split_recursive(text, 200, 20)
    assert all(len(c) <= 200 for c in got)
    assert set(" ".join(got).split()) == set(words)
    assert chunks.split_recursive("z" * 25, 10, 2) == ["z" * 10, "z" * 10, "z" * 9]
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    out = chunks.chunk_recursive(df, "t", 200, 20).orderBy("chunk_no").collect()
    assert [r["chunk"] for r in out] == got and {r["id"] for r in out} == {1}


def test_chunk_recursive_is_the_plain_split(spark):
    """Against the plain form: dense lines, long words, runs of blanks, repeated rows, empty and null texts."""
    rng = np.random.default_rng(1)

    def text(words, longest):
        parts = []
        for _ in range(words):
            parts.append("".join(rng.choice(list("abé😀"), rng.integers(1, longest))))
            parts.append(str(rng.choice([" ", " ", " ", "  ", "\t", "\n", "\n\n", "\n\n\n"])))
        return "".join(parts)

    texts = [text(int(rng.integers(0, 300)), int(rng.choice([4, 12, 120]))) for _ in range(60)]
    texts += ["", None, " ", "\n\n", "z" * 60, "z" * 61, "z" * 500, " " * 200, "\n" * 99, "a\n\n" + "b" * 99 + "\n\nc"]
    texts += [("x " * 900).strip(), " ".join("w" * (59 - i % 2 * 57) for i in range(200)), "same row " * 20, "same row " * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for size, overlap, native in [(60, 10, True), (10, 5, True), (10, 0, True), (60, 10, False)]:
        got = {}
        for r in chunks.chunk_recursive(df, "t", size, overlap, native).orderBy("id", "chunk_no").collect():
            got.setdefault(r["id"], []).append(r["chunk"])
        for i, t in enumerate(texts):
            assert got.get(i, []) == (chunks.split_recursive(t, size, overlap) if t else []), (i, size, overlap)
    with pytest.raises(ValueError):
        chunks.chunk_recursive(df, "t", 10, 6)


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "Un deux  un"), (2, ""), (3, None)], "id int, t string")
    got = {r["id"]: r["values"] for r in embed.embed_text(df, "t").collect()}
    assert all(len(v) == 64 for v in got.values())
    assert np.linalg.norm(got[1]) == pytest.approx(1.0) and not any(got[2]) and not any(got[3])
    slot = int(hashlib.md5(b"un").hexdigest()[:8], 16) % 64
    assert got[1][slot] == pytest.approx(2 / np.sqrt(5))

    def lengths():
        return lambda texts: np.array([[float(len(t))] for t in texts])

    custom = embed.embed_text(df, "t", make_encoder=lengths).orderBy("id").collect()
    assert [r["values"] for r in custom] == [[11.0], [0.0], [0.0]]
    assert [tuple(r) for r in embed.embedding_dims(embed.embed_text(df, "t"), "values", 2).collect()] == [(1, 64), (2, 64)]


def test_tfidf(spark):
    docs = [(1, "b a a B", 7), (2, "a c", 7), (3, "", 7), (4, None, 7), (5, "d", 7), (6, "a a", 7)]
    df = spark.createDataFrame(docs, "id int, t string, slot int")
    fitted = tfidf.fit_vocabulary(df, "t", max_terms=3)
    assert [(r["term"], r["slot"], r["n_texts"]) for r in fitted.orderBy("slot").collect()] == [("a", 0, 3), ("b", 1, 1), ("c", 2, 1)]
    idf = {r["slot"]: r["idf"] for r in fitted.collect()}
    assert idf[0] == pytest.approx(np.log(7 / 4) + 1) and idf[1] == pytest.approx(np.log(7 / 2) + 1)
    out = {r["id"]: {e["slot"]: e["weight"] for e in r["terms"]} for r in tfidf.embed_tfidf(df, "id", "t", fitted).collect()}
    a, b = 2 * idf[0], 2 * idf[1]
    norm = np.hypot(a, b)
    assert out[1] == {0: pytest.approx(a / norm), 1: pytest.approx(b / norm)} and out[6] == {0: pytest.approx(1.0)}
    assert out[3] == out[4] == out[5] == {} and set(out) == {1, 2, 3, 4, 5, 6}
    plan = tfidf.embed_tfidf(df, "id", "t", fitted)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    # Rows of one key are one text; an unseen term has no slot; nothing at all gives nothing.
    again = spark.createDataFrame([(1, "a zz"), (1, "b")], "id int, t string")
    twice = tfidf.embed_tfidf(again, "id", "t", fitted).collect()
    assert len(twice) == 1 and [e["slot"] for e in twice[0]["terms"]] == [0, 1]
    assert tfidf.fit_vocabulary(df.limit(0), "t").count() == 0
    assert [len(r["terms"]) for r in tfidf.embed_tfidf(df, "id", "t", tfidf.fit_vocabulary(df.limit(0), "t")).collect()] == [0] * 6


def brute(docs, questions):
    out = []
    for qid, qv, k, cells in questions:
        q = np.array(qv) / np.linalg.norm(qv)
        hits = [
            (-round(float(q @ (np.array(v) / np.linalg.norm(v))), 9), i) for i, v, c in docs if cells is None or c in cells
        ]
        out += [(qid, r + 1, i, s) for r, (s, i) in enumerate(sorted(hits)[:k])]
    return sorted((q, r, i) for q, r, i, _ in out)


@pytest.mark.parametrize("mode", ["all", "cells"])
def test_knn_matches_brute_force(spark, monkeypatch, mode):
    """A third of the documents are copies of one vector, a third lies in one cell."""
    rng = np.random.default_rng(1)
    same = rng.normal(size=8).tolist()
    docs = [(i, same if i % 3 == 0 else rng.normal(size=8).tolist(), 0 if i % 3 == 1 else i % 5) for i in range(600)]
    asked = [(f"q{j}", rng.normal(size=8).tolist(), int(rng.integers(1, 12)), [0, 3] if j % 2 else [0]) for j in range(15)]
    asked.append(("same", same, 30, [0, 1]))
    monkeypatch.setattr(retrieve, "DOC_BLOCK", 50)
    monkeypatch.setattr(retrieve, "QUESTION_BLOCK", 4)
    monkeypatch.setattr(retrieve, "SCORE_CELLS", 130)
    d = spark.createDataFrame([*docs, (999, None, 0)], "id long, vector array<double>, cell int")
    if mode.startswith("cells"):
        q = spark.createDataFrame(asked, "qid string, vector array<double>, k int, cells array<int>").select(
            "qid", "vector", "k", F.explode("cells").alias("cell")
        )
        hits, want = retrieve.knn(d, q, on=["cell"]), brute(docs, asked)
    else:
        q = spark.createDataFrame([a[:3] for a in asked], "qid string, vector array<double>, k int")
        hits, want = retrieve.knn(d, q), brute(docs, [(*a[:3], None) for a in asked])
    assert sorted((r["qid"], r["rank"], r["id"]) for r in hits.collect()) == want


def test_questions_to_prompts(spark, tmp_path):
    rows = spark.createDataFrame(
        [(2010, "Jan", 5.0), (2011, "Feb", 7.25)], f"`{C.YEAR}` int, {C.MONTH} string, {C.VALUE} double"
    )
    docs = index.all_documents({"global": rows, "Prévision arrivée": rows.select(C.YEAR, C.VALUE)})
    first = docs.where("type = 'global'").orderBy(C.YEAR).first()
    assert first["text"] == "[global] En 2010 :. Mois : Jan. Arrivees était de 5.0. type : global."
    key = F.md5("text")
    stored = index.build_index(spark, docs, key, str(tmp_path / "index"))
    ranges = "array<struct<lo:int,hi:int,type:string>>"
    asked = spark.createDataFrame(
        [("a", "Arrivees en 2010", 1, [(2010, 2010, "global")]), ("b", "rien", 2, [(1900, 1900, "global")]),
         ("c", "Arrivees", 9, [(2010, 2011, "Prévision arrivée"), (2011, 2012, "Prévision arrivée")])],
        f"qid string, question string, k int, ranges {ranges}",
    )
    got = {r["qid"]: r for r in index.answer_prompts(asked, stored).collect()}
    assert got["a"]["context"] == f"WBData : {first['text']}"
    assert got["b"]["context"] is None and got["b"]["prompt"].endswith("Je ne dispose pas de cette information.")
    assert got["c"]["context"].count("WBData : ") == 2
    open_ = spark.createDataFrame([("d", "Arrivees", 9, [])], f"qid string, question string, k int, ranges {ranges}")
    more = index.build_index(spark, docs, F.concat(F.lit("o"), key), str(tmp_path / "index"), source="other")
    found = index.answer_prompts(open_, more).first()["context"]
    assert found.count("WBData : ") == docs.count()
    assert index.answer_prompts(open_, more, source="none").first()["context"] is None


def test_run_folder_is_removed(spark, tmp_path):
    from tidemark.session import Scratch, exists, remove, shared_root

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    assert shared_root(spark).startswith(root)
    scratch = Scratch(spark)
    one, two = scratch.write(spark.range(3), "one"), scratch.write(spark.range(2), "two")
    paths = {tag: path for path, tag in scratch.paths.items()}
    scratch.drop("two")
    assert not exists(spark, paths["one"]) and exists(spark, paths["two"]) and two.count() == 2
    path = str(tmp_path / "x")
    one = spark.range(1)
    one.write.parquet(path)
    remove(spark, path)
    assert not exists(spark, path)


def test_shared_folder(spark):
    assert shared_dir(spark, "x") != shared_dir(spark, "x")
    df = materialise(spark.range(3), "t")
    assert df.count() == 3


def test_python_functions_travel_with_their_code():
    """Executors need not have the package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    code = (
        "import sys; from pyspark import cloudpickle;"
        "f, g = cloudpickle.loads(sys.stdin.buffer.read());"
        "print(f()(['a b']).shape[1], g('a b c', 3, 0), 'tidemark' in sys.modules)"
    )
    out = subprocess.run(
        [sys.executable, "-c", code], cwd="/", capture_output=True, check=True,
        input=cloudpickle.dumps((embed.hash_encoder, chunks.split_recursive)),
    )
    assert out.stdout.decode().strip() == "64 ['a b', 'c'] False"
