"""Classifiers, sharding, mixing, the registered queries and the pipeline."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from testbed.compare import connect, problem
from tidemark.llm import labelled, quality_ftrl, queries, raking, toxic_gru, vector_shards

SF = "/root/testdata/sf0.001"
BAD = ["scumbag", "rotter", "vermin"]


def made(rng, n, kind):
    words = ["".join(rng.choice(list("aeinorst"), rng.integers(2, 8))) for _ in range(n)]
    if kind == "loud":
        words = [w.upper() + "!!" for w in words]
    if kind == "toxic":
        for at in rng.integers(0, n, 3):
            words[at] = rng.choice(BAD)
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        kind = ("loud", "toxic", "plain", "plain")[i % 4]
        rows.append((i, made(rng, int(rng.integers(20, 90)), kind), int(kind != "loud"), int(kind == "toxic")))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").withColumn("quality_score", F.lit("clash"))
    return df.select("doc_id", "text", "quality_score"), df.select("doc_id", "quality", "toxic")


def test_training_sample(spark, labelled_rows):
    docs, labels = labelled_rows
    more = labels.union(spark.createDataFrame([(3, None, None), (None, 1, 1), (5, 7, 1), (9999, 0, 0)], labels.schema))
    rows = labelled.sample(docs, more, "quality", 50).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)
    counts = {y: sum(r["y"] == y for r in rows) for y in (0, 1)}
    assert counts[1] == 50 and counts[0] in (49, 50)
    assert {r["share"] for r in rows if r["y"] == 1} == {sum(zlib.crc32(str(i).encode()) % 5 != 0 and i % 4 != 0 for i in range(400)) / 50}
    held = docs.select("doc_id", labelled.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)


def accuracy(scores, labels, name, limit):
    rows = scores.join(labels, "doc_id").where(labelled.held_out(F.col("doc_id"))).select("score", name).collect()
    assert len(rows) > 50
    return np.mean([(r["score"] >= limit) == (r[name] == 1) for r in rows])


def test_quality_classifier(spark, labelled_rows):
    docs, labels = labelled_rows
    weights = quality_ftrl.train(docs, labels)
    scores = quality_ftrl.scored(docs.drop("quality_score"), weights).withColumnRenamed("quality_score", "score")
    assert accuracy(scores, labels, "quality", 0.3) > 0.97
    assert (weights == quality_ftrl.train(docs.repartition(3), labels)).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "the same text"), (4, "the same text"), (5, "word " * 50_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["quality_score"] for r in quality_ftrl.scored(odd, weights).collect()}
    assert got[1] == got[2] == pytest.approx(1 / (1 + np.exp(-weights[-1]))) and got[3] == got[4]
    nothing = quality_ftrl.train(docs, labels.where("false"))
    assert quality_ftrl.scored(odd, nothing).where("quality_score <> 0.5").count() == 0
    assert quality_ftrl.scored(odd.where("false"), weights).count() == 0


def test_sparse_dot_product():
    weights = np.random.default_rng(0).normal(size=(1 << quality_ftrl.BITS) + 1).astype(np.float32)
    texts = ["a b a", "", "x", "a b a"]
    at, values, bounds = quality_ftrl.features(pa.array(texts))
    for i, p in enumerate(quality_ftrl.probabilities(pa.array(texts), weights)):
        part = slice(bounds[i], bounds[i + 1])
        assert p == pytest.approx(1 / (1 + np.exp(-(values[part] @ weights[at[part]] + weights[-1]))), rel=1e-5)
        assert not len(values[part]) or np.linalg.norm(values[part]) == pytest.approx(1)


def test_toxicity_network(spark, labelled_rows):
    docs, labels = labelled_rows
    model = toxic_gru.train(docs, labels)
    assert accuracy(toxic_gru.scored(docs, model).withColumnRenamed("toxic_score", "score"), labels, "toxic", 0.5) > 0.85
    rng = np.random.default_rng(9)
    clean = made(rng, 700, "plain")
    late = clean + " " + BAD[0] + " " + made(rng, 40, "plain") + " " + BAD[1]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, clean), (4, late), (5, "12 34 !!"), (6, clean)], "doc_id long, text string")
    got = {r["doc_id"]: r["toxic_score"] for r in toxic_gru.scored(odd, model).collect()}
    assert got[1] == got[2] and got[4] > max(got[3], 0.5) and got[3] == pytest.approx(got[6], abs=1e-6)
    nothing = toxic_gru.train(docs, labels.where("false"))
    assert {r["toxic_score"] for r in toxic_gru.scored(odd.where("doc_id IN (1, 2, 5)"), nothing).collect()} == {0.5}


def one_by_one(text, model):
    """The score of a text, word by word and window by window, in plain loops."""
    import re as _re

    letters = [_re.sub(rb"[^A-Za-z\x80-\xff]", b"", w.encode()).lower() for w in _re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    vectors = []
    for w in letters:
        data = np.frombuffer(w, np.uint8)
        slot = int(toxic_gru.W.word_hashes(data, np.array([0]), np.array([len(data)]))[0] % np.uint64(toxic_gru.WORDS))
        padded, grams = [1, *w, 2], []
        for i in range(len(w)):
            key = np.array([padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]], np.uint64)
            grams.append(model["gram"][int(toxic_gru.W.mixed(key)[0] % np.uint64(toxic_gru.GRAMS))])
        vectors.append(np.concatenate([model["word"][slot], np.mean(grams, axis=0) if grams else np.zeros(toxic_gru.WIDE)]))
    h, sig = toxic_gru.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    starts = range(0, max(1, len(letters) - toxic_gru.WINDOW + toxic_gru.STRIDE), toxic_gru.STRIDE)
    logits = []
    for start in starts:
        part = vectors[start : start + toxic_gru.WINDOW]
        sides = []
        for d, words in (("f", part), ("b", part[::-1])):
            state, seen = np.zeros(h), []
            for v in words:
                x = v @ model[f"in_{d}"] + model[f"bias_{d}"]
                gate = sig(x[: 2 * h] + state @ model[f"gate_{d}"])
                new = np.tanh(x[2 * h :] + (gate[h:] * state) @ model[f"new_{d}"])
                state = (1 - gate[:h]) * state + gate[:h] * new
                seen.append(state)
            sides.append(seen if d == "f" else seen[::-1])
        states = [np.concatenate(pair) for pair in zip(*sides)]
        attention = np.exp([np.tanh(s @ model["look"]) @ model["ask"] for s in states])
        pooled = sum((a * s for a, s in zip(attention / attention.sum(), states)), np.zeros(2 * h)) if states else np.zeros(2 * h)
        logits.append(pooled @ model["out"] + model["bias"][0])
    smooth = np.log(np.sum(np.exp(4.0 * np.array(logits)))) / 4.0
    return sig(smooth - max(0.0, np.log(len(logits) / 16)))


def test_scores_one_by_one(labelled_rows):
    """All windows of whole texts, against an independent forward pass."""
    rng = np.random.default_rng(3)
    model = {k: v + rng.normal(0, 0.3, v.shape) for k, v in toxic_gru.fresh().items()}
    texts = [None, "", "one", "12 !!", made(rng, 31, "plain"), made(rng, 33, "toxic"), made(rng, 57, "plain"), made(rng, 900, "plain"), "Ünï çödé wörds " * 9]
    got = toxic_gru.probabilities(pa.array(texts), model)
    assert np.allclose(got, [one_by_one(t, model) for t in texts], atol=2e-4)


def test_long_texts_are_learnt_from_and_stay_clean(spark, labelled_rows):
    """Labelled texts over any size are in the sample; long clean texts pass, long toxic ones are found."""
    docs, labels = labelled_rows
    rng = np.random.default_rng(12)
    long = [(90000 + i, made(rng, 4000, "plain"), "x") for i in range(6)]
    more = docs.union(spark.createDataFrame(long, docs.schema))
    marks = labels.union(spark.createDataFrame([(i, 1, 0) for i, *_ in long], labels.schema))
    rows = labelled.sample(more, marks, "toxic", 10_000).collect()
    kept = [r for r in rows if r["doc_id"] >= 90000]
    assert kept and all(len(r["text"].split()) == 4000 for r in kept)
    by_class = {y: sum(r["share"] for r in rows if r["y"] == y) for y in (0, 1)}
    fold = labels.union(marks.where("doc_id >= 90000")).where(~labelled.held_out(F.col("doc_id")))
    assert by_class == {y: fold.where(f"toxic = {y}").count() for y in (0, 1)}
    model = toxic_gru.train(more, marks)
    clean = [made(rng, 20_000, "plain") for _ in range(5)]
    toxic = [" ".join([made(rng, 10_000, "plain"), BAD[0], made(rng, 9, "plain"), BAD[1], made(rng, 10_000, "plain")]) for _ in range(2)]
    frame = spark.createDataFrame(list(enumerate(clean + toxic + toxic[:1])), "doc_id long, text string")
    got = {r["doc_id"]: r["toxic_score"] for r in toxic_gru.scored(frame, model).collect()}
    assert all(got[i] < 0.5 for i in range(5)) and got[5] == pytest.approx(got[7], abs=1e-6)
    assert min(got[5], got[6]) > max(got[i] for i in range(5))
    assert toxic_gru.scored(frame.where("false"), model).count() == 0
    twice = toxic_gru.scored(frame.where("doc_id = 0").union(frame.where("doc_id = 0")), model).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    nothing = toxic_gru.train(docs, labels.where("false"))
    assert {r["toxic_score"] for r in toxic_gru.scored(frame, nothing).collect()} == {0.5}


def test_windows_cover_all_words():
    first = np.cumsum([0, 0, 1, 31, 32, 33, 100])
    doc, begin, size = toxic_gru.windows(first)
    for i in range(6):
        words = {w for d, b, s in zip(doc, begin, size) if d == i for w in range(b, b + s)}
        assert words == set(range(first[i], first[i + 1])) and (doc == i).any()
    assert size.max() <= toxic_gru.WINDOW


def test_gradients():
    """Backward pass against differences of the forward pass."""
    rng = np.random.default_rng(0)
    model = {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float64) for k, v in toxic_gru.fresh().items() if k not in ("word", "gram")}
    x = rng.normal(size=(5, 2 * toxic_gru.WIDE))
    at, real = rng.integers(0, 5, (6, 3)), np.arange(6)[:, None] < np.array([6, 4, 1])
    weight = rng.normal(size=3)

    def loss():
        x_in = {d: x @ model[f"in_{d}"] + model[f"bias_{d}"] for d in "fb"}
        logit, trace = toxic_gru._forward(model, x_in, at, real, True)
        return logit @ weight, trace

    grads = {k: np.zeros_like(v) for k, v in model.items()}
    x_grad = {d: np.zeros((5, 3 * toxic_gru.HIDDEN)) for d in "fb"}
    toxic_gru._backward(model, grads, x_grad, at, real, weight, loss()[1])
    for d in "fb":
        grads[f"bias_{d}"] += x_grad[d].sum(axis=0)
    for name in ("gate_f", "new_f", "gate_b", "new_b", "bias_f", "bias_b", "look", "ask", "out", "bias"):
        for place in [tuple(rng.integers(0, n) for n in model[name].shape) for _ in range(4)]:
            old, step = model[name][place], 1e-2
            model[name][place] = old + step
            up = loss()[0]
            model[name][place] = old - step
            down = loss()[0]
            model[name][place] = old
            assert grads[name][place] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-3)


def test_shards_are_even_and_gapless(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "x" * int(n)) for i, n in enumerate(rng.lognormal(6, 1, 4000))]
    rows += [(10_000 + i, "the copied text " * 20) for i in range(2000)] + [(None, "n"), (90077, None), (90078, ""), (1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"size": F.lit("clash"), "shard": F.lit("clash")})
    got = vector_shards.sharded(df).collect()
    assert len(got) == len(rows)
    slots, sizes = {}, np.zeros(16)
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    assert sizes.max() / sizes.min() < 1.02 and sizes.sum() == sum(len((t or "").encode()) + 1 for _, t in rows)
    assert len({r["shard"] for r in got if r["doc_id"] in (90077, 90078)}) == 1
    assert all(r["text_crc32"] == zlib.crc32(b"the copied text " * 20) for r in got if r["doc_id"] and 10_000 <= r["doc_id"] < 90_000)
    assert vector_shards.sharded(df.where("false")).count() == 0


def test_bins_are_matched_over_a_tree(spark, monkeypatch):
    monkeypatch.setattr(vector_shards, "FAN", 4)
    monkeypatch.setattr(vector_shards, "LEAST_CELLS", 30)
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") * 7919 % 400).cast("int")).alias("text"))
    got = vector_shards.sharded(df).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("slot").alias("top")).collect()
    sizes = [r["s"] for r in got]
    assert max(sizes) / min(sizes) < 1.05 and all(r["top"] == r["n"] - 1 for r in got) and sum(r["n"] for r in got) == 5000


def test_a_group_below_its_share_stays_whole(spark, monkeypatch):
    """However many rows it has; a larger one is split. Long texts and repeated rows are counted as they are."""
    monkeypatch.setattr(vector_shards, "CHUNK_PART", 4)
    monkeypatch.setattr(vector_shards, "PART_ROWS", 700)
    ids = spark.range(30_000).select(F.col("id").alias("doc_id"))
    text = F.expr("CASE WHEN doc_id < 7000 THEN 'below a quarter' WHEN doc_id < 15000 THEN 'above it é' ELSE concat('own ', doc_id) END")
    rows = ids.withColumn("text", text).union(spark.createDataFrame([(None, "q " * 60_000), (5, "x"), (5, "x")], "doc_id long, text string"))
    got = vector_shards.sharded(rows).collect()
    expected = sorted((i is not None, i or 0, len(t.encode()) + 1, len(t.split()), zlib.crc32(t.encode())) for i, t in map(tuple, rows.collect()))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["tokens"], r["text_crc32"]) for r in got) == expected
    of = {crc: {r["shard"] for r in got if r["text_crc32"] == crc} for crc in map(zlib.crc32, ("below a quarter".encode(), "above it é".encode()))}
    assert [len(shards) for shards in of.values()] == [1, 2]
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_dot_rule_by_hand():
    rng = np.random.default_rng(8)
    for distinct, n in ((False, 40), (True, 5)):
        loads = rng.random((n, 3))
        loads[3] = loads[4]
        left, free, expected = [[1.0] * 3 for _ in range(5)], set(range(5)), {}
        for i in sorted(range(n), key=lambda i: (-max(loads[i]), i)):
            best = max(sorted(free), key=lambda b: sum(x * y for x, y in zip(left[b], loads[i])))
            left[best] = [x - y for x, y in zip(left[best], loads[i])]
            free -= {best} if distinct else set()
            expected[i] = best
        assert list(vector_shards._dot_rule(loads, np.ones((5, 3)), distinct)) == [expected[i] for i in range(n)]


def raked_by_hand(cells, targets, rounds=500):
    w = {k: float(t) for k, t in cells.items()}
    whole = sum(w.values())
    for _ in range(rounds):
        for m, goal in enumerate(targets):
            sums = {}
            for k, v in w.items():
                sums[k[m]] = sums.get(k[m], 0) + v
            total = sum(goal[x] for x in sums)
            w = {k: v * goal[k[m]] / total * whole / sums[k[m]] for k, v in w.items()}
    return w


def test_cells_without_words_keep_their_share(spark):
    rows = [(i, "" if i % 2 else "a b c", "blank" if i % 2 else "full", "en") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = raking.mixed(df).collect()
    assert {r["probability"] for r in got if r["source"] == "blank"} == {raking.KEEP}
    assert 0.5 < sum(r["sampled"] for r in got if r["source"] == "blank") / 200 < 0.9


def test_contradicting_targets_are_reported(spark, monkeypatch):
    monkeypatch.setattr(raking, "ROUNDS", 2)
    cells = spark.createDataFrame([("a", "x", 10.0), ("b", "y", 10.0)], "source string, lang string, tokens double")
    goals = [("source", "a", 0.5), ("source", "b", 0.5), ("lang", "x", 0.9), ("lang", "y", 0.1)]
    targets = spark.createDataFrame(goals, "marginal string, value string, share double")
    with pytest.warns(UserWarning, match="'source': 0.8"):
        raking.raked(cells, targets, ("source", "lang"))


def test_raking(spark):
    rng = np.random.default_rng(8)
    names = ("source", "lang", "topic")
    cells = {(f"s{a}", f"l{b}", f"t{c}"): int(rng.integers(1, 1000)) for a in range(5) for b in range(3) for c in range(2) if (a, b, c) != (1, 1, 1)}
    goals = [{f"{n[0]}{i}": float(rng.uniform(1, 3)) for i in range(k)} for n, k in zip(names, (5, 3, 2))]
    df = spark.createDataFrame([(*k, float(v)) for k, v in cells.items()] + [("zero", "l0", "t0", 0.0), ("none", "l0", "t0", 5.0)], "source string, lang string, topic string, tokens double")
    targets = spark.createDataFrame([(n, x, g) for n, goal in zip(names, goals) for x, g in goal.items()], "marginal string, value string, share double")
    got = {tuple(r[:3]): r["weight"] for r in raking.raked(df, targets).collect()}
    want = raked_by_hand(cells, goals)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-4) for k in want)
    p = raking.probabilities(raking.raked(df, targets), 0.6).collect()
    assert sum(r["tokens"] * r["probability"] for r in p) == pytest.approx(0.6 * sum(cells.values()), rel=1e-6)
    free = {round(r["probability"] * r["tokens"] / r["weight"], 6) for r in p if r["probability"] < 1}
    assert len(free) == 1 and all(r["probability"] <= 1 for r in p)


def test_mixed_documents(spark):
    rows = [(i, "word " * (i % 50), "en" if i % 4 else None, f"s{i % 3 if i % 2 else 0}") for i in range(2000)]
    df = spark.createDataFrame([*rows, (None, None, None, None), (3, "word " * 3, "en", "s0")], "doc_id long, text string, lang string, source string").withColumn("topic", F.lit("clash"))
    got = raking.mixed(df).collect()
    assert len(got) == 2002 and all(0 <= r["probability"] <= 1 for r in got)
    total, kept = sum(r["tokens"] for r in got), sum(r["tokens"] for r in got if r["sampled"])
    assert kept / total == pytest.approx(raking.KEEP, abs=0.05)
    some = raking.sampled_documents(df)
    assert some.columns == df.columns and some.count() == sum(r["sampled"] for r in got)
    assert raking.mixed(df.where("false")).count() == 0 and raking.sampled_documents(df.where("false")).count() == 0


def test_registry():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}
    assert set(queries.ORACLES) <= set(queries.QUERIES) <= set(driver.queries()) and "pipeline" in driver.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.QUERIES[name](spark, SF)
    assert len(set(out.columns)) == len(out.columns)
    if name in queries.ORACLES:
        wrong, _ = problem(out, connect(SF), queries.ORACLES[name])
        assert wrong is None
    ids = [r[0] for r in out.select("doc_id").collect()]
    assert set(ids) == {r[0] for r in docs.select("doc_id").collect()}
    if name.split("_")[0] not in ("op3", "op8"):
        assert len(ids) == docs.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("other_0", F.lit("clash"))
    odd = spark.createDataFrame([(9001, None, None, None, None, "x"), (9002, "", "en", "s", 0, "x"), (None, "plain words here", "en", "s", 16, "x")], docs.schema)
    state = docs.union(odd).union(docs.where("doc_id = 1"))
    start = state.select("doc_id").distinct().count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r[0] for r in state.select("doc_id").collect()}
        state = stage(spark, state, SF).cache()
        assert state.columns == docs.columns
        assert {r[0] for r in state.select("doc_id").collect()} <= before, name
        empty = stage(spark, docs.where("false"), SF)
        assert empty.columns == docs.columns and empty.count() == 0
    assert 0 < state.count() < start
    pieces = corpus_pipeline.STAGES[-1][1](spark, state, SF)
    assert {r[0] for r in pieces.select("doc_id").collect()} == {r[0] for r in state.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_stages_match_brute_force(spark):
    """Each stage's decisions, from the operator's own scores, components, repeats and draws."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights = quality_ftrl.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in docs.collect() if quality_ftrl.probabilities(pa.array([r["text"]]), weights)[0] >= 0.3}
    assert {r[0] for r in corpus_pipeline.classify_quality(spark, docs, SF).select("doc_id").collect()} == good
    linked = connect(SF).execute(f"SELECT doc_id FROM ({queries.ORACLES['op10_prefix_join']}) WHERE doc_id = component_id").fetchall()
    assert {r[0] for r in corpus_pipeline.join_near_copies(spark, docs, SF).select("doc_id").collect()} == {x[0] for x in linked}
    from test_text_operators import removed

    want = removed([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: r for r in corpus_pipeline.remove_repeats(spark, docs, SF).collect()}
    assert set(got) == {i for i, (n, gone, _) in want.items() if not gone or gone < n}
    assert all(got[i]["text"] == t and got[i]["n_chars"] == len(t) for i, (n, gone, t) in want.items() if gone and i in got)
    drawn = {r["doc_id"] for r in raking.mixed(docs).where("sampled").collect()}
    assert {r[0] for r in corpus_pipeline.mix_sources(spark, docs, SF).select("doc_id").collect()} == drawn


def test_pipeline_keeps_unique_texts_of_repeated_ids(spark):
    """One id with two texts: the unique one stays, whichever row comes first; equal rows become one."""
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w30", "other")
    rows = [
        (1, long, "a"), (1, "completely other words that nobody else has", "b"), (2, near, "c"), (2, near, "d"), (2, near, "d"),
        (3, "this text stands alone in the whole table", "e"), (4, "", "f"), (4, "", "f"), (4, None, "g"), (None, long, "h"), (None, long, "h"),
        (5, long, "i"), (0, "this text stands alone in the whole table", "j"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, row__key string").repartition(3)
    got = sorted((tuple(r) for r in corpus_pipeline.join_near_copies(spark, df, SF).collect()), key=str)
    want = [
        (1, long, "a"), (1, "completely other words that nobody else has", "b"), (0, "this text stands alone in the whole table", "j"),
        (4, "", "f"), (4, None, "g"), (None, long, "h"), (None, long, "h"),
    ]
    assert got == sorted(want, key=str)
    alone = df.where("doc_id IN (0, 3, 5) OR doc_id IS NULL")
    assert sorted(r[0] or -1 for r in corpus_pipeline.join_near_copies(spark, alone, SF).collect()) == [-1, -1, -1, 5]
