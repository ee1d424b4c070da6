"""Operators on words and tokens against brute force, with nulls, ties, repeats and long texts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import block_anchors, components, divergence_rules, prefix_join, simhash, token_spans, window_packing
from tidemark.llm import words as W
from tidemark.llm.tokens import encoded, encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, one very long text, and texts that are hardly any."""
    rng = np.random.default_rng(5)
    base, passage = prose(rng, 80), prose(rng, 60)
    rows = [base] * 12 + [None, "", " \n\t", "one", "a b c d", "A b C d", "x\x0by\x1cz", "ü é 漢字 😀"]
    for i in range(25):
        words = base.split()
        for j in rng.integers(0, 80, i % 5):
            words[j] = f"edit{i}_{j}"
        rows.append(" ".join(words).upper() if i % 7 == 0 else "\n".join(words))
    rows += [f"{prose(rng, 30)} {passage} {prose(rng, 10)}" for _ in range(20)]
    rows += [passage, "same word " * 40, prose(rng, 4), prose(rng, 13), prose(rng, 9000), base + " " + passage]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns whose names clash with those that the operators make."""
    rows = [(i * 3, t, "en" if i % 3 else None, f"s{i % 4}", i) for i, t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")
    return df.withColumns({c: F.lit("x") for c in ("b", "r", "key", "row", "bucket", "tokens", "h", "kept_text", "topic", "quality_score")})


def test_words_and_hashes(monkeypatch):
    data = ["a b  c", None, "", " x\x0by\n", "ü é", "q" * 500 + " b", "b " + "q" * 500, "A"]
    w = W.split(pa.array(data))
    assert [bytes(w.data[s:e]).decode() for s, e in zip(w.starts, w.ends)] == [x for t in data for x in WORD.findall(t or "")]
    assert list(np.diff(w.first)) == [len(WORD.findall(t or "")) for t in data]
    assert w.hashes[6 + 1] == w.hashes[6 + 4] and w.hashes[6 + 2] == w.hashes[1] == w.hashes[6 + 3]
    assert W.split(pa.array(["A"]), lower=True).hashes[0] == w.hashes[0]
    whole = w.hashes.copy()
    monkeypatch.setattr(W, "SEGMENT", 64)
    monkeypatch.setattr(W, "_powers", [])
    assert (W.split(pa.array(data)).hashes == whole).all()
    assert (W.from_planes(W.planes(whole, 8), 8) == whole).all()


def removed(rows, window=13):
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_repeats_are_removed(spark, docs, texts):
    got = block_anchors.without_repeats(docs, carry=("n", "source"))
    want = removed([(i * 3, t) for i, t in texts])
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()} == want
    assert sum(w[1] for w in want.values()) > 1000
    assert all(r["n"] * 3 == r["doc_id"] for r in got.collect())
    assert block_anchors.without_repeats(docs.where("false")).count() == 0
    again = docs.union(docs.where("doc_id = 0")).union(docs.withColumn("doc_id", F.lit(None).cast("long")).where("n = 3"))
    counts = {(r["doc_id"], r["n_removed"]) for r in block_anchors.without_repeats(again).collect()}
    assert (0, 0) in counts and (None, 80) in counts
    same = block_anchors.without_repeats(docs, untouched=True).where("n_removed = 0").select("doc_id", F.col("kept_text").alias("t"))
    assert same.join(docs, "doc_id").where("NOT t <=> text").count() == 0


def test_linked_documents(spark, docs, texts):
    sets, links = {}, []
    for i, t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i * 3] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                links.append((a, b))
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in prefix_join.linked_documents(docs).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in ids} and len(links) > 100
    assert prefix_join.linked_documents(docs.where("false")).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(str(r["component_id"]) for r in prefix_join.linked_documents(odd).collect()) == ["1", "1", "1", "1"]


def test_components_of_chains_and_stars(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (None, 3), (200, 199)]
    got = {r["vertex"]: r["component"] for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 199: 199, 200: 199}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_ids_match_the_tokenizer(texts):
    data = [t for _, t in texts if t] + ["<|endoftext|> don't 12 a\n\n b  c"]
    assert [list(x) for x in encoded(data)] == [encoder(exact=True)(t) for t in data]


def test_sections_hold_all_tokens(spark, docs, texts):
    data = docs.select("doc_id", "text").union(spark.createDataFrame([(1000, "One. Two! Three?\nfour.\n\n"), (1001, "a.b. ")], "doc_id long, text string"))
    rows = token_spans.section_tokens(data).collect()
    known = {r["doc_id"]: r["text"] or "" for r in data.collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["section"])):
        by.setdefault(r["doc_id"], []).append(r)
    for i, text in known.items():
        parts = by[i]
        assert [p["section"] for p in parts] == list(range(len(parts)))
        assert "".join(text[p["start_char"] : p["end_char"]] for p in parts) == text
        assert sum(p["n_tokens"] for p in parts) == parts[0]["doc_tokens"] == len(encoder()(text))
    assert [known[1000][p["start_char"] : p["end_char"]] for p in by[1000]] == ["One. ", "Two! ", "Three?\n", "four.\n", "\n"]
    assert sum(p["n_crossing"] for p in by[1000]) == 3
    parts = token_spans.section_tokens(data, rule="proportional").groupBy("doc_id").agg(F.round(F.sum("n_tokens"), 6).alias("n"), F.first("doc_tokens").alias("d"))
    assert parts.where("n <> d").count() == 0
    with pytest.raises(ValueError):
        token_spans.section_tokens(data, rule="x")


def test_allocation_rules():
    starts, ends, edges = np.array([0, 3, 5]), np.array([3, 5, 12]), np.array([0, 4, 6, 7, 12])
    assert list(token_spans.allocate(starts, ends, edges, "majority")[0]) == [2, 0, 0, 1]
    assert list(token_spans.allocate(starts, ends, edges, "start")[0]) == [2, 1, 0, 0]
    assert token_spans.allocate(starts, ends, edges, "proportional")[0] == pytest.approx([1.5, 0.5 + 1 / 7, 1 / 7, 5 / 7])


def test_packing_is_a_round_trip(spark, docs, texts):
    data = docs.union(docs.where("doc_id = 0"))
    pieces = window_packing.packed_pieces(data, exact=True).collect()
    assert {p["doc_id"] for p in pieces} == {i * 3 for i, _ in texts}
    by, seq = {}, {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0
        by.setdefault(p["doc_id"], []).append(p)
        seq.setdefault(p["sequence_id"], []).append(p)
    for i, t in texts[1:]:
        parts = sorted(by[i * 3], key=lambda p: p["start"])
        ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").tolist()
        assert ids == [*encoder(exact=True)(t or ""), 1] and parts[0]["doc_tokens"] == len(ids)
    padding = 0
    for parts in seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    assert window_packing.packed_pieces(docs.where("false")).count() == 0


def test_nnls_and_combinations():
    ways = window_packing.combinations(6, 3)
    assert sorted(tuple(x) for x in ways.T) == sorted({tuple(np.bincount(p, minlength=7)[1:]) for p in [(6,), (5, 1), (4, 2), (4, 1, 1), (3, 3), (3, 2, 1), (2, 2, 2)]})
    true = np.array([3.0, 0, 2, 0, 0, 1, 4])
    found = window_packing.nnls(ways, ways @ true)
    assert (found >= 0).all() and ways @ found == pytest.approx(ways @ true)
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(9, 5)), rng.normal(size=9)
    x = window_packing.nnls(a, b)
    gradient = a.T @ (b - a @ x)
    assert (x >= 0).all() and (gradient <= 1e-8).all() and np.abs(gradient[x > 0]).max() < 1e-8


def test_simhash_of_text_and_edited_text(spark, docs, texts):
    rows = {r["doc_id"]: r for r in simhash.edited_fingerprints(docs).collect()}
    known = {i * 3: t or "" for i, t in texts}
    ids = sorted(known, reverse=True)
    prints = {}
    for i, after in zip(ids, ids[1:] + ids[:1]):
        n = len(known[i]) // 3
        edited = known[i][: len(known[i]) - n] + known[after][:n]
        r = rows[i]
        assert (r["n_chars"], r["next_id"]) == (len(known[i]), after)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints.setdefault(known[i], set()).add((r["f1"], r["f2"]))
    assert all(len(x) == 1 for x in prints.values()) and prints[""] == {(0, 0)}
    assert simhash.edited_fingerprints(docs.where("false")).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "c d"), (9, None)], "doc_id long, text string")
    assert simhash.edited_fingerprints(odd).count() == 4


def test_votes_match_brute_force(spark):
    text = "the cat the cat sat on the mat"
    words = text.split()
    pairs = list(zip(words, [*words[1:], None]))
    df = spark.createDataFrame([(0, text)], "id long, text string")
    r = simhash.fingerprints(df, ["id"], "text").first()
    hashed = spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64("a", "b").alias("h1"), F.xxhash64("b", "a", F.lit(3)).alias("h2")).collect()
    for name, got in (("h1", r["f1"]), ("h2", r["f2"])):
        bits = 0
        for k in range(64):
            vote = sum((1 if h[name] >> k & 1 else -1) * (len(a) + len(b or "")) for h, (a, b) in zip(hashed, pairs))
            bits |= (vote > 0) << k
        assert got & (1 << 64) - 1 == bits


def test_block_tables_find_all(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 40)]
    rows = []
    for i in range(300):
        a, b = base[i % 20], base[20 + i % 20]
        for bit in rng.integers(0, 128, i % 6):
            a, b = (a ^ 1 << int(bit), b) if bit < 63 else (a, b ^ 1 << int(bit - 64)) if 64 <= bit < 127 else (a, b)
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "q long, f1 long, f2 long")
    for radius in (0, 3, 5):
        got = {r["q"]: r["n_within"] for r in simhash.within_radius(df.where("q % 3 = 0"), df, radius).collect()}
        want = {i: sum((a ^ c).bit_count() + (b ^ d).bit_count() <= radius for _, c, d in rows) for i, a, b in rows if i % 3 == 0}
        assert got == want


@pytest.mark.parametrize("blocks", [3, 5, 6, 8])
def test_all_cuts_find_all_once(spark, monkeypatch, blocks):
    rng = np.random.default_rng(blocks)
    base, rows = rng.integers(0, 2, (6, 128)), []
    for i in range(240):
        bits = base[i % 6] ^ (rng.permutation(128) < rng.integers(0, 14))
        rows.append((i, *np.packbits(bits).view(">i8").tolist()))
    df = spark.createDataFrame(rows, "q long, f1 long, f2 long")
    apart = lambda a, b: sum((x ^ y & (1 << 64) - 1).bit_count() for x, y in zip([v & (1 << 64) - 1 for v in a], b))
    monkeypatch.setattr(simhash, "_plan", lambda radius, *_: simhash._cut(radius, blocks))
    got = {r["q"]: r["n_within"] for r in simhash.within_radius(df.where("q % 4 = 0"), df, 7).collect()}
    assert got == {i: sum(apart((a, b), r[1:]) <= 7 for r in rows) for i, a, b in rows if i % 4 == 0}


def test_texts_with_few_edited_words_are_within_radius(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        words = prose(rng, 100).split()
        rows.append((i * 10, " ".join(words)))
        for edits in (1, 2, 3):
            new = list(words)
            for j in rng.choice(100, edits, replace=False):
                new[j] = f"edit{i}_{j}"
            rows.append((i * 10 + edits, " ".join(new)))
    prints = simhash.fingerprints(spark.createDataFrame(rows, "q long, text string"), ["q"], "text")
    got = {r["q"]: r["n_within"] for r in simhash.within_radius(prints.where("q % 10 = 0"), prints.select("f1", "f2")).collect()}
    # One in a hundred with three of a hundred words replaced differs by more bits.
    assert len(got) == 40 and min(got.values()) >= 3 and sum(got.values()) >= 40 * 4 - 3


def test_matches_carry_ids_and_bits(spark):
    rows = [(1, 0, 0), (2, 0, 0), (3, 7, 0), (4, -1, -1), (5, 0, 1 << 40), (6, -1, -2)]
    df = spark.createDataFrame(rows, "doc_id long, f1 long, f2 long")
    asked = df.withColumnRenamed("doc_id", "q").where("q IN (1, 2, 4)")
    got = sorted(tuple(r) for r in simhash.matched_documents(asked, df, 3).collect())
    near = [(1, 0), (2, 0), (3, 3), (5, 1)]
    assert got == sorted([(q, d, bits) for q in (1, 2) for d, bits in near] + [(4, 4, 0), (4, 6, 1)])
    entries = df.groupBy("f1", "f2").agg(F.min("doc_id").alias("least"))
    pairs = sorted((r["g1"], r["g2"], r["least"], r["bits"]) for r in simhash.matches(asked.drop("q"), entries, 3).collect())
    assert pairs == [(-1, -1, 4, 0), (-1, -1, 6, 1), (0, 0, 1, 0), (0, 0, 3, 3), (0, 0, 5, 1)]


def test_next_ids_of_uneven_ids(spark, monkeypatch):
    monkeypatch.setattr(simhash, "IDS_OF_BUCKET", 3)
    ids = [5, 7, 8, 1000, 1001, -40, 999999, 10, 11, 12]
    got = {r["doc_id"]: r["next_id"] for r in simhash.next_ids(spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()}
    down = sorted(ids, reverse=True)
    assert got == dict(zip(down, down[1:] + down[:1]))


def test_far_id_leaves_ranges_even(spark, monkeypatch):
    monkeypatch.setattr(simhash, "IDS_OF_BUCKET", 100)
    ids = [*range(5000), 10**15]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(4)
    got = {r["doc_id"]: r["next_id"] for r in simhash.next_ids(df).collect()}
    assert got == {i: after for after, i in zip([ids[-1], *ids], ids)}
    ranges = simhash._ranged(df, len(ids)).groupBy("bucket").count().collect()
    assert len(ranges) >= 40 and max(r["count"] for r in ranges) <= 300


def base_counts(text):
    w, seen, repeated = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if often[r] > 1 for k in range(5)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(w), sum(map(len, w)), symbols, repeated, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_rules_and_divergence(spark, docs, texts):
    some = docs.where("length(text) < 4000 OR text IS NULL")
    extra = "a b c d e x\na b c d e x\n\n\nq # $$ |<>| a b c d e \U0001f600"
    df = some.select("doc_id", "text", "lang").union(spark.createDataFrame([(5000, extra, "xx")], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in divergence_rules.judged(df).collect()}
    for i, t in [*((i * 3, t or "") for i, t in texts if len(t or "") < 4000), (5000, extra)]:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_counts(t)
        assert not (r["base_failed"] and r["kept"])
    assert divergence_rules.judged(df.where("false")).count() == 0


def histograms_of(text, lang):
    """Shares of the classes of characters and of the common words, as the rules name them."""
    w = WORD.findall(text)
    kinds = [sum(c in "\t\n\x0b\x0c\r " for c in text)]
    for kind in ("#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-", "!"):
        kinds.append(sum(c in kind for c in text))
    kinds.append(len(text) - sum(kinds))
    common = divergence_rules.COMMON.get(lang) or sorted({x for words in divergence_rules.COMMON.values() for x in words})
    counts = [w.count(x) for x in common]
    counts.append(len(w) - sum(counts))
    return [k / len(text) if text else 0.0 for k in kinds], [c / len(w) if w else 0.0 for c in counts]


def far(p, q):
    half = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
    return math.sqrt(max(0.0, sum(half(a, b) + half(b, a) for a, b in zip(p, q)) / 2))


def test_histograms_and_verdicts_by_hand(spark, texts):
    """With very long texts, repeated rows, unknown languages and columns of clashing names."""
    rng = np.random.default_rng(11)
    common = [x for words in divergence_rules.COMMON.values() for x in words]
    rows = [(i, t, (None, "en", "fr", "xx")[i % 4]) for i, t in texts] * 2
    for i in range(60):
        words = [rng.choice(common) if rng.random() < 0.4 else f"w{x}" for x in rng.integers(0, 900, int(rng.integers(5, 120)))]
        shape = (str.lower, str.upper, lambda t: t.replace("w", "#|"), lambda t: t + "!" * 90, lambda t: t.replace(" ", ", "))[i % 5]
        rows.append((1000 + i, shape(" ".join(words)), ("en", "de", "es", None)[i % 4]))
    rows.append((2000, prose(rng, 60_000), "en"))
    clash = {c: F.lit("x") for c in ("words", "lines", "common", "found", "runs", "n_words", "chars", "commons", "mean_chars", "upper", "kept", "i", "share")}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(clash)
    got = {}
    for r in divergence_rules.judged(df).collect():
        assert got.setdefault(r["doc_id"], r) == r
    hists = [(i, histograms_of(t or "", lang or ""), lang or "", len(WORD.findall(t or ""))) for i, t, lang in rows]
    means = {}
    for lang in {h[2] for h in hists}:
        judged = [h[1] for h in hists if h[2] == lang and h[3] >= divergence_rules.LEAST_WORDS]
        means[lang] = [np.mean([j[k] for j in judged], axis=0) for k in (0, 1)]
    verdicts = Counter()
    for i, own, lang, n in hists:
        r, apart = got[i], [far(own[k], means[lang][k]) for k in (0, 1)]
        # The means are rounded, and the root is steep near nothing.
        assert (r["chars_distance"], r["words_distance"]) == pytest.approx(apart, abs=1e-4)
        limits = [a + b / math.sqrt(max(n, 1)) for a, b in (divergence_rules.CHARS_LIMIT, divergence_rules.WORDS_LIMIT)]
        if all(abs(x - y) > 1e-4 for x, y in zip(apart, limits)):
            near = n < divergence_rules.LEAST_WORDS or all(x <= y for x, y in zip(apart, limits))
            assert r["kept"] == (near and not r["base_failed"])
            verdicts[r["base_failed"], r["kept"]] += 1
    assert min(verdicts[k] for k in ((False, True), (False, False), (True, False))) >= 5
    assert got[2000]["n_words"] == 60_000 and len(got) == len(texts) + 61


def test_distance(spark):
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.1, 0.2, 0.7])
    m = (p + q) / 2
    want = np.sqrt(sum(0.5 * x * np.log2(x / y) for a in (p, q) for x, y in zip(a, m) if x > 0))
    row = spark.range(1).select(divergence_rules.distance(F.lit(p.tolist()), F.lit(q.tolist())).alias("d"), divergence_rules.distance(F.lit([1.0, 0.0]), F.lit([0.0, 1.0])).alias("one"))
    assert row.first()["d"] == pytest.approx(want) and row.first()["one"] == pytest.approx(1.0)


def test_shouting_tables_and_symbols_go(spark):
    rng = np.random.default_rng(3)
    common = divergence_rules.COMMON["en"]

    def clean(n):
        return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(list("abcdefghilmnorst"), 6)) for _ in range(n)) + "."

    rows = [(i, clean(120), "en") for i in range(60)]
    rows += [(100, clean(120).upper().replace(" ", "!! "), "en"), (101, " ### ".join(clean(120).split()), "en"), (102, clean(12), "en")]
    kept = {r["doc_id"]: r["kept"] for r in divergence_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not kept[100] and not kept[101] and kept[102] and all(kept[i] for i in range(60))


def test_crc_of_pieces(spark):
    rows = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    p = window_packing.packed_pieces(rows).withColumn("c", F.crc32("ids")).first()
    assert p["c"] == zlib.crc32(bytes(p["ids"]))
