"""Periodic runs, fill-in-middle cuts and merge pieces against brute force and the library."""

import cProfile
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fim_cuts, merge_pieces, queries, word_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    """Runs of many periods, lines of all kinds, markers, scripts, very long and hardly any texts, repeats."""
    rng = random.Random(3)
    texts = [None, "", " \n\t", "\n", "\n\n", "a", "a\n", "a b c d e", "x\x0by\x1cz\x85q", "<P>a\nb", "a<\nS>b", "é\n漢字 😀\r\n\n", "<S", "a a a a a a", "a a a a a"]
    for k in range(150):
        size = rng.choice([1, 2, 2, 3, 8])
        words = [rng.choice("abcdefgh"[:size]) for _ in range(rng.randrange(60))]
        if k % 3 == 0:
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
            words += unit * rng.randrange(1, 9) + [rng.choice("abcd")]
        texts.append("".join(w + rng.choice([" ", "\n", "  ", " \n"]) for w in words))
    texts += ["tick " * 3000, "one two " * 2000 + "three " * 2000, "".join(f"line {i % 7}\n" for i in range(9000)), "\n" * 70000, "ab\n" * 50000]
    texts += [texts[20], texts[20]]
    return [(k + 5, t) for k, t in enumerate(texts)] + [(None, "a b a b a b a b\nc"), (30, "q q q q q q q"), (30, "q q q q q q q")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit(7) for c in ("n", "h1", "form", "output", "runs", "ids", "collapsed", "decoded", "best", "key")})


def runs_of(w):
    """Every stretch with a smallest period that neither neighbour extends, by definition."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(w[i : i + length - p] == w[i + p : i + length] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_by_definition():
    rng = np.random.default_rng(1)
    for k in range(400):
        texts = [rng.integers(0, rng.integers(1, 4), rng.integers(0, 40)) for _ in range(4)]
        if k % 2:
            unit = rng.integers(0, 3, rng.integers(1, 6))
            texts.append(np.concatenate([rng.integers(0, 2, 5), np.tile(unit, rng.integers(2, 8)), unit[:2], rng.integers(0, 3, 4)]))
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        words = np.concatenate(texts)
        got = [(int(i), int(size), int(q)) for i, q, size in word_runs.find_runs(words, first)] if len(words) else []
        want = [(int(lo) + i, size, q) for lo, t in zip(first, texts) for i, size, q in runs_of(t.tolist())]
        assert got == want


def test_work_on_long_runs_is_in_proportion():
    words = np.concatenate([np.zeros(60000, np.int64), np.tile(np.arange(5000), 9), np.tile(np.array([1, 2, 1]), 20000)])
    got = word_runs.find_runs(words, np.array([0, len(words)])).tolist()
    assert [0, 1, 60001] in got and [60000, 5000, 45000] in got and [105000, 3, 60000] in got


def planted(id, words):
    h = zlib.crc32(str(id).encode())
    n, g = len(words), h // 10
    if id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_word_runs_query(spark, docs, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "documents", lambda *_: docs)
    got = queries.op13_word_runs(spark, "").collect()
    want, some = [], 0
    for id, text in rows:
        if text and len(text) > 20000:
            continue
        w = planted(id, WORD.findall(text or ""))
        runs = runs_of(w)
        some += len(runs)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((id, len(runs), *best, milli, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert some > 60
    short = {id for id, *_ in want}
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r) for r in got if r["doc_id"] in short], key=key) == sorted(want, key=key)
    assert len(got) == len(rows)
    assert word_runs.periodic_runs(docs.where("false")).count() == 0


def test_long_texts_collapse(docs, rows):
    out = {r["doc_id"]: r for r in word_runs.periodic_runs(docs).collect()}
    ids = {t: i for i, t in rows if t and len(t) > 4000}
    tick = out[ids["tick " * 3000]]
    assert tick["collapsed"] == "tick" and [tuple(r) for r in tick["runs"]] == [(0, 3000, 1)] and tick["n_words"] == 3000
    two = out[ids["one two " * 2000 + "three " * 2000]]
    assert two["collapsed"] == "one two three" and len(two["runs"]) == 2


def test_boundary_set_against_sorted_offsets():
    rng = np.random.default_rng(2)
    sets = [
        np.zeros(0, np.int64), np.array([0]), np.array([65535, 65536, 1 << 40]), np.arange(1, 200001), np.arange(3, 400000, 3),
        np.unique(rng.integers(1, 1 << 22, 3000)), np.unique(np.concatenate([np.arange(100, 9000), rng.integers(1, 1 << 18, 90000)])),
    ]
    kinds = set()
    for offsets in sets:
        held = fim_cuts.BoundarySet(offsets.astype(np.int64))
        kinds |= {type(c).__name__ for c in held.containers}
        assert len(held) == len(offsets) and held.after(0) == 0
        for k in {0, len(offsets) - 1, *rng.integers(0, max(1, len(offsets)), 300).tolist()} if len(offsets) else ():
            assert held.select(k) == offsets[k]
            assert held.after(k + 1) == offsets[k]
    assert kinds == {"ArrayContainer", "BitmapContainer", "RunContainer"}


def test_fim_query(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(queries, "documents", lambda *_: docs)
    got = queries.op12_fim_cuts(spark, "").collect()
    want = []
    for id, text in rows:
        text = text or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        n = len(units)
        digest = sha("7:" + ("" if id is None else str(id)))
        h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
        i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
            want.append((id, n, "plain", None, None, sha(text), sha(text)))
        elif h4 % 100 < 50:
            want.append((id, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)))
        else:
            want.append((id, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim_cuts.fill_in_middle(docs.where("false")).count() == 0


def test_forms_by_percent(docs):
    assert {r["form"] for r in fim_cuts.fill_in_middle(docs, fim_percent=0).collect()} == {"plain"}
    assert "psm" not in {r["form"] for r in fim_cuts.fill_in_middle(docs, spm_percent=100).collect()}


PIECES_OF = [
    "Hello world", "  two  spaces   three", " ", "     ", " " * 37, "\t\n\n x", "naïve café — “quotes”", "漢字かな交じり文", "😀🇫🇷 emoji", "𒀀𒀁 rare", "́combining",
    "▁literal▁mark", "<s> </s> <unk> <0x41>", "def f(x):\n    return x**2  # c\n", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "https://example.org/a?b=c&d=1", "\x00nul", "a b​c", "MiXeD CaSe",
    "0123456789 3.14159", "internationalization antidisestablishmentarianism", "�￾", "   lead and trail   ",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_as_the_library(library):
    rng = random.Random(9)
    table = merge_pieces.pieces()
    letters = "etaoinshrdlu" * 3 + "  ▁\n.,'ABCxyz0123éü漢😀" + "".join(rng.sample([t for t in table.texts if len(t) == 1], 60))
    texts = PIECES_OF + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["".join(rng.choice(table.texts[:9000]) for _ in range(rng.randrange(1, 12))) for _ in range(6000)]
    for text in texts:
        assert table.encode(text) == library.encode(text), text


def test_last_pieces_are_those_of_prefixes(library):
    table = merge_pieces.pieces()
    word = "▁internationalisation😀s"
    last = table.last_pieces(word)
    for end in range(1, len(word) + 1):
        ids = library.encode(word[1:end]) if end > 1 else library.encode("▁")[:1]
        if last[end] is not None and end > 1:
            assert table.ids[table.texts[last[end]]] == ids[-1]


def test_pieces_that_only_occur_in_longer_ones_and_whole_texts(monkeypatch):
    """A small vocabulary without single characters, byte pieces and cuts at spaces."""
    table = object.__new__(merge_pieces.Pieces)
    table.__dict__ |= merge_pieces.pieces().__dict__
    table.stretches = re.compile(r"(?s).+")
    table.known = {}
    for text in PIECES_OF:
        assert table.encode(text) == merge_pieces.pieces().encode(text)
    table.bytes = {}
    assert table.encode("a𒀀𒀁b").count(table.unknown) == 1


def test_small_tables_of_pairs_and_stretches(library, monkeypatch):
    monkeypatch.setattr(merge_pieces, "MOST_KEPT", 4)
    table = merge_pieces.pieces()
    monkeypatch.setattr(table, "known", {})
    for text in PIECES_OF * 2:
        assert table.encode(text) == library.encode(text)
    assert len(table.known) <= 4


def test_new_stretches_are_taken_together(library, monkeypatch):
    """Steps of the interpreter for a new word don't grow with the pieces that match in it."""
    rng = random.Random(4)
    table = merge_pieces.pieces()
    words = ["".join(rng.choice(["tion", "ou", "st", "he", "er", "an", "in"]) for _ in range(rng.randrange(3, 9))) for _ in range(4000)]
    text = " ".join(dict.fromkeys(words))
    assert table.encode(text) == library.encode(text)  # pairs are tested once
    monkeypatch.setattr(table, "known", {})
    profile = cProfile.Profile()
    profile.enable()
    table.encode(text)
    profile.disable()
    assert sum(entry.callcount for entry in profile.getstats()) < 10 * len(set(words))


def test_pieces_by_small_tables_and_parts(library, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(merge_pieces, "TOGETHER", 30)
    monkeypatch.setattr(merge_pieces, "LONGEST_TOGETHER", 8)
    monkeypatch.setattr(merge_pieces, "LONGEST_KEPT", 5)
    monkeypatch.setattr(merge_pieces.Kept, "PLACES", 3)
    table = merge_pieces.pieces.__wrapped__()
    letters = "etaoinshr  ▁\n.é漢😀𒀀\U0010ffff"
    texts = PIECES_OF + ["", *("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(200))]
    for most in (1 << 18, 7):
        monkeypatch.setattr(merge_pieces, "MOST_KEPT", most)
        assert [ids.tolist() for ids in table.encode_all(texts)] == [library.encode(text) for text in texts]
        assert max(map(len, table.known), default=0) <= 5


def test_pieces_query(spark, docs, rows, library, monkeypatch):
    monkeypatch.setattr(queries, "documents", lambda *_: docs)
    got = queries.op11_merge_pieces(spark, "").collect()
    want = []
    for id, text in rows:
        ids = library.encode(text or "")
        want.append((id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert merge_pieces.encoded_texts(docs.where("false")).count() == 0
