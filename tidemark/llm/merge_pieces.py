"""Encoding by a merge-type piece vocabulary in one pass over each text, and decoding.

Merging joins the best-scored pair of neighbours again and again. Its result is the one row of
pieces in which each two neighbours are compatible: merged by themselves they stay these two.
So every prefix of a text has exactly one last piece: the piece that ends there, as an automaton
over the vocabulary finds it, and that is compatible with the last piece of the prefix before it.
A table holds that piece for each prefix; ids are recovered from its end backwards.

No piece goes on over a mark for a space that follows another character, or holds a line end, so
texts are cut there into stretches, and a stretch that was met before is looked up. (Where a
vocabulary has such pieces, a text is one stretch.) All new stretches of a slice go through the
automaton and fill their tables together, a character of each at a time, and are read backwards
together; only very long ones are taken alone. What is kept of tested pairs, steps and short
stretches is bounded and changes no result.

Defined results: a null or empty text has no ids and decodes to the empty text; characters that
no piece has become the pieces of their bytes; very long texts and stretches take time in
proportion to their length; equal texts and repeated rows give equal ids; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W

MODEL = "piece_bpe_32k"
SPACE = "▁"
MOST_KEPT, LONGEST_KEPT = 1 << 18, 48
#: Characters of the stretches taken together, and of the longest of them.
TOGETHER, LONGEST_TOGETHER = 1 << 18, 512
# Kinds of pieces and kinds of models in a model file.
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
MERGES = 2
ENCODED = "doc_id long, ids array<int>, decoded string"


def message(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of one serialized message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, raw[at : at + size]
            at += size


class Kept:
    """Values under 2**18 of a function of two numbers, for many pairs at once.

    Each pair has one place; of two pairs with the same place the later one holds it, and the other
    is computed anew.
    """

    MIX, PLACES = np.uint64(0x9E3779B97F4A7C15), 21

    def __init__(self, function: Callable[[int, int], int], width: int) -> None:
        self.function, self.width = function, width
        self.held = np.full(1 << self.PLACES, -1)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a * self.width + b
        place = (pair.astype(np.uint64) * self.MIX) >> np.uint64(64 - self.PLACES)
        held = self.held[place]
        missing = np.flatnonzero(held >> 18 != pair)
        if len(missing):
            new, back = np.unique(pair[missing], return_inverse=True)
            values = [self.function(*divmod(x, self.width)) for x in new.tolist()]
            held[missing] = ((new << 18) + np.array(values))[back]
            self.held[place[missing]] = held[missing]
        return held & ((1 << 18) - 1)


class Pieces:
    """The vocabulary: scores of pieces, the automaton, and tests of pairs."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, "rb") as file:
            fields = list(message(file.read()))
        trainer = dict(message(next(v for f, v in fields if f == 2)))
        normalizer = dict(message(next(v for f, v in fields if f == 3)))
        if trainer.get(3, 1) != MERGES or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or not normalizer.get(3, 1):
            raise ValueError(f"not a merge-type model that leaves texts as they are: {path}")
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.unknown = 0
        for i, piece in enumerate(v for f, v in fields if f == 1):
            entry = dict(message(piece))
            text, kind = entry[1].decode(), entry.get(3, NORMAL)
            if kind == USER_DEFINED:
                raise ValueError(f"pieces defined by a user are not supported: {text}")
            if kind == NORMAL:
                self.ids[text] = i
                self.scores[text] = struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0
            elif kind == BYTE:
                self.bytes[int(text[3:5], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
        self.texts = list(self.ids)
        self.automaton = ahocorasick.Automaton()
        for k, text in enumerate(self.texts):
            self.automaton.add_word(text, (len(text), k))
        for text in {c for t in self.texts for c in t} - set(self.ids):  # characters that only occur in longer pieces
            self.automaton.add_word(text, (1, len(self.texts)))
            self.texts.append(text)
        self.automaton.make_automaton()
        self.prefixes = list(dict.fromkeys(chain([""], (t[:k] for t in self.texts for k in range(1, len(t) + 1)))))
        if max(len(self.prefixes), len(self.texts)) >= 1 << 18:
            raise ValueError(f"a vocabulary of too many prefixes: {path}")
        self.states = {prefix: k for k, prefix in enumerate(self.prefixes)}
        # Longest piece at the end of each state, next shorter piece at the end of each piece, lengths and
        # ids of pieces. None is -1: the last place is for a character of no piece.
        number = {text: k for k, text in enumerate(self.texts)}
        self.longest = np.array([next((number[t[k:]] for k in range(len(t)) if t[k:] in number), -1) for t in self.prefixes])
        self.shorter = np.array([next((number[t[k:]] for k in range(1, len(t)) if t[k:] in number), -1) for t in self.texts])
        self.sizes = np.array([*map(len, self.texts), 1])
        self.numbers = np.array([*(self.ids.get(t, -1) for t in self.texts), -1], np.int32)
        self.steps = Kept(self.step, 0x110000)
        self.fitting = Kept(lambda last, piece: self.compatible(last - 1 if last else None, piece), len(self.texts))
        inside = re.compile(f"[^{SPACE}]{SPACE}")
        alone = "".join({"\t", "\n", "\r"} - {c for t in self.texts for c in t})
        parts = f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")
        self.stretches = re.compile(r"(?s).+" if any(map(inside.search, self.texts)) else parts)
        self.histories: dict[int, tuple[list[float], list[str], list[str]]] = {}
        self.pairs: dict[tuple[int | None, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def history(self, piece: int) -> tuple[list[float], list[str], list[str]]:
        """Scores of the merges of a piece by itself in their order, and the first and the last part
        before each and at the end. Only a piece whose first part is then all of it is ever made."""
        known = self.histories.get(piece)
        if known is None:
            parts = list(self.texts[piece])
            done, heads, tails = [], [parts[0]], [parts[-1]]
            while True:
                best, at = -np.inf, -1
                for k in range(len(parts) - 1):
                    score = self.scores.get(parts[k] + parts[k + 1])
                    if score is not None and score > best:
                        best, at = score, k
                if at < 0:
                    break
                parts[at] += parts.pop(at + 1)
                done.append(best)
                heads.append(parts[0])
                tails.append(parts[-1])
            done.append(-np.inf)
            known = self.histories[piece] = done, heads, tails
        return known

    def compatible(self, last: int | None, piece: int) -> bool:
        """Whether ``piece`` may follow ``last``: None for the start, or a character of no piece.

        Both merge by themselves, best score first and the left one of equal scores, unless at
        some moment the parts that meet between them would be joined before.
        """
        right, heads, _ = self.history(piece)
        if heads[-1] != self.texts[piece]:
            return False
        if last is None:
            return True
        left, _, tails = self.history(last)
        i = j = 0
        while True:
            across = self.scores.get(tails[i] + heads[j])
            if across is not None and across > left[i] and across >= right[j]:
                return False
            if left[i] == right[j] == -np.inf:
                return True
            if left[i] >= right[j]:
                i += 1
            else:
                j += 1

    def step(self, state: int, character: int) -> int:
        """The longest end of the state with one more character that begins a piece."""
        text = self.prefixes[state] + chr(character)
        return next(self.states[text[k:]] for k in range(len(text) + 1) if text[k:] in self.states)

    def last_pieces(self, text: str) -> list[int | None]:
        """The last piece of each prefix; None for the empty one and behind a character of no piece."""
        last: list[int | None] = [None] * (len(text) + 1)
        pairs = self.pairs
        for end, (size, piece) in self.automaton.iter(text):
            if last[end + 1] is None:
                before = last[end + 1 - size]
                fits = pairs.get((before, piece))
                if fits is None:
                    if len(pairs) >= 4 * MOST_KEPT:
                        pairs.clear()
                    fits = pairs[before, piece] = self.compatible(before, piece)
                if fits:
                    last[end + 1] = piece
        return last

    def all_last_pieces(self, row: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``last_pieces`` of stretches in the order of their lengths, behind a gap each; None is -1."""
        last, state = np.full(len(row), -1), np.zeros(len(starts), np.int64)
        for depth, gone in enumerate(np.searchsorted(lengths, np.arange(lengths[-1]), "right").tolist()):
            at = starts[gone:] + depth
            state[gone:] = self.steps(state[gone:], row[at])
            piece = self.longest[state[gone:]]
            while True:
                at, piece = at[piece >= 0], piece[piece >= 0]
                if not len(at):
                    break
                fit = self.fitting(last[at - self.sizes[piece]] + 1, piece) > 0
                last[at[fit]] = piece[fit]
                at, piece = at[~fit], self.shorter[piece[~fit]]
        return last

    def recovered(self, text: str, last: list[int | None]) -> list[int]:
        """The ids, from the end of the text backwards."""
        out, at = [], len(text)
        while at:
            piece = last[at]
            size = 1 if piece is None else len(self.texts[piece])
            known = None if piece is None else self.ids.get(self.texts[piece])
            if known is not None:
                out.append(known)
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(text[at - size : at].encode()))
            elif not out or out[-1] != self.unknown:  # a row of unknown characters is one id
                out.append(self.unknown)
            at -= size
        out.reverse()
        return out

    def recovered_all(self, stretches: list[str]) -> Iterator[bytes]:
        """The ids of stretches in the order of their lengths."""
        lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
        starts = np.cumsum(lengths + 1) - lengths
        row = np.frombuffer(" ".join(["", *stretches]).encode("utf-32-le"), np.uint32).astype(np.int64)
        last = self.all_last_pieces(row, starts, lengths)
        used = np.zeros(len(row), bool)
        at, first = starts + lengths - 1, starts
        while len(at):
            used[at] = True
            at = at - self.sizes[last[at]]
            at, first = at[at >= first], first[at >= first]
        numbers = self.numbers[last[used]]
        ends = np.cumsum(used)[starts + lengths - 1]
        # Stretches with pieces that have no id, and characters of no piece.
        others = set(np.searchsorted(ends, np.flatnonzero(numbers < 0), "right").tolist())
        raw, lo = numbers.tobytes(), 0
        for k, hi in enumerate((4 * ends).tolist()):
            if k in others:
                table = last[starts[k] - 1 : starts[k] + lengths[k]].tolist()
                yield np.array(self.recovered(stretches[k], [None if p < 0 else p for p in table]), np.int32).tobytes()
            else:
                yield raw[lo:hi]
            lo = hi

    def found(self, stretches: list[str]) -> list[bytes]:
        """The ids of each stretch: looked up, and the new ones taken together."""
        known = self.known
        new = sorted(set(stretches).difference(known), key=len)
        lo = size = 0
        for hi, stretch in enumerate(new, 1):
            size += len(stretch)
            if len(stretch) > LONGEST_TOGETHER:
                known[stretch] = np.array(self.recovered(stretch, self.last_pieces(stretch)), np.int32).tobytes()
            elif size >= TOGETHER or hi == len(new) or len(new[hi]) > LONGEST_TOGETHER:
                known.update(zip(new[lo:hi], self.recovered_all(new[lo:hi]), strict=True))
                lo, size = hi, 0
        out = list(map(known.__getitem__, stretches))
        for stretch in reversed(new):
            if len(stretch) <= LONGEST_KEPT:
                break
            del known[stretch]
        if len(known) > MOST_KEPT:
            known.clear()
        return out

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        cut = [self.stretches.findall(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        row = list(chain.from_iterable(cut))
        ids = list(chain.from_iterable(self.found(row[k : k + MOST_KEPT]) for k in range(0, len(row), MOST_KEPT)))
        lo = 0
        for stretches in cut:
            yield np.frombuffer(b"".join(ids[lo : lo + len(stretches)]), np.int32)
            lo += len(stretches)

    def encode(self, text: str) -> list[int]:
        return list(self.encode_all([text]))[0].tolist()


@lru_cache(maxsize=2)
def pieces(model: str = MODEL) -> Pieces:
    import public_tokenizers

    return Pieces(public_tokenizers.path(f"{model}.model"))


@lru_cache(maxsize=2)
def decoder(model: str = MODEL):
    """The library's own ``decode(ids)``."""
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{model}.model")).decode


def encoded_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """``doc_id``, ``ids`` and the text ``decoded`` from them, of each whole text. Nothing is shuffled."""

    def run(batches):
        encode_all, decode = pieces(model).encode_all, decoder(model)
        for batch in batches:
            for part in W.slices(pa.Table.from_batches([batch]), "text", 1 << 20):
                texts = [text or "" for text in part.column("text").to_pylist()]
                seen = dict.fromkeys(texts)
                for text, ids in zip(list(seen), encode_all(list(seen)), strict=True):
                    seen[text] = ids, decode(ids.tolist()) if text else ""
                rows = [seen[text] for text in texts]
                ends = np.cumsum([0, *(len(ids) for ids, _ in rows)])
                flat = np.concatenate([ids for ids, _ in rows])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield from pa.table({"doc_id": part.column("doc_id"), "ids": ids, "decoded": pa.array([d for _, d in rows], pa.string())}).to_batches()

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, ENCODED)
