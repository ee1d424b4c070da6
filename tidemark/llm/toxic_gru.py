"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as two vectors: one of its hash, and the mean of those of its character
three-grams, both of its letters alone, lower-cased. A word that fewer than ``LEAST_TEXTS`` training
texts have keeps the second only, so that no text is learnt by heart. Overlapping windows of
``WINDOW`` words, a new one every ``STRIDE``, pass a gated recurrent layer in both directions;
attention pools the states to one logit. A document's logit is a smooth maximum over all its
windows, so that one toxic passage is enough, less ``CHANCE`` times the log of how many times more
than ``KEEP`` windows it has: what many windows raise it by chance. The network is trained by Adam on
a sample of bounded size (``PER_CLASS`` rows of each label, whole texts) in one task; of texts with
many windows a step takes the ``KEEP`` with the highest logits of all. It has a fixed size, so its
weights are sent to every task. Scoring reads all windows of whole texts.

Defined results: a text without words (null, empty) has the score of the bias alone, as one
window of no words; equal texts get equal scores up to rounding; without labels every score is
0.5; an empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.labelled import sample

WINDOW, STRIDE = 32, 24
WORDS, GRAMS, WIDE, HIDDEN = 1 << 15, 1 << 12, 8, 8
PER_CLASS, STEPS, BATCH, RATE = 1500, 500, 24, 0.01
#: Windows of a text that a step learns from, sharpness of the maximum, discount of many windows.
KEEP, SHARP, CHANCE, LEAST_TEXTS = 16, 4.0, 1.0, 5
#: Windows of one pass: bounds the memory of a task.
PASS = 4096

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def encode(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kind of each word, first word of each text; and of each kind its word slot, the slots of
    its character three-grams, and where those begin. Words without letters are kind by their own."""
    w = W.split(texts, hashed=False)
    keep = _LETTER[w.data]
    at = np.concatenate([[0], np.cumsum(keep)])
    letters = W.LOWER[w.data[keep]]
    starts, ends = at[w.starts], at[w.ends]
    hashes = W.word_hashes(letters, starts, ends)
    _, example, kind = np.unique(hashes, return_index=True, return_inverse=True)
    lo, size = starts[example], (ends - starts)[example]
    # Three-grams of "^word$", as rolling hashes of the letters of each kind.
    bounds = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(bounds[-1]) - bounds[:-1][owner]
    here = letters[lo[owner] + place].astype(np.uint64)
    before = np.where(place > 0, np.roll(here, 1), np.uint64(1))
    after = np.where(place < size[owner] - 1, np.roll(here, -1), np.uint64(2))
    with np.errstate(over="ignore"):
        grams = W.mixed(before << np.uint64(16) | here << np.uint64(8) | after) % np.uint64(GRAMS)
    return kind.astype(np.int64), w.first, (hashes[example] % np.uint64(WORDS)).astype(np.int64), grams.astype(np.int64), bounds


def windows(first: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of every window; together they cover all words."""
    counts = np.diff(first)
    each = np.maximum(1, -(-(counts - window) // stride) + 1)
    doc = np.repeat(np.arange(len(counts)), each)
    step = (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) * stride
    return doc, first[doc] + step, np.minimum(window, counts[doc] - step)


def fresh(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 0.5 / np.sqrt(shape[0]), shape)
    model = {"word": rng.normal(0, 0.1, (WORDS, WIDE)), "gram": rng.normal(0, 0.1, (GRAMS, WIDE))}
    for d in "fb":
        model |= {f"in_{d}": normal(2 * WIDE, 3 * HIDDEN), f"bias_{d}": np.zeros(3 * HIDDEN), f"gate_{d}": normal(HIDDEN, 2 * HIDDEN), f"new_{d}": normal(HIDDEN, HIDDEN)}
    model |= {"look": normal(2 * HIDDEN, HIDDEN), "ask": normal(HIDDEN, 1)[:, 0], "out": normal(2 * HIDDEN, 1)[:, 0], "bias": np.full(1, -3.0)}
    return {k: v.astype(np.float32) for k, v in model.items()}


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def inputs(model, slots, grams, bounds) -> np.ndarray:
    sums = np.zeros((len(grams) + 1, WIDE))
    np.cumsum(model["gram"][grams], axis=0, out=sums[1:])
    sizes = np.maximum(np.diff(bounds), 1)[:, None]
    return np.concatenate([model["word"][slots], (sums[bounds[1:]] - sums[bounds[:-1]]) / sizes], axis=1).astype(np.float32)


def _forward(model, x_in: dict[str, np.ndarray], at: np.ndarray, real: np.ndarray, trace: bool = False):
    """Logits of windows; ``at`` (step, window) is the kind of each word, ``real`` whether there is one."""
    steps, n = at.shape
    states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
    kept: dict = {"f": [], "b": []}
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        h = np.zeros((n, HIDDEN), np.float32)
        half = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
        for t in order:
            x = x_in[d][at[t]]
            gates = _sigmoid(x[:, : 2 * HIDDEN] + h @ model[f"gate_{d}"])
            z, r = gates[:, :HIDDEN] * real[t][:, None], gates[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ model[f"new_{d}"])
            if trace:
                kept[d].append((t, h, gates, z, r, c))
            h = h + z * (c - h)
            states[t][:, half] = h
    key = np.tanh(states @ model["look"])
    score = np.where(real, key @ model["ask"], -1e9)
    score = np.exp(score - score.max(axis=0))
    score = score * real
    weight = score / np.maximum(score.sum(axis=0), 1e-9)
    pooled = np.einsum("tn,tnk->nk", weight, states)
    return pooled @ model["out"] + model["bias"][0], (states, key, weight, pooled, kept)


def _backward(model, grads, x_grad, at, real, d_logit, trace) -> None:
    states, key, weight, pooled, kept = trace
    grads["out"] += pooled.T @ d_logit
    grads["bias"] += d_logit.sum()
    d_pooled = d_logit[:, None] * model["out"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = np.einsum("nk,tnk->tn", d_pooled, states)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grads["ask"] += np.einsum("tn,tnk->k", d_score, key)
    d_key = d_score[:, :, None] * model["ask"] * (1 - key**2)
    grads["look"] += np.einsum("tnk,tnj->kj", states, d_key)
    d_states += d_key @ model["look"].T
    for d in "fb":
        half = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
        d_h = np.zeros((at.shape[1], HIDDEN), np.float32)
        for t, h, gates, z, r, c in reversed(kept[d]):
            d_h = d_h + d_states[t][:, half]
            d_c = d_h * z * (1 - c**2)
            d_z = d_h * (c - h) * real[t][:, None]
            d_rh = d_c @ model[f"new_{d}"].T
            d_gates = np.concatenate([d_z, d_rh * h], axis=1) * gates * (1 - gates)
            grads[f"new_{d}"] += (r * h).T @ d_c
            grads[f"gate_{d}"] += h.T @ d_gates
            np.add.at(x_grad[d], at[t], np.concatenate([d_gates, d_c], axis=1))
            d_h = d_h * (1 - z) + d_rh * r + d_gates @ model[f"gate_{d}"].T


def _laid(kind, begin, size, window):
    """Kinds by step and window, and which of them are words."""
    real = np.arange(window)[:, None] < size
    at = np.where(real, begin + np.arange(window)[:, None], 0)
    return (kind[at] if len(kind) else at), real


def fit(texts, y: np.ndarray, share: np.ndarray, steps: int = STEPS) -> dict[str, np.ndarray]:
    model = fresh()
    if not len(y):
        model["bias"][:] = 0
        model["out"][:] = 0
        return model
    encoded = kind, first, slots, grams, bounds = encode(texts)
    doc, begin, size = windows(first)
    spans = np.searchsorted(doc, np.arange(len(y) + 1))
    pairs = np.unique(np.repeat(np.arange(len(y)), np.diff(first)) * WORDS + slots[kind]) if len(slots) else np.zeros(0, np.int64)
    rare = np.bincount(pairs % WORDS, minlength=WORDS) < LEAST_TEXTS
    model["word"][rare] = 0
    m = {k: np.zeros_like(v) for k, v in model.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.items()}
    turn = 0
    for epoch in range(-(-steps * BATCH // len(y))):
        order = np.random.default_rng(epoch).permutation(len(y))
        for lo in range(0, len(y), BATCH):
            docs = order[lo : lo + BATCH]
            pick = np.concatenate([np.arange(spans[i], spans[i + 1]) for i in docs])
            group = np.repeat(np.arange(len(docs)), spans[docs + 1] - spans[docs])
            if len(pick) > len(docs) * KEEP:
                some = _highest(model, encoded, pick, begin, size, group)
                pick, group = pick[some], group[some]
            at, real = _laid(kind, begin[pick], size[pick], WINDOW)
            used, local = np.unique(at, return_inverse=True)
            local = local.reshape(at.shape)
            own = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in used]) if len(slots) else np.zeros(0, np.int64)
            sizes = bounds[used + 1] - bounds[used] if len(slots) else np.zeros(1, np.int64)
            own_slots = slots[used] if len(slots) else np.zeros(1, np.int64)
            x = inputs(model, own_slots, grams[own], np.concatenate([[0], np.cumsum(sizes)]))
            x_in = {d: x @ model[f"in_{d}"] + model[f"bias_{d}"] for d in "fb"}
            logit, trace = _forward(model, x_in, local, real, True)
            score, weight = _pooled(logit, group, len(docs))
            p = _sigmoid(score)
            d_logit = (((p - y[docs])[group] * weight) / len(docs)).astype(np.float32)
            grads = {k: np.zeros_like(v) for k, v in model.items()}
            x_grad = {d: np.zeros((len(used), 3 * HIDDEN), np.float32) for d in "fb"}
            _backward(model, grads, x_grad, local, real, d_logit, trace)
            d_x = np.zeros_like(x)
            for d in "fb":
                grads[f"in_{d}"] += x.T @ x_grad[d]
                grads[f"bias_{d}"] += x_grad[d].sum(axis=0)
                d_x += x_grad[d] @ model[f"in_{d}"].T
            np.add.at(grads["word"], own_slots, d_x[:, :WIDE])
            np.add.at(grads["gram"], grams[own], np.repeat(d_x[:, WIDE:] / np.maximum(sizes, 1)[:, None], sizes, axis=0))
            grads["word"][rare] = 0
            turn += 1
            for k in model:
                m[k] += 0.1 * (grads[k] - m[k])
                v2[k] += 0.001 * (grads[k] ** 2 - v2[k])
                model[k] -= RATE * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v2[k] / (1 - 0.999**turn)) + 1e-8)
    if (y == 1).any() and (y == 0).any():  # the sample holds the classes in other parts than the labels
        model["bias"] += np.log(share[y == 1][0] / share[y == 0][0])
    return model


def _pooled(logit: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A smooth maximum of the logits of each document's windows, and the share each window has in it."""
    top = np.full(n, -1e9)
    np.maximum.at(top, doc, logit)
    weight = np.exp(SHARP * (logit - top[doc]))
    total = np.bincount(doc, weights=weight, minlength=n)
    return top + np.log(total) / SHARP, weight / total[doc]


def _highest(model, encoded, pick, begin, size, group) -> np.ndarray:
    """Of the windows of each document in a batch, the ``KEEP`` with the highest logits."""
    kind, _, slots, grams, bounds = encoded
    logit = np.zeros(len(pick))
    used, local = np.unique(_laid(kind, begin[pick], size[pick], WINDOW)[0], return_inverse=True)
    local = local.reshape(WINDOW, -1)
    if len(slots):
        own = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in used])
        x = inputs(model, slots[used], grams[own], np.concatenate([[0], np.cumsum(bounds[used + 1] - bounds[used])]))
    else:
        x = np.zeros((1, 2 * WIDE), np.float32)
    x_in = {d: x @ model[f"in_{d}"] + model[f"bias_{d}"] for d in "fb"}
    real = np.arange(WINDOW)[:, None] < size[pick]
    for lo in range(0, len(pick), PASS):
        logit[lo : lo + PASS] = _forward(model, x_in, local[:, lo : lo + PASS], real[:, lo : lo + PASS])[0]
    order = np.lexsort((-logit, group))
    place = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    return np.sort(order[place < KEEP])


def probabilities(texts, model: dict[str, np.ndarray]) -> np.ndarray:
    kind, first, slots, grams, bounds = encode(texts)
    doc, begin, size = windows(first)
    x = inputs(model, slots, grams, bounds) if len(slots) else np.zeros((1, 2 * WIDE), np.float32)
    x_in = {d: x @ model[f"in_{d}"] + model[f"bias_{d}"] for d in "fb"}
    logit = np.zeros(len(doc))
    # Windows of equal size share a pass, so short ones take few steps.
    order = np.argsort(size, kind="stable")
    for lo in range(0, len(doc), PASS):
        pick = order[lo : lo + PASS]
        at, real = _laid(kind, begin[pick], size[pick], max(1, int(size[pick].max())))
        logit[pick] = _forward(model, x_in, at, real)[0]
    counts = np.bincount(doc, minlength=len(first) - 1)
    if not model["out"].any():  # nothing was learnt
        return np.full(len(counts), float(_sigmoid(float(model["bias"][0]))))
    return _sigmoid(_pooled(logit, doc, len(counts))[0] - CHANCE * np.log(np.maximum(counts / KEEP, 1)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> dict[str, np.ndarray]:
    """The network fitted on a bounded sample; the only thing that reaches the driver, of fixed size."""

    def run(table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        model = fit(table.column("text"), table.column("y").to_numpy(), table.column("share").to_numpy())
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    rows = sample(docs, labels, label, per_class).groupBy().applyInArrow(run, "model binary").collect()
    return pickle.loads(rows[0][0]) if rows else fit(pa.array([], pa.string()), np.zeros(0), np.zeros(0))


def scored(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id`` and ``toxic_score`` of each row."""

    def run(batches):
        for batch in batches:
            for part in W.slices(pa.Table.from_batches([batch]), "text", 2 << 20):
                p = pa.array(probabilities(part.column("text"), model))
                yield from pa.table({"doc_id": part.column("doc_id"), "toxic_score": p}).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, toxic_score double")
