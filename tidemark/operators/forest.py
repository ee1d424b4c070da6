"""Regression forests of several labels, grown together in a fixed number of jobs.

All trees of all labels are one problem. Nodes with more than ``NODE_ROWS`` rows are split level by
level: each level is a pass over the rows in which tasks add up histograms over (node, input, bin)
before anything is shuffled, and one task per node picks the split from the sums. Smaller nodes
are dealt out, rows and all, to tasks that hold at most about ``GROUP_ROWS`` of them and grow what is
below to full depth, many nodes in one pass. A table of fewer rows than ``NODE_ROWS`` needs one job
whatever the number of labels and trees.

Bootstrap weights are Poisson numbers from a hash of the row, the tree and the seed, so neither the
layout of the table nor a task that runs again changes a tree. Rows with a null input are left out,
and those with a null label for that label only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a node that is grown in one task, rows that a task grows at a time, bins per input, and
#: cells of histograms that a task holds.
NODE_ROWS, GROUP_ROWS, BINS, CELLS = 200_000, 60_000, 256, 4_000_000
PREDICTED = 4_000_000
_POISSON = np.cumsum([np.exp(-1) / f for f in np.cumprod([1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10])])


@dataclass
class Forest:
    """Trees of one label as flat arrays; the right child follows the left one, a leaf has input -1."""

    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    input: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def leaves(self, x: np.ndarray, tree: int | None = None) -> np.ndarray:
        """The leaf of each row, in each tree or in one."""
        roots = self.roots if tree is None else self.roots[tree : tree + 1]
        at = np.repeat(roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        while at.size:
            on = self.input[at]
            inner = on >= 0
            if not inner.any():
                break
            step = self.left[at] + (x[rows, np.maximum(on, 0)] > self.cut[at])
            at = np.where(inner, step, at)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean over the trees; NaN without trees."""
        if not len(self.roots):
            return np.full(len(x), np.nan)
        step = max(1, PREDICTED // len(self.roots))
        parts = [self.value[self.leaves(x[lo : lo + step])].mean(axis=1) for lo in range(0, len(x), step)]
        return np.concatenate(parts) if parts else np.zeros(0)


def weights(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    with np.errstate(over="ignore"):
        x = row.astype(np.uint64) + np.uint64((tree * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) * 2.0**-53, "right").astype(np.float64)


def _splits(x: np.ndarray, y: np.ndarray, w: np.ndarray, node: np.ndarray, n: int):
    """Input and cut of the best split of each of ``n`` nodes, input -1 where there is none.

    The best split lowers the squared error most; of equal ones the first input and the smallest
    cut count. A node whose labels differ is split wherever its inputs differ, even at no gain.
    """
    total = np.bincount(node, w, n)
    y = y - (np.bincount(node, w * y, n) / np.maximum(total, 1e-300))[node]
    best, on, cut = np.full(n, -1.0), np.full(n, -1), np.zeros(n)
    pure = np.zeros(n, bool)
    for f in range(x.shape[1]):
        order = np.lexsort((x[:, f], node))
        k, xs, ws = node[order], x[order, f], w[order]
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        if not f:
            low, high = np.minimum.reduceat(y[order], begin), np.maximum.reduceat(y[order], begin)
            pure[k[begin]] = low == high
        sizes = np.diff(np.append(begin, len(k)))
        weight, sums = np.cumsum(ws), np.cumsum(ws * y[order])
        weight = weight - np.repeat(weight[begin] - ws[begin], sizes)
        sums = sums - np.repeat(sums[begin] - (ws * y[order])[begin], sizes)
        ends = np.concatenate([(k[1:] == k[:-1]) & (xs[1:] > xs[:-1]), [False]])
        rest = np.maximum(total[k] - weight, 1e-300)
        gain = np.where(ends, sums * sums * (1 / weight + 1 / rest), -1.0)
        top = np.maximum.reduceat(gain, begin)
        hit = np.flatnonzero(gain == np.repeat(top, sizes))
        at = hit[np.unique(k[hit], return_index=True)[1]]
        better = top > best[k[begin]]
        at, which = at[better], k[begin][better]
        middle = (xs[at] + xs[np.minimum(at + 1, len(xs) - 1)]) / 2
        best[which], on[which] = gain[at], f
        cut[which] = np.where(middle < xs[np.minimum(at + 1, len(xs) - 1)], middle, xs[at])
    on[pure | (best < 0)] = -1
    return on, cut


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, root: np.ndarray, roots: int, depth: int | None, at_depth: np.ndarray):
    """Trees below ``roots`` roots, all at once: arrays as in ``Forest``, the roots first.

    ``root`` is the root of each row, ``at_depth`` how deep each root lies; ``depth`` bounds the whole.
    """
    mean = lambda k, n: np.bincount(k, w[rows] * y[rows], n) / np.maximum(np.bincount(k, w[rows], n), 1e-300)
    rows = np.arange(len(y))
    out = [(np.full(roots, -1), np.zeros(roots), np.zeros(roots, np.int64), mean(root, roots))]
    base, total, k = 0, roots, root
    deep = at_depth.copy()
    while len(rows):
        if depth is not None:
            k = np.where(deep[k] < depth, k, -1)
            rows, k = rows[k >= 0], k[k >= 0]
            if not len(rows):
                break
        present, node = np.unique(k, return_inverse=True)
        on, cut = _splits(x[rows], y[rows], w[rows], node, len(present))
        split = on >= 0
        child = np.where(split, 2 * (np.cumsum(split) - 1), 0)
        now = out[-1]
        now[0][present], now[1][present] = on, cut
        now[2][present[split]] = total + child[split]
        go = split[node]
        rows, node = rows[go], node[go]
        k = child[node] + (x[rows, on[node]] > cut[node])
        n = 2 * int(split.sum())
        deep = np.repeat(deep[present[split]] + 1, 2)
        base, total = total, total + n
        out.append((np.full(n, -1), np.zeros(n), np.zeros(n, np.int64), mean(k, n) if n else np.zeros(0)))
    return tuple(np.concatenate(parts) for parts in zip(*out))


@dataclass
class _Open:
    """A node that is still to be split: its label, tree, place in the tree's arrays, and depth."""

    label: int
    tree: int
    node: int
    depth: int


def _matrices(batch: pa.RecordBatch, inputs: int):
    columns = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[1:]]
    row = batch.column(0).to_numpy(zero_copy_only=False)
    return row, np.stack(columns[:inputs], axis=1), columns[inputs:]


def _drawn(row, y, tree, seed, bootstrap):
    w = weights(row, tree, seed) if bootstrap else np.ones(len(row))
    return np.where(np.isnan(y), 0.0, w)


def _histograms(partial: dict, slots: dict, inputs: int, edges: list, seed: int, bootstrap: bool):
    """Sums of the rows of each open node by input and bin, added up over all rows of a task."""
    wide = max(len(e) for e in edges) + 1
    names = ["slot", "input", "bin", "w", "wy", "wyy", "low", "high"]

    def run(batches):
        n = len(slots) * inputs * wide
        sums, low, high = np.zeros((3, n)), np.full(n, np.inf), np.full(n, -np.inf)
        trees = {(label, tree) for label, tree, _ in slots}
        for batch in batches:
            row, x, ys = _matrices(batch, inputs)
            bins = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]
            for label, tree in trees:
                y = ys[label]
                w = _drawn(row, y, tree, seed, bootstrap)
                leaf = partial[label, tree].leaves(x)[:, 0]
                number = {node: s for (a, b, node), s in slots.items() if (a, b) == (label, tree)}
                lookup = np.full(len(partial[label, tree].input), -1)
                lookup[list(number)] = list(number.values())
                slot = lookup[leaf]
                take = (w > 0) & (slot >= 0)
                for f in range(inputs):
                    cell = (slot[take] * inputs + f) * wide + bins[f][take]
                    for i, v in enumerate((w[take], w[take] * y[take], w[take] * y[take] ** 2)):
                        sums[i] += np.bincount(cell, v, n)
                    np.minimum.at(low, cell, x[take, f])
                    np.maximum.at(high, cell, x[take, f])
        used = np.flatnonzero(sums[0])
        part, b = np.divmod(used, wide)
        slot, f = np.divmod(part, inputs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (slot, f, b, sums[0, used], sums[1, used], sums[2, used], low[used], high[used])], names
        )

    return run


def _best_of(table: pa.Table) -> pa.Table:
    """The best split of one node from its histogram; input -1 where it has none."""
    c = {n: table.column(n).to_numpy() for n in table.column_names}
    order = np.lexsort((c["bin"], c["input"]))
    c = {n: v[order] for n, v in c.items()}
    first = c["input"] == c["input"][0]
    w, wy, wyy = (c[n][first].sum() for n in ("w", "wy", "wyy"))
    best = (-1.0, -1, 0.0, 0.0)
    for f in np.unique(c["input"]) if wyy * w - wy * wy > 1e-12 * wyy * w else ():
        here = c["input"] == f
        left, sums = np.cumsum(c["w"][here])[:-1], np.cumsum(c["wy"][here] - c["w"][here] * (wy / w))[:-1]
        if not len(left):
            continue
        gain = sums**2 * (1 / left + 1 / (w - left))
        at = int(np.argmax(gain))
        lo, hi = c["high"][here][at], c["low"][here][at + 1]
        if gain[at] > best[0]:
            best = (float(gain[at]), int(f), float((lo + hi) / 2 if (lo + hi) / 2 < hi else lo), float(left[at]))
    return pa.table({"slot": [int(c["slot"][0])], "input": [best[1]], "cut": [best[2]], "left": [best[3]], "w": [float(w)], "mean": [float(wy / w)]})


def _split_large(rows: DataFrame, partial: dict, open_: list[_Open], inputs: int, depth: int | None, seed: int, bootstrap: bool) -> list[tuple[_Open, float]]:
    """Split nodes of more than ``NODE_ROWS`` rows, a level at a time; the open ones that are left, with their rows."""
    names = rows.columns[1 : 1 + inputs]
    at = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(c, at, 10 * BINS).alias(c) for c in names]).first()
    edges = [np.unique(np.array(found[c] or [], np.float64)) for c in names]
    wide = max(len(e) for e in edges) + 1
    small: list[tuple[_Open, float]] = []
    while open_:
        later: list[_Open] = []
        step = max(1, CELLS // (inputs * wide))
        for lo in range(0, len(open_), step):
            some = open_[lo : lo + step]
            slots = {(o.label, o.tree, o.node): i for i, o in enumerate(some)}
            sums = rows.mapInArrow(
                _histograms(partial, slots, inputs, edges, seed, bootstrap),
                "slot long, input long, bin long, w double, wy double, wyy double, low double, high double",
            ).groupBy("slot", "input", "bin")
            sums = sums.agg(*[F.sum(c).alias(c) for c in ("w", "wy", "wyy")], F.min("low").alias("low"), F.max("high").alias("high"))
            splits = sums.groupBy("slot").applyInArrow(_best_of, "slot long, input long, cut double, left double, w double, mean double")
            for r in splits.collect():
                o = some[r["slot"]]
                tree = partial[o.label, o.tree]
                tree.value[o.node] = r["mean"]
                if r["w"] <= NODE_ROWS:
                    small.append((o, r["w"]))
                elif r["input"] >= 0 and (depth is None or o.depth < depth):
                    n = len(tree.input)
                    tree.input[o.node], tree.cut[o.node], tree.left[o.node] = r["input"], r["cut"], n
                    tree.input = np.append(tree.input, [-1, -1])
                    tree.cut, tree.left = np.append(tree.cut, [0.0, 0.0]), np.append(tree.left, [0, 0])
                    tree.value = np.append(tree.value, [r["mean"]] * 2)
                    for child, w in ((n, r["left"]), (n + 1, r["w"] - r["left"])):
                        new = _Open(o.label, o.tree, child, o.depth + 1)
                        small.append((new, w)) if w <= NODE_ROWS else later.append(new)
        open_ = later
    return small


def _dealt(partial: dict, parts: dict, inputs: int, seed: int, bootstrap: bool):
    """Each row once for every tree that draws it, with the part that its node is grown in."""

    def run(batches):
        for batch in batches:
            row, x, ys = _matrices(batch, inputs)
            for (label, tree), forest in partial.items():
                w = _drawn(row, ys[label], tree, seed, bootstrap)
                leaf = forest.leaves(x)[:, 0]
                part = parts[label, tree][leaf]
                take = (w > 0) & (part >= 0)
                n = int(take.sum())
                if n:
                    same = lambda v: pa.array(np.full(n, v, np.int32))
                    columns = [pa.array(part[take].astype(np.int32)), same(label), same(tree), pa.array(leaf[take].astype(np.int32)), pa.array(row[take])]
                    columns += [pa.array(v[take]) for v in (w, ys[label], *x.T)]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "label", "tree", "node", "row", "w", "y", *[f"x{f}" for f in range(inputs)]])

    return run


#: A grown tree on its way to the driver.
_PACKED = {"on": "<i4", "cut": "<f8", "left": "<i4", "value": "<f8"}


def _grown(inputs: int, depth: int | None, depths: dict):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("label", "tree", "node", "row", "y")])
        c = {n: table.column(n).to_numpy() for n in table.column_names}
        keys = np.stack([c["label"], c["tree"], c["node"]], axis=1)
        keys, root = np.unique(keys, axis=0, return_inverse=True)
        x = np.stack([c[f"x{f}"] for f in range(inputs)], axis=1)
        deep = np.array([depths.get(tuple(int(v) for v in k), 0) for k in keys])
        on, cut, left, value = grow(x, c["y"], c["w"], root.ravel(), len(keys), depth, deep)
        # Nodes of one root, in the order they were made.
        owner = np.full(len(on), -1)
        owner[: len(keys)] = np.arange(len(keys))
        while (owner < 0).any():  # a level at a time
            inner = np.flatnonzero((owner >= 0) & (on >= 0))
            owner[left[inner]] = owner[left[inner] + 1] = owner[inner]
        order = np.argsort(owner, kind="stable")
        place = np.empty(len(on), np.int64)
        counts = np.bincount(owner, minlength=len(keys))
        place[order] = np.arange(len(on)) - np.repeat(np.cumsum(counts) - counts, counts)
        ends = np.cumsum(counts)[:-1]
        packed = zip((on, cut, place[left], value), _PACKED.values())
        lists = [pa.array([v.tobytes() for v in np.split(a[order].astype(t), ends)], pa.binary()) for a, t in packed]
        return pa.table([pa.array(k, pa.int32()) for k in keys.T] + lists, ["label", "tree", "node", "on", "cut", "left", "value"])

    return run


def _grafted(forest: Forest, node: int, on, cut, left, value) -> None:
    """Put a grown tree in the place of a leaf."""
    base = len(forest.input) - 1  # its node 0 is the leaf itself
    moved = np.where(on >= 0, left + base, 0)
    forest.input[node], forest.cut[node], forest.left[node], forest.value[node] = on[0], cut[0], moved[0], value[0]
    forest.input, forest.cut = np.append(forest.input, on[1:]), np.append(forest.cut, cut[1:])
    forest.left, forest.value = np.append(forest.left, moved[1:]), np.append(forest.value, value[1:])


def fit_forests(
    train: DataFrame, inputs: list[str], labels: list[str], trees: int, depth: int | None = None, seed: int = 42, bootstrap: bool = True
) -> dict[str, Forest]:
    """One forest for each label. All inputs are tried at every split; ``depth`` None grows until
    no split is left. The forests are what reaches the driver: a few numbers for each leaf.

    ``train`` is a written table, as it is read several times. Rows that are equal in all columns
    are drawn alike.
    """
    quoted = lambda cs, p: [F.col(f"`{c}`").cast("double").alias(f"{p}{i}") for i, c in enumerate(cs)]
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(train.columns)])
    rows = train.select(row.alias("row"), *quoted(inputs, "x"), *quoted(labels, "y"))
    rows = rows.na.drop(subset=[f"x{i}" for i in range(len(inputs))])
    n, k = rows.count(), len(inputs)
    one = lambda: Forest(np.zeros(1, np.int64), np.full(1, -1), np.zeros(1), np.zeros(1, np.int64), np.zeros(1))
    partial = {(i, t): one() for i in range(len(labels)) for t in range(trees)}
    open_ = [_Open(i, t, 0, 0) for i, t in partial]
    if n > NODE_ROWS:
        small = _split_large(rows, partial, open_, k, depth, seed, bootstrap)
    else:
        small = [(o, float(n)) for o in open_] if n else []
    if not small:
        return {c: Forest() for c in labels} if not n else _joined(partial, labels, trees, set(partial))
    # Nodes are put into parts of a bounded number of rows, at least one for each core.
    size = min(float(GROUP_ROWS), sum(w for _, w in small) / rows.sparkSession.sparkContext.defaultParallelism)
    parts = {key: np.full(len(f.input), -1) for key, f in partial.items()}
    part, held, depths = 0, 0.0, {}
    for o, w in small:
        if held and held + w > size:
            part, held = part + 1, 0.0
        parts[o.label, o.tree][o.node] = part
        depths[o.label, o.tree, o.node] = o.depth
        held += w
    deal = ", ".join(["part int, label int, tree int, node int, row long, w double, y double", *[f"x{f} double" for f in range(k)]])
    grown = "label int, tree int, node int, on binary, cut binary, left binary, value binary"
    groups = rows.mapInArrow(_dealt(partial, parts, k, seed, bootstrap), deal).groupBy("part")
    known = set(partial) - {(o.label, o.tree) for o, _ in small if o.node == 0}
    for r in groups.applyInArrow(_grown(k, depth, depths), grown).toArrow().to_pylist():
        known.add((r["label"], r["tree"]))
        arrays = [np.frombuffer(r[c], t) for c, t in _PACKED.items()]
        _grafted(partial[r["label"], r["tree"]], r["node"], *arrays)
    return _joined(partial, labels, trees, known)


def _joined(partial: dict, labels: list[str], trees: int, known: set) -> dict[str, Forest]:
    """The trees of each label that any row was drawn for, as one forest."""
    out = {}
    for i, label in enumerate(labels):
        some = [partial[i, t] for t in range(trees) if (i, t) in known]
        if not some:
            out[label] = Forest()
            continue
        begin = np.concatenate([[0], np.cumsum([len(f.input) for f in some])])
        left = [np.where(f.input >= 0, f.left + b, 0) for f, b in zip(some, begin)]
        out[label] = Forest(
            begin[:-1], np.concatenate([f.input for f in some]), np.concatenate([f.cut for f in some]),
            np.concatenate(left), np.concatenate([f.value for f in some]),
        )
    return out


def predict_forests(models: dict[str, Forest], df: DataFrame, inputs: list[str], names: dict[str, str]) -> DataFrame:
    """Add the prediction of each forest as the column ``names`` gives for its label, from one pass;
    null where an input is missing or the forest has no trees."""
    order = list(models)
    kind = T.StructType([T.StructField(f"p{i}", T.DoubleType()) for i in range(len(order))])

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.DataFrame:
        x = np.stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns], axis=1)
        known = ~np.isnan(x).any(axis=1)
        kinds, at = np.unique(x[known], axis=0, return_inverse=True)
        out = {}
        for i, label in enumerate(order):
            values = np.full(len(x), np.nan)
            values[known] = models[label].predict(kinds)[at.ravel()]
            out[f"p{i}"] = pd.Series(values).astype("Float64").mask(np.isnan(values))
        return pd.DataFrame(out)

    scored = df.withColumn("pred__v", run.asNondeterministic()(*[F.col(f"`{c}`").cast("double") for c in inputs]))
    added = {names[label]: F.col(f"pred__v.p{i}") for i, label in enumerate(order)}
    return scored.withColumns(added).drop("pred__v")
