"""Boosted trees by histograms: any number of models in one pass over the rows.

Features are put into bins once and written beside the target, a row key and the models that each row trains. A
level of a tree is one pass: every task adds up gradients by (model, node, feature, bin) over its rows and these sums meet on
the executors; the driver picks splits from that table, whose size does not depend on the rows. All
pools, folds and feature sets share the pass. A row's scores follow from the trees, so no state is kept between passes; every
``REFRESH`` trees the scores reached so far are written with the rows.

That takes a job for every level, so it is the last resort. Models that are all small (``whole`` rows at most) are grown by the same steps inside one
task each, all at the same time. For larger ones the rows are dealt once to the tasks of a barrier stage: each keeps its rows, their places
and scores, and after every level the tasks add up their sums through files of the shared folder; all of them pick the same splits. The
trees are the same up to the order of sums.
"""

from __future__ import annotations

import io
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.operators.tally import added, in_order
from courtside.session import cut, forget, local_path, remove, scratch_path, shared_dir, slots

BINS = 64              # a missing value has the first one
REFRESH = 8            # trees after which the scores are written anew
TASK_ROWS = 20_000     # (row, model) pairs for which a task of its own pays
WHOLE = 250_000        # rows of a model from which several tasks share them
TEAM = 64              # tasks that grow models together
HELD = 200 << 20       # bytes of rows and scores in a task's memory
BLOCK = 1 << 18        # rows of a block
STEP = 1 << 14         # rows whose places stay in a processor's cache
JOINT = 1 << 12        # joint bins of features that are added up at once
FEW = 200              # rows of a model in a batch from which whole columns are compared rather than each row led down


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    depth: int = 4
    rate: float = 0.05
    penalty: float = 1.0          # added to the sum of second derivatives
    least_rows: int = 1           # rows on either side of a split
    row_share: float = 1.0        # of the rows and of the columns that a tree may use
    column_share: float = 1.0
    seed: int = 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _slopes(objective: str, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the scores, for each output."""
    if objective == "squared":
        return score - y[:, None], np.ones_like(score)
    if objective == "logistic":
        p = _sigmoid(score)
        return p - y[:, None], np.maximum(p * (1 - p), 1e-16)
    p = _softmax(score)
    return p - (y[:, None] == np.arange(score.shape[1])), np.maximum(p * (1 - p), 1e-16)


def _mixed(key: np.ndarray, number: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from row keys and a tree's number."""
    x = key.view(np.uint64) ^ np.uint64((number * 0x9E3779B97F4A7C15) % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53


def bin_edges(rows: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of the bins: the distinct values where these are few, else quantiles; never more than ``bins`` - 2.

    Nothing depends on how the rows are dealt, so the same rows give the same edges. ``rows`` is read several times.
    """
    value = {c: F.col(f"`{c}`").cast("double") for c in columns}
    value = {c: F.when(~F.isnan(v), v) for c, v in value.items()}
    found = rows.agg(*[F.approx_count_distinct(v).alias(f"n{i}") for i, v in enumerate(value.values())]).first()
    few = [i for i in range(len(columns)) if found[f"n{i}"] <= (bins - 2) * 0.8]
    values: dict[int, list[float]] = {i: [] for i in few}
    if few:
        stacked = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), value[columns[i]].alias("v")) for i in few])))
        for r in stacked.where("v IS NOT NULL").distinct().collect():
            values[r.i].append(r.v)
    many = [i for i in range(len(columns)) if i not in values or len(set(values[i])) > bins - 1]
    cuts = dict(zip(many, _quantiles(rows, [columns[i] for i in many], bins))) if many else {}
    return [cuts[i] if i in cuts else np.array(sorted(set(values[i]))[:-1]) for i in range(len(columns))]


def _quantiles(rows: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """``bins`` - 2 quantiles of each column: a pass counts values by their first 16 bits, a second one those of the cells with a
    wanted rank by up to 10 more. An edge is the upper end of its cell."""
    each = rows.select(*[F.col(f"`{c}`").cast("double") for c in columns])

    def counted(width: int, cell: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(columns), width))
            for batch in batches:
                for i, column in enumerate(batch.columns):
                    v = np.asarray(column.to_numpy(zero_copy_only=False), float)
                    total[i] += np.bincount(cell(i, in_order(v[~np.isnan(v)])), minlength=width)
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})
        return added(each, run, len(columns) * width).reshape(len(columns), width)

    def at(counts: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells that hold the ranks (from 1), and the ranks within them."""
        upto = np.cumsum(counts)
        cell = np.searchsorted(upto, ranks, "left")
        return cell, ranks - (upto - counts)[cell]

    first = counted(1 << 16, lambda i, key: (key >> 48) + 32768)
    wanted = []
    for counts in first:
        n = counts.sum()
        wanted.append(at(counts, np.ceil(np.arange(1, bins - 1) * n / (bins - 1)).clip(1)) if n else (np.zeros(0, np.int64), np.zeros(0)))
    cells = [np.unique(cell) for cell, _ in wanted]
    slots = max(map(len, cells))
    if not slots:
        return [np.zeros(0) for _ in columns]
    more = max(1, min(10, 17 - slots.bit_length()))
    slot = np.full((len(columns), 1 << 16), -1)
    for i, mine in enumerate(cells):
        slot[i, mine] = np.arange(len(mine))

    def finer(i: int, key: np.ndarray) -> np.ndarray:
        place = slot[i, (key >> 48) + 32768]
        return ((place << more) + ((key >> (48 - more)) & ((1 << more) - 1)))[place >= 0]

    second = counted(slots << more, finer)
    out = []
    for i, (cell, rank) in enumerate(wanted):
        ends = []
        for c, r in zip(cell, rank):
            s = int(slot[i, c]) << more
            sub, _ = at(second[i, s:s + (1 << more)], r)
            ends.append(((int(c) - 32768) << 48) + ((int(sub) + 1) << (48 - more)) - 1)
        key = np.array(ends, np.int64)
        end = (key ^ ((key >> 63) & np.int64(2 ** 63 - 1))).view(np.float64)
        out.append(np.unique(np.where(np.isnan(end), np.inf, end)))
    return out


def _bin_type(edges: list[np.ndarray]) -> type:
    return np.uint8 if max(map(len, edges), default=0) < 255 else np.uint16


def _binned(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(columns[0]) if columns else 0, len(edges)), _bin_type(edges))
    for i, (x, cuts) in enumerate(zip(columns, edges)):
        known = ~np.isnan(x)
        out[known, i] = 1 + np.searchsorted(cuts, x[known], "left")
    return out


def _walk(x: np.ndarray, model: np.ndarray, feature: np.ndarray, bound: np.ndarray, depth: int) -> np.ndarray:
    """Number within the level reached after ``depth`` steps, for row bins x and each row's model."""
    node = np.zeros(len(model), np.int64)
    own, row, bins = model * feature.shape[1], np.arange(len(model)) * x.shape[1], np.ascontiguousarray(x).ravel()
    feature, bound = np.ascontiguousarray(feature).ravel(), np.ascontiguousarray(bound).ravel()
    for _ in range(depth):
        at = own + node
        right = bins.take(row + feature.take(at)) > bound.take(at)
        node = 2 * node + 1 + right
    return node - (2 ** depth - 1)


def _leaf(x: np.ndarray, feature: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Number of the leaf that one tree leads each row to, for bins x[feature, row]: every node compares its whole column."""
    depth = (len(feature) + 1).bit_length() - 1
    out = np.zeros(x.shape[1], np.uint8 if depth <= 8 else np.int64)
    bounds = bound.astype(x.dtype)
    for first in range(0, x.shape[1], STEP):
        part = x[:, first:first + STEP]
        leaf = out[first:first + STEP]
        masks = [np.ones(len(leaf), bool)]
        for level in range(depth):
            below, goes = [], np.zeros(len(leaf), bool)
            for at, mask in enumerate(masks, 2 ** level - 1):
                right = part[feature[at]] > bounds[at]
                right &= mask
                goes |= right
                if level < depth - 1:
                    below += [mask > right, right]
            leaf *= 2
            leaf += goes
            masks = below
    return out


@dataclass
class Boosted:
    """Fitted models over the same columns. Trees are arrays [tree, model, output, node] in heap order."""

    objective: str
    columns: list[str]
    edges: list[np.ndarray]
    start: np.ndarray                                   # [model, output]
    feature: list[np.ndarray] = field(default_factory=list)
    bound: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    gain: np.ndarray | None = None                      # [model, feature], summed over the splits

    def raw(self, x: np.ndarray, model: np.ndarray, first: int = 0, score: np.ndarray | None = None) -> np.ndarray:
        score = self.start[model].copy() if score is None else score.copy()
        trees = list(zip(self.feature[first:], self.bound[first:], self.value[first:]))
        numbers, group = np.unique(model, return_inverse=True)
        if len(model) < FEW * len(numbers):
            for feature, bound, value in trees:
                depth = (feature.shape[2] + 1).bit_length() - 1
                for k in range(score.shape[1]):
                    score[:, k] += value[model, k, _walk(x, model, feature[:, k], bound[:, k], depth)]
            return score
        for i, m in enumerate(numbers):
            rows = np.flatnonzero(group == i)
            mine, own = np.ascontiguousarray(x[rows].T), np.ascontiguousarray(score[rows].T)
            for feature, bound, value in trees:
                for k in range(len(own)):
                    own[k] += value[m, k].take(_leaf(mine, feature[m, k], bound[m, k]))
            score[rows] = own.T
        return score

    def transform(self, df: DataFrame, out: str, model: Column | int = 0) -> DataFrame:
        """Add an array of what the objective predicts (chances or a value) by each row's ``model``; null where that is null."""
        me = df.sparkSession.sparkContext.broadcast(self)  # rounds x models x nodes numbers

        def work(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            fitted = me.value
            for numbers, *features in batches:
                known = ~np.asarray(numbers.is_null())
                x = _binned([np.asarray(f.to_numpy(zero_copy_only=False), float)[known] for f in features], fitted.edges)
                found = fitted.raw(x, numbers.drop_null().to_numpy().astype(np.int64))
                if fitted.objective == "logistic":
                    found = _sigmoid(found)
                elif fitted.objective == "softmax":
                    found = _softmax(found)
                ends = np.concatenate([[0], np.cumsum(known * found.shape[1])]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()), mask=pa.array(~known))

        number = F.lit(model) if isinstance(model, int) else model
        features = [F.col(f"`{c}`").cast("double") for c in self.columns]
        return df.withColumn(out, F.arrow_udf(work, "array<double>")(number.cast("int"), *features))

    def save(self, spark: SparkSession, path: str) -> None:
        """One row: the arrays as one binary value, the column names beside it."""
        raw = io.BytesIO()
        np.savez(raw, start=self.start, gain=self.gain, **{f"edges{i}": e for i, e in enumerate(self.edges)},
                 **{f"{n}{t}": a for n in ("feature", "bound", "value") for t, a in enumerate(getattr(self, n))})
        spark.createDataFrame([(self.objective, self.columns, len(self.value), bytearray(raw.getvalue()))],
                              "objective string, columns array<string>, trees int, arrays binary").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        row = spark.read.parquet(path).first()
        got = np.load(io.BytesIO(bytes(row["arrays"])))
        trees = {n: [got[f"{n}{t}"] for t in range(row["trees"])] for n in ("feature", "bound", "value")}
        return cls(row["objective"], list(row["columns"]), [got[f"edges{i}"] for i in range(len(row["columns"]))],
                   got["start"], **trees, gain=got["gain"])


class _Rows:
    """The written training rows and the passes over them."""

    def __init__(self, frame: DataFrame, models: int, outputs: int, objective: str, kind: type = np.uint8):
        self.frame, self.models, self.outputs, self.objective, self.kind = frame, models, outputs, objective, kind
        self.tasks = frame.rdd.getNumPartitions()
        self.done = 0                 # trees in the written scores

    def refresh(self, me: Boosted) -> None:
        """Write the scores that all trees so far give."""
        fresh = cut(_scored(self.frame, me, self.done, self.outputs))
        forget(self.frame)
        self.frame, self.done = fresh, len(me.value)

    def level(self, me: Boosted, feature: np.ndarray, bound: np.ndarray, level: int, s: Settings, bins: int, usable: np.ndarray) -> np.ndarray:
        """Sums [3, model, output, node, feature, bin] for the next level of the tree being grown; those of features that no model may use are 0."""
        if level == 0 and len(me.value) - self.done >= REFRESH:
            self.refresh(me)
        d, tree, columns, outputs = self.done, len(me.value), len(me.columns), self.outputs
        wanted = np.flatnonzero(usable.any(axis=0))
        # sent with each pass: only the trees since the scores were written
        recent = Boosted(me.objective, me.columns, [], me.start, me.feature[d:], me.bound[d:], me.value[d:])

        def work(total: np.ndarray, part: dict) -> None:
            chosen = _drawn(part["key"], tree, s)
            part = {k: None if v is None else v[chosen] for k, v in part.items()}
            part["score"] = recent.raw(part["x"], part["model"], 0, part["score"])
            slope, bend = _weighted_slopes(me.objective, part)
            by_feature = np.ascontiguousarray(part["x"].T)
            for k in range(outputs):
                node = _walk(part["x"], part["model"], feature[:, k], bound[:, k], level)
                _add(total.reshape(shape)[:, :, k], by_feature, part["model"] * 2 ** level + node, slope[:, k], bend[:, k], wanted)

        shape = (3, self.models, outputs, 2 ** level, columns, bins)
        return self.summed(int(np.prod(shape)), work).reshape(shape)

    def summed(self, width: int, work: Callable[[np.ndarray, dict], None]) -> np.ndarray:
        """``work(total, batch)`` over all batches of (row, model) pairs, added up over tasks: in groups first if there are many."""
        return added(self.frame, _tally(width, work, self.outputs, self.kind), width, self.tasks)


def _pairs(batch: pa.RecordBatch, outputs: int, kind: type = np.uint8) -> dict:
    """The batch's rows once for every model that they train."""
    column = dict(zip(batch.schema.names, batch.columns))
    n = batch.num_rows
    raw = column["x"].cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + n + 1]
    x = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(kind).reshape(n, -1)
    trains = column["trains"]
    each = np.asarray(trains.value_lengths())
    flat = trains.flatten()
    row = np.repeat(np.arange(n), each)
    score = None
    if "score" in column:
        score = column["score"].flatten().to_numpy().reshape(-1, outputs)
    return {"x": x[row], "y": column["y"].to_numpy()[row], "key": column["key"].to_numpy()[row],
            "model": flat.field("m").to_numpy().astype(np.int64), "weight": flat.field("w").to_numpy(), "score": score}


def _tally(width: int, work: Callable[[np.ndarray, dict], None], outputs: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                work(total, _pairs(batch, outputs, kind))
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})
    return run


class _Arrays:
    """Named arrays of a block: in memory or, given a folder, in its files."""

    def __init__(self, folder: str | None = None):
        self.folder, self.held = folder and tempfile.mkdtemp(dir=folder), {}

    def __setitem__(self, name: str, a: np.ndarray) -> None:
        if self.folder is None:
            self.held[name] = a
            return
        np.ascontiguousarray(a).tofile(f"{self.folder}/{name}")
        self.held[name] = (a.dtype, a.shape)

    def __getitem__(self, name: str) -> np.ndarray:
        if self.folder is None:
            return self.held[name]
        kind, shape = self.held[name]
        return np.fromfile(f"{self.folder}/{name}", kind).reshape(shape)


class _Block:
    """Rows that train the same models: bins by feature, targets, keys and, where they are not all 1, weights [model, row]."""

    def __init__(self, x: np.ndarray, y: np.ndarray, key: np.ndarray, weight: np.ndarray | None, folder: str | None = None):
        self.folder, self.rows, self.arrays = folder, len(y), _Arrays(folder)
        self.sizes = x.max(axis=1, initial=0).astype(np.int64) + 1
        for name, a in (("x", x), ("y", y), ("key", key), ("weight", weight)):
            if a is not None:
                self.arrays[name] = a
        self.joint: dict[bytes, tuple] = {}

    def packs(self, x: np.ndarray, wanted: np.ndarray, tree: int) -> list[tuple[list[int], tuple[int, ...], np.ndarray]]:
        """Groups of the wanted features, their bins, and the joint bin of each row: few joint bins beside the rows are added up at once."""
        name = wanted.tobytes()
        found = self.joint.get(name)
        if found is None:
            # only what this tree's models may use; the same columns for every tree if it may use all
            self.joint = {n: kept for n, kept in self.joint.items() if kept[0] == tree and self.folder is None}
            found = (tree, self._packs(x, wanted))
        self.joint[name] = (tree, found[1])
        return found[1]

    def _packs(self, x: np.ndarray, wanted: np.ndarray) -> list[tuple[list[int], tuple[int, ...], np.ndarray]]:
        most = min(JOINT, self.rows // 32)
        groups: list[list[int]] = []
        for f in sorted(wanted.tolist(), key=lambda f: -self.sizes[f]):
            room = [g for g in groups if self.sizes[g].prod() * self.sizes[f] <= most]
            if room:
                max(room, key=lambda g: self.sizes[g].prod()).append(f)
            else:
                groups.append([f])
        packs = []
        for group in groups:
            code = x[group[0]].astype(np.uint16)
            for f in group[1:]:
                code *= np.uint16(self.sizes[f])
                code += x[f]
            packs.append((group, tuple(self.sizes[group].tolist()), code))
        return packs


class _Held:
    """One model's share of a block, with the same interface. Every row keeps its place in the tree being grown."""

    def __init__(self, part: dict, outputs: int, block: _Block | None = None, place: int = 0, number: int = 0):
        """``part`` are rows of one model; or its score at the start, beside a block in which it is the model at ``place``. ``number`` tells it among the models grown together."""
        self.outputs, self.number, self.place = outputs, number, place
        if block is None:
            block = _Block(np.ascontiguousarray(part["x"].T), part["y"], part["key"], part["weight"][None])
            score = part["score"].T
        else:
            score = np.repeat(part["score"][:, None], block.rows, axis=1)
        self.block, self.own = block, _Arrays(block.folder)
        self.own["score"] = np.array(score, float)

    node, slope, bend, chosen = (property(lambda self, name=name: self.own[name]) for name in ("node", "slope", "bend", "chosen"))

    def _down(self, x: np.ndarray, node: np.ndarray, feature: np.ndarray, bound: np.ndarray, level: int) -> None:
        """All rows go on from this level to the next one; every node compares its whole column."""
        bound = bound.astype(x.dtype)
        for k in range(self.outputs):
            goes = np.zeros(x.shape[1], bool)
            for at in range(2 ** level - 1, 2 ** (level + 1) - 1):
                right = x[feature[k, at]] > bound[k, at]
                right &= node[k] == at
                goes |= right
            node[k] *= 2
            node[k] += 1
            node[k] += goes

    def level(self, me: Boosted, feature: np.ndarray, bound: np.ndarray, level: int, s: Settings, bins: int, usable: np.ndarray) -> np.ndarray:
        number, own, block = self.number, self.own, self.block
        x, wanted = block.arrays["x"], np.flatnonzero(usable[number])
        packs = block.packs(x, wanted, len(me.value))
        if level == 0:
            score = own["score"]
            if me.value:
                last, node = me.value[-1][number], own["node"]
                self._down(x, node, me.feature[-1][number], me.bound[-1][number], s.depth - 1)
                for k in range(self.outputs):
                    score[k] += last[k].take(node[k] - (last.shape[1] - 1))
                own["score"] = score
            node = np.zeros((self.outputs, x.shape[1]), np.uint8 if s.depth < 8 else np.int64)
            chosen = _drawn(block.arrays["key"], len(me.value), s)
            weight = block.arrays["weight"][self.place] if "weight" in block.arrays.held else None
            slope, bend = _weighted_slopes(me.objective, {"score": score.T, "y": block.arrays["y"], "weight": weight})
            slope, bend = np.ascontiguousarray(slope.T), np.ascontiguousarray(bend.T)
            own["chosen"], own["slope"], own["bend"] = chosen, slope, bend
        else:
            node, chosen, slope, bend = own["node"], own["chosen"], own["slope"], own["bend"]
            self._down(x, node, feature[number], bound[number], level - 1)
        own["node"] = node
        total = np.zeros((3, 1, self.outputs, 2 ** level, len(me.columns), bins))
        for k in range(self.outputs):
            mine = [chosen if level == 0 else (node[k] == at) & chosen for at in range(2 ** level - 1, 2 ** (level + 1) - 1)]
            sizes = np.array([np.count_nonzero(m) for m in mine])
            # of two siblings the smaller one is added up, the other is what remains of the parent
            less = np.ones(1, bool) if level == 0 else np.zeros(len(mine), bool)
            if level:
                less[2 * np.arange(len(mine) // 2) + sizes.reshape(-1, 2).argmin(axis=1)] = True
            rows = np.concatenate([np.flatnonzero(mine[i]) for i in np.flatnonzero(less)])
            at = np.repeat(np.flatnonzero(less), sizes[less])
            _add(total[:, :, k], x, at, slope[k], bend[k], wanted, rows, packs)
            if level:
                pairs, less = total[:, 0, k].reshape(3, -1, 2, len(me.columns), bins), less.reshape(-1, 2)
                rest = self.total[:, 0, k] - pairs.sum(axis=2)
                rest[:2, rest[2] == 0] = 0.0     # no rows, no sums
                pairs[:] = np.where(less[None, :, :, None, None], pairs, rest[:, :, None])
        self.total = total
        return total


class _Share:
    """The blocks of several models in one task, with the same interface; ``met`` adds up what all tasks with such blocks give."""

    def __init__(self, helds: list[_Held], models: int, outputs: int, met: Callable[[np.ndarray], np.ndarray]):
        self.helds, self.models, self.outputs, self.met = helds, models, outputs, met

    def level(self, me: Boosted, feature: np.ndarray, bound: np.ndarray, level: int, s: Settings, bins: int, usable: np.ndarray) -> np.ndarray:
        total = np.zeros((3, self.models, self.outputs, 2 ** level, len(me.columns), bins))
        for held in self.helds:
            total[:, held.number:held.number + 1] += held.level(me, feature, bound, level, s, bins, usable)
        return self.met(total)


class _Meeting:
    """Sums of arrays over the tasks of a barrier stage, through files of a folder that all of them reach. Every task gets the same sums."""

    def __init__(self, folder: str, mine: int, tasks: int):
        self.folder, self.mine, self.tasks, self.step = folder, mine, tasks, 0
        os.makedirs(folder, exist_ok=True)

    def __call__(self, a: np.ndarray) -> np.ndarray:
        self.step += 1
        name = f"{self.folder}/{self.step}-{self.mine}"
        np.ascontiguousarray(a).tofile(name + "-")
        os.replace(name + "-", name)
        total = np.zeros_like(a)
        for task in range(self.tasks):
            wait, path = 2e-4, f"{self.folder}/{self.step}-{task}"
            while task != self.mine and not os.path.exists(path):
                time.sleep(wait)     # a task that ends by an error ends the whole stage
                wait = min(2 * wait, 0.01)
            total += a if task == self.mine else np.fromfile(path).reshape(a.shape)
        if self.step > 1:            # all tasks have written this step, so they have read the one before
            os.remove(f"{self.folder}/{self.step - 1}-{self.mine}")
        return total


def _drawn(key: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    return np.ones(len(key), bool) if s.row_share >= 1 else _mixed(key, s.seed * 100_003 + tree) < s.row_share


def _weighted_slopes(objective: str, part: dict) -> tuple[np.ndarray, np.ndarray]:
    slope, bend = _slopes(objective, part["score"], part["y"])
    weight = part["weight"]
    return (slope, bend) if weight is None else (slope * weight[:, None], bend * weight[:, None])


def _add(total: np.ndarray, x: np.ndarray, node: np.ndarray, slope: np.ndarray, bend: np.ndarray, wanted: np.ndarray,
         rows: np.ndarray | None = None, packs: list | None = None) -> None:
    """Adds gradients, second derivatives and rows to total[3, model, node, feature, bin], for bins x[feature, row] and each row's model and node.

    Of the features only the ``wanted`` ones. With ``packs`` only ``rows``, one model's, whose nodes (in ascending order) ``node`` has.
    """
    flat = bool((bend == 1.0).all())   # then the second derivatives add up to the rows
    if packs is not None:
        ends = np.searchsorted(node, np.arange(total.shape[2] + 1))
        for at in np.flatnonzero(np.diff(ends)):
            _add_joint(total[:, 0, at], packs, rows[ends[at]:ends[at + 1]], slope, bend, flat)
        return
    _, models, nodes, columns, bins = total.shape
    width = models * nodes * bins
    sums = np.zeros((3, columns, width))
    step = max(STEP, 4 * width)
    for at in range(0, len(node), step):
        first = node[at:at + step] * bins
        g, h = slope[at:at + step], bend[at:at + step]
        for f in wanted:
            place = first + x[f, at:at + step]
            sums[0, f] += np.bincount(place, g, width)
            if not flat:
                sums[1, f] += np.bincount(place, h, width)
            sums[2, f] += np.bincount(place, minlength=width)
    if flat:
        sums[1] = sums[2]
    total += sums.reshape(3, columns, models, nodes, bins).transpose(0, 2, 3, 1, 4)


def _add_joint(total: np.ndarray, packs: list, rows: np.ndarray, slope: np.ndarray, bend: np.ndarray, flat: bool) -> None:
    """The same for one node, total[3, feature, bin]: features are added up by their joint bins, whose sums give each feature's own."""
    tables = [np.zeros((3, int(np.prod(sizes)))) for _, sizes, _ in packs]
    every = len(rows) == len(slope)
    for first in range(0, len(rows), 2 * STEP):
        some = slice(first, first + 2 * STEP) if every else rows[first:first + 2 * STEP]
        g, h = slope[some], None if flat else bend[some]
        for (_, _, code), table in zip(packs, tables):
            place, width = (code[some] if every else code.take(some)).astype(np.intp), table.shape[1]
            table[0] += np.bincount(place, g, width)
            if not flat:
                table[1] += np.bincount(place, h, width)
            table[2] += np.bincount(place, minlength=width)
    for (group, sizes, _), table in zip(packs, tables):
        if flat:
            table[1] = table[2]
        joint = table.reshape(3, *sizes)
        for i, f in enumerate(group):
            total[:, f, :sizes[i]] += joint.sum(axis=tuple(1 + j for j in range(len(group)) if j != i))


def _gains(sums: np.ndarray, penalty: float, least_rows: int) -> np.ndarray:
    """What splitting after each bin saves: [..., feature, bin] from [3, ..., feature, bin]; -inf where a side is too small."""
    left = np.cumsum(sums, axis=-1)
    whole = left[..., -1:]
    right = whole - left
    def part(x):
        return x[0] ** 2 / (x[1] + penalty + 1e-300)
    gain = part(left) + part(right) - part(whole)
    return np.where((left[2] >= least_rows) & (right[2] >= least_rows), gain, -np.inf)


def _written(rows: DataFrame, columns: list[str], y: Column, key: Column, trains: Column) -> DataFrame:
    """Features, target, key and models of the rows, written once for the passes that find the bins."""
    return cut(rows.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns], y.cast("double").alias("_y"), key.cast("bigint").alias("_key"),
                           F.filter(trains, lambda t: t.w > 0).alias("_trains")))


def prepare(written: DataFrame, columns: list[str], edges: list[np.ndarray]) -> DataFrame:
    """The training rows: bins, target, key and an array of (m, w): the models that a row trains and its weight in each."""
    def work(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for features in batches:
            features = (features,) if isinstance(features, pa.Array) else features  # a single column comes by itself
            x = _binned([np.asarray(f.to_numpy(zero_copy_only=False), float) for f in features], edges)
            yield pa.array([r.tobytes() for r in x], pa.binary())

    binned = F.arrow_udf(work, "binary")(*[F.col(f"`{c}`") for c in columns])
    # rows without a target train nothing
    slim = written.where(F.col("_y").isNotNull() & (F.size("_trains") > 0))
    return slim.select(binned.alias("x"), F.col("_y").alias("y"), F.col("_key").alias("key"), F.col("_trains").alias("trains"))


def trained_by(models: Column, weight: Column | None = None) -> Column:
    """The ``trains`` column from an array of model numbers (and one weight for all)."""
    w = (F.lit(1.0) if weight is None else weight).cast("double")
    return F.transform(models, lambda m: F.struct(m.cast("int").alias("m"), w.alias("w")))


def fit_boosted(rows: DataFrame, columns: list[str], y: Column, key: Column, trains: Column, models: int, objective: str = "logistic",
                outputs: int = 1, settings: Settings = Settings(), allowed: np.ndarray | None = None, bins: int = BINS,
                whole: int = WHOLE) -> Boosted:
    """Fit ``models`` models at once on the rows that ``trains`` gives to each.

    ``key`` tells rows apart when a tree uses a share of them. ``allowed`` [model, column] leaves columns to some models only. A model without
    rows predicts zero scores. Missing and NaN values lie below all others; rows with a null target are left out. Models of at most ``whole`` rows
    are grown in a task each; with larger ones the rows are dealt to tasks that grow all models together, or (with a ``whole`` of 0, or
    where tasks can't meet) every level is a job over all rows.
    """
    written = _written(rows, columns, y, key, trains)
    edges = bin_edges(written, columns, bins)
    frame = cut(prepare(written, columns, edges))
    forget(written)
    sizes = {r["m"]: r["count"] for r in frame.select(F.explode("trains.m").alias("m")).groupBy("m").count().collect()}  # a row a model
    may = np.ones((models, len(columns)), bool) if allowed is None else allowed
    most, pairs = max(sizes.values(), default=0), sum(sizes.values())
    if most <= whole:
        return _fit_held(frame, columns, edges, models, objective, outputs, settings, may, bins, sizes, 0)
    tasks = min(TEAM, slots(frame.sparkSession), -(-pairs // TASK_ROWS))
    if whole and tasks > 1 and local_path(frame.sparkSession, shared_dir(frame.sparkSession)):
        return _fit_held(frame, columns, edges, models, objective, outputs, settings, may, bins, sizes, tasks)
    tasks = -(-pairs // TASK_ROWS)
    if tasks < frame.rdd.getNumPartitions():
        small = cut(frame.coalesce(tasks))
        forget(frame)
        frame = small
    table = _Rows(frame, models, outputs, objective)
    me = Boosted(objective, list(columns), edges, _start(table, models, outputs, objective))
    _grow(me, table, settings, may, bins)
    forget(table.frame)
    return me


def _grow(me: Boosted, rows: _Rows | _Held, s: Settings, may: np.ndarray, bins: int) -> None:
    """Add all trees: a level at a time, every split the one that saves most by the sums that ``rows`` gives."""
    models, outputs = me.start.shape
    me.gain = np.zeros((models, len(me.columns)))
    rng = np.random.default_rng(s.seed)
    n, inner = len(me.columns), 2 ** s.depth - 1
    for _ in range(s.rounds):
        usable = np.zeros(n, bool)
        usable[rng.permutation(n)[:max(1, int(np.ceil(n * s.column_share)))]] = True
        # a model none of whose columns were drawn uses all of its own
        usable = np.where((may & usable).any(axis=1, keepdims=True), may & usable, may)
        some = usable.argmax(axis=1)   # a column whose sums every model has
        feature = np.zeros((models, outputs, inner), np.int64)
        bound = np.full((models, outputs, inner), 255, np.int64)
        for level in range(s.depth):
            nodes = 2 ** level
            sums = rows.level(me, feature, bound, level, s, bins, usable)
            gain = np.where(usable[:, None, None, :, None], _gains(sums, s.penalty, s.least_rows), -np.inf)
            flat = gain.reshape(models, outputs, nodes, -1)
            most = flat.max(axis=-1)
            # of splits that are equally good but for rounding, the first; sums are rounded by their own size, not the gain's
            whole = np.stack([sums[:2, m, :, :, f].sum(axis=-1) for m, f in enumerate(some)], axis=1)
            blur = 1e-9 * np.abs(most) + 1e-12 * whole[0] ** 2 / (whole[1] + s.penalty + 1e-300)
            best = (flat >= np.where(np.isfinite(most), most - blur, most)[..., None]).argmax(axis=-1)
            split = most > 1e-12
            place = slice(nodes - 1, 2 * nodes - 1)
            feature[:, :, place] = np.where(split, best // bins, 0)
            bound[:, :, place] = np.where(split, best % bins, 255)
            np.add.at(me.gain, (np.argwhere(split)[:, 0], (best // bins)[split]), most[split])
        # the last level's sums give the leaves
        left = np.take_along_axis(np.cumsum(sums[:2], axis=-1).reshape(2, models, outputs, nodes, -1),
                                  np.where(split, best, (some * bins + bins - 1)[:, None, None])[None, ..., None], -1)[..., 0]
        leaves = np.stack([left, whole - left], axis=-1).reshape(2, models, outputs, 2 * nodes)
        me.feature.append(feature)
        me.bound.append(bound)
        me.value.append(-s.rate * leaves[0] / (leaves[1] + s.penalty + 1e-300))


def _fit_held(frame: DataFrame, columns: list[str], edges: list[np.ndarray], models: int, objective: str, outputs: int, s: Settings,
              may: np.ndarray, bins: int, sizes: dict[int, int], tasks: int) -> Boosted:
    """Every model in a task of its own (``tasks`` 0), or all of them by that many tasks with a share of the rows each; the trees come back as bytes, a row a model.

    A task holds up to ``HELD`` bytes: of many models it grows some after the others, and beyond that its arrays are files.
    """
    # largest first
    order = sorted(sizes, key=lambda m: (-sizes[m], m))
    row, pair = len(columns) + 30, outputs * 25 + 8   # bytes of a row, and of each model that it trains
    if tasks:
        path = scratch_path(frame.sparkSession, "meeting")
        folder, each = local_path(frame.sparkSession, path), {m: -(-n // tasks) for m, n in sizes.items()}
        pairs = frame.select("x", "y", "key", "trains.m", "trains.w").repartition(tasks, "key", "y")
        room = max(HELD - row * -(-frame.count() // tasks), pair * max(each.values()))
        groups: list[list[int]] = [[]]
        for m in order:
            if groups[-1] and (sum(each[o] for o in groups[-1]) + each[m]) * pair > room:
                groups.append([])
            groups[-1].append(m)
        large = room > HELD or row * -(-frame.count() // tasks) + room > 2 * HELD
    else:
        folder, groups = None, [[m] for m in order]
        place = F.element_at(F.create_map(*[F.lit(v) for p in enumerate(order) for v in p[::-1]]), F.col("m")) if order else F.lit(0)
        pairs = frame.select("x", "y", "key", F.inline("trains")).withColumn("_place", place).repartitionById(max(1, len(order)), "_place")
        pairs = pairs.select("x", "y", "key", F.array("m").alias("m"), F.array("w").alias("w"))
        large = (row + pair) * max(sizes.values(), default=0) > HELD
    pairs = pairs.sortWithinPartitions("key", "y")  # sums do not depend on how rows arrived

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as files:
            blocks = _blocks(batches, files if large else None)
            met, mine = (lambda a: a), 0
            if folder is not None:
                team = BarrierTaskContext.get()
                mine = team.partitionId()
                met = _Meeting(f"{folder}/{team.allGather(uuid.uuid4().hex)[0]}", mine, tasks)   # another one if the stage is run again
            total = np.zeros((models, outputs + 1))
            for members, block in blocks:
                weight = block.arrays["weight"] if "weight" in block.arrays.held else np.ones((len(members), block.rows))
                for m, w in zip(members, weight):
                    _count(total[m:m + 1], {"y": block.arrays["y"], "weight": w, "model": np.zeros(block.rows, np.int64)}, objective)
            start = _from_counts(met(total), objective)
            here = {m for members, _ in blocks for m in members}
            for group in groups:
                if folder is None and not here.intersection(group):
                    continue
                me = Boosted(objective, columns, [], start[group])
                number = {m: i for i, m in enumerate(group)}
                helds = [_Held({"score": start[m]}, outputs, block, j, number[m]) for members, block in blocks for j, m in enumerate(members) if m in number]
                _grow(me, _Share(helds, len(group), outputs, met), s, may[group], bins)
                if mine == 0:
                    parts = [me.start[:, None], me.gain[:, None], *(np.array(a).swapaxes(0, 1) for a in (me.feature, me.bound, me.value))]
                    yield pa.RecordBatch.from_pydict({"m": pa.array(group, pa.int32()), **{
                        f"a{i}": pa.array([np.ascontiguousarray(p[j]).tobytes() for j in range(len(group))], pa.binary()) for i, p in enumerate(parts)}})

    got = pairs.mapInArrow(run, "m int, a0 binary, a1 binary, a2 binary, a3 binary, a4 binary", barrier=tasks > 0).collect()
    me = Boosted(objective, list(columns), edges, np.zeros((models, outputs)), gain=np.zeros((models, len(columns))))
    inner = 2 ** s.depth - 1
    feature = np.zeros((s.rounds, models, outputs, inner), np.int64)
    bound = np.full((s.rounds, models, outputs, inner), 255, np.int64)
    value = np.zeros((s.rounds, models, outputs, inner + 1))
    for r in got:
        m = r["m"]
        me.start[m], me.gain[m] = np.frombuffer(r["a0"]), np.frombuffer(r["a1"])
        feature[:, m] = np.frombuffer(r["a2"], np.int64).reshape(s.rounds, outputs, inner)
        bound[:, m] = np.frombuffer(r["a3"], np.int64).reshape(s.rounds, outputs, inner)
        value[:, m] = np.frombuffer(r["a4"]).reshape(s.rounds, outputs, inner + 1)
    me.feature, me.bound, me.value = list(feature), list(bound), list(value)
    if tasks:
        remove(frame.sparkSession, path)
    forget(frame)
    return me


def _blocks(batches: Iterator[pa.RecordBatch], folder: str | None) -> list[tuple[tuple[int, ...], _Block]]:
    """The rows of a task by the models that they train, up to ``BLOCK`` in a block."""
    waiting: dict[tuple[int, ...], list] = {}
    out = []

    def close(members: tuple[int, ...]) -> None:
        x, y, key, w = (np.concatenate(p, axis=-1) for p in zip(*waiting.pop(members)))
        out.append((members, _Block(x, y, key, None if (w == 1).all() else w, folder)))

    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.num_rows
        x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(n, -1)
        y, key = batch.column("y").to_numpy(), batch.column("key").fill_null(0).to_numpy()
        m, w = batch.column("m").flatten().to_numpy(), batch.column("w").flatten().to_numpy()
        size = np.asarray(batch.column("m").value_lengths()).astype(np.int64)
        first = np.cumsum(size) - size
        # rows with the same models, told by the sums of mixed numbers and then by the numbers themselves
        mark = np.add.reduceat((m + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0x5851F42D4C957F2D), first)
        _, some, group = np.unique(mark, return_index=True, return_inverse=True)
        for g, one in enumerate(some):
            members = tuple(m[first[one]:first[one] + size[one]].tolist())
            rows = np.flatnonzero(group == g)
            at = first[rows][None] + np.arange(len(members))[:, None]
            assert (size[rows] == len(members)).all() and (m[at] == np.array(members)[:, None]).all()
            held = waiting.setdefault(members, [])
            held.append((np.ascontiguousarray(x[rows].T), y[rows], key[rows], w[at]))
            if sum(len(p[1]) for p in held) >= BLOCK:
                close(members)
    for members in list(waiting):
        close(members)
    return out


def _count(sums: np.ndarray, part: dict, objective: str) -> None:
    """Adds weights by class (or the weighted target) and in all, for each model."""
    y, w, m = part["y"], part["weight"], part["model"]
    np.add.at(sums, (m, sums.shape[1] - 1), w)
    if objective == "softmax":
        np.add.at(sums, (m, y.astype(np.int64)), w)
    else:
        np.add.at(sums, (m, 0), w * y)


def _from_counts(sums: np.ndarray, objective: str) -> np.ndarray:
    """Scores before the first tree: mean, log odds or log shares."""
    share = sums[:, :-1] / np.maximum(sums[:, -1:], 1e-300)
    seen = sums[:, -1:] > 0
    if objective == "squared":
        return np.where(seen, share, 0.0)
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.where(seen, np.log(share) - (np.log(1 - share) if objective == "logistic" else 0.0), 0.0)


def _start(table: _Rows, models: int, outputs: int, objective: str) -> np.ndarray:
    def work(total: np.ndarray, part: dict) -> None:
        _count(total.reshape(models, outputs + 1), part, objective)

    return _from_counts(table.summed(models * (outputs + 1), work).reshape(models, outputs + 1), objective)


def _scored(frame: DataFrame, me: Boosted, done: int, outputs: int) -> DataFrame:
    """The rows with the scores that all trees so far give, an array in the order of ``trains`` and outputs."""
    recent = Boosted(me.objective, me.columns, [], me.start, me.feature[done:], me.bound[done:], me.value[done:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _pairs(batch, outputs)
            score = recent.raw(part["x"], part["model"], 0, part["score"])
            each = np.asarray(batch.column(batch.schema.names.index("trains")).value_lengths())
            ends = np.concatenate([[0], np.cumsum(each * outputs)]).astype(np.int32)
            columns = {c: batch.column(batch.schema.names.index(c)) for c in ("x", "y", "key", "trains")}
            yield pa.RecordBatch.from_pydict({**columns, "score": pa.ListArray.from_arrays(pa.array(ends), pa.array(score.ravel()))})

    return frame.mapInArrow(run, "x binary, y double, key bigint, trains array<struct<m:int,w:double>>, score array<double>")


def first_gains(rows: DataFrame, columns: list[str], y: Column, key: Column, trains: Column, models: int, objective: str = "logistic",
                outputs: int = 1, settings: Settings = Settings(), bins: int = 1 << 15) -> DataFrame:
    """(model, output, feature, threshold, gain) of every possible first split: missing values and those up to the threshold against the rest.

    A model's thresholds are the values of its own rows; of a feature with over ``bins`` * 0.8 values, some ``bins`` quantiles.
    """
    written = _written(rows, columns, y, key, trains)
    edges = bin_edges(written, columns, bins)
    bins = max(map(len, edges), default=0) + 2
    table = _Rows(cut(prepare(written, columns, edges)), models, outputs, objective, _bin_type(edges))
    forget(written)
    me = Boosted(objective, list(columns), edges, _start(table, models, outputs, objective))
    none = np.zeros((models, outputs, 1), np.int64)
    sums = table.level(me, none, none, 0, settings, bins, np.ones((models, len(columns)), bool))[:, :, :, 0]
    gain = np.where(sums[2] > 0, _gains(sums, settings.penalty, settings.least_rows), -np.inf)
    out = [(int(m), int(k), columns[f], float(edges[f][b - 1]), float(gain[m, k, f, b]))
           for m, k, f, b in np.argwhere(np.isfinite(gain)) if 1 <= b <= len(edges[f])]
    return rows.sparkSession.createDataFrame(out, "model int, output int, feature string, threshold double, gain double")
