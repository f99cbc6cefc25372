"""Surrogate forests for all keys at once: binned features, trees grown level by level.

Every feature is cut into bins at quantiles of its key, and each task sums up its rows with the same codes, once for all levels. One level of all trees of
all keys is one aggregation: the weight of the truth per key, tree, node, feature and bin is summed in each task over its sums (without a row per tree or
feature), and the partial sums meet in a shuffle. The best
split of a node then follows from running sums over the bins, so the work of a level does not depend on the number of keys.

The trees grown so far are sent to the tasks. Their size is known beforehand, ``keys * trees * 2^depth`` splits; beyond
``MODEL_SPLITS`` the keys are dealt to groups whose trees are grown one group after another.

Rows weigh as often as a Poisson draw from the hash of the row and the tree says, so a recomputed task draws the same; a single tree takes every row once.
Each node may split on a share of the features, drawn from its number: their square root for classes, a third for regression. Every node that can gain is
split down to ``depth``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from predaudit.functions.keys import attach, group, join_on, measured
from predaudit.functions.lineage import store
from predaudit.spec import REGRESSION

TREES, DEPTH, BINS = 20, 5, 32
MODEL_SPLITS = 8_000_000  # of 4 bytes: 32 MB
DENSE = 4_000_000  # cells of a table of sums that a task holds, else it sums the cells that occur
CELLS = 6_000_000  # weights of trees that a task holds while it sums up rows with the same codes
CELL_ROWS = 5_000  # rows of a batch of such sums
CELL_SCHEMA = "key long, label string, bins array<tinyint>, w array<double>, s array<double>"
SEED = 42
TARGET = "_target"

_POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])  # of mean 1
SPLIT_SCHEMA = "key long, tree int, node int, feature int, bin int, gain double, weight double"


def _scatter(*parts: np.ndarray | int) -> np.ndarray:
    """Hash of whole numbers to 64 bits."""
    x = np.uint64(SEED)
    for part in parts:
        x = (x ^ np.asarray(part).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(29))
    return x


def _draws(rows: np.ndarray, tree: int) -> np.ndarray:
    uniform = (_scatter(rows, tree + 1) >> np.uint64(11)) / 2.0**53
    return np.searchsorted(_POISSON, uniform, side="right").astype(np.float64)


def _allowed(tree: int, nodes: np.ndarray, features: int, share: int) -> np.ndarray:
    """Which features each node may split on: the ``share`` of the smallest hashes."""
    if share >= features:
        return np.ones((len(nodes), features), bool)
    ranks = np.argsort(np.argsort(_scatter(nodes[:, None], tree + 1, np.arange(features)[None, :] + 1), axis=1), axis=1)
    return ranks < share


def _key(by: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in by]) if by else F.lit(0).cast("long")


def _coded(keys: np.ndarray, model):
    """Rows ``(_target, _key, _row, _x)`` with the values replaced by their codes; ``model.value`` holds the cuts by key and feature, filled up with infinity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = model.value
        for batch in batches:
            if batch.num_rows:
                target, key, row, x = (batch.column(i) for i in range(4))
                at, x = np.searchsorted(keys, key.to_numpy()), x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                codes = np.stack([(cuts[at, i] < x[:, i : i + 1]).sum(axis=1, dtype=np.int8) for i in range(x.shape[1])], axis=1)
                yield pa.RecordBatch.from_arrays([target, key, row, _lists(codes)], names=[TARGET, "_key", "_row", "_bins"])

    return run


def binned(frame: DataFrame, names: Sequence[str], by: Sequence[str], bins: int = BINS) -> DataFrame:
    """``(_target, _key, _row, _bins)``: codes of the features, ``i`` for values above ``i`` cuts. Without values a feature has code 0.

    Cuts are quantiles of the key, and every value of a feature that has few. They are sent to the tasks if there are at most ``MODEL_SPLITS``, else joined.
    """
    probs = [i / bins for i in range(bins)]
    cuts, _ = measured(group(frame, by, *[F.array_distinct(F.percentile_approx(c, probs, 10_000)).alias(c) for c in names]), by)
    own = (TARGET, _key(by).alias("_key"), F.xxhash64(TARGET, *names).alias("_row"))
    if (cuts.count() if by else 1) * len(names) * bins <= MODEL_SPLITS:
        found = sorted(cuts.select(_key(by).alias("_key"), *names).collect(), key=lambda r: r["_key"])
        table = np.full((len(found), len(names), bins), np.inf)
        for at, row in enumerate(found):
            for i in range(len(names)):
                table[at, i, : len(row[i + 1] or ())] = row[i + 1] or ()
        run = _coded(np.array([r["_key"] for r in found], np.int64), frame.sparkSession.sparkContext.broadcast(table))
        rows = frame.select(*own, F.array(*[F.col(c) for c in names]).alias("_x"))
        return rows.mapInArrow(run, f"{TARGET} {frame.schema[TARGET].dataType.simpleString()}, _key long, _row long, _bins array<tinyint>")

    def code(c: str) -> Column:
        return F.coalesce(F.size(F.filter(F.col(f"_cuts.`{c}`"), lambda cut: cut < F.col(c))), F.lit(0)).cast("byte")

    rows = attach(frame, cuts, by, "_cuts")
    return rows.select(*own, F.array(*[code(c) for c in names]).alias("_bins"))


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct row of some whole numbers first stands, and the number of each row among the distinct ones."""
    at, size = np.zeros(len(columns[0]), np.int64), 1
    for column in columns:
        values, of = np.unique(column, return_inverse=True)
        if size * len(values) >= 1 << 62:
            found, at = np.unique(at, return_inverse=True)
            size = len(found)
        at, size = at * len(values) + of, size * len(values)
    return np.unique(at, return_index=True, return_inverse=True)[1:]


def _lists(values: np.ndarray) -> pa.ListArray:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).reshape(-1)))


def _cells(features: int, trees: int, classes: bool):
    """Rows of ``binned`` to ``(key, label, bins, w, s)``: each task's weights, and sums of the truth, per tree of all its rows with the same codes.

    A task holds sums of ``CELLS`` at most, so the table has a row per task and combination of codes that occurs there, and never more rows than the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: dict = {}
        held: list[tuple] = []  # (key, label, codes, w, s)
        read: list[tuple] = []  # (key, label, codes, row, truth)

        def summed(parts: list[tuple], weights) -> tuple:
            key, label, codes, x, y = (np.concatenate([part[i] for part in parts]) for i in range(5))
            first, of = _distinct(key, label, *codes.T)
            sums = np.empty((2, len(first), trees))
            for tree in range(trees):
                w, s = weights(x, y, tree)
                sums[0, :, tree], sums[1, :, tree] = np.bincount(of, w, len(first)), np.bincount(of, s, len(first))
            return key[first], label[first], codes[first], sums[0], sums[1]

        def drawn(row: np.ndarray, truth: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
            weight = _draws(row, tree) if trees > 1 else np.ones(len(row))
            return weight, weight * truth

        def flush() -> Iterator[pa.RecordBatch]:
            names = pa.array([*labels], pa.string())
            for key, label, codes, w, s in held:
                text = names.take(pa.array(label)) if classes else pa.nulls(len(key), pa.string())
                whole = pa.RecordBatch.from_arrays([pa.array(key), text, _lists(codes.astype(np.int8)), _lists(w), _lists(s)], names=["key", "label", "bins", "w", "s"])
                for at in range(0, len(key), CELL_ROWS):
                    yield whole.slice(at, CELL_ROWS)
            held.clear()

        def add() -> Iterator[pa.RecordBatch]:
            held.append(summed(read, drawn))
            read.clear()
            if len(held) > 1:
                held[:] = [summed(held, lambda w, s, tree: (w[:, tree], s[:, tree]))]
            if held[0][3].size > CELLS:
                yield from flush()

        for batch in batches:
            if not batch.num_rows:
                continue
            target, key, row, codes = (batch.column(i) for i in range(4))
            if classes:
                encoded = target.cast(pa.string()).dictionary_encode()
                names = [labels.setdefault(x, len(labels)) for x in encoded.dictionary.to_pylist()]
                label, truth = np.array(names, np.int64)[encoded.indices.to_numpy()], np.zeros(batch.num_rows)
            else:
                label, truth = np.zeros(batch.num_rows, np.int64), target.to_numpy()
            read.append((key.to_numpy(), label, codes.flatten().to_numpy().reshape(-1, features), row.to_numpy().view(np.uint64), truth))
            if sum(len(part[0]) for part in read) * trees >= CELLS:
                yield from add()
        if read:
            yield from add()
        yield from flush()

    return run


def _histograms(keys: np.ndarray, features: int, trees: int, level: int, bins: int, share: int, model, classes: bool):
    """Partial sums ``(key, tree, node, feature, bin, label, w, s)`` of the open nodes of a level, from rows of ``_cells``.

    ``model.value`` holds the feature and the bin of every split so far, by key, tree and node (children of ``i`` are ``2i`` and ``2i + 1``).
    For classes ``w`` is the weight of a label, else ``w`` and ``s`` are the weight and the sum of the truth.
    """
    first = 1 << level
    width = len(keys) * first * features * bins  # cells of a tree

    def nodes_of(tree: int, key: np.ndarray, codes: np.ndarray) -> np.ndarray:
        split_on, split_at = model.value
        node = np.ones(len(key), np.int64)
        for _ in range(level):
            feature = split_on[key, tree, node]
            right = codes[np.arange(len(key)), np.maximum(feature, 0)] > split_at[key, tree, node]
            node = np.where(feature >= 0, 2 * node + right, 0)  # node 0 never splits
        return node

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str | None, np.ndarray] = {}  # sums of all cells of a label
        pieces: dict[str | None, list[tuple]] = {}  # sums of the cells that occur

        def made(label: str | None, where: np.ndarray, w: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            rest, bin_ = np.divmod(where, bins)
            rest, feature = np.divmod(rest, features)
            rest, node = np.divmod(rest, first)
            tree, key = np.divmod(rest, len(keys))
            columns = [
                pa.array(keys[key]), pa.array(tree.astype(np.int32)), pa.array((node + first).astype(np.int32)), pa.array(feature.astype(np.int32)),
                pa.array(bin_.astype(np.int32)), pa.array([label] * len(where), pa.string()), pa.array(w), pa.array(s),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["key", "tree", "node", "feature", "bin", "label", "w", "s"])

        def merged(label: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            where, w, s = (np.concatenate(x) for x in zip(*pieces[label]))
            where, of = np.unique(where, return_inverse=True)
            return where, np.bincount(of, w), np.bincount(of, s)

        def add(label: str | None, tree: int, at: np.ndarray, w: np.ndarray, s: np.ndarray) -> None:
            if label not in tables and (len(tables) + 1) * trees * width <= DENSE:
                tables[label] = np.zeros((2, trees, width))
            if label in tables:
                tables[label][0, tree] += np.bincount(at, w, width)
                tables[label][1, tree] += np.bincount(at, s, width)
            else:
                where, of = np.unique(at, return_inverse=True)
                pieces.setdefault(label, []).append((where + tree * width, np.bincount(of, w), np.bincount(of, s)))

        for batch in batches:
            if not batch.num_rows:
                continue
            key_, label_, codes, w_, s_ = (batch.column(i) for i in range(5))
            key = np.searchsorted(keys, key_.to_numpy())
            codes = codes.flatten().to_numpy().reshape(-1, features).astype(np.int64)
            weights, truths = (x.flatten().to_numpy().reshape(-1, trees) for x in (w_, s_))
            encoded = label_.dictionary_encode()
            names, label = (encoded.dictionary.to_pylist(), encoded.indices.to_numpy()) if classes else ([None], np.zeros(len(key), np.int64))
            for tree in range(trees):
                node = nodes_of(tree, key, codes)
                some = np.flatnonzero((node >= first) & (weights[:, tree] > 0))
                allowed = _allowed(tree, np.arange(first, 2 * first), features, share)[node[some] - first]
                place = ((key[some] * first + node[some] - first) * features)[:, None] + np.arange(features)
                at = place * bins + codes[some]
                for one in np.unique(label[some]):
                    mine = label[some] == one
                    use = allowed[mine]
                    w, s = (np.broadcast_to(x[some, tree][mine][:, None], use.shape)[use] for x in (weights, truths))
                    add(names[int(one)], tree, at[mine][use], w, s)
            if sum(len(piece[0]) for parts in pieces.values() for piece in parts) > DENSE:
                for one in pieces:
                    pieces[one] = [merged(one)]
                if sum(len(parts[0][0]) for parts in pieces.values()) > DENSE // 2:
                    for one in pieces:
                        yield made(one, *pieces[one][0])
                    pieces.clear()
        for one in pieces:
            yield made(one, *merged(one))
        for one, table in tables.items():
            w, s = table.reshape(2, -1)
            where = np.flatnonzero(w)
            yield made(one, where, w[where], s[where])

    return run


def _summed(coded: DataFrame, features: int, trees: int, classes: bool) -> DataFrame:
    return coded.mapInArrow(_cells(features, trees, classes), CELL_SCHEMA)


def best_splits(sums: DataFrame, classes: bool) -> DataFrame:
    """The split of most gain of every node that has one: ``(key, tree, node, feature, bin, gain, weight)``; rows up to ``bin`` go left.

    The gain is the fall of the squared error, or of the Gini impurity times the weight. Ties go to the first feature and the lowest bin.
    """
    cell = ["key", "tree", "node", "feature"]
    if classes:
        own = Window.partitionBy(*cell, "label")
        before = F.coalesce(F.sum("w").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        steps = sums.withColumns({"_before": before, "_all": F.sum("w").over(own)}).select(
            *cell, "bin", "w",
            (F.col("w") * (2 * F.col("_before") + F.col("w"))).alias("left"),  # growth of the squared weight on the left
            (F.col("w") * (F.col("w") - 2 * (F.col("_all") - F.col("_before")))).alias("right"),
            F.when(F.col("_before") == 0, F.col("_all") * F.col("_all")).otherwise(0.0).alias("whole"),
        ).groupBy(*cell, "bin").agg(*[F.sum(c).alias(c) for c in ("w", "left", "right", "whole")])
        upto = Window.partitionBy(*cell).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        everything = Window.partitionBy(*cell)
        rows = steps.select(
            *cell, "bin", F.sum("w").over(upto).alias("lw"), F.sum("w").over(everything).alias("tw"), F.sum("left").over(upto).alias("l2"),
            (F.sum("right").over(upto) + F.sum("whole").over(everything)).alias("r2"), F.sum("whole").over(everything).alias("t2"),
        )
    else:
        upto = Window.partitionBy(*cell).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        everything = Window.partitionBy(*cell)
        rows = sums.withColumns(
            {"lw": F.sum("w").over(upto), "tw": F.sum("w").over(everything), "_l": F.sum("s").over(upto), "_t": F.sum("s").over(everything)}
        ).select(
            *cell, "bin", "lw", "tw", (F.col("_l") * F.col("_l")).alias("l2"), ((F.col("_t") - F.col("_l")) * (F.col("_t") - F.col("_l"))).alias("r2"),
            (F.col("_t") * F.col("_t")).alias("t2"),
        )
    gain = F.col("l2") / F.col("lw") + F.col("r2") / (F.col("tw") - F.col("lw")) - F.col("t2") / F.col("tw")
    found = rows.where(F.col("tw") > F.col("lw")).select(
        "key", "tree", "node", F.struct(gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"), F.col("tw").alias("weight")).alias("split"),
        (F.col("t2") / F.col("tw")).alias("level"),
    )
    best = found.groupBy("key", "tree", "node").agg(F.max("split").alias("split"), F.max("level").alias("level"))
    return best.where(F.col("split.gain") > 1e-12 * F.greatest(F.lit(1.0), F.col("level"))).select(
        "key", "tree", "node", (-F.col("split.feature")).alias("feature"), (-F.col("split.bin")).alias("bin"), F.col("split.gain").alias("gain"), F.col("split.weight").alias("weight")
    )


def _grown(rows: DataFrame, keys: list[int], features: int, trees: int, depth: int, bins: int, share: int, classes: bool) -> DataFrame:
    """All splits of the trees of some keys. The driver holds one level's splits and the trees of these keys."""
    spark, keys_ = rows.sparkSession, np.array(sorted(keys), np.int64)
    split_on = np.full((len(keys_), trees, 1 << depth), -1, np.int16)
    split_at = np.zeros((len(keys_), trees, 1 << depth), np.int16)
    levels = []
    for level in range(depth):
        model = spark.sparkContext.broadcast((split_on, split_at))
        run = _histograms(keys_, features, trees, level, bins, share, model, classes)
        partial = rows.mapInArrow(
            run, "key long, tree int, node int, feature int, bin int, label string, w double, s double"
        )
        sums = partial.groupBy("key", "tree", "node", "feature", "bin", "label").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
        found = store(best_splits(sums, classes), "surrogate-splits")
        levels.append(found)
        splits = found.toArrow()
        model.unpersist()
        if not splits.num_rows:
            break
        key, tree, node = (splits[c].to_numpy() for c in ("key", "tree", "node"))
        at = np.searchsorted(keys_, key), tree, node
        split_on[at], split_at[at] = splits["feature"].to_numpy(), splits["bin"].to_numpy()
    return reduce(DataFrame.unionByName, levels)


def _centred(frame: DataFrame, by: Sequence[str], classes: bool) -> DataFrame:
    """The frame with the truth of numbers centred on the mean of its key."""
    if classes:
        return frame
    means, few = measured(group(frame, by, F.avg(TARGET).alias("_mean")), by)
    centred = join_on(frame, means, by, small=few) if by else frame.withColumn("_mean", means.scalar())
    return centred.withColumn(TARGET, F.col(TARGET) - F.col("_mean")).drop("_mean")


def forest_splits(
    frame: DataFrame, names: Sequence[str], problem: str, by: Sequence[str] = (), trees: int = TREES, depth: int = DEPTH, bins: int = BINS,
    share: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The splits of the forests of all keys, and ``(by…, key)`` to name their keys.

    ``frame`` is a feature frame; regression centres the truth on the mean of its key.
    """
    names, classes = list(names), problem != REGRESSION
    if not 1 < bins <= 127:
        raise ValueError("bins must be between 2 and 127")
    frame = _centred(frame, by, classes).where(F.col(TARGET).isNotNull())
    rows = store(_summed(binned(frame, names, by, bins), len(names), trees, classes), "surrogate-rows")
    keys = store(frame.select(*by, _key(by).alias("key")).distinct(), "surrogate-keys")
    if share is None:
        share = max(1, int(np.sqrt(len(names)) if classes else len(names) / 3)) if trees > 1 else len(names)
    per_key = trees << depth
    groups = max(1, -(-keys.count() * per_key // MODEL_SPLITS))
    parts = []
    for at in range(groups):
        mine = [r["key"] for r in keys.where(F.pmod("key", F.lit(groups)) == at).select("key").toLocalIterator()]
        if len(mine) != len(set(mine)):
            raise ValueError("two keys have the same hash")
        if mine:
            chosen = rows if groups == 1 else rows.where(F.pmod("key", F.lit(groups)) == at)
            parts.append(_grown(chosen, mine, len(names), trees, depth, bins + 1, share, classes))
    if not parts:
        return rows.sparkSession.createDataFrame([], SPLIT_SCHEMA), keys
    return reduce(DataFrame.unionByName, parts), keys


def deep_splits(frame: DataFrame, names: Sequence[str], problem: str, trees: int, depth: int, bins: int, share: int) -> DataFrame:
    """``(key, tree, node, feature, bin, gain, weight)``: the splits of one forest over the whole table, as deep as its nodes can be split.

    Rows with the same codes go the same way in a tree, so they are summed up once, and a level moves these sums to the children of their nodes by a join. Sums
    whose node is a leaf are left out, and the driver holds no tree. A level costs the sums of the open nodes, not the rows.
    """
    names, classes = list(names), problem != REGRESSION
    if not 1 < bins <= 127:
        raise ValueError("bins must be between 2 and 127")
    if not 0 < depth < 62:
        raise ValueError("the depth must be between 1 and 61")
    coded = binned(_centred(frame, (), classes).where(F.col(TARGET).isNotNull()), names, (), bins)
    parts = store(_summed(coded, len(names), trees, classes), "forest-rows")
    each = parts.select("label", "bins", F.posexplode(F.arrays_zip("w", "s")).alias("tree", "_x")).where("_x.w > 0")
    open_ = store(
        each.groupBy("tree", "label", "bins").agg(F.sum("_x.w").alias("w"), F.sum("_x.s").alias("s")).withColumn("node", F.lit(1).cast("long")), "forest-cells"
    )
    levels = []
    for _ in range(depth):
        drawn = F.array_sort(F.array(*[F.struct(F.xxhash64(F.lit(SEED), "tree", "node", F.lit(i)).alias("h"), F.lit(i).alias("feature")) for i in range(len(names))]))
        tried = open_.withColumn("_f", F.explode(F.slice(drawn, 1, share))).select(
            F.lit(0).cast("long").alias("key"), "tree", "node", F.col("_f.feature").alias("feature"), F.get("bins", F.col("_f.feature")).cast("int").alias("bin"),
            "label", "w", "s",
        )
        sums = tried.groupBy("key", "tree", "node", "feature", "bin", "label").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
        found = store(best_splits(sums, classes), "forest-splits")
        levels.append(found)
        if found.isEmpty():
            break
        went = join_on(open_, found.select("tree", "node", "feature", "bin"), ["tree", "node"])
        right = (F.get("bins", F.col("feature")) > F.col("bin")).cast("long")
        open_ = store(went.select("tree", "label", "bins", "w", "s", (2 * F.col("node") + right).alias("node")), "forest-cells")
    return reduce(DataFrame.unionByName, levels)


def _named(names: Sequence[str], index: str) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in names]), F.col(index) + 1)


def surrogate_importance(
    frame: DataFrame, names: Sequence[str], problem: str, by: Sequence[str] = (), trees: int = TREES, depth: int = DEPTH, bins: int = BINS
) -> DataFrame:
    """``(by…, feature, importance)``: impurity importance of a forest per key, scaled to sum 1 in each tree and averaged.

    Every key has a row for each feature; all are 0 where no tree finds a split.
    """
    splits, keys = forest_splits(frame, names, problem, by, trees, depth, bins)
    return importances(splits, keys, names, by)


def importances(splits: DataFrame, keys: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by…, feature, importance)`` of the keys of ``(by…, key)``, from the splits of their forests."""
    gains = splits.groupBy("key", "tree", "feature").agg(F.sum("gain").alias("gain"))
    shares = gains.withColumn("share", F.col("gain") / F.sum("gain").over(Window.partitionBy("key", "tree")))
    totals = shares.groupBy("key", "feature").agg(F.sum("share").alias("share"))
    scaled = totals.withColumn("importance", F.col("share") / F.sum("share").over(Window.partitionBy("key"))).select(
        "key", _named(names, "feature").alias("feature"), "importance"
    )
    every = keys.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in names])))
    return every.join(scaled, ["key", "feature"], "left").select(*by, "feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def first_splits(frame: DataFrame, names: Sequence[str], problem: str, by: Sequence[str] = (), bins: int = 120) -> DataFrame:
    """``(by…, feature, code, gain, n)``: the best single split of each key over all rows; rows up to the cut number ``code`` go left."""
    splits, keys = forest_splits(frame, names, problem, by, 1, 1, bins)
    return splits.join(keys, "key").select(
        *by, _named(names, "feature").alias("feature"), F.col("bin").alias("code"), "gain", F.col("weight").cast("long").alias("n")
    )
