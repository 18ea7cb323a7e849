"""Random-forest ranking of banded exposures, with block-wise validation and permutation importance."""

from __future__ import annotations

import math
import re
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows (readings of equal exposures) that are shuffled among themselves, about; with fewer in all, all of them.
GROUP = 4096
#: Outcomes that a row holds at most, about.
ALIKE = 1 << 22
#: Bytes of the table of changes that a task holds at once.
HELD = 128 << 20
#: Bytes of binned readings up to which a task grows whole trees; over these, Spark grows all trees by level over its partitions.
WHOLE = 128 << 20
#: Bins of a feature, trees of a task, readings looked at at once.
BINS, CHUNK, READINGS = 32, 25, 1 << 15
DEPTH, LEAST = 10, 3


def wide(observations: DataFrame, x: DataFrame, features: list[str]) -> DataFrame:
    """One row per observation with the exposures as an array in order of ``features``, 0 where there is none; fold by 96-hour block."""
    found = x.groupBy("diary_id", "obs_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "x"))).alias("m"))
    start = F.min("t_h").over(Window.partitionBy("diary_id"))
    names = F.array(*map(F.lit, features))
    values = F.transform(names, lambda n: F.coalesce(F.try_element_at("m", n), F.lit(0.0)))
    rows = observations.select("diary_id", "obs_id", "y", F.floor((F.col("t_h") - start) / 96).cast("int").alias("fold"))
    return rows.join(found, ["diary_id", "obs_id"], "left").select("diary_id", "obs_id", "y", "fold", values.alias("x"))


def forest(trees: int, seed: int = 0, depth: int = DEPTH) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="f", labelCol="y", numTrees=trees, minInstancesPerNode=LEAST, featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed)


def assembled(rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("f", array_to_vector("x"))


def features_of(x: DataFrame) -> list[str]:
    """All features in order of name: items times bands."""
    return [r["feature"] for r in x.select("feature").distinct().orderBy("feature").collect()]


def edges_of(x: DataFrame, features: list[str]) -> list[np.ndarray]:
    """The bounds between a feature's bins: halfway between 0 and quantiles of its other values."""
    at = [i / (BINS - 2) for i in range(BINS - 1)]
    found = {r["feature"]: r["q"] for r in x.where("x <> 0").groupBy("feature").agg(F.percentile_approx("x", at, 10000).alias("q")).collect()}
    values = [np.unique([0.0, *found.get(f, ())]) for f in features]
    return [(v[1:] + v[:-1]) / 2 for v in values]


def in_bins(x, edges: list[np.ndarray]) -> list[bytes]:
    """The bins of arrays of values, a byte for each feature."""
    if not edges:
        return [b""] * len(x)
    x = np.stack(x.to_numpy())
    return [b.tobytes() for b in np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1).astype(np.uint8)]


def as_matrix(bins, n_features: int) -> np.ndarray:
    """(rows, features) bytes of a binary Arrow column."""
    if not n_features:
        return np.zeros((len(bins), 0), np.uint8)
    out, at = np.empty((len(bins), n_features), np.uint8), 0
    for c in bins.chunks:
        out[at : at + len(c)] = np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, n_features)
        at += len(c)
    return out


def binned(rows: DataFrame, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, outcomes, folds) of all readings by diary and id, a byte for each feature."""

    def run(batches):
        for pdf in batches:
            yield pdf[["diary_id", "obs_id", "y", "fold"]].assign(bins=in_bins(pdf["x"], edges))

    t = rows.mapInPandas(run, "diary_id long, obs_id long, y double, fold int, bins binary").orderBy("diary_id", "obs_id").toArrow()
    return as_matrix(t["bins"], len(edges)), t["y"].to_numpy(), t["fold"].to_numpy()


def grown(bins: np.ndarray, y: np.ndarray, seed: list[int], row: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(feature, last bin to the left, left, right, value) by node of a regression tree on a bootstrap of the readings.

    As Spark's: Poisson weights, a random part of the features at each node, splits by variance. ``row`` tells a reading's row
    of ``bins``, where readings share rows; each has a weight of its own, and a row counts with their sum.
    """
    r = np.random.default_rng(seed)
    n, n_features = bins.shape
    tried = math.ceil(math.sqrt(n_features))
    weight = r.poisson(1.0, len(y)).astype(float)
    weighted = weight * y
    if row is not None:
        weight, weighted = np.bincount(row, weight, n), np.bincount(row, weighted, n)
    at = np.flatnonzero(weight)
    w, wy = weight[at], weighted[at]
    feature, cut, left, right, value = [np.array([-1])], [np.array([0])], [np.array([0])], [np.array([0])], [np.array([wy.sum() / max(w.sum(), 1.0)])]
    place, open_, total = np.zeros(len(at), np.int64), np.array([0]), 1
    for _ in range(DEPTH if tried else 0):
        m = len(open_)
        if not m or not len(at):
            break
        among = r.random((m, n_features)).argpartition(tried - 1, axis=1)[:, :tried]
        size = m * tried * BINS
        count, sums = np.zeros(size), np.zeros(size)
        for s in range(0, len(at), READINGS):
            c = slice(s, s + READINGS)
            key = ((place[c, None] * tried + np.arange(tried)) * BINS + bins[at[c, None], among[place[c]]]).ravel()
            count += np.bincount(key, np.repeat(w[c], tried), size)
            sums += np.bincount(key, np.repeat(wy[c], tried), size)
        count, sums = (np.cumsum(v.reshape(m, tried, BINS), axis=2) for v in (count, sums))
        n_all, s_all = count[:, :, -1:], sums[:, :, -1:]
        n_left, s_left = count[:, :, :-1], sums[:, :, :-1]
        n_right, s_right = n_all - n_left, s_all - s_left
        fits = (n_left >= LEAST) & (n_right >= LEAST)
        gain = s_left**2 / np.maximum(n_left, 1) + s_right**2 / np.maximum(n_right, 1) - s_all**2 / np.maximum(n_all, 1)
        gain = np.where(fits, gain, 0).reshape(m, -1)
        best = gain.argmax(axis=1)
        nodes = np.arange(m)
        split = gain[nodes, best] > 1e-12 * np.maximum(1.0, (s_all**2 / np.maximum(n_all, 1))[:, 0, 0])
        k, b = best // (BINS - 1), best % (BINS - 1)
        chosen = nodes[split]
        children = total + np.arange(2 * len(chosen)).reshape(-1, 2)
        # the arrays of this level's open nodes are the last ones
        here = open_[chosen] - open_[0] if m else chosen
        feature[-1][here], cut[-1][here] = among[chosen, k[chosen]], b[chosen]
        left[-1][here], right[-1][here] = children[:, 0], children[:, 1]
        sides = [(v[chosen, k[chosen], b[chosen]]) for v in (s_left, n_left, s_right, n_right)]
        means = np.stack([sides[0] / np.maximum(sides[1], 1), sides[2] / np.maximum(sides[3], 1)], axis=1).ravel()
        new = np.full(m, -1)
        new[chosen] = np.arange(len(chosen))
        stays = new[place] >= 0
        at, w, wy, place = at[stays], w[stays], wy[stays], place[stays]
        goes = bins[at, among[place, k[place]]] > b[place]
        place = 2 * new[place] + goes
        open_ = children.ravel()
        total += len(open_)
        feature.append(np.full(len(open_), -1)), cut.append(np.zeros(len(open_), int)), value.append(means)
        left.append(open_.copy()), right.append(open_.copy())
    return tuple(np.concatenate(v) for v in (feature, cut, left, right, value))


def predicted(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    feature, cut, left, right, value = tree
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while (feature[at] >= 0).any():
        below = bins[rows, np.maximum(feature[at], 0)] <= cut[at]
        at = np.where(below, left[at], right[at])
    return value[at]


def tasks(spark, n: int) -> DataFrame:
    """(id): 0 to n, a partition for each."""
    return spark.range(n, numPartitions=n)


def alike(rows: DataFrame, n: int) -> DataFrame:
    """(x, part, ys): the outcomes of readings with equal exposures, about ``ALIKE`` in a row at most; ``n`` is the number of readings."""
    part = F.pmod(F.xxhash64("diary_id", "obs_id"), F.lit(max(1, -(-n // ALIKE))))
    return rows.groupBy("x", part.alias("part")).agg(F.array_sort(F.collect_list(F.coalesce("y", F.lit(float("nan"))))).alias("ys"))


def fitted(shared: DataFrame, rows: DataFrame, x: DataFrame, features: list[str], n: int, trees: int, seed: int) -> "Trees":
    """A forest on the ``n`` readings of ``rows``; ``shared`` is :func:`alike` of these."""
    if n * len(features) > WHOLE:
        return Trees(forest(trees, seed).fit(assembled(rows)).toDebugString)
    spark, edges = rows.sparkSession, edges_of(x, features)

    def run(batches):
        for pdf in batches:
            yield pdf[["key", "part", "ys"]].assign(bins=in_bins(pdf["x"], edges))

    keyed = shared.select(F.xxhash64("x").alias("key"), "part", "ys", "x")
    t = keyed.mapInPandas(run, "key long, part long, ys array<double>, bins binary").orderBy("key", "part").toArrow()
    times, y = t["ys"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False), t["ys"].combine_chunks().flatten().to_numpy()
    row = np.repeat(np.arange(len(times), dtype=np.int32), times) if len(y) > len(times) else None
    bins = as_matrix(t["bins"], len(features))
    del t
    held = spark.sparkContext.broadcast((bins, y, row))
    del bins, row

    def grow(batches):
        bins, y, row = held.value
        for pdf in batches:
            for chunk in pdf["id"]:
                for tree in range(chunk * CHUNK, min(trees, (chunk + 1) * CHUNK)):
                    yield pd.DataFrame([(tree, *(v.tolist() for v in grown(bins, y, [seed, tree], row)))], columns=["tree", "feature", "cut", "left", "right", "value"])

    schema = "tree int, feature array<int>, cut array<int>, left array<int>, right array<int>, value array<double>"
    # sorted here: Spark's sort would grow all trees once more to find its ranges
    made = sorted(tasks(spark, -(-trees // CHUNK)).mapInPandas(grow, schema).collect())
    return Trees.of([tuple(np.array(v) for v in r[1:]) for r in made], edges)


def cross_validate(observations: DataFrame, x: DataFrame, trees: int = 500, seed: int = 0) -> DataFrame:
    """(fold, n, r2): a forest for each 96-hour block, which no lag window spans, trained on the others.

    Tasks take some trees of a fold each and return their summed predictions of the fold's readings.
    """
    spark, names = observations.sparkSession, features_of(x)
    rows = wide(observations, x, names).persist()
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    if sum(sizes.values()) * len(names) > WHOLE:
        out = _validated_by_level(rows, sizes, trees, seed)
        rows.unpersist()
        return out
    folds, chunks = sorted(sizes), -(-trees // CHUNK)
    held = spark.sparkContext.broadcast(binned(rows, edges_of(x, names)))
    rows.unpersist()

    def validated(batches):
        for pdf in batches:
            for task in pdf["id"]:
                bins, y, fold = held.value
                i, chunk = divmod(int(task), chunks)
                test = fold == folds[i]
                train = ~test if len(folds) > 1 else test
                known, outcome, asked = bins[train], y[train], bins[test]
                mine = range(chunk * CHUNK, min(trees, (chunk + 1) * CHUNK))
                total = sum(predicted(grown(known, outcome, [seed, folds[i], tree]), asked) for tree in mine)
                yield pd.DataFrame({"fold": folds[i], "row": np.flatnonzero(test), "y": y[test], "p": total})

    if not folds:
        return spark.createDataFrame([], "fold int, n long, r2 double")
    said = tasks(spark, len(folds) * chunks).mapInPandas(validated, "fold int, row long, y double, p double")
    each = said.groupBy("fold", "row").agg(F.first("y").alias("y"), (F.sum("p") / trees).alias("p"))
    wrong = F.try_divide(F.sum(F.pow(F.col("y") - F.col("p"), 2)), F.var_pop("y") * F.count("*"))
    return each.groupBy("fold").agg(F.count("*").alias("n"), F.coalesce(1 - wrong, F.lit(float("nan"))).alias("r2")).orderBy("fold")


def _validated_by_level(rows: DataFrame, sizes: dict[int, int], trees: int, seed: int) -> DataFrame:
    v = assembled(rows)
    score, out = RegressionEvaluator(labelCol="y", metricName="r2"), []
    for fold in sorted(sizes):
        model = forest(trees, seed).fit(v.where(F.col("fold") != fold)) if len(sizes) > 1 else forest(trees, seed).fit(v)
        out.append((fold, sizes[fold], float(score.evaluate(model.transform(v.where(F.col("fold") == fold))))))
    return rows.sparkSession.createDataFrame(out, "fold int, n long, r2 double")


class Trees:
    """The trees of a fitted forest as arrays: a node's feature (-1 in leaves), threshold, children and value."""

    def __init__(self, described: str):
        feature, bound, left, right, value, roots, opened = [], [], [], [], [], [], []

        def node() -> int:
            for held, x in ((feature, -1), (bound, 0.0), (left, 0), (right, 0), (value, 0.0)):
                held.append(x)
            left[-1] = right[-1] = len(value) - 1
            return len(value) - 1

        def placed(at: int) -> int:
            """Hangs a new node where the text has come to: left of the innermost open split, or right once that is done."""
            if opened:
                parent, side = opened[-1]
                (left if side == 0 else right)[parent] = at
            else:
                roots.append(at)
            return at

        def done() -> None:
            while opened and opened[-1][1] == 1:
                opened.pop()

        for line in described.splitlines():
            if m := re.match(r"\s*If \(feature (\d+) <= (\S+)\)", line):
                at = placed(node())
                feature[at], bound[at] = int(m[1]), float(m[2])
                opened.append((at, 0))
            elif re.match(r"\s*Else \(", line):
                opened[-1] = (opened[-1][0], 1)
            elif m := re.match(r"\s*Predict: (\S+)", line):
                value[placed(node())] = float(m[1])
                done()
        self.feature, self.bound = np.array(feature, np.int32), np.array(bound)
        self.left, self.right, self.value, self.roots = np.array(left, np.int32), np.array(right, np.int32), np.array(value), np.array(roots, np.int32)

    @classmethod
    def of(cls, trees: list[tuple[np.ndarray, ...]], edges: list[np.ndarray]) -> "Trees":
        """From trees as :func:`grown` makes them and the bounds of the bins."""
        out = cls("")
        starts = np.cumsum([0, *(len(t[0]) for t in trees)])
        feature, cut = (np.concatenate([t[i] for t in trees]) for i in (0, 1))
        out.feature, out.bound = feature.astype(np.int32), np.array([edges[f][c] if f >= 0 else 0.0 for f, c in zip(feature, cut)])
        out.left, out.right = (np.concatenate([t[i] + s for t, s in zip(trees, starts)]).astype(np.int32) for i in (2, 3))
        out.value, out.roots = np.concatenate([t[4] for t in trees]), starts[:-1].astype(np.int32)
        return out

    @cached_property
    def plans(self) -> list[tuple[list[tuple], dict[int, int]]]:
        """(splits, holds) of each tree. holds: the features of the splits at and below a split, as bits. splits, from the root down:
        (node, feature, bound, left, right, start, between), where start is the node or the uppermost split above it by its feature, and
        between are the other features' splits from there on with the side taken (None: splits above by its feature decide this one)."""
        feature, bound, left, right = (v.tolist() for v in (self.feature, self.bound, self.left, self.right))
        out = []
        for root in self.roots.tolist():
            splits, holds, open_ = [], {}, [(root, ())]
            while open_:
                v, path = open_.pop()
                if feature[v] < 0:
                    continue
                f, b = feature[v], bound[v]
                own = [i for i, (u, _) in enumerate(path) if feature[u] == f]
                start, between = v, []
                if own:
                    start, between = path[own[0]][0], [(u, side) for u, side in path[own[0] :] if feature[u] != f]
                    if any((b >= bound[path[i][0]]) == path[i][1] for i in own):
                        between = None
                splits.append((v, f, b, left[v], right[v], start, between))
                open_ += [(right[v], (*path, (v, False))), (left[v], (*path, (v, True)))]
            for v, f, _, low, high, *_ in reversed(splits):
                holds[v] = 1 << f | holds.get(low, 0) | holds.get(high, 0)
            out.append((splits, holds))
        return out

    def each(self, x: np.ndarray, trees: np.ndarray) -> np.ndarray:
        """(rows, trees) predictions."""
        at, rows = np.repeat(self.roots[trees][None], len(x), axis=0), np.arange(len(x))[:, None]
        while (self.feature[at] >= 0).any():
            below = x[rows, np.maximum(self.feature[at], 0)] <= self.bound[at]
            at = np.where(below, self.left[at], self.right[at])
        return self.value[at]


def _by_class(model, features: list[int], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, classes, table): the trees' summed predictions; which of a feature's values, as its splits tell them apart, a row
    has, by (feature, row); and by how much its sum changes, by (feature, class, row), where only that feature changes.

    A tree's splits each look at all rows once: from the leaves up, what a row gets that comes to a split, and from the root
    down, which rows come there. Where a feature's value passes the bound of one of its splits, rows that come there change sides.
    So the work follows the splits, not the shuffles.
    """
    n, columns = len(x), np.ascontiguousarray(x.T)
    bounds = [np.unique(model.bound[model.feature == f]) for f in features]
    width = 1 + max(map(len, bounds), default=0)
    classes = np.array([np.searchsorted(v, columns[f]) for v, f in zip(bounds, features)], np.min_scalar_type(width)).reshape(-1, n)
    base, table = np.zeros(n), np.zeros((len(features), width, n))
    lines = {(f, b): table[q, k] for q, f in enumerate(features) for k, b in enumerate(bounds[q].tolist(), 1)}
    value, feature, bound_of, left_of, right_of = (v.tolist() for v in (model.value, model.feature, model.bound, model.left, model.right))
    for root, (splits, holds) in zip(model.roots.tolist(), model.plans):
        below, got, comes = {}, {}, {root: np.arange(n)}

        def forced(v, f, rows, lefts):
            """What rows get that come to ``v``, where splits by ``f`` send all to the left whose bound ``lefts`` takes, else to the right."""
            if not holds.get(v, 0) >> f & 1:
                return got[v][rows] if v in got else value[v]
            if feature[v] == f:
                return forced((left_of if lefts(bound_of[v]) else right_of)[v], f, rows, lefts)
            return np.where(below[v][rows], forced(left_of[v], f, rows, lefts), forced(right_of[v], f, rows, lefts))

        for v, f, bound, left, right, *_ in reversed(splits):
            below[v] = columns[f] <= bound
            got[v] = np.where(below[v], got.get(left, value[left]), got.get(right, value[right]))
        base += got.get(root, value[root])
        for v, f, bound, left, right, start, between in splits:
            rows, goes = comes[v], below[v][comes[v]]
            if left in got:
                comes[left] = rows[goes]
            if right in got:
                comes[right] = rows[~goes]
            line = lines.get((f, bound))
            if line is None or between is None:
                continue
            if start != v:
                rows = comes[start]
                for u, side in between:
                    rows = rows[below[u][rows] == side]
            if (holds.get(left, 0) | holds.get(right, 0)) >> f & 1:
                low, high = forced(left, f, rows, lambda b: bound <= b), forced(right, f, rows, lambda b: bound < b)
            else:
                low, high = (got[z][rows] if z in got else value[z] for z in (left, right))
            line[rows] += high - low
    for k in range(1, width):
        table[:, k] += table[:, k - 1]
    for q in range(len(features)):
        table[q] -= table[q][classes[q], np.arange(n)]
    return base, classes, table


def _losses(model, features: list[int], y: np.ndarray, x: np.ndarray, repeats: int, seed: int, row: np.ndarray | None = None) -> list[float]:
    """Growth of the squared error, summed over readings and repeats, where one feature is shuffled among the readings.

    ``row`` tells a reading's row of ``x``, where readings share rows. Only readings whose class changes are looked up.
    """
    n_trees, out = len(model.roots), []
    row = np.arange(len(x)) if row is None else row
    together = max(1, HELD // (8 * BINS * max(1, len(x))))
    for s in range(0, len(features), together):
        some = features[s : s + together]
        base, classes, table = _by_class(model, some, x)
        twice = 2 * (y - (base / n_trees)[row])
        for q, f in enumerate(some):
            r, lost, own, flat = np.random.default_rng([seed, f]), 0.0, classes[q][row], table[q].ravel()
            flat /= n_trees
            if flat.any():
                for _ in range(repeats):
                    drawn = own[r.permutation(len(y))]
                    at = np.flatnonzero(drawn != own)
                    changed = flat[drawn[at].astype(int) * len(x) + row[at]]
                    lost += float(changed @ (changed - twice[at]))
            out.append(lost)
    return out


def rank(observations: DataFrame, x: DataFrame, trees: int = 500, repeats: int = 100, seed: int = 0, limit: int = 15) -> DataFrame:
    """(feature, importance, exposed): the 15 features whose shuffling costs most R2, with their exposed readings.

    One forest on all features. Readings of equal exposures share a row, which goes through the trees once. Rows are dealt
    to random groups of about ``GROUP``, those of very many readings in several parts; a task takes a group and some features,
    shuffles each feature among the group's readings ``repeats`` times, and returns by how much the squared error grows. So
    no shuffle is global, and nothing but sums by feature reaches the driver.
    """
    spark = observations.sparkSession
    x = x.persist(StorageLevel.DISK_ONLY)  # executors' memory is for the trees
    names = features_of(x)
    total = observations.agg(F.count("*").alias("n"), (F.var_pop("y") * F.count("*")).alias("squares")).first()
    rows = wide(observations, x, names)
    shared = alike(rows, total["n"]).persist(StorageLevel.DISK_ONLY)
    sent = spark.sparkContext.broadcast(fitted(shared, rows, x, names, total["n"], trees, seed))
    most = max(1, 2 * total["n"] // max(1, shared.count()))
    pieces = shared.select("x", "part", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("ys") - 1).cast("int"), F.lit(most)), lambda i: F.slice("ys", i + 1, F.lit(most)))).alias("piece", "ys"))
    groups = max(1, -(-(shared.agg(F.sum(F.ceil(F.size("ys") / most))).first()[0] or 0) // GROUP))
    parts = max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism // groups))

    def lost(batches):
        found = [pdf for pdf in batches if len(pdf)]
        if not found:
            return
        pdf = pd.concat(found)
        part, group = int(pdf["task"].iloc[0]) % parts, int(pdf["task"].iloc[0]) // parts
        pdf = pdf.sort_values(["key", "part", "piece"])
        mine = list(range(part, len(names), parts))
        y, row = np.concatenate(pdf["ys"].to_numpy()), np.repeat(np.arange(len(pdf)), pdf["ys"].map(len))
        yield pd.DataFrame({"feature": [names[f] for f in mine], "lost": _losses(sent.value, mine, y, np.stack(pdf["x"].to_numpy()), repeats, seed + group, row)})

    group = F.pmod(F.xxhash64("x", "part", "piece", F.lit(seed)), F.lit(groups)).cast("int")
    dealt = pieces.select(F.xxhash64("x").alias("key"), "part", "piece", "ys", "x", F.explode(F.sequence(group * parts, group * parts + (parts - 1))).alias("task"))
    sums = dealt.repartitionById(groups * parts, "task").mapInPandas(lost, "feature string, lost double").groupBy("feature").agg(F.sum("lost").alias("lost"))
    counts = x.groupBy("feature").agg(F.count_if(F.col("x") > 0).alias("exposed"))
    share = F.when(F.lit(total["squares"] or 0.0) > 0, F.col("lost") / F.lit((total["squares"] or 1.0) * repeats)).otherwise(0.0)
    return sums.join(counts, "feature").select("feature", share.alias("importance"), "exposed").orderBy(F.desc("importance"), "feature").limit(limit)
