"""Boosted regression trees grown leaf by leaf, over histograms of gradients.

Features are cut into at most 254 bins once, in a table that rounds and trials share: a byte for each feature of a row, 0 for
missing values, which go left. A round fits one tree to the gradients of squared error. Tasks route their rows down the tree
so far and add up gradients and rows by leaf, feature and bin; Spark sums these cells; the driver, which holds cells and leaves
alone, finds each leaf's best split. The best leaf is split first, until there are `leaves` of them. Which splits come first
depends on gains alone, so that all leaves that may be among the next are measured in one pass, and a tree takes about as
many passes as it is deep; splits that turn out not to be among the best are dropped again.

Passes read rows in blocks (`packed`): a Spark row is the columns of BLOCK rows, so that what Spark hands to Python costs bytes, not rows.

Gradients are rounded to whole numbers of a fixed scale: their sums have no order, and equal seeds give equal trees whatever
the partitions are. Rows and features are sampled by hashes of key, round and seed. The margins of training and validation
rows are columns, written anew every KEPT rounds with the trees since; boosting stops `patience` rounds after the best
validation error, and goes on from a saved model as if it had never stopped.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.files import Scratch, scratch

KEPT = 8
#: Gradients become whole numbers of at most so many bits.
BITS = 30
#: Rows of a block, and bytes of blocks that a reader holds at a time.
BLOCK, HELD = 1 << 13, 16 << 20
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class Settings:
    rounds: int = 400
    rate: float = 0.05
    leaves: int = 255
    depth: int = 64
    least_rows: int = 30
    features: float = 0.9
    rows: float = 0.8
    l1: float = 0.05
    l2: float = 0.05
    bins: int = 254
    seed: int = 42
    patience: int = 50


@dataclass
class Grown:
    """A tree by columns: a node's feature (-1: leaf), last bin that goes left, children, value, gain and rows."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, gain: float) -> tuple[int, int]:
        a = len(self.feature)
        for column, new in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
            column.extend([new, new])
        self.feature[node], self.bin[node], self.left[node], self.right[node], self.gain[node] = feature, bin_, a, a + 1, gain
        return a, a + 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins: nodes part their rows, so that each is looked at once a level."""
        at = np.zeros(len(bins), np.int64)
        waiting: list[tuple[int, np.ndarray | None]] = [(0, None)]
        while waiting:
            node, rows = waiting.pop()
            if self.feature[node] >= 0:
                column = bins[:, self.feature[node]]
                goes = (column if rows is None else column[rows]) <= self.bin[node]
                parts = (np.flatnonzero(goes), np.flatnonzero(~goes)) if rows is None else (rows[goes], rows[~goes])
                waiting += [(to, x) for to, x in zip((self.left[node], self.right[node]), parts) if len(x)]
            elif rows is not None:
                at[rows] = node
        return at

    def of(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass
class Boosted:
    """edges: by feature; errors: of the validation rows by round; best: rounds that predictions use."""

    features: list[str]
    edges: list[list[float]]
    base: float
    scale: float
    settings: Settings
    trees: list[Grown] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    best: int = 0

    @property
    def getNumTrees(self) -> int:  # noqa: N802  as MLlib's models call it
        return self.best

    def binned(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(values.shape, np.uint8)
        for k, edges in enumerate(self.edges):
            known = ~np.isnan(values[:, k])
            out[known, k] = 1 + np.searchsorted(np.array(edges), values[known, k], side="left")
        return out

    def gains(self) -> np.ndarray:
        out = np.zeros(len(self.features))
        for tree in self.trees[: self.best]:
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    out[f] += g
        return out / (out.sum() or 1.0)

    def dumped(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def loaded(text: str) -> Boosted:
        held = json.loads(text)
        return Boosted(**held | {"settings": Settings(**held["settings"]), "trees": [Grown(**t) for t in held["trees"]]})

    def transform(self, df: DataFrame) -> DataFrame:
        """df with its prediction."""
        shared, columns = df.sparkSession.sparkContext.broadcast(self), df.columns
        held = df.select("*", F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in self.features]).alias("of all features"))

        def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                bins = model.binned(_matrix(batch.column(batch.num_columns - 1), len(model.features)))
                out = np.full(len(bins), model.base)
                for tree in model.trees[: model.best]:
                    out += tree.of(bins)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*columns, "prediction"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return held.mapInArrow(predicted, f"{fields}, prediction double")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def uniform(draws: np.ndarray, *salts: int) -> np.ndarray:
    """A number from 0 to 1 of each draw (64 bits), by the salts."""
    x = draws.astype(np.uint64)
    for salt in salts:
        x = x + np.uint64((salt + 1) * int(MIX[0]) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * MIX[1]
        x = (x ^ (x >> np.uint64(27))) * MIX[2]
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)) / float(1 << 53)


def edges_of(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Values between the bins of each feature, by quantiles; one aggregation over all features."""
    shares = F.array(*[F.lit((k + 1) / bins) for k in range(bins - 1)])
    found = df.agg(*[F.percentile_approx(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), shares, 10_000).alias(str(k)) for k, c in enumerate(features)]).first()
    return [sorted(set(found[str(k)] or [])) for k in range(len(features))]


def prepared(df: DataFrame, features: Sequence[str], target: str = "target", key: str = "_org_idx", settings: Settings = Settings()) -> Boosted:
    """A model without trees: bins, mean target, scale of gradients."""
    y = F.col(f"`{target}`").cast("double")
    mean, least, most = df.agg(F.avg(y), F.min(y), F.max(y)).first()
    if mean is None:
        raise ValueError("no rows with a target")
    apart = max(most - mean, mean - least) or 1.0
    return Boosted(list(features), edges_of(df, features, settings.bins), mean, 2.0 ** (BITS - np.ceil(np.log2(apart))), settings)


def table(df: DataFrame, model: Boosted, target: str = "target", key: str = "_org_idx") -> DataFrame:
    """draw (a hash of the key), y, bins (a byte for each feature) and margin of the rows with a target."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    values = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in model.features])
    held = df.filter(F.col(f"`{target}`").isNotNull()).select(F.xxhash64(F.col(f"`{key}`")).alias("draw"), F.col(f"`{target}`").cast("double").alias("y"), values.alias("x"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = shared.value.binned(_matrix(batch.column(2), len(shared.value.features)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.tobytes() for b in bins], pa.binary()), pa.array(np.full(len(bins), shared.value.base))], ["draw", "y", "bins", "margin"])

    return held.mapInArrow(cut, "draw long, y double, bins binary, margin double")


COLUMNS = ("draw", "y", "bins", "margin")
PACKED = ", ".join(f"{c} binary" for c in COLUMNS)


def packed(rows: DataFrame) -> DataFrame:
    """Rows of `table` in blocks, each column of a block as bytes (bins by feature), dealt evenly; blocks stay as they are."""
    if dict(rows.dtypes)["y"] == "binary":
        return rows

    def block(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        draw, y, bins, margin = pa.Table.from_batches(some).combine_chunks().columns
        bins = np.frombuffer(b"".join(bins.to_pylist()), np.uint8).reshape(len(y), -1)
        return _block(draw.to_numpy(), y.to_numpy(), bins, margin.to_numpy())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - n)
                batch, n = batch.slice(len(part)), n + len(part)
                held.append(part)
                if n == BLOCK:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return rows.select(*COLUMNS).mapInArrow(pack, PACKED).repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def _block(*columns: np.ndarray) -> pa.RecordBatch:
    """draw, y, bins (a row for each row) and margin as one row of bytes."""
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c.T).tobytes()], pa.binary()) for c in columns], list(COLUMNS))


def _blocks(batches: Iterator[pa.RecordBatch], trees: Sequence[Grown]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """draw, y, bins and margin of each block, with the trees added to the margins."""
    for batch in batches:
        for row in zip(*batch.columns):
            draw, y, bins, margin = (np.frombuffer(c.as_buffer(), kind) for c, kind in zip(row, (np.int64, np.float64, np.uint8, np.float64)))
            bins = bins.reshape(-1, len(y)).T
            for tree in trees:
                margin = margin + tree.of(bins)
            yield draw, y, bins, margin


def _kept(rows: DataFrame, tables: Scratch) -> DataFrame:
    return tables.keep(rows, {"parquet.block.size": str(HELD)})


def cells(rows: DataFrame, trees: Sequence[Grown], tree: Grown, asked: Sequence[int], number: int, model: Boosted) -> np.ndarray:
    """[leaf asked for, feature, bin, (rows, sum of gradients)] of a pass over the rows that this round draws."""
    width, s, scale = len(model.features), model.settings, model.scale
    shared = rows.sparkSession.sparkContext.broadcast((list(trees), tree, list(asked)))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        since, now, wanted = shared.value
        slot = np.full(len(now.feature), -1)
        slot[wanted] = np.arange(len(wanted))
        n, g = (np.zeros((width, len(wanted) * 256), np.int64) for _ in range(2))
        for draw, y, bins, margin in _blocks(batches, since):
            at = slot[now.leaf_of(bins)]
            here = np.flatnonzero(at >= 0)
            if s.rows < 1:
                here = here[uniform(draw[here], s.seed, number) < s.rows]
            at, slope = at[here] * 256, np.rint((margin[here] - y[here]) * scale)
            for f in range(width):
                place = at + bins[here, f]
                n[f] += np.bincount(place, minlength=n.shape[1])
                # doubles hold sums of a block exactly: whole numbers far below 2^53
                g[f] += np.bincount(place, slope, n.shape[1]).astype(np.int64)
        n, g = (x.reshape(width, -1, 256).swapaxes(0, 1).ravel() for x in (n, g))
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(g[used])], ["cell", "n", "g"])

    sums = rows.mapInArrow(added, "cell long, n long, g long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    out = np.zeros((len(asked) * width * 256, 2), np.int64)
    found = sums.toArrow()
    out[found.column("cell").to_numpy()] = np.stack([found.column("n").to_numpy(), found.column("g").to_numpy()], axis=1)
    return out.reshape(len(asked), width, 256, 2)


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    bin: int


def best_split(cell: np.ndarray, s: Settings, scale: float, allowed: np.ndarray) -> Split | None:
    """The split with the greatest gain of a leaf's [feature, bin, (rows, gradients)]; ties by feature and bin."""
    n, g = cell[..., 0].cumsum(axis=1), cell[..., 1].cumsum(axis=1)
    all_n, all_g = n[:, -1:], g[:, -1:]
    worth = lambda count, slope: shrunk(slope / scale, s.l1) ** 2 / (count + s.l2 + 1e-300)
    gain = worth(n, g) + worth(all_n - n, all_g - g) - worth(all_n, all_g)
    usable = (n >= max(1, s.least_rows)) & (all_n - n >= max(1, s.least_rows)) & allowed[:, None]
    gain = np.where(usable, gain, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return Split(float(gain[f, b]), int(f), int(b)) if gain[f, b] > 1e-12 else None


def grown(rows: DataFrame, trees: Sequence[Grown], number: int, model: Boosted, measure: Callable[..., np.ndarray] = cells) -> Grown:
    """One tree, best leaf first."""
    rows = packed(rows)
    s, width = model.settings, len(model.features)
    drawn = np.argsort(uniform(np.arange(width), s.seed, number, 1), kind="stable")[: max(1, round(width * s.features))]
    allowed = np.isin(np.arange(width), drawn)
    tried, splits, sums, depth = Grown(), {}, {}, {0: 0}
    asked = [0]
    while asked:
        found = measure(rows, trees, tried, asked, number, model)
        for node, cell in zip(asked, found):
            sums[node] = cell[0].sum(axis=0)
            splits[node] = best_split(cell, s, model.scale, allowed) if depth[node] < s.depth else None
        # the leaves that come next if what isn't measured yet comes last
        asked, leaves, order = [], 1, []
        waiting = [0]
        while leaves < s.leaves and (able := [n for n in waiting if splits.get(n)]):
            node = max(able, key=lambda n: (splits[n].gain, -n))
            waiting.remove(node)
            order.append(node)
            leaves += 1
            if tried.feature[node] < 0:
                parts = tried.split(node, splits[node].feature, splits[node].bin, splits[node].gain)
                depth |= dict.fromkeys(parts, depth[node] + 1)
                asked += parts
            waiting += [n for n in (tried.left[node], tried.right[node]) if n in splits]
    out, where = Grown(), {0: 0}
    for node in order:
        where[tried.left[node]], where[tried.right[node]] = out.split(where[node], tried.feature[node], tried.bin[node], tried.gain[node])
    for node, at in where.items():
        if out.feature[at] < 0:
            n, g = sums[node]
            out.value[at] = float(-s.rate * shrunk(np.array(g / model.scale), s.l1) / (n + s.l2)) if n else 0.0
    return out


def moved(rows: DataFrame, trees: Sequence[Grown], tables: Scratch) -> DataFrame:
    """rows with the trees added to their margins."""
    shared = rows.sparkSession.sparkContext.broadcast(list(trees))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, shared.value):
            yield _block(*block)

    return _kept(rows.mapInArrow(added, PACKED), tables)


def root_error(rows: DataFrame, trees: Sequence[Grown]) -> float:
    """Root of the mean squared error of the margins with the trees added."""
    shared = rows.sparkSession.sparkContext.broadcast(list(trees))

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, y, _, margin in _blocks(batches, shared.value):
            yield pa.RecordBatch.from_arrays([pa.array([float(((margin - y) ** 2).sum())]), pa.array([len(y)], pa.int64())], ["squares", "n"])

    total, n = rows.mapInArrow(squares, "squares double, n long").agg(F.sum("squares"), F.sum("n")).first()
    return (total / n) ** 0.5 if n else float("nan")


def boosted(rows: DataFrame, model: Boosted, valid: DataFrame | None = None, after: Callable[[Boosted], None] = lambda m: None) -> Boosted:
    """Adds trees to the model, from where it stands, until there are `rounds` or `patience` of them brought nothing.

    rows, valid: of `table`, with the base as margin, or `packed`. after: is called with the model every KEPT rounds, and may save it.
    """
    s = model.settings
    with scratch(rows.sparkSession) as tables:
        rows, valid = (x if x is None or packed(x) is x else _kept(packed(x), tables) for x in (rows, valid))
        if model.trees:
            rows, valid = moved(rows, model.trees, tables), moved(valid, model.trees, tables) if valid is not None else None
        since: list[Grown] = []
        if valid is None:
            stop = lambda: False
        else:
            stop = lambda: bool(model.errors) and len(model.errors) - 1 - int(np.argmin(model.errors)) >= s.patience
        while len(model.trees) < s.rounds and not stop():
            tree = grown(rows, since, len(model.trees), model)
            model.trees.append(tree)
            since.append(tree)
            if valid is not None:
                model.errors.append(root_error(valid, since))
            if len(since) == KEPT:
                rows, valid, since = moved(rows, since, tables), moved(valid, since, tables) if valid is not None else None, []
                after(model)
    model.best = int(np.argmin(model.errors)) + 1 if valid is not None and model.errors else len(model.trees)
    after(model)
    return model


def fit(train: DataFrame, features: Sequence[str], settings: Settings = Settings(), valid: DataFrame | None = None, target: str = "target", key: str = "_org_idx") -> Boosted:
    """A model of training rows; with validation rows it keeps the rounds up to the best one."""
    with scratch(train.sparkSession) as tables:
        model = prepared(train, features, target, key, settings)
        rows = _kept(packed(table(train, model, target, key)), tables)
        return boosted(rows, model, None if valid is None else _kept(packed(table(valid, model, target, key)), tables))


def with_settings(model: Boosted, **changed: object) -> Boosted:
    """The model's bins without its trees, under other settings: bins are shared by trials."""
    return Boosted(model.features, model.edges, model.base, model.scale, replace(model.settings, **changed))


def trials(train: DataFrame, valid: DataFrame, features: Sequence[str], drawn: Sequence[Mapping[str, object]], settings: Settings = Settings(),
           place: str | None = None, at_once: int = 4, target: str = "target", key: str = "_org_idx") -> DataFrame:
    """(trial, params, rounds, rmse) of each set of settings, on the target's scale.

    Bins are made once. At most `at_once` trials run side by side, each in a scheduler pool of its own, and a trial's result
    depends on none of the others. With a place each result is written there when its trial ends, and trials whose result
    is there already aren't run again.
    """
    spark = train.sparkSession
    sc = spark.sparkContext
    with scratch(spark) as tables:
        bins = prepared(train, features, target, key, settings)
        rows, held = (_kept(packed(table(df, bins, target, key)), tables) for df in (train, valid))

        def run(number: int, params: Mapping[str, object]) -> tuple[int, str, int, float]:
            said = json.dumps(dict(params), sort_keys=True)
            path = f"{place}/{hashlib.md5(f'{number} {said} {settings}'.encode()).hexdigest()}" if place else None
            if path:
                done = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
                if done.getFileSystem(sc._jsc.hadoopConfiguration()).exists(done):
                    return tuple(spark.read.schema("trial int, params string, rounds int, rmse double").json(path).first())
            sc.setLocalProperty("spark.scheduler.pool", f"trial {number % at_once}")
            model = boosted(rows, with_settings(bins, **params), held)
            result = (number, said, model.best, model.errors[model.best - 1])
            if path:
                spark.createDataFrame([result], "trial int, params string, rounds int, rmse double").coalesce(1).write.mode("overwrite").json(path)
            return result

        with ThreadPoolExecutor(at_once) as pool:
            waiting = [pool.submit(inheritable_thread_target(spark)(run), k, params) for k, params in enumerate(drawn)]
            found = [w.result() for w in waiting]
    return spark.createDataFrame(found, "trial int, params string, rounds int, rmse double").orderBy("rmse", "trial")
