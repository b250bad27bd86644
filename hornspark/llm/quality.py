"""Quality classification by co-training a text view and a page-metadata view.

Two logistic classifiers are fitted to the labelled rows, one on what a text holds and one
on the columns around it.  In every round each view scores the whole unlabelled corpus and
hands the rows it is most sure of to the other as pseudo-labels.  Both are calibrated on
labelled rows that the scored fit has not seen, and a row's log odds are the sum of both
views' over the prior.  Quality and toxicity are separate targets; a row that fails either
is rejected.

1. A bounded sample of the labelled rows (``SAMPLE``, by a hash of the id) is counted: for
   each feature, how many rows of each label hold it.  The most telling ones are the
   vocabulary (``VOCABULARY``).
2. One pass over all texts keeps each row's features in the vocabulary, as short lists in
   the shared folder.  All further rounds, and the scores, read these lists.
3. A round is two jobs: all rows of the corpus are scored, and each view of each target is
   fitted in a task of its own to the sample and what it was handed.  Nothing but the views
   comes back to the driver.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import arrow_batches, cut, fresh, table
from ._words import IS_SPACE, hash_words, mix, sub_batches, text_bytes, tokens_of

#: Labelled rows to fit on at most, by expectation (a hash threshold picks them).
SAMPLE = 8000
#: Labelled rows that must hold a feature, and features of a view at most.
LEAST_ROWS, VOCABULARY = 3, 4096
ROUNDS = 3
#: A view is sure of a row from this probability on, and hands over so many of a class a round,
#: the surest of the whole corpus.
SURE, HANDED = 0.98, 300
#: Parts of the labelled rows; each is scored for calibration by a fit to the others.
FOLDS = 3
THRESHOLD = 0.5
#: Likelihood ratio from which on a feature counts as telling (chi square of 1 degree, 1 in a
#: million); so many of the best are taken whatever theirs is, and so many at most.
TELLING, LEAST_FEATURES, MOST_FEATURES = 23.9, 16, 256
#: Ridge of the weights: the penalty keeps features of few rows small.
RIDGE = 1.0

#: Classes of bytes: 0 white space, 1 letters and digits (all of UTF-8 beyond ASCII), 2 the rest.
BYTE_CLASS = np.full(256, 2, np.uint8)
BYTE_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
BYTE_CLASS[IS_SPACE] = 0
#: Shape features get ids that token hashes do not: their hash of a small number.
SHAPES = ("repeat", "upper", "symbol", "distinct")
BINS = 8
#: Bytes of a word's start that are features too, for words that are longer.
STARTS = (4, 6, 8)
META = ("lang", "source", "n_chars")
VIEWS = ("text", "meta")


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature ids of each text, text by text, and the texts' bounds among them.

    Features are the tokens (runs of letters and digits, or of symbols, in lower case), the
    starts of longer words, and the binned shares of repeated tokens and distinct tokens
    (eighths) and of capitals and symbols (powers of two)."""
    tokens = tokens_of(column, BYTE_CLASS)
    n = len(tokens.first) - 1
    count = np.diff(tokens.first)
    row = np.repeat(np.arange(n), count)
    again = np.zeros(len(row), bool)
    again[1:] = (tokens.ids[1:] == tokens.ids[:-1]) & (row[1:] == row[:-1])
    r, t = distinct(row, tokens.ids)
    different = np.bincount(r, minlength=n)
    parts = [(r, t)]
    for k in STARTS:
        long = np.flatnonzero(tokens.ends - tokens.starts > k)
        starts = hash_words(tokens.data, tokens.starts[long], tokens.starts[long] + k)
        parts.append(distinct(row[long], mix(starts ^ np.uint64(k))))
    data, offsets = text_bytes(column)
    per_text = lambda flags: np.diff(np.append(0, np.cumsum(flags))[offsets])
    size = np.maximum(np.diff(offsets), 1)
    eighths = lambda s: np.minimum((s * BINS).astype(np.int64), BINS - 1)
    powers = lambda s: np.clip(BINS + np.floor(np.log2(np.maximum(s, 2.0**-BINS))), 0, BINS - 1).astype(np.int64)
    shares = (
        eighths(np.bincount(row, again, n) / np.maximum(count, 1)),
        powers(per_text((data >= 65) & (data <= 90)) / size),
        powers(per_text(BYTE_CLASS[data] == 2) / size),
        eighths(different / np.maximum(count, 1)),
    )
    shape = [mix(np.uint64(1 + k * BINS) + s.astype(np.uint64)) for k, s in enumerate(shares)]
    rows = np.concatenate([*[r for r, _ in parts], np.tile(np.arange(n), len(SHAPES))])
    ids = np.concatenate([*[t for _, t in parts], *shape])
    order = np.argsort(rows, kind="stable")
    return ids[order], np.searchsorted(rows[order], np.arange(n + 1))


def distinct(row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids of each row."""
    order = np.lexsort((ids, row))
    r, t = row[order], ids[order]
    new = np.append(True, (r[1:] != r[:-1]) | (t[1:] != t[:-1])) if len(r) else np.zeros(0, bool)
    return r[new], t[new]


def name_ids(names: list[str]) -> np.ndarray:
    raw = [x.encode("utf-8", "surrogatepass") for x in names]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    return hash_words(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends) if raw else np.zeros(0, np.uint64)


def meta_features(batch: pa.RecordBatch, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of each row's metadata, one a column, and the bounds: numbers by their power
    of two, others by value, null as a value of its own."""
    n, out = batch.num_rows, []
    for c in columns:
        col = batch.column(c)
        if pa.types.is_integer(col.type) or pa.types.is_floating(col.type):
            v = np.abs(col.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False))
            with np.errstate(divide="ignore", invalid="ignore"):
                power = np.where(np.isfinite(v) & (v >= 1), np.floor(np.log2(v)), -1)
            power[pc.is_null(col).to_numpy(zero_copy_only=False)] = -2
            values, place = np.unique(power, return_inverse=True)
            names = [f"2^{int(x)}" if x >= 0 else "0" if x == -1 else "None" for x in values]
        else:
            seen: dict[str, int] = {}
            place = np.array([seen.setdefault(str(x), len(seen)) for x in col.to_pylist()], np.int64)
            names = list(seen)
        out.append(name_ids([f"{c}={x}" for x in names])[place] if n else np.zeros(0, np.uint64))
    return np.stack(out, 1).ravel() if out else np.zeros(0, np.uint64), np.arange(n + 1) * len(columns)


# --------------------------------------------------------------------------- the classifiers


@dataclass
class Rows:
    """Sparse binary rows over the columns 0 to width - 1."""

    index: np.ndarray
    bounds: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.bounds)[rows]
        ends = np.append(0, np.cumsum(size))
        at = np.arange(ends[-1], dtype=np.int64)
        at += np.repeat(self.bounds[:-1][rows] - ends[:-1], size)
        return Rows(self.index[at], ends, self.width)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))

    def times(self, w: np.ndarray) -> np.ndarray:
        """Each row's sum by itself: equal rows have equal sums, whatever the batch."""
        return np.bincount(self.owner(), w[self.index], len(self)) if len(self) else np.zeros(0)

    def dense(self, columns: np.ndarray) -> np.ndarray:
        place = np.full(self.width, -1)
        place[columns] = np.arange(len(columns))
        out = np.zeros((len(self), len(columns)))
        known = place[self.index] >= 0
        out[self.owner()[known], place[self.index[known]]] = 1
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def likelihood_ratio(n: float, pos: float, has: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Likelihood ratio statistic of presence against label: ``has`` rows hold the feature, ``both`` of them positive."""
    g = np.zeros(len(has))
    for seen, row, column in ((both, has, pos), (has - both, has, n - pos), (pos - both, n - has, pos), (n - pos - has + both, n - has, n - pos)):
        with np.errstate(divide="ignore", invalid="ignore"):
            g += np.where(seen > 0, 2 * seen * np.log(seen * n / (row * column)), 0.0)
    return g


def telling(x: Rows, y: np.ndarray) -> np.ndarray:
    """The columns to fit: those whose presence depends on the label, the best ones at least."""
    has = np.bincount(x.index, minlength=x.width)
    g = likelihood_ratio(len(y), float(y.sum()), has, np.bincount(x.index, y[x.owner()], x.width))
    order = np.argsort(-np.round(g, 9), kind="stable")
    order = order[has[order] > 0]
    return np.sort(order[: min(MOST_FEATURES, max(LEAST_FEATURES, int((g >= TELLING).sum())))])


def fit_logistic(x: Rows, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (ridge, none for the intercept) and intercept by Newton's method with step halving."""
    columns = telling(x, y)
    d = np.hstack([x.dense(columns), np.ones((len(x), 1))])
    ridge = np.append(np.full(len(columns), RIDGE), 1e-6)
    loss = lambda b: np.logaddexp(0, np.where(y > 0, -1, 1) * (d @ b)).sum() + (ridge * b * b).sum() / 2
    beta = np.zeros(len(ridge))
    now = loss(beta)
    for _ in range(30):
        p = sigmoid(d @ beta)
        g = d.T @ (p - y) + ridge * beta
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag(ridge), g)
        size = 1.0
        while (after := loss(beta - size * step)) > now and size > 1e-4:
            size /= 2
        beta, gain, now = beta - size * step, now - after, after
        if gain < 1e-9 * max(1.0, now):
            break
    w = np.zeros(x.width)
    w[columns] = beta[:-1]
    return w, float(beta[-1])


def fit_platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn scores into log odds, with Platt's smoothed targets."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps, damped by a small ridge
        p = sigmoid(a * z + b)
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if abs(step).max() < 1e-6:
            break
    if a > 0:
        return a, b
    return 0.0, math.log((pos + 0.5) / (neg + 0.5))  # a view that points the wrong way is worth nothing but the prior


@dataclass
class View:
    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def log_odds(self, x: Rows) -> np.ndarray:
        return self.slope * (x.times(self.weights) + self.intercept) + self.shift


@dataclass
class CoTrained:
    """Both views of one target (probability of 1), or the prior alone."""

    prior: float
    views: list[View] = field(default_factory=list)

    def log_odds(self, xs: list[Rows], rows: int) -> np.ndarray:
        out = np.full(rows, self.prior)
        for view, x in zip(self.views, xs, strict=False):
            out += view.log_odds(x) - self.prior
        return out


def prior_of(y: np.ndarray) -> CoTrained:
    return CoTrained(math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0)


def both_kinds(y: np.ndarray) -> bool:
    return min(y.sum(), len(y) - y.sum()) >= 2


def fit_view(x: Rows, y: np.ndarray, labelled: int) -> View:
    """A view fitted to all rows, of which the first ``labelled`` are, and the others
    pseudo-labelled; calibrated on the labelled ones, each scored without its fold."""
    view = View(*fit_logistic(x, y))
    fold = np.where(np.arange(len(y)) < labelled, np.arange(len(y)) % FOLDS, -1)
    z = x.take(np.arange(labelled)).times(view.weights) + view.intercept
    if all(both_kinds(y[fold != f]) for f in range(FOLDS)):
        for f in range(FOLDS):
            rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            w, b = fit_logistic(x.take(rest), y[rest])
            z[own] = x.take(own).times(w) + b
    view.slope, view.shift = fit_platt(z, y[:labelled])
    return view


def surest(odds: np.ndarray, label: int, free: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The rows that a view hands over with ``label``: sure ones of the free, by sureness, then ``tie``."""
    sure = np.round(sigmoid(odds if label else -odds), 9)
    at = np.flatnonzero(free & (sure >= SURE))
    return at[np.lexsort((tie[at], -sure[at]))][:HANDED]


def co_train(xs: list[Rows], y: np.ndarray) -> CoTrained:
    """Co-training in memory, as ``train`` does it over tables.  ``y``: 0 or 1 of the labelled
    rows, which come first; the others are the pool."""
    n = len(y)
    out = prior_of(y)
    if not both_kinds(y):
        return out
    pool = np.arange(n, len(xs[0]))
    given: list[dict[int, int]] = [{}, {}]  # pseudo-labels that each view was handed
    for r in range(ROUNDS + 1):
        out.views = []
        for x, extra in zip(xs, given, strict=True):
            rows = np.append(np.arange(n), np.array(list(extra), np.int64))
            out.views.append(fit_view(x.take(rows), np.append(y, np.array(list(extra.values()), np.float64)), n))
        if r == ROUNDS:
            break
        for k, (view, x) in enumerate(zip(out.views, xs, strict=True)):
            odds = view.log_odds(x.take(pool))
            for label in (1, 0):
                free = np.array([int(i) not in given[1 - k] for i in pool], bool)
                given[1 - k].update({int(pool[i]): label for i in surest(odds, label, free, pool)})
    return out


# --------------------------------------------------------------------------- the model


@dataclass
class Model:
    """The vocabularies of both views (sorted feature ids), and the targets' classifiers."""

    tables: list[np.ndarray]
    targets: dict[str, CoTrained]

    def rows(self, view: int, ids: np.ndarray, bounds: np.ndarray) -> Rows:
        known_ids = self.tables[view]
        at = np.searchsorted(known_ids, ids)
        known = at < len(known_ids)
        known[known] = known_ids[at[known]] == ids[known]
        return Rows(at[known].astype(np.int32), np.append(0, np.cumsum(known))[bounds], len(known_ids))

    def views_of(self, batch: pa.RecordBatch, text: str, meta: list[str]) -> list[Rows]:
        return [self.rows(0, *text_features(batch.column(text))), self.rows(1, *meta_features(batch, meta))]

    def verdict(self, xs: list[Rows], rows: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Each target's probability, and whether a row is rejected (a prior alone rejects nothing)."""
        ps, bad = [], np.zeros(rows, bool)
        for t, c in self.targets.items():
            p = sigmoid(c.log_odds(xs, rows))
            if c.views:
                bad |= p >= THRESHOLD if t == "toxic" else p < THRESHOLD
            ps.append(p)
        return ps, bad


def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and bounds of a list column."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(), bounds - bounds[0]


def list_array(x: Rows) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(x.bounds, pa.int32()), pa.array(x.index, pa.int32()))


def marked(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, meta: list[str], targets: list[str], sample: int) -> DataFrame:
    """(_id, text, m_<meta>, _in, _<target>): all rows; those of the labelled sample with their labels."""
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*[F.max(t).cast("int").alias(f"_{t}") for t in targets])
    part = F.pmod(F.xxhash64(F.col("_id"), F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    chosen = marks.filter(part < sample / max(1, marks.count())).withColumn("_in", F.lit(True))
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"m_{c}") for c in meta])
    return slim.join(F.broadcast(cut(chosen)), "_id", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))  # `sample` rows of ints


def ratio_column(n: float, pos: float, has: Column, both: Column) -> Column:
    cells = ((both, has, pos), (has - both, has, n - pos), (F.lit(pos) - both, F.lit(n) - has, pos), (F.lit(n - pos) - has + both, F.lit(n) - has, n - pos))
    return sum((F.when(o > 0, 2 * o * F.log(o * n / (r * c))).otherwise(0.0) for o, r, c in cells), F.lit(0.0))


def vocabularies(rows: DataFrame, meta: list[str], targets: list[str], size: int = VOCABULARY) -> list[np.ndarray]:
    """The features of each view that tell most about any target in the labelled sample."""
    counted = ["n", *[f"{k}_{t}" for t in targets for k in ("n", "p")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in sub_batches(big, 256):
                y = [b.column(f"_{t}").cast(pa.float64()).to_numpy(zero_copy_only=False) for t in targets]
                weights = [np.ones(b.num_rows), *[w for v in y for w in (~np.isnan(v), np.nan_to_num(v) > 0)]]
                named = b.select([f"m_{c}" for c in meta]).rename_columns(meta)
                for view, (ids, bounds) in enumerate((text_features(b.column("text")), meta_features(named, meta))):
                    owner = np.repeat(np.arange(b.num_rows), np.diff(bounds))
                    values, place = np.unique(ids, return_inverse=True)
                    sums = [np.bincount(place, w[owner].astype(float), len(values)).astype(np.int64) for w in weights]
                    yield out(np.full(len(values), view), values.view(np.int64), sums)
                yield out(np.array([-1]), np.zeros(1, np.int64), [np.array([int(w.sum())]) for w in weights])  # the totals

    def out(view: np.ndarray, fid: np.ndarray, sums: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(view, pa.int32()), pa.array(fid, pa.int64()), *[pa.array(s, pa.int64()) for s in sums]], ["view", "fid", *counted])

    arrow_batches(rows.sparkSession)
    stats = rows.filter("_in").mapInArrow(run, "view int, fid long, " + ", ".join(f"{c} long" for c in counted))
    stats = cut(stats.groupBy("view", "fid").agg(*[F.sum(c).alias(c) for c in counted]))
    total = stats.filter("view = -1").first()
    if total is None:
        return [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    scores = [ratio_column(float(total[f"n_{t}"]), float(total[f"p_{t}"]), F.col(f"n_{t}"), F.col(f"p_{t}")) for t in targets]
    best = stats.filter(F.col("n") >= LEAST_ROWS).withColumn("g", F.round(F.greatest(*scores) if len(scores) > 1 else scores[0], 9))
    out = []
    for view in range(len(VIEWS)):
        top = best.filter(F.col("view") == view).orderBy(F.desc("g"), "fid").limit(size).select("fid").collect()
        out.append(np.sort(np.array([r["fid"] for r in top], np.int64).view(np.uint64)))
    return out


def compacted(rows: DataFrame, tables: list[np.ndarray], meta: list[str], targets: list[str]) -> DataFrame:
    """(row, tie, _id, _in, _<target>, text, meta): each row's features as places in the vocabularies."""
    model = rows.sparkSession.sparkContext.broadcast(Model(tables, {}))
    kept = ["_id", "_in", *[f"_{t}" for t in targets]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for big in batches:
            for b in sub_batches(big, 256):
                named = b.select([f"m_{c}" for c in meta]).rename_columns(meta)
                xs = [m.rows(0, *text_features(b.column("text"))), m.rows(1, *meta_features(named, meta))]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *map(list_array, xs)], [*kept, *VIEWS])

    schema = T.StructType([*[rows.schema[c] for c in kept], *T._parse_datatype_string("text array<int>, meta array<int>")])
    arrow_batches(rows.sparkSession)
    out = rows.mapInArrow(run, schema)
    return table(out.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("_id").alias("tie"), "*"))


def fitted(sample: DataFrame, given: DataFrame | None, targets: list[str], widths: list[int]) -> dict[str, list[View]]:
    """The views of each target, each fitted in a task of its own."""
    parts = []
    for k, t in enumerate(targets):
        for v, name in enumerate(VIEWS):
            key = [F.lit(k).alias("target"), F.lit(v).alias("view")]
            parts.append(sample.filter(F.col(f"_{t}").isNotNull()).select(*key, F.lit(False).alias("pseudo"), "tie", "row", (F.col(f"_{t}") > 0).cast("double").alias("y"), F.col(name).alias("x")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if given is not None:
        own = F.when(F.col("view") == 0, F.col("text")).otherwise(F.col("meta"))
        rows = rows.unionByName(given.select("target", "view", F.lit(True).alias("pseudo"), "tie", "row", F.col("label").cast("double").alias("y"), own.alias("x")))

    def fit(found: pa.Table) -> pa.Table:
        found = found.sort_by([("pseudo", "ascending"), ("tie", "ascending"), ("row", "ascending")]).combine_chunks()
        view, target = found.column("view")[0].as_py(), found.column("target")[0].as_py()
        y = found.column("y").to_numpy()
        labelled = len(y) - int(found.column("pseudo").to_numpy().sum())
        fitted_view = None
        if both_kinds(y[:labelled]):
            index, bounds = lists(found.column("x").chunk(0))
            fitted_view = fit_view(Rows(index.astype(np.int64), bounds, widths[view]), y, labelled)
        return pa.table({"target": pa.array([target], pa.int32()), "view": pa.array([view], pa.int32()), "prior": [prior_of(y[:labelled]).prior], "fitted": pa.array([pickle.dumps(fitted_view)], pa.binary())})

    got = rows.groupBy("target", "view").applyInArrow(fit, "target int, view int, prior double, fitted binary").collect()
    found = {(r["target"], r["view"]): r for r in got}
    out = {}
    for k, t in enumerate(targets):
        views = [pickle.loads(found[k, v]["fitted"]) if (k, v) in found else None for v in range(len(VIEWS))]
        out[t] = CoTrained(found[k, 0]["prior"] if (k, 0) in found else 0.0, views if None not in views else [])
    return out


def handed_over(compact: DataFrame, classifiers: dict[str, CoTrained], widths: list[int], taken: np.ndarray) -> DataFrame:
    """(target, view, label, tie, row, text, meta): the rows of the whole corpus that each view is
    surest of, for the other one (``view``).  ``taken``: (target, view, row) handed over before."""
    names = ["target", "view", "label", "sure", "tie", "row"]
    told = compact.sparkSession.sparkContext.broadcast((list(classifiers.values()), taken))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, gone = told.value
        for b in batches:
            xs = [Rows(*lists(b.column(name)), w) for name, w in zip(VIEWS, widths, strict=True)]
            row, tie = (b.column(c).to_numpy() for c in ("row", "tie"))
            for k, c in enumerate(models):
                for v, view in enumerate(c.views):
                    odds = view.log_odds(xs[v])
                    free = ~np.isin(row, gone[(gone[:, 0] == k) & (gone[:, 1] == 1 - v), 2])
                    for label in (1, 0):
                        at = surest(odds, label, free, tie)
                        if len(at):
                            sure = np.round(sigmoid(odds if label else -odds), 9)
                            const = [pa.array(np.full(len(at), x, np.int32)) for x in (k, 1 - v, label)]
                            yield pa.RecordBatch.from_arrays([*const, pa.array(sure[at]), pa.array(tie[at]), pa.array(row[at]), *[b.column(n).take(pa.array(at)) for n in VIEWS]], [*names, *VIEWS])

    arrow_batches(compact.sparkSession, 16384)  # short lists
    sure = compact.filter("NOT _in AND _id IS NOT NULL").mapInArrow(run, "target int, view int, label int, sure double, tie long, row long, text array<int>, meta array<int>")
    best = Window.partitionBy("target", "view", "label").orderBy(F.desc("sure"), "tie", "row")  # a limit that Spark applies before the shuffle too
    return cut(sure.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= HANDED).drop("k", "sure"))


def train_on(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, meta: list[str], targets: list[str], sample: int) -> tuple[Model, DataFrame]:
    """The model, and the compact rows of all documents."""
    rows = marked(docs, labels, id_col, text_col, meta, targets, sample)
    tables = vocabularies(rows, meta, targets)
    widths = [len(t) for t in tables]
    compact = compacted(rows, tables, meta, targets)
    chosen = cut(compact.filter("_in"))
    given, taken = None, np.zeros((0, 3), np.int64)
    classifiers = fitted(chosen, given, targets, widths)
    for _ in range(ROUNDS if any(c.views for c in classifiers.values()) else 0):
        new = handed_over(compact, classifiers, widths, taken)
        keys = np.array([tuple(r) for r in new.select("target", "view", "row").collect()], np.int64).reshape(-1, 3)  # HANDED a class and view
        if not len(keys):
            break
        taken = np.concatenate([taken, keys])
        given = new if given is None else given.unionByName(new)
        classifiers = fitted(chosen, given, targets, widths)
    return Model(tables, classifiers), compact


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta: list[str] | None = None, targets: tuple[str, ...] = ("quality", "toxic"), sample: int = SAMPLE) -> Model:
    return train_on(docs, labels, id_col, text_col, list(META) if meta is None else meta, list(targets), sample)[0]


def classify(docs: DataFrame, model: Model, text_col: str = "text", meta: list[str] | None = None) -> DataFrame:
    """All columns of ``docs`` go through; added are p_<target> for every target and
    ``rejected``: quality under, or toxicity at or over, the threshold.  Names that are taken
    get underscores in front."""
    meta = list(META) if meta is None else meta
    (text,) = fresh(docs, "text_in")
    told = docs.sparkSession.sparkContext.broadcast(model)
    names = fresh(docs, *[f"p_{t}" for t in model.targets], "rejected")
    source = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    schema = T.StructType([*docs.schema, *[T.StructField(n, T.DoubleType()) for n in names[:-1]], T.StructField(names[-1], T.BooleanType())])
    passed = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        for big in batches:
            for b in sub_batches(big, 256, text):
                ps, bad = m.verdict(m.views_of(b, text, meta), b.num_rows)
                yield pa.RecordBatch.from_arrays([*b.columns[:passed], *map(pa.array, ps), pa.array(bad)], schema.names)

    arrow_batches(docs.sparkSession)
    return source.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected ones; all columns stay.

    Each row is judged by itself, repeated ones alike; null text is empty, null metadata a
    value of its own, and rows with a null id are judged too.  Very long texts are read
    whole.  An empty table stays empty, and without labels of both kinds all rows stay."""
    scored = classify(docs, train(docs, labels))
    flag = scored.columns[-1]
    return scored.filter(~F.col(flag)).select(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_quality, p_toxic, rejected of every document.

    Null text is empty and null metadata a value of its own; null ids are scored but not
    fitted on; ids labelled twice count as good, or toxic, if one label says so.  Without labels
    of both kinds a target is its prior and rejects nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, compact = train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "text", list(META), ["quality", "toxic"], SAMPLE)
    told = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        for b in batches:
            ps, bad = m.verdict([Rows(*lists(b.column(v)), len(t)) for v, t in zip(VIEWS, m.tables, strict=True)], b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("_id"), *map(pa.array, ps), pa.array(bad)], ["doc_id", "p_quality", "p_toxic", "rejected"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string("p_quality double, p_toxic double, rejected boolean")])
    return compact.select("_id", *VIEWS).mapInArrow(run, schema)
