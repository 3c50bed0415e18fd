"""Many small logistic regressions at once, over one table of rows that they share."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from runline.operators import clean, temporal

#: Folds in one column of member bits; bytes of sums that a task holds: more models are fitted in several passes.
BITS, MOST_SUMS = 62, 256 << 20
#: Parts of a sum that one task adds up; more of them are added in two steps.
PARTS = 64


@dataclass
class LogReg:
    """Weights of standardised features; the last one is the intercept's. `gradient`: the largest entry of the objective's at these weights."""

    features: list[str]
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    converged: bool = True
    gradient: float = 0.0


def member_bits(fold: Column, n: int, name: str = "_members") -> dict[str, Column]:
    """Aggregates over (row, fold) pairs: a bit for each of `n` folds that a row is a training row of, in as many longs as needed."""
    out = {}
    for k in range(-(-n // BITS)):
        bit = F.when((fold >= k * BITS) & (fold < (k + 1) * BITS), F.expr("1L") * F.pow(F.lit(2.0), fold - k * BITS).cast("long"))
        out[f"{name}{k}"] = F.bit_or(F.coalesce(bit, F.lit(0).cast("long")))
    return out


def _added(parts: DataFrame, tasks: int, finish, schema: str) -> DataFrame:
    """Vectors (model, sums) added up per model, then `finish(model, sum)` as a row of `schema`; in two steps where many tasks have a part."""

    def adder(then, names):
        def told(rows):
            for r in rows:
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if i == 0 else None) for i, v in enumerate(r)], names=names)

        def run(batches):
            at, total = None, None
            for batch in batches:
                rows = []
                for model, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if model != at:
                        if at is not None:
                            rows.append((at, *then(at, total)))
                        at, total = model, np.frombuffer(blob.as_buffer(), "<f8").copy()
                    else:
                        total += np.frombuffer(blob.as_buffer(), "<f8")
                yield from told(rows)
            if at is not None:
                yield from told([(at, *then(at, total))])

        return run

    if tasks > PARTS:
        salt = F.pmod(F.spark_partition_id(), F.lit(-(-tasks // PARTS)))
        some = parts.select("model", "sums", salt.alias("salt")).repartition("model", "salt").sortWithinPartitions("model", "salt")
        parts = some.select("model", "sums").mapInArrow(adder(lambda _, total: (total.tobytes(),), ["model", "sums"]), "model int, sums binary")
    return parts.repartition("model").sortWithinPartitions("model").mapInArrow(adder(finish, [x.split(" ")[0] for x in schema.split(", ")]), schema)


def fit(rows: DataFrame, members: list[str], models: dict[tuple, tuple[int, list[str]]], label: str, c: float = 1.0, rounds: int = 100, tolerance: float = 1e-7) -> dict[tuple, LogReg]:
    """L2 logistic regressions of a 0/1 label over shared rows (a stored table). models: key -> (fold, features); a row belongs to the models of the folds
    whose bits its columns `members` have.

    Features are standardised by the model's own rows (population deviation, 1 where it is 0). Classes weigh n / (2 n_c). Objective: half the squared norm
    of weights and intercept, plus C times the weighted log-loss; so the intercept is penalised too. A model of one class gets no weights.

    A Newton step is one pass over the rows: all models' scores are a matrix product, each model's second derivatives have its own width, parts of
    sums are added by model and solved there. The driver holds weights and directions, a few numbers per feature and model. A step that does not lower the
    objective is halved. Models that have not converged after `rounds` passes are warned of, and say so.
    """
    names = sorted({f for _, own in models.values() for f in own})
    keys, width = list(models), len(names)
    index = {f: k for k, f in enumerate(names)}
    at = [np.array([index[f] for f in own], np.int64) for _, own in models.values()]
    fold_of = np.array([f for f, _ in models.values()])
    n_folds = int(fold_of.max()) + 1 if len(fold_of) else 0
    overall = rows.agg(*[f(F.col(n).cast("double")) for n in names for f in (F.avg, F.stddev_pop)]).first()
    center = np.array([overall[2 * k] or 0.0 for k in range(width)])
    spread = np.array([overall[2 * k + 1] or 1.0 for k in range(width)])
    own, tasks = rows.select(*names, label, *members), rows.rdd.getNumPartitions()

    def read(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.empty((batch.num_rows, width))
        for k in range(width):
            x[:, k] = batch.column(k).to_numpy(zero_copy_only=False)
        bits = [np.asarray(batch.column(width + 1 + k))[:, None] >> np.arange(BITS) & 1 for k in range(len(members))]
        return (x - center) / spread, batch.column(width).to_numpy(zero_copy_only=False).astype(float), np.hstack(bits)[:, :n_folds].astype(float)

    def sums_of(total: dict[int, np.ndarray]):
        for model, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([v.astype("<f8").tobytes()], pa.binary())], names=["model", "sums"])

    def moments(batches):
        total = np.zeros((n_folds, 2 * width + 2))
        for batch in batches:
            z, y, m = read(batch)
            total += m.T @ np.hstack([z, z * z, np.ones((len(y), 1)), y[:, None]])
        yield from sums_of(dict(enumerate(total)))

    scale, classes = {}, {}
    of_fold = {r["model"]: np.frombuffer(r["sums"]) for r in _added(own.mapInArrow(moments, "model int, sums binary"), tasks, lambda _, t: (t.tobytes(),), "model int, sums binary").collect()}
    size = {}
    for k in range(len(keys)):
        m = of_fold.get(fold_of[k], np.zeros(2 * width + 2))
        n, pos = m[-2], m[-1]
        mean = m[at[k]] / max(n, 1)
        std = np.sqrt(np.maximum(m[width + at[k]] / max(n, 1) - mean**2, 0))
        std[std * spread[at[k]] <= 1e-9 * np.maximum(np.abs(center[at[k]] + mean * spread[at[k]]), 1)] = 1.0
        scale[k] = (mean, std)
        size[k] = n
        classes[k] = (n / (2 * (n - pos)) if n > pos else 0.0, n / (2 * pos) if pos else 0.0)
    weights = {k: np.zeros(len(at[k]) + 1) for k in range(len(keys))}
    open_ = [k for k in weights if all(classes[k])]
    best = {k: (np.inf, weights[k], np.zeros_like(weights[k]), 1.0) for k in open_}
    gradient, converged = dict.fromkeys(weights, 0.0), {k: k not in open_ for k in weights}

    def step_of(some: list[int]) -> list:
        """(model, loss, gradient, direction) at the present weights."""
        state = {k: (at[k], *scale[k], classes[k], weights[k], fold_of[k]) for k in some}
        sent = rows.sparkSession.sparkContext.broadcast(state)

        def partial(batches):
            groups: dict[bytes, list[int]] = {}
            for k, (cols, *_) in sent.value.items():
                groups.setdefault(cols.tobytes(), []).append(k)
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                z, y, members_ = read(batch)
                for same in groups.values():
                    cols = sent.value[same[0]][0]
                    x = np.hstack([z[:, cols], np.ones((len(y), 1))])
                    coef = np.stack([np.append(w[:-1] / std, w[-1] - (w[:-1] * mean / std).sum()) for _, mean, std, _, w, _ in (sent.value[k] for k in same)], axis=1)
                    eta = np.clip(x @ coef, -500, 500)
                    upper = np.triu_indices(len(cols) + 1)
                    for j, k in enumerate(same):
                        _, _, _, (w0, w1), _, fold = sent.value[k]
                        mine = np.flatnonzero(members_[:, fold])
                        e, t, v = eta[mine, j], y[mine], x[mine]
                        p, s = 1 / (1 + np.exp(-e)), np.where(t == 1, w1, w0) * c
                        loss = (s * (np.logaddexp(0, e) - t * e)).sum()
                        found = np.concatenate([[loss], v.T @ (s * (p - t)), ((v * (s * p * (1 - p))[:, None]).T @ v)[upper]])
                        total[k] = total[k] + found if k in total else found
            yield from sums_of(total)

        def solve(k, found):
            _, mean, std, _, w, _ = sent.value[k]
            d = len(w)
            full = np.zeros((d, d))
            full[np.triu_indices(d)] = found[1 + d :]
            full = full + np.triu(full, 1).T
            turn = np.zeros((d, d))  # from shared columns and 1 to the model's own standardised ones
            turn[np.arange(d - 1), np.arange(d - 1)], turn[-1, :-1], turn[-1, -1] = 1 / std, -mean / std, 1.0
            slope = turn.T @ found[1 : 1 + d] + w
            move = np.linalg.solve(turn.T @ full @ turn + np.eye(d), slope)
            return float(found[0] + w @ w / 2), float(np.abs(slope).max()), move.astype("<f8").tobytes()

        rows_ = _added(own.mapInArrow(partial, "model int, sums binary"), tasks, solve, "model int, loss double, slope double, move binary").collect()
        sent.unpersist()
        return rows_

    for _ in range(rounds):
        if not open_:
            break
        cost, passes = np.cumsum([4 * (len(at[k]) + 2) ** 2 for k in open_]) // MOST_SUMS, []
        for part in np.unique(cost):
            passes += step_of([k for k, p in zip(open_, cost, strict=True) if p == part])
        for r in passes:
            k, (low, where, move, share) = r["model"], best[r["model"]]
            if r["loss"] <= low + 1e-12 * abs(low) or low == np.inf:
                best[k] = (r["loss"], weights[k], np.frombuffer(r["move"]), 1.0)
                gradient[k] = r["slope"]
                if r["slope"] < tolerance * max(1.0, size[k]):
                    converged[k] = True
                    continue
            elif share > 1e-6:
                best[k] = (low, where, move, share / 2)
            else:  # no step from here lowers the objective
                weights[k] = where
                converged[k] = bool(gradient[k] < 1e3 * tolerance * max(1.0, size[k]))
                open_.remove(k)
                continue
            _, where, move, share = best[k]
            weights[k] = where - share * move
        open_ = [k for k in open_ if not converged[k]]
    for k in open_:
        weights[k] = best[k][1]
    if not all(converged.values()):
        warnings.warn(f"not converged: {[keys[k] for k, ok in converged.items() if not ok]}", stacklevel=2)
    out = {}
    for k, key in enumerate(keys):
        mean, std = scale[k]
        out[key] = LogReg(models[key][1], center[at[k]] + mean * spread[at[k]], std * spread[at[k]], weights[k], converged[k], gradient[k])
    return out


def train_logreg(rows: DataFrame, features: dict[tuple, list[str]] | list[str], keys: list[str], label: str, c: float = 1.0, rounds: int = 100, tolerance: float = 1e-7) -> dict[tuple, LogReg]:
    """A regression (see `fit`) per value of `keys`, each over its own rows. `features`: names, or a list per value."""
    found = [tuple(r) for r in rows.select(*keys).distinct().orderBy(*keys).collect()]  # a row per model
    if not found:
        return {}
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    numbers = rows.sparkSession.createDataFrame([(*key, k) for k, key in enumerate(found)], f"{kinds}, _fold int")
    words = range(-(-len(found) // BITS))
    bits = {f"_members{w}": F.when(F.floor(F.col("_fold") / BITS) == w, F.pow(F.lit(2.0), F.col("_fold") - w * BITS).cast("long")).otherwise(F.lit(0).cast("long")) for w in words}
    models = {key: (k, features if isinstance(features, list) else features[key]) for k, key in enumerate(found)}
    return fit(rows.join(F.broadcast(numbers), keys).withColumns(bits), list(bits), models, label, c, rounds, tolerance)


def score_rows(rows: DataFrame, models: dict[tuple, LogReg], key_names: list[str], key_types: list[str], keep: list[str], own: tuple[str, str] | None = None) -> DataFrame:
    """`keep`, the model's key and `prob`, for every row and every model: one matrix product per batch for all models. With
    `own` (one of `keep`, one of `key_names`) a row is scored only by models whose key has the row's value."""
    names = sorted({f for m in models.values() for f in m.features})
    matrix, bias, keys = np.zeros((len(names), len(models))), np.zeros(len(models)), list(models)
    for k, key in enumerate(keys):
        m = models[key]
        w = m.weights[:-1] / m.std
        matrix[[names.index(f) for f in m.features], k] = w
        bias[k] = m.weights[-1] - (w * m.mean).sum()
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*kinds, *[f"`{k}` {t}" for k, t in zip(key_names, key_types, strict=True)], "prob double"])

    types = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64()}[t] for t in key_types]

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(len(keep) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(names))], axis=1) if names else np.zeros((batch.num_rows, 0))
            p = 1 / (1 + np.exp(-np.clip(x @ matrix + bias, -500, 500)))
            mine = np.array(batch.column(keep.index(own[0])).to_pylist(), dtype=object) if own else None
            for k, key in enumerate(keys):
                if own:
                    at = np.flatnonzero(mine == key[key_names.index(own[1])])
                    if len(at):
                        some = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], *[pa.array([v] * len(at), t) for v, t in zip(key, types, strict=True)], pa.array(p[at, k])], [*keep, *key_names, "prob"])
                    continue
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array([v] * batch.num_rows, t) for v, t in zip(key, types, strict=True)], pa.array(p[:, k])], [*keep, *key_names, "prob"])

    return rows.select(*keep, *names).mapInArrow(run, schema)


def score_runs(
    rows: DataFrame, models: dict[tuple, LogReg], key_names: list[str], key_types: list[str], keys: list[str], levels: list[float], w: int, order: str = "row_idx", block: int = clean.BLOCK
) -> DataFrame:
    """The models' keys, `keys`, `_k`, start, end: runs of rows whose probability, smoothed over `w` rows and rounded to 9 digits, reaches `_k` (1 or more) of the
    sorted `levels`. Every model scores and smooths every row in the task that has its block of rows; only runs leave it, cut where blocks end."""
    names = sorted({f for m in models.values() for f in m.features})
    every, ordered = list(models), sorted(levels)
    matrix, bias = np.zeros((len(names), len(every))), np.zeros(len(every))
    for k, key in enumerate(every):
        m = models[key]
        matrix[[names.index(f) for f in m.features], k] = m.weights[:-1] / m.std
        bias[k] = m.weights[-1] - (m.weights[:-1] / m.std * m.mean).sum()
    back, ahead = w // 2, (w - 1) // 2
    spread = temporal.in_blocks(rows.select(*keys, order, *names), keys, back + 1, order, block)
    types = to_arrow_schema(T._parse_datatype_string(", ".join(f"`{k}` {t}" for k, t in zip(key_names, key_types, strict=True))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        x = np.stack([table.column(n).to_numpy() for n in names], axis=1).astype(float) if names else np.zeros((table.num_rows, 0))
        own, n = table.column("_own").to_numpy(zero_copy_only=False).astype(bool), table.num_rows
        place = table.column(order).to_numpy()[own].astype(np.int64)
        low, high = np.maximum(np.arange(n) - back, 0), np.minimum(np.arange(n) + ahead + 1, n)
        model, reach, start, end = [], [], [], []
        for first in range(0, len(every), 64):
            p = 1 / (1 + np.exp(-np.clip(x @ matrix[:, first : first + 64] + bias[first : first + 64], -500, 500)))
            if w > 1:
                sums = np.vstack([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
                p = (sums[high] - sums[low]) / (high - low)[:, None]
            k = np.searchsorted(ordered, np.round(p[own], 9), side="right")
            for j in range(k.shape[1]):
                cuts = np.flatnonzero(np.concatenate([[True], (k[1:, j] != k[:-1, j]) | (np.diff(place) != 1)])) if len(place) else np.zeros(0, np.int64)
                stops = np.append(cuts[1:], len(place)) - 1
                some = k[cuts, j] > 0
                model.append(np.full(int(some.sum()), first + j))
                reach.append(k[cuts[some], j])
                start.append(place[cuts[some]])
                end.append(place[stops[some]])
        model, reach, start, end = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (model, reach, start, end))
        told = [pa.array([every[m][i] for m in model.tolist()], types.field(i).type) for i in range(len(key_names))]
        same = [table.column(k).slice(0, 1).take(pa.array(np.zeros(len(model), np.int64))) for k in keys]
        return pa.table([*told, *same, pa.array(reach.astype(np.int32)), pa.array(start), pa.array(end)], names=[*key_names, *keys, "_k", "start", "end"])

    kinds = [f"`{k}` {t}" for k, t in zip(key_names, key_types, strict=True)] + [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    return spread.groupBy(*keys, "_block").applyInArrow(run, ", ".join(kinds) + ", _k int, start long, `end` long")


def score_expression(features: list[str], mean: list[float], std: list[float], weights: list[float], intercept: float) -> Column:
    """The probability of one model as a column expression."""
    z = F.lit(float(intercept))
    for f, m, s, w in zip(features, mean, std, weights, strict=True):
        z = z + (F.col(f) - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(w))
    return 1 / (1 + F.exp(-z))
