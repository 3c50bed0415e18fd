"""Leave-one-session-out folds, samples, scalers, and what is counted on training sessions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def loo_folds(sessions: DataFrame, session: str = "session_id") -> DataFrame:
    """(test_session, train_session) for each session and all others."""
    one = sessions.select(F.col(session).alias("test_session")).distinct()
    return one.join(one.withColumnRenamed("test_session", "train_session"), F.col("test_session") != F.col("train_session"))


#: Ranks are numbers below it.
PRIME = (1 << 31) - 1
#: Bytes of candidates that a task holds before it hands them on.
HELD = 64 << 20


def row_hash(session: str, order: str) -> Column:
    """A number below PRIME of (session, row), the same on any number of partitions."""
    text = F.concat_ws("|", F.col(session).cast("string"), F.col(order).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % PRIME


def fold_factor(seed: int, test: int) -> int:
    """What a row's hash is multiplied by (modulo PRIME) to rank it in a fold."""
    return 1 + (seed + 1000 + test) * 2654435761 % (PRIME - 1)


def balanced_sample(rows: DataFrame, folds: DataFrame, label: str, max_rows: int = 8000, seed: int = 42, session: str = "session_id", order: str = "row_idx") -> DataFrame:
    """Training rows of each fold: all of a session of at most `max_rows`; else up to half positives, filled with negatives.

    Only labels 0 and 1 count. Scarce positives are made up by negatives, scarce negatives are not. Which rows, is by rank: a row is hashed once, and the
    fold's factor gives its rank in the fold. A task keeps, per fold, session and label, the quota's lowest ranks; those of the tasks are merged
    after: a bottom-k sample. So what is shuffled are quotas, not rows. Folds are a row per pair of sessions, and known to all tasks.
    """
    kept = rows.where(F.col(label).isin(0, 1)).select(session, F.col(order).cast("long").alias("_row"), F.col(label).cast("int").alias("_label"), row_hash(session, order).alias("_hash"))
    counts = kept.groupBy(session).agg(F.count("*").alias("_n"), F.sum("_label").alias("_pos"))
    take_pos = F.least("_pos", F.lit(max_rows // 2))
    quota = counts.select(
        session,
        F.when(F.col("_n") <= max_rows, F.col("_pos")).otherwise(take_pos).alias("_q1"),
        F.when(F.col("_n") <= max_rows, F.col("_n") - F.col("_pos")).otherwise(F.least(F.col("_n") - F.col("_pos"), max_rows - take_pos)).alias("_q0"),
    )
    tests: dict = {}
    for r in folds.select("test_session", "train_session").distinct().collect():
        tests.setdefault(r.train_session, []).append(r.test_session)
    names = ["test_session", session, "_label", "_quota", "_ranks"]
    kinds = {"test": folds.schema["test_session"].dataType, "session": rows.schema[session].dataType}
    held = HELD

    def lowest(found: np.ndarray, quota: int) -> np.ndarray:
        return np.partition(found, quota - 1)[:quota] if len(found) > quota > 0 else found[: max(quota, 0)]

    def candidates(batches):
        best: dict[tuple, tuple[int, np.ndarray]] = {}
        types = to_arrow_schema(T.StructType([T.StructField("t", kinds["test"]), T.StructField("s", kinds["session"])]))

        def told():
            columns = [[k[0] for k in best], [k[1] for k in best], [k[2] for k in best], [q for q, _ in best.values()], [np.sort(x).tobytes() for _, x in best.values()]]
            arrays = [pa.array(c, t) for c, t in zip(columns, (types.field(0).type, types.field(1).type, pa.int32(), pa.int64(), pa.binary()), strict=True)]
            best.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        size = 0
        for batch in batches:
            of = batch.column(0).dictionary_encode()
            code, row, label_, hash_, q1, q0 = (np.asarray(x) for x in (of.indices, *batch.columns[1:]))
            for k, s in enumerate(of.dictionary.to_pylist()):
                for value, quotas in ((1, q1), (0, q0)):
                    at = np.flatnonzero((code == k) & (label_ == value))
                    for test in tests.get(s, []) if len(at) else []:
                        rank = hash_[at] * fold_factor(seed, test) % PRIME
                        quota_, old = best.get((test, s, value), (int(quotas[at[0]]), np.zeros(0, np.uint64)))
                        new = lowest(np.concatenate([old, rank.astype(np.uint64) << np.uint64(32) | row[at].astype(np.uint64)]), quota_)
                        best[test, s, value] = (quota_, new)
                        size += 8 * (len(new) - len(old))
            if size > held:
                yield told()
                size = 0
        yield told()

    def merge(group: pa.Table) -> pa.Table:
        found = np.concatenate([np.frombuffer(b, np.uint64) for b in group.column("_ranks").to_pylist()])
        taken = lowest(found, group.column("_quota")[0].as_py()) & np.uint64(0xFFFFFFFF)
        first = group.slice(0, 1).select(["test_session", session, "_label"]).take(pa.array(np.zeros(len(taken), np.int64)))
        return first.append_column("_row", pa.array(taken.astype(np.int64)))

    test_kind, kind = kinds["test"].simpleString(), kinds["session"].simpleString()
    each = kept.join(quota, session).select(session, "_row", "_label", "_hash", "_q1", "_q0")
    found = each.mapInArrow(candidates, f"test_session {test_kind}, `{session}` {kind}, _label int, _quota long, _ranks binary")
    found = found.groupBy("test_session", session, "_label").applyInArrow(merge, f"test_session {test_kind}, `{session}` {kind}, _label int, _row long")
    return found.select("test_session", session, F.col("_row").cast(rows.schema[order].dataType).alias(order), F.col("_label").cast(rows.schema[label].dataType).alias(label))


def standard_scaler(rows: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, mean, std): population deviation, 1 where it is 0."""
    each = rows.groupBy(*keys).agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")).alias("std")) for c in cols])
    return each.select(*keys, F.inline(entries))


def duration_prior(segments: DataFrame, folds: DataFrame, session: str = "session_id") -> DataFrame:
    """Per fold, of the lengths of all true intervals of its training sessions: quantiles (linear, truncated, at least 1),
    mean, population deviation, intervals per session, and the lengths allowed. A fold without any uses 18, 80, 160.
    Training sessions without intervals count in the mean per session."""
    lengths = segments.select(F.col(session).alias("train_session"), F.col("length").cast("double").alias("length"))
    counted = folds.groupBy("test_session").agg(F.countDistinct("train_session").alias("sessions"))
    rows = folds.join(lengths, "train_session").select("test_session", "length", F.lit(1).alias("_own"))
    missing = counted.join(rows, "test_session", "left_anti").select("test_session", F.explode(F.array(*[F.lit(x) for x in (18.0, 80.0, 160.0)])).alias("length"), F.lit(0).alias("_own"))
    rows = rows.unionByName(missing)
    points = [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95]
    names = ["p5", "p10", "p25", "median", "p75", "p90", "p95"]
    out = rows.groupBy("test_session").agg(
        F.sum("_own").alias("n_train_segments"), F.min("length").alias("min"), F.percentile("length", F.array(*[F.lit(p) for p in points])).alias("q"), F.avg("length").alias("mean_len"), F.stddev_pop("length").alias("std_len")
    ).join(counted, "test_session")
    quantiles = [F.greatest(F.col("q")[i].cast("long"), F.lit(1)).alias(f"{n}_len") for i, n in enumerate(names)]
    out = out.select("test_session", F.col("n_train_segments").cast("long").alias("n_train_segments"), F.greatest(F.col("min").cast("long"), F.lit(1)).alias("min_len"), *quantiles, "mean_len", "std_len", (F.col("n_train_segments") / F.col("sessions")).alias("mean_segment_count"))
    low = F.greatest(F.lit(18), F.floor(F.col("p10_len") * F.lit(0.45)))
    high = F.greatest(F.col("median_len") + 1, F.ceil(F.col("p90_len") * F.lit(1.85)))
    return out.withColumns({"min_allowed_len": low.cast("long"), "max_allowed_len": high.cast("long")})


def duration_prior_by_fold(prior: DataFrame, folds: DataFrame) -> DataFrame:
    """With the fold's training sessions as text."""
    text = folds.groupBy("test_session").agg(F.array_join(F.array_sort(F.collect_list("train_session")), ", ").alias("train_sessions"))
    return prior.join(text, "test_session")
