import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from runline.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, pos long, digest string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def path_and_root(leaves, i):
    """Runs of leaf i up to the root, as (before, after), and the root; node by node."""
    path = []
    while len(leaves) > 1:
        low = i // 8 * 8
        run = leaves[low : low + 8]
        path.append(("".join(run[: i - low]), "".join(run[i - low + 1 :])))
        leaves, i = [sha("".join(leaves[k : k + 8])) for k in range(0, len(leaves), 8)], i // 8
    return path, leaves[0]


def manifest(rows):
    """Rows of the query's contract."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, framed(*r[:5])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    leaves = {g: sorted(groups[g], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for g in order}
    subroots = [path_and_root([leaf for _, leaf in leaves[g]], 0)[1] for g in order]
    out = []
    for k, g in enumerate(order):
        above, root = path_and_root(subroots, k)
        for i, (r, leaf) in enumerate(leaves[g]):
            path = path_and_root([x for _, x in leaves[g]], i)[0] + above
            found = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                found = framed(*r[:4], r[4] and r[4].translate(LOWER))
            for before, after in path:
                found = sha(before + found + after)
            out.append((r[0], leaf, subroots[k], root, sha("".join(b + a for b, a in path)), found, found == root))
    return out


def rows_of(n, seed=1):
    rng = random.Random(seed)
    langs = ["en"] * 6 + ["de", "fr", None, "", "É", "zz"]
    texts = [None, "", "Plain Text", "no capitals", "É À", "x" * 50_000, "Ab:1-"]
    return [(rng.choice([i, i, None, 7]), rng.choice(["s", None]), rng.choice(langs), rng.choice([None, 3, -1]), rng.choice(texts), "k", 1, "d") for i in range(n)]


def answered(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, queries.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize(("n", "levels", "per_task"), [(1, 4, 100), (9, 4, 100), (700, 4, 500_000), (700, 1, 20), (1300, 2, 33)])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, n, levels, per_task):
    """Null and repeated ids, equal rows, null, empty and long texts, null and empty groups; trees over several blocks and tasks."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "ROWS", per_task)
    rows = rows_of(n)
    assert answered(spark, tmp_path, rows) == sorted(manifest(rows), key=repr)


def test_no_rows_and_equal_rows(spark, tmp_path):
    assert answered(spark, tmp_path, []) == []
    rows = [(5, "s", "en", 1, "A", "k", 1, "d")] * 30
    assert answered(spark, tmp_path, rows) == sorted(manifest(rows), key=repr)


def test_many_groups(spark, tmp_path):
    rows = [(i, None, f"g{i % 90}", None, "A", "k", 1, "d") for i in range(300)]
    assert answered(spark, tmp_path, rows) == sorted(manifest(rows), key=repr)


def test_manifest_tables(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("g"), merkle.digest(F.col("id")).alias("leaf"), F.lit("x").alias("key"), F.lit(1).alias("level"))
    made = merkle.manifest(spark, rows, "id", "g", "leaf")
    found = made.proofs.select("id", "g", "key", "level", merkle.fold(F.col("leaf"), F.col("path")).alias("root")).collect()
    assert {r.root for r in found} == {made.root.hex()} and len(found) == 100 and {r.key for r in found} == {"x"}
    assert made.nodes.where(f"kind = {merkle.NODE}").count() == 3 * (5 + 1)
    assert sorted((r.key, r["size"]) for r in made.subroots.collect()) == [("=0", 34), ("=1", 33), ("=2", 33)]
    with pytest.raises(ValueError):
        merkle.manifest(spark, rows.withColumn("path", F.lit(1)), "id", "g", "leaf")
