from datetime import datetime

from quern.operators.orphans import normal_key, orphans
from pyspark.sql import functions as F

T = datetime
REFS = "ref_id string, endpoint string, key string, at timestamp_ntz"
PARENTS = "key string, created_at timestamp_ntz, deleted_at timestamp_ntz"


def test_kinds_hot_keys_and_nulls(spark):
    parents = [("a", T(2025, 1, 1), None), ("b", T(2025, 1, 1), T(2025, 2, 1)), ("c", None, None), ("d", T(2025, 3, 1), None), ("d", T(2025, 1, 1), None), (None, T(2025, 1, 1), None)]
    refs = [("r1", "source", "a", T(2025, 1, 1)), ("r2", "source", "a", T(2024, 12, 31)), ("r3", "target", "b", T(2025, 2, 1)), ("r4", "target", "b", T(2025, 1, 31)), ("r5", "source", "c", T(1999, 1, 1))]
    refs += [("r6", "source", "d", T(2025, 2, 1)), ("r7", "source", "nowhere", T(2025, 2, 1)), ("r8", "source", None, T(2025, 2, 1)), ("r9", "source", "a", None), ("r10", "source", "nowhere", None)]
    refs += [(f"h{i}", "target", "a", T(2024, 1, 1)) for i in range(300)]  # a hot key, dealt to several batches
    got = orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), range_rows=2, batch_rows=50)
    found = {(r["ref_id"], r["kind"]) for r in got.collect()}
    assert found == {("r2", "late"), ("r3", "deleted"), ("r7", "missing"), ("r10", "missing"), *((f"h{i}", "late") for i in range(300))}
    assert {r["at"] for r in got.where("ref_id = 'r10'").collect()} == {None}


def test_keys_that_end_in_nul_or_are_very_long(spark):
    parents = [("a", None, None), ("x" * 200, None, None), *((f"k{i}", None, None) for i in range(300))]
    keys = ["a", "a\0", "\0a", "x" * 200, "x" * 199 + "y", *(f"k{i}" for i in range(300)), "k300"]
    refs = [(str(i), "source", k, T(2025, 1, 1)) for i, k in enumerate(keys)]
    got = orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), range_rows=20, batch_rows=50)
    assert {keys[int(r["ref_id"])] for r in got.collect()} == {"a\0", "\0a", "x" * 199 + "y", "k300"}


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], PARENTS), spark.createDataFrame([("r", "source", "a", T(2025, 1, 1))], REFS)
    assert [r["kind"] for r in orphans(some, none).collect()] == ["missing"]
    assert orphans(spark.createDataFrame([], REFS), none).count() == 0


def test_keys(spark):
    rows = [("  Ab\t", "ab"), ("  ", None), ("", None), (None, None), ("x y", "x y")]
    df = spark.createDataFrame(rows, "k string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", normal_key(F.col("k"))).collect())
