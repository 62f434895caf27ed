import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodeworks.sources.shared import fresh
from lodeworks.streaming.deliveries import DeliveryStore, kept_deliveries, landed_in_order, surplus_deliveries

SCHEMA = "id bigint, key string, rank timestamp_ntz, at timestamp_ntz, state string"
T0 = datetime(2020, 1, 1)


def rows(n, seed, keys=20):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = rnd.choice([None, "", "  ", *[f" k{j} " if j % 3 else f"K{j}" for j in range(keys)], *["hot"] * keys])
        out.append((i, k, rnd.choice([None, T0 + timedelta(days=rnd.randrange(5))]), rnd.choice([None, T0 + timedelta(days=rnd.randrange(400))]), "x"))
    return out


def brute(data):
    best, out = {}, set()
    for i, k, r, _, _ in data:
        k = (k or "").strip(" ").upper()
        if k:
            best.setdefault(k, []).append(((r is not None, r or T0, -i), i))
    for g in best.values():
        out |= {i for _, i in g} - {max(g)[1]}
    return out


def test_many_batches_equal_one_and_expired_keys_are_found_again(spark):
    data = rows(600, 3)
    path = fresh(spark, "in")
    for part in range(6):
        spark.createDataFrame(data[part::6], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    for files, days in ((1, 0), (1, 30), (100, 30)):
        got = [r.id for r in surplus_deliveries(spark, path, "key", "rank", "id", "at", expiry_days=days, files_per_batch=files).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(data)
    kept = kept_deliveries(spark, path, "key", "rank", "id", "at")
    assert {r.id for r in kept.collect()} == {d[0] for d in data} - brute(data)
    assert kept.columns[-1] == "state" and len(kept.columns) == 5


def test_a_batch_that_is_run_again_changes_nothing(spark):
    data = rows(200, 4)
    store = DeliveryStore(spark, fresh(spark, "store"), F.upper(F.nullif(F.trim("key"), F.lit(""))), F.col("rank"), "id", "at", expiry_days=1)
    a, b = spark.createDataFrame(data[:120], SCHEMA), spark.createDataFrame(data[120:], SCHEMA)
    store.merge(a, 0)
    store.merge(b, 1)
    store.files.delete(f"{store.root}/commits/1.json")  # lost just before its commit
    assert store.committed() == [0]
    store.merge(b, 1)
    store.merge(b, 1)
    assert {r.id for r in store.surplus().collect()} == brute(data)


def test_runs_are_merged(spark):
    data = rows(300, 6, keys=40)
    store = DeliveryStore(spark, fresh(spark, "store"), F.upper(F.nullif(F.trim("key"), F.lit(""))), F.col("rank"), "id", "at", expiry_days=0, fan_in=2, buckets=3)
    for n in range(9):
        store.merge(spark.createDataFrame(data[n::9], SCHEMA), n)
    last = store._last(99)
    assert max(r["level"] for r in last["archive"] + last["hot"]) >= 2 and len(last["archive"] + last["hot"]) <= 6
    runs = {x.split("=")[1] for x in store.files.names(f"{store.root}/runs")}
    assert {r["id"] for r in last["archive"] + last["hot"]} <= runs and len(runs) <= 9
    got = [r.id for r in store.surplus().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)


def test_a_batch_writes_only_what_it_touches(spark):
    store = DeliveryStore(spark, fresh(spark, "store"), F.col("key"), F.col("rank"), "id", "at")
    store.merge(spark.createDataFrame([(i, f"k{i}", None, T0, "s") for i in range(500)], SCHEMA), 0)
    store.merge(spark.createDataFrame([(900, "k7", T0, T0, "s"), (901, "new", T0, T0, "s")], SCHEMA), 1)
    assert [tuple(r) for r in store.trace().orderBy("batch").collect()] == [(0, 500, 0), (1, 2, 0)]
    assert spark.read.parquet(store._place("b1")).count() == 2 and [r.id for r in store.surplus().collect()] == [7]


def test_landings(spark):
    data = rows(400, 9)
    df = spark.createDataFrame(data, SCHEMA)
    month = F.coalesce(F.month("at"), F.lit(0))
    store = landed_in_order(df, month, "key", "rank", "id", "at", expiry_days=10)
    got = [r.id for r in store.surplus().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)
    assert sum(r.late for r in store.trace().collect()) > 0 and len(store.committed()) == len({r[0] for r in df.select(month).distinct().collect()})
    assert landed_in_order(df.limit(0), F.lit(0), "key", "rank", "id", "at").surplus().count() == 0


def test_empty_table_and_late_key(spark):
    path = fresh(spark, "in")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert surplus_deliveries(spark, path, "key", "rank", "id", "at").count() == 0
    store = DeliveryStore(spark, fresh(spark, "store"), F.col("key"), F.col("rank"), "id", "at", expiry_days=1)
    one = lambda i, d, n: store.merge(spark.createDataFrame([(i, "k", None, T0 + timedelta(days=d), "s")], SCHEMA), n)
    one(1, 0, 0)
    store.merge(spark.createDataFrame([(9, "other", None, T0 + timedelta(days=300), "s")], SCHEMA), 1)
    store.merge(spark.createDataFrame([(8, "other", None, T0 + timedelta(days=301), "s")], SCHEMA), 2)  # k expires
    assert [r["id"] for r in store._last(3)["archive"]] == ["b0"]
    one(2, 0, 3)
    assert {r.id for r in store.surplus().collect()} == {9, 2} and store.commit_of(3)["late"] == 1
