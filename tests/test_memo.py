"""The keyed store against a dict, with several writers."""

import random
import threading
from datetime import datetime, timedelta

from adjudica.sinks.memo import MemoStore
from adjudica.streaming import progress


def rows(df):
    return {r.key: r.value for r in df.collect()}


def frame(spark, values):
    return spark.createDataFrame(list(values.items()), "key string, value string")


def test_like_a_dict(spark, tmp_path):
    store, want, rnd = MemoStore(spark, str(tmp_path / "m"), 4), {}, random.Random(1)
    assert rows(store.all()) == {}
    for step in range(6):
        new = {f"k{rnd.randrange(30)}": f"v{step}-{i}" for i in range(12)}
        store.put(frame(spark, new))
        want |= new
        gone = [f"k{rnd.randrange(30)}" for _ in range(3)]
        store.delete(spark.createDataFrame([(k,) for k in gone], "key string"))
        want = {k: v for k, v in want.items() if k not in gone}
        if step == 3:
            assert len(store.generations()) == 8
            store.compact()
            assert len(store.generations()) == 1 and rows(store.all()) == want
            assert store.clean() == 8 and rows(store.all()) == want
    assert rows(store.all()) == want
    asked = [f"k{i}" for i in range(0, 30, 7)]
    assert rows(store.get(asked)) == {k: v for k, v in want.items() if k in asked}
    assert "bucket" in store.get(["k1"])._jdf.queryExecution().executedPlan().toString()
    joined = {r.key: r.value for r in store.join(spark.createDataFrame([(k,) for k in (*asked, "none")], "key string")).collect()}
    assert joined == {k: want.get(k) for k in (*asked, "none")}


def test_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "m")
    MemoStore(spark, path, 2)
    failed = []

    def write(k):
        try:
            MemoStore(spark, path, 2).put(frame(spark, {f"w{k}": str(k), "all": str(k)}))
        except Exception as e:  # told below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = MemoStore(spark, path, 2)
    got = rows(store.all())
    assert not failed and {k for k in got if k != "all"} == {f"w{k}" for k in range(5)} and len(store.generations()) == 5


def test_expiry(spark, tmp_path):
    store = MemoStore(spark, str(tmp_path / "m"), 2)
    now = datetime.now()
    store.put(spark.createDataFrame([("old", "x", now - timedelta(days=2)), ("new", "y", now + timedelta(days=2)), ("ever", "z", None)], "key string, value string, expires timestamp"))
    assert set(rows(store.all())) == {"new", "ever"} and rows(store.get(["old"])) == {}


def test_suppressions_from_a_start_in_any_order(spark, tmp_path):
    rnd = random.Random(7)
    acts = [(r, s, rnd.choice(["suppress", "suppress", "restore", "reset", "look"]) if s % 7 else "reset", rnd.randrange(6)) for r in range(4) for s in range(40)]
    first = [(1, 3), (1, 3), (2, 5), (9, 1)]
    schema = "review long, seq long, action string, finding long"
    batch = spark.createDataFrame(acts, schema)
    initial = spark.createDataFrame(first, "review long, finding long")
    shuffled = acts[:]
    rnd.shuffle(shuffled)
    for k in range(3):
        spark.createDataFrame(shuffled[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = progress.suppressions(progress.read(spark, str(tmp_path / "in"), schema, 1), initial if k == 0 else initial)
        progress.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.review: (r.seq, r.suppressed) for r in progress.latest(spark.read.parquet(str(tmp_path / "out")), "review").collect() if r.review in range(4)}
    assert got == {r.review: (r.seq, r.suppressed) for r in progress.suppressed_now(batch).collect()}
