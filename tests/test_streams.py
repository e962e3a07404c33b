"""Streams with state against the batch operators, at exact boundaries and with posts out of order."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire.operators import presence as pr
from quire.streaming import limits, mail, retention
from quire.streaming import posts as st

T0 = datetime(2024, 5, 1, 12)
VISITS = "id long, event_id long, ts timestamp, kind string, keep boolean"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def stream(spark, folder, batches, schema):
    """A stream that gives each of the lists of rows as a micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def result(df, folder, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/cp-{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def gone(spark, visits, now):
    """Ids that the batch rule selects at `now`."""
    df = spark.createDataFrame([v for v in visits if v[3] in ("seen", "left")], VISITS)
    status = {}
    for i, n, t, kind, _ in sorted(visits, key=lambda v: (v[2], v[1])):
        if kind not in ("seen", "left"):
            status[i] = kind
    kept, made = {v[0] for v in visits if v[4]}, {}
    for v in visits:
        made[v[0]] = min(v[2], made.get(v[0], v[2]))
    rows = [(i, status.get(i), i in kept, made[i]) for i in made]
    s = pr.last_seen(df).drop("created_at").join(spark.createDataFrame(rows, "id long, status string, keep boolean, created_at timestamp"), "id")
    rule = pr.expired(F.col("keep"), F.col("last_seen"), F.coalesce("status", F.lit("")), F.col("created_at"), F.lit(now).cast("timestamp"))
    return {r.id for r in s.where(rule).collect()}


def test_removals_at_exact_boundaries(rocks, tmp_path):
    ms, mn = timedelta(milliseconds=1), timedelta(minutes=1)
    now = T0 + 120 * mn
    seen = lambda i, t, kind="seen", keep=False: (i, 10 * i, t, kind, keep)
    first = [seen(1, now - 15 * mn), seen(2, now - 15 * mn - ms), seen(3, now - mn, "left"), seen(4, now - mn - ms, "left"), seen(5, T0, keep=True)]
    first += [seen(6, now - 60 * mn, "reading"), seen(6, now - 30 * mn), seen(7, now - 60 * mn - ms, "reading"), (7, 71, now - 30 * mn, "seen", False)]
    first += [seen(8, T0), (8, 81, T0 + mn, "left", False), (8, 82, T0 + mn + 30_000 * ms, "seen", False), seen(9, T0), (9, 91, T0 + 119 * mn, "seen", False)]
    first += [seen(10, T0, "reading"), (10, 101, T0 + mn, "seen", False), (10, 102, T0 + 100 * mn, "failed", False), seen(11, T0, "left"), (11, 111, T0, "seen", False)]
    r = random.Random(2)
    r.shuffle(first)
    batches = [first[::2], first[1::2], [(99, 1, now + timedelta(days=1), "seen", True)]]
    out = result(retention.removals(stream(rocks, tmp_path, batches, VISITS), event_time=True, late="1 day"), tmp_path, "removed")
    assert {x.id for x in out} == gone(rocks, first, now) == {2, 4, 7, 8, 10, 11}
    assert {x.id: x.due for x in out}[2] == now - ms + timedelta(microseconds=1)


def test_removals_equal_batch_on_random_visits(rocks, tmp_path):
    r = random.Random(7)
    visits = []
    for n in range(400):
        visits.append((r.randint(1, 40), n, T0 + timedelta(seconds=r.randint(0, 7200)), r.choice(["seen"] * 6 + ["left", "left", "reading", "ready"]), r.random() < 0.01))
    seen = {v[0] for v in visits if v[3] in ("seen", "left")}
    visits = [v for v in visits if v[0] in seen]
    now = T0 + timedelta(hours=2, seconds=400)
    batches = [visits[i::5] for i in range(5)] + [[(99, 1, now + timedelta(hours=3), "seen", True)]]
    out = result(retention.removals(stream(rocks, tmp_path, batches, VISITS), event_time=True, late="3 hours"), tmp_path, "removed_random")
    assert len(out) == len({x.id for x in out}) and {x.id for x in out} == gone(rocks, visits, now)


def test_removals_by_the_clock(rocks, tmp_path):
    """Processing time: what was left long ago goes with the next batches, what was seen just now stays."""
    now = datetime.now()
    batches = [[(1, 1, now - timedelta(hours=2), "seen", False), (2, 2, now + timedelta(hours=1), "seen", False)], [(3, 3, now, "seen", True)], [(4, 4, now, "seen", True)]]
    df = retention.removals(stream(rocks, tmp_path, batches, VISITS))
    q = df.writeStream.format("memory").queryName("removed_clock").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        while time.time() < end and (q.lastProgress is None or q.lastProgress["batchId"] < 5):  # three with visits, then some for timers
            time.sleep(1)
    finally:
        q.stop()
    assert {x.id for x in rocks.table("removed_clock").collect()} == {1}


def test_typed_state_is_asked_for(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        retention.needs_state_store(spark)


POSTS = "form string, visitor long, ts timestamp, event_id long, website string"


def test_ordered_limit_equals_batch_on_shuffled_batches(rocks, tmp_path):
    r = random.Random(3)
    posts = [("m" if i % 3 else "s", r.randint(0, 2), T0 + timedelta(seconds=r.randint(0, 3 * 3600)), i, "x" if i % 17 == 0 else "") for i in range(300)]
    posts += [("m", 1, T0 + timedelta(hours=1), 1000 + i, "") for i in range(4)] + [("m", 1, T0 + timedelta(hours=2, microseconds=-1), 1010, None)]
    r.shuffle(posts)
    batches = [posts[i::6] for i in range(6)] + [[("end", 0, T0 + timedelta(days=2), 9999, "")]]
    out = result(limits.rate_limit(stream(rocks, tmp_path, batches, POSTS), 5, late="5 hours", trap="website"), tmp_path, "ordered")
    want = pr.rate_limit(rocks.createDataFrame(posts, POSTS), 5, trap="website").where("nth is not null").collect()
    assert {(x.event_id, x.nth, x.refused) for x in out if x.form != "end"} == {(x.event_id, x.nth, x.refused) for x in want} and len(out) == len(want)


def test_ordered_limit_releases_as_the_watermark_moves(rocks, tmp_path):
    at = lambda m, i: ("m", 1, T0 + timedelta(minutes=m), i, "")
    batches = [[at(30, 1)], [at(10, 2)], [at(45, 3)], [at(40, 4)], [at(59, 5), at(200, 6)]]
    out = result(limits.rate_limit(stream(rocks, tmp_path, batches, POSTS), 2, late="25 minutes"), tmp_path, "moving")
    assert sorted((x.nth, x.event_id, x.refused) for x in out) == [(1, 2, False), (2, 1, False), (3, 4, True), (4, 3, True), (5, 5, True)]


def test_other_streams_equal_batch(spark, tmp_path):
    r = random.Random(5)
    posts = [("m", r.randint(0, 3), T0 + timedelta(seconds=r.randint(0, 20_000)), i, "x" if i % 5 == 0 else "") for i in range(200)]
    saves = [(r.randint(0, 3), T0 + timedelta(seconds=r.randint(0, 20_000)), i) for i in range(200)]
    visits = [(r.randint(0, 9), i, T0 + timedelta(seconds=r.randint(0, 20_000)), r.choice(["seen", "left"]), False) for i in range(200)]
    rows = lambda df: sorted(map(tuple, df if isinstance(df, list) else df.collect()))
    # one micro-batch, whose rows are in no order, then one that ends every session
    saved = "user_id long, ts timestamp, event_id long"
    out = result(st.debounce(stream(spark, tmp_path / "a", [saves, [(99, T0 + timedelta(days=2), 9999)]], saved), "10 minutes"), tmp_path, "saved")
    assert rows(out) == rows(pr.debounce(spark.createDataFrame(saves, saved), "10 minutes"))
    out = result(st.last_seen(stream(spark, tmp_path / "b", [visits[::2], visits[1::2]], VISITS)), tmp_path, "last_seen", "complete")
    assert rows(out) == rows(pr.last_seen(spark.createDataFrame(visits, VISITS)))
    out = result(st.rate_limit(stream(spark, tmp_path / "c", [posts], POSTS), 3, trap="website"), tmp_path, "trapped")
    want = pr.rate_limit(spark.createDataFrame(posts, POSTS), 3, trap="website").where("nth is not null").select("form", "visitor", "event_id", "nth", "refused")
    assert rows(out) == rows(want)
    out = result(st.hourly_totals(stream(spark, tmp_path / "d", [posts], POSTS), 3, trap="website").select("form", "visitor", "accepted", "refused"), tmp_path, "trapped_totals", "complete")
    assert rows(out) == rows(pr.hourly_totals(spark.createDataFrame(posts, POSTS), 3, trap="website").select("form", "visitor", "accepted", "refused"))


def writes_to(folder):
    """A send that leaves a line a message in a file, in place of a mail server."""

    def send(row):
        if "bad" in row["subject"]:
            raise OSError("no route")
        with open(f"{folder}/{row['message']}", "a") as f:
            f.write(f"{row['recipient']} {row['subject']}\n")

    return send


OUTBOX = "event_id long, recipient string, subject string, body string, reply_to string"


def test_a_batch_that_comes_again_sends_nothing_twice(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    rows = [(i, "a@example.org", f"s{i}" if i != 3 else "bad", "b", "") for i in range(6)] + [(0, "a@example.org", "s0", "b", ""), (7, "", "nobody", "b", ""), (8, None, "nobody", "b", ""), (None, "a@example.org", "no key", "b", "")]
    sink = mail.sink(f"{tmp_path}/ledger", writes_to(box), "event_id")
    df = stream(spark, tmp_path, [rows, [(100, "b@example.org", "later", "b", "")]], OUTBOX)
    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    sent = lambda: sorted(p.read_text() for p in box.iterdir())
    want = [f"a@example.org s{i}\n" for i in (0, 1, 2, 4, 5)] + ["b@example.org later\n"]
    assert sent() == want
    for number, batch in ((0, rows), (1, [(100, "b@example.org", "later", "b", "")])):  # a restart gives the batches again
        sink(spark.createDataFrame(batch, OUTBOX), number)
    assert sent() == want
    assert [(r.subject, r.error) for r in mail.unconfirmed(spark, f"{tmp_path}/ledger").collect()] == [("bad", "OSError: no route")]


def test_a_crash_between_claim_and_sending_is_told(spark, tmp_path):
    folder = f"{tmp_path}/ledger"
    assert mail.unconfirmed(spark, folder).count() == 0
    spark.createDataFrame([("m1", "a", "s", "b", "")], "message string, recipient string, subject string, body string, reply_to string").write.parquet(f"{folder}/claimed/batch=4")
    mail.deliver(spark.createDataFrame([(1, "a", "s", "b", "")], OUTBOX), 4, folder, writes_to(tmp_path), "event_id")
    assert [(r.message, r.error) for r in mail.unconfirmed(spark, folder).collect()] == [("m1", None)]
    assert not (tmp_path / "m1").exists()
