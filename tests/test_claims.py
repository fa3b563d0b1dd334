"""The stateful queue against a walk over all events, whole, in parts and with restarts."""

import datetime as dt
import random

import pytest

from corpusloom.streaming import claims

T = dt.datetime(2024, 1, 1)
SCHEMA = "queue string, kind string, job string, at timestamp, seq long, message string"


def _at(i):
    return T + dt.timedelta(seconds=i)


def _walk(events, per_turn, max_retries, lease, end):
    """Written without the library's queue: a list of jobs, searched for each event."""
    jobs, out = {}, []

    def put(name, at, status, run_after=None, worker=None, error=None):
        j = jobs[name]
        j.update(status=status, run_after=run_after, until=at + dt.timedelta(seconds=lease) if status == "running" and lease else None)
        out.append((j["queue"], name[1], at, status, j["attempts"], run_after, worker, error))

    def expire(queue, now):
        ended = sorted((j["until"], j["created"], n) for n, j in jobs.items() if j["status"] == "running" and j["until"] and j["until"] <= now and j["queue"] == queue)
        for until, _, n in ended:
            put(n, until, "queued", error="lease")

    for queue, kind, job, at, seq, message in sorted(events, key=lambda e: (e[3], e[4])):
        expire(queue, at)
        name = (queue, job)
        live = jobs.get(name)
        live = live if live and live["status"] in ("queued", "running") else None
        if kind == "enqueue" and not live:
            jobs[name] = {"queue": queue, "created": (at, seq), "attempts": 0, "status": "queued", "run_after": None, "until": None}
            put(name, at, "queued", dt.datetime.fromisoformat(message) if message else None)
        elif kind == "turn":
            due = sorted((j["created"], n) for n, j in jobs.items() if j["queue"] == queue and j["status"] == "queued" and (j["run_after"] is None or j["run_after"] <= at))
            for _, n in due[:per_turn]:
                jobs[n]["attempts"] += 1
                put(n, at, "running", worker=message)
        elif kind == "recover":
            for n in sorted(n for n, j in jobs.items() if j["queue"] == queue and j["status"] == "running"):
                put(n, at, "queued", error="recovered")
        elif kind == "complete" and live:
            put(name, at, "done")
        elif kind == "pause" and live:
            put(name, at, "queued", dt.datetime.fromisoformat(message))
        elif kind == "fail" and live and live["status"] == "running":
            n = live["attempts"]
            wait = (60 if "429" in message else 1) * 2 ** (n - 1)
            put(name, at, "failed", error=message) if n >= max_retries else put(name, at, "queued", at + dt.timedelta(seconds=wait), error=message)
    for queue in {e[0] for e in events}:
        expire(queue, end)
    return sorted(out, key=str)


def _events(seed, n=260):
    rng, out = random.Random(seed), []
    for i in range(n):
        queue, at = rng.choice("ab"), i * 3 + rng.randrange(3)
        kind = rng.choices(["enqueue", "turn", "complete", "fail", "pause", "recover"], [6, 8, 2, 5, 1, 0.2])[0]
        message = {"turn": f"w{rng.randrange(3)}", "fail": rng.choice(["HTTP 429", "boom"]), "pause": _at(at + 50).isoformat(), "enqueue": rng.choice([None, _at(at + 20).isoformat()])}.get(kind)
        out.append((queue, kind, None if kind in ("turn", "recover") else f"j{rng.randrange(25)}", _at(at), i, message))
    return out + [("z", "enqueue", "last", _at(n * 3 + 10_000), n, None)]  # passes the watermark over all others


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("lease", "per_turn"), [(None, 1), (25, 2)])
def test_equal_to_a_walk_in_parts_and_over_restarts(spark, tmp_path, lease, per_turn):
    events = _events(3)
    want = [r for r in _walk(events, per_turn, 3, lease, _at(260 * 3 + 10_000)) if r[0] != "z"]
    for cut, order in ((1, "whole"), (4, "parts")):
        folder = f"{tmp_path}/{order}"
        part = -(-len(events) // cut)
        for i in range(cut):  # each part is read by a query of its own that starts from the checkpoint
            shuffled = random.Random(i).sample(events[i * part : (i + 1) * part], len(events[i * part : (i + 1) * part]))
            spark.createDataFrame(shuffled, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
            got = claims.run(claims.changes(stream, per_turn, 3, lease, "5 seconds"), f"{folder}/out", f"{folder}/progress")
        assert _rows(got.filter("queue != 'z'")) == want
    assert {r[3] for r in want} >= {"queued", "running", "done", "failed"}


def test_odd_events(spark, tmp_path):
    odd = [("a", "enqueue", "x", _at(0), None, "no time"), ("a", "nonsense", "x", _at(1), 1, None), (None, "enqueue", "y", _at(1), 2, None), ("a", "turn", None, None, 3, None), ("a", "complete", "unknown", _at(2), 4, None), ("a", "turn", None, _at(3), 5, None), ("a", "turn", None, _at(3), 5, None)]
    spark.createDataFrame(odd, SCHEMA).write.parquet(f"{tmp_path}/in")
    got = claims.run(claims.changes(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/progress")
    assert [r[1:5] for r in _rows(got)] == [("x", _at(0), "queued", 0), ("x", _at(3), "running", 1)]
