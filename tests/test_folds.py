"""Hashes over include trees and groups under a budget, with blocks of a few rows, against loops over the events."""

import hashlib
import random

import pytest

from codefacts.operators import measure, tables


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(measure, "scan", lambda rows, by, place, **values: tables.scan(rows, by, place, 8, **values))


def mixed(before, value):
    return hashlib.md5(f"{before}|{value}".encode()).hexdigest()[:16]


def walked(own):
    """(path, hash, steps) of each file that is left, in that order; a step is (before, value, context, data, after)."""
    open_, out = [], []

    def take(value, context, data=None):
        top = open_[-1]
        after = mixed(top["hash"], value)
        top["steps"].append((top["hash"], value, context, data, after))
        top["hash"] = after

    for kind, value in own:
        if kind == "enter":
            open_.append({"path": value, "hash": "0", "steps": []})
            take(value, "self path")
        elif kind == "exit":
            if open_:
                last = open_.pop()
                out.append((last["path"], last["hash"], last["steps"]))
                if open_:
                    take(last["hash"], "hash for #include", last["path"])
        elif open_:
            take(f"{kind} {value}", kind)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hashes_and_history(spark, seed):
    rng = random.Random(seed)
    units = {t: [(rng.choice(["enter", "exit", "define", "exit", "enter", "if"]), f"v{rng.randrange(5)}") for _ in range(n)] for t, n in ((1, 150), (2, 40), (3, 1), (4, 3))}
    units[5] = [("enter", "a")] * 12 + [("exit", "")] * 12 + [("exit", "")] * 3 + [("define", "lost"), ("enter", "b"), ("exit", "b")]
    units[6] = [("exit", "x")] * 9
    rows = [(t, i * 3, *e) for t, own in units.items() for i, e in enumerate(own)]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "task_id long, seq long, kind string, value string")
    want = {t: walked(own) for t, own in units.items()}
    got = sorted(tuple(r) for r in measure.include_hashes(events).select("task_id", "path", "hash").collect())
    assert got == sorted((t, p, h) for t, own in want.items() for p, h, _ in own)
    steps = sorted(tuple(r) for r in measure.hash_history(events).select("task_id", "passage", "ord", "path", "before", "mixed_value", "mix_context", "context_data", "after").collect())
    assert steps == sorted((t, n, i, p, *s) for t, own in want.items() for n, (p, _, many) in enumerate(own) for i, s in enumerate(many))
    assert measure.include_hashes(events.limit(0)).count() == 0 and measure.hash_history(events.limit(0)).count() == 0


def test_a_file_with_many_events(spark):
    """More events in one file than a run of hashes holds."""
    own = [("enter", "f"), *[("define", str(i)) for i in range(1200)], ("exit", "f")]
    events = spark.createDataFrame([(1, i, *e) for i, e in enumerate(own)], "task_id long, seq long, kind string, value string")
    (_, _, steps), = walked(own)
    assert [tuple(r) for r in measure.hash_history(events).orderBy("ord").select("before", "after").collect()] == [(s[0], s[4]) for s in steps]


@pytest.mark.parametrize("budget", [1, 20, 64, 5000])
def test_budget_groups(spark, budget):
    rng = random.Random(budget)
    units = {t: ["p" * rng.choice([0, 1, 5, 12, 90]) for _ in range(n)] for t, n in ((1, 130), (2, 1), (3, 30))}
    rows = [(t, i, p) for t, own in units.items() for i, p in enumerate(own)]
    want = set()
    for t, own in units.items():
        group = used = 0
        for i, p in enumerate(own):
            if used and used + len(p) + 1 > budget:
                group, used = group + 1, 0
            used += len(p) + 1
            want.add((t, i, p, group))
    got = measure.budget_groups(spark.createDataFrame(rows, "task_id long, ord long, path string"), budget).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    assert measure.budget_groups(spark.createDataFrame([], "task_id long, ord long, path string"), budget).count() == 0
