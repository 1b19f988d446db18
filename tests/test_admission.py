"""Ordered admission against one loop, and densities against direct kernel sums."""

import datetime as dt
import math
import random
from decimal import Decimal

import pytest

from tidemark.operators import accounts, metrics

rng = random.Random(17)
START = dt.datetime(2024, 1, 1)


def brute(rows, limits):
    used, out = {}, []
    for user, at, key, amount in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        quota, now = limits.get(user), used.get(user, Decimal(0))
        a = None if amount is None else Decimal(str(amount))
        ok = a is not None and a >= 0 and quota is not None and (quota < 0 or now + a <= Decimal(str(quota)))
        used[user] = now + (a if ok else 0)
        out.append((key, ok, used[user]))
    return sorted(out)


def test_admission(spark):
    limits = {"hot": 1000.0, "small": 10.0, "free": -1.0, "none": None, "zero": 0.0, "exact": 6.5}
    rows = []
    for user, n in (("hot", 900), ("small", 60), ("free", 30), ("none", 5), ("zero", 5), ("exact", 40), ("unlisted", 5)):
        for _ in range(n):
            at = START + dt.timedelta(hours=rng.randint(0, 24 * 60))  # many ties, several buckets
            rows.append((user, at, len(rows), rng.choice([0.5, 1.0, 2.25, 3.0, 400.0, 999.0, 0.0, round(rng.random() * 20, 2)])))
    rows += [("hot", START, 10**6, None), ("small", START, 10**6 + 1, -5.0), ("small", START + dt.timedelta(days=99), 10**6 + 2, 0.0)]
    requests = spark.createDataFrame(rows, "user_id string, at timestamp, id long, amount double").repartition(4)
    plans = spark.createDataFrame(list(limits.items()), "user_id string, quota double")
    out = accounts.admit(requests, plans, "amount", "at", "id")
    assert out.columns == ["user_id", "at", "id", "amount", "admitted", "used"]
    assert sorted((r["id"], r["admitted"], r["used"]) for r in out.collect()) == brute(rows, limits)
    assert accounts.admit(requests.limit(0), plans, "amount", "at", "id").collect() == []


def test_admission_of_alternating_amounts(spark):
    """One small and one too large in turn: each loop over rejections would need as many rounds as rows."""
    rows = [("u", START + dt.timedelta(minutes=i), i, 1.0 if i % 2 else 300.0 - i / 2) for i in range(400)]
    out = accounts.admit(spark.createDataFrame(rows, "user_id string, at timestamp, id long, amount double"), spark.createDataFrame([("u", 250.0)], "user_id string, quota double"), "amount", "at", "id")
    assert sorted((r["id"], r["admitted"], r["used"]) for r in out.collect()) == brute(rows, {"u": 250})


def test_density(spark):
    groups = {"a": [rng.gauss(0, 1) for _ in range(300)], "b": [float(rng.randint(0, 3)) for _ in range(50)], None: [1.0, 5.0], "same": [2.0] * 9, "one": [3.0], "no": []}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None, float("nan"), float("inf")]]
    out = metrics.density(spark.createDataFrame(rows, "g string, v double"), "g", "v", points=40, cells=4096).collect()
    assert {r["g"] for r in out} == {"a", "b", None}
    for g in ("a", "b", None):
        vs, got = groups[g], sorted((r["point"], r["x"], r["density"]) for r in out if r["g"] == g)
        mean = sum(vs) / len(vs)
        w = math.sqrt(sum((v - mean) ** 2 for v in vs) / (len(vs) - 1)) * len(vs) ** -0.2
        assert [p for p, _, _ in got] == list(range(40))
        assert got[0][1] == pytest.approx(min(vs) - 2 * w) and got[-1][1] == pytest.approx(max(vs) + 2 * w)
        for _, x, d in got:
            assert d == pytest.approx(sum(math.exp(-(((x - v) / w) ** 2) / 2) for v in vs) / (len(vs) * w * math.sqrt(2 * math.pi)), rel=1e-4, abs=1e-7)
