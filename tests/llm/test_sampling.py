import numpy as np

from cellwise.llm import sampling as s

TARGETS = [("a", 50, 1), ("b_c", 30, 1), ("rare", 10, 40), ("none_there", 10, 0)]


def test_flight_keeps_the_totals():
    rng = np.random.default_rng(1)
    group = rng.integers(0, 3, 300)
    pi = np.array([0.2, 0.5, 0.35])[group]
    x = np.zeros((300, 3))
    x[np.arange(300), group] = pi
    p = s.flight(pi, x, rng)
    assert ((p < 1e-9) | (p > 1 - 1e-9)).sum() >= 300 - 4
    for g in range(3):
        assert abs(p[group == g].sum() - pi[group == g].sum()) < 1e-6
    p = s.land(p, x, rng)
    assert set(np.round(p, 9)) <= {0.0, 1.0}
    for g in range(3):
        assert abs(p[group == g].sum() - pi[group == g].sum()) <= 1 + 1e-6


def test_inclusion_is_even():
    hits = np.zeros(40)
    for seed in range(400):
        rng = np.random.default_rng(seed)
        pi = np.full(40, 0.25)
        hits += s.land(s.flight(pi, pi[:, None], rng), pi[:, None], rng)
    assert hits.sum() == 400 * 10 and abs(hits / 400 - 0.25).max() < 0.12


def frames(spark, n=1000):
    cards = [(i, ["A", " b-c", "B C", "rare", "odd", None][min(5, i % 23 // 4)]) for i in range(n)] + [(5, "a"), (5, "a"), (None, "a")]
    keys = [(i, i) for i in range(0, n, 2)] + [(4, 9), (10**7, 1), (None, 1)]
    c = spark.createDataFrame(cards, "card_id bigint, type string").selectExpr("*", "'x' as category", "1 as unit", "0.5 as p")
    return c, spark.createDataFrame(keys, "card_id bigint, keyed_at bigint"), spark.createDataFrame(
        TARGETS,
        "category string, share_pct int, min_cards int"
    ), cards, keys


def test_sample_meets_the_targets(spark):
    c, k, t, cards, keys = frames(spark)
    sample, report = s.balanced_sample(c, k, t)
    norm = lambda x: x.strip().lower().replace(" ", "_").replace("-", "_")
    keyed = {i for i, _ in keys if i is not None}
    have = {}
    for i, x in cards:
        if x and i in keyed and norm(x) in {n for n, _, _ in TARGETS}:
            have.setdefault(norm(x), set()).add(i)
    size = sum(map(len, have.values())) // 4
    got = sample.collect()
    assert len({r["unit"] for r in got}) == len(got)
    for r in report.collect():
        need = next(max(m, size * p // 100) for n, p, m in TARGETS if n == r["category"])
        available = len(have.get(r["category"], ()))
        assert (r["n_needed"], r["n_available"], r["n_drawn"], r["filled"]) == (need, available, min(need, available), available >= need)
        assert {x["unit"] for x in got if x["category"] == r["category"]} <= have.get(r["category"], set())
    again, _ = s.balanced_sample(c, k, t)
    assert {r["unit"] for r in again.collect()} == {r["unit"] for r in got}


def test_empty_tables(spark):
    c, k, t, _, _ = frames(spark, 50)
    sample, report = s.balanced_sample(c.limit(0), k, t)
    assert sample.count() == 0 and report.where("filled").count() == 1
    assert s.balanced_sample(c, k, t.limit(0))[1].count() == 0


def test_pairs_fly_as_the_general_step_does(monkeypatch):
    """Both ways keep the totals of every category and the chances of every unit."""
    group = np.arange(60) % 3
    pi = np.array([0.2, 0.5, 0.35])[group]
    x = np.zeros((60, 3))
    x[np.arange(60), group] = pi
    hits = {}
    for way in ("pairs", "general"):
        if way == "general":
            monkeypatch.setattr(s.np, "allclose", lambda *a: False)
        hits[way] = np.mean([s.land(s.flight(pi, x, r), x, r) for r in map(np.random.default_rng, range(300))], axis=0)
    assert all(abs(h - pi).max() < 0.12 for h in hits.values())


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK_UNITS", 20)
    c, k, t, _, _ = frames(spark, 3000)
    _, report = s.balanced_sample(c, k, t)
    assert all(r["n_drawn"] == min(r["n_needed"], r["n_available"]) for r in report.collect())
