import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cellwise.llm import grouping as g

TARGETS = [("train", 0.7), ("validation", 0.12), ("test", 0.18)]


def rows(n=4000, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        t = "Hot-table_rows" if r.random() < 0.1 else f" tab_{r.randint(0, 900)}_{r.choice(['rows', 'cols', 'cols_v2'])}"
        out.append(
            (
                i,
                r.choice([t, t.upper(), t.replace("_", "-"), None]),
                r.choice([f"u{r.randint(0, 3000)}", None, " "]),
                r.choice(["a", "b", "B ", None]),
                r.choice(["train", "TRAIN ", "dev", None, " "])
            )
        )
    return out


def norm(t):
    t = t.strip().lower().replace("-", "_")
    t = t[:-3] if t.endswith("_v2") else t
    return t[:-5] if t.endswith(("_rows", "_cols")) else t


def components(data):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, t, u, *_ in data:
        a = ("t", norm(t)) if t else None
        b = ("e", u.strip()) if u and u.strip() else None
        for e in (a, b):
            if e:
                up[find(("r", i))] = find(e)
        find(("r", i))
    return {i: find(("r", i)) for i, *_ in data}


def test_components_stay_together(spark):
    data = rows()
    df = spark.createDataFrame(data, "rec_id bigint, table_id string, uid string, kind string, split string").selectExpr(
        "*",
        "1 as component",
        "2 as node",
        "'x' as stratum",
        "named_struct('uid', uid) as source"
    )
    assigned, report, broken = g.grouped_splits(
        df,
        spark.createDataFrame(TARGETS, "split_name string, share double"),
        "rec_id",
        "table_id",
        "source.uid",
        "kind",
        "split"
    )
    got = {r["rec_id"]: r for r in assigned.collect()}
    assert set(got) == {i for i, *_ in data}
    truth = components(data)
    by = defaultdict(set)
    for i, c in truth.items():
        by[c].add((got[i]["component"], got[i]["split"]))
    assert all(len(v) == 1 for v in by.values())
    assert len(by) == len({r["component"] for r in got.values()})
    n = Counter(r["split"] for r in got.values())
    sizes = Counter(truth.values()).most_common(1)[0][1]
    for name, share in TARGETS:
        assert abs(n[name] / len(data) - share) < max(0.02, sizes / len(data))
    want = defaultdict(set)
    for _, t, _, _, s in data:
        if t and s and s.strip():
            want[norm(t)].add(s.strip().lower())
    assert {r["base_table"] for r in broken.collect()} == {t for t, s in want.items() if len(s) > 1}
    assert report.agg(F.sum("n_records")).first()[0] == len(data)


def test_long_chain(spark):
    data = [(i, f"t{i // 2}", f"u{(i + 1) // 2}", "a", None) for i in range(300)]
    edges = g.links(
        spark.createDataFrame(data, "rec_id bigint, table_id string, uid string, kind string, split string"),
        "rec_id",
        "table_id",
        "uid",
        "kind",
        "split"
    )
    assert g.components(edges).select("label").distinct().count() == 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], "rec_id bigint, table_id string, uid string, kind string, split string")
    t = spark.createDataFrame(TARGETS, "split_name string, share double")
    assert [x.count() for x in g.grouped_splits(df, t, "rec_id", "table_id", "uid", "kind", "split")] == [0, 0, 0]


def test_giant_component_and_hub(spark):
    """A hub that a third of all records name, and a chain beside it."""
    data = [(i, f"t{i}", "hub" if i % 3 == 0 else f"u{i // 2}", "a", "train") for i in range(6000)]
    df = spark.createDataFrame(data, "rec_id bigint, table_id string, uid string, kind string, split string")
    assigned, _, broken = g.grouped_splits(
        df,
        spark.createDataFrame(TARGETS, "split_name string, share double"),
        "rec_id",
        "table_id",
        "uid",
        "kind",
        "split"
    )
    got = {r["rec_id"]: (r["component"], r["split"]) for r in assigned.collect()}
    truth = components(data)
    assert len(got) == len(data) and len({(truth[i], *got[i]) for i in got}) == len(set(truth.values()))
    assert broken.count() == 0


def test_many_strata(spark, monkeypatch):
    monkeypatch.setattr(g, "STRATA", 3)
    data = [(i, f"t{i}", None, f"s{i % 11}", None) for i in range(600)]
    df = spark.createDataFrame(data, "rec_id bigint, table_id string, uid string, kind string, split string")
    assigned, _, _ = g.grouped_splits(
        df,
        spark.createDataFrame(TARGETS, "split_name string, share double"),
        "rec_id",
        "table_id",
        "uid",
        "kind",
        "split"
    )
    n = Counter(r["split"] for r in assigned.collect())
    assert all(abs(n[k] / 600 - s) < 0.02 for k, s in TARGETS)
