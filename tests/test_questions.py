"""Built questions: every example is valid, and shows the edge that its mode asks for."""

import pytest
from pyspark.sql import functions as F

from cellwise.operators import corpus, generate, questions, roundtrip, validator


@pytest.fixture(scope="module")
def drawn(spark):
    return questions.synthetic(spark.range(60), "id", 5, generate.Config(4, 6, 3, 4)).cache()


@pytest.mark.parametrize("kind", questions.KINDS)
@pytest.mark.parametrize("mode", ["normal", "empty", "near_threshold", "tie"])
def test_every_mode_is_valid(drawn, kind, mode):
    if mode not in ("normal", *questions.HARD[kind]):
        return
    rows = questions.BUILDERS[kind](drawn, F.lit(mode), 5).withColumn("k", F.col("metadata.example_id")).cache()
    verdict = validator.validate(rows, "k").collect()
    assert len(verdict) == 60 and all(r["valid"] for r in verdict), [r["failed"] for r in verdict if not r["valid"]][:3]
    done = {r["k"]: r for r in corpus.execute(rows, "k", "table.headers", "table.rows", "metadata.spec").collect()}
    got = rows.collect()
    for r in got:
        assert done[r["k"]]["answer"] == r["gold_answer"]["rows"]
        assert (r["metadata"]["difficulty"] == "hard") == bool(r["metadata"]["edge_cases"])
        assert 4 <= len(r["table"]["rows"]) <= 6 and 4 <= len(r["table"]["headers"]) <= 5
    edges = [e for r in got for e in r["metadata"]["edge_cases"]]
    assert mode not in ("empty",) or kind != "best_under_constraint" or edges == ["empty"] * 60
    assert mode != "tie" or edges.count("argmax_tie") > 30


def test_real_tables_in_both_orientations(spark):
    rows = [["Pilots", "7", "(9)", "n/a"], ["Tugs", "12", "5", "3"], ["Ferries", "12", "8", ""], ["Total", "31", "4", "3"]]
    table = (["port", "2004", "2005", "2006"], rows, None, ["categorical", "numeric", "numeric", "numeric"])
    df = spark.createDataFrame(
        [(f"t{i}", table, "u", "d", c) for i, c in enumerate(["high"] * 12 + ["low"])],
        "table_id string, table struct<headers array<string>, rows array<array<string>>, row_labels array<string>, column_types array<string>>, uid string, dataset string, confidence string"
    )
    got = questions.real_dataset(df, 2, hard=0.5).collect()
    assert all(r["valid"] for r in got) and {(r["metadata"]["orientation"], r["question_type"]) for r in got} == {
        (o, k) for o in ("across_rows", "across_columns") for k in questions.KINDS
    }
    for r in got:
        across = r["metadata"]["orientation"] == "across_rows"
        assert r["question"].endswith("Exclude any total or subtotal rows.") == across and r["table_id"].endswith("_rows" if across else "_cols")
        assert not across or 3 not in r["gold_answer"]["rows"] and r["metadata"]["spec"]["rows"] == [0, 1, 2]
        assert "12" not in r["table_id"]


def test_extremum_of_a_given_question(spark):
    table = (
        ["port", "2004", "2005"],
        [["Pilots", "7", "9"], ["Tugs", "7", "5"], ["Sum total", "14", "14"]],
        None,
        ["categorical", "numeric", "numeric"]
    )
    df = spark.createDataFrame(
        [("t", table, "u", "d", "high")],
        "table_id string, table struct<headers array<string>, rows array<array<string>>, row_labels array<string>, column_types array<string>>, uid string, dataset string, confidence string"
    )
    ask = lambda t, c, w: questions.build_extremum(t, F.lit(c), F.lit(w), F.lit("Which?"), F.array(F.lit("x"))).collect()
    one, two = ask(questions.as_rows(df), "2004", "lower")[0], ask(questions.as_columns(df), "Pilots", "higher")[0]
    assert one["gold_answer"]["rows"] == [0, 1] and one["metadata"]["edge_cases"] == ["argmax_tie"] and one["question_type"] == "rank_models" and one["split"] == "eval"
    assert two["gold_answer"]["label"] == "2005" and ask(questions.as_rows(df), "1999", "higher") == [] and ask(
        questions.as_rows(df),
        "2004",
        "upwards"
    ) == []


def test_dataset_and_round_trip(spark):
    valid, invalid = questions.synthetic_dataset(spark, 30, 9)
    rows = valid.collect()
    assert len(rows) == 30 and [
        r["question_type"] for r in sorted(rows, key=lambda r: r["table_index"])
    ] == list(questions.KINDS) * 10 and invalid.count() == 0
    keyed = valid.withColumn("k", F.col("metadata.example_id"))
    assert roundtrip.trainable(keyed, "k").count() == 30
    bad = keyed.withColumn("gold_answer", F.col("gold_answer").withField("rows", F.array(F.lit(0), F.lit(1), F.lit(2)).cast("array<int>")))
    failed = [r["failed"] for r in roundtrip.round_trip(bad, "k").collect()]
    assert sum("operation_exec" in f and "answer_correct" in f for f in failed) > 20
    with pytest.raises(ValueError, match="operation_exec"):
        roundtrip.trainable(bad, "k")


def test_threshold_is_never_a_value(spark):
    df = spark.createDataFrame(
        [
            ([1.0, 2.0, 3.0], m, d, u) for m in ("normal", "near_threshold", "empty") for d in ("higher", "lower") for u in (0.0, 0.4, 0.99)
        ] + [([2.0], "normal", "lower", 0.5), ([1.0, 1.08], "near_threshold", "lower", 0.0)],
        "v array<double>, m string, d string, u double"
    )
    for r in df.select("*", questions.choose_threshold(F.col("v"), F.col("d"), F.col("m"), F.col("u")).alias("t")).collect():
        assert all(abs(r["t"] - v) > 1e-9 for v in r["v"])
        if r["m"] == "empty":
            assert r["t"] < 1 if r["d"] == "lower" else r["t"] > 3
        elif r["m"] == "normal" and len(r["v"]) > 1:
            assert r["t"] in (1.5, 2.5)
