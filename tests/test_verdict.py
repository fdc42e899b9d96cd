from folio.plans import verdict as V


def test_verdict(spark):
    schema = "id int, raw_scored int, artifact_scored int, raw_tokens double, artifact_tokens double, accuracy_gain double, coverage double, fidelity double, visible_chars int"
    rows = [
        (1, 20, 20, 1000.0, 50.0, 0.25, 0.95, 0.99, 5000), (2, 20, 20, 100.0, 500.0, 0.25, 0.95, 0.99, 10), (3, 20, 20, 1000.0, 500.0, 0.1, 0.5, None, 5000),
        (4, 0, 20, 1000.0, 50.0, None, 0.95, 0.99, 5000), (5, 20, 20, 0.0, 50.0, None, 0.9, 0.98, None),
    ]
    out = {r.id: r for r in V.verdict(spark.createDataFrame(rows, schema)).collect()}
    assert out[1].passed and out[1].token_reduction == 0.95 and out[1].missed == []
    assert out[2].passed and not out[2].reduction_applies and out[2].token_reduction == -4.0
    assert out[3].missed == ["token reduction", "accuracy gain", "coverage", "fidelity"] and not out[3].passed
    assert out[4].passed is None and out[4].missed is None and out[4].token_reduction is None
    assert out[5].missed == ["accuracy gain"] and out[5].token_reduction == 0.0


def test_gain_is_over_paired_questions(spark):
    rows = [("r", 1, "raw", 0.5), ("r", 1, "artifact", 1.0), ("r", 2, "artifact", 0.0), ("r", 3, "raw", None), ("r", 3, "artifact", 0.0), ("r", 4, "raw", 1.0), ("r", 4, "artifact", 1.0)]
    got = V.paired_gain(spark.createDataFrame(rows, "run string, question_id int, condition string, accuracy double"), "run").collect()
    assert [(r.compared, r.accuracy_gain) for r in got] == [(2, 0.25)]
    assert V.paired_gain(spark.createDataFrame([], "run string, question_id int, condition string, accuracy double"), "run").collect() == []
