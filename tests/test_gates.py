import pytest

from dyadscope.operators import gates
from dyadscope.settings import ScanSettings

ROWS = "name string, split_role string, y_col string, n_docs_total bigint, n_informative bigint, n_docs bigint, top1_share double, missing_y string, missing_exog string"


def verdicts(spark, rows, **settings):
    df = spark.createDataFrame(rows, ROWS)
    return {r.name: r for r in gates.gate_cascade(df, ScanSettings.of(**settings).gates).collect()}


def test_first_failing_gate_wins(spark):
    out = verdicts(
        spark,
        [
            ("y", "validation", "y", 1, 0, 0, None, "y_gone", "x"),
            ("x", "discovery", "y", 50, 500, 50, 0.1, None, "x1|x2"),
            ("docs", "validation", "y", 29, 500, 29, 0.1, None, None),
            ("docs_discovery", "discovery", "y", 29, 500, 29, 0.1, None, None),
            ("flat", "discovery", "y", 50, 0, 0, None, None, None),
            ("events", "validation", "y", 50, 99, 40, 0.9, None, None),
            ("clusters", "discovery", "y", 50, 40, 9, 0.9, None, None),
            ("top", "validation", "y", 50, 100, 30, 0.25, None, None),
            ("edge", "validation", "y", 50, 100, 30, 0.20, None, None),
        ],
    )
    assert {k: v.reason_code for k, v in out.items()} == {
        "y": "missing_y_column", "x": "missing_feature_columns", "docs": "validation_gate_infeasible_policy_docs", "docs_discovery": "fit",
        "flat": "not_estimable_low_within_event_variation", "events": "validation_low_informative_events",
        "clusters": "not_estimable_low_policy_doc_clusters", "top": "validation_high_policy_doc_concentration", "edge": "fit",
    }
    assert out["docs"].n_docs == 29 and out["docs"].n_informative == 0 and out["docs"].reason_detail == "max_docs_possible=29 < gate=30"
    assert out["events"].top1_share == 0.9 and out["events"].reason_detail == "99 < 100"
    assert out["top"].reason_detail == "0.2500 > 0.2000" and out["top"].status == "not_validated_out_of_sample"


def test_feasibility_modes(spark):
    table = spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("c", 1, 1)], "y_col string, is_unusable int, is_below_floor int")
    assert gates.check_outcome_feasibility(table) == {"unusable": ["c"], "below_floor": ["b", "c"]}
    with pytest.raises(ValueError, match="unusable"):
        gates.check_outcome_feasibility(table, "fail_unusable")
    with pytest.raises(ValueError, match="b, c"):
        gates.check_outcome_feasibility(table, "fail_below_floor")
    with pytest.raises(ValueError, match="must be one of"):
        gates.check_outcome_feasibility(table, "stop")


def test_scaled_and_profiled_gates(spark):
    assert gates.autoscaled_gates(100, 30, 0.2, 10, 5) == (20, 6)
    assert gates.autoscaled_gates(100, 30, 0.01, 10, 5) == (10, 5)
    caps = spark.createDataFrame([(45, 0)], "min_track_events_validation bigint, min_track_docs_validation bigint")
    assert tuple(gates.profiled_gates(caps, "feasibility_diagnostic", events=100, docs=30).first()) == (45, 30)
    assert tuple(gates.profiled_gates(caps, "adaptive_production", events=100, docs=30, rounding="round").first()) == (22, 30)
    assert tuple(gates.profiled_gates(caps, "strict_production", events=100, docs=30).first()) == (100, 30)
