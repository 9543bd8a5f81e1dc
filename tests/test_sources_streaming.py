import json

import pytest
from pyspark.sql import functions as F

from dyadscope.operators import equation
from dyadscope.sources import readers, sinks
from dyadscope.streaming import run_events


def test_registry_documents(spark, tmp_path):
    rows = [{"feature_name": "a", "allowed_in_scan": 1}, {"other": 2}]
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "wrapped.json").write_text(json.dumps({"meta": {}, "feature_registry": rows}))
    for name in ("list.json", "wrapped.json"):
        assert [r.feature_name for r in readers.read_registry(spark, str(tmp_path / name)).collect()] == ["a"]


def test_contexts_documents_and_merge(spark, tmp_path):
    rows = [{"name": "Five Years!", "y_col": "y_5y"}, {"context_scope": "any", "source_cols": ["a", " "], "group_mode": "at_least_k", "threshold": 2}]
    for text in (json.dumps(rows), json.dumps({"contexts": rows})):
        (tmp_path / "c.json").write_text(text)
        got = readers.read_contexts(spark, str(tmp_path / "c.json")).orderBy("position").collect()
        assert [(r.context_scope, r.y_col) for r in got] == [("five_years", "y_5y"), ("any", "y_group__any")]
        assert got[1].source_cols == ["a"] and got[1].threshold == 2
    given = readers.read_contexts(spark, str(tmp_path / "c.json"))
    defaults = spark.createDataFrame([(0, "all_contexts", "y_all"), (1, "five_years", "y_5y")], "position int, context_scope string, y_col string")
    assert readers.merge_contexts(defaults, given).count() == 3
    assert readers.merge_contexts(defaults, given, "replace").count() == 2
    assert len(readers.check_contexts(given, ["a", "y_5y"])) == 2
    with pytest.raises(ValueError, match="missing source columns"):
        readers.check_contexts(given, ["y_5y"])


def test_run_history_keeps_the_later_document(spark, tmp_path):
    def put(name, **doc):
        (tmp_path / name).write_text(json.dumps(doc))

    put("summary_1.json", run_id="r1", timestamp="2026-01-01", status="ok", counts={"scan_rows": 3, "bad": -1}, search_governance={"validation_used_for_search": False})
    put("summary_2.json", run_id="r2__singlex", timestamp="2026-01-02", status="error")
    put("paired_1.json", run_id="r1", timestamp="2026-01-01", mode="paired_x")
    out = {r.run_id: r for r in readers.read_run_history(spark, [("run_summary", f"{tmp_path}/summary_*.json"), ("paired_summary", f"{tmp_path}/paired_*.json")]).collect()}
    assert out["r1"].source_kind == "paired_summary" and out["r1"].mode == "paired_x"
    assert out["r2__singlex"].state == "failed" and out["r2__singlex"].mode == "singlex_baseline"
    alone = readers.read_run_history(spark, [("run_summary", f"{tmp_path}/summary_1.json")]).first()
    assert alone.counts == {"scan_rows": 3} and json.loads(alone.search_governance) == {"validation_used_for_search": False}


def test_inference_scan_tags_runs_and_fills_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("candidate_id,status_validation,p_boot_validation\nc1,ok,0.2\n")
    (tmp_path / "b.csv").write_text("candidate_id,status_validation,p_boot_validation\nc2,,x\n")
    out = readers.read_inference(spark, [("r1", "m", str(tmp_path / "a.csv")), ("r2", "m", str(tmp_path / "b.csv"))])
    assert {(r.run_id, r.candidate_id, r.q_value_validation) for r in out.collect()} == {("r1", "c1", None), ("r2", "c2", None)}


def test_inference_scan_goes_by_header_names_and_full_paths(spark, tmp_path):
    """Two runs with one base name, columns in another order, old names of p and q, and a folder of parts."""
    for d in ("one", "two", "three"):
        (tmp_path / d).mkdir()
    (tmp_path / "one/top.csv").write_text("candidate_id,track,p_boot_validation,q_value_validation\nc1,t,0.1,0.2\n")
    (tmp_path / "two/top.csv").write_text("q_value,candidate_id,p_value_validation,track\n0.4,c2,0.3,t\n")
    (tmp_path / "three/part-0.csv").write_text('candidate_id,key_factor\nc3,"a,b"\n')
    (tmp_path / "three/part-1.csv").write_text("key_factor,candidate_id\nf,c4\n")
    runs = [("r1", "m1", str(tmp_path / "one/top.csv")), ("r2", "m2", f"file://{tmp_path}/two/top.csv"), ("r3", "m3", str(tmp_path / "three"))]
    got = sorted(tuple(r[c] for c in ("run_id", "mode", "candidate_id", "track", "p_boot_validation", "q_value_validation", "key_factor")) for r in readers.read_inference(spark, runs).collect())
    assert got == [("r1", "m1", "c1", "t", "0.1", "0.2", None), ("r2", "m2", "c2", "t", "0.3", "0.4", None),
                   ("r3", "m3", "c3", None, None, None, "a,b"), ("r3", "m3", "c4", None, None, None, "f")]


def test_files_over_the_bound_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    import hashlib

    (tmp_path / "big one.bin").write_bytes(b"x" * 5_000_000)
    (tmp_path / "small.bin").write_bytes(b"y")
    monkeypatch.setattr(readers, "WHOLE_FILE", 1000)
    got = {r.n_bytes: r.sha256 for r in readers.file_manifest(spark, f"{tmp_path}/*.bin").collect()}
    assert got == {5_000_000: hashlib.sha256(b"x" * 5_000_000).hexdigest(), 1: hashlib.sha256(b"y").hexdigest()}


def test_only_small_files_are_whole_values(spark, tmp_path):
    """A task holds a whole value several times over: none is larger than 32 MB, but where only Spark opens the file system."""
    import hashlib

    data = {n: bytes(range(256)) * (n // 256) for n in (1024, 40 << 20)}
    for n, content in data.items():
        (tmp_path / f"of%20 {n}.bin").write_bytes(content)
    want = {n: hashlib.sha256(content).hexdigest() for n, content in data.items()}
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(32 << 20))
    try:
        assert {r.n_bytes: r.sha256 for r in readers.file_manifest(spark, f"{tmp_path}/*.bin").collect()} == want
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.manifest.link./in", f"file://{tmp_path}")
    assert {r.n_bytes: r.sha256 for r in readers.file_manifest(spark, "viewfs://manifest/in/*.bin").collect()} == want


def test_files_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "x int, tags array<string>")
    sinks.write_rows(df, str(tmp_path / "out"), ["tags", "x", "gone"], format="csv")
    back = readers.read_table(spark, str(tmp_path / "out"))
    assert back.columns == ["tags", "x", "gone"] and json.loads(back.first().tags) == ["a", "b"]
    sinks.write_log(df, str(tmp_path / "log"))
    sinks.write_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.write_document(spark, {"b": 1, "a": "ä"}, str(tmp_path / "doc"))
    assert json.loads(spark.read.text(str(tmp_path / "doc")).first()[0]) == {"a": "ä", "b": 1}
    (tmp_path / "in_1.csv").write_text("x\n1\n")
    assert readers.resolve_input(spark, str(tmp_path / "locked.csv"), str(tmp_path / "in_*.csv"))[1] == "fallback_latest_glob"
    assert readers.resolve_input(spark, str(tmp_path / "locked.csv"), str(tmp_path / "zz_*.csv"))[1] == "missing_default_no_fallback"
    import hashlib

    row = readers.file_manifest(spark, str(tmp_path / "in_1.csv")).first()
    assert row.sha256 == hashlib.sha256(b"x\n1\n").hexdigest() and row.n_bytes == 4


def log_line(ts, run, state):
    return json.dumps({"ts": f"2026-01-01T00:00:{ts:02d}Z", "event_type": "t", "run_id": run, "mode": "m", "state": state, "attempt": 1})


def test_status_stream_over_several_batches(spark, tmp_path):
    log, table, ckpt = (str(tmp_path / d) for d in ("log", "status", "ckpt"))
    (tmp_path / "log").mkdir()

    def feed(name, *lines):
        (tmp_path / "log" / name).write_text("\n".join(lines))
        run_events.maintain_status(run_events.read_events(spark, log), table, ckpt).awaitTermination()
        return {r.run_id: (r.state, r.n_events, r.n_illegal) for r in run_events.read_status(spark, table).collect()}

    assert feed("1.json", log_line(1, "a", "queued"), log_line(2, "a", "running")) == {"a": ("running", 2, 0)}
    # b jumps from queued to succeeded; the late event for a counts but does not move it back
    got = feed("2.json", log_line(3, "a", "succeeded"), log_line(1, "a", "queued"), log_line(1, "b", "queued"), log_line(2, "b", "succeeded"))
    assert got == {"a": ("succeeded", 4, 0), "b": ("succeeded", 2, 1)}
    got = feed("3.json", log_line(9, "a", "running"))
    assert got["a"] == ("running", 5, 1) and got["b"] == ("succeeded", 2, 1)
    # The last batch touched one run and wrote one run.
    assert [r.run_id for r in spark.read.parquet(f"{table}/v=2").collect()] == ["a"]
    run_events.compact_status(spark, table, str(tmp_path / "compact"))
    assert {r.run_id: r.n_events for r in run_events.read_status(spark, str(tmp_path / "compact")).collect()} == {"a": 5, "b": 2}


def test_moves_of_a_run_by_plain_reading():
    events = [(5, 1, "succeeded"), (1, 1, "queued"), (3, 1, "running")]
    assert run_events.moved(None, events) == ("succeeded", 5, 3, 0)
    assert run_events.moved(("succeeded", 5, 3, 0), [(2, 1, "queued")]) == ("succeeded", 5, 4, 0)
    assert run_events.moved(("succeeded", 5, 3, 0), [(5, 2, "running"), (6, 2, "running")]) == ("running", 6, 5, 1)


def test_first_submission_wins_in_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("2026-01-01T00:00:01Z", "k1", "r1"), ("2026-01-01T00:00:05Z", "k1", "r2"), ("2026-01-01T00:00:02Z", "k2", "r3")]
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"ts": t, "idempotency_key": k, "run_id": r}) for t, k, r in rows))
    stream = spark.readStream.schema("ts timestamp, idempotency_key string, run_id string").json(str(tmp_path / "in"))
    q = run_events.first_submissions(stream).writeStream.format("memory").queryName("first_submissions").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.idempotency_key for r in spark.table("first_submissions").collect()} == {"k1", "k2"}
    assert spark.table("first_submissions").count() == 2
    batch = spark.createDataFrame(rows, "ts string, idempotency_key string, run_id string")
    assert {r.run_id: r.effective_run_id for r in run_events.submissions(batch).collect()} == {"r1": "r1", "r2": "r1", "r3": "r3"}


def test_explorer_view_equals_the_full_result_after_every_batch(spark, tmp_path):
    import random

    from dyadscope.operators import explore

    schema = "run_id string, mode string, track string, context_scope string, y_col string, spec_id string, key_factor string, status_validation string, candidate_tier string, p_boot_validation double, q_value_validation double, validated_rate_restart double"
    (tmp_path / "in").mkdir()
    rng, everything, store = random.Random(4), [], str(tmp_path / "store")
    for batch in range(3):
        rows = [dict(
            run_id=f"r{rng.randrange(6)}", mode="m", track=f"t{rng.randrange(2)}", context_scope="c", y_col=rng.choice(["y", ""]), spec_id="s", key_factor=rng.choice(["f", "g", f"only{batch}", ""]),
            status_validation=rng.choice(["ok", "failed", ""]), candidate_tier=rng.choice(["support_candidate", "validated_candidate"]), p_boot_validation=rng.choice([None, rng.random()]),
            q_value_validation=rng.choice([None, 0.05, rng.random()]), validated_rate_restart=rng.choice([None, 0.5]),
        ) for _ in range(60)]
        everything += rows
        (tmp_path / "in" / f"{batch}.json").write_text("\n".join(json.dumps(r) for r in rows))
        run_events.maintain_explorer(spark.readStream.schema(schema).json(str(tmp_path / "in")), store, str(tmp_path / "ck")).awaitTermination()
        full = explore.usable_rows(spark.createDataFrame([tuple(r.values()) for r in everything], schema))
        for name, want in (("combinations", explore.combinations(full)), ("factors", explore.factors(full))):
            view = run_events.read_view(spark, store, name).select(*want.columns)
            rounded = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
            assert rounded(view) == rounded(want)
    # The last batch wrote the factors it touched, not those of the first batch alone.
    assert "only0" not in {r.key_factor for r in spark.read.parquet(f"{store}/factors/view/v=2").collect()}


def test_equation_path_gains_from_the_right_factor(spark):
    from tests.test_designs_scan import choice_frame

    df = choice_frame(spark)
    args = dict(controls=["anchor"], track="all", split_role="all", n_bootstrap=15)
    steps = equation.equation_steps(df, ["x_feat", "x_feat", "nowhere"], **args).orderBy("step").collect()
    assert [(r.step, r.added_factor) for r in steps] == [(0, "(base_controls)"), (1, "x_feat")]
    assert steps[1].delta_accuracy_mean > 0 and steps[1].n_events == 90 and steps[1].equation == "y_all ~ anchor + x_feat"
    assert steps[0].delta_accuracy_mean is None and steps[1].bootstrap_success == 15
    far = equation.equation_steps(df, ["x_feat"], grouped_fit_max_events=0, **args).orderBy("step").collect()
    assert far[1].accuracy_mean == pytest.approx(steps[1].accuracy_mean, abs=1e-6)
    summary = equation.path_summary(equation.equation_steps(df, ["x_feat"], **args)).first()
    assert summary.best_step == 1 and summary.top_positive_contributor == "x_feat"
    with pytest.raises(ValueError, match="none of the requested factors"):
        equation.equation_steps(df, ["nowhere"], **args)


def test_accuracy_ties_follow_the_first_row(spark):
    df = spark.createDataFrame([(True, 0.0), (False, 0.0), (True, 1.0), (True, -1.0)], "chosen_first boolean, z double")
    assert equation.event_accuracy(df, F.col("z")).first().accuracy == 0.5


def test_first_lines_need_no_sort(spark, tmp_path):
    """Headers are found by a minimum of line numbers, whatever the size of a block of lines."""
    from dyadscope.sources.readers import first_lines

    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(f"{name},x\n" + "1,2\n" * 50)
    found = first_lines(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted(r["value"] for r in found.collect()) == ["a,x", "b,x"]
    assert "Sort" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_batch_is_many_files(spark, tmp_path):
    """Batches of a stream grow by files, not by the size of one file."""
    from dyadscope.plans.run_queries import _deal

    per_batch = _deal(spark.range(0, 8000, 1, 8), str(tmp_path / "rows"), 3)
    files = spark.read.parquet(str(tmp_path / "rows")).inputFiles()
    assert per_batch == 8 and len(files) == 24
    assert max(spark.read.parquet(f).count() for f in files) <= 1000
