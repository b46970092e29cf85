"""Studies that are kept subject by subject."""

import shutil

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nightgrid.functions import generators
from nightgrid.plans import studies
from nightgrid.plans.study import Runner, Step, Study, guarded
from nightgrid.sources import recordings


def rows(spark, *subjects):
    return spark.createDataFrame([(s, i, float(i)) for s in subjects for i in range(4)], "subject_id string, i long, v double")


def doubled(name="double", need="raw", bad=(), **more):
    def kernel(t):
        who = t.column("subject_id")[0].as_py()
        if who in bad:
            raise RuntimeError(f"{who} is broken")
        return pa.table({"subject_id": t.column("subject_id"), "v": pa.array(t.column("v").to_numpy() * 2)})

    return Step(name, lambda x: guarded(x[need], kernel, "subject_id string, v double"), (need,), **more)


def summed(name="sum", need="double", **more):
    return Step(name, lambda x: x[need].groupBy("subject_id").agg(F.sum("v").alias("v")), (need,), **more)


def states(run, study):
    return {(r["step"], r["subject"]): r["state"] for r in run.state(study).collect()}


def runs_of(run, study, step):
    return {r["subject"]: r["run"] for r in run.state(study).filter(F.col("step") == step).collect()}


def values(df):
    return {r["subject_id"]: r["v"] for r in df.collect()}


def test_a_new_subject_is_computed_alone(spark, tmp_path):
    st, run = Study("s", [doubled(), summed()]), Runner(spark, str(tmp_path))
    run.run(st, {"raw": rows(spark, "a", "b")})
    before = runs_of(run, "s", "sum")
    files = sorted(str(p) for p in (tmp_path / "s").rglob("*.parquet"))
    out = run.run(st, {"raw": rows(spark, "a", "b", "c")})
    after = runs_of(run, "s", "sum")
    assert values(out["sum"]) == {"a": 12.0, "b": 12.0, "c": 12.0}
    assert {s: after[s] for s in "ab"} == before and after["c"] > before["a"]
    assert set(files) <= {str(p) for p in (tmp_path / "s").rglob("*.parquet")}  # the others' files are as they were
    new = spark.read.parquet(str(tmp_path / "s" / "double" / f"run={after['c']}"))
    assert {r[0] for r in new.select("subject_id").distinct().collect()} == {"c"}
    third = run.run(st, {"raw": rows(spark, "a", "b", "c")})
    assert runs_of(run, "s", "sum") == after and values(third["sum"]) == values(out["sum"])


def test_a_failing_subject_blocks_no_other(spark, tmp_path):
    run = Runner(spark, str(tmp_path))
    out = run.run(Study("s", [doubled(bad=("b",)), summed()]), {"raw": rows(spark, "a", "b", "c")})
    assert values(out["sum"]) == {"a": 12.0, "c": 12.0}
    assert states(run, "s") == {("double", "a"): "ok", ("double", "c"): "ok", ("double", "b"): "fail", ("sum", "a"): "ok", ("sum", "c"): "ok"}
    row = run.state("s").filter("state = 'fail'").first()
    assert row["code"] == "EXTRACT_FAILED" and "b is broken" in row["message"]
    # mended: only this subject runs
    before = runs_of(run, "s", "sum")
    out = run.run(Study("s", [doubled(), summed()]), {"raw": rows(spark, "a", "b", "c")})
    assert values(out["sum"]) == {"a": 12.0, "b": 12.0, "c": 12.0}
    assert {k: v for k, v in runs_of(run, "s", "sum").items() if k != "b"} == before


def test_a_failing_job_is_split_until_the_others_are_through(spark, tmp_path):
    def build(x):
        return x["raw"].withColumn("v", F.when(F.col("subject_id") == "s3", F.raise_error(F.lit("no s3"))).otherwise(F.col("v")).cast("double"))

    run = Runner(spark, str(tmp_path))
    out = run.run(Study("s", [Step("step", build, ("raw",))]), {"raw": rows(spark, *[f"s{i}" for i in range(6)])})
    assert {r[0] for r in out["step"].select("subject_id").distinct().collect()} == {f"s{i}" for i in range(6) if i != 3}
    assert out["step"].count() == 20 and states(run, "s")[("step", "s3")] == "fail"


def test_missing_inputs_and_dependencies(spark, tmp_path):
    run = Runner(spark, str(tmp_path))
    two = Step("both", lambda x: x["raw"].join(x["extra"].select("subject_id").distinct(), "subject_id"), ("raw", "extra"))
    run.run(Study("s", [two]), {"raw": rows(spark, "a", "b"), "extra": rows(spark, "a")})
    assert states(run, "s") == {("both", "a"): "ok", ("both", "b"): "fail"}
    assert run.state("s").filter("subject = 'b'").first()["code"] == "MISSING_INPUT"
    run.run(Study("t", [Step("q", lambda x: x["zz"], ("zz",)), summed(need="gone")]), {"raw": rows(spark, "a")})
    assert [r["code"] for r in run.state("t").collect()] == ["MISSING_INPUT"]  # the first failure of a subject ends its run


def test_what_a_killed_run_left_is_never_read(spark, tmp_path):
    st, run = Study("s", [doubled(), summed()]), Runner(spark, str(tmp_path))
    run.run(st, {"raw": rows(spark, "a")})
    rows(spark, "a", "z").select("subject_id", "v").write.parquet(str(tmp_path / "s" / "double" / "run=7"))
    assert run.table("s", "double").count() == 4
    assert any(p.endswith("run=7") for p in run.prune(Study("s", [doubled(), summed(final=True)])))
    assert not (tmp_path / "s" / "double" / "run=7").exists()


def test_rerun_and_force(spark, tmp_path):
    steps = [doubled("a", "raw"), doubled("b", "a"), doubled("c", "b")]
    st, run = Study("s", steps), Runner(spark, str(tmp_path))
    src = {"raw": rows(spark, "x")}
    run.run(st, src)
    first = {s: runs_of(run, "s", s)["x"] for s in "abc"}
    run.run(st, src, rerun={"a"})
    assert {s: runs_of(run, "s", s)["x"] for s in "abc"} == first  # all later steps are there, which comes before a rerun
    run.run(st, src, force={"a"})
    now = {s: runs_of(run, "s", s)["x"] for s in "abc"}
    assert now["a"] > first["a"] and (now["b"], now["c"]) == (first["b"], first["c"])
    run.run(st, src, rerun={"c"})
    assert runs_of(run, "s", "c")["x"] > now["c"]
    assert st.needed({"c"}) == [] and st.needed({"a", "b"}) == ["c"] and st.needed({"c"}, force={"b"}) == ["a", "b"] and st.needed({"a", "b", "c"}, rerun={"c"}) == ["c"]
    assert st.problems(("raw",)) == [] and Study("x", [doubled("q", "zz")]).problems() == ["q needs zz"]


def test_whole_table_steps_run_again_for_new_subjects(spark, tmp_path):
    norm = Step("norm", lambda x: x["double"].agg(F.count("*").alias("n")), ("double",), per_subject=False)
    st, run = Study("s", [doubled(), norm]), Runner(spark, str(tmp_path))
    assert run.run(st, {"raw": rows(spark, "a")})["norm"].first()["n"] == 4
    one = runs_of(run, "s", "norm")
    run.run(st, {"raw": rows(spark, "a")})
    assert runs_of(run, "s", "norm") == one
    assert run.run(st, {"raw": rows(spark, "a", "b")})["norm"].first()["n"] == 8 and runs_of(run, "s", "norm") != one


def test_consumed_streams_are_gone_and_trees_share_parents(spark, tmp_path):
    seen = []

    def look(x):
        seen.append(sorted(x))
        return x["clean"]

    clean = studies.transform_step("clean", lambda x: x["raw"].filter("v < 3"), ("raw",), gives="clean", optional=("^_track",))
    child = Study("child", [Step("leaf", lambda x: x["clean"].groupBy("subject_id").agg(F.max("v").alias("v")), ("clean",))])
    st = Study("s", [clean, Step("look", look, ("all",), optional=("heart_track",))], [child])
    run = Runner(spark, str(tmp_path))
    out = run.run(st, {"raw": rows(spark, "a"), "heart_track": rows(spark, "a")})
    assert seen == [["clean", "heart_track"]] and values(out["child/leaf"]) == {"a": 2.0}
    assert st.optional_of(0) == ("heart_track",)
    assert Study("bad", [clean, Step("x", look, ("raw",))]).problems(("raw",)) == ["x needs raw"]


def night(spark, subjects, seconds=400, fs=64):
    t = np.arange(seconds * fs) / fs
    ecg = sum(np.exp(-((t - b) ** 2) / (2 * 0.012**2)) for b in np.arange(0.5, seconds, 0.9))
    out = [(s, "ecg", c, float(fs), "uV", ecg[a : a + 300 * fs].tolist()) for s in subjects for c, a in enumerate(range(0, len(ecg), 300 * fs))]
    return out + [(s, "emg", 0, float(fs), "uV", np.sin(t[: 60 * fs]).tolist()) for s in subjects]


def test_pruned_study_keeps_tables_and_beats(spark, tmp_path):
    names = ("pan_tompkins", "hrv_features")
    st = Study("n", [studies.generator_step(n, studies.AFTER.get(n, ())) for n in names] + [studies.table_step(names, 6)])
    run = Runner(spark, str(tmp_path))
    signals = spark.createDataFrame(night(spark, ["a", "b"]), recordings.SCHEMA)
    out = run.run(st, {"signals": signals})
    tables, beats = out["feature_table_6s"].count(), out["pan_tompkins"].filter(studies.BEATS).count()
    assert tables > 0 and beats > 800
    run.prune(st)
    assert run.table("n", "feature_table_6s").count() == tables
    left = run.table("n", "pan_tompkins")
    assert left.count() == beats and left.filter(f"NOT ({studies.BEATS})").isEmpty()
    assert run.table("n", "hrv_features") is None and not any((tmp_path / "n" / "hrv_features").glob("run=*/*.parquet"))
    before = runs_of(run, "n", "feature_table_6s")
    run.run(st, {"signals": signals})
    assert runs_of(run, "n", "feature_table_6s") == before and run.prune(st) == []
    # a subject without its final table keeps all it has
    run.run(Study("n", st.steps[:1]), {"signals": spark.createDataFrame(night(spark, ["c"]), recordings.SCHEMA)})
    run.prune(st)
    assert run.table("n", "pan_tompkins").filter("subject_id = 'c' AND signal <> 'heartbeat_mask'").count() > 0


def test_steps_read_their_own_channels_only(spark, tmp_path):
    spark.createDataFrame(night(spark, ["a"]), recordings.SCHEMA).write.parquet(str(tmp_path / "signals"))
    step = studies.generator_step("pan_tompkins")
    df = step.build({"signals": spark.read.parquet(str(tmp_path / "signals"))})
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(channel,ecg)" in plan or "In(channel, [ecg])" in plan
    st = studies.dataset_study("cinc2018")
    assert st.problems(("signals",)) == [] and st.steps[-1].final and studies.used_channels(st, ["pan_tompkins"]) == ["ecg"]
    assert {s.name for s in studies.dataset_study("ucddb").steps if s.final} == {"feature_table_6s", "feature_table_1s"}
    assert set(studies.used_channels(st)) < {c for _, _, f in generators.GENERATORS.values() for c in f.channels} | {"x"}


def test_quality_frame(spark):
    q = spark.createDataFrame([("a", "p", i, float(i)) for i in range(45)] + [("a", "z", i, 1.0) for i in range(30)], "subject_id string, signal string, idx long, v double")
    labels = spark.createDataFrame([("a", 0, 2), ("a", 1, None), ("b", 0, 1)], "subject_id string, epoch_index long, label int")
    r = studies.quality_frame(q, labels).collect()
    assert len(r) == 1 and r[0]["inputs"] == {"p": 14.5, "z": 1.0} and r[0]["label"] == 2 and r[0]["seconds"] == 30


def test_no_subjects(spark, tmp_path):
    run = Runner(spark, str(tmp_path))
    assert set(run.run(Study("s", [doubled()]), {"raw": rows(spark, "a").limit(0)})) == {"raw"}
    with pytest.raises(ValueError):
        run.run(Study("s", [doubled()]), {"raw": spark.range(3)})
    shutil.rmtree(tmp_path)
