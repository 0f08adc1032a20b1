"""Parameter checks, explanations, log reading."""

import pytest
from pyspark.sql import functions as F

from plumbline import settings
from plumbline.operators import contacts, explain, preparation
from plumbline.runtime import fresh_path
from plumbline.sources import events, structures, sequences
from plumbline.streaming import progress


@pytest.mark.parametrize("make", [
    lambda: settings.ControlTest(n_shuffles=18), lambda: settings.ControlTest(alpha=1.0),
    lambda: settings.Comparison(moderate=0.9, strong=0.8), lambda: settings.Comparison(weight_size=0, weight_charge=0),
    lambda: settings.Comparison(sigma=0), lambda: settings.Criterion("x", "sideways"),
    lambda: settings.Criterion("x", "lower", -1), lambda: settings.active([settings.Criterion("x", "lower", 0)]),
    lambda: settings.TargetRequest(chain="B", partners=("B",)), lambda: settings.TargetRequest(mode="groove"),
    lambda: settings.check_lengths(30, 20)])
def test_bad_parameters(make):
    with pytest.raises(ValueError):
        make()


def record(spark, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {explain.COLUMNS[k]}" for k in values)) if values else spark.range(1)


def test_caution_survives_praise(spark):
    df = record(spark, shuffle_pass=False, shuffle_wins=3, shuffle_n=20, shuffle_p_value=0.9, ensemble_defect=0.01,
                ensemble_defect_score=0.99, mfe_norm=-0.5, mfe_norm_score=0.95, positional_entropy_mean=0.1,
                positional_entropy_mean_score=0.99, stem_fraction=0.6, stem_fraction_score=0.9, n_hairpins=1)
    e = explain.explain(df).first()["explanation"]
    assert e["rules_fired"][0] == "shuffle_fail" and len(e["rules_fired"]) == 4
    assert "beat 3 of 20, p = 0.900" in e["text"] and e["text"].endswith(settings.TARGET_CAVEAT)


def test_no_number_no_sentence(spark):
    df = record(spark, shuffle_pass=False, shuffle_n=20, shuffle_p_value=0.9)
    assert explain.explain(df).first()["explanation"]["rules_fired"] == []


def test_own_rules(spark):
    mine = (explain.Rule("tall", "neutral", 1, "stem_fraction > 0.5", "Quite %.1f", ("stem_fraction",), "tall"),)
    e = explain.explain(record(spark, stem_fraction=0.75), mine, caveat=None).first()["explanation"]
    assert e["text"] in ("Quite 0.8", "Quite 0.7") and e["chips"][0]["label"] == "tall"


def test_contacts_against_all_pairs(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    a, b = rng.uniform(-20, 20, (120, 3)), rng.uniform(-20, 20, (80, 3))
    schema = "residue_number int, x double, y double, z double"
    da = spark.createDataFrame([(i // 4, *map(float, p)) for i, p in enumerate(a)], schema)
    db = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)], schema)
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).min(1)
    want = {}
    for i, v in enumerate(d):
        if v <= 4.5:
            want[i // 4] = min(want.get(i // 4, 9), v)
    got = {r["residue_number"]: r["min_distance_A"] for r in contacts.interface_contacts(da, db).collect()}
    assert got == {k: pytest.approx(v, abs=0.0051) for k, v in want.items()}


def test_zero_overlap(spark):
    pockets = spark.createDataFrame([(1, 1, 0.9, None), (1, 2, 0.5, 0.3)], "target_id long, pocket_index int, score double, druggability double")
    over = pockets.withColumn("overlap_count", F.lit(0).cast("long"))
    def pick(require, allow):
        req = spark.createDataFrame([(1, 4, require, allow)], "target_id long, n_requested long, require_overlap boolean, allow_zero_overlap boolean")
        return preparation.select_pocket(pockets, over, req).first()
    assert pick(True, False)["status"] == "failed"
    fallback = pick(True, True)
    assert (fallback["pocket_index"], fallback["method"]) == (1, "target_site_zero_overlap_fallback")


def test_tie_break_prefers_known_druggability(spark):
    pockets = spark.createDataFrame([(1, 1, 0.5, None), (1, 2, 0.5, 0.1)], "target_id long, pocket_index int, score double, druggability double")
    req = spark.createDataFrame([(1, 0, True, False)], "target_id long, n_requested long, require_overlap boolean, allow_zero_overlap boolean")
    out = preparation.select_pocket(pockets, pockets.withColumn("overlap_count", F.lit(0).cast("long")), req).first()
    assert out["pocket_index"] == 2 and out["method"] == "automatic_score"


def write(spark, text, label="t"):
    path = fresh_path(spark, label)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def test_strict_reader(spark):
    _pockets, errors = structures.read_pocket_info(spark, write(spark, "Pocket 1 :\n\tScore : 1.0\nnonsense here"))
    with pytest.raises(ValueError, match="line"):
        structures.raise_on_errors(errors)


def test_mixed_formats(spark):
    root = fresh_path(spark, "mix")
    for name, text in (("k=a", "ACGU\n# no\nGGCC"), ("k=b", ">s1 first\nACG\nUUU"), ("k=c", "id,sequence\nx,ACGU")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/{name}")
    out = {(r["sequence"], r["supplied_id"], r["row"]) for r in sequences.read_sequences(spark, root + "/k=*/").collect()}
    assert out == {("ACGU", None, 1), ("GGCC", None, 3), ("ACGUUU", "s1", 1), ("ACGU", "x", 2)}


LOG = [
    '{"job_id": "j", "seq": 1, "created_utc": "2024-01-01T00:00:00Z", "event": "run_started"}',
    '{"job_id": "j", "seq": 2, "created_utc": "2024-01-01T00:00:01Z", "event": "stage_started", "stage": "fold", "total": 10}',
    '{"job_id": "j", "seq": 3, "created_utc": "2024-01-01T00:00:02Z", "event": "advance", "stage": "fold", "completed": 4, "total": 10, "unit": "rows"}',
    '', '{"job_id": "j", "seq": 4, "crea',
]


def test_torn_line(spark):
    status = progress.run_status(events.read_progress_events(spark, write(spark, "\n".join(LOG)))).first()
    assert (status["status"], status["stage"], status["completed"], status["total"], status["unit"]) == ("running", "fold", 4, 10, "rows")


def test_stream_ignores_late_and_repeated_lines(spark):
    path, out = write(spark, "\n".join(LOG)), fresh_path(spark, "out")
    done = '{"job_id": "j", "seq": 9, "created_utc": "2024-01-01T00:00:09Z", "event": "run_completed", "artifact_path": "a.json"}'
    check = fresh_path(spark, "check")

    def run():
        s = progress.run_status_stream(events.stream_progress_events(spark, path))
        s.writeStream.outputMode("update").foreachBatch(
            lambda b, n: b.withColumn("n", F.lit(n)).write.mode("append").parquet(out)).option(
            "checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out).orderBy(F.desc("n")).first()

    assert run()["status"] == "running"
    for text in (done, "\n".join([LOG[2], LOG[0]])):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(path)
        last = run()
        assert last["status"] == "completed" and last["artifact_path"] == "a.json" and last["stage"] is None


def test_repeats_are_dropped_on_a_stream(spark):
    path, out, check = write(spark, "\n".join(LOG)), fresh_path(spark, "out"), fresh_path(spark, "check")
    for _ in range(2):
        s = progress.drop_repeats(events.stream_progress_events(spark, path))
        s.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
        spark.createDataFrame([(LOG[1],)], "value string").coalesce(1).write.mode("append").text(path)
    assert spark.read.parquet(out).count() == 3
