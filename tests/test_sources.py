"""File formats, caches and sinks, on files written by the tests."""

from __future__ import annotations

import os

import numpy as np
import pytest
from fixtures import write_edf, write_mat
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracemill.functions import naming
from tracemill.plans import params
from tracemill.plans.recordings import load_collection, load_second_site
from tracemill.sources import cache, edf, files, mat

RATE = 16


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(0)
    (tmp_path / "edf").mkdir()
    names = ["EEG C3-Ref", "EEG C4-REF", "EEG Fz-Ref", "ECG"]
    data = {}
    for n in (1, 2):
        data[n] = {name: rng.integers(-1000, 1000, RATE * 30) for name in names}
        write_edf(str(tmp_path / "edf" / f"eeg{n}.edf"), data[n], RATE, start="10.00.00")
    return tmp_path, data


def test_edf_samples_in_ranges(spark, folder):
    path, data = folder
    headers = edf.headers(spark, str(path / "edf"))
    outlines = {r.patient_num: r for r in edf.recordings(headers).collect()}
    assert outlines[1].sample_rate == RATE and outlines[2].duration_s == 30.0
    assert outlines[1].start_clock == "10:00:00"
    # a range of two records, so each file is decoded in fifteen pieces
    found = edf.samples(headers, range_bytes=2 * 2 * RATE * 4).collect()
    assert len(found) == 2 * 4 * RATE * 30
    for r in found:
        assert r.value == data[r.patient_num][r.channel][r.idx]


def test_edf_checks(spark, tmp_path):
    path = str(tmp_path / "eeg7.edf")
    write_edf(path, {"a": np.zeros(8)}, 4)
    raw = open(path, "rb").read()
    open(path, "wb").write(raw[:192] + b"EDF+D" + raw[197:])
    with pytest.raises(PySparkException):
        edf.recordings(edf.headers(spark, path)).collect()


def test_embedded_annotations(spark, tmp_path):
    notes = [(2, 3, ["Seizure start"]), (9, None, ["eye", "EPI?"]), (12, None, ["nothing"])]
    names = {"Fz": np.arange(20 * 8), "C3": np.arange(20 * 8), "EOG": np.arange(20 * 8)}
    write_edf(str(tmp_path / "EEG001.edf"), names, 8, notes)
    found = load_second_site(spark, str(tmp_path / "EEG001.edf"), clean=False)
    events = [(r.onset_s, r.duration_s, r.annotations) for r in found["events"].orderBy("onset_s").collect()]
    assert events == [(2, 3, ["Seizure start"]), (9, None, ["eye", "EPI?"]), (12, None, ["nothing"])]
    assert sorted((r.on_s, r.off_s, r.kind) for r in found["intervals"].collect()) == [(2, 5, "seizure"), (8, 10, "seizure")]
    assert [r.channel for r in found["samples"].select("channel").distinct().collect()] == ["C3"]


@pytest.mark.parametrize("compress", [False, True])
def test_mat(spark, tmp_path, compress):
    matrix = np.arange(6.0).reshape(2, 3)
    path = str(tmp_path / "x.mat")
    write_mat(path, "Yff", matrix, compress)
    rows = mat.matrices(spark, path, "Yff", only=True)
    cells = mat.snippet_cells(rows).collect()
    assert {(r.channel, r.idx): r.value for r in cells} == {(i, j): matrix[i, j] for i in range(2) for j in range(3)}
    with pytest.raises(PySparkException):
        mat.matrices(spark, path, "other").collect()


def test_collection(spark, folder):
    path, _ = folder
    reviewers = []
    for shift in (0, 3):
        flags = np.zeros((3, 30))
        flags[:, 5 + shift : 12 + shift] = 1
        flags[0, 20] = 1
        reviewers.append(flags)
    write_mat(str(path / "flags.mat"), "annotat_new", reviewers)
    (path / "notes.csv").write_text(
        "Patient #,Text,Time,Duration,Extra\n1,Grade 1 artifact,d1 10:00:15,3 sec,x\n1,grade 2,d1 10:00:20,3 sec,x\n"
    )
    found = load_collection(
        spark, str(path / "edf"), str(path / "flags.mat"), str(path / "notes.csv"), discretization_s=5, clean=False
    )
    assert sorted(r.channel for r in found["samples"].select("channel").distinct().collect()) == ["C3", "C4"]
    counts = {(r.patient_num, r.sec): r.n for r in found["reviewer_counts"].collect()}
    assert counts[1, 5] == 3 and counts[1, 20] == 1 and counts[2, 5] == 0
    got = sorted((r.patient_num, r.kind, r.on_s, r.off_s) for r in found["intervals"].collect())
    assert got == [(1, "artifact", 10, 20), (1, "seizure", 5, 15), (2, "seizure", 5, 20)]


def test_cache_newest_wins(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert cache.load_latest(spark, path, "a") is None
    frame = lambda v: spark.createDataFrame([(0, "c", 0, v)], "patient_num int, channel string, idx bigint, value double")
    cache.save(frame(1.0), path, "aEEG_x_", "2024-01-01T00")
    cache.save(frame(2.0), path, "aEEG_x_", "2024-01-02T00")
    cache.save(frame(3.0), path, "tricorr_", "2024-01-03T00")
    assert cache.load_latest(spark, path, "aEEG_").first().value == 2.0
    assert cache.load_latest(spark, path, "none") is None
    assert cache.load_signal(spark, path, "tricorr_", "tricorr", 15, 1).first().value == 3.0
    with pytest.raises(ValueError):
        cache.load_signal(spark, path, "x", "ecg", 15, 1)
    with pytest.raises(FileNotFoundError):
        cache.load_signal(spark, path, "none", "tricorr", 15, 1)
    calls = []

    def compute():
        calls.append(1)
        return frame(9.0)

    for _ in range(2):
        got = cache.load_or_compute_curve(spark, path, "roc_", [2, 1], "2024-01-04T00", compute)
        assert got.first().value == 9.0
    assert len(calls) == 1
    cache.save_curve(frame(10.0), path, "roc_", [1, 2], "2024-01-05T00")
    assert cache.load_or_compute_curve(spark, path, "roc_", [1, 2], "2024-01-06T00", compute).first().value == 10.0


def test_result_keys():
    given = dict(params.COMMON) | params.BY_SIGNAL["tricorr"]
    key = naming.result_key("tricorr", given)
    assert key.startswith("tricorr-") and key == naming.result_key("tricorr", dict(reversed(given.items())))
    assert key != naming.result_key("tricorr", given | {"rolling_window_s": 61})
    assert key != naming.result_key("aEEG", given)
    assert len(params.PATIENTS) == 79 and len(params.PATIENTS_WITH_NOTES) == 22
    assert params.SECOND_SITE_CHANNELS["EEG001"] == ("Fz",) and params.SECOND_SITE_CHANNELS["EEG015"] == ()


def test_tex_and_csv(spark, tmp_path):
    rows = [("seizure", "within", "tricorr", 0.8765, 0.5, 12.34), ("patient", "across", "aEEG", 0.9, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "target string, standardization string, signal string, auc double, tpr57 double, fphr80 double")
    text = files.sensitivity_tex(df)
    assert text.startswith(files.SENSITIVITY_HEADING)
    assert text.endswith("patient&across&aEEG&0.9&1.0&0.0\\\\\nseizure&within&tricorr&0.88&0.5&12.0")
    files.write_csv(df.withColumn("grades", F.array(F.lit(1), F.lit(2))), str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.count() == 2 and back.first().grades == "[1, 2]"


def test_fetch_missing(spark, tmp_path):
    (tmp_path / "remote").mkdir()
    for n in (1, 2):
        (tmp_path / "remote" / f"eeg{n}.edf").write_text(f"file {n}")
    target = tmp_path / "local"
    url = f"file://{tmp_path}/remote/eeg{{n}}.edf"
    first = {r.n: r.status for r in files.fetch_missing(spark, [1], url, str(target)).collect()}
    second = {r.n: r.status for r in files.fetch_missing(spark, [1, 2], url, str(target)).collect()}
    assert first == {1: "fetched"} and second == {1: "present", 2: "fetched"}
    assert sorted(os.listdir(target)) == ["eeg1.edf", "eeg2.edf"]


def test_export(spark, folder):
    path, _ = folder
    headers = edf.headers(spark, str(path / "edf"))
    outlines, samples = edf.recordings(headers), edf.samples(headers)
    none = spark.createDataFrame([], "patient_num int, on_s double, off_s double")
    files.export_recording(samples, outlines, outlines.select("patient_num"), none, str(path / "out"))
    back = spark.read.parquet(str(path / "out" / "samples"))
    assert back.count() == samples.count()


def test_broken_note_lines_are_told(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text(
        "Text,Patient #,Time,Duration,Extra\nGrade 1,1,d1 10:00:15,3 sec,x\nGrade 1,2\nGrade 1,x,d1 10:00:15,3 sec,\n"
        '"Grade, 2",3,d1 10:00:20,3 sec,x\nGrade 1,4,d1 10:00:20,3 sec,x,one,more\n'
    )
    rows = files.checked_notes(spark, str(path)).collect()
    assert [(r.patient_num, r.text, r.time) for r in rows if r.broken is None] == [
        (1, "Grade 1", "d1 10:00:15"), (3, "Grade, 2", "d1 10:00:20"),
    ]
    broken = [r for r in rows if r.broken is not None]
    assert len(rows) == 5 and len(broken) == 3
    assert all(r.patient_num is None and r.text is None for r in broken)
    assert {"Grade 1,2", "Grade 1,4,d1 10:00:20,3 sec,x,one,more"} < {r.broken for r in broken}


def test_only_an_absent_cache_is_empty(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("not parquet")
    assert cache.load_latest(spark, str(tmp_path / "none"), "a") is None
    (tmp_path / "empty").mkdir()
    assert cache.load_latest(spark, str(tmp_path / "empty"), "a") is None
    with pytest.raises((PySparkException, Py4JJavaError)):
        cache.load_latest(spark, str(tmp_path / "bad"), "a")
