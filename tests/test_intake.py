"""Mails, files, streams, training."""

import json
from datetime import datetime
from email.message import EmailMessage

import numpy as np
import pytest
from pyspark.sql import functions as F

from formflow.operators import emails as E
from formflow.operators import quality, training
from formflow.sources import files
from formflow.streaming import pipeline


def mail(subject="Grüße", parts=()):
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = subject, "a@x.example", "b@x.example"
    m.set_content("text")
    for data, kind, name in parts:
        main, sub = kind.split("/")
        m.add_attachment(data, maintype=main, subtype=sub, **({"filename": name} if name else {}))
    return m.as_bytes()


@pytest.fixture
def box(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.eml").write_bytes(mail(parts=[(b"x" * 2048, "application/pdf", None), (b"", "application/pdf", "leer.pdf"), (b"img", "image/png", "a.png"), (b"y" * 10, "application/octet-stream", "B.PDF")]))
    (folder / "two.EML").write_bytes(mail("leer"))
    (folder / "notes.txt").write_bytes(b"no mail")
    return folder


def test_mails(spark, box):
    raw = files.emails(spark, str(box))
    messages = E.parse_messages(raw).cache()
    assert {r.email_id: r.metadata["subject"] for r in messages.collect()} == {"one": "Grüße", "two": "leer"}
    assert messages.filter("email_id = 'two'").collect()[0].metadata["message_id"] == ""
    parts = E.attachment_rows(messages)
    listed = E.list_attachments(parts, ["email_id"], ["part_idx"], F.col("stem")).orderBy("index")
    assert [(r["index"], r.filename, r.size_bytes, r.size_readable) for r in listed.collect()] == [
        (0, "one_attachment_1.pdf", 2048, "2.0 KB"), (1, "leer.pdf", 0, "0.0 KB"), (2, "B.PDF", 10, "0.0 KB"),
    ]
    chosen = spark.createDataFrame([("one", 1), ("one", 2), ("one", 2), ("two", 0)], "email_id string, index int")
    assert [r.filename for r in E.select_attachments(listed, chosen, ["email_id"]).collect()] == ["B.PDF"]
    assert E.select_attachments(listed, None, ["email_id"]).count() == 2
    seen = {r.filename: (r.is_pdf, r.data) for r in E.interactive_attachments(parts).collect()}
    assert seen["a.png"] == (False, "data:image/png;base64,aW1n") and seen["B.PDF"] == (True, None) and len(seen) == 2
    assert {r.email_id: len(r.attachments) for r in E.preview(messages).collect()} == {"one": 3, "two": 0}
    pages = E.normalize_pages(listed, lambda b: [b[:1]] * 2 if len(b) > 100 else 1 / 0, ["email_id", "index"])
    assert [(r["index"], r.page_idx) for r in pages.orderBy("page_idx").collect()] == [(0, 0), (0, 1)]


def test_odd_mails(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"\xff\xfe\x00")), (4, bytearray(b"Subject: =?x?b?!!\n\n"))], "i int, content binary")
    rows = {r.i: r for r in E.parse_messages(df).collect()}
    assert rows[1].metadata is None and rows[2].metadata["subject"] == "" and rows[4].metadata["subject"].startswith("=?x")


def test_stream_sees_each_mail_once(spark, box, tmp_path):
    out, tasks, mark = (str(tmp_path / n) for n in ("out", "tasks", "mark"))
    stream = lambda: files.email_stream(spark, str(box))
    for _ in range(2):
        pipeline.intake(stream(), out, mark + "1").awaitTermination()
        pipeline.task_log(stream(), tasks, mark + "2").awaitTermination()
    assert spark.read.parquet(out).count() == 3
    assert sorted(r.current_stage for r in spark.read.parquet(tasks).collect()) == ["opencv", "opencv"]
    (box / "three.eml").write_bytes(mail(parts=[(b"z", "application/pdf", "z.pdf")]))
    pipeline.intake(stream(), out, mark + "1").awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_progress(spark):
    at = datetime(2024, 1, 1)
    tasks = spark.createDataFrame([(t, "", at) for t in "abcd"], "task_id string, eml_file string, created_at timestamp")
    results = [("b", "opencv"), ("b", "opencv"), ("c", "opencv"), ("c", "layout"), ("c", "ml"), ("d", "ml"), ("x", "ml"), ("a", "other")]
    df = spark.createDataFrame([(*r, at) for r in results], "task_id string, stage string, finished_at timestamp")
    got = {r.task_id: (r.status, r.current_stage, r.completed_at) for r in pipeline.progress(tasks, df).collect()}
    assert got == {"a": ("pending", "opencv", None), "b": ("processing", "layout", None), "c": ("completed", "ml", at), "d": ("processing", "opencv", None)}
    assert pipeline.stage_times(df.filter("task_id = 'c'")).count() == 3


def test_definitions(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"form_type": "X", "version": "1", "products": []}))
    (tmp_path / "b.json").write_text(json.dumps({"form_type": "X", "version": "2"}))
    (tmp_path / "c.json").write_text(json.dumps({"version": "3"}))
    (tmp_path / "d.json").write_text("{broken")
    assert [(r.form_type, r.version) for r in files.definitions(spark, str(tmp_path)).collect()] == [("X", "2")]


def test_zone_files_and_registry(spark, tmp_path):
    box = {"x": 1, "y": 2, "width": 3, "height": 4}
    (tmp_path / "z.json").write_text(json.dumps({"orders": [box, box], "names": box}))
    got = sorted((r.kind, r.zone_idx, r.rect.height) for r in files.zone_sets(spark, str(tmp_path / "z.json")).collect())
    assert got == [("names", 0, 4), ("orders", 0, 4), ("orders", 1, 4)]
    files.save_zone_set(spark, str(tmp_path / "saved"), json.dumps({"orders": box}))
    assert files.zone_sets(spark, str(tmp_path / "saved")).count() == 1
    registry = files.FormRegistry(spark, str(tmp_path / "registry"))
    assert registry.get("X") is None
    registry.register("X", "{}")
    registry.register("Y", "[]")
    registry.register("X", "{1}")
    assert registry.get("X") == "{1}" and registry.load().count() == 2


def test_product_list(spark, tmp_path):
    (tmp_path / "p.txt").write_text("Kopf\n------ Frisch ------\n1 | 1-12 | Suppe\n2 | | Brot\n------ Ofen ------\n3|30|Kuchen\nx | 1 | y\n")
    got = [tuple(r) for r in files.product_list(spark, str(tmp_path / "p.txt")).orderBy("row").collect()]
    assert got == [(1, "1-12", 1, 12, "Suppe", "Frisch"), (2, None, None, None, "Brot", "Frisch"), (3, "30", 30, 30, "Kuchen", "Ofen")]


def test_latest_and_results(spark, tmp_path):
    t = lambda d: datetime(2024, 1, d)
    df = spark.createDataFrame([("page_9.png", t(9)), ("page_000_normalized.png", t(1)), ("b/page_000_normalized.png", t(1))], "path string, modification_time timestamp")
    assert files.latest(df, F.col("path").endswith("page_000_normalized.png")).collect()[0].path == "page_000_normalized.png"
    assert files.latest(df.limit(0), F.lit(True)).count() == 0
    out = str(tmp_path / "results")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "task_id string, v int")
    files.write_results(rows, out, ["task_id"])
    files.write_results(rows.filter("task_id = 'a'").withColumn("v", F.lit(7)), out, ["task_id"])
    assert {r.task_id: r.v for r in spark.read.parquet(out).collect()} == {"a": 7, "b": 2}
    listed = spark.createDataFrame([("a", "x/1.json"), ("a", "x/summary.json"), ("a", "x/1.json")], "task_id string, path string")
    assert [tuple(r) for r in files.task_summary(listed).collect()] == [("a", ["x/1.json"], 1)]


def test_samples_and_training(spark):
    posts = spark.createDataFrame([("3", "1", "Mo", "data:image/png;base64,YWJj"), ("x", "1", "Mo", "data:image/png;base64,YWJj"), ("4", "1", "Mo", "nope")], "digit string, row string, column string, image_data string")
    assert [r.digit for r in files.sample_rows(posts).collect()] == ["3"]
    rng = np.random.default_rng(0)
    glyphs = rng.random((10, 784)) > 0.5
    rows = [(d, (glyphs[d] * rng.uniform(0.8, 1, 784)).astype(float).tolist()) for d in range(10) for _ in range(12)]
    data = spark.createDataFrame(rows, "label int, pixels array<float>")
    mixed = training.mixed(data, data.limit(5), per_class=8, factor=3)
    assert mixed.count() == 80 + 15
    model = training.train(data, hidden=(16,))
    acc = quality.accuracy(training.predict(model, data), "label", "predicted").collect()[0]
    assert acc.accuracy > 0.9
    with pytest.raises(ValueError, match="abort_missing"):
        training.train(data.filter("label > 0"))
    assert training.epochs_for(99) == (20, 32) and training.epochs_for(100) == (10, 32)
