import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from corpuslab.sources import files, markup
from corpuslab.streaming import progress


def test_metadata_and_folders(spark, tmp_path):
    (tmp_path / "meta.json").write_text(json.dumps({"samples": [{"id": 1, "label": "human"}, {"id": 2}]}, indent=1))
    assert sorted(map(tuple, files.metadata_samples(spark, str(tmp_path / "meta.json"), "id: bigint, label: string").collect()), key=str) == [(1, "human"), (2, None)]
    folder = tmp_path / "human"
    folder.mkdir()
    (folder / "1.txt").write_text("one two\nthree")
    (folder / "x.md").write_text("no")
    assert list(map(tuple, files.text_folder(spark, str(folder)).collect())) == [("1.txt", "one two\nthree")]
    assert files.binary_files(spark, str(folder)).count() == 2


def test_safe_paths(spark):
    rows = spark.createDataFrame([("a/b.txt",), ("../x",), ("/etc/x",), ("a/../b",), ("a..b",)], "p string")
    assert [r[0] for r in rows.select(files.safe_path(F.col("p"))).collect()] == [True, False, False, False, True]


def test_jsonl_and_csv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert sorted(r.id for r in files.jsonl(spark, str(tmp_path / "a.jsonl"), "id long").collect()) == [1, 2]
    (tmp_path / "n.csv").write_text('﻿Text,AI percent\n"two\nlines",37%\n" ",5\nok,abc\n', encoding="utf-8")
    rows = files.notes(spark, str(tmp_path / "n.csv")).orderBy("_row").collect()
    assert [r.problem for r in rows] == [None, "row 3: Text cannot be empty", "row 4: AI percent is not a percentage of 0 to 100"]
    with pytest.raises(ValueError, match="missing columns"):
        files.notes(spark, str(tmp_path / "n.csv"), percent_col="x")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "train"), (2, "b", "test")], "id int, text string, split string")
    assert files.save_splits(rows, str(tmp_path / "d")).count() == 0
    with pytest.raises(Exception, match="(?i)already exists"):
        files.save_splits(rows, str(tmp_path / "d"))
    assert files.splits(spark, str(tmp_path / "d"), "test").count() == 1
    assert "| train | 1 | 1 |" in files.card(rows)
    assert files.snapshot(rows, str(tmp_path / "s"), F.col("text")).count() == 2
    files.snapshot(rows, str(tmp_path / "s"), F.col("text"))
    with pytest.raises(ValueError, match="other rows"):
        files.snapshot(rows.where("id = 1"), str(tmp_path / "s"), F.col("text"))


def test_snapshots_tell_multisets_apart(spark, tmp_path):
    of = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    at = str(tmp_path / "m")
    files.snapshot(of(1, 1, 2), at, F.col("id"), key="id")
    assert files.snapshot(of(2, 1, 1), at, F.col("id"), key="id").count() == 3
    with pytest.raises(ValueError, match="other rows: 1, 2, 3$"):
        files.snapshot(of(3, 3, 2, 2), at, F.col("id"), key="id")
    off = files.differences(of(1, 1, 2), of(3, 3, 2), key="id", content=F.col("id"))
    assert sorted(map(tuple, off.collect())) == [(1, 2, 0), (3, 0, 2)]
    assert files.differences(of(), of(), key="id", content=F.col("id")).count() == 0


def test_html_depth_rules():
    page = "<nav><p>skip these five words here</p></nav><p>One <b>two</b> three four&amp;five six<br>seven<script>var p='</p>';</script></p><p>too short</p><p>unclosed one two three four five"
    assert markup.html_text(page, frozenset({"p"})) == "One two three four&five six\nseven"


def test_tex_archives():
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as archive:
        for name, data in (("a.tex", b"appendix"), ("m.tex", b"\\begin{document}main"), ("x.png", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    assert markup.tex_source(buffer.getvalue()) == "\\begin{document}main\n\nappendix"
    assert markup.tex_source(gzip.compress(b"plain tex")) == "plain tex"
    assert markup.tex_source(b"%PDF-1.4") is None


def test_progress_log_is_appended_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    line = {"created_at_utc": "2024-01-01T00:10:00Z", "provider": "p", "model": "m", "mode": "fresh", "sample_id": 1, "error": "e"}
    (log / "1.json").write_text(json.dumps(line) + "\n" + json.dumps(line) + "\n")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):
        progress.append(progress.once_each(progress.read_log(spark, str(log)), ["sample_id"]), out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == 1
    (log / "2.json").write_text(json.dumps(line | {"sample_id": 2}) + "\n")
    progress.append(progress.once_each(progress.read_log(spark, str(log)), ["sample_id"]), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_broken_pages_and_archives():
    assert markup.harvest("<OAI><record>") is None
    assert markup.tex_source(gzip.compress(b"plain tex " * 50)[:-12]) is None
    assert markup.tex_source(gzip.compress(b"%PDF-1.4")) is None
    assert markup.tex_source(b"") == ""


def test_harvest_records():
    page = "<r xmlns='urn:x'><record><metadata><m><id> 7 </id><title/><authors><author><keyname>Roe</keyname></author><author/></authors></m></metadata></record><record/><resumptionToken/></r>"
    got = markup.harvest(page)
    assert got["token"] is None and len(got["records"]) == 1
    assert got["records"][0]["id"] == "7" and got["records"][0]["title"] is None and got["records"][0]["authors"] == ["Roe"]


def test_nested_and_stray_tags():
    five = "one two three four five"
    page = f"</p></nav><div>{five}<div> six</div> seven<style>x</div></style></div><pre><div>{five}</div></pre><div>few</div>"
    assert markup.html_text(page, frozenset({"div"})) == f"{five} six seven"
