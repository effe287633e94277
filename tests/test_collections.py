"""Paged collections, CSV records over blocks, archives, the progress log."""

import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import text as X
from corpuslab.sources import collections, files, markup, paged, records, shared
from corpuslab.streaming import progress


def page(folder, cursor, after, items):
    at = folder / f"cursor={cursor}"
    at.mkdir()
    (at / "part-0.json").write_text(json.dumps({"next": after, "items": items}) + "\n")


def test_chains_end_where_a_page_is_lost(spark, tmp_path):
    spark.dataSource.register(paged.PagedSource)
    page(tmp_path, "a0", "a1", [{"i": 1}, {"i": 2}])
    page(tmp_path, "a1", "a2", [])
    page(tmp_path, "b0", None, [{"i": 3}])
    read = spark.read.format("paged").options(path=f"file://{tmp_path}", starts=json.dumps({"a": "a0", "b": "b0"}), tries="2")
    rows = sorted(map(tuple, read.option("failed", "record").load().collect()), key=str)
    assert [(r[0], r[1], r[2]) for r in rows] == [("a", "a0", '{"i": 1}'), ("a", "a0", '{"i": 2}'), ("a", "a2", None), ("b", "b0", '{"i": 3}')]
    assert [r[3] is not None for r in rows] == [False, False, True, False]
    with pytest.raises(Exception, match="a2"):
        read.option("failed", "raise").load().collect()


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    spark.dataSource.register(paged.PagedSource)
    folder = tmp_path / "pages"
    folder.mkdir()
    page(folder, "a0", "a1", [{"i": 0}])

    def run():
        stream = spark.readStream.format("paged").options(path=f"file://{folder}", starts=json.dumps({"a": "a0"}), tries="1").load()
        progress.append(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
        return sorted(json.loads(r["item"])["i"] for r in spark.read.schema(paged.SCHEMA).parquet(str(tmp_path / "out")).collect())

    assert run() == [0] and run() == [0]
    page(folder, "a1", "a2", [{"i": 1}, {"i": 2}])
    page(folder, "a2", None, [{"i": 3}])
    assert run() == [0, 1, 2, 3] and run() == [0, 1, 2, 3]


def test_records_over_many_blocks(spark, tmp_path):
    """A file cut into blocks of 64 bytes, most of which begin inside a quoted field, read by more than one task."""
    texts = [f"line {i}\nwith \"\"quotes\"\", commas\r\n\nand more {'x' * (i % 50)}" if i % 3 else f"plain {i}" for i in range(200)]
    body = "\ufeffText,AI percent\r\n" + "".join(f'"{t}",{i % 130}%\r\n' + ("\r\n" if i % 7 == 0 else "") for i, t in enumerate(texts))
    (tmp_path / "n.csv").write_bytes(body.encode())
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(str(tmp_path / "n.csv")).rdd.getNumPartitions() > 10
        rows = {r["_row"]: r for r in files.notes(spark, str(tmp_path / "n.csv")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(rows) == list(range(2, 202))
    for i, t in enumerate(texts):
        assert rows[i + 2]["Text"] == t.replace('""', '"')
        assert rows[i + 2]["problem"] == (None if i % 130 <= 100 else f"row {i + 2}: AI percent is not a percentage of 0 to 100")


def test_records_over_many_batches(spark, tmp_path):
    """Records of more lines than a batch has, blank lines, several files; the quote that one file leaves open takes in the rest of it."""
    body = {f"{k}.csv": "a,b\n" + "".join(f'{i},"' + f"x{k}\n\n" * (i % 9) + '"\r\n' + "\n" * (i % 2) for i in range(40)) for k in range(3)}
    body["1.csv"] += '99,"open\n\nto, the end\n'
    for name, text in body.items():
        (tmp_path / name).write_bytes(text.encode())
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = sorted((r["file"].rsplit("/", 1)[1], r["number"], r["record"]) for r in records.csv_records(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = []
    for name, text in body.items():
        rows = ["a,b"] + [f'{i},"' + f"x{name[0]}\n\n" * (i % 9) + '"' for i in range(40)]
        want += [(name, n, r) for n, r in enumerate(rows + (['99,"open\n\nto, the end'] if name == "1.csv" else []), 1)]
    assert got == sorted(want)


def test_texts_are_staged_once_and_hardly_shuffled(spark, tmp_path, monkeypatch):
    rows = spark.range(2000).select("id", F.concat_ws("\n", *[F.sha2(F.concat(F.col("id"), F.lit(i)), 512) for i in range(8)]).alias("Text"), F.lit("5%").alias("AI percent"))
    rows.repartitionByRange(2, "id").write.options(header=True, quoteAll=True, escape='"').csv(f"file://{tmp_path}/notes")
    sizes, stage = [], shared.stage

    def staged(df, name):
        out = stage(df, name)
        sizes.append(sum(f.stat().st_size for f in map(Path, (x.removeprefix("file://") for x in out.inputFiles()))))
        return out

    monkeypatch.setattr(shared, "stage", staged)
    out = files.notes(spark, f"file://{tmp_path}/notes")
    assert out.count() == 2000 and out.where("problem is not null").count() == 0
    assert sum(sizes) < 1.2 * sum(f.stat().st_size for f in (tmp_path / "notes").glob("*.csv"))
    pieces, _ = records._staged(spark, f"file://{tmp_path}/notes")
    assert pieces.where("part is not null").count() < 50 and pieces.where("record is not null").count() > 1950


def test_headers(spark, tmp_path):
    for name, line in (("a.csv", "x,y"), ("b.csv", "x,z")):
        (tmp_path / name).write_text(line + "\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        records.csv_rows(spark, str(tmp_path))
    assert records.csv_rows(spark, str(tmp_path / "a.csv")).collect()[0].asDict() == {"_row": 2, "x": "1", "y": "2"}
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError, match="missing columns: x"):
        records.csv_rows(spark, str(tmp_path / "e.csv"), required=("x",))


def test_archives_member_by_member(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else f"text {i} é" * i) for i in range(25)], "id long, text string")
    at = collections.write_archives(rows, id_col="id", text_col="text", members=10)
    got = {r["member"]: r["text"] for r in markup.archive_members(files.binary_files(spark, at)).collect()}
    assert got == {f"{i}.tex": "" if i == 3 else f"text {i} é" * i for i in range(25)}
    whole = files.binary_files(spark, at).limit(1).collect()[0]["content"]
    odd = spark.createDataFrame([("cut", bytearray(whole[: len(whole) // 2])), ("pdf", bytearray(b"%PDF-1.4")), ("gz", bytearray(gzip.compress(b"no tar"))), ("none", bytearray())], "path string, content binary")
    ends = {r["path"]: r for r in markup.archive_members(odd).where("member is null").collect()}
    assert set(ends) == {"cut", "pdf", "gz", "none"} and all(r["text"] is None for r in ends.values())


def test_progress_is_folded_once(spark, tmp_path):
    log, out, mark = (str(tmp_path / n) for n in ("log", "out", "mark"))
    schema = "id long, at long, error string, done boolean"
    for batch in ([(1, 1, "e1", False), (2, 1, None, True)], [(1, 2, None, None), (1, 3, "e3", False)], [(1, 4, None, True)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(log)
        for _ in range(2):  # the second run finds nothing new
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(log)
            progress.merge(stream, out, mark, key="id", at="at", error="error", done="done").awaitTermination()
    got = {r["id"]: tuple(r)[1:] for r in progress.progress_table(spark, out, "id").collect()}
    assert got == {1: (4, 2, "e3", True), 2: (1, 0, None, True)}


def test_normalisers(spark):
    cases = {
        "collapse": [("a\u00a0\t b \n\n \n\n c\r\n", "a b\n\nc"), ("\n\n", ""), ("", ""), (" x ", "x"), ("a\n\nb\n \nc", "a\n\nb\n\nc")],
        "unfence": [("```text\nhi\n```", "hi"), ("```\r\na\r\nb```", "a\nb"), ("```Markdown x```", "x"), ("``````", ""), ("`````", "`````"), ("a ```b```", "a ```b```")],
        "normalize_response": [("Answer : yes: no", "yes: no"), ("RESPONSE:x", "x"), ("my answer: x", "my answer: x"), ("no label", "no label")],
        "normalize_edit": [("Edited \t text : a", "a"), ("corrected text:b", "b"), ("edited: c", "edited: c")],
        "normalize_question": [
            (' 1.) "What  is\tit?" ', "What is it?"),
            ('{"question": "- Question : Why?"}', "Why?"),
            ("```text\nPROMPT: Who?\n```", "Who?"),
            ("How: so?", "How: so?"),
            ("```", ""),
            ("{bad", "{bad"),
        ],
    }
    for name, pairs in cases.items():
        rows = spark.createDataFrame(pairs, "a string, b string")
        assert [r[0] for r in rows.select(getattr(X, name)(F.col("a"))).collect()] == [b for _, b in pairs], name
    assert [markup.clean(a) for a, _ in cases["collapse"]] == [b for _, b in cases["collapse"]]


def test_staged_folder(spark):
    rows = shared.stage(spark.range(3), "t")
    assert rows.count() == 3 and rows.dtypes == spark.range(3).dtypes
