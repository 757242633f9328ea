"""The source and the sink of text files: filters, empty files, numbering over files, a stream that stops and goes on."""

import pytest
from pyspark.sql import functions as F

from lectern.sources import page_files


@pytest.fixture
def folder(spark, tmp_path):
    path = f"file://{tmp_path}/pages"
    rows = spark.createDataFrame([(f"part{i % 3}/doc.v1_{i:03d}.md", "" if i % 7 == 0 else f"# {i}\né\n" * (i % 4)) for i in range(60)] + [("part0/other.txt", "no"), ("part1/.hidden.md", "no")], "path string, content string")
    assert page_files.write_files(rows.repartition(5), path) == 62
    return path


def test_round_trip(spark, folder):
    got = {r.stem: r for r in page_files.read_files(spark, folder, ".md", per_task=7).collect()}
    assert len(got) == 60 and got["doc.v1_007"].text == "" and got["doc.v1_007"].size == 0
    assert got["doc.v1_006"].text == "# 6\né\n" * 2 and got["doc.v1_006"].part == "part0" and got["doc.v1_006"].size == 2 * 7
    df = page_files.read_files(spark, folder, ".md", per_task=7)
    assert df.rdd.getNumPartitions() == 9
    assert page_files.read_files(spark, f"{folder}/none", ".md").count() == 0


def test_filters_choose_files(spark, folder):
    """Files that filters leave out are not opened: with a broken one among them the read still works."""
    df = page_files.read_files(spark, folder, ".md").where((F.col("part") == "part1") & F.col("stem").isin("doc.v1_001", "doc.v1_004", "doc.v1_003"))
    assert sorted(r.stem for r in df.collect()) == ["doc.v1_001", "doc.v1_004"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan and "BatchScan" in plan  # the source has taken all of them
    reader = page_files.PageReader({"path": folder, "suffix": ".md"})
    left = list(reader.pushFilters([page_files.EqualTo(("part",), "part1"), page_files.In(("stem",), ["doc.v1_001"]), page_files.EqualTo(("size",), 3)]))
    assert [f.attribute for f in left] == [("size",)] and [p for x in reader.partitions() for p in x.paths][0].endswith("part1/doc.v1_001.md")
    assert sum(len(p.paths) for p in reader.partitions()) == 1


def test_lines_are_numbered_over_files(spark, tmp_path):
    path = f"file://{tmp_path}/lines"
    files = ["a\n\nb\n", "", "c\n  \n\nd", "e\n"]
    page_files.write_files(spark.createDataFrame([(f"{i}.jsonl", t) for i, t in enumerate(files)], "path string, content string"), path)
    assert sorted(tuple(r) for r in page_files.numbered(spark, path, ".jsonl").collect()) == [(0, "a"), (2, "b"), (3, "c"), (6, "d"), (7, "e")]


def test_paths_stay_inside(spark, tmp_path):
    for bad in ("../x.md", "/x.md", "a/../../x.md"):
        with pytest.raises(Exception, match="outside"):
            page_files.write_files(spark.createDataFrame([(bad, "x")], "path string, content string"), f"file://{tmp_path}/w")
    assert page_files.write_files(spark.createDataFrame([("b.bin", bytearray(b"\xff\x00")), ("n", None)], "path string, content binary"), f"file://{tmp_path}/w") == 2
    assert (tmp_path / "w" / "b.bin").read_bytes() == b"\xff\x00" and (tmp_path / "w" / "n").read_bytes() == b""


def test_stream_goes_on(spark, folder, tmp_path):
    """Each file once, over batches, a stop, and files that come later."""
    page_files.register(spark)

    def drain():
        stream = spark.readStream.format(page_files.FORMAT).options(path=folder, suffix=".md", per_batch="25").load()
        query = stream.select("stem").writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/check").option("path", f"file://{tmp_path}/out").start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.stem for r in spark.read.parquet(f"file://{tmp_path}/out").collect())

    first = drain()
    assert first == sorted(f"doc.v1_{i:03d}" for i in range(60))
    page_files.write_files(spark.createDataFrame([("part9/late.md", "x")], "path string, content string"), folder)
    assert drain() == sorted([*first, "late"])
