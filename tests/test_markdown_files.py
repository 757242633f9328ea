"""Folders of Markdown files: names are listed in tasks, and only files that are asked for are opened."""

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from lectern.sources import corpus


@pytest.fixture
def folder(tmp_path):
    files = {"a/p1.md": b"one", "a/p.2.md": b"", "a/note.txt": b"x", "a/.p3.md": b"x", "a/_p4.md": b"x", "b/p5.md": "﻿ü\r\n".encode(), "b/p6.md": b"\xff", "b/deep/p7.md": b"x", "_c/p8.md": b"x", "p9 +%20.md": b"top"}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    return str(tmp_path)


def test_listed_in_tasks(spark, folder, monkeypatch):
    def whole(self):
        raise AssertionError("the driver lists every file")

    monkeypatch.setattr(DataFrame, "inputFiles", whole)
    allowed = spark.createDataFrame([(p,) for p in ("p1", "p.2", "p5", "p7", "p8", "gone")], "page_id string")
    got = {r.page_id: r.markdown for r in corpus.parsed_pages(spark, folder, allowed).collect()}
    assert got == {"p1": "one", "p.2": "", "p5": "﻿ü\r\n"}  # p6 is no text, and is not opened
    index = spark.createDataFrame([("k1", "p1"), ("k2", "p.2"), ("k3", "gone")], "page_id string, stem string")
    assert sorted(map(tuple, corpus.parser_output(spark, f"{folder}/a", index, "p").collect())) == [("p", "k1", "one"), ("p", "k2", "")]
    assert {(r.stem, r.markdown) for r in corpus.read_markdown(spark, f"{folder}/a").collect()} == {("p1", "one"), ("p.2", "")}
    assert {r.stem for r in corpus.read_markdown(spark, folder).collect()} == {"p9 +%20"}


def test_other_patterns_by_spark(spark, folder):
    """A pattern that the listing does not know goes by Spark's source, with the same rows."""
    got = {(r.stem, r.path, r.markdown) for r in corpus.read_markdown(spark, f"{folder}/[a]").collect()}
    assert got == {(r.stem, r.path, r.markdown) for r in corpus.read_markdown(spark, f"{folder}/a").collect()}


def test_not_text_raises(spark, folder):
    with pytest.raises(Exception, match="decode"):
        corpus.parsed_pages(spark, folder).collect()
