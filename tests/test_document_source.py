"""The folder as a data source: what it lists, how it deals files into tasks, and the pages that come of it."""

import pytest

from evidentia.sources import documents, files


def pages_of(content):
    """A stand-in for a PDF extractor."""
    return [(i + 1, t) for i, t in enumerate(content.decode().split("|"))]


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "docs"
    (at / "deep").mkdir(parents=True)
    (at / "a b+c%20\u00e9.md").write_text("the first page of this file, long enough\n<!-- page -->\nshort\n <!--PAGE--> \nthe third page of this file, long enough")
    (at / "x.TXT").write_bytes(b"a text with a byte that is no UTF-8: \xff, kept as it can be")
    (at / "y.pdf").write_text("one page of a file that stands for a PDF|tiny|another page of that same file")
    (at / "z.docx").write_text("no supported suffix, so this isn't read at all")
    (at / "deep" / "w.md").write_text("a file in a folder below, read if one asks for it")
    (at / "empty.md").write_text("")
    return at


def test_pages_are_those_of_the_other_reader(spark, folder):
    by_source = sorted(map(tuple, documents.load_pages(spark, str(folder), pdf="tests.test_document_source:pages_of").collect()))
    assert by_source == sorted(map(tuple, files.load_pages(spark, str(folder), pdf=pages_of).collect()))
    assert [(r[0], r[1]) for r in by_source] == [("a b+c%20\u00e9.md", 1), ("a b+c%20\u00e9.md", 3), ("x.TXT", 1), ("y.pdf", 1), ("y.pdf", 3)]
    assert sorted(map(tuple, documents.load_pages(spark, f"file://{folder}", glob="a*").collect())) == by_source[:2] if "%" not in str(folder) else True


def test_names_and_suffixes_prune(spark, folder):
    names = lambda **o: sorted(r["source_file"] for r in documents.read_documents(spark, str(folder), **o).select("source_file").collect())
    assert names(suffixes=".md,.txt") == ["a b+c%20\u00e9.md", "empty.md", "x.TXT"]
    assert names(glob="x*") == ["x.TXT"] and "w.md" in names(recursive="true", suffixes=".md")
    with pytest.raises(Exception, match="no supported file"):
        names(glob="nothing*")
    with pytest.raises(Exception, match="no PDF extractor"):
        names(glob="y*")


def test_many_files_take_all_cores_and_no_more_tasks(spark, tmp_path):
    for i in range(1000):
        (tmp_path / f"f{i}.txt").write_text("x" * (100_000 if i < 4 else 100))
    read = documents.read_documents(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and read.count() == 1000
    sizes = [sum(100_000 if int(n[1:-4]) < 4 else 100 for _, n in p.files) for p in documents.DocumentReader({"path": str(tmp_path), "tasks": "4"}).partitions()]
    assert max(sizes) < 1.1 * min(sizes)
