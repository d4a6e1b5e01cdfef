"""Headings by an as-of order and clause numbers in two levels, held against a plain pass over each document's lines."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import index, structure


def kind_of(line):
    """The three kinds of heading that these tests write."""
    words = line.split(" ")
    if words[0].replace(".", "").isdigit() and len(words) > 1 and words[1][0].isupper():
        return "numbered", words[0], " ".join(words[1:])
    if words[0].count(".") and words[0].replace(".", "").isdigit() and len(words) == 1:
        return "bare", words[0], ""
    return ("named", "", line[:-1]) if line == "Scope:" else None


def plain(pages):
    """{(source_file, seq): (clause_id, title, parent_title, lines)} by one pass."""
    out, titles, seq = {}, {}, {}
    for source, page, text in sorted(pages):
        out.setdefault((source, 0), ("", "(preamble)", "", [])) if seq.setdefault(source, 0) == 0 else None
        for line in text.split("\n"):
            line = line.strip()
            head = kind_of(line) if line else None
            seen = titles.setdefault(source, {})
            parent = ""
            if head and head[0] == "bare":
                parts = head[1].split(".")
                ancestors = [".".join(parts[:i]) for i in range(len(parts) - 1, 0, -1)]
                parent = next((seen[a] for a in ancestors if a in seen), None)
                head = head if parent is not None else None
            if head:
                seq[source] += 1
                out[source, seq[source]] = (head[1], head[2], parent, [])
                if head[2] and head[1]:
                    seen[head[1]] = head[2]
            else:
                out[source, seq[source]][3].append((page, line))
    return {k: v for k, v in out.items() if "".join(x for _, x in v[3]).strip()}


@pytest.mark.parametrize("pages_a_range", [1, 3, 256])
def test_segments_are_those_of_a_plain_pass(spark, monkeypatch, pages_a_range):
    monkeypatch.setattr(structure, "PAGE_RANGE", pages_a_range)
    rng = random.Random(8)
    make = [lambda: f"{rng.randint(1, 3)}.{rng.randint(1, 2)} Title {rng.randint(1, 99)}", lambda: f"{rng.randint(1, 3)}.{rng.randint(1, 2)}.{rng.randint(1, 2)}", lambda: "Scope:", lambda: "  some words of text, as they come  ", lambda: "", lambda: f"{rng.randint(1, 3)} Main title"]
    pages = [(f"f{s}", p, "\n".join(make[rng.choice([0, 1, 1, 2, 3, 3, 3, 4, 5])]() for _ in range(rng.randint(1, 12)))) for s in range(4) for p in range(1, 12) if (s + p) % 5]
    got = structure.segment(spark.createDataFrame(pages, "source_file string, page int, text string")).collect()
    assert {(r["source_file"], r["seq"]): (r["clause_id"], r["title"], r["parent_title"], [tuple(x) for x in r["lines"]]) for r in got} == plain(pages)


def test_equal_numbers_in_one_document_make_no_pairs(spark):
    """10,000 equal bare numbers behind 10,000 equal titled ones: rows grow with the headings, not with their product."""
    pages = spark.range(100).select(F.lit("a").alias("source_file"), (F.col("id") + 1).cast("int").alias("page"), F.array_join(F.array_repeat(F.concat(F.lit("2.1 Title "), F.col("id").cast("string"), F.lit("\n2.1.3\ntext")), 100), "\n").alias("text"))
    found = structure.accept_headings(structure.detect_headings(pages))
    rows = found.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.when(F.col("kind") == "bare", F.col("parent_title") == F.concat(F.lit("Title "), (F.col("page") - 1).cast("string")))).alias("right")).collect()
    assert {r["kind"]: (r["n"], r["right"]) for r in rows} == {"numbered": (10_000, 0), "bare": (10_000, 10_000)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "seen" not in plan and plan.count("Join") == 1  # the one join brings each heading its parent, by place


def test_pages_without_headings_and_null_texts(spark):
    pages = spark.createDataFrame([("a", 1, None), ("a", 2, ""), ("b", 3, "only text"), ("c", 700, "1.1 Far page\nits text"), ("c", 3, "2.2.2\nbare without ancestor")], "source_file string, page int, text string")
    got = sorted((r["source_file"], r["seq"], r["clause_id"], r["page"], [tuple(x) for x in r["lines"]]) for r in structure.segment(pages).collect())
    assert got == [("b", 0, "", 3, [(3, "only text")]), ("c", 0, "", 3, [(3, "2.2.2"), (3, "bare without ancestor")]), ("c", 1, "1.1", 700, [(700, "its text")])]
    assert structure.segment(pages.where(F.lit(False))).count() == 0


def test_only_changed_files_are_cut(spark, tmp_path):
    """A reader of the old state goes on while the new one is built; unchanged files keep their chunks; the result is that of a whole build."""
    path, words = str(tmp_path / "ix"), "some words that fill a clause, " * 30
    page = lambda f, n, t: (f, n, f"{n}.1 Heading\n{t}\n{words}")
    first = [page("a.md", 1, "one"), page("a.md", 2, "two"), page("b.md", 1, "three"), page("c.md", 1, "four")]
    second = [page("a.md", 1, "one"), page("a.md", 2, "two"), page("b.md", 1, "changed"), page("d.md", 1, "new")]
    frame = lambda rows: spark.createDataFrame(rows, "source_file string, page int, text string")
    assert index.build_changed(frame(first), path, "monday", window=64) == {"made": 3, "kept": 0, "gone": 0}
    reader = index.open_index(spark, path, "monday")
    assert index.build_changed(frame(second), path, "tuesday", last="monday", window=64) == {"made": 2, "kept": 1, "gone": 1}
    rows = lambda df: sorted(map(tuple, df.select("chunk_id", "page_content", "doc_family").collect()))
    index.build_changed(frame(second), path, "whole", window=64)
    assert rows(index.open_index(spark, path, "tuesday")) == rows(index.open_index(spark, path, "whole"))
    assert {r[0][:4] for r in rows(reader)} == {"a.md", "b.md", "c.md"}
    # pages in another order are the same file; a state that isn't there is none
    assert index.build_changed(frame(second[::-1]), path, "again", last="tuesday", window=64) == {"made": 0, "kept": 3, "gone": 0}
    assert index.build_changed(frame(second), path, "fresh", last="nowhere", window=64)["made"] == 3
    assert index.drop_others(spark, path, "tuesday") == 4 and not index.is_valid(spark, path, "monday") and index.is_valid(spark, path, "tuesday")
