"""From page texts to clauses: boilerplate removal, headings, segmentation. Joins and windows keyed by document; no loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .layout import spread

#: Fixed values.
NOISE = r"(?i)^\s*(?:page\s+)?\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?\s*$"
PAGE_MARK = r"(?im)^\s*<!--\s*page\s*-->\s*$"
NUMBERED = r"^(\d+(?:\.\d+){0,5})\s+([A-Z][^.!?]{2,90})$"
BARE = r"^(\d+(?:\.\d+){1,5})$"
DOTTED = r"^(\d+)\.\s+([A-Z][^.!?]{2,90})$"
PART = r"^(Part\s+[A-Z])\s*[-\x{2013}\x{2014}]\s*(.+)$"
NAMED_SECTIONS = [
    "scope", "definitions", "introduction", "foreword", "references",
    "abbreviations", "purpose", "general", "normative references",
    "table of contents", "contents", "revision history", "acknowledgements",
]
SKIP_TITLES = ["table of contents", "contents", "revision history", "acknowledgements"]
MIN_PAGE_CHARS = 20
#: Pages of a document whose headings one task counts, and the type of a page's headings.
PAGE_RANGE = 256
HEADS = "array<struct<line_no:int,clause_id:string,title:string,parent_title:string>>"


def split_pages(files: DataFrame) -> DataFrame:
    """(source_file, text) to (source_file, page, text): cut at page marks, pages from 1; a file without marks is one page."""
    return files.select("source_file", F.posexplode(F.split(X.text(F.col("text")), PAGE_MARK)).alias("pos", "text")).select("source_file", (F.col("pos") + 1).alias("page"), "text")


def drop_short_pages(pages: DataFrame, least: int = MIN_PAGE_CHARS) -> DataFrame:
    """Page numbers keep their gaps."""
    return pages.where(F.length(X.strip(F.col("text"))) >= least)


def lines(pages: DataFrame) -> DataFrame:
    """(source_file, page, line_no, line): every line, empty ones too."""
    return spread(pages.select("source_file", "page", "text")).select("source_file", "page", F.posexplode(F.split(X.text(F.col("text")), "\n")).alias("line_no", "line"))


def repeated_lines(pages: DataFrame, share: float = 0.5, max_len: int = 120) -> DataFrame:
    """(source_file, line, n): stripped lines on at least `share` of a document's pages, and on two; each counts once a page."""
    once = lines(pages).select("source_file", "page", X.strip(F.col("line")).alias("line")).where((F.length("line") > 0) & (F.length("line") <= max_len) & ~F.startswith("line", F.lit("|"))).distinct()
    size = pages.groupBy("source_file").agg(F.count("*").alias("pages"))
    counts = once.groupBy("source_file", "line").agg(F.count("*").alias("n"))
    return counts.join(size, "source_file").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share))).select("source_file", "line", "n")


def strip_running_headers(pages: DataFrame, share: float = 0.5, max_len: int = 120) -> DataFrame:
    """Pages without blank lines, page numbers and repeated lines; kept lines stay raw, an emptied page stays a row."""
    every = lines(pages).withColumn("bare", X.strip(F.col("line")))
    kept = every.where((F.col("bare") != "") & ~F.rlike("line", F.lit(NOISE)))
    gone = repeated_lines(pages, share, max_len).select("source_file", F.col("line").alias("bare"))
    kept = kept.join(gone, ["source_file", "bare"], "left_anti").groupBy("source_file", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return pages.select("source_file", "page").join(kept, ["source_file", "page"], "left").select("source_file", "page", F.coalesce(F.array_join(F.col("ls.line"), "\n"), F.lit("")).alias("text"))


def heading(line: Column) -> Column:
    """struct(kind, clause_id, title), or null; kind bare still needs a seen ancestor (accept_bare)."""
    s = X.strip(line)
    long_number = ~F.contains(F.regexp_extract(s, NUMBERED, 1), F.lit(".")) & (F.length(F.regexp_extract(s, NUMBERED, 1)) > 2)
    make = lambda kind, i, t: F.struct(F.lit(kind).alias("kind"), i.alias("clause_id"), t.alias("title"))
    short = F.forall(F.split(s, r"\."), lambda x: F.length(x) <= 2)
    named = F.regexp_replace(s, ":+$", "")
    return (
        F.when((s == "") | F.startswith(s, F.lit("|")), F.lit(None))
        .when(F.rlike(s, F.lit(NUMBERED)) & ~long_number, make("numbered", F.regexp_extract(s, NUMBERED, 1), F.trim(F.regexp_extract(s, NUMBERED, 2))))
        .when(F.rlike(s, F.lit(BARE)) & short, make("bare", s, F.lit("")))
        .when(F.rlike(s, F.lit(DOTTED)) & (F.length(F.regexp_extract(s, DOTTED, 1)) <= 2), make("dotted", F.regexp_extract(s, DOTTED, 1), F.trim(F.regexp_extract(s, DOTTED, 2))))
        .when(F.rlike(s, F.lit(PART)), make("part", F.regexp_extract(s, PART, 1), F.trim(F.regexp_extract(s, PART, 2))))
        .when(F.lower(named).isin(NAMED_SECTIONS), make("named", F.lit(""), named))
    )


def detect_headings(pages: DataFrame) -> DataFrame:
    """Heading lines: source_file, page, line_no, kind, clause_id, title; bare numbers not checked yet."""
    found = lines(pages).withColumn("h", heading(F.col("line"))).where("h is not null")
    return found.select("source_file", "page", "line_no", "h.kind", "h.clause_id", "h.title")


def _ancestors(rows: DataFrame) -> DataFrame:
    parts = F.split("clause_id", r"\.")
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("depth", "ancestor")
    return rows.where(F.contains("clause_id", F.lit("."))).select("source_file", "page", "line_no", "clause_id", at)


def accept_headings(found: DataFrame) -> DataFrame:
    """Drops bare numbers without an earlier titled ancestor in their document and adds parent_title, of the deepest, latest earlier one.

    A bare number counts if any ancestor came before; an accepted bare ancestor had a titled
    one itself, so titled ones decide.  As-of without pairs: titled headings and one row per ancestor of a bare number stand in
    one order of places, and each of the latter takes the last title before it.
    """
    titled = found.where("title <> '' and clause_id <> '' and kind <> 'part'").select("source_file", F.col("clause_id").alias("ancestor"), "page", "line_no", F.lit(0).alias("depth"), "title")
    asked = _ancestors(found.where("kind = 'bare'")).select("source_file", "ancestor", "page", "line_no", (F.col("depth") + 1).alias("depth"), F.lit(None).cast("string").alias("title"))
    earlier = Window.partitionBy("source_file", "ancestor").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = titled.unionByName(asked).withColumn("last", F.last("title", ignorenulls=True).over(earlier)).where("depth > 0 and last is not null")
    parents = last.groupBy("source_file", "page", "line_no").agg(F.max_by("last", "depth").alias("parent_title"))
    out = found.join(parents, ["source_file", "page", "line_no"], "left").where("kind <> 'bare' or parent_title is not null")
    return out.withColumn("parent_title", F.coalesce("parent_title", F.lit("")))


def clause_numbers(pages: DataFrame, heads: DataFrame) -> DataFrame:
    """(source_file, page, heads, before): a page's accepted headings in order, and how many its document has on earlier pages.

    In two levels: sums of ranges of PAGE_RANGE pages, running sums of these, and running sums inside a range. No task holds
    a document's lines, nor all its pages.
    """
    own = heads.groupBy("source_file", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "clause_id", "title", "parent_title"))).alias("heads"))
    counted = pages.select("source_file", "page").join(own, ["source_file", "page"], "left").withColumns({"n": F.coalesce(F.size("heads"), F.lit(0)), "range": F.floor(F.col("page") / PAGE_RANGE)})
    earlier = lambda *by: Window.partitionBy("source_file", *by)
    sums = counted.groupBy("source_file", "range").agg(F.sum("n").alias("sum"))
    ranges = sums.withColumn("offset", F.coalesce(F.sum("sum").over(earlier().orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum")
    inside = counted.withColumn("inside", F.coalesce(F.sum("n").over(earlier("range").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(ranges, ["source_file", "range"]).select("source_file", "page", "heads", (F.col("offset") + F.col("inside")).alias("before"))


def segment(pages: DataFrame) -> DataFrame:
    """Clauses in order: source_file, seq, doc_family, doc_role, clause_id, section, title, parent_title, page, lines (page, line).

    Lines before a document's first heading are its (preamble).  Clauses without text, contents
    pages and front matter are dropped, though their titles serve descendants.
    """
    marks = clause_numbers(pages, accept_headings(detect_headings(pages)))
    numbered = pages.select("source_file", "page", "text").join(marks, ["source_file", "page"])
    # a page's lines are cut at its headings: a row a piece of a clause, not a row a line
    split = numbered.select("source_file", "page", "before", F.coalesce("heads", F.array().cast(HEADS)).alias("heads"), F.transform(F.split(X.text(F.col("text")), "\n"), X.strip).alias("all"))
    begin = F.concat(F.array(F.lit(0)), F.transform("heads", lambda h: h["line_no"] + 1))
    end = F.concat(F.transform("heads", lambda h: h["line_no"]), F.array(F.size("all")))
    pieces = F.posexplode(F.zip_with(begin, end, lambda a, b: F.slice("all", a + 1, b - a))).alias("k", "texts")
    every = split.select("source_file", "page", "before", "heads", pieces).select("source_file", "page", "k", (F.col("before") + F.col("k")).alias("seq"), F.get("heads", F.col("k") - 1).alias("head"), "texts")
    first = lambda c: F.max(F.col("head")[c]).alias(c)
    runs = F.array_sort(F.collect_list(F.struct("page", "k", "texts")))
    grouped = every.groupBy("source_file", "seq").agg(first("clause_id"), first("title"), first("parent_title"), runs.alias("runs"))
    grouped = grouped.withColumn("ls", F.flatten(F.transform("runs", lambda r: F.transform(r["texts"], lambda x: F.struct(r["page"].alias("page"), x.alias("line"))))))
    whole = F.array_join(F.col("ls.line"), "\n")
    title = F.when(F.col("seq") == 0, "(preamble)").otherwise(F.col("title"))
    family, role = X.describe_document(F.col("source_file"))
    out = grouped.where((X.strip(whole) != "") & ~X.looks_like_toc(whole) & ~F.lower(F.regexp_replace(X.text(title), ":+$", "")).isin(SKIP_TITLES))
    out = out.select("source_file", "seq", family.alias("doc_family"), role.alias("doc_role"), X.text(F.col("clause_id")).alias("clause_id"), title.alias("title"), X.text(F.col("parent_title")).alias("parent_title"), F.get("ls", F.lit(0))["page"].alias("page"), F.col("ls").alias("lines"))
    return out.withColumn("section", X.parent_of(F.col("clause_id")))
