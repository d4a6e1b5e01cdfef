"""Files to pages: text and markdown natively, PDF through an extractor that the caller brings."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import structure

#: Fixed values.
SUFFIXES = (".pdf", ".md", ".txt")
PAGES = "source_file string, page int, text string"


def select_folder(override: str | None, real: str, sample: str) -> tuple[str, str]:
    """(folder, label): the override, which must exist; else the real folder if it holds a supported file; else the sample."""
    if override:
        if not os.path.isdir(override):
            raise FileNotFoundError(override)
        return override, "override"
    if os.path.isdir(real) and any(p.suffix.lower() in SUFFIXES for p in Path(real).iterdir()):
        return real, "documents"
    return sample, "sample"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, content) of the supported files directly in a folder; suffixes in either case. Raises if there is none."""
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in suffix[1:]) for suffix in SUFFIXES) + "}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    if found.isEmpty():
        raise FileNotFoundError(f"no supported file in {folder}")
    return found.select(F.try_url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("source_file"), "content")


def load_pages(spark: SparkSession, folder: str, pdf: Callable[[bytes], list[tuple[int, str]]] | None = None, least: int = structure.MIN_PAGE_CHARS) -> DataFrame:
    """Pages (source_file, page, text) of a folder, short ones left out, numbers kept.

    `pdf` gives (page number, text) of a PDF's bytes; without it PDF files raise when they are read.
    """
    files = scan(spark, folder)
    is_pdf = F.endswith(F.lower("source_file"), F.lit(".pdf"))
    plain = structure.split_pages(files.where(~is_pdf).select("source_file", F.make_valid_utf8(F.col("content").cast("string")).alias("text")))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_rows in batches:
            out = []
            for name, content in zip(pdf_rows["source_file"], pdf_rows["content"], strict=True):
                if pdf is None:
                    raise RuntimeError(f"{name}: no PDF extractor was given")
                out += [(name, n, text) for n, text in pdf(content)]
            yield pd.DataFrame(out, columns=["source_file", "page", "text"])

    scanned = files.where(is_pdf).mapInPandas(extract, PAGES)
    return structure.drop_short_pages(plain.unionByName(scanned), least)


def table_to_markdown(table: Column) -> Column:
    """An array of rows of cells as markdown: null cells empty, line ends in cells as spaces, a separator under the first row."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.element_at(table, 1), lambda c: F.lit("---")), " | "), F.lit(" |"))
    lines = F.transform(table, row)
    return F.when(F.size(table) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")).otherwise("")


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions of a YAML file: id, lang, question, accepted."""
    import yaml

    rows = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    rows = rows.get("questions", rows) if isinstance(rows, dict) else rows
    made = [(str(r["id"]), r.get("lang"), r["question"], [{"file": r["expected_file"], "pages": r.get("expected_pages") or []}, *({"file": a["file"], "pages": a.get("pages") or []} for a in r.get("also_accept") or [])]) for r in rows]
    return spark.createDataFrame(made, "id string, lang string, question string, accepted array<struct<file:string,pages:array<int>>>")


def read_used(path: str, day: str) -> int:
    """Answers used on a day by the state file; corrupt, missing or another day's counts as none."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        return int(data.get("used") or 0) if data.get("date") == day else 0
    except (OSError, ValueError, AttributeError):
        return 0


def write_used(path: str, day: str, used: int) -> None:
    """Replaces the state file at once; a failed write is passed over, the guard must not stop the answer."""
    try:
        target = Path(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        temp = target.with_suffix(".tmp")
        temp.write_text(json.dumps({"date": day, "used": used}), encoding="utf-8")
        temp.replace(target)
    except OSError:
        return


def memory_limit_mb(paths: tuple[str, ...] = ("/sys/fs/cgroup/memory.max", "/sys/fs/cgroup/memory/memory.limit_in_bytes")) -> int | None:
    """The container's memory ceiling in whole MB, or None if none is declared."""
    for p in paths:
        try:
            n = int(Path(p).read_text().strip())
        except (OSError, ValueError):
            continue
        if 0 < n < 1 << 50:
            return n // (1024 * 1024)
    return None


def inside_container(marker: str = "/.dockerenv") -> bool:
    return os.path.exists(marker)


def write_report(df: DataFrame, path: str) -> None:
    """Results as JSON lines in a folder."""
    df.write.mode("overwrite").json(path)
