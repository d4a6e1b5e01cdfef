"""Clauses to chunks that stay on one page and within a token budget: one pass over each clause's lines, in Arrow batches.

The greedy fold depends on every earlier line of its clause, and tokens may be a tokenizer's: that is
Python's part. Labels, keys and statistics are built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .layout import spread

#: Fixed values.
FRACTION, MIN_TOKENS, DEFAULT_WINDOW, LABEL_ROOM = 0.85, 20, 512, 4

#: Tokens of each text.
Counter = Callable[[list[str]], list[int]]


def word_counter() -> Counter:
    """The offline counter: runs of other characters than white space, as X.count_words counts."""
    found = re.compile(r"[\S\x1c-\x1f]+").findall
    return lambda texts: [len(found(t)) for t in texts]


def tokenizer_counter(path: str) -> Callable[[], Counter]:
    """A counter by a `tokenizers` file on every worker, without special tokens, truncation or padding."""

    def load() -> Counter:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    return load


def token_counts(texts: Column, load: Callable[[], Counter] = word_counter) -> Column:
    """Tokens of each text by a counter; a null text has none."""

    @F.pandas_udf("int")
    def count(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = load()
        for s in series:
            yield pd.Series(known(s.fillna("").tolist()), index=s.index, dtype="int32")

    return count(texts)


def model_window(config: dict, keys: tuple[str, ...] = ("max_seq_length", "model_max_length", "max_position_embeddings")) -> int:
    """The first of the keys that holds a whole number from 1 to 8192, else 512."""
    return next((config[k] for k in keys if isinstance(config.get(k), int) and not isinstance(config[k], bool) and 1 <= config[k] <= 8192), DEFAULT_WINDOW)


def cut_line(line: str, budget: int, count: Counter) -> list[str]:
    """Parts of a line above the budget, cut between words; a single word above it stays whole."""
    words = line.split(" ")
    done, begin, size = [], 0, 0
    for i, n in enumerate(count([w + " " for w in words])):
        if size > 0 and size + n > budget:
            done.append(" ".join(words[begin:i]))
            begin, size = i, n
        else:
            size += n
    return [*done, " ".join(words[begin:])]


def split_long_line(line: Column, budget: int, load: Callable[[], Counter] = word_counter) -> Column:
    """Array of the parts of a line; one within the budget is its only part, a null line has none."""

    @F.pandas_udf("array<string>")
    def split(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = load()
        for s in series:
            sizes = count(s.fillna("").tolist())
            yield pd.Series([None if x is None else [x] if n <= budget else cut_line(x, budget, count) for x, n in zip(s, sizes, strict=True)], index=s.index, dtype=object)

    return split(line)


def fold(parts: list[tuple[int | None, str, int]], budget: int) -> list[tuple[int | None, list[str]]]:
    """(page, lines) of the pieces of (page, line, tokens): flushed at page breaks and before the budget is passed."""
    out: list[tuple[int | None, list[str]]] = []
    size = 0
    for page, line, n in parts:
        if out and page == out[-1][0] and not (size > 0 and size + n > budget):
            out[-1][1].append(line)
            size += n
        else:
            out.append((page, [line]))
            size = n
    return out


def pack(clauses: DataFrame, max_tokens: int, min_tokens: int = MIN_TOKENS, load: Callable[[], Counter] = word_counter) -> DataFrame:
    """Chunks of clauses: chunk key (source_file, seq, piece), page of the piece, page_content with its label, and the clause's columns.

    The label counts against the budget.  If a clause has several pieces, those under
    `min_tokens` are dropped.  Empty and null lines are passed over; a clause without any other has no chunk.
    """
    label = lambda page: X.context_label(F.col("source_file"), F.col("clause_id"), F.col("title"), F.col("parent_title"), page)
    heading = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("parent_title"))
    carried = ["source_file", "doc_family", "doc_role", "clause_id", "section", "title", "parent_title", "seq", "heading"]
    rows = clauses.withColumn("heading", heading).select(*carried, label(F.col("page")).alias("label"), F.col("lines.page").alias("pages"), F.col("lines.line").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load()
        for batch in batches:
            budgets = [max(min_tokens, max_tokens - (n + LABEL_ROOM)) for n in count(pc.fill_null(batch.column("label"), "").to_pylist())]
            row, piece, page, body, of = [], [], [], [], []
            pages, texts = batch.column("pages").to_pylist(), batch.column("texts").to_pylist()
            sizes = iter(count([x for lines in texts for x in lines or () if x]))
            for r, budget in enumerate(budgets):
                parts = []
                for p, x in zip(pages[r] or (), texts[r] or (), strict=True):
                    if not x:
                        continue
                    n = next(sizes)
                    cut = [x] if n <= budget else cut_line(x, budget, count)
                    parts += [(p, x, n)] if len(cut) == 1 else zip([p] * len(cut), cut, count(cut), strict=True)
                made = fold(parts, budget)
                for k, (p, lines) in enumerate(made):
                    row.append(r)
                    piece.append(k)
                    page.append(p)
                    body.append("\n".join(lines))
                    of.append(len(made))
            tokens = count(body)
            keep = pa.array([o == 1 or n >= min_tokens for o, n in zip(of, tokens, strict=True)], pa.bool_())
            columns = [batch.column(c).take(pa.array(row, pa.int32())) for c in carried]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(piece, pa.int32()), pa.array(page, pa.int32()), pa.array(body, pa.string()), pa.array(tokens, pa.int32())], names=[*carried, "piece", "page", "body", "tokens"]).filter(keep)

    schema = T.StructType([*[rows.schema[c] for c in carried], T.StructField("piece", T.IntegerType()), T.StructField("page", T.IntegerType()), T.StructField("body", T.StringType()), T.StructField("tokens", T.IntegerType())])
    rows = rows.withColumn("pages", F.col("pages").cast("array<int>"))
    return rows.mapInArrow(run, schema).withColumn("page_content", F.concat(label(F.col("page")), F.lit("\n"), F.col("body"))).drop("body")


def build_chunks(pages: DataFrame, window: int = DEFAULT_WINDOW, min_tokens: int = MIN_TOKENS, load: Callable[[], Counter] = word_counter) -> DataFrame:
    """Pages to chunks: headers stripped, clauses cut, packed to 85% of the model's window; chunk_id sorts as the corpus does."""
    from .structure import segment, strip_running_headers

    chunks = pack(segment(strip_running_headers(spread(pages))), int(window * FRACTION), min_tokens, load)
    return chunks.withColumn("chunk_id", F.concat_ws("#", "source_file", F.format_string("%06d", "seq"), F.format_string("%04d", "piece")))


#: Accuracy of the median's sketch: its rank is off by at most chunks / SKETCH.
SKETCH = 1000


def chunk_stats(chunks: DataFrame, window: int) -> DataFrame:
    """One row: chunks, least, upper median and most tokens, how many pass the window, and `about`, the median by a mergeable quantile sketch.

    The exact median keeps a count for each distinct size; the sketch (Spark's approx_percentile, rank error 1 / SKETCH) stays small whatever the sizes are.
    """
    about = F.percentile_approx("tokens", 0.5, SKETCH).alias("about")
    return chunks.agg(F.count("*").alias("chunks"), F.min("tokens").alias("least"), F.expr("percentile_disc(0.5) within group (order by tokens desc)").alias("median"), F.max("tokens").alias("most"), F.count_if(F.col("tokens") > window).alias("over"), about)
