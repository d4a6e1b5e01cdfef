"""Pages, headers, headings, clauses and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import layout, packing, structure
from ..operators.index import scratch_path
from ..sources import documents
from .base import LINES, PAGES, SPEC, STRIP, big, pages, query, spec_pages, table

SPLIT = r"""files AS (SELECT doc_id, replace(text, '. ', '.' || chr(10) || ' <!-- Page --> ' || chr(10)) AS text FROM documents),
cut AS (SELECT doc_id AS source_file, u.i AS page, ps[u.i] AS text FROM (SELECT doc_id, regexp_split_to_array(text, '(?im)^\s*<!--\s*page\s*-->\s*$') AS ps FROM files), unnest(range(1, len(ps) + 1)) AS u(i))"""


def _split(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("source_file"), F.replace("text", F.lit(". "), F.lit(".\n <!-- Page --> \n")).alias("text"))
    return big(structure.split_pages(files), "page")


@query(f"WITH {SPLIT} SELECT source_file, page, md5(text) AS text_md5 FROM cut")
def page_split(spark, d):
    return _split(spark, d).select("source_file", "page", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query(f"WITH {SPLIT} SELECT source_file, page FROM cut WHERE length({STRIP.format('text')}) >= 20")
def short_page_filter(spark, d):
    return structure.drop_short_pages(_split(spark, d)).select("source_file", "page")


def _written_files(batches):
    """Writes (path, text) rows as files, and gives back how many."""
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            system, at = fs.FileSystem.from_uri(path)
            system.create_dir(at.rpartition("/")[0])
            with system.open_output_stream(at) as f:
                f.write((text or "").encode())
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])


@query(f"WITH {SPLIT} SELECT 'doc_' || source_file || '.md' AS source_file, page, md5(text) AS text_md5 FROM cut WHERE length({STRIP.format('text')}) >= 20")
def source_pages(spark, d):
    """Documents as files of a folder, read back by the data source and cut at their page marks."""
    folder = scratch_path(spark, "folder")
    folder = folder if ":" in folder.split("/")[0] else f"file://{folder}"
    marked = F.replace("text", F.lit(". "), F.lit(".\n <!-- Page --> \n"))
    made = layout.spread(table(spark, d, "documents")).select(F.concat(F.lit(f"{folder}/doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), marked.alias("text"))
    made.mapInArrow(_written_files, "n bigint").agg(F.sum("n")).first()
    return big(documents.load_pages(spark, folder), "page").select("source_file", "page", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query(f"WITH {SPLIT} SELECT source_file, count(*) AS pages, max(page) AS last_page FROM cut GROUP BY 1")
def page_numbering(spark, d):
    return _split(spark, d).groupBy("source_file").agg(F.count("*").alias("pages"), F.max("page").alias("last_page"))


REPEATED = f"""{PAGES}, {LINES.format('pg')}, once AS (SELECT DISTINCT source_file, page, {STRIP.format('line')} AS line FROM lines), sizes AS (SELECT source_file, count(*) AS pages FROM pg GROUP BY 1),
rep AS (SELECT source_file, line, count(*) AS n FROM once WHERE line <> '' AND length(line) <= 120 AND line NOT LIKE '|%' GROUP BY 1, 2),
headers AS (SELECT rep.* FROM rep JOIN sizes USING (source_file) WHERE n >= greatest(2, floor(pages * 0.05::DOUBLE)))"""
NOISE = r"(?i)^\s*(?:page\s+)?\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?\s*$"


@query(f"WITH {REPEATED} SELECT source_file, line, n FROM headers")
def repeated_line_counts(spark, d):
    return structure.repeated_lines(pages(spark, d), share=0.05)


@query(f"""WITH {REPEATED}, kept AS (SELECT l.* FROM lines l WHERE {STRIP.format('line')} <> '' AND NOT regexp_matches(line, '{NOISE}') AND NOT EXISTS (SELECT 1 FROM headers h WHERE h.source_file = l.source_file AND h.line = {STRIP.format('l.line')}))
SELECT pg.source_file, pg.page, coalesce(k.text, '') AS text FROM pg LEFT JOIN (SELECT source_file, page, string_agg(line, chr(10) ORDER BY line_no) AS text FROM kept GROUP BY 1, 2) k ON k.source_file = pg.source_file AND k.page = pg.page""")
def strip_running_headers(spark, d):
    return structure.strip_running_headers(pages(spark, d), share=0.05)


@query(rf"""SELECT doc_id, regexp_matches(l, '{NOISE}') AS noise FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Page ' || doc_id || ' of 50' WHEN 1 THEN '  ' || doc_id || ' / 7 ' WHEN 2 THEN 'page ' || (doc_id * 1000) ELSE string_split(text, chr(10))[1] END AS l FROM documents)""")
def noise_lines(spark, d):
    i = F.col("doc_id")
    line = F.when(i % 4 == 0, F.concat(F.lit("Page "), i.cast("string"), F.lit(" of 50"))).when(i % 4 == 1, F.concat(F.lit("  "), i.cast("string"), F.lit(" / 7 "))).when(i % 4 == 2, F.concat(F.lit("page "), (i * 1000).cast("string"))).otherwise(F.element_at(F.split("text", "\n"), 1))
    return table(spark, d, "documents").select("doc_id", F.rlike(line, F.lit(structure.NOISE)).alias("noise"))


HEADS = rf"""{SPEC}, {LINES.format('spec')}, s AS (SELECT source_file, page, line_no, {STRIP.format('line')} AS s FROM lines),
k AS (SELECT *, CASE WHEN s = '' OR s LIKE '|%' THEN NULL
  WHEN regexp_matches(s, '^(\d+(?:\.\d+){{0,5}})\s+([A-Z][^.!?]{{2,90}})$') AND NOT regexp_matches(s, '^\d{{3,}}\s') THEN 'numbered'
  WHEN regexp_matches(s, '^\d{{1,2}}(?:\.\d{{1,2}}){{1,5}}$') THEN 'bare' WHEN regexp_matches(s, '^\d{{1,2}}\.\s+[A-Z][^.!?]{{2,90}}$') THEN 'dotted'
  WHEN regexp_matches(s, '^Part\s+[A-Z]\s*[-\x{{2013}}\x{{2014}}]\s*.+$') THEN 'part'
  WHEN lower(rtrim(s, ':')) IN ('scope', 'definitions', 'introduction', 'foreword', 'references', 'abbreviations', 'purpose', 'general', 'normative references', 'table of contents', 'contents', 'revision history', 'acknowledgements') THEN 'named' END AS kind FROM s),
heads AS (SELECT source_file, page, line_no, kind, CASE kind WHEN 'numbered' THEN regexp_extract(s, '^(\d+(?:\.\d+)*)', 1) WHEN 'bare' THEN s WHEN 'dotted' THEN regexp_extract(s, '^(\d+)', 1) WHEN 'part' THEN regexp_extract(s, '^(Part\s+[A-Z])', 1) ELSE '' END AS clause_id,
  CASE kind WHEN 'numbered' THEN trim(regexp_extract(s, '^\d+(?:\.\d+)*\s+(.*)$', 1)) WHEN 'dotted' THEN trim(regexp_extract(s, '^\d+\.\s+(.*)$', 1)) WHEN 'part' THEN trim(regexp_extract(s, '^Part\s+[A-Z]\s*[-\x{{2013}}\x{{2014}}]\s*(.+)$', 1)) WHEN 'named' THEN rtrim(s, ':') ELSE '' END AS title FROM k WHERE kind IS NOT NULL)"""
ACCEPTED = f"""{HEADS}, near AS (SELECT b.source_file, b.page, b.line_no, arg_max(t.title, (length(t.clause_id) - length(replace(t.clause_id, '.', ''))) * 1000000000000::BIGINT + t.page * 100000 + t.line_no) AS parent_title
  FROM heads b JOIN heads t ON t.source_file = b.source_file AND t.title <> '' AND t.kind IN ('numbered', 'dotted') AND starts_with(b.clause_id, t.clause_id || '.') AND (t.page < b.page OR t.page = b.page AND t.line_no < b.line_no) WHERE b.kind = 'bare' GROUP BY 1, 2, 3),
acc AS (SELECT h.*, coalesce(n.parent_title, '') AS parent_title FROM heads h LEFT JOIN near n ON n.source_file = h.source_file AND n.page = h.page AND n.line_no = h.line_no WHERE h.kind <> 'bare' OR n.parent_title IS NOT NULL)"""
SEGMENTS = rf"""{ACCEPTED}, run AS (SELECT s.source_file, s.page, s.line_no, s.s, a.kind, a.clause_id, a.title, a.parent_title, count(a.kind) OVER (PARTITION BY s.source_file ORDER BY s.page, s.line_no ROWS UNBOUNDED PRECEDING) AS seq
  FROM s LEFT JOIN acc a ON a.source_file = s.source_file AND a.page = s.page AND a.line_no = s.line_no),
grp AS (SELECT source_file, seq, coalesce(max(clause_id), '') AS clause_id, CASE WHEN seq = 0 THEN '(preamble)' ELSE max(title) END AS title, coalesce(max(parent_title), '') AS parent_title, string_agg(s, chr(10) ORDER BY page, line_no) FILTER (kind IS NULL) AS text, arg_min(page, page * 100000 + line_no) FILTER (kind IS NULL) AS page FROM run GROUP BY 1, 2),
seg AS (SELECT * FROM grp WHERE {STRIP.format('text')} <> '' AND len(regexp_extract_all(substr(text, 1, 1200), '\.{{4,}}\s*\d')) < 3 AND lower(rtrim(title, ':')) NOT IN ('table of contents', 'contents', 'revision history', 'acknowledgements'))"""


@query(f"WITH {HEADS} SELECT * FROM heads")
def detect_headings(spark, d):
    return big(structure.detect_headings(spec_pages(spark, d)), "line_no")


@query(f"WITH {ACCEPTED} SELECT * FROM acc")
def bare_guard(spark, d):
    return big(structure.accept_headings(structure.detect_headings(spec_pages(spark, d))), "line_no")


@query(rf"WITH {SEGMENTS} SELECT source_file, seq, clause_id, title, parent_title, CASE WHEN contains(clause_id, '.') THEN regexp_replace(clause_id, '\.[^.]*$', '') ELSE '' END AS section, page, text FROM seg")
def segment_clauses(spark, d):
    seg = structure.segment(spec_pages(spark, d))
    return seg.select("source_file", "seq", "clause_id", "title", "parent_title", "section", "page", F.array_join(F.col("lines.line"), "\n").alias("text"))


@query(rf"WITH {HEADS} SELECT DISTINCT clause_id, CASE WHEN contains(clause_id, '.') THEN regexp_replace(clause_id, '\.[^.]*$', '') ELSE '' END AS section FROM heads")
def parent_title(spark, d):
    return structure.detect_headings(spec_pages(spark, d)).select("clause_id", X.parent_of(F.col("clause_id")).alias("section")).distinct()


NAMES = "names AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'S-' || (700 + doc_id % 40) || 'v2024-01 TRS.pdf' WHEN 1 THEN 's-' || (700 + doc_id % 40) || 'Qv2024-01 qrs.md' WHEN 2 THEN 'S-719Jv2023 TRS with Justification.pdf' WHEN 3 THEN '459.pdf' WHEN 4 THEN 'notes.' || doc_id || '.txt' WHEN 5 THEN 'S-' || doc_id || 'v3 IRS.pdf' WHEN 6 THEN 'S-' || doc_id || 'v3 annex.pdf' ELSE 'S-' || doc_id || 'v3.pdf' END AS name FROM documents)"


@query(rf"""WITH {NAMES}, p AS (SELECT doc_id, name, upper(regexp_extract(name, '(?i)^(S-\d+)[A-Z]?v[\d-]+\s*(.*)\.[A-Z0-9]+$', 1)) AS code, trim(regexp_extract(name, '(?i)^(S-\d+)[A-Z]?v[\d-]+\s*(.*)\.[A-Z0-9]+$', 2)) AS tail, regexp_extract(name, '^(\d{{3}})\.[A-Za-z0-9]+$', 1) AS rep FROM names)
SELECT doc_id, CASE WHEN code <> '' THEN code WHEN rep <> '' THEN 'IOGP ' || rep ELSE regexp_replace(name, '\.[^.]*$', '') END AS family,
 CASE WHEN code <> '' THEN (CASE WHEN contains(upper(tail), 'TRS') THEN 'TRS' WHEN contains(upper(tail), 'QRS') THEN 'QRS' WHEN contains(upper(tail), 'IRS') THEN 'IRS' WHEN tail <> '' THEN tail ELSE 'spec' END) || CASE WHEN contains(lower(tail), 'justification') THEN '+Justification' ELSE '' END WHEN rep <> '' THEN 'Report' ELSE 'document' END AS role FROM p""")
def describe_document(spark, d):
    i = F.col("doc_id")
    s = i.cast("string")
    m = i % 8
    code = (700 + i % 40).cast("string")
    name = (
        F.when(m == 0, F.concat(F.lit("S-"), code, F.lit("v2024-01 TRS.pdf"))).when(m == 1, F.concat(F.lit("s-"), code, F.lit("Qv2024-01 qrs.md"))).when(m == 2, "S-719Jv2023 TRS with Justification.pdf").when(m == 3, "459.pdf")
        .when(m == 4, F.concat(F.lit("notes."), s, F.lit(".txt"))).when(m == 5, F.concat(F.lit("S-"), s, F.lit("v3 IRS.pdf"))).when(m == 6, F.concat(F.lit("S-"), s, F.lit("v3 annex.pdf"))).otherwise(F.concat(F.lit("S-"), s, F.lit("v3.pdf")))
    )
    family, role = X.describe_document(F.col("name"))
    return table(spark, d, "documents").select("doc_id", name.alias("name")).select("doc_id", family.alias("family"), role.alias("role"))


LABEL = "'[' || source_file || CASE WHEN clause_id <> '' THEN ' | §' || clause_id || CASE WHEN coalesce(nullif(title, ''), parent_title) <> '' THEN ' ' || coalesce(nullif(title, ''), parent_title) ELSE '' END WHEN coalesce(nullif(title, ''), parent_title) <> '' THEN ' | ' || coalesce(nullif(title, ''), parent_title) ELSE '' END || ' | p.' || {0} || ']'"


@query(f"WITH {SEGMENTS} SELECT source_file, seq, {LABEL.format('page')} AS label FROM seg")
def context_label(spark, d):
    seg = structure.segment(spec_pages(spark, d))
    return seg.select("source_file", "seq", X.context_label(F.col("source_file"), F.col("clause_id"), F.col("title"), F.col("parent_title"), F.col("page")).alias("label"))


@query(r"""WITH t AS (SELECT doc_id, repeat('Foreword ..... ' || doc_id || chr(10), CAST(doc_id % 5 AS INTEGER)) || text AS t FROM documents) SELECT doc_id, len(regexp_extract_all(substr(t, 1, 1200), '\.{4,}\s*\d')) >= 3 AS toc FROM t""")
def toc_test(spark, d):
    t = F.concat(F.repeat(F.concat(F.lit("Foreword ..... "), F.col("doc_id").cast("string"), F.lit("\n")), (F.col("doc_id") % 5).cast("int")), F.col("text"))
    return table(spark, d, "documents").select("doc_id", X.looks_like_toc(t).alias("toc"))


@query(f"WITH {SEGMENTS} SELECT DISTINCT source_file, title FROM seg")
def skip_sections(spark, d):
    return structure.segment(spec_pages(spark, d)).select("source_file", "title").distinct()


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS tokens FROM documents")
def token_counts(spark, d):
    return big(table(spark, d, "documents").select("doc_id", X.count_words(F.col("text")).alias("tokens")), "tokens")


SPLIT_LONG = r"""RECURSIVE ws AS (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents), n AS (SELECT doc_id, u.i, w[u.i] AS word, CASE WHEN regexp_matches(w[u.i], '\S') THEN 1 ELSE 0 END AS t FROM ws, unnest(range(1, len(w) + 1)) AS u(i)),
f AS (SELECT doc_id, i, t AS size, 0 AS part FROM n WHERE i = 1 UNION ALL SELECT n.doc_id, n.i, CASE WHEN f.size > 0 AND f.size + n.t > 40 THEN n.t ELSE f.size + n.t END, f.part + CASE WHEN f.size > 0 AND f.size + n.t > 40 THEN 1 ELSE 0 END FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1)"""


@query(r"WITH " + SPLIT_LONG + """, p AS (SELECT f.doc_id, f.part, string_agg(n.word, ' ' ORDER BY n.i) AS line FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i GROUP BY 1, 2), c AS (SELECT doc_id, sum(t) AS tokens FROM n GROUP BY 1),
o AS (SELECT doc_id, part, line FROM p JOIN c USING (doc_id) WHERE tokens > 40 UNION ALL SELECT doc_id, 0, array_to_string(w, ' ') FROM ws JOIN c USING (doc_id) WHERE tokens <= 40) SELECT doc_id, CAST(part AS BIGINT) AS part, md5(line) AS line_md5 FROM o""")
def split_long_lines(spark, d):
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(packing.split_long_line(line, 40)).alias("part", "line"))
    return big(parts.select("doc_id", "part", F.md5(F.encode("line", "UTF-8")).alias("line_md5")), "part")


# Packing of the clauses of spec pages to 60 words, in SQL: parts of long lines, then a fold over the parts of a clause.
PACK = SEGMENTS.replace("spec AS (SELECT", "RECURSIVE spec AS (SELECT", 1) + rf"""
, bud AS (SELECT source_file, seq, clause_id, title, parent_title, greatest(20, 60 - (len(regexp_extract_all({LABEL.format('page')}, '\S+')) + 4)) AS budget FROM seg),
ln AS (SELECT r.source_file, r.seq, r.page, r.line_no, r.s, b.budget, len(regexp_extract_all(r.s, '\S+')) AS t FROM run r JOIN bud b ON b.source_file = r.source_file AND b.seq = r.seq WHERE r.kind IS NULL AND r.s <> ''),
lw AS (SELECT source_file, seq, page, line_no, budget, u.i, ws[u.i] AS word, CASE WHEN regexp_matches(ws[u.i], '\S') THEN 1 ELSE 0 END AS t FROM (SELECT *, string_split(s, ' ') AS ws FROM ln WHERE t > budget), unnest(range(1, len(ws) + 1)) AS u(i)),
lf AS (SELECT source_file, seq, page, line_no, i, t AS size, 0 AS part FROM lw WHERE i = 1 UNION ALL SELECT w.source_file, w.seq, w.page, w.line_no, w.i, CASE WHEN f.size > 0 AND f.size + w.t > w.budget THEN w.t ELSE f.size + w.t END, f.part + CASE WHEN f.size > 0 AND f.size + w.t > w.budget THEN 1 ELSE 0 END
  FROM lf f JOIN lw w ON w.source_file = f.source_file AND w.seq = f.seq AND w.page = f.page AND w.line_no = f.line_no AND w.i = f.i + 1),
parts AS (SELECT source_file, seq, page, line_no, 0 AS part, s AS line, t FROM ln WHERE t <= budget UNION ALL SELECT f.source_file, f.seq, f.page, f.line_no, f.part, string_agg(w.word, ' ' ORDER BY w.i), CAST(sum(w.t) AS BIGINT) FROM lf f JOIN lw w ON w.source_file = f.source_file AND w.seq = f.seq AND w.page = f.page AND w.line_no = f.line_no AND w.i = f.i GROUP BY 1, 2, 3, 4, 5),
ord AS (SELECT p.*, b.budget, row_number() OVER (PARTITION BY p.source_file, p.seq ORDER BY page, line_no, part) AS k FROM parts p JOIN bud b ON b.source_file = p.source_file AND b.seq = p.seq),
fold AS (SELECT source_file, seq, k, page, t AS size, 0 AS piece FROM ord WHERE k = 1 UNION ALL SELECT o.source_file, o.seq, o.k, o.page, CASE WHEN o.page <> f.page OR f.size > 0 AND f.size + o.t > o.budget THEN o.t ELSE f.size + o.t END, f.piece + CASE WHEN o.page <> f.page OR f.size > 0 AND f.size + o.t > o.budget THEN 1 ELSE 0 END
  FROM fold f JOIN ord o ON o.source_file = f.source_file AND o.seq = f.seq AND o.k = f.k + 1),
pieces AS (SELECT f.source_file, f.seq, f.piece, min(f.page) AS page, string_agg(o.line, chr(10) ORDER BY o.k) AS body, CAST(sum(o.t) AS BIGINT) AS tokens FROM fold f JOIN ord o ON o.source_file = f.source_file AND o.seq = f.seq AND o.k = f.k GROUP BY 1, 2, 3),
packed AS (SELECT p.*, {LABEL.format('p.page')} || chr(10) || body AS page_content FROM (SELECT *, count(*) OVER (PARTITION BY source_file, seq) AS n FROM pieces) p JOIN (SELECT source_file AS sf, seq AS sq, clause_id, title, parent_title FROM seg) g ON g.sf = p.source_file AND g.sq = p.seq WHERE n = 1 OR tokens >= 20)"""


def _packed(spark, d):
    return packing.pack(structure.segment(spec_pages(spark, d)), 60)


@query(f"WITH {PACK} SELECT source_file, seq, CAST(piece AS BIGINT) AS piece, page, tokens, page_content FROM packed")
def pack_chunks(spark, d):
    return big(_packed(spark, d).select("source_file", "seq", "piece", "page", "tokens", "page_content"), "piece", "page", "tokens")


@query(f"WITH {PACK} SELECT count(*) AS chunks, min(tokens) AS least, list_sort(list(tokens))[1 + count(*) // 2] AS median, max(tokens) AS most, count(*) FILTER (tokens > 55) AS over, true AS sketch_within FROM packed")
def chunk_stats(spark, d):
    """The sketch's median must have a rank within its stated error: so many chunks are smaller, and so many aren't larger."""
    at = scratch_path(spark, "packed")
    _packed(spark, d).select("tokens").write.parquet(at)
    made = spark.read.parquet(at)
    stats = big(packing.chunk_stats(made, 55), "least", "median", "most")
    ranks = made.crossJoin(F.broadcast(stats.select("about"))).agg(F.count_if(F.col("tokens") < F.col("about")).alias("below"), F.count_if(F.col("tokens") <= F.col("about")).alias("up_to"))
    half, error = F.col("chunks") / 2, F.greatest(F.lit(1), F.col("chunks") / packing.SKETCH)
    within = (F.col("below") <= half + error) & (F.col("up_to") >= half - error)
    return stats.crossJoin(F.broadcast(ranks)).withColumn("sketch_within", within).drop("about", "below", "up_to")
