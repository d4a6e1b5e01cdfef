"""Scalar text functions: Column to Column, built-in expressions only.

Regular expressions use (?U) where Unicode white space counts.  A null text counts as
empty unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns and word lists that results depend on.
TOKEN = r"[a-z0-9][a-z0-9\-.]*"
QUOTE_WINDOW = 6
NOT_FOUND = "This information is not found in the loaded documents."
CONTAINED = r"(?m)^\s*(?:#{1,6}\s*(\d{1,3}(?:\.\d{1,3}){0,3})|(\d{1,3}(?:\.\d{1,3}){1,3}))\s+(?=[A-Z(\d])"
SPEC_NAME = r"(?i)^(S-\d+)[A-Za-z]?v[\d-]+\s*(.*)\.[A-Za-z0-9]+$"
REPORT_NAME = r"^(\d{3})\.[A-Za-z0-9]+$"
CAPABILITY = (
    r"(?i)(what can (you|i)\b|what (questions|topics)\b|what (does|is) this (app|demo|chat|tool)\b|how do i use\b"
    r"|what are you able\b|apa (saja )?(yang )?bisa\b|bisa (ditanyakan|ditanya|dibahas|dicek apa)\b|topik apa\b)"
)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def normalise(c: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text(c), r"(?U)\s+", " ")))


def tokenize(c: Column) -> Column:
    """Keyword tokens in order; hyphens and dots stay inside; a plural is followed by its singular (over three letters, one s)."""
    plural = lambda t: (F.length(t) > 3) & F.endswith(t, F.lit("s")) & ~F.endswith(t, F.lit("ss"))
    found = F.regexp_extract_all(F.lower(text(c)), F.lit(TOKEN), F.lit(0))
    return F.flatten(F.transform(found, lambda t: F.when(plural(t), F.array(t, F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(F.array(t))))


def count_words(c: Column) -> Column:
    """The offline token counter: runs of other characters than white space."""
    return F.regexp_count(text(c), F.lit(r"(?U)\S+"))


def quote_supported(quote: Column, excerpt: Column, window: int = QUOTE_WINDOW) -> Column:
    """Do `window` words in a row of the quote (all of a shorter one) occur in the excerpt? False if either is blank."""
    q, hay = normalise(quote), normalise(excerpt)
    words = F.split(q, " ")
    n = F.size(words)
    spans = F.transform(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, window), " "))
    return (q != "") & (hay != "") & F.exists(spans, lambda s: F.contains(hay, s))


def clause_present(clause_id: Column, excerpt: Column) -> Column:
    """Does this number stand in the excerpt, not inside a longer one? False for an empty id."""
    pattern = F.concat(F.lit(r"(?<![\d.])\Q"), text(clause_id), F.lit(r"\E(?![\d.])"))
    return (text(clause_id) != "") & F.coalesce(F.rlike(text(excerpt), pattern), F.lit(False))


def contained_clauses(body: Column, own: Column, limit: int = 8) -> Column:
    """Clause numbers that open lines or name markdown headings, in order, each once, without the excerpt's own."""
    a, b = (F.regexp_extract_all(text(body), F.lit(CONTAINED), F.lit(g)) for g in (1, 2))
    return F.slice(F.array_distinct(F.filter(F.zip_with(a, b, lambda x, y: F.concat(x, y)), lambda x: (x != "") & ~x.eqNullSafe(own))), 1, limit)


def parent_of(clause_id: Column) -> Column:
    """'8.1.2' to '8.1', '8' to ''."""
    return F.when(F.contains(clause_id, F.lit(".")), F.regexp_replace(clause_id, r"\.[^.]*$", "")).otherwise("")


def describe_document(name: Column) -> tuple[Column, Column]:
    """(family, role) of a file name: specification code and kind, three-digit report, or the stem."""
    code, tail = F.upper(F.regexp_extract(name, SPEC_NAME, 1)), F.trim(F.regexp_extract(name, SPEC_NAME, 2))
    up = F.upper(tail)
    role = F.when(F.contains(up, F.lit("TRS")), "TRS").when(F.contains(up, F.lit("QRS")), "QRS").when(F.contains(up, F.lit("IRS")), "IRS").when(tail != "", tail).otherwise("spec")
    role = F.concat(role, F.when(F.contains(F.lower(tail), F.lit("justification")), "+Justification").otherwise(""))
    report = F.regexp_extract(name, REPORT_NAME, 1)
    family = F.when(code != "", code).when(report != "", F.concat(F.lit("IOGP "), report)).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    return family, F.when(code != "", role).when(report != "", "Report").otherwise("document")


def context_label(source: Column, clause_id: Column, title: Column, parent_title: Column, page: Column) -> Column:
    """[file | §id heading | p.n]: the label that opens each chunk."""
    heading = F.when(text(title) != "", title).otherwise(text(parent_title))
    middle = F.when(text(clause_id) != "", F.concat(F.lit("§"), clause_id, F.when(heading != "", F.concat(F.lit(" "), heading)).otherwise(""))).when(heading != "", heading)
    return F.concat(F.lit("["), F.concat_ws(" | ", source, middle, F.concat(F.lit("p."), page.cast("string"))), F.lit("]"))


def looks_like_toc(c: Column, sample: int = 1200) -> Column:
    """Three dot leaders or more in the first `sample` characters."""
    return F.regexp_count(F.substring(text(c), 1, sample), F.lit(r"\.{4,}\s*\d")) >= 3


def is_capability_question(question: Column) -> Column:
    """Is this about the assistant, not the documents? False for null."""
    return F.rlike(text(question), F.lit(CAPABILITY))


def content_to_text(json: Column) -> Column:
    """Plain text of a message given as JSON: a string, a list of strings and {text or content} blocks joined by line ends, null (''), or anything else as it is.

    Parsed once, as a VARIANT; what isn't JSON stays as it is.
    """
    value = F.try_parse_json(json)
    part = lambda v, path: F.try_variant_get(v, path, "string")
    block = lambda b: F.when(F.startswith(F.schema_of_variant(b), F.lit("OBJECT")), F.coalesce(F.nullif(part(b, "$.text"), F.lit("")), part(b, "$.content"), F.lit(""))).otherwise(F.coalesce(part(b, "$"), F.lit("")))
    kind = F.schema_of_variant(value)
    listed = F.array_join(F.transform(F.try_variant_get(value, "$", "array<variant>"), block), "\n")
    return F.when(json.isNull() | F.is_variant_null(value), "").when(F.startswith(kind, F.lit("ARRAY")), listed).when(kind == "STRING", part(value, "$")).otherwise(json)


def render_answer(claims: Column) -> Column:
    """Verified claims (text, source_file, page) as text: a sentence, a dash list, or that nothing was found."""
    line = lambda c: F.concat(c["text"], F.lit(" (Source: "), c["source_file"], F.lit(", Page: "), c["page"].cast("string"), F.lit(")"))
    lines = F.transform(claims, line)
    return F.when(claims.isNull() | (F.size(claims) == 0), NOT_FOUND).when(F.size(claims) == 1, F.element_at(lines, 1)).otherwise(F.concat(F.lit("- "), F.array_join(lines, "\n- ")))


def format_excerpt(number: Column, source: Column, clause_id: Column, page: Column, body: Column, citable: bool = True, blank: str = "-") -> Column:
    """One numbered excerpt, its body marked as untrusted data, with the other clauses that may be cited from it if `citable`. `blank` stands for an empty clause."""
    extra = contained_clauses(body, clause_id) if citable else F.array()
    head = F.concat(F.lit("["), number.cast("string"), F.lit("] Source: "), F.coalesce(source, F.lit("unknown")), F.lit(" | Clause: "), F.when(text(clause_id) == "", blank).otherwise(clause_id), F.lit(" | Page: "), F.coalesce(page.cast("string"), F.lit("?")))
    head = F.concat(head, F.when(F.size(extra) > 0, F.concat(F.lit(" | Also citable from this excerpt: "), F.array_join(extra, ", "))).otherwise(""))
    return F.concat(head, F.lit("\n<untrusted_source>\n"), text(body), F.lit("\n</untrusted_source>"))


def html_escape(c: Column) -> Column:
    out = text(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def preview(c: Column, n: int = 600) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def seconds_to_midnight(ts: Column) -> Column:
    """Until the next calendar day; the session's time zone must be UTC."""
    return F.greatest(F.unix_timestamp(F.date_add(F.to_date(ts), 1).cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp")), F.lit(0))


def format_wait(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    m = F.floor(s / 60)
    return F.when(m >= 60, F.concat(F.floor(m / 60).cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m"))).when(m > 0, F.concat(m.cast("string"), F.lit("m"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def legacy_chunk_key(source: Column, page: Column, clause_id: Column, body: Column) -> Column:
    """Key by file, page, clause and the first 40 characters. It collides for long labels; chunk_id doesn't."""
    return F.concat_ws("|", source, page.cast("string"), text(clause_id), F.substring(text(body), 1, 40))


def with_prefix(c: Column, model: str, role: str, prompts: dict[str, dict[str, str]]) -> Column:
    """The text with the prefix that the model expects for queries or passages; none for an unknown model."""
    return F.concat(F.lit(prompts.get(model, {}).get(role, "")), text(c))


def lookup(c: Column, names: dict[str, str]) -> Column:
    """A friendly name; an unknown one stays as it is."""
    if not names:
        return c
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def luminance(hex_colour: Column) -> Column:
    """Relative luminance of '#rrggbb'."""
    def channel(at: int) -> Column:
        v = F.conv(F.substring(hex_colour, at, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

    return 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6)


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)
