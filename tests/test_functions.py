from pyspark.sql import functions as F

from evidentia.functions import text as X


def one(spark, column, **values):
    names = list(values) or ["x"]
    row = [tuple(values.values()) or (1,)]
    df = spark.createDataFrame(row, ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in (values or {"x": 1}).items()) if names else "x int")
    return df.select(column.alias("r")).first()["r"]


def test_tokenizer_keeps_codes_and_adds_singulars(spark):
    tok = lambda t: one(spark, X.tokenize(F.col("t")), t=t)
    assert tok("Flange B-16.5 for Pipes") == ["flange", "b-16.5", "for", "pipes", "pipe"]
    assert tok("EN 10204-3.1 records, valves.") == ["en", "10204-3.1", "records", "record", "valves."]
    assert tok("bus stress ABS") == ["bus", "stress", "abs"]
    assert tok(None) == [] and tok("") == []


def test_quote_support(spark):
    sup = lambda q, e: one(spark, X.quote_supported(F.col("q"), F.col("e")), q=q, e=e)
    body = "Painters keep the drying room above twelve degrees until the second coat has set."
    assert sup("keep the drying room above twelve", body)
    assert sup(" KEEP\nthe drying   room Above twelve degrees", body)
    assert sup("someone said that the room was warm enough", body) is False
    assert sup("second coat", body) and sup("", body) is False and sup("x", "") is False and sup(None, None) is False
    # six words in a row are enough, whatever stands around them
    assert sup("they say keep the drying room above twelve always", body)


def test_clause_numbers(spark):
    present = lambda i, e: one(spark, X.clause_present(F.col("i"), F.col("e")), i=i, e=e)
    assert present("6.4.2", "as in 6.4.2, unless") and not present("6.4.2", "under 16.4.2") and not present("6.4.2", "6.4.20 says") and not present("7", "7.25 mm") and not present("", "x") and not present(None, "x")
    body = "[plan.md | p.4]\n9.2.1 Storage\nshelves\n9.2.3 Labels\n## 9.3 Transport\n9.3.1 (a) by road\n9.2.3 Labels again\n10 Annex"
    assert one(spark, X.contained_clauses(F.col("b"), F.lit("9.2.1")), b=body) == ["9.2.3", "9.3", "9.3.1"]
    assert one(spark, X.contained_clauses(F.col("b"), F.lit("")), b="# 4 Terms\nwords\n5.6 Units") == ["4", "5.6"]


def test_document_names(spark):
    names = {"123.md": ("IOGP 123", "Report"), "s-801v2020 trs.txt": ("S-801", "TRS"), "S-802Qv2021-12 QRS.pdf": ("S-802", "QRS"), "S-803Jv2022 IRS with justification.pdf": ("S-803", "IRS+Justification"), "minutes.may.md": ("minutes.may", "document"), "S-804v7.pdf": ("S-804", "spec"), "S-805v7 Annex B.pdf": ("S-805", "Annex B"), "1234.pdf": ("1234", "document")}
    fam, role = X.describe_document(F.col("n"))
    for n, want in names.items():
        assert one(spark, F.struct(fam, role), n=n) == want, n


def test_capability_questions(spark):
    yes = ["What topics do you know?", "So what does this tool cover", "how do I use it", "WHAT CAN I look up", "what are you able to find?", "apa yang bisa dicek apa", "Topik apa saja"]
    no = ["How often is a valve tested?", "What must the buyer deliver with the pump?", "apa isi bab tiga?", "Which paint can be used?", "", None]
    for q in yes:
        assert one(spark, X.is_capability_question(F.col("q")), q=q), q
    for q in no:
        assert not one(spark, X.is_capability_question(F.col("q")), q=q), q


def test_message_content(spark):
    text = lambda j: one(spark, X.content_to_text(F.col("j")), j=j)
    assert text('"a"') == "a" and text('[{"type":"text","text":"a"},"b",{"content":"c"}]') == "a\nb\nc" and text(None) == "" and text("null") == "" and text("42") == "42"


def test_waits(spark):
    for s, want in ((3700, "1h 1m"), (61, "1m"), (59, "59s"), (0, "0s")):
        assert one(spark, X.format_wait(F.col("s")), s=s) == want


def test_contrast(spark):
    assert abs(one(spark, X.contrast(F.lit("#ffffff"), F.lit("#000000"))) - 21) < 1e-9
