"""Identifiers, captions and fuzzy words, line by line."""

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspan.functions import entities as E
from veilspan.functions import predicates as P
from veilspan.functions import text as T
from veilspan.functions import vocabulary as V
from veilspan.plans import catalogue

HINTS = {
    "": [], " \t\n": [], None: [],
    "write to asha.verma+x@mail.example.com now": [("EMAIL", "asha.verma+x@mail.example.com", True)],
    "pay asha@okbank": [("UPI", "asha@okbank", True)],
    "HDFC0123456 and ABCDE1234F": [("IFSC", "HDFC0123456", True), ("PAN", "ABCDE1234F", True)],
    "see https://example.com/a?b, ok": [("URL", "https://example.com/a?b", True)],
    "host 10.20.30.40 up": [("IP", "10.20.30.40", True)],
    "no 1.2.3.4.5 here": [],
    "passport K1234567": [("PASSPORT", "K1234567", True)],
    "2345 6789 0123": [("AADHAAR", "2345 6789 0123", True)],
    "on 12/11/1990": [("DATE", "12/11/1990", False)],
    "Rs 1,234.50 due": [("MONEY", "Rs 1,234.50", False)],
    "A/c no 123456789012": [("AADHAAR", None, None)],
    "4111 1111 1111 1111": [("AADHAAR", "4111 1111 1111", True), ("CARD", "4111 1111 1111 1111", True)],
    "4111 1111 1111 1112": [("AADHAAR", "4111 1111 1111", True), ("CARD", "4111 1111 1111 1112", False)],
    "XXXX XXXX XXXX 1234": [("CARD", "XXXX XXXX XXXX 1234", True)],
    "call +91 98765 43210": [("PHONE", "+91 98765 43210", True)],
    "Rs 5 call 98765 43210": [("MONEY", "Rs 5", False)],
    "zip 560001": [("PIN", "560001", False)],
    "a@b.example.com a@b.example.com": [("EMAIL", "a@b.example.com", True)],
}


def test_hints(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(HINTS)], "id int, text string")
    got = {r.text: [(h.kind, h.matched, h.strong) for h in r.hints] for r in E.with_hints(rows).collect()}
    for text, want in HINTS.items():
        if text and text.startswith("A/c"):
            assert ("ACCOUNT", "123456789012", True) in got[text]
        else:
            assert got[text] == want, text


#: Numbers in words, two with one mark between, kinds that the SQL hasn't, a carriage return at the end, a number that first stands in a longer one.
LINES = [
    "key ab1059743005344cd and 4111111111111111 end", "é4111111111111111é", "call 5554321 +1 (438) 555-5817 or 5556789 now", "+1 (438) 555-5817", "at 7642 6360 0241 zip 560001", "x@y.example.com 10.2.3.4",
    "XXXX XXXX XXXX 1234", "no 2428942606\r", "n 9428942606 and 12428942606123 8942606 then", "Rs 5 call 2345678 8640635", "a 98765\x0b43210 b", "12345678 12345678", "ab@okbank K1234567 12/11/1990",
]


@pytest.mark.parametrize("name", ["card_hits_luhn", "phone_hits", "all_hints", "document_decisions"])
def test_document_hints_as_their_sql_says(spark, tiny, tmp_path, name):
    agree(spark, tiny, tmp_path, name, documents=spark.createDataFrame([(k, t) for k, t in enumerate([*LINES, "\n".join(LINES)])], "doc_id long, text string"))


@pytest.mark.parametrize("name", ["lines_with_hints", "referee_prompts"])
def test_form_hints_of_long_customer_numbers(spark, tiny, tmp_path, name):
    customers = spark.read.parquet(f"{tiny}/customer.parquet").limit(4).withColumn("c_custkey", F.get(F.array(*[F.lit(k) for k in (7, 123456, 899999, 4123456)]), F.monotonically_increasing_id().cast("int")).cast("long"))
    agree(spark, tiny, tmp_path, name, customer=customers)


def test_document_hints_have_every_kind(spark, tmp_path):
    spark.createDataFrame([(k, t) for k, t in enumerate(LINES)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.page_id, r.kind, r.matched) for r in catalogue.QUERIES["document_hints"](spark, str(tmp_path)).collect()}
    assert {(0, "CARD", "1059743005344"), (2, "PHONE", "+1 (438) 555-5817"), (4, "AADHAAR", "7642 6360 0241"), (4, "PIN", "560001"), (12, "UPI", "ab@okbank")} <= got


def agree(spark, tiny, at, name, **tables):
    """The query and its SQL give the same rows over these tables."""
    db = duckdb.connect()
    for t in ("documents", "customer", "nation"):
        tables.get(t, spark.read.parquet(f"{tiny}/{t}.parquet")).coalesce(1).write.parquet(f"{at}/{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet/*.parquet')")
    rows = catalogue.QUERIES[name](spark, str(at))
    want = db.execute(f"SELECT {', '.join(rows.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(want) and want


def test_hints_run_each_pattern_once_and_keep_columns(spark):
    rows = spark.createDataFrame([(i, t, "mine", "own") for i, t in enumerate(HINTS)], "id int, text string, _h string, _EMAIL string")
    every = E.with_hints(rows)
    assert every.columns == ["id", "text", "_h", "_EMAIL", "hints"] and {(r._h, r._EMAIL) for r in every.collect()} == {("mine", "own")}
    plan = E.hint_rows(every, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract_all") <= len(E.KINDS) + 1
    # one kind alone gives what it gives among all
    for kind in E.KINDS:
        alone = {r.text: [(h.matched, h.strong) for h in r.hints] for r in E.with_hints(rows, kinds=(kind,)).collect()}
        assert alone == {r.text: [(h.matched, h.strong) for h in r.hints if h.kind == kind] for r in every.collect()}


def test_promotion(spark):
    rows = spark.createDataFrame([("Date of Birth", "12/11/1990"), ("Invoice date", "12/11/1990"), ("Closing Balance", "Rs 10"), ("Total", "Rs 10"), (None, "DOB 12/11/1990"), ("जन्म", "12/11/1990")], "p string, text string")
    out = E.with_hints(rows).select("p", E.has_strong(E.promoted(F.col("hints"), F.col("p"), F.col("text"))).alias("s")).collect()
    assert [r.s for r in out] == [True, False, True, False, True, True]


@pytest.mark.parametrize("line, want", [("Account Holder", True), ("Customer ID:", True), ("Anything here:", True), ("Room 5:", False), ("one two three four five:", False), ("a@b:", False), ("Asha Verma", False), ("नाम", True), ("", False), (None, False)])
def test_captions(spark, line, want):
    assert spark.createDataFrame([(line,)], "t string").select(P.is_caption(F.col("t")).alias("x")).first().x is want


def _fuzzy(a, stems):
    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x):
            new = [i + 1]
            for j, d in enumerate(y):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (c != d)))
            row = new
        return row[-1]

    a = a.strip().lower().strip(".,-")
    for s in stems if a else ():
        if a == s or (len(a) > len(s) and (a.startswith(s) or a.endswith(s) or f" {s}" in a)):
            return True
        if abs(len(a) - len(s)) <= 3 and (lev(a, s) <= max(1, min(len(a), len(s)) // 3) or (len(a) >= 4 and len(s) >= 4 and lev(a[:4], s[:4]) <= 1)):
            return True
    return False


def test_stems(spark):
    words = ["Status", "amount", "hotel", "games", "Disria", "नम", "पिता ", "", "zebra", "c/o", "the house", "warehouse", "housekeeper", "xq", "Sub District", "quarterly report"]
    got = spark.createDataFrame([(w,) for w in words], "t string").select(P.is_sensitive_label(F.col("t")).alias("s"), P.is_address_label(F.col("t")).alias("a")).collect()
    assert [(r.s, r.a) for r in got] == [(_fuzzy(w, V.SENSITIVE_STEMS), _fuzzy(w, V.ADDRESS_STEMS)) for w in words]


def test_public_bodies(spark):
    lines = {"Govemment of India": True, "First National Bank": True, "Asha Verma": False, "Bank 5": False, "Reserve Bank of Indla.": True, "ltd": False, None: False, "City Hospital (North)": True}
    rows = spark.createDataFrame([(t,) for t in lines], "t string").select("t", P.is_public_entity(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == lines


def test_clip_and_trim(spark):
    row = spark.createDataFrame([("\t a\nb  ", "x" * 70)], "a string, b string").select(T.trimmed(F.col("a")).alias("a"), T.clip(F.col("a")).alias("c"), T.clip(F.col("b")).alias("b")).first()
    assert row.a == "a\nb" and row.c == "a b" and row.b == "x" * 63 + "…"
