"""Span tables: lines of text with boxes, from the tables at hand, from logs and from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank

#: Pixels of a line, its pitch, and the page.
LINE, PITCH, WIDTH, HEIGHT = 22, 32, 1240, 1754
FORM_TOP, FORM_PITCH, LABEL_X, VALUE_X = 200, 62, 60, 520


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _box(df: DataFrame, left: Column, top: Column) -> DataFrame:
    return df.select("page_id", "pos", "text", left.alias("l"), top.alias("t"), (left + 9 * F.length("text")).alias("r"), (top + LINE).alias("b"))


def line_spans(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(page_id, pos, text, l, t, r, b): each line of each text in one column; blank lines are kept in pos but not as rows."""
    lines = docs.select(F.col(key).cast("long").alias("page_id"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "text"))
    return _box(lines, F.lit(40), 40 + PITCH * F.col("pos")).where(~is_blank(F.col("text")))


def page_sizes(spans: DataFrame) -> DataFrame:
    """(page_id, width, height) of pages of lines."""
    return spans.groupBy("page_id").agg(F.lit(WIDTH).alias("width"), F.greatest(F.lit(HEIGHT), F.max("t") + 2 * PITCH).alias("height"))


def document_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spans(table(spark, sf_dir, "documents"), "doc_id")


def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spans(table(spark, sf_dir, "pages"), "page_id", "html")


def turn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a page, a turn a line."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("page_id"), F.col("turn").cast("int").alias("pos"), "text")
    return _box(turns, F.lit(40), 40 + PITCH * F.col("pos")).where(~is_blank(F.col("text")))


def _padded(c: Column, n: int) -> Column:
    """The last n digits, with zeros before."""
    return F.lpad((c % F.lit(10**n)).cast("string"), n, "0")


def _form(rows: DataFrame, key: Column, fields: list[tuple[str, Column]]) -> DataFrame:
    """Pages of two columns, caption and value, below a heading. The value comes first and sits five pixels lower."""
    box = lambda pos, text, left, top: F.struct(F.lit(pos).alias("pos"), text.cast("string").alias("text"), F.lit(left).alias("l"), F.lit(top).alias("t"))
    spans = [box(0, F.lit("First National Bank Statement"), LABEL_X, 80)]
    for i, (label, value) in enumerate(fields):
        top = FORM_TOP + FORM_PITCH * i
        spans += [box(2 * i + 1, value, VALUE_X, top + 5), box(2 * i + 2, F.lit(label), LABEL_X, top)]
    lines = rows.select(key.cast("long").alias("page_id"), F.explode(F.array(*spans)).alias("s")).select("page_id", "s.pos", "s.text", "s.l", "s.t")
    return _box(lines, F.col("l"), F.col("t"))


def customer_fields(k: Column) -> list[tuple[str, Column]]:
    text = k.cast("string")
    return [
        ("Account Holder", F.col("c_name")), ("Customer ID", text), ("Branch", F.col("n_name")),
        ("Closing Balance", F.concat(F.lit("Rs "), F.col("c_acctbal").cast("decimal(18,2)").cast("string"))),
        ("PAN", F.concat(F.lit("ABCDE"), _padded(k, 4), F.lit("F"))), ("IFSC", F.concat(F.lit("HDFC0"), _padded(k, 6))),
        ("Mobile", F.concat(F.lit("+91 98765 "), _padded(k, 5))),
        ("Date of Birth", F.concat(_padded(k % 28 + 1, 2), F.lit("/"), _padded(k % 12 + 1, 2), F.lit("/"), (1950 + k % 50).cast("string"))),
        ("Email ID", F.concat(F.lit("user"), text, F.lit("@mail.example.com"))), ("UPI", F.concat(F.lit("user"), text, F.lit("@okbank"))),
        ("Account No", F.concat(F.lit("A/c no "), _padded(k, 12))), ("Aadhaar", F.concat(F.lit("2345 6789 "), _padded(k, 4))),
        ("Passport", F.concat(F.lit("K"), _padded(k, 7))), ("Card Number", F.concat(F.lit("XXXX XXXX XXXX "), _padded(k, 4))),
        ("Type", F.col("c_mktsegment")), ("Remarks", F.concat(F.lit("Rs 5 call "), _padded(k * 7919, 7))),
    ]


def form_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement forms, one a customer. The table of nations has a row a nation and joins by broadcast when it is small."""
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return _form(customers, F.col("c_custkey"), customer_fields(F.col("c_custkey").cast("long")))


def supplier_form_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("long")
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return _form(rows, k, [("Name", F.col("s_name")), ("State", F.col("n_name")), ("Balance:", F.concat(F.lit("Rs "), F.col("s_acctbal").cast("decimal(18,2)").cast("string"))),
                           ("Mobile No", F.concat(F.lit("98765"), _padded(k, 5)))])


def address_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters with an address among other lines, one a supplier; every third has one address line only."""
    k = F.col("s_suppkey").cast("long")
    lines = [F.lit("Some heading of the letter 7"), F.col("s_name"), F.lit("Asha Verma"), F.concat(F.lit("PO: "), _padded(k, 3)), F.concat(F.lit("plot "), k.cast("string")),
             F.when(k % 3 == 0, F.lit("Notes: none")).otherwise(F.lit("State: Kerala")), F.lit("Status: paid"), F.lit("Remarks follow here")]
    rows = table(spark, sf_dir, "supplier").select(k.alias("page_id"), F.posexplode(F.array(*lines)).alias("pos", "text"))
    return _box(rows, F.lit(40), 40 + PITCH * F.col("pos"))


_LOG = r"id=(\d+)\s+action=(\w+)\s+src=(\w+)\s+x=(-?\d+)\s+y=(-?\d+)(?:\s+ang=\S+)?\s+text=(.*)$"


def read_span_log(lines: DataFrame, order: str, text: str = "value", key: str | None = None) -> DataFrame:
    """Decisions from log lines (id, action, src, x, y, text); of several passes the last, which starts at its id 1.

    ``order`` gives the lines' order, ``key`` the page. Lines of another form are skipped.
    """
    from pyspark.sql import Window

    keys = [key] if key else []
    part = lambda k: F.regexp_extract(text, _LOG, k)
    rows = lines.where(F.col(text).rlike(_LOG)).select(*keys, order, part(1).cast("int").alias("id"), part(2).alias("action"), part(3).alias("src"), part(4).cast("int").alias("x"),
                                                      part(5).cast("int").alias("y"), F.regexp_replace(part(6), r"\s+$", "").alias("text"))
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_pass", F.count_if(F.col("id") == 1).over(upto))
    return rows.withColumn("_last", F.max("_pass").over(Window.partitionBy(*keys))).where("_pass = _last").drop("_pass", "_last")


def read_stats(lines: DataFrame, text: str = "value") -> DataFrame:
    """key=value pairs of the first statistics line, as a map."""
    body = F.regexp_extract(text, r"\w*Stats\S*\s+(.*)$", 1)
    return lines.where(F.length(body) > 0).select("*", F.str_to_map(body, F.lit(" "), F.lit("=")).alias("stats"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as rows (path, length, content); unreadable ones are skipped."""
    return spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(path).select("path", "length", "content")
