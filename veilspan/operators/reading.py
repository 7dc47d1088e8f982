"""Reading order, and roles of two-column forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entities import has_strong
from ..functions.predicates import caption, is_caption


def upper_median(values: Column) -> Column:
    """The middle of the sorted values, the upper one of two."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def reading_order(spans: DataFrame) -> DataFrame:
    """Adds row_no and span_id, both from 1.

    In order of their tops, a line joins the last row if its centre is within the tolerance (0.6 of the upper median height, 4 at
    least) of the mean of the row's centres, and else starts a new one; rows are read from the left. The fold needs a page's lines
    together and in order, so a page is one array; pages are dealt over all tasks. Ties keep ``pos``.
    """
    cols = [c for c in spans.columns if c not in ("page_id", "row_no", "span_id")]
    item = F.struct(F.col("t").alias("_t"), F.col("pos").alias("_p"), *cols)
    pages = spans.groupBy("page_id").agg(F.sort_array(F.collect_list(item)).alias("s"))
    middle = upper_median(F.transform("s", lambda x: x["b"] - x["t"]))
    pages = pages.withColumn("_tol", F.greatest(F.lit(4), (middle * F.lit(0.6)).cast("int")))
    centres = F.transform("s", lambda x: F.floor((x["t"] + x["b"]) / 2).cast("int"))
    start = F.struct(F.lit(0).alias("row"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("rows"))

    def step(a: Column, c: Column) -> Column:
        mean = F.when(a["n"] > 0, (a["sum"] / F.greatest(a["n"], F.lit(1))).cast("long"))
        same = F.coalesce(F.abs(c - mean) <= F.col("_tol"), F.lit(False))
        row = F.when(same, a["row"]).otherwise(a["row"] + 1)
        return F.struct(row.alias("row"), F.when(same, a["n"] + 1).otherwise(F.lit(1)).alias("n"), F.when(same, a["sum"] + c).otherwise(c.cast("long")).alias("sum"),
                        F.concat(a["rows"], F.array(row)).alias("rows"))

    rows = F.aggregate(centres, start, step, lambda a: a["rows"])
    placed = F.transform(F.arrays_zip(rows.alias("row"), F.col("s").alias("s")), lambda z: F.struct(z["row"].alias("row_no"), z["s"]["l"].alias("_l"), z["s"]["_t"].alias("_t"), z["s"]["_p"].alias("_p"), z["s"].alias("s")))
    out = pages.select("page_id", F.posexplode(F.sort_array(placed)).alias("_i", "z"))
    return out.select("page_id", (F.col("_i") + 1).alias("span_id"), F.col("z.row_no").alias("row_no"), *[F.col(f"z.s.{c}").alias(c) for c in cols])


def label_columns(ordered: DataFrame, sizes: DataFrame) -> DataFrame:
    """(page_id, label_x, tolerance, gap) of pages whose captions stand in one column.

    At least six lines, three rows of several and three leading captions; the column is the upper median of the largest set of
    leading edges within the tolerance, the first on ties.
    """
    row = Window.partitionBy("page_id", "row_no")
    lead = ordered.withColumn("n_row", F.count("*").over(row)).withColumn("first", F.min("span_id").over(row)).join(sizes, "page_id")
    width = F.col("width")
    page = lead.groupBy("page_id").agg(
        F.count("*").alias("n"), F.count_if((F.col("span_id") == F.col("first")) & (F.col("n_row") >= 2)).alias("multi"), F.first("width").alias("width"),
        F.sort_array(F.collect_list(F.when((F.col("span_id") == F.col("first")) & (F.col("n_row") >= 2) & is_caption(F.col("text")), F.struct("span_id", "l")))).alias("edges"),
    ).where((F.col("n") >= 6) & (width > 0) & (F.col("multi") >= 3) & (F.size("edges") >= 3))
    page = page.withColumn("tolerance", F.greatest(F.lit(6), (width * F.lit(0.035)).cast("int"))).withColumn("gap", F.greatest(F.lit(10), (width * F.lit(0.04)).cast("int")))
    sets = F.transform("edges", lambda e, i: F.struct(
        F.size(F.filter("edges", lambda o: F.abs(o["l"] - e["l"]) <= F.col("tolerance"))).alias("n"), (-i).alias("i"),
        upper_median(F.transform(F.filter("edges", lambda o: F.abs(o["l"] - e["l"]) <= F.col("tolerance")), lambda o: o["l"])).alias("x")))
    best = page.withColumn("best", F.array_max(sets)).where("best.n >= 3")
    return best.select("page_id", F.col("best.x").alias("label_x"), "tolerance", "gap")


def with_roles(ordered: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds role (LABEL, VALUE, STANDALONE) and label_text; needs ``hints``.

    A row's first line is a label if it stands in the label column, a gap follows and it reads like a caption; the rest of the row
    are its values. A line with a strong hint is never a label.
    """
    row = Window.partitionBy("page_id", "row_no").orderBy("span_id")
    rows = ordered.join(label_columns(ordered, sizes), "page_id", "left")
    rows = rows.withColumns({"_nth": F.row_number().over(row), "_next": F.lead("l").over(row)})
    head = (F.col("_nth") == 1) & (F.abs(F.col("l") - F.col("label_x")) <= F.col("tolerance")) & (F.col("_next") - F.col("r") >= F.col("gap")) & is_caption(F.col("text"))
    rows = rows.withColumn("_head", F.coalesce(head, F.lit(False)))
    label = F.max(F.when(F.col("_head"), caption(F.col("text")))).over(Window.partitionBy("page_id", "row_no"))
    rows = rows.withColumn("_label", label)
    role = F.when(F.col("_label").isNull(), "STANDALONE").when(F.col("_nth") > 1, "VALUE").when(has_strong(F.col("hints")), "STANDALONE").otherwise("LABEL")
    return rows.withColumn("role", role).withColumn("label_text", F.when((F.col("role") == "VALUE"), F.col("_label"))).drop("_nth", "_next", "_head", "_label", "label_x", "tolerance", "gap")


def with_neighbours(ordered: DataFrame) -> DataFrame:
    """Adds the texts of the line before and after on the page."""
    page = Window.partitionBy("page_id").orderBy("span_id")
    return ordered.withColumns({"prev_text": F.lag("text").over(page), "next_text": F.lead("text").over(page)})
