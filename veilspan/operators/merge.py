"""One decision a line out of every opinion; what is hidden; masked text and bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.entities import kind_label


def merge_decisions(spans: DataFrame) -> DataFrame:
    """Adds action, source and reason. Each line has exactly one decision.

    In order: the user's; a label stays; then rules, referee and workhorse, where an unsure one passes on; on degraded pages a strong
    hint hides and the rest stays; what was only ever unsure stays visible as UNSURE; the rest is KEEP by default. Needs role, hints,
    override (action), det, referee, work (structs action, source, reason; null without) and degraded.
    """
    d = lambda action, source, reason: F.struct(F.lit(action).alias("action") if isinstance(action, str) else action.alias("action"),
                                                F.lit(source).alias("source") if isinstance(source, str) else source.alias("source"),
                                                F.lit(reason).alias("reason") if isinstance(reason, str) else reason.alias("reason"))
    sure = lambda c: F.coalesce(F.col(f"{c}.action") != "UNSURE", F.lit(False))
    strong = F.try_element_at(F.filter("hints", lambda h: h["strong"]), F.lit(1))
    unsure = F.coalesce(F.col("referee.action") == "UNSURE", F.lit(False)) | F.coalesce(F.col("work.action") == "UNSURE", F.lit(False))
    out = (
        F.when(F.col("override").isNotNull(), d(F.col("override"), "USER", "user tap"))
        .when(F.col("role") == "LABEL", d("KEEP", "LAYOUT", "field label"))
        .when(sure("det"), d(F.col("det.action"), F.col("det.source"), F.col("det.reason")))
        .when(sure("referee"), d(F.col("referee.action"), "REFEREE", F.col("referee.reason")))
        .when(sure("work"), d(F.col("work.action"), "WORKHORSE", F.col("work.reason")))
        .when(F.col("degraded") & strong.isNotNull(), d("HIDE", "HEURISTIC", F.concat(F.lit("regex: "), kind_label(strong["kind"]))))
        .when(F.col("degraded"), d("KEEP", "HEURISTIC", "no strong pattern"))
        .when(unsure, d("UNSURE", F.when(F.col("referee").isNotNull(), "REFEREE").otherwise("WORKHORSE"), "unsure -> kept visible"))
        .otherwise(d("KEEP", "DEFAULT", "no decision"))
    )
    return spans.withColumn("_d", out).select(*spans.columns, "_d.action", "_d.source", "_d.reason")


def toggled(merged: DataFrame, taps: DataFrame) -> DataFrame:
    """Merges again after taps (page_id, span_id): a hidden line is kept, any other hidden."""
    rows = merged.join(taps.select("page_id", "span_id", F.lit(True).alias("_tap")), ["page_id", "span_id"], "left")
    rows = rows.withColumn("override", F.when(F.col("_tap"), F.when(F.col("action") == "HIDE", "KEEP").otherwise("HIDE")).otherwise(F.col("override")))
    return merge_decisions(rows.drop("_tap", "action", "source", "reason"))


def hidden(merged: DataFrame) -> DataFrame:
    return merged.where("action = 'HIDE'")


def masked_text(text: Column, action: Column) -> Column:
    return F.when(action == "HIDE", F.repeat(F.lit("█"), F.length(text))).otherwise(text)


def masked_pages(merged: DataFrame) -> DataFrame:
    """(page_id, text): each page's lines in order, the hidden ones as bars of their length."""
    line = F.struct("span_id", masked_text(F.col("text"), F.col("action")).alias("x"))
    return merged.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["x"]), "\n").alias("text"))


def _padding() -> Column:
    return F.greatest(F.lit(3), ((F.col("b") - F.col("t")) * F.lit(0.12)).cast("int"))


def bars(merged: DataFrame, sizes: DataFrame) -> DataFrame:
    """(page_id, span_id, l, t, r, b, radius): boxes over hidden lines, grown by 0.12 of their height (3 at least). Lines with a slanted
    quad, where there is a column of quads, have a path instead (:func:`slanted_bars`)."""
    rows = hidden(merged)
    if "quad" in merged.columns:
        rows = rows.where(~G.is_slanted(F.col("quad")))
    rows = rows.join(sizes, "page_id").withColumn("x", G.inflate(F.col("l"), F.col("t"), F.col("r"), F.col("b"), _padding(), F.col("width"), F.col("height")))
    return rows.select("page_id", "span_id", "x.l", "x.t", "x.r", "x.b", F.round(F.least(F.lit(10.0), (F.col("x.b") - F.col("x.t")) * F.lit(0.12)), 4).alias("radius"))


def slanted_bars(merged: DataFrame) -> DataFrame:
    """(page_id, span_id, path): corners of the bars over hidden lines whose quad is slanted, grown along the quad's own axes."""
    return hidden(merged).where(G.is_slanted(F.col("quad"))).select("page_id", "span_id", G.inflate_quad(F.col("quad"), _padding()).alias("path"))


def hit_test(spans: DataFrame, taps: DataFrame, slop: int = 0) -> DataFrame:
    """(tap_id, page_id, span_id): the smallest line under each tap (tap_id, page_id, x, y), if any; ties go to the first line.
    Taps meet the lines of their page only."""
    far = F.lit(2**31 - 1)
    box = G.inflate(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.lit(slop), far, far)
    rows = taps.join(spans, "page_id").withColumn("_box", box).where(G.contains(F.col("_box"), F.col("x"), F.col("y")))
    return rows.groupBy("tap_id", "page_id").agg(F.min_by("span_id", F.struct(G.area(F.col("l"), F.col("t"), F.col("r"), F.col("b")), F.col("span_id"))).alias("span_id"))


def clipboard(spans: DataFrame, page_id: int, span_id: int) -> DataFrame:
    """The trimmed text of one line; no row if it is blank."""
    from ..functions.text import is_blank, trimmed

    return spans.where((F.col("page_id") == page_id) & (F.col("span_id") == span_id) & ~is_blank(F.col("text"))).select(trimmed(F.col("text")).alias("text"))


def write_masked(merged: DataFrame, path: str) -> None:
    """Masked pages as one text file a page group; writing again replaces."""
    masked_pages(merged).select("text").write.mode("overwrite").text(path)


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def span_log(merged: DataFrame) -> DataFrame:
    """A line of log for each decision, as :func:`sources.spans.read_span_log` reads it."""
    line = F.format_string("id=%d action=%s src=%s x=%d y=%d ang=%.1f text=%s", "span_id", "action", "source", "l", "t", F.lit(0.0), "text")
    return merged.select("page_id", "span_id", line.alias("value"))
