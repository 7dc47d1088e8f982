"""What pages come to: counts, skew, budget, warnings, receipts, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .reading import upper_median


def page_stats(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """(page_id, n_spans, median_height, n_chars, density): lines, the upper median of heights, characters that aren't space, and
    lines a million pixels."""
    rows = spans.groupBy("page_id").agg(
        F.count("*").alias("n_spans"), upper_median(F.collect_list(F.col("b") - F.col("t"))).alias("median_height"),
        F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("n_chars"))
    return rows.join(sizes, "page_id").withColumn("density", F.round(F.col("n_spans") / (F.col("width") * F.col("height") / F.lit(1e6)), 6))


def action_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("page_id").agg(*[F.count_if(F.col("action") == a).alias(f"n_{a.lower()}") for a in ("HIDE", "KEEP", "UNSURE")])


def skew(spans: DataFrame) -> DataFrame:
    """(page_id, n, median_abs, median_signed, correction, is_skewed); needs angle.

    Upper medians of the deviation from horizontal and of the signed one; the latter is turned over if at least 0.7 of the finite angles
    are nearer to it upside down. Pages of four lines or more that are 2 degrees or more off are turned back by it.
    """
    rows = spans.groupBy("page_id").agg(
        F.count("*").alias("n"), upper_median(F.collect_list(G.from_horizontal(F.col("angle")))).alias("median_abs"),
        upper_median(F.collect_list(G.signed_deviation(F.col("angle")))).alias("folded"), F.collect_list("angle").alias("angles"))
    finite = F.filter("angles", lambda a: ~F.isnan(a) & (F.abs(a) < float("inf")))
    flipped = G.normalized(F.col("folded") + 180)
    rows = rows.withColumns({"_ok": finite, "_flip": flipped})
    votes = F.size(F.filter("_ok", lambda a: G.circular_distance(G.normalized(a), F.col("_flip")) < G.circular_distance(G.normalized(a), F.col("folded"))))
    signed = F.when((F.size("_ok") > 0) & (votes / F.nullif(F.size("_ok"), F.lit(0)) >= 0.7), F.col("_flip")).otherwise(F.col("folded"))
    rows = rows.withColumn("median_signed", signed)
    fix = F.when((F.col("n") >= 4) & (F.abs("median_signed") >= 2), G.normalized(-F.col("median_signed"))).otherwise(F.lit(0.0))
    return rows.select("page_id", "n", *[F.round(c, 4).alias(c) for c in ("median_abs", "median_signed")], F.round(fix, 4).alias("correction"), (F.col("median_abs") >= 8).alias("is_skewed"))


def accepts_turn(had: Column, got: Column, was_high: Column, high: Column, n_after: Column) -> Column:
    """Whether a second reading of a turned page is the better one: few characters lost (2 to 10 percent, by how much lower the lines
    became) and either more text or lines lower by 0.15."""
    gain = F.when(was_high > 0, 1 - high / F.nullif(was_high, F.lit(0))).otherwise(F.lit(0.0))
    share = F.lit(0.02) + F.lit(0.08) * F.least(F.greatest(gain, F.lit(0.0)), F.lit(1.0))
    loss = F.greatest(F.lit(2), (had * share).cast("int"))
    return (n_after > 0) & (got >= had - loss) & ((got > had) | (gain >= F.lit(0.15)))


def map_back(spans: DataFrame, transforms: DataFrame) -> DataFrame:
    """Lines of a turned page on the page as it was: quads through the inverse of ``tr`` and their hulls as boxes."""
    quad = F.transform(G.quad_of(F.col("l"), F.col("t"), F.col("r"), F.col("b")), lambda p: G.invert(F.col("tr"), p))
    rows = spans.join(transforms, "page_id").withColumn("quad", quad).withColumn("_h", G.hull(F.col("quad")))
    return rows.withColumns({c: F.col(f"_h.{c}") for c in "ltrb"}).drop("_h", "tr")


def referee_skip(n: Column, median_height: Column, height: Column, refine: Column) -> Column:
    """Why a page gets no second opinion, or null: not asked for, over 100 lines, or 40 lines of small print (under 0.010 of the page)."""
    ratio = median_height / F.nullif(height, F.lit(0))
    return (
        F.when(~refine, "interactive budget").when(n > 100, F.concat(F.lit("dense page: "), n.cast("string"), F.lit(" spans > 100")))
        .when((n >= 40) & (height > 0) & (ratio < 0.010), F.concat(F.lit("small print: median line "), median_height.cast("string"), F.lit("px"))))


def share_warning(n: Column, hides: Column, width: Column, height: Column, median_skew: Column) -> Column:
    """Struct (reason, message) before an export, or null: skewed pages first, then large pages with little text and nothing hidden."""
    pixels = width * height / F.lit(1e6)
    found = F.when(n == 1, F.lit("1 text region was")).otherwise(F.concat(n.cast("string"), F.lit(" text regions were")))
    skewed = F.concat(F.lit("The page is tilted by about "), median_skew.cast("int").cast("string"), F.lit("°; tilted lines are easily missed, so check the bars or take the picture again."))
    sparse = F.when(n == 0, F.lit("No line of text was found, so no bar was drawn.")).otherwise(F.concat(F.lit("Only "), found, F.lit(" found and no bar was drawn; look whether more can be read.")))
    w = lambda reason, message: F.struct(F.lit(reason).alias("reason"), message.alias("message"))
    return F.when(median_skew >= 8, w("SKEWED", skewed)).when((hides == 0) & (pixels >= 0.3) & (n / F.nullif(pixels, F.lit(0.0)) < 4), w("SPARSE_TEXT", sparse))


SILICON = ["CPU", "NPU", "GPU"]


def receipts(stages: DataFrame) -> DataFrame:
    """(page_id, receipt, chip) of stages (page_id, seq, silicon, task, status, span_count, elapsed_ms): what ran on which silicon."""
    what = F.concat(F.col("task"), F.when(F.col("status") == "OK", F.concat(F.lit(" "), F.col("span_count").cast("string"))).when(F.col("status") == "SKIPPED", " skip").otherwise(" fail"))
    place = F.array_position(F.array(*[F.lit(s) for s in SILICON]), F.col("silicon"))
    by = stages.groupBy("page_id", "silicon").agg(
        F.first(place).alias("place"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", what.alias("x")))), lambda x: x["x"]), " · ").alias("what"),
        F.sum("elapsed_ms").alias("ms"), F.sum(F.when(F.col("status") == "OK", F.col("span_count"))).alias("spans"))
    group = F.struct("place", F.concat("silicon", F.lit("·"), "what").alias("x"), F.when(F.col("spans").isNotNull(), F.concat("silicon", F.lit(" "), F.col("spans").cast("string"))).alias("c"))
    out = by.groupBy("page_id").agg(F.sort_array(F.collect_list(group)).alias("g"), F.sum("ms").alias("ms"))
    total = F.concat(F.lit("total "), F.format_string("%.1fs", F.col("ms") / 1000))
    return out.select("page_id", F.array_join(F.concat(F.transform("g", lambda x: x["x"]), F.array(total)), " | ").alias("receipt"), F.array_join(F.transform("g", lambda x: x["c"]), " · ").alias("chip"))


def loaded_backends(stats: DataFrame) -> DataFrame:
    """(page_id, backends): distinct backends that loaded, in order, joined by +."""
    ok = stats.where(~F.col("backend").isin("", "unloaded", "failed", "none"))
    names = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("seq", "backend"))), lambda x: x["backend"]))
    return ok.groupBy("page_id").agg(F.array_join(names, "+").alias("backends"))


def truth_match(spans: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds cls: the truth's class of each line, or null; truth has page_id, text and cls in a stated order (seq).

    Equal after folding case and space; else the longest key of four characters or more that holds the line or is held by it. Lines
    meet the truth of their page only.
    """
    from ..functions.text import squeezed

    keys = truth.select("page_id", squeezed(F.col("text")).alias("_key"), "cls", "seq")
    rows = spans.withColumn("_n", squeezed(F.col("text")))
    both = rows.select("page_id", "span_id", "_n").where(F.length("_n") > 0).join(keys, "page_id")
    exact = F.col("_n") == F.col("_key")
    near = (F.length("_key") >= 4) & (F.contains("_n", F.col("_key")) | F.contains("_key", F.col("_n")))
    best = both.where(exact | near).groupBy("page_id", "span_id").agg(F.max_by("cls", F.struct(exact, F.length("_key"), F.when(exact, F.col("seq")).otherwise(-F.col("seq")))).alias("cls"))
    return rows.drop("_n").join(best, ["page_id", "span_id"], "left")


def confusion(scored: DataFrame) -> DataFrame:
    """One row: counts, precision, recall, F1 and over-redaction of lines with a class; ambiguous and unmatched ones don't count."""
    hid, must = F.col("action") == "HIDE", F.col("cls") == "HIDE"
    rows = scored.agg(F.count_if(must & hid).alias("tp"), F.count_if((F.col("cls") == "KEEP") & hid).alias("fp"), F.count_if(must & ~hid).alias("fn"),
                      F.count_if((F.col("cls") == "KEEP") & ~hid).alias("tn"), F.count_if(F.col("cls").isNull()).alias("unmatched"))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    rows = rows.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn")), "over_redaction": share(F.col("fp"), F.col("fp") + F.col("tn"))})
    rows = rows.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return rows.select("tp", "fp", "fn", "tn", "unmatched", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "over_redaction")])


def stage_reports(pages: DataFrame) -> DataFrame:
    """(page_id, seq, silicon, task, status, span_count, elapsed_ms, note): the reports of a page's stages in order.

    Pages have n_det, queue, npu_reason, degraded, n_work, work_ms, skip, n_referee and referee_ms. The classifier's slot never decides
    anything and says so. A page without open lines ends there; one whose judge gave nothing has a failed stage and no more.
    """
    r = lambda silicon, task, status, n, ms, note: F.struct(F.lit(silicon).alias("silicon"), F.lit(task).alias("task"), F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"),
                                                            n.cast("long").alias("span_count"), ms.cast("long").alias("elapsed_ms"), note.cast("string").alias("note"))
    zero, no = F.lit(0), F.lit(None)
    left = F.concat(F.col("queue").cast("string"), F.lit(" left for the models"))
    cpu = r("CPU", "det", "OK", F.col("n_det"), zero, left)
    npu = r("NPU", "classifier", "SKIPPED", zero, zero, F.col("npu_reason"))
    failed = r("GPU", "workhorse", "FAILED", zero, zero, F.lit("no reply"))
    work = r("GPU", "workhorse", "OK", F.col("n_work"), F.col("work_ms"), no)
    ran = F.col("skip").isNull() & (F.col("n_referee") > 0)
    second = F.when(ran, r("GPU", "referee", "OK", F.col("n_referee"), F.col("referee_ms"), no)).otherwise(r("GPU", "referee", "SKIPPED", zero, zero, F.coalesce("skip", F.lit("nothing contested"))))
    stages = F.when(F.col("queue") == 0, F.array(cpu, npu)).when(F.col("degraded"), F.array(cpu, npu, failed)).otherwise(F.array(cpu, npu, work, second))
    return pages.select("page_id", F.posexplode(stages).alias("seq", "x")).select("page_id", "seq", "x.*")


def paired_runs(runs: DataFrame, first: str = "full", second: str = "workhorse") -> DataFrame:
    """(case_id, hides, hides_other, delta, total_ms, total_ms_other) of cases that ran in both modes; runs have case_id, mode, hide_count,
    total_ms, one row a case and mode. The join is on the case, so its size is that of the runs."""
    own = lambda mode, tail: runs.where(F.col("mode") == mode).select("case_id", F.col("hide_count").alias(f"hides{tail}"), F.col("total_ms").alias(f"total_ms{tail}"))
    return own(first, "").join(own(second, "_other"), "case_id").select("case_id", "hides", "hides_other", (F.col("hides") - F.col("hides_other")).alias("delta"), "total_ms", "total_ms_other")


def pair_medians(pairs: DataFrame, bugs: DataFrame) -> DataFrame:
    """One row: pairs, true medians of hides and times by mode, and cases with a hidden label, by mode; bugs have case_id, mode and label_hidden."""
    bad = lambda mode: F.coalesce(F.max(F.col("label_hidden") & (F.col("mode") == mode)), F.lit(False))
    rows = pairs.join(bugs.groupBy("case_id").agg(bad("full").alias("bad"), bad("workhorse").alias("bad_other")), "case_id", "left")
    medians = [F.median(c).alias(f"median_{c}") for c in ("hides", "hides_other", "total_ms", "total_ms_other")]
    return rows.agg(F.count("*").alias("n"), *medians, F.count_if("bad").alias("label_cases"), F.count_if("bad_other").alias("label_cases_other"))


def timing_bands(timings: DataFrame) -> DataFrame:
    """(doc_type, n, median_ms, min_ms, max_ms): the true median and range of total_ms; partial aggregates a type."""
    return timings.groupBy("doc_type").agg(F.count("*").alias("n"), F.median("total_ms").alias("median_ms"), F.min("total_ms").alias("min_ms"), F.max("total_ms").alias("max_ms"))


#: The statistics of a page, in the order of the line.
STATS = ["spans", "ocr_ms", "wall_ms", "deskew", "cpu_det", "llm_spans", "median_h", "workhorse_ms", "summary_ms", "referee_ms", "total_ms", "hide", "keep", "unsure",
         "referee_queue", "backend", "referee_skip", "degraded", "doctype"]


def stats_line(merged: DataFrame, runs: DataFrame) -> DataFrame:
    """(page_id, value): the page's statistics (STATS) as key=value; runs have a row a page with what isn't counted from its lines: ocr_ms,
    wall_ms, deskew, llm_spans, workhorse_ms, summary_ms, referee_ms, backend, referee_skip and doctype, null where a stage didn't run."""
    rows = merged.groupBy("page_id").agg(
        F.count("*").alias("spans"), F.count_if(F.col("det").isNotNull()).alias("cpu_det"), upper_median(F.collect_list(F.col("b") - F.col("t"))).alias("median_h"),
        *[F.count_if(F.col("action") == a).alias(a.lower()) for a in ("HIDE", "KEEP", "UNSURE")], F.count_if(F.col("referee").isNotNull()).alias("referee_queue"), F.max("degraded").alias("degraded"))
    ms = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = rows.join(runs, "page_id", "left").withColumns({
        **{c: ms(c) for c in ("ocr_ms", "llm_spans", "workhorse_ms", "summary_ms", "referee_ms")}, "wall_ms": F.coalesce("wall_ms", F.lit(-1)),
        "deskew": F.format_string("%.1f", F.coalesce(F.col("deskew").cast("double"), F.lit(0.0))), "backend": F.coalesce("backend", F.lit("none")),
        "referee_skip": F.coalesce(F.substring_index("referee_skip", ":", 1), F.lit("-")), "doctype": F.coalesce("doctype", F.lit("-"))})
    rows = rows.withColumn("total_ms", F.col("workhorse_ms") + F.col("summary_ms") + F.col("referee_ms"))
    return rows.select("page_id", F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in STATS]).alias("value"))
