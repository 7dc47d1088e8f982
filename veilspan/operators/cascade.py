"""Batches for a judge, prompts, replies and what becomes of them."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entities import has_strong, kind_label
from ..functions.text import clip, is_blank, trimmed
from . import instructions as I

WORKHORSE_BATCH, REFEREE_BATCH, QUEUE_CAP = 10, 20, 8


def batched(queue: DataFrame, size: int = WORKHORSE_BATCH) -> DataFrame:
    """Adds batch_no (from 0) and local_id (from 1), in order of span_id within the page."""
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("span_id")) - 1
    return queue.withColumn("_n", nth).withColumns({"batch_no": F.floor(F.col("_n") / size).cast("int"), "local_id": (F.col("_n") % size + 1).cast("int")}).drop("_n")


def letter(local_id: Column) -> Column:
    return F.char(F.lit(64) + local_id)


def near_text(previous: Column, following: Column) -> Column:
    """Neighbouring lines, blank ones left out."""
    return F.concat_ws(" | ", F.when(~is_blank(previous), previous), F.when(~is_blank(following), following))


def _in_order(batch: DataFrame, line: Column, *more: Column) -> DataFrame:
    """One row a batch; its lines by local_id. A batch has as many lines as its size at most."""
    return batch.groupBy("page_id", "batch_no").agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("local_id", line.alias("x")))), lambda x: x["x"]), "").alias("body"), *more)


def workhorse_prompts(batches: DataFrame, letters: bool = False) -> DataFrame:
    """(page_id, batch_no, n, prompt). The lines around a batch are those of the page, not of the queue; hints stay out."""
    tag = letter(F.col("local_id")) if letters else F.col("local_id").cast("string")
    line = F.concat(tag, F.lit(": "), clip(F.col("text")), F.lit("\n"))
    rows = _in_order(batches, line, F.min_by("prev_text", "local_id").alias("above"), F.max_by("next_text", "local_id").alias("below"))
    around = lambda name: F.when(F.coalesce(~is_blank(F.col(name)), F.lit(False)), F.concat(F.lit(f"{name}: "), clip(F.col(name)), F.lit("\n"))).otherwise("")
    end = F.lit("\nLetters to hide (or none):") if letters else F.concat(F.lit("\nJSON for ids 1-"), F.col("n").cast("string"), F.lit(" /no_think"))
    return rows.select("page_id", "batch_no", "n", F.concat(around("above"), F.lit("Lines:\n"), F.col("body"), around("below"), end).alias("prompt"))


def referee_prompts(batches: DataFrame, summaries: DataFrame | None = None, letters: bool = False) -> DataFrame:
    """(page_id, batch_no, n, prompt): each line with its tags, and its caption or else its neighbours; summaries (page_id, summary)."""
    tag = letter(F.col("local_id")) if letters else F.col("local_id").cast("string")
    kinds = F.array_distinct(F.transform("hints", lambda h: kind_label(h["kind"])))
    tags = F.when(F.size(kinds) > 0, F.concat(F.lit(" ["), F.array_join(kinds, ","), F.lit("]"))).otherwise("")
    near = near_text(F.col("prev_text"), F.col("next_text"))
    label = F.when(F.coalesce(~is_blank(F.col("label_text")), F.lit(False)), F.concat(F.lit("\n   label: "), clip(F.col("label_text")))).when(
        F.length(near) > 0, F.concat(F.lit("\n   near: "), clip(near))).otherwise("")
    rows = _in_order(batches, F.concat(tag, F.lit(": "), clip(F.col("text")), tags, label, F.lit("\n")))
    rows = rows.join(summaries, "page_id", "left") if summaries is not None else rows.withColumn("summary", F.lit(None).cast("string"))
    head = F.when(F.coalesce(~is_blank(F.col("summary")), F.lit(False)), F.concat(F.lit("Document: "), clip(F.col("summary")), F.lit("\n\n"))).otherwise("")
    end = F.lit("\nLetters to hide (or none):") if letters else F.concat(F.lit("\nJSON for ids 1-"), F.col("n").cast("string"))
    return rows.select("page_id", "batch_no", "n", F.concat(head, F.lit("Lines to judge:\n"), F.col("body"), end).alias("prompt"))


def summary_prompts(spans: DataFrame) -> DataFrame:
    """(page_id, prompt) with the page's ten longest lines."""
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy(F.length("text").desc(), "span_id"))
    top = spans.where(F.length("text") > 3).withColumn("nth", nth).where("nth <= 10")
    lines = top.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", clip(F.col("text")).alias("x")))), lambda x: x["x"]), "\n").alias("x"))
    return lines.select("page_id", F.concat(F.lit("Text:\n"), F.col("x"), F.lit("\n\nDocument type:")).alias("prompt"))


def reply_schema(n: Column, referee: bool = False) -> Column:
    """JSON schema of a reply with as many decisions as the batch has lines; a referee may not be unsure but gives reasons."""
    head = '{"type":"object","properties":{"decisions":{"type":"array","minItems":'
    mid = ',"items":{"type":"object","properties":{"id":{"type":"integer"},"a":{"type":"string","enum":'
    kinds = '["hide","keep"]},"reason":{"type":"string"}}' if referee else '["hide","keep","unsure"]}}'
    return F.concat(F.lit(head), n.cast("string"), F.lit(',"maxItems":'), n.cast("string"), F.lit(mid + kinds + ',"required":["id","a"]}}},"required":["decisions"]}'))


def judge(prompts: DataFrame, model: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(page_id, batch_no, reply): each prompt's reply. ``model`` is called once a task; a prompt on which it fails has no reply. A column
    ``system``, if there is one, goes before the prompt with a blank line between."""
    text = F.concat_ws("\n\n", "system", "prompt") if "system" in prompts.columns else F.col("prompt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = model()
        for b in batches:
            replies = []
            for p in b.column(2).to_pylist():
                try:
                    replies.append(ask(p))
                except Exception:  # one bad batch must not end the page
                    replies.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(replies, pa.string())], ["page_id", "batch_no", "reply"])

    return prompts.select("page_id", "batch_no", text.alias("prompt")).mapInArrow(run, "page_id long, batch_no int, reply string").where("reply IS NOT NULL")


# Words that replies use for each action, and the patterns by which replies are read.
ACTIONS = {
    "HIDE": ["hide", "redact", "sensitive", "private", "mask", "block"],
    "KEEP": ["keep", "show", "safe", "public", "visible", "none"],
    "UNSURE": ["unsure", "unknown", "maybe", "uncertain", "review"],
}
_THINK = r"(?is)<think>.*?</think>"


def to_action(word: Column) -> Column:
    out = None
    for action, words in ACTIONS.items():
        test = F.lower(trimmed(word)).isin(words)
        out = F.when(test, action) if out is None else out.when(test, action)
    return out


def _rank(action: Column) -> Column:
    return F.when(action == "HIDE", 2).when(action == "UNSURE", 1).otherwise(0)


def parse_json_replies(replies: DataFrame, asked: DataFrame, keys: tuple[str, ...] = ("page_id", "batch_no")) -> DataFrame:
    """(keys, local_id, action, reason) from replies in any state; asked has keys and local_id.

    Fences and thoughts go, then every flat object with an id and an action counts, so a list that breaks off still yields its whole
    objects. Ids that weren't asked are dropped; of several decisions on an id the most protective stays, the first on ties.
    """
    fence = r"(?s)```(?:json|JSON)?\s*(.*?)(?:```|$)"
    raw = trimmed(F.col("reply"))
    inner = trimmed(F.regexp_extract(raw, fence, 1))
    body = F.regexp_replace(F.when(F.length(inner) > 0, inner).otherwise(raw), _THINK, "")
    body = F.regexp_replace(body, r"^[^\[{]+(?=[\[{])", "")
    rows = replies.select(*keys, F.posexplode(F.regexp_extract_all(body, F.lit(r"\{[^{}]*\}"), F.lit(0))).alias("seq", "o"))
    number = F.regexp_extract("o", r'(?i)"id"\s*:\s*"?(-?\d+)"?', 1)
    word = F.regexp_extract("o", r'(?i)"(?:a|action|decision|label)"\s*:\s*"([a-zA-Z_]+)"', 1)
    why = F.regexp_extract("o", r'(?i)"(?:reason|why)"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
    why = F.left(trimmed(F.replace(F.replace(why, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit(" "))), F.lit(120))
    rows = rows.select(*keys, "seq", number.try_cast("int").alias("local_id"), to_action(word).alias("action"), F.when(~is_blank(why), why).alias("reason"))
    rows = rows.where("local_id IS NOT NULL AND action IS NOT NULL").join(asked.select(*keys, "local_id").distinct(), [*keys, "local_id"], "left_semi")
    best = F.max_by(F.struct("action", "reason"), F.struct(_rank(F.col("action")), -F.col("seq")))
    return rows.groupBy(*keys, "local_id").agg(best.alias("d")).select(*keys, "local_id", "d.action", "d.reason")


_TAG = r"(?<![A-Za-z])[A-Z](?![A-Za-z])"
_NOTHING = r"(?i)\bnone\b|\bnothing\b|\bno\s+(?:ids?|spans?|lines?)\b"


def parse_hide_lists(replies: DataFrame, asked: DataFrame, keys: tuple[str, ...] = ("page_id", "batch_no")) -> DataFrame:
    """(keys, local_id, action, reason) from replies that list the letters to hide.

    The last line with a capital standing alone is the answer. Without one, or with none that was asked, a word for nothing means that
    all stay, and anything else is no answer. An answer decides every line that was asked.
    """
    body = trimmed(F.regexp_replace(F.regexp_replace(F.col("reply"), _THINK, " "), r"```[a-zA-Z]*", " "))
    lines = F.filter(F.transform(F.split(body, r"\r\n|\n|\r"), trimmed), lambda x: x.rlike(_TAG))
    listed = F.transform(F.regexp_extract_all(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")), F.lit(_TAG), F.lit(0)), lambda c: F.ascii(c) - 64)
    rows = replies.select(*keys, body.alias("body"), listed.alias("listed")).where(F.length("body") > 0)
    ids = asked.groupBy(*keys).agg(F.array_sort(F.collect_set("local_id")).alias("ids"))
    rows = rows.join(ids, list(keys)).withColumn("hidden", F.array_intersect("listed", "ids"))
    rows = rows.where((F.size("hidden") > 0) | F.col("body").rlike(_NOTHING)).select(*keys, "hidden", F.explode("ids").alias("local_id"))
    on = F.array_contains("hidden", F.col("local_id"))
    return rows.select(*keys, "local_id", F.when(on, "HIDE").otherwise("KEEP").alias("action"), F.when(on, "listed").otherwise("not listed").alias("reason"))


def is_collapsed(n: Column, kinds: Column, hides: Column, tenths: int = 8) -> Column:
    """A batch of four or more whose answers are all the same, or mostly HIDE."""
    return (n >= 4) & ((kinds == 1) | (10 * hides >= tenths * n))


#: Share of HIDE, in tenths, from which a batch's answer counts as collapsed: of JSON replies, and of lists of letters, where only answers
#: that are all the same do.
TIGHT, LOOSE = 8, 11


def collapsed_batches(answers: DataFrame, letters: bool = True) -> DataFrame:
    """(page_id, batch_no, attempt, collapsed) of answers (page_id, batch_no, attempt, local_id, action)."""
    shape = answers.groupBy("page_id", "batch_no", "attempt").agg(F.count("*").alias("n"), F.count_distinct("action").alias("k"), F.count_if(F.col("action") == "HIDE").alias("h"))
    return shape.select("page_id", "batch_no", "attempt", is_collapsed(F.col("n"), F.col("k"), F.col("h"), LOOSE if letters else TIGHT).alias("collapsed"))


def retry_prompts(prompts: DataFrame, first: DataFrame, letters: bool = True) -> DataFrame:
    """(page_id, batch_no, n, system, prompt): batches to ask once more, as their first answers (without attempt) are collapsed. Of lists of
    letters the question is turned round; a JSON reply is asked for again as it was."""
    bad = collapsed_batches(first.withColumn("attempt", F.lit(1)), letters).where("collapsed")
    system = F.lit(I.RETRY_LETTERS if letters else I.WORKHORSE)
    return prompts.join(bad, ["page_id", "batch_no"], "left_semi").select("page_id", "batch_no", "n", system.alias("system"), "prompt")


def with_system(prompts: DataFrame, task: str, letters: bool = False) -> DataFrame:
    """Adds system: the instruction of the task (WORKHORSE, REFEREE or SUMMARY) and reply format."""
    return prompts.withColumn("system", F.lit(getattr(I, f"{task}_LETTERS" if letters and task != "SUMMARY" else task)))


def settle_batches(answers: DataFrame, asked: DataFrame, letters: bool = True) -> tuple[DataFrame, DataFrame]:
    """Of answers (page_id, batch_no, attempt, local_id, action, reason): the decisions that hold, and the lines in doubt.

    A batch's first answer holds unless it is collapsed, by the bar of the reply format; then the second holds if there is one and it
    isn't. Lines of batches that were answered and discarded are in doubt.
    """
    shape = collapsed_batches(answers, letters)
    good = shape.where("NOT collapsed").groupBy("page_id", "batch_no").agg(F.min("attempt").alias("attempt"))
    held = answers.join(good, ["page_id", "batch_no", "attempt"], "left_semi")
    doubt = asked.join(shape.select("page_id", "batch_no").distinct(), ["page_id", "batch_no"], "left_semi").join(good.select("page_id", "batch_no"), ["page_id", "batch_no"], "left_anti")
    return held, doubt


def by_span(answers: DataFrame, batches: DataFrame) -> DataFrame:
    """Answers with the span_id that their local_id stands for in the batch; ids that the batch doesn't hold are dropped."""
    return answers.join(batches.select("page_id", "batch_no", "local_id", "span_id"), ["page_id", "batch_no", "local_id"])


def opinions(decisions: DataFrame, name: str, source: str) -> DataFrame:
    """(page_id, span_id, name): a struct (action, source, reason) a decided line, as the merge wants it."""
    return decisions.select("page_id", "span_id", F.struct("action", F.lit(source).alias("source"), "reason").alias(name))


def degraded_pages(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """(page_id, degraded): pages with lines to judge; degraded where not one of them got a decision."""
    some = decisions.select("page_id", F.lit(False).alias("none")).distinct()
    return queue.select("page_id").distinct().join(some, "page_id", "left").select("page_id", F.col("none").isNull().alias("degraded"))


def contested(queue: DataFrame, chosen: DataFrame) -> DataFrame:
    """Lines of the queue that a second opinion should settle (page_id, span_id of :func:`referee_queue`)."""
    return queue.join(chosen, ["page_id", "span_id"], "left_semi")


def summary_line(reply: Column, most: int = 60) -> Column:
    """The first line of a reply, cut; null if it is blank."""
    line = F.left(F.element_at(F.split(trimmed(reply), r"\r\n|\n|\r"), 1), F.lit(most))
    return F.when(~is_blank(line), line)


def doctype_tag(summary: Column, most: int = 40) -> Column:
    """A summary as one word for logs; a dash without one."""
    return F.coalesce(F.left(F.replace(summary, F.lit(" "), F.lit("_")), F.lit(most)), F.lit("-"))


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in ``spark.checkpoint.dir``; a session on one machine without that setting gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='veilspan-')}")
    return df.checkpoint()


def run_cascade(decided: DataFrame, workhorse: Callable, referee: Callable) -> DataFrame:
    """The lines of ``decided`` (with det, hints, role, label_text, neighbours) with work, referee, degraded and doubt, ready to be merged.

    Open lines are batched and judged by lists of letters; a collapsed batch is asked once more; replies become decisions on spans;
    pages without any are degraded. Of the others, contested lines go to the referee. ``workhorse`` and ``referee`` make a judge
    (:func:`judge`). The decided lines, the queue and each model's replies are checkpointed in the shared folder, as several joins read them
    and a model should be asked once.
    """
    decided = kept(decided)
    queue = kept(batched(decided.where(F.col("det").isNull() & ~is_blank(F.col("text")))))
    prompts = workhorse_prompts(queue, letters=True)
    first = parse_hide_lists(kept(judge(with_system(prompts, "WORKHORSE", letters=True), workhorse)), queue)
    again = parse_hide_lists(kept(judge(retry_prompts(prompts, first), workhorse)), queue)
    answers = first.withColumn("attempt", F.lit(1)).unionByName(again.withColumn("attempt", F.lit(2)))
    held, doubt = settle_batches(answers, queue)
    held = kept(by_span(held, queue))
    pages = degraded_pages(queue, held)
    rows = decided.join(opinions(held, "work", "WORKHORSE"), ["page_id", "span_id"], "left").join(pages, "page_id", "left")
    rows = rows.join(doubt.select("page_id", "span_id", F.lit(True).alias("doubt")), ["page_id", "span_id"], "left")
    rows = kept(rows.withColumns({"degraded": F.coalesce("degraded", F.lit(False)), "doubt": F.coalesce("doubt", F.lit(False))}))
    asked = rows.where(F.col("det").isNull() & ~is_blank(F.col("text")) & ~F.col("degraded")).withColumn("work", F.col("work.action"))
    second = kept(batched(contested(asked, referee_queue(asked)), REFEREE_BATCH))
    settled = by_span(parse_hide_lists(judge(with_system(referee_prompts(second, letters=True), "REFEREE", letters=True), referee), second), second)
    return rows.join(opinions(settled, "referee", "REFEREE"), ["page_id", "span_id"], "left")


def referee_queue(spans: DataFrame, cap: int = QUEUE_CAP) -> DataFrame:
    """(page_id, span_id, priority) of lines that a second opinion should settle; needs role, hints, work (action or null) and doubt.

    Undecided lines, kept lines with a strong hint and unsure ones always go; lines in doubt and hidden ones without a hint fill what
    the cap leaves, in the page's order.
    """
    strong = has_strong(F.col("hints"))
    priority = (
        F.when(F.col("role") == "LABEL", F.lit(None)).when(F.col("work").isNull(), 0).when((F.col("work") == "KEEP") & strong, 1).when(F.col("work") == "UNSURE", 2)
        .when(F.col("doubt"), 3).when((F.col("work") == "HIDE") & (F.size("hints") == 0), 4)
    )
    rows = spans.withColumn("priority", priority).where("priority IS NOT NULL")
    page = Window.partitionBy("page_id")
    rows = rows.withColumn("must", F.count_if(F.col("priority") <= 2).over(page))
    nth = F.count_if(F.col("priority") > 2).over(page.orderBy("span_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("nth", nth).where((F.col("priority") <= 2) | (F.col("nth") <= cap - F.col("must"))).select("page_id", "span_id", "priority")
