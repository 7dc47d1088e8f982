"""Decisions without a model: an ordered list of rules, then the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.entities import certain_identifier, gate_identifier, kind_label
from ..functions.predicates import inline_field, is_address_label, is_caption, is_header, is_name_like, is_private_caption, is_public_entity, is_sensitive_label, sensitive_neighbour
from ..functions.text import is_blank, trimmed


def with_address_block(spans: DataFrame, order: str = "span_id") -> DataFrame:
    """Adds in_address: from the first to the last of two or more address fields of a page, and a name just above."""
    page = Window.partitionBy("page_id")
    field = inline_field(F.col("text"))
    rows = spans.withColumn("_anchor", F.coalesce(is_address_label(field["label"]), F.lit(False)))
    at = F.when(F.col("_anchor"), F.col(order))
    rows = rows.withColumns({"_n": F.count(at).over(page), "_lo": F.min(at).over(page), "_hi": F.max(at).over(page)})
    inside = F.col(order).between(F.col("_lo"), F.col("_hi")) | ((F.col(order) == F.col("_lo") - 1) & is_name_like(F.col("text")))
    return rows.withColumn("in_address", F.coalesce((F.col("_n") >= 2) & inside, F.lit(False))).drop("_anchor", "_n", "_lo", "_hi")


def _verdict(gate: str, action: str, confidence: int, reason) -> Column:
    return F.struct(F.lit(gate).alias("gate"), F.lit(action).alias("action"), F.lit(confidence).alias("confidence"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))


def gate(spans: DataFrame) -> DataFrame:
    """Adds verdict (gate, action, confidence, reason): an identifier, a public body, a caption, a private field or a neighbour's
    caption, whichever comes first; needs hints, role and the neighbours."""
    text = F.col("text")
    rows = spans.withColumns({"_id": gate_identifier(F.col("hints")), "_field": inline_field(text), "_near": sensitive_neighbour(text, F.col("prev_text"), F.col("next_text"))})
    pair = F.col("role") != "LABEL"
    verdict = (
        F.when(is_blank(text), _verdict("NONE", "UNSURE", 0, "no gate fired"))
        .when(F.col("_id").isNotNull(), _verdict("IDENTIFIER", "HIDE", 99, F.concat(F.lit("identifier: "), kind_label(F.col("_id.kind")), F.lit(" = "), F.col("_id.matched"))))
        .when(is_public_entity(text), _verdict("PUBLIC_ENTITY", "KEEP", 96, "issuer or institution"))
        .when(is_caption(text, V.GATE_CAPTIONS), _verdict("LABEL", "KEEP", 95, "field label"))
        .when(pair & F.coalesce(is_sensitive_label(F.col("_field.label")), F.lit(False)), _verdict("CAPTION_PAIR", "HIDE", 90, F.concat(F.lit("inline '"), F.col("_field.label"), F.lit("' → value"))))
        .when(pair & F.col("_near").isNotNull(), _verdict("CAPTION_PAIR", "HIDE", 88, F.concat(F.lit("neighbour caption: "), F.col("_near"))))
        .otherwise(_verdict("NONE", "UNSURE", 0, "no gate fired"))
    )
    return rows.withColumn("verdict", verdict).drop("_id", "_field", "_near")


def _decision(action: str, source: str, reason) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(source).alias("source"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))


def decide(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """(all columns, det): det (action, source, reason) of lines that rules settle, else null. Needs hints, role, label_text and
    the neighbours; windows share the page's partitioning."""
    text = F.col("text")
    rows = gate(with_address_block(spans)).join(sizes.select("page_id", F.col("height").alias("_height")), "page_id")
    rows = rows.withColumns({"_kind": certain_identifier(text, F.col("hints")), "_field": inline_field(text)})
    by_gate = F.when(F.col("verdict.action") == "KEEP", _decision("KEEP", "LAYOUT", F.col("verdict.reason"))).when(
        F.col("verdict.action") == "HIDE", _decision("HIDE", "DETERMINISTIC", F.col("verdict.reason")))
    det = (
        F.when(is_blank(text), F.lit(None))
        .when(F.col("role") == "LABEL", _decision("KEEP", "LAYOUT", "field label"))
        .when(F.col("_kind").isNotNull(), _decision("HIDE", "DETERMINISTIC", F.concat(F.lit("regex: "), kind_label(F.col("_kind")))))
        .when(F.coalesce(is_sensitive_label(F.col("_field.label")), F.lit(False)), _decision("HIDE", "DETERMINISTIC", F.concat(F.lit("inline field '"), F.col("_field.label"), F.lit("'"))))
        .when(F.col("in_address"), _decision("HIDE", "DETERMINISTIC", "address block"))
        .when((F.col("role") == "VALUE") & is_private_caption(F.col("label_text")), _decision("HIDE", "DETERMINISTIC", F.concat(F.lit("value of '"), trimmed(F.col("label_text")), F.lit("'"))))
        .when(is_header(text, F.col("role"), F.col("t"), F.col("_height"), F.col("hints")), _decision("KEEP", "DETERMINISTIC", "document header"))
        .otherwise(by_gate)
    )
    return rows.withColumn("det", det).drop("_height", "_kind", "_field")


def open_lines(decided: DataFrame) -> DataFrame:
    """Lines that no rule settled: the model's queue."""
    return decided.where(F.col("det").isNull() & ~is_blank(F.col("text")))


