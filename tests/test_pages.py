"""Pages: order, roles, rules, judge's replies, merging, geometry."""

import random

from pyspark.sql import functions as F

from veilspan.functions import entities as E
from veilspan.functions import geometry as G
from veilspan.operators import cascade, merge, page, reading, rules
from veilspan.plans import catalogue
from veilspan.sources import spans as S

BOX = "page_id long, pos int, text string, l int, t int, r int, b int"


def brute_order(lines):
    """(pos) in reading order, with row numbers."""
    heights = sorted(b - t for _, _, t, _, b in lines)
    tol = max(4, int(heights[len(heights) // 2] * 0.6))
    bands = []
    for p, l, t, r, b in sorted(lines, key=lambda x: (x[2], x[0])):  # noqa: E741
        c = (t + b) // 2
        if bands and abs(c - sum(x[0] for x in bands[-1]) // len(bands[-1])) <= tol:
            bands[-1].append((c, l, t, p))
        else:
            bands.append([(c, l, t, p)])
    return [(p, k + 1) for k, band in enumerate(bands) for _, l, t, p in sorted(band, key=lambda x: x[1:])]


def test_reading_order(spark):
    rng = random.Random(1)
    rows = []
    for pg in range(30):
        for pos in range(rng.randint(1, 25)):
            l, t = rng.choice([40, 300, 520]), rng.randint(0, 300)  # noqa: E741
            rows.append((pg, pos, f"w{pos}", l, t, l + 90, t + rng.randint(10, 40)))
    got = reading.reading_order(spark.createDataFrame(rows, BOX)).orderBy("page_id", "span_id").collect()
    for pg in range(30):
        want = brute_order([(p, l, t, r, b) for g, p, _, l, t, r, b in rows if g == pg])
        assert [(x.pos, x.row_no) for x in got if x.page_id == pg] == want


def decided(spark, lines):
    rows = [(1, k, t, 40, 40 + 32 * k, 40 + 9 * len(t), 62 + 32 * k) for k, t in enumerate(lines)]
    return {r.text: r for r in catalogue.analysed(reading.reading_order(spark.createDataFrame(rows, BOX))).collect()}


def test_rules(spark):
    got = decided(spark, ["Some heading line", "Asha Verma", "PO: Kothrud", "near the big tree", "State: Kerala", "Order total ok", "Name", "Ravi Kumar", "call 1234567"])
    says = {t: (r.det.action, r.det.reason) if r.det else None for t, r in got.items()}
    assert says["Asha Verma"] == ("HIDE", "address block") and says["near the big tree"] == ("HIDE", "address block")
    assert says["PO: Kothrud"] == ("HIDE", "inline field 'PO'")
    assert says["Name"] == ("KEEP", "field label") and says["Ravi Kumar"] == ("HIDE", "neighbour caption: Name")
    assert says["Some heading line"] is None and says["call 1234567"][1].startswith("identifier: phone")
    assert {r.text for r in rules.open_lines(catalogue.analysed(reading.reading_order(spark.createDataFrame([(1, 0, "plain words here", 0, 900, 9, 920)], BOX)))).collect()} == {"plain words here"}


def test_one_address_caption_pulls_nothing(spark):
    got = decided(spark, ["Asha", "Status: paid", "plain words here"])
    assert got["plain words here"].det is None and got["Status: paid"].det.reason == "inline field 'Status'"


def test_roles(spark):
    rows = []
    for k, (a, b) in enumerate([("Name", "Asha"), ("PAN", "ABCDE1234F"), ("Account No", "55"), ("ABCDE1234F:", "x")]):
        rows += [(1, 2 * k, a, 60, 100 + 60 * k, 200, 122 + 60 * k), (1, 2 * k + 1, b, 520, 102 + 60 * k, 600, 124 + 60 * k)]
    spans = E.with_hints(reading.reading_order(spark.createDataFrame(rows, BOX)))
    got = {(r.span_id, r.text): (r.role, r.label_text) for r in reading.with_roles(spans, S.page_sizes(spans)).collect()}
    assert got[1, "Name"] == ("LABEL", None) and got[2, "Asha"] == ("VALUE", "Name") and got[4, "ABCDE1234F"] == ("VALUE", "PAN")
    stacked = E.with_hints(reading.reading_order(spark.createDataFrame([(1, k, "Name", 40, 40 * k, 90, 40 * k + 20) for k in range(8)], BOX)))
    assert {r.role for r in reading.with_roles(stacked, S.page_sizes(stacked)).collect()} == {"STANDALONE"}


def test_merge_precedence(spark):
    d = lambda a: (a, "S", "why") if a else None
    cases = [  # role, override, det, referee, work, degraded, strong -> action, source
        ("LABEL", "HIDE", None, None, None, False, False, "HIDE", "USER"), ("LABEL", None, "HIDE", "HIDE", "HIDE", False, True, "KEEP", "LAYOUT"),
        ("VALUE", None, "HIDE", "KEEP", "KEEP", False, False, "HIDE", "S"), ("VALUE", None, "UNSURE", "KEEP", "HIDE", False, False, "KEEP", "REFEREE"),
        ("VALUE", None, None, "UNSURE", "HIDE", False, False, "HIDE", "WORKHORSE"), ("VALUE", None, None, "UNSURE", "UNSURE", False, True, "UNSURE", "REFEREE"),
        ("VALUE", None, None, None, "UNSURE", False, True, "UNSURE", "WORKHORSE"), ("VALUE", None, None, None, None, False, True, "KEEP", "DEFAULT"),
        ("VALUE", None, None, None, None, True, True, "HIDE", "HEURISTIC"), ("VALUE", None, None, None, None, True, False, "KEEP", "HEURISTIC"),
    ]
    rows = [(k, r, o, d(x), d(y), d(z), g, [("URL", "u", True)] if s else [], a, src) for k, (r, o, x, y, z, g, s, a, src) in enumerate(cases)]
    op = "struct<action:string,source:string,reason:string>"
    df = spark.createDataFrame(rows, f"span_id int, role string, override string, det {op}, referee {op}, work {op}, degraded boolean, hints {E.HINTS}, want string, want_source string")
    assert all((r.action, r.source) == (r.want, r.want_source) for r in merge.merge_decisions(df).collect())


def test_referee_queue_keeps_leak_risks(spark):
    rows = [(1, k, "VALUE", None if k < 10 else "HIDE", [], False) for k in range(14)] + [(2, k, "VALUE", "HIDE", [], k == 3) for k in range(12)] + [(3, 1, "LABEL", None, [], True)]
    df = spark.createDataFrame(rows, f"page_id long, span_id int, role string, work string, hints {E.HINTS}, doubt boolean")
    got = [(r.page_id, r.span_id) for r in cascade.referee_queue(df).orderBy("page_id", "span_id").collect()]
    assert got == [(1, k) for k in range(10)] + [(2, k) for k in range(8)]


def test_judge(spark):
    prompts = spark.createDataFrame([(1, 0, "a"), (1, 1, "bad")], "page_id long, batch_no int, prompt string")

    def model():
        def ask(p):
            if p == "bad":
                raise ValueError(p)
            return p.upper()

        return ask

    assert [r.reply for r in cascade.judge(prompts, model).collect()] == ["A"]


def test_geometry(spark):
    row = spark.createDataFrame([(30.0,)], "a double").select(G.rotation(F.lit(100), F.lit(50), F.col("a")).alias("tr"), G.point(F.lit(10), F.lit(20)).alias("p")).select(
        "p", G.invert(F.col("tr"), G.apply(F.col("tr"), F.col("p"))).alias("q"), G.inflate_quad(G.quad_of(F.lit(0), F.lit(0), F.lit(10), F.lit(4)), F.lit(2)).alias("g"),
        G.inflate_quad(G.quad_of(F.lit(0), F.lit(0), F.lit(0), F.lit(4)), F.lit(2)).alias("flat")).first()
    assert abs(row.q.x - 10) < 1e-9 and abs(row.q.y - 20) < 1e-9
    assert [(p.x, p.y) for p in row.g] == [(-2, -2), (12, -2), (12, 6), (-2, 6)] and row.flat[0].x == 0
    angles = [(370.0, 10.0, 10.0), (-95.0, 85.0, 85.0), (float("nan"), 0.0, 0.0), (175.0, 5.0, -5.0)]
    for a, flat, signed in angles:
        r = spark.createDataFrame([(a,)], "a double").select(G.from_horizontal(F.col("a")).alias("h"), G.signed_deviation(F.col("a")).alias("s")).first()
        assert (r.h, r.s) == (flat, signed)


def test_skew_and_warnings(spark):
    up = [(1, k, "x", 0, 0, 9, 9, 175.0) for k in range(5)] + [(2, k, "x", 0, 0, 9, 9, 1.0) for k in range(5)] + [(3, k, "x", 0, 0, 9, 9, 40.0) for k in range(3)]
    got = {r.page_id: r for r in page.skew(spark.createDataFrame(up, BOX + ", angle double")).collect()}
    assert got[1].median_signed == 175.0 and got[1].correction == -175.0 and got[2].correction == 0 and got[3].correction == 0 and got[3].is_skewed
    w = spark.createDataFrame([(0, 0, 0.0), (1, 0, 0.0), (5, 3, 9.0), (5, 3, 0.0)], "n int, h int, s double").select(page.share_warning(F.col("n"), F.col("h"), F.lit(2000), F.lit(2000), F.col("s")).alias("w")).collect()
    assert [r.w and r.w.reason for r in w] == ["SPARSE_TEXT", "SPARSE_TEXT", "SKEWED", None] and "1 text region was" in w[1].w.message


def test_scores(spark):
    rows = spark.createDataFrame([("HIDE", "HIDE"), ("HIDE", "KEEP"), ("KEEP", "HIDE"), ("KEEP", "KEEP"), ("KEEP", None), ("HIDE", "AMBIG")], "action string, cls string")
    r = page.confusion(rows).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.unmatched, r.precision, r.recall, r.f1, r.over_redaction) == (1, 1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)
    assert page.confusion(rows.limit(0)).first().f1 == 0


def test_stats_and_logs(spark, tmp_path):
    lines = spark.createDataFrame([(0, "I/SomeStats: spans=3 hide=1"), (1, "other")], "n int, value string")
    assert S.read_stats(lines).first().stats == {"spans": "3", "hide": "1"}
    merge.append_runs(lines, str(tmp_path / "runs"))
    merge.append_runs(lines, str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).count() == 4


def test_whole_forms(spark, tiny, monkeypatch):
    """Every line of a form, compared with Python over the decisions of all_decisions."""
    forms = S.form_spans(spark, tiny).where("page_id BETWEEN 1 AND 4").cache()
    monkeypatch.setattr(S, "form_spans", lambda *_: forms)
    sizes = {r.page_id: (r.width, r.height) for r in S.page_sizes(forms).collect()}
    lines = {(r.page_id, r.span_id): r for r in catalogue.ordered_forms(spark, tiny).collect()}
    said = {(r.page_id, r.span_id): r for r in catalogue.QUERIES["all_decisions"](spark, tiny).collect()}
    assert set(said) == set(lines) == {(p, i) for p in sizes for i in range(1, 34)}
    got = lambda name: catalogue.QUERIES[name](spark, tiny).collect()
    hide = {k for k, r in said.items() if r.action == "HIDE"}
    assert {(r.page_id, r.span_id): r.masked for r in got("masked_text")} == {k: "█" * len(r.text) if k in hide else r.text for k, r in lines.items()}
    want = {k: (max(lines[k].l - 3, 0), max(lines[k].t - 3, 0), min(lines[k].r + 3, sizes[k[0]][0]), min(lines[k].b + 3, sizes[k[0]][1])) for k in hide}
    assert {(r.page_id, r.span_id): (r.l, r.t, r.r, r.b) for r in got("redaction_bars")} == want
    n = lambda p, a: sum(k[0] == p and r.action == a for k, r in said.items())
    assert {r.page_id: r.n_hidden for r in got("hidden_spans")} == {p: n(p, "HIDE") for p in sizes if n(p, "HIDE")}
    assert {r.page_id: (r.n_hide, r.n_keep, r.n_unsure) for r in got("action_counts")} == {p: (n(p, "HIDE"), n(p, "KEEP"), n(p, "UNSURE")) for p in sizes}
    flip = lambda k, r: ("KEEP" if r.action == "HIDE" else "HIDE", "USER") if k[1] == 11 else (r.action, r.source)
    assert {(r.page_id, r.span_id): (r.action, r.source) for r in got("toggled_decisions")} == {k: flip(k, r) for k, r in said.items()}
    assert {(r.page_id, r.id): (r.action, r.src, r.x, r.y, r.text) for r in got("span_log")} == {k: (r.action, r.source, lines[k].l, lines[k].t, lines[k].text) for k, r in said.items()}
    hints = [r.page_id for r in E.with_hints(forms).collect() if r.hints]
    assert {r.page_id: r.n_identified for r in got("lines_with_hints")} == {p: hints.count(p) for p in sizes}


def test_replies_reach_their_spans(spark):
    """Local ids become span ids, others go; pages without any decision are degraded; the bar is the reply format's."""
    queue = spark.createDataFrame([(p, s, 0, s - 9) for p in (1, 2) for s in range(10, 20)], "page_id long, span_id int, batch_no int, local_id int")
    said = spark.createDataFrame([(1, 0, 1, i, "HIDE" if i < 10 else "KEEP", "listed") for i in [*range(1, 11), 77]], "page_id long, batch_no int, attempt int, local_id int, action string, reason string")
    assert sorted(r.span_id for r in cascade.by_span(said, queue).collect()) == list(range(10, 20))
    held, doubt = cascade.settle_batches(said, queue, letters=True)
    assert held.count() == 11 and doubt.count() == 0
    held, doubt = cascade.settle_batches(said, queue, letters=False)
    assert held.count() == 0 and sorted(r.span_id for r in doubt.collect()) == list(range(10, 20))
    assert {r.page_id: r.degraded for r in cascade.degraded_pages(queue, cascade.by_span(said, queue)).collect()} == {1: False, 2: True}
    prompts = spark.createDataFrame([(1, 0, 10, "p"), (2, 0, 10, "q")], "page_id long, batch_no int, n long, prompt string")
    first = said.drop("attempt")
    assert cascade.retry_prompts(prompts, first, letters=True).count() == 0
    assert [r.page_id for r in cascade.retry_prompts(prompts, first, letters=False).collect()] == [1]


def test_clipboard_quads_and_images(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "  a b\t"), (1, 2, " \n")], "page_id long, span_id int, text string")
    assert [r.text for r in merge.clipboard(rows, 1, 1).collect()] == ["a b"] and merge.clipboard(rows, 1, 2).count() == 0
    points = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0)], "x0 double, y0 double, x1 double, y1 double").select(F.array(G.point(F.col("x0"), F.col("y0")), G.point(F.col("x1"), F.col("y1"))).alias("two"),
        G.quad_of(F.lit(0), F.lit(0), F.lit(10), F.lit(4)).alias("four"), F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (10, 10), (6, 14), (-4, 4))]).alias("tilted"))
    got = points.select(G.as_quad(F.col("two")).alias("none"), G.quad_angle(F.col("four")).alias("flat"), G.quad_angle(F.col("tilted")).alias("angle"), G.is_slanted(F.col("four")).alias("a"), G.is_slanted(F.col("tilted")).alias("b")).first()
    assert got.none is None and got.flat == 0 and abs(got.angle - 45) < 1e-9 and (got.a, got.b) == (False, True)
    (tmp_path / "x.png").write_bytes(b"abc")
    assert [(r.length, bytes(r.content)) for r in S.read_images(spark, str(tmp_path / "x.png")).collect()] == [(3, b"abc")]
    merge.write_masked(spark.createDataFrame([(1, 1, "ab", "HIDE"), (1, 2, "cd", "KEEP")], "page_id long, span_id int, text string, action string"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["██", "cd"]


def test_catalogue_has_oracles():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) >= 60
