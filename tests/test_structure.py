"""Fixtures of the reference's behaviour, and windows against loops in plain Python."""

import random
import re
import time

from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import jobs as J
from docweave.operators import pages as PG
from docweave.operators import quality as Q
from docweave.operators import structure as S
from docweave.operators import tables as TB
from docweave.operators.config import EngineConfig
from docweave.sinks import docx as DX
from docweave.sources import tables as SRC


MARKS = ["1. ", "2、", "(3) ", "①", "• ", "▪", "plugin_a: ", "plugin_b： ", "一、", "2.4 ", "max ", "∑", "", "", "", "", "", ""]
WORDS = ["alpha", "Beta", "x = 2", "九月", "10", "(note)", "≤", "gamma-"]
ENDS = ["", "", "", ".", "。", ":", "：", ";", "!", "？"]


def made_lines(n):
    """Lines of all kinds, with blank ones and blanks around some."""
    out = []
    for _ in range(n):
        line = random.choice(MARKS) + " ".join(random.choices(WORDS, k=random.randrange(1, 4))) + random.choice(ENDS)
        out.append(random.choice(["", "  "]) + line + random.choice(["", " "]) if random.random() < 0.9 else random.choice(["", "  "]))
    return out


def blank_between(left, right):
    a, b = left[-1], right[0]
    plain = lambda c: c.isascii() and c.isalnum()
    return a in "-+=*/≤≥≈" or (plain(a) and plain(b))


def loop_blocks(rows):
    """(role, text) of the blocks of (role, line), by a loop with what is open."""
    out, kind = [], None
    for role, line in rows:
        line = line.strip()
        if not line:
            continue
        ends, colon = line[-1] in "。！？!?；;：:.", line[-1] in "：:"
        if role == "body" and kind is not None:
            out[-1][1] += (" " if blank_between(out[-1][1], line) else "") + line
        else:
            out.append([role, line])
            kind = None if role in ("title", "heading1", "heading2", "formula") else role
        if kind == "body" and ends or kind not in ("body", None) and ends and not colon:
            kind = None
    return [(role, text) for role, text in out]


def test_blocks_match_a_loop(spark):
    """Blocks and their texts before marks are taken off, of random roles and lines."""
    random.seed(6)
    roles = ["title", "heading1", "heading2", "formula", "ordered", "bullet", "plugin", "body", "body", "body", "body"]
    rows = [(d, i, line, random.choice(roles)) for d in range(80) for i, line in enumerate(made_lines(25))]
    grouped = S.block_ids(spark.createDataFrame(rows, "d long, i long, text string, role string"), ["d"], "i")
    got = {}
    for r in S.block_texts(grouped.withColumn("role", F.concat(F.lit("_"), "role")), ["d"], "i").orderBy("d", "block_id").collect():
        got.setdefault(r["d"], []).append((r["role"][1:], r["text"]))
    for d in range(80):
        want = loop_blocks([(role, text) for k, _, text, role in rows if k == d])
        assert [x for x, _ in got.get(d, [])] == [x for x, _ in want] and [re.sub(r"\s", "", t) for _, t in got.get(d, [])] == [re.sub(r"\s", "", t) for _, t in want]


def test_roles_and_marks(spark):
    """Each kind of line with a text of its own, and what is left of it without its mark."""
    cases = [
        ("7. seven", "ordered", "seven"), ("8、acht", "ordered", "acht"), ("（12） twelve", "ordered", "twelve"), ("③drei", "ordered", "drei"), ("3.5 thirds", "heading2", "3.5 thirds"),
        ("◦ circle", "bullet", "circle"), ("plugin_q9 : nine", "plugin", "plugin_q9：nine"), ("十一、十一月", "heading1", "十一、十一月"), ("摘要", "heading1", "摘要"),
        ("min f(y)", "formula", "min f(y)"), ("∫ g", "formula", "∫ g"), ("y₁ ≥ 4", "formula", "y₁ ≥ 4"), ("plain words", "body", "plain words"),
    ]
    rows = spark.createDataFrame([(k, 0, t) for k, (t, _, _) in enumerate(cases)], "d long, i long, text string").withColumn("role", S.text_role(F.col("text"), F.lit(False)))
    got = {r["d"]: (r["role"], r["text"]) for r in S.block_texts(S.block_ids(rows, ["d"], "i"), ["d"], "i").collect()}
    assert got == {k: (role, text) for k, (_, role, text) in enumerate(cases)}
    assert spark.range(1).select(S.text_role(F.lit("plain words"), F.lit(True))).first()[0] == "title"


def test_lists_continue_and_restart(spark):
    rows = [(0, 1, "ordered", "a"), (0, 2, "ordered", "b"), (0, 3, "ordered", "c"), (0, 4, "heading1", "d"), (0, 5, "ordered", "e")]
    out = S.list_ids(spark.createDataFrame(rows, "doc_id long, block_id long, role string, text string"), ["doc_id"]).collect()
    assert [r["list_id"] for r in sorted(out, key=lambda r: r["block_id"])] == [1, 1, 1, None, 2]


def test_normalize(spark):
    cases = {"𝑥\u0b35 + 𝑦\u0b36 + 𝛼 + \u1250 + \uf0b7 项目": "x₁ + y₂ + α + ⎧ + • 项目", "  a \t b\r\n\n c\x00 ": "a b\nc", "": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.normalize(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == cases


def test_demotion_matches_a_loop(spark):
    random.seed(5)
    rows = []
    for d in range(60):
        for i in range(30):
            role = random.choice(["ordered", "bullet", "bullet", "bullet", "body"])
            rows.append((d, i, random.choice(["a", "b.", "c:", "• d", "• e."]), random.choice([36, 48, 60]), role))
    got = {(r["d"], r["i"]): r["final_role"] for r in S.demoted(spark.createDataFrame(rows, "d long, i long, text string, x0 long, role string"), ["d"], "i").collect()}
    last = {}
    for d, i, text, x0, role in rows:
        p = last.get(d)
        if p and role == "bullet" and ((p[0] == "ordered" and p[1][-1] in "：:" and x0 <= p[2] + 14) or (p[0] == "bullet" and not re.search(r"[。！？!?；;：:.]$", p[1]) and "•" not in text)):
            role = "body"
        last[d] = (role, text, x0)
        assert got[(d, i)] == role


def test_routes(spark):
    cfg = EngineConfig()
    rows = [(1, "This page has well over twenty characters", 0, 0), (1, "So has this second page of the document", 0, 0), (2, "This page has well over twenty characters", 1, 1), (3, "", 0, 0)]
    pages = Q.page_quality(spark.createDataFrame(rows, "doc long, text string, images long, full_images long"), cfg)
    assert {r["doc"]: r["route"] for r in Q.route(Q.document_quality(pages, "doc", cfg), cfg).collect()} == {1: "text", 2: "page_image", 3: "ocr"}


def test_ocr_audit_matches_a_loop(spark):
    random.seed(7)
    words = ["plain words", "\ufffd odd", "九月 ", "", "a\x00b", "\ue000 private"]
    pages = [(k, random.choices(words, k=random.randrange(4)), random.choices(["0.91", "0.2", "0.75", "bad", "nan", "1"], k=random.randrange(4))) for k in range(200)]
    out = {r["page"]: r for r in Q.ocr_audit(spark.createDataFrame(pages, "page long, texts array<string>, scores array<string>")).collect()}
    for k, texts, scores in pages:
        known = [float(s) for s in scores if s not in ("bad", "nan")]
        texts = [" ".join(t.replace("\0", "").split()) for t in texts]
        odd = sum(c == "\ufffd" or "\ue000" <= c <= "\uf8ff" for t in texts for c in t)
        chars, low = sum(len("".join(t.split())) for t in texts), sum(s < 0.75 for s in known)
        r = out[k]
        assert (r["lines"], r["low"], r["suspicious"], r["chars"]) == (len(texts), low, odd, chars)
        assert r["low_ratio"] == (low / len(known) if known else 1.0) and r["min"] == (min(known) if known else None)
        assert r["mean"] is None if not known else abs(r["mean"] - sum(known) / len(known)) < 1e-9
        doubt = not texts or not any(texts) or not known or low / len(known) > 0.25 or sum(known) / len(known) < 0.75 or odd / max(chars, 1) > 0.05
        assert r["needs_review"] == doubt, (texts, scores)


def test_spans_and_candidates(spark):
    assert TB.spans_of(2, 2, {(1, 1)}, set()) == [(0, 0, 2, 2)]
    assert TB.spans_of(2, 2, {(0, 1), (1, 1)}, {(1, 0, 1), (1, 1, 2)}) == [(0, 0, 1, 1), (0, 1, 1, 1), (1, 0, 1, 1), (1, 1, 1, 1)]
    rules = [(100.0, 36.0, 324.0), (130.0, 36.0, 324.0), (160.0, 36.0, 324.0), (400.0, 36.0, 324.0)]
    posts = [(36.0, 90.0, 170.0), (180.0, 90.0, 170.0), (324.0, 90.0, 170.0)]
    assert TB.find_candidates(rules, posts) == [(0, 2, [36.0, 180.0, 324.0])]
    # bounds are the means of chains; the rules' ends join uprights near them, and a short upright counts as a bound only
    near = [(35.0, 90.0, 170.0), (100.0, 120.0, 130.0), (326.0, 90.0, 170.0)]
    assert TB.find_candidates(rules, near) == [(0, 2, [35.5, 100.0, 325.0])]
    assert TB.band_of([(10, 20, 0, 5, 10), (11, 21, 6, 9, 10), (40, 50, 0, 5, 10)]) == [0, 0, 1]


def loop_lines(chars):
    """(text, x0, x1, top, bottom) of (no, char, x0, x1, top, bottom), by loops."""
    kept = [c for c in chars if c[1] not in ("", "\n", "\t", "\r", "\ufffe") and (c[1] == " " or c[1].strip())]
    bands = []
    for c in sorted(kept, key=lambda c: (c[4], c[2], c[0])):
        for band in reversed(bands):
            p = band[-1]
            size = max(p[5] - p[4], c[5] - c[4], 1.0)
            if min(p[5], c[5]) - max(p[4], c[4]) >= 0.35 * min(p[5] - p[4], c[5] - c[4]) or abs(p[4] + p[5] - c[4] - c[5]) / 2 <= max(6.0, 0.6 * size):
                band.append(c)
                break
        else:
            bands.append([c])
    out = []
    for band in bands:
        run = []
        for c in [*sorted(band, key=lambda c: (c[2], c[0])), None]:
            if run and (c is None or c[2] - run[-1][3] > max(14.0, 1.3 * max(c[5] - c[4], run[-1][5] - run[-1][4], 1.0))):
                if text := " ".join("".join(x[1] for x in run).split()):
                    out.append((text, min(x[2] for x in run), max(x[3] for x in run), min(x[4] for x in run), max(x[5] for x in run)))
                run = []
            if c:
                run.append(c)
    return sorted(out)


def test_text_lines_match_a_loop(spark):
    random.seed(21)
    pages = {p: [(k, random.choice("abc 九\n\t"), float(x := random.randrange(300)), float(x + random.randrange(4, 12)), float(t := random.randrange(60)), float(t + random.randrange(1, 14))) for k in range(80)] for p in range(20)}
    rows = [(p, *c) for p, cs in pages.items() for c in cs]
    out = TB.text_lines(spark.createDataFrame(rows, "page long, char_no long, char string, x0 double, x1 double, top double, bottom double"), ["page"])
    got = {}
    for r in out.collect():
        got.setdefault(r["page"], []).append((r["text"], r["x0"], r["x1"], r["top"], r["bottom"]))
    for p, cs in pages.items():
        assert sorted(got[p]) == loop_lines(cs)


def test_whole_tables(spark):
    """A grid with a cell over two columns and one over two rows; texts in cells, lines elsewhere left alone; a page without marks of one kind."""
    rules = [(1, t, 40.0, 340.0) for t in (100.0, 140.0)] + [(1, 180.0, 40.0, 140.0)] * 0 + [(1, 180.0, 140.0, 340.0), (1, 220.0, 40.0, 340.0), (2, 50.0, 0.0, 300.0)]
    posts = [(1, 40.0, 100.0, 220.0), (1, 140.0, 100.0, 220.0), (1, 240.0, 140.0, 220.0), (1, 340.0, 100.0, 220.0), (3, 10.0, 0.0, 90.0)]
    lines = [(1, 1, "wide", 200.0, 280.0, 110.0, 120.0), (1, 2, "tall", 60.0, 90.0, 170.0, 190.0), (1, 3, "second", 60.0, 90.0, 195.0, 205.0), (1, 4, "far", 60.0, 90.0, 400.0, 410.0), (2, 1, "none", 1.0, 2.0, 1.0, 2.0)]
    out = TB.tables(
        spark.createDataFrame(lines, "page long, line_no long, text string, x0 double, x1 double, top double, bottom double"),
        spark.createDataFrame(rules, "page long, top double, x0 double, x1 double"), spark.createDataFrame(posts, "page long, x double, top double, bottom double"), ["page"])
    got = {(r["row"], r["col"]): (r["row_span"], r["col_span"], r["text"]) for r in out.collect() if r["page"] == 1 and r["table_no"] == 0}
    assert got == {(0, 0): (1, 1, ""), (0, 1): (1, 2, "wide"), (1, 0): (2, 1, "tall\nsecond"), (1, 1): (1, 1, ""), (1, 2): (1, 1, ""), (2, 1): (1, 1, ""), (2, 2): (1, 1, "")}
    assert out.where("page <> 1").count() == 0


def test_page_composition_matches_a_loop(spark):
    """Lines between tables make blocks of their own; only a document's first line before any table is a title; lists begin anew after a table."""
    random.seed(22)
    rows, boxes, want = [], [], {}
    for d in range(40):
        lines = made_lines(20)
        tops = sorted(random.sample(range(5, 400), 2))
        boxes += [(d, k, 0.0, 500.0, float(t), float(t + 15)) for k, t in enumerate(tops)]
        rows += [(d, i, t, float(36 + random.choice([0, 6, 12, 18, 24])), 400.0, float(20 * i), float(20 * i + 10)) for i, t in enumerate(lines)]
    frame = spark.createDataFrame(rows, "d long, line_no long, text string, x0 double, x1 double, top double, bottom double")
    tables = spark.createDataFrame(boxes, "d long, table_no int, x0 double, x1 double, top double, bottom double")
    given = frame.withColumn("indent", F.lit(0.0)).select("d", "line_no", "text", "x0")
    left, indents = {}, []
    for d, i, text, x0, *_ in rows:
        if text.strip():
            left[d] = min(left.get(d, x0), x0)
    for d in range(40):
        parts, tops = [[], [], []], [b[4] for b in boxes if b[0] == d]
        for _, i, text, x0, _, top, bottom in (r for r in rows if r[0] == d):
            if text.strip() and not any(t - 1 <= (top + bottom) / 2 <= t + 16 for t in tops):
                parts[sum(t <= top for t in tops)].append((i, text.strip(), x0))
        want[d] = parts
        indents += [(d, i, text, x0, x0 - left[d], k == 0 and n == 0 and d % 2 == 0, k) for k, part in enumerate(parts) for n, (i, text, x0) in enumerate(part)]
    roles = spark.createDataFrame(indents, "d long, i long, text string, x0 double, indent double, first boolean, k int").withColumn("role", S.layout_role(F.col("text"), F.col("indent"), F.col("first")))
    role_of = {(r["d"], r["i"]): r["final_role"] for r in S.demoted(roles, ["d", "k"], "i").collect()}
    got = {}
    for r in PG.compose(frame, tables, ["d"], F.col("d") % 2 == 0).collect():
        got.setdefault(r["d"], []).append((r["segment"], r["block_id"], r["role"], r["text"], r["list_id"]))
    for d in range(40):
        expect, last, number = [], None, 0
        for k, part in enumerate(want[d]):
            for role in (["table"] if k else []) + [role for role, _ in loop_blocks([(role_of[(d, i)], text) for i, text, _ in part])]:
                kind = "ordered" if role == "ordered" else "bullet" if role in ("bullet", "plugin") else None
                number += kind is not None and kind != last
                last = kind
                expect.append((k, role, number if kind else None))
        assert [(s, role, n) for s, _, role, _, n in sorted(got[d], key=lambda x: x[:2])] == expect
    assert given.count() == len(rows)


def test_upsert_keeps_the_last_change(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 3), (1, "z", 2), (5, "n", 1)], "id long, s string, n int")
    assert sorted(tuple(r) for r in J.upsert(old, new, "id", "n").collect()) == [(1, "y"), (2, "b"), (5, "n")]


def test_docx_of_broken_and_merged(spark):
    merged = DX.table([(0, 0, 2, 1, "down"), (0, 1, 1, 2, "across"), (1, 1, 1, 1, "b"), (1, 2, 1, 1, "c")])
    file = DX.archive([DX.paragraph("heading1", "A <&> B"), merged, DX.paragraph("plugin", "x", 3)], [b"jpeg"])
    found = DX.inspect(file)
    assert (found["paragraphs"], found["tables"], found["cells"], found["headings"], found["bullets"], found["media_count"]) == (2, 1, 5, 1, 1, 1)
    assert found["complete"] and found["zip_ok"] and found["text_chars"] == 5 + 4 + 6 + 1 + 1 + 1
    files = spark.createDataFrame([("ok", file), ("cut", file[:50]), ("none", None), ("empty", b"")], "name string, content binary")
    assert {r["name"]: (r["zip_ok"], r["paragraphs"]) for r in DX.metrics(files, "name").collect()} == {"ok": (True, 2), "cut": (False, 0), "none": (False, 0), "empty": (False, 0)}
    page = spark.createDataFrame([(1, 0, "table", "a\tb\nc", None), (1, 1, "ordered", "d", 1)], "d long, i int, role string, text string, list_id long")
    assert DX.inspect(DX.documents(page, "d", "i").first()["content"])["cells"] == 3


def test_uploads(spark, tmp_path):
    for name, data in {"b.pdf": b"  %PDF-1.7 x", "a.pdf": b"no", "c.pdf": b"%PDF-" + b"x" * 200, "d.txt": b"%PDF-"}.items():
        (tmp_path / name).write_bytes(data)
    assert [(r["path"][-5:], r["status"]) for r in SRC.uploads(spark, str(tmp_path), 100).collect()] == [("a.pdf", 415), ("b.pdf", 200), ("c.pdf", 413)]
    assert [bytes(r["content"]) for r in SRC.accepted(spark, str(tmp_path), 100).collect()] == [b"  %PDF-1.7 x"]


def test_event_log_and_latest_table(spark, tmp_path):
    from docweave.sinks import files as FS

    source = tmp_path / "in"
    for k, events in enumerate([[("a", 1, "queued"), ("b", 1, "queued")], [("a", 2, "failed")]]):
        spark.createDataFrame(events, "job_id string, seq bigint, status string").coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema("job_id string, seq bigint, status string").json(str(source))
        FS.append_events(stream, str(tmp_path / "log"), str(tmp_path / "state"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    rows = spark.read.parquet(FS.newest(spark, str(tmp_path / "state"))).collect()
    assert {r["job_id"]: r["status"] for r in rows} == {"a": "failed", "b": "queued"} and spark.read.json(str(tmp_path / "log")).count() == 3
    FS.write_report(spark.createDataFrame([("d1", None), ("d2", "ValueError: bad")], "name string, error string"), str(tmp_path / "report"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "report")).collect())[0] == '{"name":"d1","error":null}'


def test_stream_deadline_and_expiry(spark, tmp_path):
    """A job that stays under way is queued again by its timer; a job that ended is forgotten, so its id can be used anew."""
    from docweave.streaming.jobs import job_states

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cfg, seen, schema = EngineConfig(task_timeout_s=1.0, ttl_s=1), [], "job_id string, seq bigint, status string, progress int, table_count int, route string"
    send = lambda *events: spark.createDataFrame([(*e, None, None) for e in events], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    send(("slow", 1, "processing", 10), ("done", 1, "succeeded", 100))
    stream = job_states(spark.readStream.schema(schema).json(str(tmp_path / "in")), cfg)
    query = stream.writeStream.foreachBatch(lambda df, _: seen.extend((r["job_id"], r["status"], r["attempts"]) for r in df.collect()))
    query = query.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        wait_for(lambda: ("slow", "queued", 2) in seen)
        assert ("slow", "processing", 1) in seen and ("done", "succeeded", 1) in seen
        time.sleep(5)
        send(("done", 2, "queued", 0))
        wait_for(lambda: ("done", "queued", 1) in seen)
    finally:
        query.stop()


def wait_for(test, seconds=90):
    """A stream with timers has batches without end, so it is stopped once it has done what is asked."""
    end = time.time() + seconds
    while not test():
        assert time.time() < end
        time.sleep(0.2)


def test_stream_folds_jobs(spark, tmp_path):
    from docweave.sources.tables import EVENT_SCHEMA
    from docweave.streaming.jobs import job_states

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = [("a", 1, "processing", 10), ("a", 2, "failed", 20), ("a", 3, "processing", 30), ("a", 4, "succeeded", 100), ("a", 5, "failed", 0), ("b", 1, "failed", 0), ("b", 2, "failed", 0)]
    spark.createDataFrame(events, "job_id string, seq bigint, status string, progress int").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT_SCHEMA).json(str(tmp_path / "in"))
    query = job_states(stream).writeStream.format("memory").queryName("jobs").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        wait_for(lambda: spark.sql("SELECT * FROM jobs").count() == 2)
    finally:
        query.stop()
    got = {r["job_id"]: (r["status"], r["attempts"]) for r in spark.sql("SELECT * FROM jobs").collect()}
    assert got == {"a": ("succeeded", 2), "b": ("failed", 2)}


def test_recognition_export_keeps_empty_pages_and_counts_none(spark):
    pages = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "id int, page int")
    blocks = spark.createDataFrame([(1, 0, "text", "<table><tr><td>x</td></tr></table>"), (1, 0, "text", None), (1, 1, "text", "  \n ")], "id int, page int, label string, content string")
    lines = PG.recognised_lines(blocks, ["id"], "page")
    rows = PG.recognition_export(pages, lines, ["id"], "page", F.col("id") == 2).collect()
    got = sorted((r["id"], r["part"], r["page"], r["line_no"], r["kind"]) for r in rows)
    assert got == [(1, 1, 0, -1, "heading2"), (1, 1, 0, 0, "table"), (1, 1, 1, -1, "heading2"), (2, 0, 0, 0, "image"), (2, 1, 0, -1, "heading2")]
    counts = PG.table_counts(pages.select("id").distinct(), lines.where("kind = 'table'"), ["id"]).collect()
    assert sorted((r["id"], r["tables"]) for r in counts) == [(1, 1), (2, 0)]
