"""Table reader, document and XML trees, wire fields and chunks with pages, on awkward inputs and against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from recordmill.functions import trees as TR
from recordmill.functions import wire as W
from recordmill.operators import documents as DOC
from recordmill.operators import tables as TB


def grid(html, table=0):
    """Texts of one table by place."""
    out = {}
    for no, row, col, text, *_ in TB.cells_of(html):
        if no == table:
            assert (row, col) not in out
            out[row, col] = text
    return out


def test_spans_cover_their_places():
    html = "<table><tr><td rowspan=3>a<td colspan='2'>b<th>c</tr><tr><td>d</td><td rowspan=2 colspan=2>e</td></tr><tr><td>f</table>"
    assert grid(html) == {(0, 0): "a", (0, 1): "b", (0, 2): "b", (0, 3): "c", (1, 0): "a", (1, 1): "d", (1, 2): "e", (1, 3): "e", (2, 0): "a", (2, 1): "f", (2, 2): "e", (2, 3): "e"}
    spanned = {(r, c) for _, r, c, *_, s in TB.cells_of(html) if s}
    assert spanned == {(0, 2), (1, 0), (1, 3), (2, 0), (2, 2), (2, 3)}


def test_spans_reach_no_further_than_the_rows():
    assert grid("<table><tr><td rowspan=65534>a<td>b</tr><tr><td>c</table>") == {(0, 0): "a", (0, 1): "b", (1, 0): "a", (1, 1): "c"}
    assert len(grid("<table><tr><td colspan=99999999>a</table>")) == TB.MOST_COLUMNS
    assert grid("<table><tr><td rowspan=x colspan=0>a<td>b</table>") == {(0, 0): "a", (0, 1): "b"}


def test_nested_tables_open_ends_and_marks():
    html = "x<table><td>one<br>two<table><tr><td>in<sup>2</sup></table> three<td><a href='/h'>li<b>n</b>k</a>6<sup>8</sup></td><tr class=k id=r1><th>&amp;"
    assert grid(html) == {(0, 0): "one two three", (0, 1): "link6", (1, 0): "&"} and grid(html, 1) == {(0, 0): "in"}
    by = {c[:3]: c for c in TB.cells_of(html)}
    assert by[0, 0, 1][4:7] == ("8", "/h", False) and by[0, 1, 0][6:9] == (True, "r1", "k") and by[1, 0, 0][4] == "2"
    for broken in (None, "", "<td>no table</td></table>", "<table>", "</table><table><tr></tr><tr><td></table>"):
        assert all(len(c) == 11 for c in TB.cells_of(broken))


def test_headers_are_carried_and_pairs_need_their_second_row(spark):
    html = "<table><tr id=r0><td>early<tr class=head><td>H1<tr id=r1><td>a<tr id=r1b><td>b<tr id=r2><td>c<tr class=head><td>H2<tr id=r3><td>d<tr id=r3b><td>e</table>"
    df = spark.createDataFrame([("k", html), (None, html)], "k string, h string")
    rows = TB.grouped_rows(TB.table_cells(df, "k", "h"), "k", F.col("row_class") == "head", F.col("text"))
    got = sorted((r["k"] or "", r["row_no"], r["header"], r["cells"][0]["text"]) for r in rows.collect())
    assert [g[2:] for g in got if g[0] == "k"] == [(None, "early"), ("H1", "a"), ("H1", "b"), ("H1", "c"), ("H2", "d"), ("H2", "e")] and len(got) == 12
    pairs = TB.row_pairs(rows, "k").where("k is null").collect()
    assert sorted((r["cells"][0]["text"], r["other"][0]["text"]) for r in pairs) == [("a", "b"), ("d", "e")]


def test_details_turned_round(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (2, "x", None), (3, "q", "q")], "k int, p string, q string")
    details = spark.createDataFrame([(1, "b", "a", 10, 20, "n"), (1, "b", "c", 1, 2, "m"), (1, "c", "b", 9, 9, "late"), (2, None, "x", 5, 6, "z"), (3, "q", "q", 7, 8, "s")], "k int, p string, q string, op int, oq int, note string")
    got = {(r["k"], r["p"]): (r["op"], r["oq"], r["note"]) for r in TB.join_oriented(rows, details, ["k"], ("p", "q"), [("op", "oq")]).collect()}
    assert got == {(1, "a"): (20, 10, "n"), (1, "b"): (1, 2, "m"), (2, "x"): (6, 5, "z"), (3, "q"): (7, 8, "s")}


def paragraph(text):
    return {"type": "paragraph", "content": [{"type": "text", "text": text}]}


def test_rich_text(spark):
    item = lambda *inner: {"type": "list_item", "content": list(inner)}
    doc = {"type": "doc", "content": [
        paragraph(" one "), {"type": "ordered_list", "content": [item(paragraph("a"), paragraph("more"), {"type": "bullet_list", "content": [item(paragraph("in"))]}), item(paragraph("b"))]},
        {"type": "horizontal_rule"}, {"type": "blockquote", "content": [paragraph("said"), {"type": "heading", "content": [{"type": "text", "text": "x"}, {"type": "hard_break"}, {"type": "bold", "content": [{"type": "text", "text": "y"}]}]}]}, paragraph(" "), None, 5, {"type": "paragraph", "content": "no list"},
    ]}
    assert TR.rich_blocks(doc) == ["one", "1. a", "more", "- in", "2. b", "---", "said", "x\ny"]
    deep = "{\"type\": \"doc\", \"content\": [" * 3000 + json.dumps(paragraph("deep")) + "]}" * 3000
    rows = [json.dumps(doc), deep, "{", None, "[]", json.dumps({"type": "doc"})]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(TR.rich_text(F.col("x"))).collect()]
    assert got[0].startswith("one\n\n1. a") and got[1] in ("deep", None) and got[2:] == [None] * 4


def test_xml_rows():
    rows = TR.xml_rows("<a:r x='1>2'><b>t &amp; u<br/>v</b></zz><c><d>open</c><![CDATA[<raw>]]> < 3</a:r> tail <e/>")
    assert [(r["at"], r["parent"], r["depth"], r["name"], r["text"]) for r in rows] == [(0, None, 0, "r", "<raw> < 3"), (1, 0, 1, "b", "t & uv"), (2, 1, 2, "br", None), (3, 0, 1, "c", None), (4, 3, 2, "d", "open"), (5, None, 0, "e", None)]
    assert TR.xml_rows(None) == [] and TR.xml_rows("text < only & <1>") == []
    deep = TR.xml_rows("<n>" * 20_000 + "x")
    assert len(deep) == 20_000 and deep[-1]["depth"] == 19_999 and deep[-1]["text"] == "x"


def test_wire_round_trip(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0, 1, 127, 128, 300, 2**62, -1, -(2**63), rng.getrandbits(40)]), rng.choice(["", "EUR", "ünï", "x" * 300, None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "n long, t string")
    data = W.wire_message((1, F.col("n")), (2, W.wire_message((7, F.col("t")), (3, F.col("n")))), (200, F.lit(5)))
    got = df.select("n", "t", data.alias("d")).select("n", "t", W.wire_number(F.col("d"), 1), W.wire_text(F.col("d"), 2, 7), W.wire_number(F.col("d"), 2, 3), W.wire_number(F.col("d"), 200), W.wire_text(F.col("d"), 1)).collect()
    assert all(r[0] == r[2] == r[4] and r[1] == r[3] and r[5] == 5 and r[6] is None for r in got)


def test_wire_of_anything_but_messages():
    rng = random.Random(5)
    for _ in range(2000):
        data = bytes(rng.getrandbits(8) for _ in range(rng.randrange(20)))
        try:
            fields = W.fields_of(data)
        except (ValueError, IndexError):
            assert W.value_at(data, (1,)) is None
        else:
            assert all(n > 0 and k in (0, 1, 2, 5) for n, k, _ in fields if k)
    assert W.value_at(None, (1,)) is None and W.value_at(b"", (1,)) is None and W.value_at(b"\x0d\x01\x02\x00\x00", (1,)) == b"\x01\x02\x00\x00"


@pytest.mark.parametrize("overlap", [0, 30])
def test_chunks_know_their_pages_and_headings(overlap):
    rng = random.Random(overlap)
    for _ in range(60):
        row = lambda: "| " + " | ".join(str(rng.randrange(9)) for _ in range(3)) + " |"
        block = lambda: rng.choice(["# Head " + str(rng.randrange(99)), "word " * rng.randrange(1, 60), "x" * rng.randrange(1, 250), "\n".join(["| a | b | c |", "|---|---|---|", *[row() for _ in range(rng.randrange(1, 30))]]), "One. Two! " * rng.randrange(1, 20)])
        segments = [{"page": rng.choice([i + 1, None]) if rng.random() < 0.2 else i + 1, "markdown": rng.choice([None, ""]) if rng.random() < 0.1 else "\n\n".join(block() for _ in range(rng.randrange(1, 5)))} for i in range(rng.randrange(6))]
        whole = "\n\n".join(s["markdown"] or "" for s in segments)
        owner = [s["page"] for i, s in enumerate(segments) for _ in range(len(s["markdown"] or "") + 2 * (i < len(segments) - 1))]
        found = DOC.segment_chunks(segments, 200, overlap)
        assert [c[6] for c in found] == DOC.chunks_of(whole, 200, overlap)
        covered = set()
        for _, start, end, first, last, heading, _ in found:
            pages = [p for p in owner[start:end] if p is not None]
            assert (first, last) == (min(pages, default=None), max(pages, default=None))
            assert not covered & set(range(start, end))
            covered |= set(range(start, end))
            heads = [m for m in re.finditer(r"(?m)^# (.*)$", whole) if m.start() <= start]
            assert heading == (heads[-1][1].strip() if heads else None)
        assert {i for i, c in enumerate(whole) if not c.isspace()} <= covered  # nothing is lost


def test_segments_of_any_key(spark):
    df = spark.createDataFrame([("a", [(1, "# T\n\nx")]), (None, None), ("b", [])], "k string, s array<struct<page:int,markdown:string>>")
    assert [tuple(r)[:-1] for r in DOC.chunk_segments(df, "k", "s").collect()] == [("a", 0, 0, 6, 1, 1, "T")]


def test_batches_are_worked_on_in_slices(spark):
    import pyarrow as pa

    from recordmill.functions import batches as B

    texts = pa.array(["x" * 300_000, None, "", *["y" * 100_000] * 40])
    given: list[list] = []

    def lengths(xs):
        given.append(xs)
        return [None if x is None else len(x) for x in xs]

    assert B.by_slices(texts[1:], pa.int64(), lengths).to_pylist() == [None, 0, *[100_000] * 40]
    assert len(given) > 3 and max(sum(len(x or "") for x in xs) for xs in given) <= 2 * B.SLICE_BYTES
    assert B.by_slices(texts[:0], pa.int64(), lengths).to_pylist() == []
    # one batch of long values leaves a task as several
    df = spark.createDataFrame([(i, f"<p>{i}</p>" + "z" * 200_000) for i in range(40)], "id long, html string").coalesce(1)
    sizes = DOC.page_lines(df, "id", "html").mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "first": [b.column(0)[0].as_py()]}) for b in bs), "n long, first long")
    assert sum(r.n for r in DOC.page_lines(df, "id", "html").groupBy().count().selectExpr("count as n").collect()) == 40
    assert sorted(r.id for r in DOC.page_lines(df, "id", "html").select("id").collect()) == list(range(40)) and sizes.agg({"n": "sum"}).first()[0] == 40
    words = [[{"start": 0.4 * i, "end": 0.4 * i + 0.4, "text": f"w{k}.", "speaker": "a"} for i in range(3000)] for k in range(60)] + [None, []]
    spoken = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w array<struct<start:double,end:double,text:string,speaker:string>>").coalesce(1)
    got = {r.k: r.s for r in spoken.select("k", DOC.sentences_of(F.col("w")).alias("s")).collect()}
    assert got[60] is None and got[61] == [] and all(len(got[k]) == 3000 and got[k][7]["text"] == f"w{k}." for k in range(60))


def test_cells_are_shuffled_once(spark):
    df = spark.createDataFrame([(i % 3, f"<table><tr class=h><td>H{i}<tr id=r><td>a<tr id=rb><td>b</table>") for i in range(3)], "k long, html string")
    rows = TB.row_pairs(TB.grouped_rows(TB.table_cells(df, "k", "html"), "k", F.col("row_class") == "h", F.col("text")), "k")
    out = rows.select("k", "header", F.col("cells")[0]["text"].alias("a"), F.col("other")[0]["text"].alias("b")).distinct()
    assert sorted(map(tuple, out.collect())) == [(i, f"H{i}", "a", "b") for i in range(3)]
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_rows_of_a_page_as_shuffled_cells_give_them(spark):
    rng = random.Random(5)
    bits = ["<tr class=head><td class=n>H1", "<tr class=head><td>no name", "<tr class='head'><td class=n>H2</td><td class=n>later", "<tr id=r1><td>a", "<tr id=r1b><td>b<sup>2</sup>", "<tr id=r2><td rowspan=2>c<td colspan=2><a href='x'>d</a>", "<tr id=r2b><td>e", "<tr></tr>", "<table>", "</table>", "<tr id=r1><td>in<table><tr id=q><td>deep<tr id=qb><td>er</table>"]
    pages = [(i, "<table>" + "".join(rng.choices(bits, k=rng.randrange(14))) + ("<!-- -->" if i % 5 == 0 else "")) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(pages, "k long, html string").coalesce(1)
    cells = TB.table_cells(df, "k", "html")
    grouped = TB.grouped_rows(cells, "k", F.col("row_class") == "head", F.when(F.col("cell_class") == "n", F.col("text")))
    shown = lambda cells: F.transform(cells, lambda c: F.concat_ws("|", c["col_no"], c["text"], c["sup"], c["href"], c["cell_class"], c["spanned"]))
    name = lambda r: F.get(F.filter(r["cells"], lambda c: c["cell_class"] == "n"), F.lit(0))["text"]
    read = df.select("k", TB.page_rows(F.col("html")).alias("rows"))
    headed = read.select("k", TB.headed_rows(F.col("rows"), lambda r: r["row_class"] == "head", name).alias("headed"))
    flat = headed.select("k", F.explode("headed").alias("r")).select("k", "r.row.table_no", "r.row.row_no", "r.row.row_id", "r.header", shown(F.col("r.row.cells")).alias("c"))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    want = order(grouped.select("k", "table_no", "row_no", "row_id", "header", shown(F.col("cells")).alias("c")).collect())
    assert order(flat.collect()) == want and len({r[4] for r in want}) == 3 and {r[1] for r in want} > {0, 1}
    pairs = headed.select("k", F.explode(TB.paired_rows(F.col("headed"))).alias("r")).select("k", "r.row.row_id", "r.header", shown(F.col("r.row.cells")).alias("c"), shown(F.col("r.other")).alias("o"))
    want = order(TB.row_pairs(grouped, "k").select("k", "row_id", "header", shown(F.col("cells")).alias("c"), shown(F.col("other")).alias("o")).collect())
    assert order(pairs.collect()) == want and len(want) > 20
    # before, every cell was shuffled, and each page was taken apart anew whatever its layout
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and plan.count("ArrowEvalPython") == 1


def test_layouts_of_tables_are_worked_out_once(monkeypatch):
    page = lambda i: f"<table><tr id=r{i} class=\"c{i}\"><td class='k{i}'>x{i} &amp;<br>y<sup>{i}</sup><a href=\"/q{i}?a&amp;b\">z</a><td colspan=2 rowspan=2>w<tr><td>v</table>"
    want = [TB.cells_of("<!-- no plain markup -->" + page(i)) for i in range(9)]
    made = []
    monkeypatch.setattr(TB, "_Tables", lambda own=TB._Tables: made.append(1) or own())
    reader = TB._Reader()
    reader.TAGS = 4
    for i in range(9):
        read = reader.read(page(i))
        told = [(*c[:7], None if c[7] is None else read[2][c[7]].get("id"), None if c[7] is None else read[2][c[7]].get("class"), *c[8:]) for c in TB._values(read)]
        assert told == want[i] and told[0][3:6] == (f"x{i} & yz", str(i), f"/q{i}?a&b")
    assert len(made) == 1 and [c[:3] for c in TB.cells_of("<table><tr><td colspan=\"3\">a<td colspan='2'>b</table>")] == [(0, 0, i) for i in range(5)]
