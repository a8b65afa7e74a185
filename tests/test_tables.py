"""Workbooks and the attention ranker against plain versions."""

import io
import random
import zipfile

import numpy as np
import pandas as pd
import pytest

from weftline.operators import attention
from weftline.sources import workbooks

# ---------------------------------------------------------------- workbooks


def texts(df):
    return {(r["path"].rsplit("/", 1)[1], r["sheet_no"], r["batch"]): r["text"] for r in df.collect()}


def test_workbooks(spark, tmp_path):
    rows = [["Fund", "Share", None], *([f"F{i}", i / 4 if i % 2 else i, i % 3 == 0, "past the header"] for i in range(45))]
    rows[7] = ["F6", None, True]
    (tmp_path / "a.xlsx").write_bytes(workbooks.workbook({"Funds & <more>": rows, "Empty": [], "Heads": [["x", "y"]], "Gap": [["h"], [], ["v"]]}))
    (tmp_path / "b.xlsx").write_bytes(workbooks.workbook({"S": []}))
    (tmp_path / "c.xlsx").write_bytes(b"PK\x03\x04 no archive")
    (tmp_path / "d.xls").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1 another format")
    (tmp_path / "e.csv").write_text("no workbook")
    got = texts(workbooks.workbook_texts(spark, str(tmp_path)))
    for k in range(3):
        assert len(got[("a.xlsx", 0, k)].split("\n")) == 2 + (20, 20, 5)[k]
    first = [got.pop(("a.xlsx", 0, k)) for k in range(3)][0].split("\n")
    assert first[:2] == ["Worksheet: Funds & <more>", "Headers: Fund | Share"]
    assert first[2] == "Fund: F0 | Share: 0 | True | past the header" and first[3] == "Fund: F1 | Share: 0.25 | False | past the header" and first[8] == "Fund: F6 | Share: None | True"
    assert got.pop(("a.xlsx", 3, 0)) == "Worksheet: Gap\nHeaders: h\nh: None\nh: v"
    assert {k[0]: v.split("]")[0] for k, v in got.items()} == {"b.xlsx": "[Empty Excel", "c.xlsx": "[Excel parsing failed", "d.xls": "[Excel parsing failed"}
    assert workbooks.workbook_texts(spark, str(tmp_path / "none")).count() == 0


def test_shared_strings_dates_and_places():
    """What other programs write: shared strings in runs, dates by style, rows and cells left out."""
    main, rel, package = (x.strip("{}") for x in (workbooks.MAIN, workbooks.REL, workbooks.PACKAGE))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><workbookPr/><sheets><sheet name="One" sheetId="3" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}"><Relationship Id="x" Target="/xl/worksheets/any.xml" Type="t"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>plain</t></si><si><r><t>in </t></r><r><t>runs</t></r><rPh><t>hint</t></rPh></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        cells = '<c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="D2" s="1"><v>45292</v></c><c r="E2" s="2"><v>45292.5</v></c><c r="F2" s="3"><v>7</v></c><c r="G2" t="e"><v>#DIV/0!</v></c><c r="AA2" t="str"><f>x</f><v>sum</v></c><c r="AB2"/>'
        z.writestr("xl/worksheets/any.xml", f'<worksheet xmlns="{main}"><sheetData><row r="2">{cells}</row><row r="9"><c><v>-3</v></c><c t="b"><v>0</v></c></row></sheetData></worksheet>')
    (a, b) = workbooks.sheets(out.getvalue())
    assert a[:3] == (0, "One", 2) and a[3] == ["plain", None, "in runs", "2024-01-01 00:00:00", "2024-01-01 12:00:00", "7", "#DIV/0!", *[None] * 19, "sum", None]
    assert b == (0, "One", 9, ["-3", "False"])


def test_column_names():
    assert [workbooks._column(c) for c in ("A1", "Z9", "AA1", "XFD1")] == [0, 25, 26, 16383]


# ---------------------------------------------------------------- dispatch by type


def test_files_are_parsed_by_type(spark, tmp_path):
    from weftline.sources import parse

    (tmp_path / "sub").mkdir()
    (tmp_path / "t.csv").write_text("a,b\n" + "\n".join(f"{i},x{i}" for i in range(25)) + '\n"quoted, value"\n', encoding="utf-8")
    (tmp_path / "e.csv").write_text("a,b\n")
    (tmp_path / "sub" / "w.xlsx").write_bytes(workbooks.workbook({"S": [["h"], ["v", 2]]}))
    (tmp_path / "n.txt").write_text("First sentence here. Second one follows.", encoding="utf-8")
    (tmp_path / "p.pdf").write_bytes(b"%PDF-1.4 page one\x0cpage two")
    (tmp_path / "i.png").write_bytes(b"no image")
    (tmp_path / "broken.csv").write_bytes(b"a,b\n\xff\xfe,1\n")
    (tmp_path / "big.md").write_text("x" * 5000)
    reader = {"pdf": lambda data: [p.decode() for p in data.split(b" ", 1)[1].split(b"\x0c")]}
    rows = parse.parse_files(spark, str(tmp_path), reader, most=4000).collect()
    got = {}
    for r in rows:
        got.setdefault(r["path"].rsplit("/", 1)[1], {})[r["part"]] = (r["text"], r["error"] and r["error"].split(":")[0])
    assert got["t.csv"][0][0].startswith("Headers: a | b\na: 0 | b: x0\n") and got["t.csv"][1][0].split("\n")[-1] == "a: quoted, value | b: None" and len(got["t.csv"]) == 2
    assert got["e.csv"] == {0: ("[Empty CSV]", None)} and got["w.xlsx"] == {0: ("Worksheet: S\nHeaders: h\nh: v | 2", None)}
    assert got["p.pdf"] == {0: ("page one", None), 1: ("page two", None)} and got["n.txt"][0][1] is None
    failed = {k: v[0][1] for k, v in got.items() if v[0][1]}
    assert failed == {"i.png": "LookupError", "broken.csv": "UnicodeDecodeError", "big.md": "too large"} and got["i.png"][0][0].startswith("[Image parsing failed] ")
    chunks, failures = parse.parse_documents(spark, str(tmp_path), reader, budget=6)
    mine = [(r["chunk_index"], r["content"]) for r in chunks.where("path like '%n.txt'").orderBy("chunk_index").collect()]
    assert mine[0] == (0, "First sentence here.") and {r["path"].rsplit("/", 1)[1] for r in failures.collect()} == {"i.png", "broken.csv"}
    assert [r["chunk_index"] for r in chunks.where("path like '%p.pdf'").orderBy("chunk_index").collect()] == [0, 1]


# ---------------------------------------------------------------- attention


def records(n, seed=1):
    r = random.Random(seed)
    rows = []
    for q in range(n):
        right = r.randrange(4)
        for c in range(4):
            row = {k: float(r.random()) for k in attention.NUMERIC} | {"query_id": q, "candidate": f"m{c}", "label": int(c == right)}
            row["walks"] = 3.0 * (c == right) * (c % 2) + r.random()  # odd metapaths show by their walks, even ones by their scores
            row["router_score"] = 2.0 * (c == right) * (1 - c % 2) + r.random()
            rows.append(row)
    return pd.DataFrame(rows)


def test_gradient_by_differences():
    model = attention.train(records(6), epochs=1, hidden=5)
    x, m = model.features(records(3, 2))
    up = np.random.default_rng(3).normal(size=len(x))
    grad = model.backward(model.forward(x, m)[1], up)
    for k, w in model.weights.items():
        flat = w.reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 7)):
            if k == "embed" and i >= flat.size - 5:
                continue  # the row of unknown metapaths is never fitted
            old = flat[i]
            flat[i] = old + 1e-6
            above = up @ model.forward(x, m)[0]
            flat[i] = old - 1e-6
            below = up @ model.forward(x, m)[0]
            flat[i] = old
            assert grad[k].reshape(-1)[i] == pytest.approx((above - below) / 2e-6, abs=1e-6), k


def test_ranker_learns_what_holds_for_each_metapath(spark):
    model, again = attention.train(records(120)), attention.train(records(120))
    assert all((model.weights[k] == again.weights[k]).all() for k in model.weights)
    rows = records(80, 5)
    scored = attention.apply(spark.createDataFrame(rows).repartition(3), model).toPandas()
    best = scored.sort_values("score").groupby("query_id").tail(1)
    assert best["label"].mean() > 0.95
    plain = rows.sort_values("router_score").groupby("query_id").tail(1)["label"].mean()
    assert best["label"].mean() > plain
    odd = attention.apply(spark.createDataFrame(rows.head(4).assign(candidate="unknown")), model)
    assert odd.where("score is null or isnan(score)").count() == 0


def test_training_without_pairs():
    rows = records(2).assign(label=0)
    assert len(attention.pairs_of(rows)) == 0
    assert np.isfinite(attention.train(rows, epochs=2).forward(*attention.train(rows, epochs=2).features(rows))[0]).all()
