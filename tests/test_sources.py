"""File sources, keyed upserts and streaming forms on small fixtures."""

import datetime

from quantiva.functions import parsing
from quantiva.sources import files
from quantiva.streaming import totals


def test_kinds_and_inventory(spark, tmp_path):
    for name in ("a.PDF", "b.dxf", "sub.d/c.jpeg", "d", "e.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 3)
    got = {r["path"].rpartition("/")[2]: (r["kind"], r["length"]) for r in files.inventory(spark, str(tmp_path)).collect()}
    assert got == {"a.PDF": ("PDF_VECTORIEL", 3), "b.dxf": ("DXF", 3), "c.jpeg": ("IMAGE", 3), "d": ("UNKNOWN", 3), "e.txt": ("UNKNOWN", 3)}


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "plan.json").write_text('{\n "projet": {"nom": "A"}, "types": {"S1": {"a": 1.2}, "S2": {"a": 0.9}}}')
    docs = files.json_documents(spark, str(tmp_path / "plan.json"), "projet struct<nom:string>, types map<string,struct<a:double>>")
    assert sorted((r["key"], r["value"]["a"]) for r in docs.select(files.entries(docs["types"]).alias("e")).select("e.*").collect()) == [("S1", 1.2), ("S2", 0.9)]
    (tmp_path / "i.csv").write_text("name,n\na,1\nb,\n")
    assert [tuple(r) for r in files.csv_index(spark, str(tmp_path / "i.csv"), "name string, n int").collect()] == [("a", 1), ("b", None)]


def test_upsert(spark):
    old = spark.createDataFrame([("a", "f", 1), ("b", "f", 2), ("c", None, 3)], "nom string, fichier string, n int")
    new = spark.createDataFrame([("b", "f", None), ("c", None, 9), ("d", "g", 4)], old.schema)
    assert sorted(map(tuple, files.upsert(old, new, ["nom", "fichier"]).collect()), key=str) == [("a", "f", 1), ("b", "f", None), ("c", None, 9), ("d", "g", 4)]
    assert files.upsert(old.limit(0), new, ["nom", "fichier"]).count() == 3


def test_notes(spark):
    df = spark.createDataFrame([("3HA12 L=4,20",), ("L = 420",), ("no length",), (None,)], "t string")
    assert [r[0] for r in df.select(parsing.explicit_length(df["t"])).collect()] == [4.2, 4.2, None, None]
    rooms = spark.createDataFrame([("5,00 x 3.5",), ("400 x 3",), ("SALON 5 x 3",), (None,)], "t string")
    assert [r[0] for r in rooms.select(parsing.room_dims(rooms["t"])).collect()] == [[5.0, 3.5], [4.0, 3.0], None, None]


def test_streams(spark, tmp_path):
    at = lambda d, h: datetime.datetime(2026, 1, d, h)
    src = spark.createDataFrame([(at(1, 1), "S", 1.5), (at(1, 9), "S", 2.0), (at(2, 3), "P", 4.0)], "ts timestamp, family string, v double")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    run = totals.windowed_totals(stream, "ts", ["family"], "v").writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    run.awaitTermination(60)
    assert sorted((r["begin"].day, r["family"], r["n"], float(r["total"])) for r in spark.table("sums").collect()) == [(1, "S", 2, 3.5), (2, "P", 1, 4.0)]
    (tmp_path / "files").mkdir()
    (tmp_path / "files/a.dwg").write_bytes(b"12")
    run = totals.new_files(spark, str(tmp_path / "files")).writeStream.format("memory").queryName("kinds").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state2")).start()
    run.awaitTermination(60)
    assert [(r["kind"], r["length"]) for r in spark.table("kinds").collect()] == [("DWG", 2)]


def test_dxf_and_ifc(spark, tmp_path):
    pairs = ["0", "SECTION", "2", "ENTITIES", "0", "TEXT", "8", "POTEAU_RDC", "1", "P1(25x35)", "10", "1.5", "20", "2", "0", "LWPOLYLINE", "8", "AXES", "10", "0", "20", "0", "10", "4", "20", "3.5", "0", "ENDSEC", "0", "EOF"]
    (tmp_path / "a.dxf").write_text("\r\n".join(pairs) + "\r\n")
    (tmp_path / "b.dxf").write_text("")
    got = {r["kind"]: r for r in files.dxf_entities(spark, f"{tmp_path}/*.dxf").collect()}
    assert set(got) == {"TEXT", "LWPOLYLINE"} and got["TEXT"]["text"] == "P1(25x35)" and got["TEXT"]["layer_class"] == "poteaux"
    assert got["LWPOLYLINE"]["xs"] == [0.0, 4.0] and got["LWPOLYLINE"]["ys"] == [0.0, 3.5] and got["LWPOLYLINE"]["layer_class"] == "axes"
    (tmp_path / "m.ifc").write_text("ISO-10303-21;\n#12=IFCBEAM('g1',#2,'N1',$,$,#3,#4,'x');\n#13= IFCCOLUMN('g2',#2,$,$,$,#3,#4,'x');\n#14=IFCDOOR('g3',#2,'d',$);\nENDSEC;\n")
    rows = {r["entity"]: (r["family"], r["guid"], r["name"]) for r in files.ifc_elements(spark, f"{tmp_path}/m.ifc").collect()}
    assert rows == {12: ("POUTRE", "g1", "N1"), 13: ("POTEAU", "g2", None)}


def test_route_and_sinks(spark, tmp_path):
    paths = spark.createDataFrame([("a.dxf",), ("b.ifc",), ("c.xyz",), (None,)], "path string")
    assert {r["path"]: (r["reader"], r["partial"]) for r in files.route(paths).collect()} == {"a.dxf": ("dxf_entities", False), "b.ifc": ("ifc_elements", False), "c.xyz": (None, True), None: (None, True)}
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    files.write_sheets({"one": df, "two": df.limit(0)}, str(tmp_path / "book"))
    files.write_sheets({"one": df}, str(tmp_path / "book"), append=True)
    assert spark.read.option("header", "true").csv(str(tmp_path / "book/one")).count() == 4
    files.json_dump(df, str(tmp_path / "dump"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "dump")).collect()) == ['{"id":1,"t":"x"}', '{"id":2}']


IFC = """ISO-10303-21;
DATA;
#1=IFCCARTESIANPOINT((1.5,-2.,3.E0));
#2=IFCAXIS2PLACEMENT3D(#1,$,$);
#3=IFCLOCALPLACEMENT($,#2);
#10=IFCBEAM('g10',$,'Poutre d''angle; (1)',$,$,#3,$,$);
#11=IFCBEAM('g11',$,$,$,$,$,$,$);
#12=IFCCOLUMN('g12',$,'P',$,
  $,#3,$,$);
#13=IFCDOOR('g13',$,'porte',$,$,$,$,$);
#20=IFCBUILDINGSTOREY('s1',$,'RDC',$,$,$,$,$,.ELEMENT.,0.);
#21=IFCRELCONTAINEDINSPATIALSTRUCTURE('r1',$,$,$,(#10,#13),#20);
#30=IFCPROPERTYSINGLEVALUE('Reference',$,IFCIDENTIFIER('25X40'),$);
#31=IFCPROPERTYSINGLEVALUE('Span',$,IFCREAL(4.5),$);
#32=IFCPROPERTYSINGLEVALUE('Level',$,IFCLABEL('R+1'),$);
#33=IFCPROPERTYSET('p1',$,'Pset_BeamCommon',$,(#30,#31));
#34=IFCPROPERTYSET('p2',$,'Autre',$,(#32));
#35=IFCRELDEFINESBYPROPERTIES('d1',$,$,$,(#10),#33);
#36=IFCRELDEFINESBYPROPERTIES('d2',$,$,$,(#10,#12),#34);
#40=IFCMATERIAL('B25',$,$);
#41=IFCMATERIALLIST((#99,#40));
#42=IFCRELASSOCIATESMATERIAL('m1',$,$,$,(#12),#41);
#43=IFCRELASSOCIATESMATERIAL('m2',$,$,$,(#11),#40);
#50=IFCBEAM('broken',$;
ENDSEC;
"""


def test_ifc_references_are_followed(spark, tmp_path):
    from quantiva.sources import ifc

    (tmp_path / "a.ifc").write_text(IFC.replace("angle; (1)", "angle (1)"))
    (tmp_path / "b.ifc").write_text("#1=IFCSLAB('x',$,'D',$,$,$,$,$);")
    got = {(r["file"][-5:], r["entity"]): r for r in ifc.elements(spark, f"{tmp_path}/*.ifc").collect()}
    assert set(got) == {("a.ifc", 10), ("a.ifc", 11), ("a.ifc", 12), ("b.ifc", 1)}
    beam, other, column, slab = got["a.ifc", 10], got["a.ifc", 11], got["a.ifc", 12], got["b.ifc", 1]
    assert (beam["name"], beam["reference"], beam["mark"], beam["storey"]) == ("Poutre d'angle (1)", "N1", "25X40", "RDC")
    assert (beam["width"], beam["height"], beam["length"], beam["x"], beam["y"], beam["z"]) == (0.25, 0.4, 4.5, 1.5, -2.0, 3.0)
    assert (other["name"], other["reference"], other["storey"], other["material"], other["x"]) == ("IFCBEAM-11", "N2", "INCONNU", "B25", None)
    assert (column["storey"], column["material"], column["width"], column["z"]) == ("R+1", "B25", None, 3.0) and slab["reference"] == "D1" and slab["properties"] is None
    assert [r["bad"] for r in ifc.statements(spark, f"{tmp_path}/a.ifc").filter("bad is not null").collect()] == ["#50=IFCBEAM('broken',$"]
    (tmp_path / "c.ifc").write_text(IFC)  # a separator within a text breaks its statement in two, which is said
    assert ifc.statements(spark, f"{tmp_path}/c.ifc").filter("bad is not null").count() == 2


def test_versioned_table(spark, tmp_path):
    import pytest

    from quantiva.sources.history import Conflict, VersionedTable

    t = VersionedTable(spark, f"file://{tmp_path}/t", "k string, j int, v int, w int", ["k", "j"])
    rows = lambda *r: spark.createDataFrame(list(r), t.schema)
    now = lambda v=None: sorted(map(tuple, t.read(v).collect()), key=str)
    assert now() == [] and t.versions() == []
    t.upsert(rows(("a", 1, 1, 1), ("b", None, 2, 2)))
    t.upsert(rows(("b", None, None, 9), ("c", 3, 3, 3), ("a", 1, 7, 7)), keep=("w",))
    assert now() == [("a", 1, 7, 1), ("b", None, 2, 2), ("c", 3, 3, 3)] and now(1) == [("a", 1, 1, 1), ("b", None, 2, 2)]
    # a writer that dies between writing and committing leaves the version before it
    t.write(rows(("z", 0, 0, 0)), 2)
    assert now() == now(2) and t.versions() == [1, 2]
    first, second = t.write(rows(("x", 1, 1, 1)), 2), t.write(rows(("y", 1, 1, 1)), 2)
    t.commit(first, 2)
    with pytest.raises(Conflict):
        t.commit(second, 2)
    assert now() == [("x", 1, 1, 1)] and t.delete(spark.createDataFrame([("x", 1), ("q", 2)], "k string, j int")) == 4 and now() == []
    assert t.clean() == 5 and t.versions() == [4] and now() == []
    with pytest.raises(KeyError):
        t.read(1)


def test_project_history(spark, tmp_path):
    from quantiva.sources.history import MOST, ProjectHistory

    h = ProjectHistory(spark, f"file://{tmp_path}/h")
    kind = "nom string, fichier string, beton double, acier double, livrables map<string,string>, plan_data string"
    add = lambda *r: h.add(spark.createDataFrame(list(r), kind))
    add(("A", "/x/a.pdf", 1.23456, 2.06, {"xlsx": "o.xlsx"}, '{"p": 1}'), (None, None, None, None, None, None))
    a = next(r for r in h.entries().collect() if r["nom"] == "A")
    assert (a["fichier"], a["chemin_source"], a["beton"], a["acier"]) == ("a.pdf", "/x/a.pdf", 1.235, 2.1) and h.snapshot(a["id"]) == '{"p": 1}'
    add(("A", "/y/a.pdf", 5.0, None, None, None), ("B", "b.pdf", 1.0, 1.0, None, None))
    got = {r["nom"]: r for r in h.entries().collect()}
    assert list(got) == ["B", "A", "Projet sans nom"] and (got["A"]["id"], got["A"]["beton"], got["A"]["acier"], got["A"]["chemin_source"], got["A"]["livrables"]) == (a["id"], 5.0, 2.1, "/x/a.pdf", {"xlsx": "o.xlsx"})
    assert h.snapshot(a["id"]) == '{"p": 1}' and {r["nom"] for r in h.entries(1).collect()} == {"A", "Projet sans nom"}
    assert h.remove(a["id"]) and not h.remove(a["id"]) and h.snapshot(a["id"]) is None
    add(*((f"n{i:02d}", "f", 0.0, 0.0, None, None) for i in range(MOST)))
    assert h.entries().count() == MOST and "B" not in {r["nom"] for r in h.entries().collect()}


def test_dxf_source(spark, tmp_path):
    from quantiva.sources import dxf

    draw = lambda *p: "\r\n".join(map(str, p)) + "\r\n"
    insert = (0, "INSERT", 66, 1, 8, "STRUCT-RDC", 2, "POTEAU P3", 10, 5, 20, 6, 0, "ATTRIB", 8, "x", 10, 9, 20, 9, 1, "25x30", 2, "SECTION", 0, "ATTRIB", 2, "NIVEAU", 1, "RDC", 0, "SEQEND", 8, "0")
    shapes = (0, "LWPOLYLINE", 8, "VOILE R+1", 10, 0, 20, 0, 10, 3000, 20, 0, 10, 3000, 20, 4000, 0, "POLYLINE", 8, "DALLE", 10, 0, 20, 0, 0, "VERTEX", 10, 1, 20, 2, 0, "VERTEX", 10, 4, 20, 6, 0, "SEQEND", 0, "LINE", 8, "POUTRE", 10, 0, 20, 0, 11, 600, 21, 0, 0, "LINE", 8, "POUTRE", 10, 0, 20, 0, 11, 10, 21, 0, 0, "LINE", 8, "AXES", 10, 0, 20, 0, 11, 9999, 21, 0)
    texts = (0, "TEXT", 8, "TOITURE", 1, " P1 (25X35)", 10, 1.5, 20, 2, 11, 7, 21, 7, 0, "MTEXT", 8, "0", 3, "BN2 ", 1, "20x40x300", 10, 1, 20, 1, 0, "TEXT", 8, "0", 1, "note", 10, 0, 20, 0, 0, "DIMENSION", 8, "COTES", 42, 3.25, 10, 1, 20, 1)
    head = (0, "SECTION", 2, "TABLES", 0, "TABLE", 2, "LAYER", 0, "LAYER", 2, "VOILE R+1", 0, "ENDTAB", 0, "ENDSEC", 0, "SECTION", 2, "BLOCKS", 0, "BLOCK", 2, "POTEAU P3", 0, "TEXT", 1, "P9", 0, "ENDBLK", 0, "ENDSEC", 0, "SECTION", 2, "ENTITIES")
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.dxf").write_bytes(draw(*head, *insert, *shapes, *texts, 0, "ENDSEC", 0, "EOF").encode() + b"")
    (tmp_path / "sub/b.DXF").write_bytes(draw(*head, 0, "TEXT", 8, "S", 1, "S2", 10, 1, 20, 1).encode() + b"oops\r\nx\r\n" + draw(0, "TEXT", 1, "S3").encode())
    (tmp_path / "c.dxf").write_bytes(b"")
    (tmp_path / "d.dxf").write_bytes(draw(*head, 0, "TEXT", 8, "é").encode("latin-1") + b"0")
    got = dxf.read(spark, str(tmp_path))
    kinds = {}
    for r in got.collect():
        kinds.setdefault(r["file"].rpartition("/")[2], []).append(r["kind"])
    assert kinds["a.dxf"] == ["LAYER", "BLOCK", "INSERT", "LWPOLYLINE", "POLYLINE", "LINE", "LINE", "LINE", "TEXT", "MTEXT", "TEXT", "DIMENSION"] and kinds["b.DXF"] == ["LAYER", "BLOCK", None] and "c.dxf" not in kinds
    by = {(r["kind"], r["seq"]): r for r in got.filter("file like '%a.dxf'").collect()}
    assert by["INSERT", 2]["attributes"] == {"SECTION": "25x30", "NIVEAU": "RDC"} and by["INSERT", 2]["layer"] == "STRUCT-RDC" and by["INSERT", 2]["xs"] == [5.0]
    assert by["MTEXT", 9]["text"] == "BN2 20x40x300" and by["TEXT", 8]["xs"] == [1.5] and by["DIMENSION", 11]["measure"] == 3.25
    e = {r["reference"]: r for r in dxf.elements(got).collect()}
    assert {k: (r["family"], r["level"], r["sides"], r["length"], r["confidence"]) for k, r in e.items()} == {
        "BLOC-POTEAU P3": ("POTEAUX", "RDC", None, None, 0.6), "P1": ("POTEAU", "TOIT", "25x35", None, 0.7), "BN2": ("POUTRE", "INCONNU", "20x40x300", None, 0.7),
        "GEO-1": ("VOILES", "R+1", None, 7.0, 0.4), "GEO-2": ("DALLE", "INCONNU", None, 0.01, 0.4), "GEO-3": ("POUTRES", "INCONNU", None, 0.6, 0.3),
    }
    state = {r["file"].rpartition("/")[2]: (r["elements"], r["partial"], r["problem"]) for r in dxf.extract(spark, f"file://{tmp_path}").collect()}
    assert state["a.dxf"] == (6, False, None) and state["b.DXF"][:2] == (0, True) and "oops" in state["b.DXF"][2] and state["d.dxf"][1]
    assert [r["file"] for r in dxf.extract(spark, f"{tmp_path}/a*.dxf").collect()] == [f"{tmp_path}/a.dxf"]


def test_plans_of_a_folder(spark, tmp_path):
    import json

    from quantiva.sources import plans

    draw = lambda *p: "\n".join(map(str, p)) + "\n"
    head = (0, "SECTION", 2, "ENTITIES")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.dxf").write_text(draw(*head, 0, "TEXT", 8, "RDC", 1, "P1", 10, 1, 20, 2, 0, "ENDSEC"))
    (tmp_path / "broken.dxf").write_text(draw(*head, 0, "TEXT", 8, "x", 1, "P2", 10, 1, 20, 2, 0, "LINE") + "?\n1\n")
    (tmp_path / "m.IFC").write_text(IFC.replace("angle; (1)", "angle (1)"))
    words = [(1, 1, "A", 100, 50), (1, 2, "B", 200, 50), (1, 3, "S1(90x90x25)", 110, 300), (1, 4, "Plancher RDC", 5, 5), (2, 1, "P9", 5, 5), (2, 2, None, 1, 1)]
    lines = [json.dumps({"page": p, "id": i, "text": t, "x": x, "y": y, "x1": x + 8, "y1": y + 8}) for p, i, t, x, y in words]
    (tmp_path / "w.words.json").write_text("\n".join([*lines, "{not json"]))
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    (tmp_path / "empty.dxf").write_bytes(b"")
    elements, documents = plans.extract(spark, str(tmp_path))
    got = {(r["file"].rpartition("/")[2], r["reference"]): r for r in elements.collect()}
    assert set(got) == {("a.dxf", "P1"), ("broken.dxf", "P2"), ("m.IFC", "N1"), ("m.IFC", "N2"), ("m.IFC", "P1"), ("w.words.json", "S1"), ("w.words.json", "P9")}
    assert got["a.dxf", "P1"]["level"] == "RDC" and got["m.IFC", "N1"]["sides"] == "25x40" and got["m.IFC", "N1"]["length"] == 4.5
    assert (got["w.words.json", "S1"]["sides"], got["w.words.json", "S1"]["level"], got["w.words.json", "P9"]["level"], got["w.words.json", "P9"]["page"]) == ("90x90x25", "RDC", None, 2)
    state = {r["file"].rpartition("/")[2]: (r["kind"], r["elements"], r["partial"], r["problem"]) for r in documents.collect()}
    assert state["a.dxf"] == ("DXF", 1, False, None) and state["broken.dxf"][:3] == ("DXF", 1, True) and state["m.IFC"] == ("IFC", 3, True, "1 statements can't be read")
    assert state["w.words.json"] == ("WORDS", 2, True, "1 words can't be read") and state["scan.pdf"] == ("PDF_VECTORIEL", 0, True, "no reader for PDF_VECTORIEL") and len(state) == 5
    (tmp_path / "none").mkdir()
    (tmp_path / "none/x.txt").write_text("x")
    assert [tuple(r)[1:] for r in plans.extract(spark, f"{tmp_path}/none")[1].collect()] == [("UNKNOWN", 0, "no reader for UNKNOWN", True)]
