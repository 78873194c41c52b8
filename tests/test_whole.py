"""Queries over whole tables: nothing of the input is left out unseen."""

import pytest

from quantiva.plans import ordered_queries, registry, relational_queries  # noqa: F401

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A few placements (project, inst, type, source, quantity) of types 1 to 4 and 9, and a catalogue of 1 to 5."""
    top = str(tmp_path_factory.mktemp("tables"))
    lines = [(1, 1, 1, "F", 7), (1, 6, 2, "F", 30), (1, 7, 7, "O", 2), (1, 7, 2, "O", 50), (2, 1, 3, "O", 1), (2, 2, 9, "F", 3), (3, 5, 10, "F", 4), (3, 6, 1, "F", 4)]
    line = [(p, i, t, "A", s, float(q), 1) for p, i, t, s, q in lines]
    spark.createDataFrame(line, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_returnflag string, l_linestatus string, l_quantity double, l_suppkey bigint").write.parquet(f"{top}/lineitem.parquet")
    part = [(t, "SMALL", 10, 100.0 + t) for t in (1, 2, 3, 5, 7, 10)]
    spark.createDataFrame(part, "p_partkey bigint, p_type string, p_size int, p_retailprice double").write.parquet(f"{top}/part.parquet")
    return top


def got(spark, name, top, *cols):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, top).select(*cols).collect())


def test_pivot_keeps_all_columns(spark, tables):
    rows = {r["project"]: r for r in registry.QUERIES["h3_cells_pivot_all"](spark, tables).collect()}
    assert [rows[1][f"c{i}"] for i in range(1, 8)] == [1, None, None, None, None, 2, 7]
    assert [rows[k]["left_out"] for k in (1, 2, 3)] == [1, 0, 0] and rows[3]["c5"] == 10
    seen = sum(1 for r in registry.QUERIES["h3_cells_pivot_all"](spark, SMALL).collect() for v in r[1:8] if v is not None)
    assert seen == spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()


def test_every_search_is_answered(spark, tmp_path):
    vectors = [(i, [float(i % 7 - 3), float(i % 11), 1.0], i % 3) for i in range(1, 201)] + [(250, [0.0, 0.0, 0.0], 1)]  # none with id 0
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = got(spark, "r3_cosine_topk_all", str(tmp_path), "query", "score", "vec_id")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    by = {i: v for i, v, _ in vectors}
    want = [(q, *x) for q in (50, 100, 150, 200) for x in sorted(((round(cos(by[q], v), 4), i) for i, v, label in vectors if label == 1 and any(v)), key=lambda x: (-x[0], x[1]))[:3]]
    assert rows == sorted(want)
    few = [(50, [1.0, 0.0], 0), (51, [1.0, 0.1], 0)]
    spark.createDataFrame(few, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/few/embeddings.parquet")
    assert [r[2] for r in got(spark, "r3_cosine_topk_all", f"{tmp_path}/few", "query", "score", "vec_id")] == [51, 50]


def test_all_placements_and_catalogue(spark, tables):
    plan, table = {(1, 1), (1, 2), (2, 9), (3, 10), (3, 1)}, {(1, 7), (1, 2), (2, 3)}
    ref = ("project", "type")
    assert got(spark, "u1_set_difference_all", tables, *ref, "side") == sorted([(*x, "plan_only") for x in plan - table] + [(*x, "table_only") for x in table - plan])
    assert got(spark, "u2_intersect_all", tables, *ref) == [(1, 2)]
    assert got(spark, "u3_union_all", tables, *ref, "origin") == sorted([(*x, "plan") for x in plan] + [(*x, "table") for x in table])
    side = lambda x: "both" if x in plan & table else "plan_only" if x in plan else "table_only"
    assert got(spark, "j22_plan_table_discrepancy_all", tables, *ref, "side") == sorted((*x, side(x)) for x in plan | table)
    assert got(spark, "j23_orphans_all", tables, "type", "side") == [(5, "unplaced"), (9, "unknown")]
    total = {1: 7 * 101 + 80 * 102 + 2 * 107, 2: 103, 3: 4 * 110 + 4 * 101}  # 7 is in, 9 is unknown
    assert got(spark, "j11_costing_all", tables, "project", "total") == sorted((k, float(v)) for k, v in total.items())
    families = got(spark, "j1_placement_catalogue_all", tables, "type", "family")
    assert len(families) == 8 and {t for t, f in families if f == "inconnu"} == {9} and (10, "chainage") in families
