"""Queries of ordered operators, spatial joins, search and windowed streams on points, pages and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordered, search, spatial
from .carriers import CTE, placements, points, read
from .registry import query

W = f"with {CTE} "


@query("w1_gap_clusters", W + "select id, sum(flag) over (partition by ref order by page, y, id)::bigint as cluster from (select *, case when lag(page) over w is null or lag(page) over w <> page or y - lag(y) over w >= 4000 then 1 else 0 end flag from points window w as (partition by ref order by page, y, id))")
def w1_gap_clusters(spark, sf):
    gap = (F.col("lag_page") != F.col("page")) | (F.col("y") - F.col("lag_y") >= 4000)
    return ordered.gap_clusters(points(spark, sf), ["ref"], ["page", "y", "id"], gap).select("id", "cluster")


@query("w2_y_bands", W + ", f as (select *, case when lag(y) over w is null or y - lag(y) over w > 1000 then 1 else 0 end flag from points window w as (partition by page order by y, id)), b as (select *, sum(flag) over (partition by page order by y, id) band from f) select page, band::bigint band, min(y) lo, max(y) hi, count(*) n from b group by page, band")
def w2_y_bands(spark, sf):
    c = ordered.gap_clusters(points(spark, sf), ["page"], ["y", "id"], F.col("y") - F.col("lag_y") > 1000, "band")
    return c.groupBy("page", "band").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.count("*").alias("n"))


@query("w5_axis_runs", W + ", d as (select distinct project % 500 as lot, type % 40 axis from placements), i as (select *, axis - dense_rank() over (partition by lot order by axis) isl from d), s as (select *, count(*) over (partition by lot, isl) n, count(*) over (partition by lot) m from i) select lot, axis from s where n >= 2 or m = 1")
def w5_axis_runs(spark, sf):
    d = placements(spark, sf).select((F.col("project") % 500).alias("lot"), (F.col("type") % 40).alias("axis")).distinct()
    s = ordered.islands(d, ["lot"], "axis")
    n, m = F.count("*").over(Window.partitionBy("lot", "island")), F.count("*").over(Window.partitionBy("lot"))
    return s.withColumns({"n": n, "m": m}).filter("n >= 2 or m = 1").select("lot", "axis")


@query("w6_pair_scale", W + "select id, round(dy / dx, 3) estimate from (select id, x - lag(x) over w dx, (y - lag(y) over w)::double dy from points window w as (partition by ref order by page, y, id)) where dx > 5")
def w6_pair_scale(spark, sf):
    w = Window.partitionBy("ref").orderBy("page", "y", "id")
    p = points(spark, sf).select("id", (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).cast("double").alias("dy"))
    return p.filter("dx > 5").select("id", F.round(F.col("dy") / F.col("dx"), 3).alias("estimate"))


@query("w7_cumulative_axes", W + "select project, inst, type, sum(qty) over (partition by project order by inst, type, qty rows unbounded preceding)::bigint pos from placements")
def w7_cumulative_axes(spark, sf):
    w = Window.partitionBy("project").orderBy("inst", "type", "qty").rowsBetween(Window.unboundedPreceding, 0)
    return placements(spark, sf).select("project", "inst", "type", F.sum("qty").over(w).alias("pos"))


@query("w9_anchor_zones", W + "select id, (lag(y) over w + y) / 2.0 zone_lo, (y + lead(y) over w) / 2.0 zone_hi from (select * from points where family = 'signup') window w as (partition by page order by y)")
def w9_anchor_zones(spark, sf):
    a = ordered.anchor_zones(points(spark, sf).filter("family = 'signup'"), ["page"], "y", "id")
    return a.select("id", F.col("zone_lo").cast("double").alias("zone_lo"), F.col("zone_hi").cast("double").alias("zone_hi"))


@query("w10_first_anchor", W + "select page, family, min(id) id from points group by page, family")
def w10_first_anchor(spark, sf):
    return points(spark, sf).groupBy("page", "family").agg(F.min("id").alias("id"))


@query("w13_instance_ids", W + "select project, inst, type, row_number() over (partition by type order by project, inst, level, qty)::int no from placements")
def w13_instance_ids(spark, sf):
    return placements(spark, sf).withColumn("no", F.row_number().over(Window.partitionBy("type").orderBy("project", "inst", "level", "qty"))).select("project", "inst", "type", "no")


@query("s18_section_ffill", "select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) section from conversations")
def s18_section_ffill(spark, sf):
    c = read(spark, sf, "conversations")
    return ordered.forward_fill(c, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "section").select("conv_id", "turn", "section")


_ANCHORS = W + ", r as (select * from points where family = 'signup'), l as (select * from points where family = 'error'), p as (select l.id, r.id r_id, (l.x - r.x) * (l.x - r.x) + ((l.y - r.y) * 0.01) * ((l.y - r.y) * 0.01) d2 from l join r using (page) where (l.x - r.x) * (l.x - r.x) + ((l.y - r.y) * 0.01) * ((l.y - r.y) * 0.01) <= 100) "


def _pairs(spark, sf):
    p = points(spark, sf).select("id", "family", "page", "x", "y")
    return spatial.radius_join(p.filter("family = 'error'"), p.filter("family = 'signup'"), ["page"], 10.0, scale=(1.0, 0.01))


@query("j6_nn_join", _ANCHORS + "select id, r_id from (select *, row_number() over (partition by id order by round(d2, 6), r_id) k from p) where k = 1")
def j6_nn_join(spark, sf):
    return spatial.nearest(_pairs(spark, sf).withColumn("d2", F.round("d2", 6)), "id", "r_id").select("id", "r_id")


@query("j7_knn", _ANCHORS + "select id, r_id, k::int k from (select *, row_number() over (partition by id order by round(d2, 6), r_id) k from p) where k <= 3")
def j7_knn(spark, sf):
    return spatial.nearest(_pairs(spark, sf).withColumn("d2", F.round("d2", 6)), "id", "r_id", 3).select("id", "r_id", F.col("rank").alias("k"))


@query("j8_radius_join", _ANCHORS + "select id, count(*) n from p group by id")
def j8_radius_join(spark, sf):
    return _pairs(spark, sf).groupBy("id").agg(F.count("*").alias("n"))


@query("j10_mutual_best", _ANCHORS + "select id, r_id from (select *, row_number() over (partition by id order by round(d2, 6), r_id) a, row_number() over (partition by r_id order by round(d2, 6), id) b from p) where a = 1 and b = 1")
def j10_mutual_best(spark, sf):
    p = points(spark, sf).select("id", "family", "page", "x", "y")
    return spatial.mutual_nearest(p.filter("family = 'error'"), p.filter("family = 'signup'"), ["page"], 10.0, (1.0, 0.01))


@query("j19_proximity_semi", _ANCHORS + "select distinct id from p")
def j19_proximity_semi(spark, sf):
    return _pairs(spark, sf).select("id").distinct()


@query("f3_in_zone", W + "select id from points where x between 10 and 40 and y between 20000 and 60000")
def f3_in_zone(spark, sf):
    return points(spark, sf).filter("x between 10 and 40 and y between 20000 and 60000").select("id")


@query("f1_cartouche", W + "select id from points where not (x > 75 and y > 69120 or family = 'error')")
def f1_cartouche(spark, sf):
    return points(spark, sf).filter("not (x > 75 and y > 69120 or family = 'error')").select("id")


@query("r3_cosine_topk", "with q as (select embedding e from embeddings where vec_id = 0), s as (select vec_id, round(list_cosine_similarity(embedding::double[], (select e from q)::double[]), 4) score from embeddings where label = 1) select vec_id, score from s order by score desc, vec_id limit 3")
def r3_cosine_topk(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    q = F.broadcast(e.filter("vec_id = 0").limit(1).select(F.col("v").alias("q")))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    score = F.round(dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q")), 4)
    return e.filter("label = 1").join(q).select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(3)


@query("r3_cosine_topk_all", "with s as (select q.vec_id query, e.vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 4) score from embeddings e, embeddings q where q.vec_id % 50 = 0 and (e.label = 1 or (select count(*) from embeddings) <= 10)), r as (select *, row_number() over (partition by query order by score desc, vec_id) k from s) select query, vec_id, score from r where k <= 3")
def r3_cosine_topk_all(spark, sf):
    """Every vector whose id is divisible by 50 is a query; the filter holds for more than ten vectors."""
    e = read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    n = F.broadcast(e.agg(F.count("*").alias("n")))  # one row
    return search.cosine_topk(e.join(n).filter("label = 1 or n <= 10"), e.filter("vec_id % 50 = 0"), 3)


@query("w11_words_to_lines", W + "select page, y // 600 line, string_agg(cast(ref as varchar), ' ' order by x, id) words from points group by page, y // 600")
def w11_words_to_lines(spark, sf):
    p = points(spark, sf).groupBy("page", F.floor(F.col("y") / 600).alias("line")).agg(F.array_sort(F.collect_list(F.struct("x", "id", "ref"))).alias("ws"))
    return p.select("page", "line", F.array_join(F.transform("ws", lambda w: w["ref"].cast("string")), " ").alias("words"))


@query("g9_shoelace", W + ", v as (select ref, x, y, lead(x) over w nx, lead(y) over w ny, first_value(x) over w fx, first_value(y) over w fy from points where family = 'view' window w as (partition by ref order by id)) select ref, round(abs(sum(cast(x as decimal(12,2)) * coalesce(ny, fy) - cast(coalesce(nx, fx) as decimal(12,2)) * y))::double / 2, 3) area from v group by ref")
def g9_shoelace(spark, sf):
    w = Window.partitionBy("ref").orderBy("id")
    v = points(spark, sf).filter("family = 'view'").select("ref", "x", "y", F.coalesce(F.lead("x").over(w), F.first("x").over(w)).alias("nx"), F.coalesce(F.lead("y").over(w), F.first("y").over(w)).alias("ny"))
    cross = F.col("x").cast("decimal(12,2)") * F.col("ny") - F.col("nx").cast("decimal(12,2)") * F.col("y")
    return v.groupBy("ref").agg(F.round(F.abs(F.sum(cross)).cast("double") / 2, 3).alias("area"))
