"""Queries from the words of pages to placed elements and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import detail_pages, placing
from .carriers import read
from .registry import query


def plan_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a supplier's page: names of axes, labels of all kinds, and words that are none; lines are in no order.

    A word is made once, as an element of an array, so that what asks for its text does not repeat how it is made.
    """
    line, p, o, q = read(spark, sf, "lineitem"), F.col("l_partkey"), F.col("l_orderkey"), F.col("q")
    ident = o * 10_000_000 + p * 8 + F.col("l_linenumber")
    line = line.withColumn("q", F.col("l_quantity").cast("bigint")).select("l_suppkey", "l_partkey", "l_orderkey", ident.alias("id"), "q", F.col("l_returnflag").alias("flag"), F.explode(F.array(F.struct((q % 9).cast("int").alias("kind"), (p * F.col("l_suppkey") % 20).alias("axis"), (p % 30).cast("string").alias("n")))).alias("w"))
    axis, n, kind = F.col("w.axis"), F.col("w.n"), F.col("w.kind")
    text = F.when(kind == 0, F.chr(65 + axis)).when(kind == 1, (1 + axis).cast("string")).when(kind == 2, F.concat(F.lit(" S"), n)).when(kind == 3, F.concat(F.lit("P"), n, F.lit("(25x35)")))
    text = text.when(kind == 4, F.concat(F.lit("n"), n, F.lit("BIS-(25X40)"))).when(kind == 5, F.concat(F.lit("(S"), n, F.lit(", 0"), (o % 20).cast("string"), F.lit(")"))).when(kind == 6, "D3 (20x10)").when(kind == 7, "plan").otherwise("S2(90x90)")
    x = F.when(kind == 0, axis * 50 + o % 5).when(kind == 1, 500 + o % 3 * 60).otherwise(p * 37 % 1000)
    y = F.when(kind == 0, o % 3 * 60 + 10).when(kind == 1, 200 + axis * 40 + o % 5).otherwise(200 + o * 53 % 800)
    made = line.select((F.col("l_suppkey") % 7).alias("doc"), F.col("l_suppkey").alias("page"), "id", "q", "flag", F.explode(F.array(F.struct(text.alias("text"), x.alias("x"), y.alias("y")))).alias("w"))
    x, y = F.col("w.x"), F.col("w.y")
    return made.select("doc", "page", "id", "w.text", "w.x", "w.y", (x + 10 + q).alias("x1"), (y + 8).alias("y1"), "flag")


def table_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of the same pages: they begin at some of the words that are no labels."""
    w = plan_words(spark, sf).filter("text = 'plan' and flag = 'A'")
    return w.select("doc", "page", F.col("x").alias("zx0"), F.col("y").alias("zy0"), (F.col("x") + 60).alias("zx1"), (F.col("y") + 40).alias("zy1"))


_PLAN = """with l as (select l_suppkey % 7 doc, l_suppkey page, l_orderkey * 10000000 + l_partkey * 8 + l_linenumber id, l_partkey p, l_orderkey o, l_quantity::bigint q, l_partkey * l_suppkey % 20 axis, l_quantity::bigint % 9 kind, l_returnflag flag from lineitem),
w as (select *, case kind when 0 then axis * 50 + o % 5 when 1 then 500 + o % 3 * 60 else p * 37 % 1000 end x, case kind when 0 then o % 3 * 60 + 10 when 1 then 200 + axis * 40 + o % 5 else 200 + o * 53 % 800 end y from l),
z as (select page, x zx0, y zy0, x + 60 zx1, y + 40 zy1 from w where kind = 7 and flag = 'A'),
free as (select * from w where kind between 2 and 6 and not exists (select 1 from z where z.page = w.page and w.x + (10 + w.q) / 2.0 between zx0 - 10 and zx1 + 10 and w.y + 4 between zy0 - 10 and zy1 + 10)),
seen as (select distinct page, kind, axis key, case kind when 0 then x else y end pos, case kind when 0 then round_even(y / 40.0, 0) else round_even(x / 40.0, 0) end band from w where kind < 2),
keys as (select page, kind, band, key, key - row_number() over (partition by page, kind, band order by key) run from (select distinct page, kind, band, key from seen)),
good as (select page, kind, band, key from (select *, count(*) over (partition by page, kind, band, run) long from keys) where long > 1 or (page, kind) in (select (page, kind) from keys group by page, kind having count(distinct key) = 1)),
axes as (select distinct page, kind, pos, case kind when 0 then chr((65 + key)::int) else (1 + key)::varchar end as name from seen join good using (page, kind, band, key)),
hits as (select doc, page, id, x, y, false coupled, 0 k, case kind when 2 then 'S' || (p % 30) when 3 then 'P' || (p % 30) when 4 then 'N' || (p % 30) || 'BIS' else 'D3' end as ref, case kind when 2 then 'semelles' when 3 then 'poteaux' when 4 then 'poutres' else 'dalles' end family, case kind when 3 then '25x35' when 4 then '25x40' when 6 then '20x10' end sides from free where kind <> 5
  union all select doc, page, id, x, y, true, 0, 'S' || (p % 30), 'semelles', null from free where kind = 5 union all select doc, page, id, x, y, true, 1, 'Q' || (o % 20), 'poteaux', null from free where kind = 5),
near as (select page, pos_x, kind, (min(row(abs(pos - pos_x), pos, name))) b from (select distinct page, x pos_x, 0 kind from hits union select distinct page, y, 1 from hits) join axes using (page, kind) group by page, pos_x, kind) """


@query("h13_placements", _PLAN + "select doc, hits.page, id, k::int k, ref, family, (row_number() over (partition by doc, ref order by hits.page, coupled, id, k))::int number_in_doc, a.b[3] letter, n.b[3] number, x, y, sides from hits left join near a on a.page = hits.page and a.pos_x = x and a.kind = 0 left join near n on n.page = hits.page and n.pos_x = y and n.kind = 1")
def h13_placements(spark, sf):
    """Labels outside tables, each on its nearest axes; coupled labels are two elements."""
    return placing.placements(plan_words(spark, sf), table_zones(spark, sf))


def schedule_words(spark: SparkSession, sf: str) -> DataFrame:
    """An order's page with a table of footings: a column for each of its lines, some of which stand below the header."""
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    q = F.col("l_quantity").cast("bigint")
    c = read(spark, sf, "lineitem").withColumns({"c": F.row_number().over(at).cast("bigint"), "q": q})
    low = (F.col("l_returnflag") == "A") & (F.col("c") > 1)
    c = c.withColumns({"hx": 100 + F.col("c") * 60, "hy": F.when(low, F.lit(320)).otherwise(300 + F.col("c") % 3)})
    s, t = lambda v: v.cast("string"), lambda *v: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in v))
    q, n = F.col("q"), F.col("c")
    own = [t("S", s(n)), F.when(q % 5 > 0, t(s(20 + q), "x", s(30 + q))).otherwise("-"), s(10 + q % 40), F.when(F.col("l_linestatus") == "O", t(s(2 + n), "HA", s(8 + 2 * (q % 4)))).otherwise("-"), t(s(3 + n), "t10")]
    places = [(0, 0), (3, 40), (-2, 440), (0, 510), (1, 610)]  # to the right of the header, and below it or the page's edge
    lines = [("H", 1500, 441), ("Ferraillage", 40, 500), ("selon", 60, 505), ("x", 80, 515), ("ferraillages", 40, 600), ("Selon", 60, 605), ("Y", 80, 615)]
    # one expression for all words of a line, so that it is small enough to be compiled
    shared = F.when(n == 1, F.array(*(F.lit(v[0]) for v in lines))).otherwise(F.array().cast("array<string>"))
    each = c.select("l_orderkey", "c", "hx", "hy", F.posexplode(F.concat(F.array(*own), shared)).alias("i", "text"))
    right, down = (F.array(*(F.lit(float(v)) for v in vs))[F.col("i")] for vs in zip(*places, *(v[1:] for v in lines), strict=True))
    mine, i = F.col("i") < len(own), F.col("i").cast("bigint")
    ident = F.when(mine, n * 100 + i + 1).otherwise(i - len(own) + 1)
    return each.select(F.lit(0).alias("doc"), F.col("l_orderkey").alias("page"), F.lit(10.0).alias("eps"), ident.alias("id"), "text", (F.when(mine, F.col("hx")).otherwise(0) + right).alias("x"), (F.when(F.col("i") < 2, F.col("hy")).otherwise(0) + down).alias("y"))


_METRES = "case when {0} > 10 then round(({0}) / 100.0, 4)::double else ({0})::double end"


@query("h7_borderless_tables", "with c as (select l_orderkey page, l_quantity::bigint q, l_linestatus s, l_returnflag f, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) c, count(*) over (partition by l_orderkey) n from lineitem) select 0 doc, page, 'S' || c as ref, case when q % 5 > 0 then " + _METRES.format("20 + q") + " end a, case when q % 5 > 0 then " + _METRES.format("30 + q") + " end b, " + _METRES.format("10 + q % 40") + " h, case when s = 'O' then (2 + c) || 'HA' || (8 + 2 * (q % 4)) end bars_x, (3 + c) || 'T10' bars_y from c where n > 1 and (f <> 'A' or c = 1)")
def h7_borderless_tables(spark, sf):
    """Footings of tables without borders come back as their columns were written; columns off the header's line don't."""
    return placing.borderless_tables(schedule_words(spark, sf))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of an order, numbered: ``page, c, q`` and their flags."""
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return read(spark, sf, "lineitem").select(F.lit(0).alias("doc"), F.col("l_orderkey").alias("page"), F.row_number().over(at).cast("bigint").alias("c"), F.col("l_quantity").cast("bigint").alias("q"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"))


_LINE = "l as (select l_orderkey page, l_quantity::bigint q, l_returnflag flag, l_linestatus state, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) c, count(*) over (partition by l_orderkey) n from lineitem)"


def _spread(lines: DataFrame, x: Column, y: Column, words: list[tuple[int, Column, int, int]]) -> DataFrame:
    """Words (number, text or null, place from x and y) of each line; small code per word, so that it is compiled."""
    numbers, _, right, down = zip(*words, strict=True)
    each = lines.select("doc", "page", "c", x.cast("double").alias("x"), y.cast("double").alias("y"), F.posexplode(F.array(*(w[1] for w in words))).alias("i", "text")).filter("text is not null")
    of = lambda values, kind: F.array(*(F.lit(v).cast(kind) for v in values))[F.col("i")]
    return each.select("doc", "page", (F.col("c") * 100 + of(numbers, "bigint")).alias("id"), "text", (F.col("x") + of(right, "double")).alias("x"), (F.col("y") + of(down, "double")).alias("y"))


def beam_words(spark: SparkSession, sf: str) -> DataFrame:
    """Details of beams, 800 px apart: labels with and without sections, bars below and above, drops, stirrups."""
    c, q = F.col("c").cast("string"), F.col("q")
    s, t = lambda v: v.cast("string"), lambda *v: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in v))
    x, y = F.col("c") * 800, F.lit(500)
    label = F.when(q % 4 == 0, t("N", c)).when(q % 4 == 1, t("n", c, "-(", s(20 + q), "X40)")).when(q % 4 == 2, t("PN", c, " (", s(20 + q), "x35)")).otherwise(t("BN", c, "/LG", c))
    return _spread(_lines(spark, sf), x, y, [
        (1, label, 0, 0), (2, F.when(q % 3 > 0, t("(", s(30 + q), "x50)")), 5, -20), (3, F.lit("90x90"), 5, 20), (4, t(s(2 + q % 5), "HA", s(10 + q % 3)), 0, 30), (5, t(s(2 + q % 5), "ha", s(10 + q % 3)), 9, 31),
        (6, F.when(F.col("flag") == "A", F.lit("bateau")), -100, -60), (7, t("3T", s(8 + q % 4)), -30, -50), (8, t("CHAP. ", s(q), "T8"), 10, 90), (9, F.when(F.col("state") == "O", t("Cad T", s(6 + q % 3))), 40, 110),
        (10, F.when(q % 2 == 0, F.lit("e=(12x9 symet)")), 60, 120), (11, F.lit("esp = 17,5"), 60, 130), (12, F.lit("e=99"), 60, 180),
    ])


_BEAM = f"with {_LINE}, r as (select *, case q % 4 when 0 then 'N' || c when 1 then 'N' || c when 2 then 'PN' || c else 'BN' || c end as ref, 0 other from l union all select *, 'LG' || c, 1 from l where q % 4 = 3) "


@query("h16_beam_pages", _BEAM + "select 0 doc, page, ref, case when q % 4 in (1, 2) then round((20 + q) / 100.0, 4) when q % 3 > 0 then round((30 + q) / 100.0, 4) end::double b, case q % 4 when 1 then 0.4 when 2 then 0.35 else case when q % 3 > 0 then 0.5 end end::double h, case when q % 4 in (1, 2) then 'label' when q % 3 > 0 then 'heuristic' end source, case when other = 0 then (2 + q % 5) || 'T' || (10 + q % 3) else '' end as lower, case when other = 0 then case when flag = 'A' then q || 'T8' else concat_ws('+', '3T' || (8 + q % 4), case when not (q = 3 and q % 4 = 0) then q || 'T8' end) end else '' end as upper, case when state = 'O' then (6 + q % 3)::int end phi, case when state = 'O' then case when q % 2 = 0 then 0.12 else 0.175 end end::double spacing from r")
def h16_beam_pages(spark, sf):
    """Beams of pages of details, against what each detail was written with."""
    return detail_pages.beam_pages(beam_words(spark, sf))


def column_words(spark: SparkSession, sf: str) -> DataFrame:
    """Columns, 300 px apart: a table of those on one line, and some that stand below with their own details."""
    c, q = F.col("c").cast("string"), F.col("q")
    s, t = lambda v: v.cast("string"), lambda *v: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in v))
    own = F.col("flag") == "A"
    x, y = F.col("c") * 300, F.when(own, 1000).otherwise(100)
    only = lambda when, v: F.when(when, v)
    return _spread(_lines(spark, sf), x, y, [
        (1, t("P", c), 0, 0), (2, only(~own, t(s(2 + q % 9), "T12")), 3, 22), (3, only(~own & (q % 5 > 0), s(15 + q)), -4, 38), (4, only(~own, s(25 + q)), 0, 58), (5, only(~own & (q % 2 == 0), t("T", s(6 + q % 3), "+Ep")), 0, 72),
        (6, only(~own & (q % 4 == 0), F.lit("e=12.5")), 4, 80), (7, only(own, t("(", s(20 + q), "x30)")), 20, 10), (8, only(own, t(s(4 + q % 3), "HA14 + 2T10")), 0, 20), (9, only(own & (q % 2 == 1), t("Cad. T", s(8 + q % 2))), 0, 40), (10, only(own & (q % 3 == 0), F.lit("Esp=20")), 0, 50),
    ])


_COLUMN = f"with {_LINE}, m as (select *, count(*) filter (flag <> 'A') over (partition by page) heads, count(*) filter (flag = 'A') over (partition by page) own from l) "


@query("h15_column_pages", _COLUMN + "select 0 doc, page, 'P' || c as ref, case when flag = 'A' then round((20 + q) / 100.0, 4) when q % 5 > 0 then round((15 + q) / 100.0, 4) end::double a, case when flag = 'A' then 0.3 else round((25 + q) / 100.0, 4) end::double b, case when flag = 'A' then 'label' else 'heuristic' end source, case when flag = 'A' then (4 + q % 3) || 'T14+2T10' else (2 + q % 9) || 'T12' end bars, case when flag = 'A' then case when q % 2 = 1 then 8 + q % 2 end when q % 2 = 0 then 6 + q % 3 end::int phi, case when flag = 'A' then case when q % 2 = 1 then case when q % 3 = 0 then 0.2 else 0.0 end end when q % 2 = 0 then case when q % 4 = 0 then 0.125 else 0.0 end end::double spacing from m where flag = 'A' or heads >= 3")
def h15_column_pages(spark, sf):
    """Columns of tables and of single details, against what each was written with."""
    return detail_pages.column_pages(column_words(spark, sf))
