"""Box geometry, perception post-processing and routing over derived boxes and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import geometry as G, metrics as M, perception as P
from quillon.plans.derived import BOX_SQL, boxes
from quillon.plans.registry import query
from quillon.sources.io import table

W = "(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))"
H = "(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
SHARED = f"(greatest({W}, 0) * greatest({H}, 0))"
TRUTH, FOUND = f"(select * from ({BOX_SQL}) where side = 1)", f"(select * from ({BOX_SQL}) where side = 0)"


def sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    b = boxes(spark, folder)
    return b.where("side = 1").drop("side"), b.where("side = 0").drop("side")


@query(f"select a.page, a.ord as a_ord, b.ord as b_ord, round({SHARED} / (a.w * a.h + b.w * b.h - {SHARED}), 6) as iou from ({BOX_SQL}) a join ({BOX_SQL}) b on a.page = b.page and a.ord < b.ord where {SHARED} > 0")
def box_iou_pairs(spark: SparkSession, folder: str) -> DataFrame:
    b = boxes(spark, folder)
    p = G.meeting(G.prefixed(b, "a_", ["page"]), G.prefixed(b, "b_", ["page"]), ["page"]).where("a_ord < b_ord")
    return p.where(G.overlap("a_", "b_") > 0).select("page", "a_ord", "b_ord", F.round(G.iou("a_", "b_"), 6).alias("iou"))


@query(f"select a.page, a.ord as a_ord, b.ord as b_ord, {SHARED} as shared from {FOUND} a join {TRUTH} b on a.page = b.page where {SHARED} >= b.w * b.h * 0.25")
def overlap_join(spark: SparkSession, folder: str) -> DataFrame:
    truth, found = sides(spark, folder)
    return G.overlapping(found, truth, ["page"], 0.25).select("page", "a_ord", "b_ord", "shared")


@query(
    f"select a.page, a.ord as a_ord, min(b.ord) as region from {FOUND} a left join {TRUTH} b on a.page = b.page and a.x + a.w / 2.0 between b.x and b.x + b.w and a.y + a.h / 2.0 between b.y and b.y + b.h group by a.page, a.ord"
)
def point_in_region_first(spark: SparkSession, folder: str) -> DataFrame:
    truth, found = sides(spark, folder)
    return G.first_containing(found, truth, ["page"], "ord").distinct()


@query(
    f"""with h as (select distinct a.page, a.cat, a.ord, 1 as hit from {TRUTH} a join {FOUND} b on a.page = b.page and a.cat = b.cat where {SHARED} >= a.w * a.h * 0.5),
    r as (select a.cat, coalesce(h.hit, 0) as hit from {TRUTH} a left join h using (page, cat, ord))
    select cat, count(*) as n, cast(sum(hit) as bigint) as found, cast(round(cast(sum(hit) * 100 as decimal(20, 6)) / count(*), 1) as double) as recall_pct from r group by cat"""
)
def element_recall(spark: SparkSession, folder: str) -> DataFrame:
    truth, found = sides(spark, folder)
    return M.recall_percent(G.recalled(truth, found, ["page", "cat"]), ["cat"])


@query(f"select a.page, a.ord as a_ord from {FOUND} a where not exists (select 1 from {TRUTH} b where a.page = b.page and abs(a.x - b.x) <= 40 and abs(a.y - b.y) <= 40 and abs(a.w - b.w) <= 40 and abs(a.h - b.h) <= 40)")
def tolerance_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    truth, found = sides(spark, folder)
    return G.not_near(found, truth, ["page"], 40).select("page", "a_ord")


def sweep(source: str, keys: str) -> str:
    return f"""(with b0 as (select {keys}, greatest(x, 0) as x0, greatest(y, 0) as y0, least(x + w, 600) as x1, least(y + h, 600) as y1 from {source}),
      b1 as (select distinct * from b0 where x1 > x0 and y1 > y0), e as (select {keys}, y0 as lo from b1 union select {keys}, y1 from b1),
      s as (select *, lead(lo) over (partition by {keys} order by lo) as hi from e),
      p as (select {', '.join('b1.' + k.strip() for k in keys.split(','))}, lo, hi, x0, x1 from b1 join s using ({keys}) where hi is not null and y0 <= lo and y1 >= hi),
      r as (select *, max(x1) over (partition by {keys}, lo order by x0, x1 rows between unbounded preceding and 1 preceding) as reach from p)
      select {keys}, cast(sum((hi - lo) * (greatest(x1, coalesce(reach, x0)) - greatest(x0, coalesce(reach, x0)))) as bigint) as area from r group by {keys})"""


@query(f"select * from {sweep(f'({BOX_SQL})', 'page')}")
def union_area(spark: SparkSession, folder: str) -> DataFrame:
    return G.union_area(boxes(spark, folder), ["page"], 600, 600)


@query(
    f"""with g as {sweep(TRUTH, 'page, cat')}, f as {sweep(FOUND, 'page, cat')}, u as {sweep(f'({BOX_SQL})', 'page, cat')},
    t as (select cat, sum(coalesce(g.area, 0)) as gt, sum(coalesce(f.area, 0)) as pred, sum(coalesce(g.area, 0) + coalesce(f.area, 0) - u.area) as inter from u left join g using (page, cat) left join f using (page, cat) group by cat)
    select cat, cast(gt as bigint) as gt, cast(pred as bigint) as pred, cast(inter as bigint) as inter, round(inter / pred, 6) as precision, round(inter / gt, 6) as recall, round(2 * inter / (gt + pred), 6) as f1 from t"""
)
def pixel_prf(spark: SparkSession, folder: str) -> DataFrame:
    truth, found = sides(spark, folder)
    a = G.pixel_areas(truth, found, ["page", "cat"], 600, 600).groupBy("cat").agg(*[F.sum(c).alias(c) for c in ("gt", "pred", "inter")])
    out = M.prf(a, "pred", "gt", "inter")
    return out.select("cat", "gt", "pred", "inter", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"select cat, min(x) as x0, min(y) as y0, max(x + w) as x1, max(y + h) as y1 from ({BOX_SQL}) group by cat")
def bounding_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return G.bounding_box(boxes(spark, folder), ["cat"])


@query(f"select page, ord, cast(row_number() over (partition by page order by w * h desc, ord) as int) as rank from ({BOX_SQL}) qualify row_number() over (partition by page order by w * h desc, ord) <= 3")
def largest_regions(spark: SparkSession, folder: str) -> DataFrame:
    return G.largest(boxes(spark, folder), ["page"], 3).select("page", "ord", "rank")


@query(f"select page, ord, cast(floor(x * 0.625 + 0.5) as int) as x, cast(floor(y * 0.625 + 0.5) as int) as y, cast(floor(w * 0.625 + 0.5) as int) as w, cast(floor(h * 0.625 + 0.5) as int) as h from ({BOX_SQL})")
def scaled_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return G.scaled(boxes(spark, folder), F.lit(0.625)).select("page", "ord", "x", "y", "w", "h")


#: Order-dependent: each round takes the next box of every page and keeps it unless a kept one is near.
NEAR_KEPT = "len(list_filter(kept, lambda k: k.cat = b.cat and abs(k.x - b.x) <= 30 and abs(k.y - b.y) <= 30)) > 0"


@query(
    f"""with recursive b as (select page, ord, cat, x, y, row_number() over (partition by page order by ord, cat, x, y) as n from ({BOX_SQL})),
    f(page, n, kept) as (select distinct page, cast(0 as bigint), cast([] as struct(cat varchar, x int, y int, ord bigint)[]) from b
      union all select b.page, b.n, case when {NEAR_KEPT} then kept else list_append(kept, {{'cat': b.cat, 'x': b.x, 'y': b.y, 'ord': cast(b.ord as bigint)}}) end from f join b on b.page = f.page and b.n = f.n + 1),
    l as (select page, arg_max(kept, n) as kept from f group by page) select page, k.cat as type, k.x as x, k.y as y, k.ord as ord from (select page, unnest(kept) as k from l)"""
)
def fuzzy_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    b = boxes(spark, folder).withColumn("type", F.col("cat"))
    items = F.array_sort(F.collect_list(F.struct("ord", "type", "x", "y")))
    pages = b.groupBy("page").agg(items.alias("items"))
    kept = pages.select("page", F.explode(G.fuzzy_distinct(F.col("items"), pages.schema["items"].dataType.simpleString(), 30)).alias("k"))
    return kept.select("page", "k.type", "k.x", "k.y", F.col("k.ord").cast("long").alias("ord"))


SOFT = "select vec_id, list_transform(embedding, lambda v: cast(v as double) * 20) as l from embeddings"
CLASSES_SQL = f"(select vec_id, list_position(l, list_max(l)) - 1 as pos, 1.0 / list_sum(list_transform(l, lambda v: exp(v - list_max(l)))) as conf from ({SOFT}))"
TAG_SQL = (
    "case when conf < 0.22 then 'blank' when conf < 0.5 then 'uncertain' "
    + " ".join(f"when cls in ({', '.join(map(str, ids))}) then '{t}'" for t, ids in P.CLASS_TAGS.items())
    + " else 'photo' end"
)
TAGS_SQL = f"(select *, {TAG_SQL} as tag from (select vec_id, cast(pos * 14 + 400 as int) as cls, conf from {CLASSES_SQL}))"


def tagged(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of the embeddings, read as logits at temperature 1/20."""
    e = table(spark, folder, "embeddings").select("vec_id", "label", P.top1(F.transform("embedding", lambda v: v.cast("double") * 20)).alias("t"))
    e = e.select("vec_id", "label", (F.col("t.cls") * 14 + 400).alias("cls"), F.col("t.conf").alias("conf"))
    return e.withColumn("tag", P.tag(F.col("cls"), F.col("conf")))


@query(f"select vec_id, cls, round(conf, 6) as conf, tag from {TAGS_SQL}")
def softmax_top1(spark: SparkSession, folder: str) -> DataFrame:
    return tagged(spark, folder).select("vec_id", "cls", F.round("conf", 6).alias("conf"), "tag")


@query(f"select label, tag, count(*) as n from embeddings join {TAGS_SQL} t using (vec_id) group by label, tag")
def tag_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = P.summary(tagged(spark, folder), ["label"])
    return s.select("label", F.explode("summary").alias("tag", "n")).select("label", "tag", F.col("n").cast("long").alias("n"))


def page_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles of a page are its found boxes, tagged by one embedding after another."""
    _, found = sides(spark, folder)
    t = tagged(spark, folder).select(F.col("vec_id").alias("k"), "tag", "conf")
    # vectors are numbered from 0; the last number says how many there are
    n = table(spark, folder, "embeddings").agg((F.max("vec_id") + 1).alias("n"))
    return found.crossJoin(F.broadcast(n)).withColumn("k", (F.col("page") * 7 + F.col("ord")) % F.col("n")).drop("n").join(t, "k")


@query(
    f"""with n as (select max(vec_id) + 1 as n from embeddings), t as (select a.*, v.tag, v.conf from {FOUND} a cross join n join {TAGS_SQL} v on v.vec_id = (a.page * 7 + a.ord) % n),
    p as (select a.page, b.ord as region, b.x as rx, b.y as ry, b.w as rw, b.h as rh, a.tag, row_number() over (partition by a.page, b.ord order by a.conf desc, a.ord, a.tag) as r from t a join {TRUTH} b on a.page = b.page where b.w >= 24 and b.h >= 24 and {SHARED} >= b.w * b.h * 0.25)
    select page, region, tag, tag in ('photo', 'ui', 'document', 'uncertain') as escalate, tag = 'uncertain' as captcha_like from p where r = 1"""
)
def region_decisions(spark: SparkSession, folder: str) -> DataFrame:
    truth, _ = sides(spark, folder)
    return P.decisions(page_tiles(spark, folder), truth, ["page"])


@query(
    f"""with s as (select label, cast(sum(case when tag in ('photo', 'document', 'uncertain') then 1 else 0 end) as int) as n from embeddings join {TAGS_SQL} t using (vec_id) group by label)
    select label, case when label % 4 = 3 then 0 else n + (label % 2) end as complexity, case when label % 4 = 3 or label % 5 = 4 then null when n + (label % 2) > 0 then 'big' else 'small' end as model from s"""
)
def complexity_routing(spark: SparkSession, folder: str) -> DataFrame:
    s = P.summary(tagged(spark, folder), ["label"]).withColumn("enabled", F.col("label") % 4 != 3)
    s = s.withColumn("complexity", P.complexity(F.col("enabled"), F.col("summary"), F.col("label") % 2 == 1, F.lit(False)))
    asked = F.when(F.col("label") % 5 == 4, "client")
    return s.select("label", "complexity", P.route(asked, F.col("enabled"), F.col("complexity"), F.lit("small"), F.lit("big"), F.lit(True)).alias("model"))


@query(
    """with p as (select p_partkey, cast(200 + p_size * 40 as int) as w, cast(100 + p_size * 30 as int) as h from part), c as (select *, cast(least(greatest(ceil(w / 480.0), 2), 4) as int) as cols, cast(least(greatest(ceil(h / 480.0), 1), 3) as int) as rows0 from p)
    select p_partkey, cols, least(rows0, greatest(1, cast(floor(6 / cols) as int))) as rows, cols * least(rows0, greatest(1, cast(floor(6 / cols) as int))) as n_tiles from c"""
)
def grid_tiles(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", (F.col("p_size") * 40 + 200).alias("w"), (F.col("p_size") * 30 + 100).alias("h"))
    cols, rows = P.grid(F.col("w"), F.col("h"), F.lit(6))
    return p.select("p_partkey", cols.alias("cols"), rows.alias("rows"), F.size(P.tiles(F.col("w"), F.col("h"), F.lit(6))).alias("n_tiles"))


@query(f"select label % 3 as fold, count(*) as n, round(avg(case when tag = expected then 1.0 else 0.0 end), 6) as accuracy from (select label, tag, case when label % 2 = 0 then 'uncertain' else 'photo' end as expected from embeddings join {TAGS_SQL} t using (vec_id)) group by label % 3")
def eval_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    t = tagged(spark, folder).withColumn("fold", F.col("label") % 3).withColumn("expected", F.when(F.col("label") % 2 == 0, "uncertain").otherwise("photo"))
    return M.accuracy(t, ["fold"], "expected", "tag").withColumn("accuracy", F.round("accuracy", 6))


@query("select p_partkey, round(least(1.0, 1280 / (200.0 + p_size * 40)), 9) as scale from part")
def image_scales(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", F.round(P.image_scale(F.col("p_size") * 40 + F.lit(200.0)), 9).alias("scale"))
