"""The registered query of each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.deploy import ship
from quillon.llm.byte_bpe import decode, encode, joined_ids
from quillon.llm.change_applier import apply_changes
from quillon.llm.cube_mix import mix
from quillon.llm.decontaminate import contaminations
from quillon.llm.html_template import extract
from quillon.llm.metric_join import metric_links
from quillon.llm.near_minhash import near_duplicates
from quillon.llm.periodic_runs import periodic_runs
from quillon.llm.ppm import score
from quillon.llm.quality_ordinal import quality
from quillon.llm.substring_dedup import substring_dedup
from quillon.llm.toxicity import toxicity
from quillon.llm.url_rules import judge


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_cube_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).drop("tag")


def op2_html_template(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


def op3_debruijn_spans(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup(table(spark, folder, "documents")).drop("kept_text")


def op4_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages"))


def op5_toxicity_zstd(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_ppm(spark: SparkSession, folder: str) -> DataFrame:
    return score(table(spark, folder, "documents"))


def op7_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_metric_join(spark: SparkSession, folder: str) -> DataFrame:
    return metric_links(table(spark, folder, "embeddings"))


def op9_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op10_pigeonhole(spark: SparkSession, folder: str) -> DataFrame:
    return contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def cents(balance: str) -> Column:
    """Hundredths, halves up; null where the balance is no finite number that fits."""
    return F.when(F.abs(balance) < 9e16, F.floor(100 * F.col(balance) + 0.5)).alias("cents")


def op11_change_applier(spark: SparkSession, folder: str) -> DataFrame:
    changes = apply_changes(table(spark, folder, "client_changes"))
    return changes.select("change_id", "client_id", "status", "batch", "missed", "city", cents("balance"), "current")


def repeated(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten has its words from some place on replaced by the first few of them again and again."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("__w").cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    again = F.transform("__w", lambda w, i: F.when(i < F.col("__a"), w).otherwise(F.get("__w", (F.col("__a") + F.pmod(i - F.col("__a"), F.col("__p"))).cast("int"))))
    split = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("__w")).withColumn("__w", F.when(F.size("__w") > 0, F.col("__w")))
    return split.withColumns({"__a": a, "__p": p}).select("doc_id", F.when(F.col("__w").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(repeated(table(spark, folder, "documents")))
    order = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    best = F.get(order, F.lit(0))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * -F.col("best.less") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    coded = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined_ids(F.col("ids")), 256).alias("ids_sha256"), "ids")
    return decode(coded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_cube_mix,
        op2_html_template,
        op3_debruijn_spans,
        op4_url_rules,
        op5_toxicity_zstd,
        op6_ppm,
        op7_ordinal_quality,
        op8_metric_join,
        op9_hyperminhash,
        op10_pigeonhole,
        op11_change_applier,
        op12_periodic_runs,
        op13_byte_bpe,
    )
}

SPLIT = r"coalesce(list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> ''), [])"
LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of a text of digits, a bit at a time.
CRC32 = "xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({0}::varchar, ''), lambda c: ascii(c)::ubigint)), lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)::ubigint[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::ubigint))), 4294967295::ubigint)"
#: The rules in another form: where a client stands after a batch is the first number that has not come by then, from the
#: last number whose change had waited too long, or from where it stood.  ``ahead`` has the end of each run of numbers that have come.
CHANGES = f"""with recursive d as (select distinct change_id, client_id, seq, op, valid_at, source, segment, city, balance from client_changes),
  r as (select *, dense_rank() over (partition by client_id order by seq nulls first) as n, {CRC32.format("change_id")} as h from d),
  t as (select *, cast(valid_at::date - date '1970-01-01' + 2 * (h % 4) as int) as day from r where valid_at is not null and h % 11 <> 0),
  b as (select *, cast(least(8, greatest(1, 1 + floor((day - 19723) * 8 / 160))) as int) as came, row_number() over (partition by client_id, n order by day, change_id) as turn from t),
  f as (select * from b where turn = 1),
  w as (select k, coalesce((select max(day) from b where came < k), -100000) as largest from (select unnest(range(1, 10)) as k)),
  late as (select client_id, k, max(n) as reach from f, w where (k = 9 or day + 5 <= largest) group by all),
  runs as (select client_id, k, n, max(n) over (partition by client_id, k, g) + 1 as ahead from (select client_id, k, n, n - row_number() over (partition by client_id, k order by n) as g from f, w where came <= k)),
  s(client_id, k, stand, reach) as (select distinct client_id, 0, 1::bigint, 1::bigint from b
    union all select x.client_id, x.k, coalesce(a.ahead, x.reach), x.reach from (select s.client_id, s.k + 1 as k, greatest(s.stand, coalesce(l.reach + 1, 0)) as reach from s left join late l on l.client_id is not distinct from s.client_id and l.k = s.k + 1 where s.k < 9) x left join runs a on a.client_id is not distinct from x.client_id and a.k = x.k and a.n = x.reach),
  m as (select f.change_id, f.client_id, f.n, f.op, f.city, f.balance, min(s.k) as done from f join s on s.client_id is not distinct from f.client_id and s.k >= f.came and s.stand > f.n join s p on p.client_id is not distinct from s.client_id and p.k = f.came where f.n >= p.reach group by all),
  a as (select *, n - coalesce(lag(n) over (partition by client_id order by n), 0) - 1 as missed, n = max(n) over (partition by client_id) and op is distinct from 'D' as current,
    last_value(case when op in ('I', 'D') or (op = 'U' and city is not null) then n end ignore nulls) over (partition by client_id order by n) as city_from,
    last_value(case when op in ('I', 'D') or (op = 'U' and balance is not null) then n end ignore nulls) over (partition by client_id order by n) as balance_from from m),
  z as (select a.*, case when c.op <> 'D' then c.city end as city_now, case when e.op <> 'D' then e.balance end as balance_now from a left join a c on c.client_id is not distinct from a.client_id and c.n = a.city_from left join a e on e.client_id is not distinct from a.client_id and e.n = a.balance_from)
  select b.change_id, b.client_id, case when z.done is null then 'rejected' else 'applied' end as status, cast(coalesce(z.done, b.came) as int) as batch, cast(coalesce(z.missed, 0) as bigint) as missed, z.city_now as city, cast(floor(100 * z.balance_now + 0.5) as bigint) as cents, coalesce(z.current, false) as current
  from b left join z on z.change_id = b.change_id and b.turn = 1"""

ORACLES: dict[str, str] = {
    "op11_change_applier": CHANGES,
    "op3_debruijn_spans": rf"""with d as (select doc_id, {SPLIT.format('text')} as ws from documents),
  pos as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from d where len(ws) >= 50)),
  first as (select h, min(doc_id) as least from pos group by h),
  cov as (select distinct doc_id, unnest(range(i, i + 50)) as p from pos join first using (h) where least < doc_id),
  w as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as p from d),
  k as (select w.doc_id, count(cov.p) as gone, string_agg(w.w, ' ' order by w.p) filter (where cov.p is null) as kept from w left join cov on w.doc_id = cov.doc_id and w.p = cov.p group by w.doc_id)
  select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(gone, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)""",
    "op8_metric_join": """with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null),
  ok as (select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
  pr as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
  r as (select vec_id as v, vec_id as u from embeddings union select r.v, pr.b from r join pr on r.u = pr.a),
  c as (select v, min(u) as component_id from r group by v),
  n as (select a, count(*) as n from pr group by a)
  select vec_id, coalesce(n, 0) as n_links, component_id, component_id = vec_id as kept from embeddings left join n on a = vec_id join c on v = vec_id""",
    "op9_hyperminhash": rf"""with recursive d as (select doc_id, {SPLIT.format(LOW)} as ws from documents),
  s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]] else list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])) end) as g from d),
  n as (select doc_id, count(*) as n from s group by doc_id),
  pr as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
  e as (select a, b from pr join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
  sym as (select a, b from e union all select b, a from e),
  r as (select doc_id as v, doc_id as u from documents union select r.v, sym.b from r join sym on r.u = sym.a),
  c as (select v, min(u) as component_id from r group by v)
  select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, component_id = d.doc_id as kept from d left join n using (doc_id) join c on c.v = d.doc_id""",
}
