"""Detection, tokenisation, gates and containment over documents, pages and derived identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import rules, text as X
from quillon.functions.rules import BY_NAME, SECRET_LABELS, SECRET_PARTS, ALIAS_PAIRS
from quillon.operators import detect, gate, tokens
from quillon.plans.derived import KYC_SQL, kyc
from quillon.plans.registry import query
from quillon.sources.io import table

EMAIL_SQL = r"regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')"
#: RE2 has no look-around: every start is tried on a short substring, then overlaps go greedily.
CARD_TAIL = r"'^[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}'"
DIGIT_SUM = "list_sum(list_transform(range(1, length(d) + 1), lambda i: case when (length(d) - i) % 2 = 1 then (case when cast(substr(d, i, 1) as int) > 4 then cast(substr(d, i, 1) as int) * 2 - 9 else cast(substr(d, i, 1) as int) * 2 end) else cast(substr(d, i, 1) as int) end))"


@query(f"select lang, cast(sum(len({EMAIL_SQL})) as bigint) as n_email, count(*) as n_docs from documents group by lang")
def detect_email_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.groupBy("lang").agg(F.sum(rules.count_of("email", F.col("text"))).cast("long").alias("n_email"), F.count("*").alias("n_docs"))


@query(
    rf"""with c as (select doc_id, text, unnest(range(1, length(text) + 1)) as i from documents where regexp_matches(text, '[0-9]{{4}}[\s-]?[0-9]{{4}}[\s-]?[0-9]{{4}}[\s-]?[0-9]{{4}}')),
    m as (select doc_id, i, regexp_extract(substr(text, i, 24), {CARD_TAIL}) as v from c where substr(text, i, 1) between '0' and '9' and not (i > 1 and substr(text, i - 1, 1) between '0' and '9')
      and regexp_matches(substr(text, i, 24), '^[0-9]{{4}}[\s-]?[0-9]{{4}}[\s-]?[0-9]{{4}}[\s-]?[0-9]{{4}}(?:$|[^0-9])')),
    g as (select doc_id, i, v, lag(i + length(v)) over (partition by doc_id order by i) as prev from m),
    l as (select doc_id, regexp_replace(v, '[^0-9]', '', 'g') as d from g where prev is null or i >= prev)
    select doc_id, count(*) as n_card from l where {DIGIT_SUM} % 10 = 0 group by doc_id"""
)
def detect_card_luhn_docs(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", rules.count_of("card", F.col("text")).cast("long").alias("n_card"))
    return d.where("n_card > 0")


#: Detectors without look-around, for a position in a text: (may not stand before, the match, may not follow).
AT_POSITION = {
    "email": ("[A-Za-z0-9._%+-]", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", ""),
    "phone": ("[0-9]", r"(?:\+91[\s-]?)?(?:[0-9][\s-]?){9}[0-9]", "[0-9]"),
    "aadhaar": ("[0-9]", r"[2-9][0-9]{3}[\s-]?[0-9]{4}[\s-]?[0-9]{4}", r"[\s-]?[0-9]"),
    "pan": ("[A-Z0-9]", "[A-Z]{5}[0-9]{4}[A-Z]", "[A-Z0-9]"),
    "upi": ("[0-9]", "[0-9]{10}@[A-Za-z]{2,12}", "[A-Za-z0-9]"),
    "voterid": ("[A-Z0-9]", "[A-Z]{3}[0-9]{7}", "[A-Z0-9]"),
    "dl": ("[A-Za-z0-9_]", "[A-Z]{2}-?[0-9]{2}-?[0-9]{4}-?[0-9]{7}", "[A-Za-z0-9_]|-[0-9]"),
    "passport": ("[A-Z0-9]", "[A-Z][1-9][0-9]{6}", "[0-9]"),
    "card": ("[0-9]", r"[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}", "[0-9]"),
}


def found_sql(source: str, key: str, rules_: tuple[str, ...] = tuple(AT_POSITION)) -> str:
    """(key, type, value, i) of every match in ``source`` (key, text), each position tried on its own.

    Matches of a rule do not overlap: one that begins before the last one's end is left out, which
    decides right as long as no three overlap in a chain.  A match is looked for in the 120 characters from its start,
    which is longer than any value of the given tables; a longer one would be cut here, not in the engine.
    """
    one = []
    for name in rules_:
        before, match, after = AT_POSITION[name]
        follows = f" and not regexp_matches(substr(text, i + length(v), 3), '^(?:{after})')" if after else ""
        luhn = f" and (select {DIGIT_SUM} % 10 = 0 from (select regexp_replace(v, '[^0-9]', '', 'g') as d))" if name == "card" else ""
        one.append(
            f"""select {key}, '{name}' as type, v, i from (select *, lag(i + length(v)) over (partition by {key} order by i) as prev from (select {key}, text, i, regexp_extract(substr(text, i, 120), '^{match}') as v
            from (select {key}, text, unnest(range(1, length(text) + 1)) as i from {source} where regexp_matches(text, '{match}')) where not (i > 1 and regexp_matches(substr(text, i - 1, 1), '{before}'))) where v <> ''{follows}) where (prev is null or i >= prev){luhn}"""
        )
    return " union all ".join(f"({x})" for x in one)


@query(f"select doc_id, count(*) as n_phone from ({found_sql('documents', 'doc_id', ('phone',))}) group by doc_id")
def detect_phone_docs(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", rules.count_of("phone", F.col("text")).cast("long").alias("n_phone"))
    return d.where("n_phone > 0")


ANCHORED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?:\+91[\s-]?)?[0-9]{5}[\s-]?[0-9]{5}",
    "aadhaar": r"[2-9][0-9]{3}[\s-]?[0-9]{4}[\s-]?[0-9]{4}",
    "pan": "[A-Z]{5}[0-9]{4}[A-Z]",
    "upi": "[0-9]{10}@[A-Za-z]{2,12}",
    "voterid": "[A-Z]{3}[0-9]{7}",
    "dl": "[A-Z]{2}-?[0-9]{2}-?[0-9]{4}-?[0-9]{7}",
    "passport": "[A-Z][1-9][0-9]{6}",
}
CARD_OK = f"(select {DIGIT_SUM} % 10 = 0 from (select regexp_replace(card, '[^0-9]', '', 'g') as d))"


@query(
    "select c_nationkey, "
    + ", ".join(f"cast(sum(case when regexp_full_match({n}, '{p}') then 1 else 0 end) as bigint) as n_{n}" for n, p in ANCHORED.items())
    + f", cast(sum(case when {DIGIT_SUM} % 10 = 0 then 1 else 0 end) as bigint) as n_card from (select *, regexp_replace(card, '[^0-9]', '', 'g') as d from ({KYC_SQL})) group by c_nationkey"
)
def detect_battery_kyc(spark: SparkSession, folder: str) -> DataFrame:
    names = [*ANCHORED, "card"]
    return kyc(spark, folder).groupBy("c_nationkey").agg(*[F.sum(rules.count_of(n, F.col(n))).cast("long").alias(f"n_{n}") for n in names])


@query(
    f"select c_nationkey, ocr, cast(sum(case when ocr = 1 and regexp_full_match(account, '[A-Z]{{2,4}}-[A-Z]{{1,4}}[0-9]{{4,}}') then 1 else 0 end) as bigint) as n_account from ({KYC_SQL}) cross join (select 0 as ocr union all select 1) group by c_nationkey, ocr"
)
def detect_account_ocr_only(spark: SparkSession, folder: str) -> DataFrame:
    k = kyc(spark, folder).withColumn("ocr", F.explode(F.array(F.lit(0), F.lit(1))))
    n = F.when(F.col("ocr") == 1, rules.count_of("account", F.col("account"))).otherwise(0)
    return k.groupBy("c_nationkey", "ocr").agg(F.sum(n).cast("long").alias("n_account"))


CLEAN_SQL = r"regexp_replace(lower(label), '[_\-\s]', '', 'g')"
FIELD_SQL = (
    f"case when {CLEAN_SQL} in ({', '.join(repr(s) for s in SECRET_LABELS)}) or regexp_matches(lower(label), '{SECRET_PARTS}') then 'password' "
    + " ".join(f"when {CLEAN_SQL} = '{a}' then '{t}'" for a, t in ALIAS_PAIRS)
    + " "
    + " ".join(f"when contains({CLEAN_SQL}, '{a}') then '{t}'" for a, t in ALIAS_PAIRS if "-" not in a)
    + " end"
)


@query(f"select label, field_type, case when field_type = 'password' then 'A' when field_type is not null then 'B' end as field_tier, count(*) as n from (select label, {FIELD_SQL} as field_type from ({KYC_SQL})) group by all")
def field_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    k = kyc(spark, folder).groupBy("label").agg(F.count("*").alias("n"))
    return detect.classify_fields(k, "label").select("label", "field_type", "field_tier", "n")


MASK_SQL = r"""case when contains(v, '@') then concat(case when length(split_part(v, '@', 1)) <= 2 then rpad(substr(v, 1, 1), 3, '*') else concat(substr(v, 1, 3), '***') end, substr(v, instr(v, '@')))
  when length(regexp_replace(v, '[^0-9]', '', 'g')) >= 4 then array_to_string(list_transform(range(1, length(v) + 1), lambda i: case when substr(v, i, 1) between '0' and '9' and length(regexp_replace(substr(v, i + 1), '[^0-9]', '', 'g')) >= 4 then 'X' else substr(v, i, 1) end), '')
  else concat(substr(v, 1, 2), '…') end"""


@query(f"select c_custkey, kind, {MASK_SQL} as masked from (unpivot (select c_custkey, email, phone, card, aadhaar, label from ({KYC_SQL})) on email, phone, card, aadhaar, label into name kind value v)")
def mask_values(spark: SparkSession, folder: str) -> DataFrame:
    k = kyc(spark, folder).unpivot("c_custkey", ["email", "phone", "card", "aadhaar", "label"], "kind", "v")
    return k.select("c_custkey", "kind", rules.mask_value(F.col("v"), strict=False).alias("masked"))


#: The display form, unless it shows more than half of a value that is no address.
STRICT_MASK_SQL = r"case when not contains(v, '@') and length(regexp_replace(m, '[X*…]', '', 'g')) * 2 > length(v) then concat(substr(v, 1, 2), repeat('X', greatest(length(v) - 2, 1))) else m end"


@query(f"select c_custkey, kind, {STRICT_MASK_SQL} as masked from (select *, {MASK_SQL} as m from (unpivot (select c_custkey, email, phone, card, pan, label from ({KYC_SQL})) on email, phone, card, pan, label into name kind value v))")
def mask_values_strict(spark: SparkSession, folder: str) -> DataFrame:
    k = kyc(spark, folder).unpivot("c_custkey", ["email", "phone", "card", "pan", "label"], "kind", "v")
    return k.select("c_custkey", "kind", rules.mask_value(F.col("v")).alias("masked"))


@query(
    f"""with seen as (select 'email' as type, email as value, c_custkey as ord from ({KYC_SQL}) union all select 'pan', pan, c_custkey from ({KYC_SQL})
      union all select 'email', unnest({EMAIL_SQL}), 1000000000 + doc_id from documents),
    f as (select type, value, min(ord) as first_ord from seen group by type, value)
    select type, value, cast(row_number() over (partition by type order by first_ord, value) as int) as n, concat('[', upper(type), '_', cast(row_number() over (partition by type order by first_ord, value) as varchar), ']') as token from f"""
)
def token_numbering(spark: SparkSession, folder: str) -> DataFrame:
    k = kyc(spark, folder)
    docs = table(spark, folder, "documents").select(F.lit("email").alias("type"), F.explode(rules.all_values(BY_NAME["email"], F.col("text"))).alias("value"), (F.col("doc_id") + 1000000000).alias("ord"))
    seen = k.select(F.lit("email").alias("type"), F.col("email").alias("value"), F.col("c_custkey").alias("ord")).union(k.select(F.lit("pan"), "pan", "c_custkey")).union(docs)
    return tokens.number_tokens(seen.withColumn("second", F.col("value")), ["ord", "second"])


EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(
    rf"""with d as (select doc_id, text, {EMAIL_SQL} as vs, string_split_regex(text, '{EMAIL_PATTERN}') as parts from documents where regexp_matches(text, '{EMAIL_PATTERN}')),
    m as (select doc_id, unnest(vs) as v, generate_subscripts(vs, 1) as k from d), f as (select doc_id, v, min(k) as k from m group by all), n as (select doc_id, v, row_number() over (partition by doc_id order by k) as n from f),
    t as (select m.doc_id, list(concat('[EMAIL_', n, ']') order by m.k) as toks from m join n using (doc_id, v) group by m.doc_id)
    select doc_id, md5(array_to_string(list_transform(range(1, len(parts) + 1), lambda i: concat(parts[i], coalesce(toks[i], ''))), '')) as digest, cast(len(vs) as int) as n_redacted from d join t using (doc_id)"""
)
def tokenize_documents_email(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where(rules.may_match(F.col("text"))).select("doc_id", "text")
    clean, _ = tokens.tokenize(d, "text", ["doc_id"], scope=["doc_id"], types=["email"])
    return clean.where("n_redacted > 0").select("doc_id", F.md5("clean").alias("digest"), "n_redacted")


#: Rewriting of all rules by offsets: matches of one text by start, the longer first; a later one that begins inside the
#: last is left out.  Values are numbered over all documents by first appearance.
@query(
    rf"""with m as ({found_sql('documents', 'doc_id')}), o as (select *, max(i + length(v)) over (partition by doc_id order by i, length(v) desc rows between unbounded preceding and 1 preceding) as upto from m),
    k as (select doc_id, type, v, i, case when regexp_matches(v, '^[0-9+ -]+$') then regexp_replace(v, '[ -]', '', 'g') else v end as key from o where upto is null or i >= upto),
    f as (select type, key, min(doc_id * 1000000 + i) as first_at from k group by all), n as (select type, key, row_number() over (partition by type order by first_at) as n from f),
    t as (select k.doc_id, k.i, length(k.v) as len, concat('[', upper(k.type), '_', n, ']') as token, row_number() over (partition by k.doc_id order by k.i) as r, lag(k.i + length(k.v)) over (partition by k.doc_id order by k.i) as from_at from k join n using (type, key)),
    p as (select t.doc_id, string_agg(concat(substr(text, coalesce(from_at, 1), i - coalesce(from_at, 1)), token), '' order by r) as head, max(i + len) as rest, count(*) as n from t join documents d using (doc_id) group by t.doc_id)
    select doc_id, md5(concat(head, substr(text, rest))) as digest, cast(n as int) as n_redacted from p join documents using (doc_id)"""
)
def tokenize_documents(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where(rules.may_match(F.col("text"))).select("doc_id", "text")
    clean, _ = tokens.tokenize(d, "text", ["doc_id"])
    return clean.where("n_redacted > 0").select("doc_id", F.md5("clean").alias("digest"), "n_redacted")


#: A payment address is an address and a telephone number; a card's last twelve digits may be an identity number.
PAIRS_SQL = f"""select c_custkey, {DIGIT_SUM} % 10 = 0 as is_card, substr(d, 5, 1) between '2' and '9' as is_aadhaar, card from (select *, regexp_replace(card, '[^0-9]', '', 'g') as d from ({KYC_SQL}))"""


def _overlaps(spark: SparkSession, folder: str, strict: bool) -> DataFrame:
    k = kyc(spark, folder, spread=True).select("c_custkey", F.concat(F.lit("pay "), "upi", F.lit(" or "), "card").alias("text"))
    clean, _ = tokens.tokenize(k, "text", ["c_custkey"], strict=strict)
    return clean.select("c_custkey", F.regexp_replace("clean", "_[0-9]+", "").alias("clean"), "n_redacted")


@query(
    f"""select c_custkey, concat('pay [PHONE][UPI] or ', case when is_card then '[CARD]' else '' end, case when is_aadhaar then concat(case when is_card then '' else concat(substr(card, 1, 5)) end, '[AADHAAR]') when not is_card then card else '' end) as clean,
    cast(2 + is_card::int + is_aadhaar::int as int) as n_redacted from ({PAIRS_SQL})"""
)
def tokenize_overlap_compat(spark: SparkSession, folder: str) -> DataFrame:
    return _overlaps(spark, folder, False)


@query(
    f"""select c_custkey, concat('pay [UPI] or ', case when is_card then '[CARD]' when is_aadhaar then concat(substr(card, 1, 5), '[AADHAAR]') else card end) as clean, cast(1 + (is_card or is_aadhaar)::int as int) as n_redacted from ({PAIRS_SQL})"""
)
def tokenize_overlap_strict(spark: SparkSession, folder: str) -> DataFrame:
    return _overlaps(spark, folder, True)


@query("select count(*) as n, count(*) as n_equal, cast(0 as bigint) as n_left from customer")
def detokenize_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    k = kyc(spark, folder, spread=True).select("c_custkey", F.concat(F.lit("id "), "pan", F.lit(" mail "), "email").alias("text"))
    clean, names = tokens.tokenize(k, "text", ["c_custkey"], scope=["c_custkey"])
    pairs = names.groupBy("c_custkey").agg(F.collect_list(F.struct("token", "value")).alias("pairs"))
    back = clean.join(pairs, "c_custkey", "left").withColumn("back", tokens.restore(F.col("clean"), F.col("pairs")))
    left = F.count_if(F.size(rules.all_values(BY_NAME["pan"], F.col("clean"))) > 0)
    return back.agg(F.count("*").alias("n"), F.count_if(F.col("back") == F.col("text")).alias("n_equal"), left.alias("n_left"))


@query(f"select doc_id, v as value from (select doc_id, unnest({EMAIL_SQL}) as v from documents)")
def leak_gate_emails(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", "text")
    return gate.violations(d, ["doc_id"]).where("type = 'email'").select("doc_id", "value")


@query(f"select lang, type, count(*) as n, count(distinct v) as n_values from ({found_sql('documents', 'doc_id')}) join documents using (doc_id) group by lang, type")
def leak_gate_violations(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("lang", "text")
    return gate.violations(d, ["lang"], ["text"]).groupBy("lang", "type").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


@query(
    f"""with h as (select doc_id, doc_id % 3 as regions, case doc_id % 4 when 0 then null when 1 then false else true end as up, case when doc_id % 5 = 0 and len({EMAIL_SQL}) = 0 then null else len({EMAIL_SQL}) end as hits from documents)
    select doc_id, case when hits > 0 then 'block' when regions = 0 then 'pass' when up and hits is not null then 'pass' else 'skip' end as verdict from h"""
)
def leak_gate_verdict(spark: SparkSession, folder: str) -> DataFrame:
    n = F.size(rules.all_values(BY_NAME["email"], F.col("text")))
    k = F.col("doc_id")
    up = F.when(k % 4 == 1, False).when(k % 4 != 0, True)
    d = table(spark, folder, "documents").withColumn("hits", F.when((k % 5 != 0) | (n > 0), n))
    return d.select("doc_id", gate.verdict((k % 3).cast("int"), up, F.col("hits")).alias("verdict"))


PAGE_TEXT = "(select page_id, html as text from pages)"


@query(f"select page_id, count(v) as n_hits, count(v) = 0 as passed from pages left join ({found_sql(PAGE_TEXT, 'page_id')}) using (page_id) group by page_id")
def leak_gate_pages(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "pages").select("page_id", "html")
    hits = gate.violations(p, ["page_id"])
    return gate.passes(hits, ["page_id"], p)


@query(
    rf"""with h as (select 'dom-scan' as origin, doc_id, v as detail from ({found_sql('documents', 'doc_id', ('email',))}) union all select 'image-ocr', doc_id, v from ({found_sql('documents', 'doc_id', ('card',))})
      union all select 'image-ocr-error', doc_id, 'unreadable' from documents where doc_id % 97 = 0
      union all select 'gt-value-in-body', doc_id, cast(item_id as varchar) from (select item_id, regexp_replace(lower(text), '\s', '', 'g') as needle from benchmark) b join (select doc_id, regexp_replace(lower(text), '\s', '', 'g') as body from documents) d on contains(body, needle) where needle <> '')
    select origin, count(*) as n_hits, count(distinct doc_id) as n_docs from h group by origin"""
)
def leak_audit(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", "text")
    of = lambda name: gate.violations(d, ["doc_id"], ["text"]).where(F.col("type") == name).select("doc_id", F.col("value").alias("detail"))
    unread = d.where("doc_id % 97 = 0").select("doc_id", F.lit("unreadable").alias("detail"))
    known = gate.contained(table(spark, folder, "benchmark").select("item_id", "text"), d.withColumnRenamed("text", "body"), "text", "body")
    hits = gate.audit({"dom-scan": of("email"), "image-ocr": of("card"), "image-ocr-error": unread, "gt-value-in-body": known.select("doc_id", F.col("item_id").alias("detail"))}, ["doc_id"])
    return hits.groupBy("origin").agg(F.count("*").alias("n_hits"), F.countDistinct("doc_id").alias("n_docs"))


@query(r"select item_id, text as body from benchmark where not regexp_matches(text, '@|(?:[0-9][\s-]?){4}')")
def payload_after_gate(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "benchmark").select("item_id", "text")
    return gate.release(b, ["item_id"], ["text"]).select("item_id", F.get_json_object("body", "$.text").alias("body"))


@query(
    r"""select item_id, count(*) as n_docs, min(doc_id) as first_doc from (select item_id, regexp_replace(lower(text), '\s', '', 'g') as needle from benchmark) b
    join (select doc_id, regexp_replace(lower(text), '\s', '', 'g') as body from documents) d on contains(body, needle) where length(needle) > 0 group by item_id"""
)
def gt_value_containment(spark: SparkSession, folder: str) -> DataFrame:
    needles = table(spark, folder, "benchmark").select("item_id", "text")
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("body"))
    hit = gate.contained(needles, docs, "text", "body")
    return hit.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("select conv_id, turn, case when length(text) > 80 then concat(substr(text, 1, 80), '…') else text end as short_text, cast(floor(length(text) * 3 / 4.0 / 1024 + 0.5) as bigint) as kb from conversations")
def truncate_text(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    return c.select("conv_id", "turn", X.truncate(F.col("text")).alias("short_text"), F.floor(F.length("text") * 3 / F.lit(4.0) / 1024 + 0.5).cast("long").alias("kb"))


@query(
    """select n_name, cast(list_reduce(list_prepend(cast(2166136261 as hugeint), list_transform(range(1, length(n_name) + 1), lambda i: cast(ascii(substr(n_name, i, 1)) as hugeint))), lambda h, x: (xor(cast(h as bigint), cast(x as bigint))::hugeint * 16777619) % 4294967296) as bigint) as hash from nation"""
)
def fnv_hash(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    codes = F.transform(F.sequence(F.lit(1), F.length("n_name")), lambda i: F.ascii(F.substr(F.col("n_name"), i, F.lit(1))))
    return n.select("n_name", X.fnv1a(codes).alias("hash"))


@query("select c_custkey, case when s >= 60 then concat(cast(s // 60 as varchar), 'm ', cast(s % 60 as varchar), 's') else concat(cast(s as varchar), 's') end as label from (select c_custkey, greatest(1, ((c_custkey * 7919) % 400000 + 500) // 1000) as s from customer)")
def duration_labels(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select("c_custkey", ((F.col("c_custkey") * 7919) % 400000).alias("ms"))
    return c.select("c_custkey", X.duration(F.col("ms")).alias("label"))


#: Every role as it is, in capitals, and within a longer name; and the events' own types.
ROLES = [name for role, _ in X.ROLE_COLOURS for name in (role, role.upper(), f"my {role} here")]
ROLE_SQL = f"case when event_id % 50 < {len(ROLES)} then list_extract([{', '.join(repr(r) for r in ROLES)}], cast(event_id % 50 + 1 as int)) else event_type end"
EXACT, WITHIN = " ".join(f"when low = '{k}' then '{v}'" for k, v in X.ROLE_COLOURS), " ".join(f"when contains(low, '{k}') then '{v}'" for k, v in X.ROLE_COLOURS)


@query(f"select role, count(*) as n, case {EXACT} {WITHIN} else '#64748b' end as colour from (select *, lower(role) as low from (select {ROLE_SQL} as role from events)) group by role, low")
def role_colours(spark: SparkSession, folder: str) -> DataFrame:
    at = (F.col("event_id") % 50).cast("int")
    role = F.coalesce(F.get(F.array(*map(F.lit, ROLES)), at), F.col("event_type"))
    return table(spark, folder, "events").groupBy(role.alias("role")).agg(F.count("*").alias("n")).withColumn("colour", X.role_colour(F.col("role")))


@query(
    f"""with k as (select c_nationkey, c_custkey, email, concat('[EMAIL_', cast(dense_rank() over (partition by c_nationkey order by email) as varchar), ']') as token from ({KYC_SQL})), f as (select c_nationkey, token, min(c_custkey) as c_custkey, arg_min(email, c_custkey) as v from k group by c_nationkey, token)
    select c_nationkey, c_custkey, token, {MASK_SQL} as masked from f"""
)
def stable_token_log(spark: SparkSession, folder: str) -> DataFrame:
    k = kyc(spark, folder).select("c_nationkey", "c_custkey", "email")
    named = k.withColumn("token", F.concat(F.lit("[EMAIL_"), F.dense_rank().over(Window.partitionBy("c_nationkey").orderBy("email")).cast("string"), F.lit("]")))
    log = tokens.masked_log(named, "email")
    return tokens.stable_tokens(log, ["c_nationkey"], "c_custkey").select("c_nationkey", "c_custkey", "token", "masked")
