"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  toxicity: documents that it rejects go.  near_dedup: of each group of near copies the one
with the least id stays; rows that repeat an id stay together.  substring_dedup: words of long
passages that an earlier document holds go, the text is then joined by single blanks and n_chars
follows; other texts stay as they are, and emptied documents stay with an empty text.
decontamination: documents that hold a benchmark passage go.  mix: documents that the mix takes, with
source_size, target, taken and copies.  Null texts pass every stage but the mix, which takes none.
Further columns pass whatever their names, dots, blanks and back-ticks included; only the mix's own four names are replaced.  Rows that repeat
are rows of their own, an empty table gives an empty one, and very long texts are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.deploy import ship
from quillon.llm import cube_mix, decontaminate, near_minhash, store, substring_dedup, toxicity


#: Near copies share four fifths of their runs of so many words.
SHINGLE = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    pair = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_of(pair)(F.col("text")) < toxicity.PREDICTED)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = packed(docs, F.col("doc_id"), F.col("text"))
    gone = near_minhash.near_duplicates(rows.select("doc_id", "text"), shingle=SHINGLE).where("not kept").select("doc_id").distinct()
    return rows.select("doc", "doc_id").join(gone, "doc_id", "left_anti").select("doc.*")


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """The rows as one column ``doc``, so that no name of theirs meets one of an operator."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    return docs.select(F.struct(*map(F.col, quoted)).alias("doc"), *more)


def cut_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("variant"), F.col("text"))
    spans = substring_dedup.repeated_spans(rows.select("doc_id", "variant", "text"))
    marks = spans.groupBy("doc_id", "variant").agg(F.collect_list(F.struct(*substring_dedup.MARK)).alias("spans"))
    joined = rows.select("doc", "doc_id", "variant").join(marks, ["doc_id", "variant"], "left")
    text = substring_dedup.cut(F.col("doc")["text"], "spans")
    less = F.col("doc").withField("text", text)
    if "n_chars" in docs.columns:
        less = less.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select(F.when(F.col("spans").isNull(), F.col("doc")).otherwise(less).alias("doc")).select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = packed(docs, F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("row"), F.col("text"))
    found = decontaminate.contaminations(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    return rows.join(found.select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    added = ["source_size", "target", "taken", "copies"]
    mixed = cube_mix.mix(docs).where("copies > 0").select(F.col("doc_id").alias("id"), F.col("tag").alias("of"), *added)
    rows = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), cube_mix.row_hash().alias("tag"))
    repeated = store.durable(rows.groupBy("doc_id", "tag").count().where("count > 1").select(F.col("doc_id").alias("id"), F.col("tag").alias("of")))
    same = F.col("tag").eqNullSafe(F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))
    several = cube_mix.numbered(store.durable(rows.join(repeated, same, "left_semi"))).select(*rows.columns)
    chosen = rows.join(repeated, same, "left_anti").union(several).join(mixed, same)
    kept = [c for c in docs.columns if c not in added]  # columns of these names are the mix's
    return chosen.select(*[F.col("doc")[c].alias(c) for c in kept], *added)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("substring_dedup", cut_substrings),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
]

#: No SQL form: the toxicity model is trained here.  Its stages' operators are tested against brute force, the stages
#: themselves on small tables whose outcome is known.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{store.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        out = f"{top}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if last:
            store.remove(spark, last)
        last = out
    return docs
