"""From raw documents to token files: five stages, each over all rows its predecessor kept.

Every stage takes (spark, docs, sf_dir); its rows are written as Parquet and read again as the
next one's input. All but the last return the columns of ``documents``.

1. toxicity: documents scored 0.5 or more go.
2. near-duplicates: of each group of near copies (fingerprints within four bits, or five-word
   shingles with a similarity of 0.8 or more) exactly one row stays, the one with the smallest
   doc_id; ids may repeat or be null, and rows of other groups stay whatever their id.
3. decontamination: documents contaminated by a benchmark item go.
4. mixing: nothing goes; rows are put in the order of the mix, which the file order carries.
5. token output: token files in the order of the mix; a row per document with its place in them.

Nulls: a null text is kept unless it is a near-duplicate; a null doc_id counts as the largest and
is no reason to drop a row.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelinekit.llm import decontamination, mixing, simhash, token_output, toxicity
from timelinekit.llm.common import saved, table
from timelinekit.llm.queries import END_ID, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, COLUMNS).filter("score < 0.5").select(*COLUMNS)


def row_key(columns: list[str]) -> Column:
    """A hash of the whole row; nulls count, so values in different columns are told apart."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = row_key(COLUMNS)
    kept = simhash.copy_representatives(docs, key).select(F.col("key").alias("_key"))
    # rows equal in all columns share a key, and one of them stays; only such rows are compared as a whole
    rows = docs.select(key.alias("_key")).groupBy("_key").agg((F.count(F.lit(1)) > 1).alias("_many"))
    kept = saved(kept.join(rows, "_key"), "pipeline-kept")
    found = docs.withColumn("_key", key).join(kept, "_key")
    one = found.filter(~F.col("_many")).select(*COLUMNS)
    return one.unionByName(found.filter("_many").select(*COLUMNS).dropDuplicates(COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = saved(decontamination.matches(docs, table(spark, sf_dir, "benchmark")).select("doc_key").distinct(), "pipeline-contaminated")
    keyed = docs.withColumn("doc_key", F.xxhash64("text"))
    return keyed.join(found, "doc_key", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_to_weights(docs).orderBy("slot", "nth").select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ordered, order = in_file_order(docs)
    folder = token_output.encode(ordered, tokenizer_path("word_bpe_49k.json"), END_ID, order)
    return token_output.decode(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def in_file_order(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns that give the order in which its files were written.

    Rows that don't come straight from files have no such order and go by doc_id.
    """
    try:
        name = F.col("_metadata.file_name")
        part = F.regexp_extract(name, r"part-(\d+)", 1).cast("long")
        return docs.select(*COLUMNS, part.alias("_part"), name.alias("_name"), F.col("_metadata.row_index").alias("_row")), ["_part", "_name", "_row"]
    except AnalysisException:
        return docs, ["doc_id"]


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]

# A trained classifier and a tokenizer library decide; SQL can't state them. See tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
