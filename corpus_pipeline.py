"""Training data from documents: language, toxicity, near duplicates, packing.

Each stage takes what the one before kept, as written; the first three return
the columns of documents, the last the packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.llm import langid, toxicity
from arbor.llm.common import few, fresh, table
from arbor.llm.ngram_jaccard import jaccard_classes
from arbor.llm.packing import pack
from arbor.session import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without
    letters, null ones among them, and those too far from every language go;
    rows of equal text go or stay together; an empty table gives none, and so
    does one without any labelled document. Other columns stay as they are,
    whatever their names."""
    names = fresh(docs, "lang_pred", "score", "rejected")
    found = langid.identify(docs, langid.fit(docs), *docs.columns, names=names)
    return found.where(~F.col(names[2])).select(*docs.columns)


def civility(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold. A null or wordless text
    scores the share of toxic labels; rows of equal text go or stay together; an
    empty table gives none; without labels all scores are 0.5, and all go. Other
    columns stay as they are, whatever their names."""
    (name,) = fresh(docs, "score")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), *docs.columns, name=name)
    return found.where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def _rows(docs: DataFrame, row: str) -> tuple[DataFrame, DataFrame]:
    """docs with a column `row`, a number that only rows of the same doc_id (or none) and
    the same text share, and the numbers: that column, doc_id and how many rows (times)
    have it. It is a hash, so that no text has to move; where two rows that
    differ (by a second hash of the text) get the same number, another seed is taken."""
    seed = 0
    while True:
        numbered = docs.withColumn(row, F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", "text"))
        what = F.xxhash64(F.lit(~seed), "text")
        ids = numbered.groupBy(row).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("times"), ((F.count("doc_id").isin(0, F.count("*"))) & F.min("doc_id").eqNullSafe(F.max("doc_id")) & (F.min(what) == F.max(what))).alias("alike"))
        ids = written(ids, "rows")
        if ids.where("not alike").isEmpty():
            return numbered, ids.drop("alike")
        seed += 1


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that Jaccard links of 0.8 between sets of 5-word
    shingles connect: that with the least doc_id, null being the greatest.

    Rows are told apart, not ids: a row without doc_id is linked by its text as
    any other, rows that repeat a doc_id are each judged by their own text, and
    of rows that repeat doc_id and text one stays. Of several texts of a group
    under its least doc_id that with the least hash stays. A row without words
    has no shingles, is linked with nothing and always stays."""
    wordless = F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n\v\f\r")) == ""
    (row,) = fresh(docs, "_row")
    numbered, ids = _rows(docs.where(~wordless), row)
    found = jaccard_classes(numbered.select(F.col(row).alias("doc_id"), "text"), 5, 80, 100)
    classes = found.select(F.col("doc_id").alias(row), "component_id").distinct().join(ids, row)
    first = classes.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias(row))
    first = written(first.select(row), "first")
    # most rows stay, so those that go, or have to be made one, are looked up
    others = written(ids.join(first, row, "left_anti").select(row), "others")
    repeated = ids.where("times > 1").join(first, row, "left_semi").select(row)
    kept = numbered.join(few(others.unionAll(repeated)), row, "left_anti").select(*docs.columns).unionAll(docs.where(wordless))
    one = numbered.join(few(repeated), row, "left_semi").groupBy(row).agg(F.min(F.struct(*docs.columns)).alias("one"))
    return kept.unionAll(one.select("one.*"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' tokens in windows, a row a piece: as packing.pack() says,
    with nulls as empty texts, repeated rows packed each, an empty table giving none."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("toxicity", civility), ("near_duplicates", deduplicate), ("packing", packing)]

#: Models, similarity and packing aren't SQL: tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
