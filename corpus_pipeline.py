"""From raw documents to packed training sequences: five stages, each over all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.llm.common import table, written
from gradeflow.llm.jaccard import jaccard_components
from gradeflow.llm.mixing import drawn
from gradeflow.llm.packing import packed_sequences
from gradeflow.llm.pii import redact_pii
from gradeflow.llm.quality import fit_quality, good_documents

#: Documents scored below are rejected.
QUALITY = 0.3
#: No source is repeated more often than this; every document is taken at least once.
REPEATS = 2.0


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model takes for junk go; all others stay as they are."""
    return good_documents(docs, fit_quality(docs, table(spark, sf_dir, "labels"), held_out=5), QUALITY)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) one row stays, that with the smallest id.

    Rows are told apart by id and text, so rows that repeat an id with another text, and rows
    without an id, are members of their own; an id goes before none, equal rows are one. Texts
    without words have no near duplicates; of these only copies under the same id go. Columns
    are known by their places here, so they may have any names.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    marked = plain.withColumn("row", F.xxhash64(F.col(doc_id).isNull(), F.col(text).isNull(), doc_id, text))
    groups = jaccard_components(marked.select("row", text), words=5, num=80, den=100, id_col="row", text_col=text).distinct()
    ids = groups.join(marked.select("row", F.col(doc_id).alias("id")).distinct(), "row")
    first = ids.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("row"))
    stays = written(first.select("row").unionByName(ids.where("n_shingles = 0 and id is not null").select("row")), "pipeline-stays")
    rest = [c for c in plain.columns if c != text]
    kept = marked.join(stays, "row").groupBy("row").agg(F.min(F.struct(*rest)).alias("rest"), F.min(text).alias("text"))
    wordless = marked.where(F.col(doc_id).isNull()).join(ids.where("n_shingles = 0 and id is null").select("row"), "row")
    return kept.select(*["text" if c == text else F.col("rest")[c] for c in plain.columns]).union(wordless.select(plain.columns)).toDF(*names)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; ``n_chars`` follows the text."""
    out = redact_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn towards equal weights as far as ``REPEATS`` allows; a row for each copy, one at least."""
    return drawn(docs, least=1, most_repeats=REPEATS, budget="cover")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; copies of a document are documents of their own."""
    return packed_sequences(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality_classifier), ("ngram_jaccard_join", ngram_jaccard_join), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: A learned filter, tokenizer ids and the order of online packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
