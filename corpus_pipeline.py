"""The corpus pipeline: five stages from raw documents to packed sequences.

1. Language ID drops documents without a recognisable language.
2. Line dedup keeps a line that 10 or more documents hold in the first of
   them alone; a document that has nothing else left goes.
3. MinHash near-dedup (five words, similarity 0.8) keeps the first document of
   each group.
4. Decontamination drops documents that cover half of a benchmark item.
5. Best-fit packing places what is left in sequences of 2048 tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but
the last return the columns of docs. Nulls in any column, empty texts and
repeated rows have the results that the operators define; an empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graftwork.llm import decontam, langid, linededup, neardup, packing
from graftwork.llm.common import Scratch, free_name, table
from graftwork.llm.queries import vocabulary

#: Cosine under which a text of SHORT characters or more is in no learned language, and a shorter one, whose few letters
#: say less. Chance gives some 0.04 for one prototype. Of 1,200 texts of the test tables none of the longer fell under 0.2
#: and none of the shorter under 0.1; of 600 made of random letters in three scripts one reached 0.18.
MIN_COSINE, MIN_COSINE_SHORT, SHORT = 0.18, 0.09, 40
#: Flagged rows up to this many are broadcast, more are joined by shuffle.
MAX_BROADCAST = 100_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prototypes = langid.fit_prototypes(docs)
    lang, score = free_name(docs, "_gw_lang"), free_name(docs, "_gw_score")
    told = langid.identify(docs, prototypes, pred=lang, score=score)
    kept = (F.col(lang) != langid.UNKNOWN) & (F.col(score) >= F.when(F.length("text") >= SHORT, MIN_COSINE).otherwise(MIN_COSINE_SHORT))
    return told.filter(kept).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lines, dropped = free_name(docs, "_gw_lines"), free_name(docs, "_gw_dropped")
    told = linededup.dedup_lines(spark, docs, min_docs=10, keep="first", n_lines=lines, n_dropped=dropped, bucketed=False)
    emptied = (F.col(dropped) > 0) & (F.btrim("text", F.lit(" \t\n\x0b\f\r")) == "")
    n_chars = {"n_chars": F.length("text").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {}
    return told.filter(~F.coalesce(emptied, F.lit(False))).withColumns(n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(spark, docs, shingle=5, num=80, den=100)
    a, b, n = (free_name(docs, x) for x in ("_gw_a", "_gw_b", "_gw_nth"))
    first = found.filter("first").select(F.col("a").alias(a), F.col("b").alias(b))
    named = docs.select("*", *(F.xxhash64(F.lit(s), "doc_id", "text").alias(x) for s, x in enumerate((a, b))))
    # rows equal in id and text share the names; one of them stays
    nth = F.row_number().over(Window.partitionBy(a, b).orderBy(F.lit(0)))
    return named.join(first, [a, b], "left_semi").withColumn(n, nth).filter(F.col(n) == 1).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # two hashes name a row: with one, clean documents of a large corpus would meet a flagged one's
    hashes = [F.lpad(F.hex(F.xxhash64(F.lit(s), "doc_id", "text")), 16, "0") for s in range(2)]
    mark = free_name(docs, "_gw_row")
    named = docs.withColumn(mark, F.concat(*hashes))
    found = decontam.tile_pairs(spark, named, table(spark, sf_dir, "benchmark"), row=mark)
    flagged = Scratch(spark, "decontaminate").save(found.select(F.col("row").alias(mark)).distinct(), "flagged")
    if flagged.count() <= MAX_BROADCAST:
        flagged = F.broadcast(flagged)
    return named.join(flagged, mark, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, vocabulary(), 2048)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("best_fit_packing", pack),
]

#: No stage but line dedup can be expressed in SQL; tests compare the others with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again for the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
