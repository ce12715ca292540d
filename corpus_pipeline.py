"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
``documents``, whole and unchanged for the rows they keep.  The stages' decisions:

* quality: documents whose score is below 0.3 go;
* near_duplicates: of every group of near copies (five-word shingles, similarity of 0.80 or more) the document with
  the smallest id stays;
* decontaminate: documents in which a benchmark window occurs go;
* pack: what is left becomes token sequences, returned as one row per piece.

Defined results, in every stage: an empty table stays empty; rows with a null id stay, as no decision names them; rows that
share an id are kept or dropped together by the two stages that decide by id, and one by one by the quality stage, which
judges each text; a null or empty text is judged as empty, is nobody's copy and holds no window; repeated rows stay repeated
rows; extra columns, whatever their names, come out as they went in.

No stage has a SQL counterpart as a whole (learned scores, tokens), so ``ORACLE_SQL`` is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontam, neardup, packing, quality
from graphloom.llm.queries import tokenizer_file
from graphloom.llm.scratch import exact, stash

CUTOFF = 0.3
NEAR_PERCENT = 80


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` whose doc_id is not in ``gone``; rows with a null id stay."""
    gone = stash(gone.select("doc_id").distinct(), "gone")
    few = gone.count() <= neardup.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*map(exact, docs.columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores at least ``CUTOFF``; a score equal to it stays."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), cutoff=CUTOFF)
    score = "score"
    while score in {c.lower() for c in docs.columns}:
        score = "_" + score
    return quality.score_documents(docs, model, cutoff=CUTOFF, into=score).where(F.col(score) >= CUTOFF).select(*map(exact, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose document is its group's smallest id; without a copy a document is its own group."""
    return without(docs, neardup.near_duplicates(docs, percent=NEAR_PERCENT).where("doc_id != component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no benchmark window occurs."""
    found = decontam.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.where("n_hit > 0"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence; ties between windows go to the one opened first."""
    return packing.piece_digests(packing.pack_documents(docs, tokenizer_file(), end_id=2))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
