"""A corpus through five of the operators: toxicity, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. run() writes each stage's rows to the shared folder and reads them again for the next.

Defined cases: no stage crashes on nulls in any column, on empty or very long texts, on repeated rows, on an
empty table (which stays empty, with the same columns) or on columns that bear names of a stage's own, which are kept as
they are. A row without text is clean to all stages; what each does with ties and equal rows stands in its module.
"""

from codequarry.llm import decontaminate, near_dup, packing, secrets, toxicity
from codequarry.llm.common import fold, materialize, table
from pyspark.sql import functions as F


def drop_toxic(spark, docs, sf_dir):
    """Documents that score 0.7 or more go. The labels are learnt as in query op2."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("id"), 3) != 1)
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays (five words, similarity 0.8)."""
    return near_dup.drop_near_duplicates(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a benchmark window go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark, docs, sf_dir):
    """Live secrets are replaced in the text; n_chars follows. All documents stay."""
    clean = secrets.redact_live(docs, repo=F.concat_ws("/", "source", "lang"))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def pack(spark, docs, sf_dir):
    """The sequences that the documents are packed into, a row for each piece."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else materialize(docs), sf_dir)
    return docs
