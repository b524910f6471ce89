"""The detectors for users of SQL: temporary views over a table or view of documents.

    views(spark, "documents")
    SELECT type, count(*) FROM documents_entities WHERE status = 'confirmed' GROUP BY type
    SELECT d.doc_id, l.value FROM documents d JOIN documents_leaks l USING (doc_id)

The views are plans, not results: what a query asks of them (columns, documents) reaches the scan below, and a view of
today reads the table as it is when it is queried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veladura.operators import anonymize, audit


def leaks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to one row for each leak that the audit finds: doc_id, type, value, start, stop, seq."""
    return docs.select("doc_id", F.explode(audit.leaks(F.col("text"))).alias("l")).select("doc_id", "l.*")


#: What each view gives of documents (doc_id, text).
VIEWS = {"entities": anonymize.entities, "leaks": leaks, "anonymized": anonymize.anonymized}


def views(spark: SparkSession, documents: str, doc_id: str = "doc_id", text: str = "text", prefix: str | None = None) -> list[str]:
    """Creates or replaces the views of VIEWS over a table or view, named after it (or the prefix); gives their names."""
    docs = spark.table(documents).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = []
    for kind, made in VIEWS.items():
        names.append(f"{prefix or documents.replace('.', '_')}_{kind}")
        made(docs).createOrReplaceTempView(names[-1])
    return names
