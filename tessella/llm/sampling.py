"""A bounded sample of labelled rows, to fit classifiers on."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.shared import discard, materialise


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(id, text, lang, y): at most ``rows`` labelled documents, those with the smallest id hashes.

    Rows without id or label aren't used; of several labels for an id the largest
    counts, of several texts the smallest. ``lang`` is null where ``docs`` has no such
    column. The ids are bounded by ``rows``, so they are broadcast and the
    documents are not shuffled. The sample is written; ``discard`` it after use.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    ids = ids.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    ids = materialise(ids.orderBy(F.xxhash64("id"), "id").limit(rows), "sample_ids")
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    texts = docs.select(F.col(id_col).alias("id"), F.struct(F.coalesce(F.col(text_col), F.lit("")).alias("text"), lang.cast("string").alias("lang")).alias("d"))
    found = texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("d").alias("d"), F.max("y").alias("y"))
    sample = materialise(found.select("id", "d.text", "d.lang", "y"), "sample")
    discard(ids)
    return sample
