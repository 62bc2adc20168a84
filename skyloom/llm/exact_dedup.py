"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A text is cut into chunks where its own content says so: at the first sentence or line end after 255
characters, or after 4096 characters without one. Equal texts have equal chunks, and an insertion moves only
the boundaries near it. A document's recipe is the ordered list of its chunks' identifiers.

Chunk texts are moved once per map task, to give each distinct chunk a verified identifier: its 64-bit digest, and
a variant number where two different chunks share a digest. Long documents themselves are never shuffled;
recipes of eight bytes a chunk are compared instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import ascii_lower, id_and_text, staged

CHUNK = r"(?s).{255,4095}?(?:[.!?\n]|\z)|.{1,4096}"


def _digest(chunk):
    return F.xxhash64(chunk)


def chunk_variants(chunks: DataFrame) -> DataFrame:
    """``(digest, chunk, variant)`` of the digests that several different chunks share.

    ``chunks`` has ``digest`` and ``chunk`` in any number of rows. Grouping is by the chunk's own bytes, so what is
    not returned is verified: one digest, one chunk. Rows are combined before the shuffle, so a chunk
    that every document has costs one row per map task.
    """
    distinct = chunks.groupBy("digest", "chunk").agg(F.count(F.lit(1)).alias("n"))
    shared = distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    by_text = Window.partitionBy("digest").orderBy("chunk")
    return distinct.join(shared, "digest", "left_semi").select(
        "digest", "chunk", F.row_number().over(by_text).alias("variant"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=_digest) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z only; null counts as empty, and all empty texts
    are one group. The row with the largest id stays; in a group without any id the ``keep_id`` is null. Rows that
    repeat one id and text are one document: each counts in ``group_size`` and carries the same decision. An empty
    table gives no rows; further columns are ignored whatever their names. ``digest`` maps a chunk to its
    identifier before verification; any function of the chunk gives right results.
    """
    texts = id_and_text(docs, id_col, text_col).select("id", ascii_lower(F.col("text")).alias("text"))
    cut = F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0))
    recipes = staged(texts.select(
        "id", F.sha2("text", 256).alias("sha"), F.transform(cut, digest).alias("recipe")), "recipes")
    occurrences = texts.select("id", F.sha2("text", 256).alias("sha"), F.posexplode(cut).alias("at", "chunk")).withColumn(
        "digest", digest(F.col("chunk")))
    variants = staged(chunk_variants(occurrences.select("digest", "chunk")), "variants")
    if variants.isEmpty():
        recipes = recipes.withColumn("resolved", F.lit(None).cast("array<struct<at:int,variant:int>>"))
    else:
        resolved = occurrences.join(variants, ["digest", "chunk"]).groupBy("id", "sha").agg(
            F.array_sort(F.collect_set(F.struct("at", "variant"))).alias("resolved"))
        recipes = recipes.join(resolved, recipes.id.eqNullSafe(resolved.id) & (recipes.sha == resolved.sha), "left").select(
            recipes.id, recipes.sha, "recipe", "resolved")
    key = ["recipe", "resolved"]
    recipes = recipes.withColumn("resolved", F.coalesce("resolved", F.array().cast("array<struct<at:int,variant:int>>")))
    groups = recipes.groupBy(*key).agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return recipes.join(groups, key).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of equal texts, with all its columns: that with the largest id.

    Of rows that repeat one id and text, one stays. Rows without an id count as the smallest.
    """
    # Null ids become texts that no number has, so ids and digests are plain join keys.
    key = lambda column: F.coalesce(column.cast("string"), F.lit("none"))
    kept = exact_duplicates(docs, id_col, text_col).filter("kept").select(
        key(F.col("doc_id")).alias("id"), F.col("text_sha256").alias("sha")).distinct()
    rows = docs.select(key(docs[id_col]).alias("id"), F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))), 256).alias("sha"),
                       F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    one = rows.join(kept, ["id", "sha"], "left_semi").groupBy("id", "sha").agg(F.first("row").alias("row"))
    return one.select("row.*")
