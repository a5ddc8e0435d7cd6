"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups.

``groups`` hashes every text to 128 bits (MD5) and groups by hash *and* text:
the text in the grouping key is the byte comparison, so two texts that share a
hash by collision stay two groups. Map-side combining folds the copies that a
task reads before anything is shuffled, so a text held by a third of all rows
moves once per task. ``classes`` names the surviving row of every document,
``survivors`` returns the surviving rows with all their columns.

Defined results: a null text counts as empty; rows with a null id are counted
in their group and survive only if no row of the group has an id; repeated
rows (same id and text) are one document, which ``survivors`` writes once and
``classes`` reports on each line; an empty table gives an empty result; all
other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featsearch.llm.common import join_hot, stored


def _text(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def _hashed(docs: DataFrame, id_col: str, text_col: str, hash128) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").alias("id"), _text(text_col).alias("text")
    ).withColumn("h", hash128(F.col("text")))


def groups(docs: DataFrame, id_col="doc_id", text_col="text", keep="smallest", hash128=F.md5) -> DataFrame:
    """One row per distinct text: ``h, text, keep_id, group_size``."""
    pick = F.min if keep == "smallest" else F.max
    return _hashed(docs, id_col, text_col, hash128).groupBy("h", "text").agg(
        pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


def classes(docs: DataFrame, id_col="doc_id", text_col="text", keep="smallest", hash128=F.md5) -> DataFrame:
    """``id, text_sha256, keep_id, group_size, kept`` of every row.

    The groups are written once without their texts. Rows find their group by
    hash; only if some hash holds more than one text do the rows of those
    hashes go through a second join that compares the text as well.
    """
    lone, several = F.col("n_texts") == 1, F.col("n_texts") > 1
    per_hash = stored(
        groups(docs, id_col, text_col, keep, hash128)
        .groupBy("h")
        .agg(
            F.count(F.lit(1)).alias("n_texts"),
            F.min("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
        )
    )
    rows = _hashed(docs, id_col, text_col, hash128)
    narrow = rows.select("id", "h", F.sha2("text", 256).alias("text_sha256"))
    out = join_hot(narrow, per_hash.where(lone).drop("n_texts"), "h")
    collided = per_hash.where(several).select("h")
    if not collided.isEmpty():
        clash = rows.join(collided, "h", "left_semi")
        exact = groups(docs, id_col, text_col, keep, hash128).join(collided, "h", "left_semi")
        out = out.unionByName(
            clash.join(exact, ["h", "text"]).select(
                "id", "h", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"
            )
        )
    return out.select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def survivors(docs: DataFrame, id_col="doc_id", text_col="text", keep="smallest", hash128=F.md5) -> DataFrame:
    """The surviving rows of ``docs`` with all columns, in one shuffle."""
    pick = F.min if keep == "smallest" else F.max
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    # rows without an id lose against any row with one, under either order
    has_id = F.col(f"`{id_col}`").isNull() if keep == "smallest" else F.col(f"`{id_col}`").isNotNull()
    row = F.struct(
        has_id.alias("k"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text_col}`").isNull().alias("was_null"),
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)],
    )
    kept = (
        docs.select(_text(text_col).alias("text"), row.alias("row"))
        .withColumn("h", hash128(F.col("text")))
        .groupBy("h", "text")
        .agg(pick("row").alias("row"))
    )
    cols = {id_col: F.col("row.id"), text_col: F.when(~F.col("row.was_null"), F.col("text"))}
    cols |= {c: F.col(f"row.c{i}") for i, c in enumerate(rest)}
    return kept.select(*[cols[c].alias(c) for c in docs.columns])
