"""Exact duplicates with a split of heavy hitters, in DataFrame functions only.

Every text becomes a digest of its normalised form. A Misra-Gries style summary (Spark's
frequent-items aggregate, merged across partitions) names candidate digests that may hold
more than one row in ``1 / HEAVY_SHARE``; their exact counts decide which are heavy, at most
``1 / HEAVY_SHARE`` of them. The winners of heavy groups are broadcast and matched map-side, so a
hot group never meets in one task; all other digests are joined by an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpath.llm.common import document_columns, keep_by, stage_table

SPACES = " \t\n\v\f\r"
HEAVY_SHARE = 1 / 2000
TRACKED = 8192


def digest(text: Column) -> Column:
    """sha256 of the text without the characters of ``[\\x20\\x09-\\x0D]``."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACES, "").cast("binary"), 256))


def winner() -> list[Column]:
    """The row with the most code points, then the smallest doc_id, then the first row read."""
    return [F.min(F.struct("minus_length", "doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")]


def heavy_digests(keys: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Digests that hold more than ``heavy_share`` of the rows, verified by exact counts."""
    most = int(1 / heavy_share)
    guess = keys.agg(F.expr(f"approx_top_k(hex(digest), {most}, {max(TRACKED, 2 * most)})").alias("top"))
    candidates = guess.select(F.explode("top").alias("t")).select(F.unhex("t.item").alias("digest"))
    groups = keys.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*winner())
    bound = keys.agg((F.count(F.lit(1)) * heavy_share).alias("least"))
    return groups.join(F.broadcast(bound), F.col("group_size") > F.col("least")).drop("least")


def group_copies(docs: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``digest``.

    A null text counts as empty, so null, empty and blank texts are one group. Exactly one row
    of a group is kept, also when a row is repeated; among null ids a null comes first. Extra
    columns are not read. An empty table gives no rows.
    """
    keys = document_columns(docs).select(
        "doc_id",
        digest(F.col("text")).alias("digest"),
        (-F.length("text")).alias("minus_length"),
        F.monotonically_increasing_id().alias("row"),
    )
    keys = stage_table(keys, "digests")
    heavy = stage_table(heavy_digests(keys, heavy_share), "heavy-digests")
    few = F.broadcast(heavy)
    light = keys.join(few.select("digest"), "digest", "left_anti")
    parts = [keys.join(few, "digest"), light.join(light.groupBy("digest").agg(*winner()), "digest")]
    rows = parts[0].unionByName(parts[1])
    return rows.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "digest",
    )


def drop_copies(docs: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept, whatever their names.

    Rows are matched by (doc_id, digest), in one shuffle of the texts. Where one kept row was
    repeated under the same id, the extra repeats go too; only such tables are ordered once more.
    """
    groups = stage_table(group_copies(docs, heavy_share), "copies")
    kept = groups.where("kept").select("doc_id", "digest")
    left = keep_by(docs, kept, "left_semi", doc_id=F.col("doc_id").cast("long"), digest=digest(F.col("text")))
    if groups.where("doc_id <=> keep_id and not kept").isEmpty():
        return left
    rows = left.select(F.struct(*[left[f"`{c}`"] for c in left.columns]).alias("document"), F.col("doc_id"), digest(F.col("text")).alias("digest"))
    one = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("digest"))
    return rows.withColumn("number", one).where("number = 1").select("document.*")
