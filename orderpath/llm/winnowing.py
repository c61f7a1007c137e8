"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. Of each 9 consecutive hashes
of 5 words the smallest is kept as a fingerprint (all places that share it), so two texts
that share 13 words in a row share a fingerprint in them. Fingerprints of documents and items
are joined; each pair of places is a diagonal (place in the document minus place in the
item), and the words along a diagonal are compared: every run of 13 equal words, or the whole
item when it is shorter, is a hit. Items of fewer than 13 words are fingerprinted by their
whole word sequence and looked up by length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpath.llm.common import document_columns, keep_by, stage_table

WINDOW, GRAM = 13, 5
SPAN = WINDOW - GRAM + 1
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; ``lower`` does just that where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), BETWEEN), lambda w: w != "")


def gram_hashes(words: Column, size: int) -> Column:
    """Hash of the ``size`` words from each place on; empty when there are fewer."""
    grams = F.sequence(F.lit(1), F.size(words) - (size - 1))
    whole = F.transform(grams, lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(F.size(words) >= size, whole).otherwise(F.array().cast("array<bigint>"))


def fingerprints(hashes: Column, least: Column) -> Column:
    """``fp``, ``at`` (from 0) of the hashes that are the smallest of some window of SPAN hashes.

    ``least`` holds the smallest hash of every window; a place counts if one of the windows
    around it has its hash.
    """
    places = F.transform(hashes, lambda h, i: F.struct(h.alias("fp"), i.alias("at")))
    around = lambda s: F.slice(least, F.greatest(s["at"] - (SPAN - 2), F.lit(1)), SPAN)
    return F.filter(places, lambda s: F.array_contains(around(s), s["fp"]))


def least_of_windows(hashes: Column) -> Column:
    starts = F.sequence(F.lit(1), F.size(hashes) - (SPAN - 1))
    return F.when(F.size(hashes) >= SPAN, F.transform(starts, lambda i: F.array_min(F.slice(hashes, i, SPAN)))).otherwise(
        F.array().cast("array<bigint>")
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once: inside other lambdas a plain expression would be evaluated for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prints(words: Column) -> Column:
    """Struct of ``n_words`` and ``fps`` of an array of words."""
    of_hashes = lambda h: let(least_of_windows(h), lambda least: fingerprints(h, least))
    return let(words, lambda w: F.struct(F.size(w).alias("n_words"), let(gram_hashes(w, GRAM), of_hashes).alias("fps")))


def grams_of_text(size: int) -> Column:
    return let(words_of(F.col("text")), lambda w: gram_hashes(w, size))


def near_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast what was counted to be small; leave the rest to a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def row_key(docs: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, ``text``: rows of equal id and text share a key, and with it their result."""
    key = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("hash"))
    return document_columns(docs).select(key.alias("row"), "doc_id", "text")


def diagonals(marked: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """``row``, ``item_key``, ``n_words``, ``shift``: where a document may share words with an item."""
    long_items = items.where(F.col("n_words") >= WINDOW).select("item_key", "n_words", F.explode(prints(F.col("words"))["fps"]).alias("f"))
    theirs = stage_table(long_items.select("item_key", "n_words", F.col("f.fp").alias("fp"), F.col("f.at").alias("j")), "item-prints")
    ours = marked.select("row", F.explode("prints.fps").alias("f")).select("row", F.col("f.fp").alias("fp"), F.col("f.at").alias("i"))
    found = ours.join(near_side(theirs, theirs.count()), "fp").select("row", "item_key", "n_words", (F.col("i") - F.col("j")).alias("shift"))
    short = items.where((F.col("n_words") > 0) & (F.col("n_words") < WINDOW))
    for size in sorted(r.n_words for r in short.select("n_words").distinct().collect()):
        of_size = short.where(F.col("n_words") == size).select("item_key", "n_words", F.xxhash64("words").alias("fp"))
        places = docs.select("row", F.posexplode(grams_of_text(size)).alias("shift", "fp"))
        found = found.unionByName(places.join(near_side(of_size, of_size.count()), "fp").drop("fp"))
    return found.distinct()


def hits(candidates: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """``row``, ``item``, ``runs``: spans [start, stop) of document words equal to a window of the item.

    Only the words along the diagonal travel with a candidate; they are compared one by one.
    """
    shifts = candidates.groupBy("row").agg(F.collect_set(F.struct("item_key", "n_words", "shift")).alias("at"))
    texts = docs.join(near_side(shifts, candidates.count()), "row")

    def along(words: Column, a: Column) -> Column:
        first = F.greatest(a["shift"], F.lit(0))
        mine = F.slice(words, first + 1, F.greatest(a["n_words"] + a["shift"] - first, F.lit(0)))
        return F.struct(a["item_key"].alias("item_key"), a["n_words"].alias("n_words"), first.alias("first"), (first - a["shift"]).alias("skip"), mine.alias("mine"))

    slices = let(words_of(F.col("text")), lambda w: F.transform("at", lambda a: along(w, a)))
    paired = texts.select("row", F.explode(slices).alias("a")).select("row", "a.*")
    paired = paired.join(near_side(items.select("item_key", "item", "words"), items.count()), "item_key")
    theirs = F.slice("words", F.col("skip") + 1, F.greatest(F.size("mine"), F.lit(0)))
    same = F.zip_with("mine", theirs, lambda x, y: F.coalesce(x == y, F.lit(False)))
    need = F.least(F.col("n_words"), F.lit(WINDOW))

    def runs(equal: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(equal) - need + 1), lambda i: F.forall(F.slice(equal, i, need), lambda x: x))
        spans = F.transform(starts, lambda i: F.struct((F.col("first") + i - 1).alias("start"), (F.col("first") + i - 1 + need).alias("stop")))
        return F.when(F.size(equal) >= need, spans)

    return paired.select("row", "item", let(same, runs).alias("runs")).where(F.size("runs") > 0)


def covered(spans: Column) -> Column:
    """Number of places in the union of spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def add(s: Column, x: Column) -> Column:
        new = F.greatest(x["stop"] - F.greatest(s["end"], x["start"]), F.lit(0))
        return F.struct(F.greatest(s["end"], x["stop"]).alias("end"), (s["total"] + new).alias("total"))

    return F.aggregate(F.array_sort(spans), start, add, lambda s: s["total"])


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, ``n_words``, ``n_hit``, ``items`` (sorted ids as text) of every row of ``docs``.

    A null or empty text has no words and no hits; an item without words or id hits nothing;
    repeated rows are judged each; an empty benchmark hits nothing. Extra columns are not read.
    """
    keyed = row_key(docs)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    items = items.where("item is not null").withColumn("words", words_of(F.col("text"))).withColumn("n_words", F.size("words"))
    items = items.withColumn("item_key", F.xxhash64("item", "text")).drop("text").dropDuplicates(["item_key"])
    items = stage_table(items, "items")
    marked = stage_table(keyed.select("row", prints(words_of(F.col("text"))).alias("prints")), "prints")
    candidates = stage_table(diagonals(marked, keyed, items), "diagonals")
    found = hits(candidates, keyed, items)
    per_row = found.groupBy("row").agg(
        F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.collect_set("item")).alias("items")
    )
    per_row = stage_table(per_row.select("row", covered(F.col("runs")).alias("n_hit"), "items"), "hits")
    return marked.select("row", "prints.n_words").join(near_side(per_row, per_row.count()), "row", "left").select(
        "row",
        F.when(F.col("row.id") != -(2**63), F.col("row.id")).alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows; all columns as they are, whatever their names."""
    found = find_contamination(docs, benchmark).where(contaminated(F.col("n_hit"), F.col("n_words")))
    bad = stage_table(found.select(F.col("row.id").alias("id"), F.col("row.hash").alias("hash")).distinct(), "contaminated")
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return keep_by(docs, near_side(bad, bad.count()), "left_anti", id=doc_id, hash=F.xxhash64(text))
