"""Near-duplicate groups by SetSketch registers, banding, joint likelihood and exact checks.

A document is its set of 2-word shingles, hashed to 64 bits. A register of the sketch is the
smallest of one exponential draw per shingle, kept as its exponent to the base BASE and cut to
a fixed range; sketches of parts merge by the larger register, and registers of similar sets
agree. Rows of equal sets are one class, so copies are never compared.

Classes that agree on all registers of a band are candidates. Every class is first compared
with one representative of each of its buckets (a star, never all pairs). Candidates whose
likelihood given both sketches and sizes puts their similarity far below the threshold are
dropped; the others are confirmed on the full sets. Classes of one bucket that are still in
different components after that are candidates too, so no candidate link between components
is left out. Where these would be many pairs, each set is replaced by its difference to a
common centre: |x ^ y| is |Dx ^ Dy|, so sets near the centre are linked for certain and sets
far from it are linked only if their differences share rare elements (prefix filter). At a similarity of 0.8 a pair shares no band with a chance
below 4e-6, and higher ones with less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpath.llm.common import document_columns, keep_by, small_batches, stage_table, texts_of

REGISTERS, ROWS = 252, 6
BANDS = REGISTERS // ROWS
BASE, TOP = 1.01, 8190
PERCENT = 80
MARGIN = 6.0
FAMILIES = 8
DIRECT_PAIRS = 20_000
CENTRE_HASHES = 500_000
BROADCAST_ROWS = 100_000
PLACES_AT_ONCE = 1024
MEMO_WORDS = 50_000
SEEDS = np.random.default_rng(20240229).integers(1, 1 << 32, size=(2, REGISTERS), dtype=np.uint32)
XOR, ODD = SEEDS[0], SEEDS[1] | np.uint32(1)
BAND_FACTORS = np.random.default_rng(3).integers(1, 1 << 63, size=ROWS, dtype=np.uint64) | np.uint64(1)
BAND_SALTS = np.random.default_rng(4).integers(1, 1 << 63, size=BANDS, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct hashes of the 2-word shingles of a text; keeps the hashes of frequent words."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for word in set(words):
            if word not in memo:
                memo[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
        if len(words) == 1:
            return mixed(hashes + np.uint64(1))
        return np.unique(mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + mixed(hashes[1:])))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set: K = floor(1 - log_BASE(smallest draw)), cut to 0 .. TOP.

    Draw i of an element is exponential with rate 1: -log(1 - u) of a uniform u hashed from it.
    """
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, dtype=np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), PLACES_AT_ONCE):
        draws = short[i : i + PLACES_AT_ONCE, None] ^ XOR
        draws *= ODD
        np.minimum(least, draws.min(axis=0), out=least)
    draw = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(draw) / np.log(BASE)), 0, TOP).astype("<i2")


def buckets(sketches: np.ndarray) -> np.ndarray:
    """One number for each sketch and band."""
    parts = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    return mixed((parts * BAND_FACTORS).sum(axis=2) + BAND_SALTS).astype(np.int64)


def likely_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Similarity of most likelihood given which of two sketches has the larger registers.

    With u, v the shares of the two sizes, a register is larger on the left with chance
    p(u - v J) and on the right with p(v - u J), p(x) = -log_BASE(1 - x (BASE - 1) / BASE).
    The log likelihood is concave in J, so its maximum is found by halving on the slope.
    """
    left, right = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - left - right
    u = size_a / (size_a + size_b)
    v = 1 - u
    share = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-x * share) / np.log(BASE)
    slope_p = lambda x: share / (1 - x * share) / np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        j = (low + high) / 2
        x, y = u - v * j, v - u * j
        px, py = np.maximum(p(x), 1e-12), np.maximum(p(y), 1e-12)
        dx, dy = -v * slope_p(x), -u * slope_p(y)
        slope = left * dx / px + right * dy / py - equal * (dx + dy) / np.maximum(1 - px - py, 1e-12)
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2


# ---------------------------------------------------------------- stages


def sketch_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``node``, ``check``, ``sketch`` of every row.

    ``node`` and ``check`` are two 64-bit digests of the set; both and the sketch are null for an
    empty set.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            sizes, nodes, checks, sketches = [], [], [], []
            for text in texts_of(batch.column(2)):
                hashes = shingles(text)
                sizes.append(len(hashes))
                if len(hashes):
                    digest = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), dtype="<i8")
                    nodes.append(int(digest[0]))
                    checks.append(int(digest[1]))
                    sketches.append(registers(hashes).tobytes())
                else:
                    for column in (nodes, checks, sketches):
                        column.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(sketches, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "node", "check", "sketch"],
            )

    rows = document_columns(small_batches(docs)).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(work, "doc_id long, text_hash long, n_shingles long, node long, check long, sketch binary")


def classes_of(sketched: DataFrame) -> DataFrame:
    """One row per distinct set; two sets with the same 64-bit ``node`` raise instead of being merged."""
    groups = sketched.where("node is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"),
        F.min("check").alias("low"),
        F.max("check").alias("high"),
        F.first("n_shingles").alias("n"),
        F.first("sketch").alias("sketch"),
    )
    safe = F.when(F.col("low") == F.col("high"), F.col("node")).otherwise(F.raise_error(F.lit("two sets share a digest")).cast("long"))
    return groups.select(safe.alias("node"), "first", "n", "sketch")


def band_rows(classes: DataFrame) -> DataFrame:
    """``node``, ``bucket``: one row per class and band."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sketches = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<i2").reshape(-1, REGISTERS)
                keys = buckets(sketches)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), BANDS))), pa.array(keys.ravel())], ["node", "bucket"]
                )

    return classes.select("node", "sketch").mapInArrow(work, "node long, bucket long")


def likely_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` that the sizes and the likelihood leave possible."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT)
    least = PERCENT / 100 - MARGIN * np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sketches = [np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<i2").reshape(-1, REGISTERS) for i in (4, 5)]
                sizes = [batch.column(i).to_numpy().astype(np.float64) for i in (2, 3)]
                yield batch.select(["a", "b"]).filter(pa.array(likely_similarity(*sketches, *sizes) >= least))

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(work, "a long, b long")


def shingle_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node``, ``hashes`` of the given classes, written; one text of each is read and shingled again."""
    wanted = stage_table(
        nodes.join(classes, "node").select("node", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")), "wanted"
    )
    texts = document_columns(docs).withColumn("_text_hash", F.xxhash64("text"))
    texts = texts.join(near_side(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            sets = [shingles(text).view(np.int64) for text in texts_of(batch.column(1))]
            if sets:
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["node", "hashes"]
                )

    sets = texts.select("node", "text").mapInArrow(work, "node long, hashes array<bigint>").dropDuplicates(["node"])
    return stage_table(sets, "shingle-sets")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs whose full sets pass 100 * intersection >= PERCENT * union.

    Only the texts of classes in some pair are read and shingled again, one for each class.
    """
    sets = shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, docs)
    side = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.withColumn("common", F.size(F.array_intersect("h_a", "h_b")).cast("long"))
    union = F.size("h_a") + F.size("h_b") - F.col("common")
    return both.where(F.col("common") * 100 >= union * PERCENT).select("a", "b")


def near_side(df: DataFrame) -> DataFrame:
    """Broadcast a written table that was counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def star_pairs(bands: DataFrame) -> DataFrame:
    """Each class with one representative of each of its buckets, ``a`` > ``b``.

    Buckets of one family choose alike, by a hash of the class, so the buckets of a group name
    few representatives, but not only one that may happen to lie at its rim.
    """
    family = F.pmod(F.col("bucket"), F.lit(FAMILIES))
    ranked = bands.withColumn("rank", F.struct(F.xxhash64("node", family).alias("h"), F.col("node").alias("node")))
    shared = ranked.groupBy("bucket").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first != last")
    both = bands.join(shared.select("bucket", F.col("first.node").alias("p")), "bucket").where("node != p")
    return both.select(F.greatest("node", "p").alias("a"), F.least("node", "p").alias("b")).distinct()


def mixed_buckets(bands: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``bucket``, ``node``, ``comp`` of buckets that hold several components, and ``bucket``,
    ``major`` (its largest component), ``few``.

    ``few`` tells whether all buckets of one ``major`` have at most DIRECT_PAIRS pairs of a class
    outside it with any other.
    """
    placed = bands.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("bucket")
    placed = stage_table(placed.join(several, "bucket"), "mixed-buckets")
    counts = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
    largest = largest.select("bucket", F.col("top.comp").alias("major"), ((F.col("all") - F.col("top.n")) * F.col("all")).alias("pairs"))
    many = largest.groupBy("major").agg((F.sum("pairs") <= DIRECT_PAIRS).alias("few"))
    return placed, stage_table(largest.join(many, "major").select("bucket", "major", "few"), "bucket-majors")


def cross_pairs(placed: DataFrame, majors: DataFrame) -> DataFrame:
    """Pairs of one bucket in different components: each class outside the bucket's largest
    component with all classes of the other components there."""
    few = majors.where("few").select("bucket", "major")
    placed = placed.join(few, "bucket")
    minor = placed.where("comp != major").select("bucket", F.col("node").alias("p"), F.col("comp").alias("p_comp"))
    both = minor.join(placed, "bucket").where("comp != p_comp")
    return both.select(F.greatest("p", "node").alias("a"), F.least("p", "node").alias("b")).distinct()


def counted_hashes(members: DataFrame) -> DataFrame:
    """``g``, ``e``, ``n``: how many sets of group ``g`` hold ``e``, summed within each batch only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.table([batch.column(0).take(pc.list_parent_indices(batch.column(1))), pc.list_flatten(batch.column(1))], ["g", "e"])
            counts = rows.group_by(["g", "e"]).aggregate([([], "count_all")])
            yield from counts.select(["g", "e", "count_all"]).rename_columns(["g", "e", "n"]).to_batches()

    return members.select("g", "hashes").mapInArrow(work, "g long, e long, n long")


def differences(placed: DataFrame, majors: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``g``, ``node``, ``comp``, ``slack``, ``d``: the classes in buckets of one large group ``g`` and
    each one's difference ``d`` to the group's centre, the shingles of more than half of its classes.

    A centre has less than twice the shingles of a mean class. ``slack`` is |x| - 9 |d|: two classes
    are similar by 0.8 when 9 |x ^ y| <= |x| + |y|, for certain when their slacks sum to 0 or more.
    """
    members = placed.join(majors.where("not few").select("bucket", F.col("major").alias("g")), "bucket")
    members = stage_table(members.select("g", "node", "comp").distinct(), "group-members")
    sets = shingle_sets(members.select("node").distinct(), classes, docs)
    members = stage_table(members.join(sets, "node"), "group-sets")
    half = stage_table(members.groupBy("g").agg((F.count(F.lit(1)) / 2).alias("half")), "halves")
    shares = counted_hashes(members).groupBy("g", "e").agg(F.sum("n").alias("n"))
    centres = shares.join(near_side(half), "g").where("n > half").groupBy("g").agg(F.collect_list("e").alias("centre"))
    centres = stage_table(centres, "centres")
    size = centres.agg(F.sum(F.size("centre"))).first()[0] or 0
    both = members.join(F.broadcast(centres) if size <= CENTRE_HASHES else centres, "g", "left")
    centre = F.coalesce("centre", F.array().cast("array<bigint>"))
    d = F.concat(F.array_except("hashes", centre), F.array_except(centre, F.col("hashes")))
    both = both.select("g", "node", "comp", F.size("hashes").alias("n"), d.alias("d"))
    return stage_table(both.select("g", "node", "comp", (F.col("n") - 9 * F.size("d")).alias("slack"), "d"), "differences")


def centre_pairs(apart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Certain links, and pairs that may be links, of ``differences``; every other pair is none.

    If two slacks sum to 0 or more, both do with the largest slack of the group, so stars at that
    class hold all certain links. A pair with slacks below that needs -(sum of slacks) / 18 common elements in
    its differences. With elements in order of their frequency, the first common one lies no nearer
    to the end than this in either; only such places are joined.
    """
    nearest = apart.groupBy("g").agg(F.max(F.struct("slack", "node")).alias("z"))
    nearest = stage_table(nearest.select("g", F.col("z.slack").alias("z_slack"), F.col("z.node").alias("z")), "nearest")
    placed = apart.join(near_side(nearest), "g").withColumn("sure", F.col("slack") + F.col("z_slack") >= 0)
    links = placed.where("sure and node != z").select(F.greatest("node", "z").alias("a"), F.least("node", "z").alias("b"))
    rim = stage_table(placed.where("not sure").groupBy("g").agg(F.max("slack").alias("rim_slack")), "rims")
    placed = placed.join(near_side(rim), "g").withColumn("partner", F.when(F.col("sure"), F.col("rim_slack")).otherwise(F.col("z_slack")))
    placed = placed.withColumn("size", F.size("d")).where("18 * size >= -(slack + partner)")
    placed = stage_table(placed.select("g", "node", "comp", "slack", "sure", "partner", "size", "d"), "near-enough")
    rows = placed.select("g", "node", F.explode("d").alias("e"))
    often = rows.groupBy("g", "e").agg(F.count(F.lit(1)).alias("f"))
    order = rows.join(often, ["g", "e"]).groupBy("g", "node").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("order"))
    places = placed.drop("d").join(order, ["g", "node"]).select("*", F.posexplode("order").alias("pos", "o"))
    places = places.withColumn("left", F.col("size") - F.col("pos")).where("o.f > 1 and 18 * left >= -(slack + partner)")
    places = stage_table(places.select("g", F.col("o.e").alias("e"), "node", "comp", "slack", "sure", "left"), "places")
    x, y = places.where("not sure").alias("x"), places.alias("y")
    near = 18 * F.least("x.left", "y.left") >= -(F.col("x.slack") + F.col("y.slack"))
    once = F.col("y.sure") | (F.col("x.node") < F.col("y.node"))
    same = (F.col("x.g") == F.col("y.g")) & (F.col("x.e") == F.col("y.e"))
    pairs = x.join(y, same & near & once & (F.col("x.comp") != F.col("y.comp")))
    return links, pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``comp`` (smallest node reachable) of the nodes in ``links`` (``a`` > ``b``).

    Alternates large and small stars until nothing changes; a node joins with the minimum of
    its neighbours only, and each step is written.
    """
    edges = stage_table(links.distinct(), "stars")
    seen = None
    while True:
        edges = stage_table(small_star(large_star(edges)), "stars")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("comp"))
            ).distinct()
        seen = mark


def large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node point to the smallest of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def group_near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``component_id``, ``kept`` of every row.

    ``component_id`` is the smallest doc_id linked with the row over any number of links. Rows
    without words are linked with nothing. Null ids come after all others: a component of null
    ids only has a null component. A row is kept when its id is the component's; rows that repeat an
    id and text are kept or dropped alike. Extra columns are not read; an empty table gives no rows.
    """
    sketched = stage_table(sketch_documents(docs), "sketches")
    classes = stage_table(classes_of(sketched), "classes")
    bands = band_rows(classes)
    tried = stage_table(star_pairs(bands), "star-pairs")
    links = stage_table(confirmed(stage_table(likely_pairs(tried, classes), "likely"), classes, docs), "links")
    labels = components(links)
    placed, majors = mixed_buckets(bands, labels)
    rest, certain = cross_pairs(placed, majors), links.limit(0)
    if not majors.where("not few").isEmpty():
        certain, far = centre_pairs(differences(placed, majors, classes, docs))
        rest = rest.unionByName(far).distinct()
    rest = rest.join(tried, ["a", "b"], "left_anti")
    more = stage_table(confirmed(stage_table(likely_pairs(rest, classes), "likely"), classes, docs), "links")
    labels = stage_table(components(links.unionByName(more).unionByName(certain)), "labels")
    named = sketched.drop("sketch", "check").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = stage_table(named, "named")
    smallest = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    return named.join(smallest, "comp", "left").select(
        "doc_id", "text_hash", "n_shingles", component, F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group; all columns as they are, whatever their names.

    Rows that repeat a kept id and text stay with it.
    """
    gone = group_near_duplicates(docs).where("not kept").select("doc_id", "text_hash")
    gone = stage_table(gone.distinct(), "near-copies")
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return keep_by(docs, near_side(gone), "left_anti", doc_id=F.col("doc_id").cast("long"), text_hash=text_hash)
