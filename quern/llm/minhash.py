"""Near-duplicate documents by MinHash and a signature-coordinate inverted join (operator 2).

1. Each text becomes its set of word shingles (64-bit hashes); equal sets are one
   class, so exact copies cost one row each and never meet in pairs.
2. A class's signature has COORDINATES minima; each coordinate-value pair is a
   posting key.  A key that only one class has cannot match and is dropped; a
   class with fewer than ``least`` keys left has no partner.
3. Prefix: keys are ordered by how many classes have them.  Two signatures that
   agree on ``least`` coordinates share a key among the first (keys - least + 1)
   of each; only those are posted.  Collisions are then counted on the whole
   signatures, and pairs under ``least`` are skipped without reading their sets.
4. Shingles that no other posted class has are set aside: they count in a set's
   size and are in no intersection.  A class whose other shingles are fewer than
   ``percent`` of its set has no partner and leaves.
5. Posted classes are joined to one hub per key (the class whose keys are most
   common), never to all of a group; verified links merge components.
6. What is left are pairs of classes in different components.  They share a
   shingle of the first few of each, rarest first; groups by these are paired if
   they are small.  In a large group, linked classes differ from a hub in the
   same shingles; they are grouped by these, again and again until few pairs are
   left (``_settled`` proves that no link is lost).  Where that does not lower the
   pairs, sets are grouped by bands of ROWS minima: a link at the bound shares no
   band with probability under MISS_BANDS.
7. Of all these pairs, those with enough collisions are read; links are confirmed by the number of shingles in both and the full sets' sizes.

``least`` is the largest threshold that loses a pair at the similarity bound
with probability under MISS, for coordinates that agree independently.

Defined cases: a null text or one without words has the empty set and is linked
with nothing; rows that share an id are one document and share its component;
rows without an id take the component of their copies and get a null component
if no copy has an id; an empty table gives an empty result; other columns are
never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import rolling
from .graph import components

COORDINATES = 40
MISS = 1e-7
#: Ids of classes whose rows have no id are at least this.
NO_ID = 1 << 62
#: Steps of regrouping at most; FEW pairs a posted class are compared at once; rows with a hub, a posted class, that are regrouped at most.
LEVELS, FEW, HUBBED = 8, 16, 2
#: Stands for the shingles that only the hub has, after all others in order.
LONE = (1 << 63) - 1
#: Minima that make a band; a link at the bound has no band in common with probability under MISS_BANDS.
ROWS, MISS_BANDS = 12, 1e-9
#: Pairs of a group that are compared, as ``_open`` tells its size.
PAIRS = "minor * (all - minor) + minor * (minor - 1) div 2"

_odd = C.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_seed = C.mix(np.arange(101, COORDINATES + 101, dtype=np.uint64))


def least_matches(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest t with P(fewer than t of the coordinates agree) < miss at the bound."""
    p, below, t = percent / 100, 0.0, 0
    while t < coordinates and below + (more := comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)) < miss:
        below += more
        t += 1
    return t


def band_count(percent: int) -> int:
    """The fewest bands with P(no band agrees) < MISS_BANDS at the bound."""
    return ceil(log(MISS_BANDS) / log1p(-((percent / 100) ** ROWS))) if percent < 100 else 1


def shingle_sets(text: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat distinct shingle hashes, ascending within each row, and their offsets.

    A row with fewer words than a shingle has its whole sequence as the only one.
    """
    flat, off = C.words_of(pc.ascii_lower(text))
    data, at = C.buffers(flat.cast(pa.large_string()))
    h = C.mix(rolling.span_hash(rolling.prefix(data), at[:-1], at[1:]))
    n = np.diff(off)
    count = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    start = C.spread(off[:-1], count)
    row = np.repeat(np.arange(len(n)), count)
    g = np.minimum(n[row], words).astype(np.uint64)
    for j in range(words):
        inside = start + j < off[1:][row]
        g = C.mix(g * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, h[np.minimum(start + j, max(len(h) - 1, 0))] if len(h) else np.uint64(0), np.uint64(0)))
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))])


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in C.chunks(batch, "text"):
                g, off = shingle_sets(text, words)
                n = np.diff(off)
                full = np.flatnonzero(n)
                keys = np.zeros((len(full), COORDINATES), np.uint64)
                ca, cb = _sums(g, off)
                if len(full):
                    at = off[:-1][full]
                    for j in range(COORDINATES):
                        keys[:, j] = C.mix(np.minimum.reduceat((g ^ _seed[j]) * _odd[j], at) + _seed[j])
                ends = np.zeros(len(n) + 1, np.int32)
                ends[1:] = np.cumsum(n > 0) * COORDINATES
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array(ca), pa.array(cb), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64).ravel()))],
                    ["doc_id", "dk", "n", "ca", "cb", "keys"],
                )

    return run


def _sums(g: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each row's set; together they name the set."""
    n = np.diff(off)
    full = np.flatnonzero(n)
    ca, cb = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(full):
        ca[full] = np.add.reduceat(C.mix(g + np.uint64(1)), off[:-1][full])
        cb[full] = np.add.reduceat(C.mix(g ^ np.uint64(0x5851F42D4C957F2D)), off[:-1][full])
    return ca.view(np.int64), cb.view(np.int64)


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, text in C.chunks(batch, "text"):
                g, off = shingle_sets(text, words)
                ca, cb = _sums(g, off)
                yield pa.RecordBatch.from_arrays([pa.array(ca), pa.array(cb), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(g.view(np.int64)))], ["ca", "cb", "shingles"])

    return run


def _both(pairs: DataFrame, side: DataFrame, *names: str) -> DataFrame:
    """``pairs(a, b, ...)`` with the named columns of a and of b, suffixed 1 and 2."""
    for end, k in (("a", 1), ("b", 2)):
        pairs = pairs.join(side.select(F.col("cid").alias(end), *[F.col(c).alias(f"{c}{k}") for c in names]), end)
    return pairs


def _groups(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """One row per row of ``docs`` (``doc_id, dk, n, ca, cb``), and the components of the classes (ca, cb)."""
    spark, start = docs.sparkSession, C.mark()
    least = least_matches(percent)
    slim = C.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("dk"), "text")
    sketch = C.written(slim.mapInArrow(_sketch(words), "doc_id long, dk long, n long, ca long, cb long, keys array<long>"), "sketch")
    # ids that rows with different texts share name no class; their classes are linked below
    several = sketch.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("ca").alias("x"), F.max("ca").alias("y")).where("x <> y").select("doc_id")
    clash = several.limit(1).count() > 0
    named = sketch.where("n > 0")
    named = named.join(several.withColumn("odd", F.lit(True)), "doc_id", "left") if clash else named.withColumn("odd", F.lit(False))
    own = F.when(F.col("doc_id").isNull() | F.coalesce("odd", F.lit(False)), F.abs(F.xxhash64("ca", "cb") % NO_ID) + NO_ID).otherwise(F.col("doc_id"))
    classes = C.written(
        named.groupBy("ca", "cb").agg(F.min(F.struct(own.alias("cid"), "n", "keys")).alias("x"), F.min("doc_id").alias("first_id")).select("ca", "cb", "first_id", "x.cid", "x.n", "x.keys"), "classes"
    )
    links = spark.createDataFrame([], "a long, b long")
    if clash:
        of_id = sketch.where("n > 0").join(several, "doc_id").join(classes.select("ca", "cb", "cid"), ["ca", "cb"]).select("doc_id", "cid")
        links = of_id.join(of_id.groupBy("doc_id").agg(F.min("cid").alias("a")), "doc_id").select("a", F.col("cid").alias("b")).where("a <> b").distinct()

    posts = classes.select("cid", F.explode("keys").alias("key"))
    # written, so that the join below has a plain exchange on either side and Spark can split a hot key's rows
    common = C.written(posts.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "keys")
    ordered = (
        posts.join(common, "key")
        .groupBy("cid")
        .agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("own"), F.sum("df").alias("weight"))
        .where(F.size("own") >= least)
    )
    posted = C.written(ordered.select("cid", "weight", F.explode(F.expr(f"slice(own, 1, size(own) - {least} + 1)")).alias("x")).select("cid", "weight", "x.key"), "posted")
    marked = C.written(posted.select("cid").distinct(), "marked")
    texts = C.only(slim, marked.select(F.col("cid").alias("doc_id")), "doc_id").select("text")
    lone = marked.where(f"cid >= {NO_ID}").limit(1).count() > 0
    if lone:  # their texts are found by what they hold
        texts = texts.unionByName(slim.where("doc_id IS NULL").select("text"))
        texts = texts.unionByName(slim.join(several, "doc_id", "left_semi").select("text")) if clash else texts
    sets = texts.mapInArrow(_set_rows(words), "ca long, cb long, shingles array<long>").join(classes.select("ca", "cb", "cid", "n", "keys"), ["ca", "cb"])
    sets = _shared(C.written(sets.dropDuplicates(["cid"]).select("cid", "n", "keys", "shingles"), "sets"), percent)
    posted = C.written(C.only(posted, C.written(sets.select("cid"), "shared-ids"), "cid"), "posted")

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        """Pairs with enough collisions, and whether they are links."""
        near = _both(pairs, sets.select("cid", "n", "keys"), "n", "keys").where(F.size(F.array_intersect("keys1", "keys2")) >= least)
        near = C.written(near.where(100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")).select("a", "b", "n1", "n2"), f"{tag}-near")
        inter = _both(near, _of(near, "a", "b").select("cid", "shingles"), "shingles").select("a", "b", "n1", "n2", F.size(F.array_intersect("shingles1", "shingles2")).cast("long").alias("inter"))
        return C.written(inter.select("a", "b", (100 * F.col("inter") >= percent * (F.col("n1") + F.col("n2") - F.col("inter"))).alias("linked")), tag)

    def _of(pairs: DataFrame, *ends: str) -> DataFrame:
        return C.only(sets, C.written(pairs.select(F.explode(F.array(*ends)).alias("cid")).distinct(), "ends"), "cid")

    nodes = posted.select("cid").distinct()
    comp = nodes.select("cid", F.col("cid").alias("comp"))
    if clash:
        comp = _merged(nodes.unionByName(links.select(F.explode(F.array("a", "b")).alias("cid"))).distinct().select("cid", F.col("cid").alias("comp")), links)
    # one hub for each key, and one class of each other component of the key
    heads = posted.join(comp, "cid").groupBy("key", "comp").agg(F.max(F.struct("weight", (-F.col("cid")).alias("minus"))).alias("top"))
    heads = heads.select("key", "comp", "top", (-F.col("top.minus")).alias("head"))
    hubs = heads.groupBy("key").agg(F.max("top").alias("best"), F.count("*").alias("k")).where("k > 1").select("key", (-F.col("best.minus")).alias("hub"))
    pairs = heads.join(hubs, "key").where("head <> hub").select(F.least("head", "hub").alias("a"), F.greatest("head", "hub").alias("b")).distinct()
    before = C.mark()
    comp = _merged(comp, verified(pairs, "links").where("linked"))
    C.drop_since(spark, before, comp)
    # linked sets share one of the first of their shingles; their sizes are in one band or in neighbouring ones (a little wider than percent, for rounding)
    first = sets.select("cid", "n", F.explode(F.expr(f"slice(shingles, 1, cast(size(shingles) - ({percent} * n + 99) div 100 + 1 AS int))")).alias("item"))
    band = F.floor(F.log(F.col("n").cast("double")) / (1.001 * log(100 / percent)))
    banded = first.select("cid", "item", F.explode(F.array(band, band - 1)).alias("band")) if percent < 100 else first.withColumnRenamed("n", "band")
    comp = _settled(C.written(banded.select(F.xxhash64("item", "band").alias("key"), "cid"), "groups"), sets, comp, verified, _of, percent, marked.count())
    C.drop_since(spark, start, sketch, classes, comp)
    return sketch, classes, comp


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``cid, comp`` once the components of the ends of ``links(a, b)`` are one."""
    ends = links.select("a", "b").join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    found = components(ends)
    return C.written(comp.join(found, comp["comp"] == found["node"], "left").select("cid", F.coalesce("component", "comp").alias("comp")), "comp")


def _shared(sets: DataFrame, percent: int) -> DataFrame:
    """``sets`` that may have a partner, their ``shingles`` only those that another set has, rarest first, and how common these are."""
    for _ in range(2):  # without the sets that leave, fewer shingles are shared
        each = sets.select("cid", F.explode("shingles").alias("item"))
        # written, so that the join below has a plain exchange on either side and Spark can split a hot shingle's rows
        common = C.written(each.groupBy("item").agg(F.count("*").alias("df")).where("df > 1"), "shingles")
        own = each.join(common, "item").groupBy("cid").agg(F.expr("transform(sort_array(collect_list(struct(df, item))), x -> x.item)").alias("shingles"), F.sum("df").alias("weight"))
        sets = C.written(sets.select("cid", "n", "keys").join(own, "cid").where(100 * F.size("shingles") >= percent * F.col("n")), "shared-sets")
    return sets


def _open(groups: DataFrame, comp: DataFrame) -> DataFrame:
    """Groups ``key`` with rows of several components: how many rows, how many outside the largest one (``major``).

    Of groups with the same classes, as told by two 64-bit hashes, one stays.
    """
    name = [F.bit_xor(F.xxhash64("cid", F.lit(k))).alias(x) for k, x in ((1, "u"), (2, "v"))]
    sizes = groups.join(comp, "cid").groupBy("key", "comp").agg(F.count("*").alias("k"), *name)
    sizes = sizes.groupBy("key").agg(F.sum("k").alias("all"), F.max(F.struct("k", "comp")).alias("major"), F.bit_xor("u").alias("u"), F.bit_xor("v").alias("v")).where("all > major.k")
    return sizes.groupBy("u", "v").agg(F.min(F.struct("key", "all", (F.col("all") - F.col("major.k")).alias("minor"), F.col("major.comp").alias("major"))).alias("x")).select("x.*")


def _bands(percent: int):
    """For each set, a key for each band: ROWS minima of its shingles together."""
    count = band_count(percent)
    odd = C.mix(np.arange(1001, 1001 + count * ROWS, dtype=np.uint64)) | np.uint64(1)
    seed = C.mix(np.arange(500001, 500001 + count * ROWS, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = np.asarray(batch.column(1).offsets, np.int64)
            lo = 0
            while lo < batch.num_rows:  # so many sets at once that their keys and shingles stay small
                hi = max(lo + 1, min(lo + 1024, int(np.searchsorted(off, off[lo] + (1 << 16), "right")) - 1))
                g, at = np.asarray(batch.column(1).values)[off[lo] : off[hi]].view(np.uint64), off[lo:hi] - off[lo]
                keys = np.zeros((hi - lo, count), np.uint64)
                for j in range(count * ROWS):
                    keys[:, j // ROWS] = C.mix((keys[:, j // ROWS] + np.uint64(j)) ^ np.minimum.reduceat((g ^ seed[j]) * odd[j], at))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * count), pa.array(keys.view(np.int64).ravel()))], ["cid", "bands"])
                lo = hi
        C.give_back()

    return run


def _settled(groups: DataFrame, sets: DataFrame, comp: DataFrame, verified, of, percent: int, count: int) -> DataFrame:
    """``cid, comp`` once no link between two components of a group ``key`` is left.

    Groups are compared in pairs, the smallest first, as long as these are FEW
    for each of ``count`` posted classes.  In each larger group the set h with the most common shingles is
    compared with all others.  Let D(x) be the shingles that are in one of x and h only; x and m
    differ in |D(x)| + |D(m)| - 2 |D(x) & D(m)| shingles, and are linked if these
    are at most c (|x| + |m|), c = (100 - percent) / (100 + percent).  With
    slack(x) = |D(x)| - c |x|, a link needs
    |D(x) & D(m)| >= (slack(x) + slack(m)) / 2, and at least 1 if x and m are in
    two components: one of them, say m, is not linked with h, so that
    slack(m) > c |h|, and slack(x) >= ||x| - |h|| - c |x| >= -c |h|.

    With the least slack of the rows that are not in x's component, ``need`` is
    a bound for x alone.  Rows without so many shared differences leave; the
    others are grouped anew by a prefix of them, rarest first, and all repeats
    with these groups.

    Shingles that only h has are in every D; one item, LONE, stands for all.

    Where a step leaves more than half of the pairs, where sets are in groups of
    many hubs (HUBBED), and after LEVELS steps, the sets of the large groups are grouped by bands of minima, which unlinked sets
    seldom share however many sets their group has; a link at the bound is not
    in these groups with probability under MISS_BANDS.  Their sets are compared
    with one hub for each group, and then all pairs in two components.
    """
    p, q = percent, 100 + percent
    some = lambda df: df.limit(1).count() > 0
    start = C.mark()
    step = F.ceil(F.log2("all"))
    size_of = sets.select("cid", "n", "weight")

    def merged(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        fresh = verified(pairs.select(F.least("x", "cid").alias("a"), F.greatest("x", "cid").alias("b")).distinct(), "rest").where("linked")
        return _merged(comp, fresh) if some(fresh) else comp

    def compared(groups: DataFrame, sizes: DataFrame, comp: DataFrame) -> DataFrame:
        """Rows outside the largest component of their group against all rows of the group."""
        rows = groups.join(comp, "cid").join(sizes.select("key", "major"), "key").join(size_of.drop("weight"), "cid")
        one = rows.where("comp <> major").select("key", F.col("cid").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"))
        return merged(one.join(rows, "key").where(alike & F.expr("comp <> cx AND (comp = major OR x < cid)")), comp)

    alike = 100 * F.least("n", "nx") >= p * F.greatest("n", "nx")

    def bounded(rows: DataFrame) -> DataFrame:
        """With ``need``, by the least slack (times q) of those in and out of the hub's component."""
        inside = F.col("comp") == F.col("hub_comp")
        least = rows.groupBy("hub").agg(F.min(F.when(inside, F.col("slack"))).alias("in"), F.min(F.when(~inside, F.col("slack"))).alias("out")).where("out IS NOT NULL")
        low = F.col("slack") + F.when(inside, F.col("out")).otherwise(F.least("in", "out"))
        return rows.join(least, "hub").withColumn("need", F.greatest(F.lit(1).cast("long"), F.ceil(low / (2 * q)))).drop("in", "out")

    names = ["hub", "hub_comp", "cid", "comp", "slack", "lone"]
    last = None
    for level in range(LEVELS + 1):
        sizes = C.written(_open(groups, comp), "sizes")
        hist = sorted(sizes.groupBy(step.alias("step")).agg(F.sum(F.expr(PAIRS)).alias("pairs")).collect())
        limit, pairs = -1, 0
        for r in hist:
            pairs += r["pairs"]
            limit = r["step"] if pairs <= FEW * count else limit
        if limit >= 0:
            comp = compared(groups, sizes.where(step <= limit), comp)
        if not hist or limit == hist[-1]["step"]:
            return comp
        if level == LEVELS or last is not None and 2 * pairs > last:
            break
        last = pairs
        now = groups.join(sizes.where(step > limit).select("key"), "key", "left_semi").join(comp, "cid").join(sets.select("cid", "n", "weight"), "cid")
        top = F.max(F.struct("weight", (-F.col("cid")).alias("minus"), "n", "comp")).alias("top")
        mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), top).where("lo < hi").select("key", (-F.col("top.minus")).alias("hub"), F.col("top.n").alias("hub_n"), F.col("top.comp").alias("hub_comp"))
        # written, so that the join below has a plain exchange on either side and Spark can split a hot key's rows
        pairs = C.written(now.join(C.written(mixed, "open-keys"), "key").where("cid <> hub").select("cid", "comp", "hub", "hub_comp", "hub_n", "n").distinct(), "open-pairs")
        if pairs.count() > HUBBED * count:
            break
        own = of(pairs, "cid", "hub")
        rest = pairs.join(own.select("cid", "shingles"), "cid").join(own.select(F.col("cid").alias("hub"), F.col("shingles").alias("base")), "hub")
        rest = rest.withColumn("extra", F.array_except("shingles", "base")).withColumn("inter", F.size("shingles").cast("long") - F.size("extra")).withColumn("lone", F.col("hub_n") - F.size("base"))
        items = F.concat("extra", F.array_except("base", "shingles"), F.when(F.col("lone") > 0, F.array(F.lit(LONE))).otherwise(F.array().cast("array<long>")))
        slack = q * (F.col("n") + F.col("hub_n") - 2 * F.col("inter")) - (100 - p) * F.col("n")
        linked = 100 * F.col("inter") >= p * (F.col("n") + F.col("hub_n") - F.col("inter"))
        rest = C.written(rest.select("cid", "comp", "hub", "hub_comp", linked.alias("linked"), slack.alias("slack"), F.greatest(F.col("lone") - 1, F.lit(0)).alias("lone"), items.alias("items")), "open")
        fresh = rest.where("comp <> hub_comp AND linked").select(F.col("cid").alias("a"), F.col("hub").alias("b"))
        if some(fresh):
            comp = _merged(comp, fresh)
        left = rest.drop("comp", "hub_comp").join(comp, "cid").join(comp.toDF("hub", "hub_comp"), "hub")
        left = bounded(left).where("size(items) + lone >= need").select(*names, "need", F.explode("items").alias("item"))
        for again in range(2):  # what few share decides who goes, and then fewer share
            left = bounded(left.drop("need")) if again else left
            shared = left.groupBy("hub", "item").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("df")).where("lo < hi").select("hub", "item", "df")
            left = left.join(C.written(shared, "shared"), ["hub", "item"]).groupBy(*names, "need").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("own")).where("size(own) + lone >= need")
            cut = "own" if not again else "slice(own, 1, cast(size(own) + lone - need + 1 AS int))"
            left = C.written(left.select(*names, "need", F.explode(F.expr(cut)).alias("x")).select(*names, "need", "x.item"), "items")
            if not some(left):
                break
        C.drop_since(sets.sparkSession, start, comp, left)
        groups = left.select(F.xxhash64("hub", "item").alias("key"), "cid")
    large = C.written(groups.join(sizes.where(step > limit).select("key"), "key", "left_semi").select("cid").distinct(), "large")
    keys = C.only(sets, large, "cid").select("cid", "shingles").mapInArrow(_bands(percent), "cid long, bands array<long>")
    groups = C.written(keys.select("cid", F.explode("bands").alias("key")), "bands")
    sizes = C.written(_open(groups, comp), "sizes")
    rows = groups.join(sizes.select("key"), "key").join(comp, "cid").join(size_of, "cid")
    # written, so that the join below has a plain exchange on either side and Spark can split a hot key's rows
    hubs = C.written(rows.groupBy("key").agg(F.max(F.struct("weight", (-F.col("cid")).alias("minus"), "comp", "n")).alias("top")).select("key", (-F.col("top.minus")).alias("x"), F.col("top.comp").alias("cx"), F.col("top.n").alias("nx")), "open-keys")
    comp = merged(rows.join(hubs, "key").where(alike & (F.col("comp") != F.col("cx"))), comp)
    return compared(groups, C.written(_open(groups, comp), "sizes"), comp)


def _members(sketch: DataFrame, classes: DataFrame, final: DataFrame) -> DataFrame:
    """``doc_id, dk, n, label, component`` for each row of the sketch; label and component are null for empty sets."""
    of_class = classes.select("ca", "cb", "cid", "first_id").join(final, "cid", "left").select("ca", "cb", "first_id", F.coalesce("comp", "cid").alias("label"))
    smallest = of_class.groupBy("label").agg(F.min("first_id").alias("component"))
    return sketch.drop("keys").join(of_class.join(smallest, "label").select("ca", "cb", "label", "component"), ["ca", "cb"], "left")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Texts are linked when 100 * common shingles >= percent * united shingles.
    """
    rows = _members(*_groups(docs, words, percent))
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` of each component, that with the smallest id, and all rows without words.

    Of rows that repeat id and text one stays; rows without an id stay only where
    no row of their component has one.
    """
    plain, at = C.by_place(docs)
    own = plain.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"))
    rows = C.written(_members(*_groups(own, words, percent)).where("n > 0").select("label", "doc_id", "dk"), "members")
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "dk")).alias("best")).select("label", F.col("best.dk").alias("best"))
    gone = C.written(rows.join(best, "label").where("dk <> best").select("dk").distinct(), "dropped")
    left = plain.withColumn("dk", F.xxhash64(F.col(at["doc_id"]).cast("long"), at["text"])).join(gone, "dk", "left_anti")
    twice = C.written(rows.groupBy("dk").agg(F.count("*").alias("k")).where("k > 1").select("dk"), "repeated")
    if twice.limit(1).count():
        left = left.join(twice, "dk", "left_anti").unionByName(left.join(twice, "dk", "left_semi").dropDuplicates(["dk"]))
    return left.drop("dk").toDF(*docs.columns)


def op2_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir), words=3, percent=85)
