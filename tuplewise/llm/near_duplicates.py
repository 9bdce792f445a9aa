"""Near-duplicate groups by one-permutation hashing.

Texts are lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and seen as sets
of distinct five-word shingles; a text of fewer words is one shingle, one without
words is empty and linked with nothing.  Two texts are linked if 100 times the
size of the intersection is at least 75 times that of the union.

Sketch.  One hash of each shingle fills ``BANDS * ROWS`` bins with minima; empty
bins copy a full one that a hash of (bin, attempt) picks (optimal densification).
Texts that agree on all rows of a band share a bucket.  At the threshold a pair
shares none of the 32 buckets of 4 rows with probability 5e-6.

Bounded pairs.  Equal sets first fold into one class, so copies make no pairs.
Then each bucket gets star-shaped candidate edges: from a centre to each member
that isn't known to be in the centre's component.  Edges are confirmed on the full
sets and components joined.  A centre has then met the whole bucket and leaves it;
buckets that still hold more than one component go another round, with four times
the centres, until none is left: rounds follow the logarithm of a bucket's size.

After two rounds, buckets of over ``CROWDED`` members that still aren't settled are
those of texts around one template, or of a family of near copies and its
neighbours.  Their members meet again by prefix filtering, which is exact: shingles
are ordered from rare to frequent, and of two linked texts the smaller one has one of
its first n - 6n/7 + 1 shingles among the first m - 3m/4 + 1 of the larger one, and at the
first one that they share each has 3(n + m)/7 left at least, itself included.  What
a template repeats is frequent and so last in order; its pages meet only if they
share what is their own.  The order comes from counts of a fixed number of cells
(``COUNT_BITS``), to which a task adds what it sees twice or more; it decides how many
candidates there are, not which links are found.

So no candidate pair that could join two components goes untested, without a cap on
partners or candidates, and rows between steps follow members, not pairs.

All state between rounds is a table in the shared folder; only row counts reach
the driver.  Hot buckets and classes meet tables that are unique in the key, so
skewed sides split; minima combine map-side.

Texts are found again by doc_id and a hash of the text, so tables in which many rows
have no doc_id, or all have one, cost no more than others.

Defined results: a null text is empty; rows with a null doc_id take part, but give
no component its id, and are kept only if their component has no other id;
repeated rows share class and verdict; extra columns are ignored by
``near_duplicates``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplewise.llm import kernel
from tuplewise.llm.common import cut, small_batches, temporary

BANDS, ROWS = 32, 4
BIN_BITS = 7  # 2**7 bins = BANDS * ROWS
SHINGLE = 5
PERCENT = 75
#: centres of a bucket in the first two rounds: of an ordinary bucket, and of a crowded one of mostly one component
CENTRES = ((1, 1), (1, 4))
#: members of an unsettled bucket from which on they meet by prefix filtering, after the first rounds
CROWDED = 32
#: shingles are counted in 2**COUNT_BITS cells
COUNT_BITS = 18
#: classes whose sets are fetched by a broadcast of their ids; more are joined by shuffle
BROADCAST_ROWS = 100_000

_U = np.uint64


@lru_cache(maxsize=1)
def _probes() -> np.ndarray:
    """For each attempt and bin, the bin that densification looks at."""
    attempts, bins = np.arange(1, 4097, dtype=_U)[:, None], np.arange(1 << BIN_BITS, dtype=_U)[None, :]
    return (kernel.mix(attempts * _U(0x9E3779B97F4A7C15) + bins * _U(0xC2B2AE3D27D4EB4F)) >> _U(64 - BIN_BITS)).astype(np.int16)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One-permutation minima of a sorted, non-empty set of 64-bit hashes, densified."""
    where = (shingles >> _U(64 - BIN_BITS)).astype(np.int16)
    first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    out = np.zeros(1 << BIN_BITS, dtype=_U)
    full = np.zeros(1 << BIN_BITS, dtype=bool)
    out[where[first]] = shingles[first]
    full[where[first]] = True
    probes, low = _probes(), 0
    empty = np.flatnonzero(~full)
    for high in (32, 512, len(probes)):
        if not len(empty):
            break
        seen = full[probes[low:high, empty]]
        at = seen.argmax(axis=0)
        done = seen[at, np.arange(len(empty))]
        out[empty[done]] = out[probes[low + at[done], empty[done]]]
        empty, low = empty[~done], high
    out[empty] = shingles[0]
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    factors = kernel.mix(np.arange(ROWS, dtype=_U) + _U(77)) | _U(1)
    salt = kernel.mix(np.arange(BANDS, dtype=_U) + _U(1234))
    return kernel.mix((sketch.reshape(BANDS, ROWS) * factors).sum(axis=1, dtype=_U) + salt)


def set_digest(shingles: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    total = kernel.mix(shingles).sum(dtype=_U, keepdims=True) + np.array([len(shingles)], dtype=_U) * _U(0xD6E8FEB86659FD93)
    return int(kernel.mix(total).view(np.int64)[0])


def _sets(texts) -> Iterator[np.ndarray]:
    for row, to, got in kernel.words_of(texts, kernel.SPACE_WORDS, True):
        for i in range(to - row):
            yield kernel.shingle_set(got.hash[got.first[i] : got.first[i + 1]], SHINGLE)


def _listed(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = pa.array(np.r_[0, np.cumsum([len(r) for r in rows])], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*rows, np.zeros(0, dtype=_U)]).view(np.int64)))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes, rows = [], [], []
        for shingles in _sets(batch.column(2)):
            sizes.append(len(shingles))
            nodes.append(set_digest(shingles) if len(shingles) else None)
            rows.append(bands(signature(shingles)) if len(shingles) else np.zeros(0, dtype=_U))
        columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), _listed(rows)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "node", "bands"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sets = [], []
        for wanted, shingles in zip(batch.column(0).to_pylist(), _sets(batch.column(1)), strict=True):
            if len(shingles) and set_digest(shingles) == wanted:
                nodes.append(wanted)
                sets.append(shingles)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _listed(sets)], names=["node", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the smallest node that it reaches.

    Labels pass along edges and then jump to their own labels, so rounds follow the
    logarithm of the longest path rather than its length.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label"), F.lit(True).alias("moved")))
    while labels.filter("moved").limit(1).count():
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        after = F.least(F.col("to"), F.coalesce("further", F.col("to")))
        labels = cut(step.join(jump, "to", "left").select("node", after.alias("label"), (after < F.col("was")).alias("moved")))
    return labels.select("node", "label")


def _confirmed(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough."""
    side = lambda end: sets.select(F.col("node").alias(end), F.col("shingles").alias(f"s{end}"))
    joined = edges.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return joined.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), common.alias("nc")).filter(
        100 * F.col("nc") >= PERCENT * (F.col("na") + F.col("nb") - F.col("nc"))
    ).select("a", "b")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n) of the shingles of a task's sets, of cells with two or more."""
    counts = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    for batch in batches:
        cells = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(_U) >> _U(64 - COUNT_BITS)
        counts += np.bincount(cells.astype(np.int64), minlength=len(counts))
    full = np.flatnonzero(counts > 1)
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], names=["cell", "n"])


def _prefixes(counts):
    """A task's function: the first shingles of each set, from rare to frequent, as buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = counts.value
        for batch in batches:
            lists = batch.column(1)
            flat, at = lists.values.to_numpy().view(_U), lists.offsets.to_numpy().astype(np.int64)
            size = np.diff(at)
            probe = size - (3 * size + 3) // 4 + 1
            found = [np.zeros(0, dtype=_U)]
            for i, n in enumerate(probe.tolist()):
                own = flat[at[i] : at[i + 1]]  # sorted already, so equal counts keep that order
                found.append(own[np.argsort(frequency[own >> _U(64 - COUNT_BITS)], kind="stable")[:n]])
            place = np.arange(int(probe.sum())) - np.repeat(np.cumsum(probe) - probe, probe)
            columns = [
                pa.array(kernel.mix(np.concatenate(found) + _U(PERCENT)).view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(size)), probe))),
                pa.array(np.repeat(size, probe), pa.int64()), pa.array(place, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "node", "n", "place"])

    return run


#: may be the first shingle shared with a text of no fewer shingles
_FIRST = "7 * (n - place) >= 6 * n"


def _shared(members: DataFrame) -> DataFrame:
    """The ``members`` (bucket, node, n, place) of buckets in which two could meet."""
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.max(F.expr(_FIRST)).alias("any")).filter("k > 1 AND any").select("bucket")
    return members.join(shared, "bucket", "left_semi")


def _by_prefix(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Bucket members (bucket, node, n, place) by which all linked pairs of ``nodes`` meet; ``place``: the shingle's in the order of the node's own."""
    chosen = cut(sets.join(nodes, "node", "left_semi"))
    cells = chosen.select("shingles").mapInArrow(_counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = cells.toArrow()  # at most 2**COUNT_BITS rows
    counts = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    counts[table["cell"].to_numpy()] = table["n"].to_numpy()
    shared = nodes.sparkSession.sparkContext.broadcast(counts)
    return _shared(cut(chosen.mapInArrow(_prefixes(shared), "bucket long, node long, n long, place long")))


def _linked(members: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(node, comp) of the nodes that have links, from bucket members (bucket, node, n, place)."""
    labels: DataFrame | None = None
    tested: DataFrame | None = None
    turn = 0
    while True:
        now = members.withColumn("comp", F.col("node")) if labels is None else members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        now = cut(now)
        # sizes of the components within each bucket; buckets with one component are settled
        parts = now.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"), F.max(F.expr(_FIRST)).alias("any"))
        sizes = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.sum("m").alias("size"), F.max(F.struct("m", "comp")).alias("most"), F.max("any").alias("any")).filter("k > 1 AND any")
        crowded = F.col("size") > CROWDED
        sizes = sizes.select("bucket", crowded.alias("crowded"), (crowded & (2 * F.col("most.m") >= F.col("size"))).alias("mostly_one"), F.col("most.comp").alias("main"))
        now = cut(now.join(parts.drop("any").join(sizes, "bucket"), ["bucket", "comp"]))
        if turn == len(CENTRES):
            turn += 1
            crowd = cut(now.filter("crowded").select("node").distinct())
            if crowd.limit(1).count():
                members = now.filter("not crowded").select("bucket", "node", "n", "place").unionByName(_by_prefix(crowd, sets))
                continue
        few, many = CENTRES[turn] if turn < len(CENTRES) else (4 ** (turn - len(CENTRES)),) * 2
        slots = F.when(F.col("mostly_one"), many).otherwise(few)
        in_main = F.col("mostly_one") & (F.col("comp") == F.col("main"))
        # small components first, members outside a main one too; just the second round looks from the main one
        order = F.when(F.col("mostly_one"), -F.col("m")).otherwise(F.col("m")) if turn == 1 else F.when(in_main, 1 << 62).otherwise(F.col("m"))
        rank = F.struct(order.alias("m"), F.xxhash64("node").alias("h"), "node", "n", "comp", "place")
        centres = now.groupBy("bucket", F.pmod(F.xxhash64("node", F.lit(turn)), slots).alias("slot")).agg(F.min(rank).alias("c"))
        centres = cut(centres.select("bucket", *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("node", "n", "comp", "place")]))
        if not centres.limit(1).count():
            return labels
        met = now.join(centres, "bucket").filter(F.col("comp") != F.col("c_comp"))
        # enough of both is left from the shared shingle on; of bands, that says that the sizes are close enough
        met = met.filter(7 * F.least(F.col("n") - F.col("place"), F.col("c_n") - F.col("c_place")) >= 3 * (F.col("n") + F.col("c_n")))
        edges = met.select(F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b")).distinct()
        edges = cut(edges if tested is None else edges.join(tested, ["a", "b"], "left_anti"))
        tested = edges if tested is None else tested.union(edges)
        links = cut(_confirmed(edges, sets))
        if links.limit(1).count():
            labels = _relabelled(labels, links)
        members = now.select("bucket", "node", "n", "place").join(centres.select("bucket", F.col("c_node").alias("node")), ["bucket", "node"], "left_anti")
        turn += 1


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components after ``links`` (a, b) join some of them."""
    if labels is None:
        return components(links).select("node", F.col("label").alias("comp"))
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), F.col("comp").alias(f"_{end}"))
        links = links.join(own, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    joined = components(links.filter("a != b"))
    old = labels.join(joined.select(F.col("node").alias("comp"), "label"), "comp", "left").select("node", F.coalesce("label", "comp").alias("comp"))
    new = joined.join(labels.select("node"), "node", "left_anti").select("node", F.col("label").alias("comp"))
    return cut(old.union(new))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable), kept.

    Further columns: ``text_hash`` (xxhash64 of the text) and ``group``, a number of the
    component that also tells apart components without a doc_id (null without shingles).
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = cut(texts.mapInArrow(_sketches, "doc_id long, text_hash long, n_shingles long, node long, bands array<long>"))
    with temporary(spark):
        of_node = cut(_grouped(texts, rows), lasting=True)
    out = rows.select("doc_id", "n_shingles", "node", "text_hash").join(of_node, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash", F.col("comp").alias("group"))


def _grouped(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, comp, component_id) of each class of equal sets."""
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash"))
    classes = rows.filter("n_shingles > 0").groupBy("node").agg(rep.alias("rep"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes.select("node", F.col("rep.doc_id").alias("rep"), F.col("rep.text_hash").alias("rep_hash"), "n", "bands"))
    buckets = classes.select(F.explode("bands").alias("bucket"), "node", "n", F.lit(0).cast("long").alias("place"))
    members = cut(_shared(buckets))

    wanted = cut(classes.select("node", "rep", "rep_hash").join(members.select("node").distinct(), "node"))
    few = wanted.count() <= BROADCAST_ROWS
    found = texts.join(F.broadcast(wanted) if few else wanted, (texts.text_hash == wanted.rep_hash) & texts.doc_id.eqNullSafe(wanted.rep))
    sets = found.select("node", "text").mapInArrow(_full_sets, "node long, shingles array<long>")
    sets = cut(sets.groupBy("node").agg(F.first("shingles").alias("shingles")))

    labels = _linked(members, sets)
    named = classes.select("node", "rep")
    named = named.withColumn("comp", F.col("node")) if labels is None else named.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return named.join(smallest, "comp").select("node", "comp", "component_id")
