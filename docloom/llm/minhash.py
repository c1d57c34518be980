"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

Sketch (Dahlgaard, Knudsen and Thorup, "Fast similarity sketching", 2017): t coordinates start empty.  In round i < t
every element goes to a hashed bin with a hashed value, and a bin that no earlier round has filled keeps the smallest;
in round t + j every element goes to bin j.  It stops when all bins are filled, so every coordinate of every non-empty
set is filled, and equal coordinates estimate Jaccard similarity with concentration bounds like those of sampling.

Flow
1. One Python pass over the texts: shingle set, its size, a 128-bit digest of the set and the band keys.
2. Documents of one set form a class (pre-aggregated on the map side); from here on only classes are dealt with.
3. Sets of the classes that share a bucket with others are made from the texts.  Their rows are found through a bitmap of
   hashed ids that has a fixed size, and where there are too many ids for that by a join of the texts with the ids.
4. First, each bucket compares its members with the one that shares most buckets with others.  Members of buckets that
   are then one component are done.  The others are few, and all links among them are found by an exact set join with
   prefixes of rare elements: elements that no other set has rule pairs out without making them, and no cap decides.
5. Every candidate is confirmed on the full sets, and confirmed links are joined to components by label
   propagation with pointer jumping.

Defined cases: null texts and texts without words have the empty set: no link, their own component.  Repeated rows
and equal sets are one class.  Rows keep their count; extra columns are ignored.  A null doc_id takes part, and its
component's id is the smallest non-null id, or null.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, in_batches

WIDTH = 5
ROWS = 5
#: A pair at the threshold shares no band with this probability at most.
MISS = 1e-7
#: Bits of the bitmap of ids whose sets are wanted (1 MB, whatever the input), and the most ids it is used for.
BITS, FEW = 1 << 23, 1 << 21
#: Bytes from which a text's words are read one by one, and elements that a sketch takes at once.
LONG, BLOCK = 1 << 19, 1 << 16


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def mix(x):
    """The finalizer of splitmix64, in place on a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(text: str | None, width: int = WIDTH):
    """Sorted distinct 64-bit hashes of the word shingles; A-Z lowered, words split at ASCII white space."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    # a very long text's words are taken one by one, as all of them as objects would need many times its size
    words = data.split() if len(data) < LONG else (m[0] for m in re.finditer(rb"[^\x20\x09-\x0D]+", data))
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64)
    n = len(w)
    if n == 0:
        return np.empty(0, np.uint64)
    length = min(n, width)
    h = np.full(n - length + 1, length, np.uint64)
    for i in range(length):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : n - length + 1 + i])
    return np.unique(h)


def sketch(elements, t: int):
    """The t coordinates of a non-empty set of 64-bit hashes."""
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    n, i = len(elements), 0
    while i < 2 * t:
        rounds = np.arange(i, min(2 * t, i + max(1, 2048 // n)), dtype=np.uint64)
        forced = rounds >= t
        for k in range(0, n, BLOCK):
            x = mix(elements[None, k : k + BLOCK] + (mix(rounds + np.uint64(1)) | np.uint64(1))[:, None])
            bins = (x & np.uint64(0xFFFFFFFF)) % np.uint64(t)
            if forced.any():
                bins[forced] = (rounds[forced] - np.uint64(t))[:, None]
            value = (rounds << np.uint64(32))[:, None] | (x >> np.uint64(32))
            np.minimum.at(out, bins.ravel().astype(np.intp), value.ravel())
        i += len(rounds)
        if out.max() != np.iinfo(np.uint64).max:
            break
    return out


def band_keys(coordinates, bands: int, rows: int):
    parts = coordinates.reshape(bands, rows)
    h = np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return h.view(np.int64)


def digest(elements) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _sketched(bands: int, rows: int, width: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes, keys, all_bands = [], [], []
            for text in texts:
                s = shingles(text.as_py(), width)
                sizes.append(len(s))
                keys.append(digest(s) if len(s) else None)
                all_bands.append(band_keys(sketch(s, bands * rows), bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(all_bands, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "key", "bands"])

    return run


def _sets(width: int, bitmap: dict | None):
    """Sets of the rows (hash, text) whose hash is in the bitmap, or of all rows without one."""

    def run(batches):
        for batch in batches:
            keys, sets = [], []
            for place, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bitmap is not None:
                    bits = bitmap.get(place // 32768 + 1)
                    if bits is None or not bits[place % 32768 >> 3] >> (place & 7) & 1:
                        continue
                s = shingles(text.as_py(), width)
                if len(s):
                    keys.append(digest(s))
                    sets.append(s.view(np.int64))
                if len(sets) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["key", "elements"])
                    keys, sets = [], []
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["key", "elements"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node reachable."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        nearer = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("after"))
        moved = cut(nearer.join(jump, "next", "left").select("node", F.least("next", F.coalesce("after", "next")).alias("comp"), F.col("comp").alias("was")))
        labels = moved.select("node", "comp")
        if moved.where("comp <> was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = WIDTH, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text).

    Two documents are linked where 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id reachable over links, kept says that it is the row's own.
    """
    return grouped(docs, percent, width, rows, miss).select("doc_id", "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame, percent: int = 80, width: int = WIDTH, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """``near_duplicates`` with text_hash (xxhash64 of the text) and component, which tells components apart where ids
    repeat or are null; it is null for empty sets, and its values may change between runs.
    """
    bands = bands_for(percent, rows, miss)
    texts = docs.select("doc_id", "text")
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    rows_of = cut(in_batches(hashed, _sketched(bands, rows, width), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, text_hash long, n_shingles long, key binary, bands array<long>"))
    alike = rows_of.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n_shingles", "bands")).alias("r"))
    # numbers are given once, when the table is written
    classes = cut(alike.select("key", "r.doc_id", F.col("r.n_shingles").cast("int").alias("size"), "r.bands", F.monotonically_increasing_id().alias("node")))
    links = _links(texts, classes, percent, width)
    comps = classes.select("node", "key", "doc_id").join(components(links), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = comps.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = comps.join(least, "comp").select("key", "component_id", F.col("comp").alias("component"))
    out = rows_of.select("doc_id", "text_hash", "n_shingles", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", "component")


def _sets_of(texts: DataFrame, wanted: DataFrame, width: int, few: int = FEW) -> DataFrame:
    """(node, elements) of the classes ``wanted`` (node, key, doc_id), read from the row of each that has its doc_id."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    wanted = cut(wanted)
    if wanted.count() <= few:
        bitmap = wanted.groupBy(F.bitmap_bucket_number(place + 1).alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits"))
        held, rows = {r["number"]: bytes(r["bits"]) for r in bitmap.collect()}, texts
    else:  # rows without an id share one hash of it
        ids = wanted.select(F.xxhash64("doc_id").alias("place")).distinct()
        held, rows = None, texts.withColumn("place", F.xxhash64("doc_id")).join(ids, "place", "left_semi")
    made = in_batches(rows.select(place.alias("place"), "text"), _sets(width, held), "key binary, elements array<long>")
    return cut(made.join(wanted.select("key", "node"), "key").groupBy("key", "node").agg(F.first("elements").alias("elements")).select("node", "elements"))


def _links(texts: DataFrame, classes: DataFrame, percent: int, width: int) -> DataFrame:
    """Confirmed links (a, b) between classes: of each component at least a spanning set, which is all that counts."""
    members = classes.select(F.explode("bands").alias("bucket"), "node", "size")
    stats = members.groupBy("bucket").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1")
    crowd = cut(members.join(stats, "bucket"))
    # the member that shares most buckets with others is the likeliest original of its bucket
    weights = cut(crowd.groupBy("node").agg(F.sum("n").alias("weight")))
    sets = _sets_of(texts, classes.select("node", "key", "doc_id").join(weights, "node"), width)
    crowd = crowd.drop("n").join(weights, "node")
    centers = crowd.groupBy("bucket").agg(F.max(F.struct("weight", "node", "size")).alias("c")).select("bucket", F.col("c.node").alias("center"), F.col("c.size").alias("center_size"))
    crowd = cut(crowd.drop("weight").join(centers, "bucket").where("node <> center"))
    near = F.least("size", "center_size") * 100 >= F.greatest("size", "center_size") * percent
    pairs = crowd.where(near).select(F.least("center", "node").alias("a"), F.greatest("center", "node").alias("b")).distinct()
    pairs = cut(pairs)
    links = _confirmed(sets, pairs, percent)
    open_nodes = _open(crowd.select("bucket", "node", "size"), components(links))
    if open_nodes.isEmpty():
        return links
    rest = cut(_by_prefix(cut(sets.join(open_nodes, "node")), percent).join(pairs, ["a", "b"], "left_anti"))
    return links.union(_confirmed(sets, rest, percent))


def _by_prefix(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, of (node, elements, size, comp): exact prefix filtering.

    With each set's elements in the order (frequency, element), linked sets share an element among their first
    size - ceil(size * percent / 100) + 1, and at the first that they share enough elements must follow in both.  A pair
    is made at that element alone.  At each element, sets of its largest component meet only those of others.
    Counts are written before they are joined, so that joins read exchanges of their own, whose large partitions (of a
    frequent element) are split.
    """
    each = sets.select("node", F.explode("elements").alias("element"))
    often = cut(each.groupBy("element").agg(F.count(F.lit(1)).alias("often")).where("often > 1"))
    counted = each.join(often, "element", "left").select("node", F.coalesce("often", F.lit(1)).alias("n"), "element")
    sorted_sets = counted.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "element"))).alias("e"))
    length = F.col("size") - F.ceil(F.col("size") * percent / 100).cast("int") + 1
    heads = cut(sorted_sets.join(sets.select("node", "size", "comp"), "node").select("node", "size", "comp", F.slice("e", F.lit(1), length).alias("e")))
    places = heads.select("node", "size", "comp", F.transform("e", lambda x: x["element"]).alias("head"), F.posexplode("e").alias("at", "x")).where("x.n > 1")
    places = places.select("node", "size", "comp", "head", "at", F.col("x.element").alias("element"))
    most = places.groupBy("element", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("element").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    met = cut(places.join(cut(most.select("element", "main")), "element"))
    one = met.where("comp <> main").select("element", F.col("node").alias("x"), F.col("size").alias("sx"), F.col("comp").alias("cx"), F.col("head").alias("hx"), F.col("at").alias("px"))
    two = met.select("element", F.col("node").alias("y"), F.col("size").alias("sy"), F.col("comp").alias("cy"), F.col("head").alias("hy"), F.col("at").alias("py"), (F.col("comp") == F.col("main")).alias("in_main"))
    left = F.least(F.col("sx") - F.col("px"), F.col("sy") - F.col("py")).cast("long")
    enough = left * (100 + percent) >= (F.col("sx") + F.col("sy")).cast("long") * percent
    apart = (F.col("cx") != F.col("cy")) & (F.col("in_main") | (F.col("x") < F.col("y"))) & enough
    first = F.array_intersect("hx", "hy")[0] == F.col("element")
    return one.join(two, "element").where(apart & first).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, size, comp) of the members (bucket, node, size) of buckets that lie in several components."""
    own = members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    still = own.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    return cut(own.join(still.select("bucket"), "bucket").select("node", "size", "comp").distinct())


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes that are as similar as asked, by their full sets."""
    first = pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    both = first.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a")
    shared = F.size(F.array_intersect("ea", "eb"))
    sized = both.select("a", "b", shared.alias("i"), (F.size("ea") + F.size("eb") - shared).alias("u"))
    return cut(sized.where(F.col("i").cast("long") * 100 >= F.col("u").cast("long") * percent).select("a", "b"))
