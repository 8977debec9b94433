"""Near-duplicate documents by a MinHash LSH forest.

1. Sketch. Each text becomes the set of its word shingles (64-bit hashes), a
   digest of that set and ``TREES`` signatures of ``2 * DEPTH`` MinHash values.
   Texts with equal sets form one class, which is one node from here on.
2. Forest. Each tree sorts the classes by their signature. Neighbours in that
   order whose longest common prefix has at least DEPTH values are candidates;
   so each run of classes with a common prefix is a region. In a region of up
   to WINDOW + 1 classes all meet. A larger one is divided at the next value,
   and its parts again, until a part is that small or the values are used up;
   besides, each class of it meets the NEAR before it in the order. A region of
   more than ``region_rows`` classes is first cut at twice the depth and, where
   that does not part it, into salted chunks, whose classes also meet the
   smallest class of the region.
3. Verification on full sets of every pair that any tree found, in two rounds.
   First each class meets its best candidate of smaller number, which joins
   groups by a tree of links; then all further pairs whose ends are still in
   different components. A pair inside a component can't change the result.
4. Closing. In the regions of more than WINDOW + 1 classes that lie in several
   components an exact join finds all further links, see ``close_regions``. So
   dividing, NEAR and the salts cost no link.
5. Components by alternating large and small stars.

For similarity J, a tree finds a pair with a probability of J**DEPTH, so all 20
miss it with 4e-7 at J = 0.85 and 3e-5 at J = 0.8.
Nothing of the size of the input is collected or broadcast; texts travel only
for classes with candidates.

Cases: a text without words, or null, has an empty set and is linked with
nothing; with fewer words than a shingle, the whole sequence is the only
shingle. A row is a node: rows with one id and different texts may lie in
different components. A null id is never a component's id unless all are null.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pixelgrove.llm.common import join_uneven, key_filter, may_contain, stage, unused
from pixelgrove.llm.words import WordHashes

TREES, DEPTH, WINDOW, NEAR, REGION_ROWS = 20, 4, 24, 4, 5000
#: Entries of a shingle that meet in one group at the closing.
CHUNK = 2000
FILTER_BITS = 1 << 25
_RANDOM = np.random.default_rng(20240229)
#: Odd multipliers of the MinHash values, two levels of DEPTH a tree.
_MULTIPLY = _RANDOM.integers(0, 1 << 63, TREES * DEPTH * 2, "u8") * np.uint64(2) + np.uint64(1)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9))


def shingles(text: str | None, size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; A-Z are lowered, words end at ASCII white space."""
    words = (text or "").encode().lower().split()
    h = np.fromiter(map(known.__getitem__, words), "u8", len(words))
    if not len(h):
        return h
    n = max(len(h) - size + 1, 1)
    out = np.zeros(n, "u8")
    for i in range(min(size, len(h))):
        out = (out ^ h[i : i + n]) * _MIX[0]
        out ^= out >> np.uint64(29)
    out = (out + np.uint64(len(h) if len(h) < size else size)) * _MIX[2]
    return np.unique(out ^ (out >> np.uint64(32)))


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def signature(found: np.ndarray) -> bytes:
    """All MinHash values, 16 bits of each."""
    best = np.full(len(_MULTIPLY), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(found), 2048):
        np.minimum(best, (found[at : at + 2048, None] * _MULTIPLY).min(0), out=best)
    # a value's lowest bits are the least mixed, its highest are near zero as it is a minimum
    return ((best * _MIX[1]) >> np.uint64(48)).astype(">u2").tobytes()


def text_key(text: Column) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sketch(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            n, digests, signatures, last = [], [], [], {}
            for text in batch.column("text"):
                found = shingles(text.as_py(), size, known)
                n.append(len(found))
                d = digest(found) if len(found) else None
                digests.append(d)
                if d is not None and d not in last:
                    last[d] = signature(found)
                signatures.append(last.get(d))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "text_key", "n_shingles", "digest", "signature"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, digest binary, signature binary")


def trees(classes: DataFrame) -> DataFrame:
    """Rows (tree, k1, k2, node): the two levels of each tree's signature."""
    span = 2 * DEPTH  # bytes of one level
    keys = F.array(*[F.struct(F.substring("signature", 1 + 2 * span * t, span).alias("k1"), F.substring("signature", 1 + 2 * span * t + span, span).alias("k2")) for t in range(TREES)])
    return classes.select("node", F.posexplode(keys).alias("tree", "k")).select("tree", "k.k1", "k.k2", "node")


def forest(classes: DataFrame, region_rows: int) -> DataFrame:
    """Rows (tree, k1, k2, cut, pivot, node) of every tree; cut tells the parts of a large region apart."""
    rows = trees(classes)
    large = rows.groupBy("tree", "k1").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where(F.col("n") > region_rows)
    large = stage(large, "large-regions")
    if large.isEmpty():
        return rows.select("tree", "k1", "k2", F.lit(0).cast("long").alias("cut"), F.lit(None).cast("long").alias("pivot"), "node")
    deep = join_uneven(rows, large, ["tree", "k1"], "n", how="inner").groupBy("tree", "k1", "k2").agg(F.count(F.lit(1)).alias("n2")).where(F.col("n2") > region_rows)
    rows = join_uneven(rows, large, ["tree", "k1"], "n").drop("n")
    rows = join_uneven(rows, stage(deep, "deep-regions"), ["tree", "k1", "k2"], "n2")
    salt = F.when(F.col("n2").isNotNull(), F.pmod(F.xxhash64("node"), F.ceil(F.col("n2") / region_rows))).otherwise(F.lit(0))
    return rows.select("tree", "k1", "k2", F.when(F.col("pivot").isNotNull(), F.xxhash64("k2", salt)).otherwise(F.lit(0)).alias("cut"), "pivot", "node")


def _parts(values: list[bytes], low: int, high: int, depth: int) -> Iterator[tuple[int, int]]:
    """Bounds of the parts with up to WINDOW + 1 classes that a region is divided into; larger ones at the last depth are left out."""
    if high - low <= WINDOW + 1:
        yield low, high
    elif depth < DEPTH:
        start = low
        for i in range(low + 1, high + 1):
            if i == high or values[i][2 * depth : 2 * depth + 2] != values[start][2 * depth : 2 * depth + 2]:
                yield from _parts(values, start, i, depth + 1)
                start = i


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a < b) from rows sorted by (tree, k1, cut, k2, node); one region, of about ``region_rows`` at most, is held at a time."""
    a, b, region, pivot, nodes, values = [], [], None, None, [], []

    def meet(x: int, y: int) -> None:
        a.append(min(x, y))
        b.append(max(x, y))

    def close() -> None:
        small = len(nodes) <= WINDOW + 1 and pivot is None
        for i in range(0 if small else len(nodes)):
            for j in range(max(0, i - NEAR), i):
                meet(nodes[j], nodes[i])
            if pivot is not None and nodes[i] != pivot:
                meet(pivot, nodes[i])
        for low, high in _parts(values, 0, len(nodes), 0):
            for i in range(low, high):
                for j in range(low, i if small else i - NEAR):
                    meet(nodes[j], nodes[i])

    for batch in batches:
        for tree, k1, k2, cut, of, node in zip(*[batch.column(c).to_pylist() for c in ("tree", "k1", "k2", "cut", "pivot", "node")], strict=True):
            if (tree, k1, cut) != region:
                close()
                region, pivot, nodes, values = (tree, k1, cut), of, [], []
            nodes.append(node)
            values.append(k2)
        if len(a) > 50_000:
            yield _pairs(a, b)
            a.clear(), b.clear()
    close()
    if a:
        yield _pairs(a, b)


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def candidates(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, votes) that go to verification."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "tree", "k1", "cut").sortWithinPartitions("tree", "k1", "cut", "k2", "node")
    return dealt.mapInArrow(_neighbours, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def verify(pairs: DataFrame, texts: DataFrame, names: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar on full sets."""
    held = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts, names)
    left = pairs.select("a", "b").join(held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(held.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sets = WordHashes(), OrderedDict()

        def found(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in sets:
                sets[node] = shingles(text.as_py(), size, known)
                if len(sets) > 256:
                    sets.popitem(last=False)
            sets.move_to_end(node)
            return sets[node]

        for batch in batches:
            rows = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True)
            ok = [similar(found(a, ta), found(b, tb), percent) for a, b, ta, tb in rows]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def close_regions(classes: DataFrame, links: DataFrame, texts: DataFrame, names: DataFrame, size: int, percent: int, least: int = WINDOW + 1) -> DataFrame:
    """All further links (a, b) between classes of regions with more than ``least`` classes in several components.

    An exact join by prefixes. The shingles of all these classes have one order:
    those that occur in one component only, then by how many classes have them.
    Similar sets share one of their first shingles in it, as a set that shares
    none of these has too few others. So a class is entered under its first
    shingles: the smaller of two similar sets needs less of them ("indexed")
    than the larger. What a family of texts has in common comes last in the
    order and is rarely entered. Entries of different components meet if sizes
    and places leave enough shingles to share, and are verified on their sets.

    Where a shingle has more than CHUNK entries, those outside its largest
    component meet all others by chunks of both sides. Only hashes travel.
    """
    rows = trees(classes).select("tree", "k1", "node")
    none = links.select(F.col("node").alias("a"), F.col("root").alias("b")).limit(0)
    crowds = stage(rows.groupBy("tree", "k1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least), "crowds")
    if crowds.isEmpty():
        return none
    inside = join_uneven(rows, crowds, ["tree", "k1"], "n", how="inner").drop("n").join(links, "node", "left")
    inside = stage(inside.select("tree", "k1", "node", F.coalesce("root", "node").alias("root")), "crowded")
    mixed = inside.groupBy("tree", "k1").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").drop("low", "high")
    crowded = stage(join_uneven(inside, stage(mixed, "mixed"), ["tree", "k1"], "n", how="inner").select("node", "root").distinct(), "crowded-classes")
    if crowded.isEmpty():
        return none
    sets = stage(sets_of(texts_of(crowded.select("node"), texts, names).join(crowded, "node"), size), "crowded-sets")

    each = sets.select("node", "root", F.size("found").cast("long").alias("size"), F.explode("found").alias("h"))
    # a shingle of one component can't be shared by two: it stands first in the order and needs no entry
    common = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h", "n")
    ordered = join_uneven(each, stage(common, "common-shingles"), "h", "n", how="inner").groupBy("node", "root", "size").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("s"))
    ordered = ordered.withColumn("before", F.col("size") - F.size("s"))
    ordered = ordered.withColumns({"probed": F.expr(f"size - ({percent} * size + 99) div 100 + 1"), "indexed": F.expr(f"size - (2 * {percent} * size + {99 + percent}) div {100 + percent} + 1")})
    ordered = ordered.select("*", F.posexplode(F.slice("s", F.lit(1), F.greatest(F.lit(0), F.col("probed") - F.col("before")).cast("int"))).alias("j", "e"))
    entries = stage(ordered.select("e.h", "node", "root", "size", (F.col("before") + F.col("j")).alias("pos"), (F.col("before") + F.col("j") < F.col("indexed")).alias("indexed")), "entries")

    shares = entries.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n"), F.max("indexed").alias("indexed"))
    lists = shares.groupBy("h").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("total"), F.max("indexed").alias("any")).where(F.col("any") & (F.col("total") > F.col("m.n")))
    lists = stage(lists.select("h", "total", F.col("m.root").alias("main"), F.ceil(F.col("total") / CHUNK).alias("chunks"), F.ceil((F.col("total") - F.col("m.n")) / CHUNK).alias("turns")), "lists")
    part = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = join_uneven(entries, lists, "h", "total", how="inner")
    columns = ["node", "root", "size", "pos", "indexed"]
    members = dealt.withColumn("turn", every("turns")).select("h", part("chunks", 3).alias("chunk"), "turn", *columns)
    asking = dealt.where("root <> main").withColumn("chunk", every("chunks")).select("h", "chunk", part("turns", 5).alias("turn"), *[F.col(c).alias(f"q_{c}") for c in columns])
    enough = (
        f"root <> q_root AND ((q_size <= size AND q_indexed) OR (size <= q_size AND indexed)) AND {percent} * greatest(size, q_size) <= 100 * least(size, q_size)"
        f" AND {100 + percent} * least(size - pos, q_size - q_pos) >= {percent} * (size + q_size)"
    )
    met = members.join(asking, ["h", "chunk", "turn"]).where(enough).select(F.least("node", "q_node").alias("a"), F.greatest("node", "q_node").alias("b")).distinct()
    both = stage(met, "closing-pairs").join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(x.values.to_numpy(), y.values.to_numpy(), percent) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def sets_of(held: DataFrame, size: int) -> DataFrame:
    """(node, root, found) from (node, root, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            found = [shingles(text.as_py(), size, known).view("i8") for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), pa.array(found, pa.list_(pa.int64()))], ["node", "root", "found"])

    return held.select("node", "root", "text").mapInArrow(run, "node long, root long, found array<long>")


def texts_of(nodes: DataFrame, texts: DataFrame, names: DataFrame) -> DataFrame:
    """(node, text) of the rows, by id and text key, that stand for these classes."""
    used = stage(nodes.join(names, "node").select("node", "rep", "rep_key"), "used-nodes")
    near = may_contain(texts, F.xxhash64("doc_id", "text_key"), key_filter(used.select(F.xxhash64("rep", "rep_key").alias("k")), "k", FILTER_BITS), FILTER_BITS)
    near = near.dropDuplicates(["doc_id", "text_key"])
    return near.join(used, (F.col("doc_id") == F.col("rep")) & (F.col("text_key") == F.col("rep_key"))).select("node", "text")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of an edge (a, b); root is the smallest node of its component."""
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = stage(small, "edges")
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def with_links(links: DataFrame, more: DataFrame) -> DataFrame:
    """Components of (node, root) and further links (a, b)."""
    more = stage(more, "more-links")
    if more.isEmpty():
        return links
    return stage(components(links.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "links")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", region_rows: int = REGION_ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links of at least ``percent``), kept, text_key."""
    sketched = stage(sketch(docs, shingle, id_col, text_col), "sketches")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = sketched.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.max("signature").alias("signature"), F.count(F.lit(1)).alias("n"))
    # numbers of the classes: unique, and fixed once they are written
    classes = stage(grouped.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("rep.doc_id").alias("rep"), F.col("rep.text_key").alias("rep_key"), "signature", "n"), "classes")
    names = classes.select("node", "rep", "rep_key")

    pairs = stage(candidates(forest(classes, region_rows)), "pairs")
    # ties by a hash, so no class is the partner of most
    best = pairs.groupBy("b").agg(F.max(F.struct("votes", F.xxhash64("a", "b").alias("h"), "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    links = components(verify(best, texts, names, shingle, percent))
    links = stage(links, "links")
    open_pairs = (
        pairs.join(links.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
        .join(links.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        .where("coalesce(ra, a) <> coalesce(rb, b)")
        .join(best.withColumn("done", F.lit(True)), ["a", "b"], "left_anti")
        .select("a", "b")
    )
    open_pairs = stage(open_pairs, "open-pairs")
    if not open_pairs.isEmpty():
        links = with_links(links, verify(open_pairs, texts, names, shingle, percent))
    links = with_links(links, close_regions(classes, links, texts, names, shingle, percent, min(WINDOW + 1, region_rows)))
    named = stage(links.join(names.select("node", "rep"), "node"), "named")
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_class = join_uneven(named, stage(smallest, "smallest"), "root", "n").select("node", "component_id")
    by_class = classes.select("node", "digest", "rep", "n").join(of_class, "node", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"), "n")
    out = join_uneven(sketched.select("doc_id", "text_key", "n_shingles", "digest"), stage(by_class, "components"), "digest", "n")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_key")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay, those with the smallest id of each component, with all their columns."""
    own_id, of = unused(docs, "__id"), unused(docs, "__of")
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **settings).where("kept").select(F.col("doc_id").alias(own_id), F.col("text_key").alias(of)).distinct()
    return docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (text_key(F.col(text_col)) == F.col(of)), "left_semi")
