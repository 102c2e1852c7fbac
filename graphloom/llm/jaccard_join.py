"""Similarity join of texts on the Jaccard similarity of their word n-grams.

Texts with the same set of n-grams form a class; the join is between classes.  Each class gets
MinHash signatures for a forest of prefix tries.  A trie is the classes sorted by signature, dealt
over tasks by ranges of it; classes below one trie node stand next to each other, so one walk over the
sorted rows links every class to the first one below the deepest node that it shares with the row
before, and notes that node's depth.  Links of a depth and deeper ones join the classes of the nodes
there into candidate groups (connected components, never all pairs).

The matched prefix starts at the whole signature.  All candidate groups are verified, and the recall
is estimated from the similarities found: a pair of similarity s shares a node of depth d in one of
the tries with probability 1 - (1 - s^d)^tries, so each verified pair stands for the inverse of that
many.  While the mean over the groups is below the target, prefixes are shortened to the first depth at which
these pairs promise the target, and the groups that grew are verified again.  A few pairs at the very threshold count beside those found, so
that little evidence shortens further; at the depth where pairs at the threshold reach the target it ends.

Verification is exact, on 64-bit hashes of the n-grams of the whole texts: pairs of a group are counted by
products of incidence matrices.  Members are dealt by the logarithm of their number of n-grams, as only
neighbouring sizes can be similar enough, and by blocks of about 3 sqrt(m) of the m members of a size; a
task holds two blocks, so no task or row gathers a large group.  Per class it gives the
number of links, and per component of the links one edge for each class; no pair is ever a row.

Defined results: words are what stands between ASCII white space.  A text of fewer than n words
is one n-gram of all its words.  A null or empty text has none: it is a group of its own, without links.
Repeated rows and exact copies are documents of one class, linked to each other.  Null and equal
ids are allowed.  An empty table gives an empty result.  ``jaccard_join`` lets no other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import append_columns, emit, free_name, texts
from graphloom.operators.components import connected_components
from graphloom.storage import materialize

N = 5
#: Similarity of linked texts, as a fraction.
THRESHOLD = (4, 5)
TREES, DEPTH = 24, 8
RECALL = 0.999
_COLUMNS = 4096
#: Pairs at the threshold that count beside those found when recall is estimated, a group each.
DOUBT = 100
#: Largest size of the bitmap of texts that have a partner, as a power of two: 8 MB, whatever the input.
MARK_BITS = 26


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def ngrams(text: bytes, hashes: WordHashes, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out + h[i : len(h) - width + 1 + i])
    return np.unique(out)


class Forest:
    """MinHash functions of all trees; ``sign`` gives a tree's signature as ``depth`` big-endian
    16-bit values, so that bytes sort as prefixes do."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH):
        self.trees, self.depth = trees, depth
        draw = np.random.default_rng(20240229)
        self.a = draw.integers(0, 1 << 32, trees * depth, dtype=np.uint32) | np.uint32(1)
        self.b = draw.integers(0, 1 << 32, trees * depth, dtype=np.uint32)

    def sign(self, grams: np.ndarray) -> bytes:
        x = (grams >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(x), 256):
            low = np.minimum(low, (self.a[:, None] * x[None, i : i + 256] + self.b[:, None]).min(axis=1))
        low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return (low >> np.uint32(16)).astype(">u2").tobytes()


def expected_recall(similarity: float, depth: int, trees: int) -> float:
    return 1.0 - (1.0 - similarity**depth) ** trees


def matched_depth(similarity: float, trees: int, depth: int, target: float) -> int:
    """Shorten the matched prefix until pairs at the threshold are found with the target recall."""
    while depth > 1 and expected_recall(similarity, depth, trees) < target:
        depth -= 1
    return depth


def signatures(docs: DataFrame, text_col: str, id_col: str, n: int, forest: Forest) -> DataFrame:
    """A row per document: doc_id, place (hash of the text), cls (hash of the n-gram set; null for none), sig, size."""

    def make():
        hashes = WordHashes()

        def compute(column: pa.Array):
            cls, sig, size = [], [], []
            for t in texts(column):
                grams = ngrams(t, hashes, n)
                cls.append(xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else None)
                sig.append(forest.sign(grams) if len(grams) else None)
                size.append(len(grams))
            return [cls, sig, size]

        return compute

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("place"), F.col(text_col).alias("text"))
    return append_columns(rows, ["text"], "cls bigint, sig binary, size bigint", make).drop("text")


def trie_links(classes: DataFrame, forest: Forest, least: int) -> DataFrame:
    """Edges (src, dst, depth) of all tries: each class to the first one of the deepest node that it
    shares with the row before, for nodes of at least the depth ``least``."""
    width = 2 * forest.depth
    keys = F.transform(F.sequence(F.lit(0), F.lit(forest.trees - 1)), lambda t: F.struct(t.cast("int").alias("tree"), F.substring(F.col("sig"), t * width + 1, F.lit(width)).alias("key")))
    rows = classes.select("cls", F.explode(keys).alias("k")).select("k.tree", "k.key", "cls")
    sorted_rows = rows.repartitionByRange("tree", "key", "cls").sortWithinPartitions("tree", "key", "cls")
    walked = materialize(_walk(sorted_rows, forest.depth, least), "trie")
    # nodes that go on over the edge of a range: a row per range on the driver
    edges = sorted((r.part, r.first, r.last, r.src, r.dst) for r in walked.where("part is not null").collect())
    over = [(y[3], x[4], d) for x, y in zip(edges, edges[1:]) if (d := _shared(x[2], y[1])) >= least and x[4] != y[3]]
    found = walked.where("part is null").select("src", "dst", "depth")
    if over:
        found = found.union(found.sparkSession.createDataFrame(over, "src bigint, dst bigint, depth int"))
    return found


def _shared(a: bytes, b: bytes) -> int:
    """Values that two keys (tree and signature) share from the left; -1 in different trees."""
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return -1 if same < 4 else (same - 4) // 2


def _walk(rows: DataFrame, depth: int, least: int) -> DataFrame:
    """Links within sorted rows.  A task also gives one row with its number, its first and last class
    (src, dst) and their keys."""

    def make():
        first: tuple | None = None
        last: tuple | None = None  # key and class
        heads = np.zeros(depth + 1, np.int64)  # by depth: first class of the last row's node

        def step(*columns) -> Iterator[dict]:
            nonlocal first, last
            if not columns:
                if first is not None:
                    part = TaskContext.get().partitionId()
                    yield {"src": [first[1]], "dst": [last[1]], "depth": [None], "part": [part], "first": [first[0]], "last": [last[0]]}
                return
            n = len(columns[0])
            tree = columns[0].to_numpy().astype(">i4").view(np.uint8).reshape(n, 4)
            key = np.concatenate([tree, np.frombuffer(b"".join(columns[1].to_pylist()), np.uint8).reshape(n, -1)], axis=1)
            cls = columns[2].to_numpy()
            differ = np.ones((n, key.shape[1] + 1), bool)  # a last column that always differs
            differ[1:, :-1] = key[1:] != key[:-1]
            shared = (differ.argmax(axis=1) - 4) // 2  # below 0 in another tree
            shared[0] = -1 if last is None else _shared(last[0], key[0].tobytes())
            src, dst, deep = [], [], []
            for d in range(least, depth + 1):
                at = np.maximum.accumulate(np.where(shared < d, np.arange(n), -1))
                head = np.where(at >= 0, cls[at], heads[d])
                heads[d] = head[-1]
                link = (shared == d) & (head != cls)
                src.append(cls[link])
                dst.append(head[link])
                deep.append(np.full(int(link.sum()), d, np.int32))
            first = first or (key[0].tobytes(), int(cls[0]))
            last = (key[-1].tobytes(), int(cls[-1]))
            if k := sum(map(len, src)):
                yield {"src": np.concatenate(src), "dst": np.concatenate(dst), "depth": np.concatenate(deep), "part": [None] * k, "first": [None] * k, "last": [None] * k}

        return step

    return emit(rows, ["tree", "key", "cls"], "src bigint, dst bigint, depth int, part int, first binary, last binary", make)


def marks_of(places: DataFrame, column: str, most: int = MARK_BITS) -> np.ndarray:
    """A bitmap of the hashes of a column, 16 bits for each row up to 2^most: at most 2^(most - 6) words reach the
    driver, however many rows there are."""
    bits = min(most, max(16, (16 * places.count()).bit_length()))
    slot = F.pmod(F.col(column), F.lit(1 << bits))
    words = places.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(64)).cast("int"))).alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    return out


def marked(df: DataFrame, column: str, marks: np.ndarray, wanted: bool) -> DataFrame:
    """Rows whose hash is in the bitmap, or those whose hash is not.  A row may be in it by chance,
    so what is in it has to be looked up exactly; what is not in it needs no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(marks)
    at = df.columns.index(column)

    def run(batches):
        bitmap = shared.value
        size = np.uint64(len(bitmap) * 64 - 1)
        for batch in batches:
            slot = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) & size
            hit = (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            yield batch.filter(pa.array(hit if wanted else ~hit))

    return df.mapInArrow(run, df.schema)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over slices of the shared
    n-grams."""
    out = np.zeros((len(left), len(right)), np.float32)
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True) if left and right else []
    sides = []
    for side in (left, right):
        row = np.repeat(np.arange(len(side)), [len(x) for x in side])
        value = np.concatenate(side)
        at = np.searchsorted(both, value)
        ok = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == value) if len(both) else np.zeros(len(value), bool)
        row, at = row[ok], at[ok]
        order = np.argsort(at, kind="stable")
        sides.append((row[order], at[order]))
    for lo in range(0, len(both), _COLUMNS):
        m = []
        for (row, at), side in zip(sides, (left, right)):
            i, j = np.searchsorted(at, [lo, lo + _COLUMNS])
            x = np.zeros((len(side), _COLUMNS), np.float32)
            x[row[i:j], at[i:j] - lo] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Whether the Jaccard similarity reaches the threshold, for all pairs, exact in integers; and the
    similarities of the pairs that do, in the order of the matrix."""
    common = overlaps(left, right).astype(np.int64)
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - common
    hit = common * threshold[1] >= union * threshold[0]
    return hit, common[hit] / union[hit]


def roots(adjacent: np.ndarray) -> np.ndarray:
    """Least index of each node's component, for a symmetric boolean matrix."""
    n = len(adjacent)
    out = np.arange(n)
    while True:
        new = np.minimum(out, np.where(adjacent, out[None, :], n).min(axis=1))
        new = new[new]
        if (new == out).all():
            return out
        out = new


def verify(members: DataFrame, n: int, threshold: tuple[int, int], depths: list[int], trees: int) -> DataFrame:
    """Links of each class from one pair of blocks: cls, grp, links (classes), weights (by depth, the links, each
    by the inverse of its chance to be found there), docs (documents), root.

    ``members`` has grp, x, y (blocks of the pair), block (the member's own), cls, docs, text."""
    schema = "cls bigint, grp bigint, links bigint, weights array<double>, docs bigint, root bigint"

    def check(table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        cls = table["cls"].to_numpy()
        order = np.argsort(cls)
        cls, docs, block = cls[order], table["docs"].to_numpy()[order], table["block"].to_numpy()[order]
        raw = table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else table["text"]
        sets = [ngrams(raw[int(i)].as_buffer().to_pybytes(), hashes, n) for i in order]
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        size = len(cls)
        hit, weights = np.zeros((size, size), bool), np.zeros((size, len(depths)))
        a, b = np.flatnonzero(block == x), np.flatnonzero(block == y)
        if len(a) and len(b):
            found, similar = linked([sets[i] for i in a], [sets[i] for i in b], threshold)
            if x == y:
                apart = ~np.eye(len(a), dtype=bool)
                similar, found = similar[apart[found]], found & apart
            i, j = np.nonzero(found)
            for k, d in enumerate(depths):
                worth = 1.0 / expected_recall(similar, d, trees)
                weights[:, k] += np.bincount(a[i], worth, size)
                if x != y:
                    weights[:, k] += np.bincount(b[j], worth, size)
            hit[a[i], b[j]] = hit[b[j], a[i]] = True
        root = cls[roots(hit)]
        out = {"cls": cls, "grp": table["grp"].to_numpy()[order], "links": hit.sum(axis=1, dtype=np.int64), "weights": list(weights), "docs": hit.astype(np.int64) @ docs, "root": root}
        del hit, sets
        return pa.table(out)

    return members.groupBy("grp", "x", "y").applyInArrow(check, schema)


def dealt(members: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Members (grp, cls, size, ...) with the pairs of blocks x <= y that they take part in, and their own block.

    A pair reaches the threshold only if its sizes do, so only blocks of the same or the next power of
    the threshold's inverse meet."""
    step = math.log(threshold[1] / threshold[0])
    binned = members.withColumn("bin", F.floor(F.log(F.col("size").cast("double")) / step + 1e-9).cast("bigint"))
    # a row per group and size, with the blocks of the sizes next to it
    blocks = F.ceil(F.count("*") / F.greatest(F.lit(64.0), F.lit(3.0) * F.sqrt(F.count("*")))).cast("bigint")
    sizes = binned.groupBy("grp", "bin").agg(blocks.alias("n"))
    near = F.explode(F.array(*[F.struct((F.col("bin") + d).alias("bin"), *[F.when(F.lit(d == e), F.col("n")).alias(c) for e, c in ((0, "blocks"), (1, "below"), (-1, "above"))]) for d in (-1, 0, 1)])).alias("s")
    around = sizes.select("grp", near).select("grp", "s.*").groupBy("grp", "bin").agg(*[F.sum(c).alias(c) for c in ("blocks", "below", "above")])
    around = around.where("blocks is not null").na.fill(0, ["below", "above"])
    rows = binned.join(materialize(around, "around"), ["grp", "bin"])
    number = lambda b, i: b * F.lit(1 << 32) + i
    rows = rows.withColumn("block", number(F.col("bin"), F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks"))))
    numbers = lambda b, n: F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: number(b, i))
    others = [numbers(F.col("bin") + d, F.col(c)) for d, c in ((0, "blocks"), (1, "above"), (-1, "below"))]
    none = F.array().cast("array<bigint>")
    others = F.concat(others[0], F.when(F.col("above") > 0, others[1]).otherwise(none), F.when(F.col("below") > 0, others[2]).otherwise(none))
    rows = rows.withColumn("other", F.explode(others))
    return rows.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("bin", "blocks", "below", "above", "other")


def texts_of(docs: DataFrame, members: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """One text of each class, as (place, text): by hash and id, so that the copies of a text spread over
    the shuffle; a bitmap keeps texts without a partner out of it."""
    wanted = members.select(F.col("place").alias("_place"), F.col("rep_id").alias("_id"))
    body = docs.select(F.xxhash64(text_col).alias("place"), F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    body = marked(body, "place", marks_of(wanted, "_place"), True)
    return body.join(wanted, (F.col("place") == F.col("_place")) & F.col("rep").eqNullSafe(F.col("_id")), "left_semi").dropDuplicates(["place", "rep"]).select("place", "text")


def estimated_recall(checked: DataFrame, at_threshold: list[float], doubt: int) -> list[float]:
    """By depth: mean of the groups' shares of links that are found there, with ``doubt`` groups at the threshold."""
    each = range(len(at_threshold))
    groups = checked.groupBy("grp").agg(F.sum("links").alias("links"), *[F.sum(F.col("weights")[k]).alias(f"w{k}") for k in each]).where("links > 0")
    got = groups.agg(F.count("*").alias("groups"), *[F.sum(F.col("links") / F.col(f"w{k}")).alias(f"found{k}") for k in each]).first()
    return [((got[f"found{k}"] or 0.0) + doubt * at_threshold[k]) / (got.groups + doubt) for k in each]


def similar_groups(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    n: int = N,
    threshold: tuple[int, int] = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    doubt: int = DOUBT,
) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, place, cls) and classes (cls, grp, docs, n_links, least_id, rep_id, place).

    ``rep_id`` and ``place`` are of the class's first document, one with an id if there is one.  ``grp`` names the connected component of the links, ``docs`` counts the documents of the class and
    ``n_links`` the other documents whose similarity reaches the threshold."""
    forest = Forest(trees, depth)
    similarity = threshold[0] / threshold[1]
    signed = materialize(signatures(docs, text_col, id_col, n, forest), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("r")
    by_class = signed.where("cls is not null").groupBy("cls").agg(F.count("*").alias("docs"), first, F.min("doc_id").alias("least_id"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    classes = materialize(by_class.select("cls", "docs", "r.place", F.col("r.doc_id").alias("rep_id"), "least_id", "sig", "size"), "classes")
    least = matched_depth(similarity, trees, depth, recall)
    links = materialize(trie_links(classes, forest, least), "trie")
    depths = list(range(depth, least - 1, -1))
    sure = [expected_recall(similarity, d, trees) for d in depths]
    groups = checked = known = None
    place, above = 0, depth + 1
    while True:
        matched = depths[place]
        edges = links.where((F.col("depth") >= matched) & (F.col("depth") < above)).select("src", "dst")
        if groups is not None:  # what was joined stays joined
            edges = edges.union(groups.select(F.col("cls").alias("src"), F.col("grp").alias("dst")))
        groups = materialize(connected_components(edges).select(F.col("node").alias("cls"), F.col("component").alias("grp")), "groups")
        sizes = materialize(groups.groupBy("grp").agg(F.count("*").alias("m")), "sizes")
        grown = sizes if known is None else sizes.join(known, ["grp", "m"], "left_anti")  # groups only merge
        grown, known, above = materialize(grown.select("grp"), "grown"), sizes, matched
        if checked is None or not grown.isEmpty():
            # written tables on both sides, so that a hot group's rows can be split
            members = materialize(groups.join(grown, "grp").join(classes.select("cls", "docs", "place", "rep_id", "size"), "cls"), "members")
            pairs = dealt(members, threshold).join(texts_of(docs, members, text_col, id_col), "place")
            pairs = pairs.select("grp", "x", "y", "block", "cls", "docs", F.col("text").cast("binary").alias("text"))
            now = verify(pairs, n, threshold, depths, trees)
            if checked is not None:
                now = now.union(checked.join(members.select("cls"), "cls", "left_anti").select(*now.columns))
            checked = materialize(now, "links")
        # the first depth that promises the target, by the similarities seen so far; the last one always does
        reached = next((k for k, r in enumerate(estimated_recall(checked, sure, doubt)) if r >= recall), len(depths) - 1)
        if reached <= place:
            break
        place = reached
    found = checked.groupBy("cls").agg(F.sum("docs").alias("linked"))
    comps = connected_components(checked.where("cls <> root").select(F.col("cls").alias("src"), F.col("root").alias("dst")))
    out = (
        classes.drop("sig", "size")
        .join(found, "cls", "left")
        .join(comps.select(F.col("node").alias("cls"), "component"), "cls", "left")
        .select("cls", F.coalesce("component", "cls").alias("grp"), "docs", (F.coalesce("linked", F.lit(0)) + F.col("docs") - 1).alias("n_links"), "least_id", "rep_id", "place")
    )
    return signed.select("doc_id", "place", "cls"), out


def jaccard_join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """A row per document: doc_id, class_id (the least id of its group), n_links, class_docs."""
    rows, classes = similar_groups(docs, text_col, id_col, **options)
    classes = materialize(classes, "linked")
    ids = materialize(classes.groupBy("grp").agg(F.min("least_id").alias("class_id")), "ids")
    found = classes.join(ids, "grp").select("cls", "class_id", "n_links", F.col("docs").alias("class_docs"))
    return rows.join(found, "cls", "left").select(
        "doc_id",
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("class_docs", F.lit(1)).cast("bigint").alias("class_docs"),
    )


def first_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without near duplicates: of each group the row with the least id stays, then
    the least text hash; rows equal in both count once.  Texts without words all stay.  All columns pass through."""
    rows, classes = similar_groups(docs, text_col, id_col, **options)
    classes = materialize(classes, "linked")
    least = F.min(F.struct(F.col("rep_id").isNull().alias("none"), F.col("rep_id").alias("id"), "place"))
    groups = materialize(classes.groupBy("grp").agg(least.alias("r"), F.sum("docs").alias("size")).where("size > 1"), "groups")
    at, stay_id, stay_at = (free_name(docs, x) for x in ("_at", "_stay_id", "_stay_at"))
    stay = groups.select(F.col("r.id").alias(stay_id), F.col("r.place").alias(stay_at))
    # texts of groups of several documents; all others stay without a shuffle
    several = rows.where("cls is not null").select("place", "cls").distinct().join(classes.join(groups.select("grp"), "grp").select("cls"), "cls")
    several = materialize(several.select(F.col("place").alias(at)).distinct(), "places")
    marks = marks_of(several, at)
    placed = docs.withColumn(at, F.xxhash64(f"`{text_col}`"))
    found = marked(placed, at, marks, True)
    member = found.join(several, at, "left_semi").select(*[F.col(f"`{c}`") for c in placed.columns])
    kept = member.join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col(stay_id)) & (F.col(at) == F.col(stay_at)), "left_semi").dropDuplicates([id_col, at])
    chance = found.join(several, at, "left_anti").select(*[F.col(f"`{c}`") for c in placed.columns])
    return marked(placed, at, marks, False).unionByName(kept).unionByName(chance).drop(at)
