"""Near-duplicate classes by Order MinHash and banded alignment.

Words are lower-cased runs of letters, digits and characters beyond ASCII. A text is the sequence of its
five-word k-mers, each labelled with its occurrence (the second "a b c d e" is another k-mer than the
first); a text of fewer words is one k-mer of them all. An Order MinHash sketch takes the ``LENGTH`` k-mers of
least hash and lists them in text order, so two texts share it with about the probability ``J**LENGTH`` if
their k-mers stand in the same order, and not if they are shuffled. Each of ``SKETCHES`` sketches is a bucket.
A text of four to ``SHORT`` k-mers has further buckets: what is left of it without any ``r`` of its ``n`` k-mers,
for each ``r`` up to ``n / 5``. Two such texts of the threshold's similarity always share one.

Similarity is the alignment's: matched k-mers over all different ones, ``L / (n + m - L)``, with ``L`` the
longest common subsequence. Since labelled k-mers are unique, this is the longest increasing run of
positions, and a pair that reaches the threshold cannot match beyond the band ``(n + m) / 9``.

Inside a bucket not all pairs are made. A pivot is compared with every other member. In even sketches the first
pivot is the member that shares buckets with most others, in odd ones a member drawn by a hash, so that a text
meets several pivots. Members that no comparison has linked yet become pivots in the following ``ROUNDS``.
What is then open is made whole: in each bucket the members outside its largest component meet every member
of another component, so that no two classes share a bucket with an untried pair that could be similar.
Pairs whose lengths or parity bitmaps exclude the threshold are left out, which loses none: the bitmaps of two
texts differ in no more bits than their k-mers differ, and that is at most ``(n + m) / 9``.
Classes are the connected components of the verified links, found by minimum labels with pointer jumping.

Equal texts, known by 128 bits, are one node from the start; copies are never expanded. Texts enter only for
candidates: each once with all its pivots where the pivots' texts are few enough to broadcast, else once a pair.
Links and classes stay distributed.

Defined results: equal texts are always one class, also null (an empty text) and texts without a word, which
have no other link; a class is named by its least doc_id, null where none is known; repeated rows get the
same class; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES, LENGTH = 28, 5
ROUNDS = 3
SHORT = 10
#: A table of keys is broadcast up to so many rows of two or three numbers; beyond, Spark shuffles.
BROADCAST_ROWS = 50_000
#: Texts of pivots are broadcast up to so many bytes.
BROADCAST_BYTES = 32_000_000
#: Bits of the parity bitmap of a text's k-mers.
PARITY_BITS = 2048
#: K-mers of pivots that a worker keeps.
KEPT_KMERS = 4_000_000
#: A bucket is dealt to one more task for each so many members.
DEALT_ROWS = 500

_WORD_BYTE = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _WORD_BYTE[_a:_b] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_DRAW = np.random.Generator(np.random.PCG64(5))
_STEP = _DRAW.integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _DRAW.integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << int(n).bit_length()
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                values = np.full(size, base, dtype=np.uint64)
                values[0] = 1
                setattr(self, name, np.multiply.accumulate(values))


_POWERS = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(text: str) -> np.ndarray:
    """The hashes of the occurrence-labelled k-mers of a text in text order."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _WORD_BYTE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    _POWERS.reach(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS.up[: len(data)], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * _POWERS.down[starts])
    n = len(words)
    if n < SHINGLE:
        return _mix((words * _STEP[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    made = words[: n - SHINGLE + 1] * _STEP[0]
    for j in range(1, SHINGLE):
        made = made + words[j : n - SHINGLE + 1 + j] * _STEP[j]
    made = _mix(made)
    order = np.argsort(made, kind="stable")
    same = made[order[1:]] == made[order[:-1]]
    if same.any():
        at = np.arange(len(made))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), at, 0))
        occurrence = np.empty(len(made), dtype=np.uint64)
        occurrence[order] = at - first
        made = np.where(occurrence > 0, _mix(made + occurrence * _ODD), made)
    return made


def order_minhash(labelled: np.ndarray) -> np.ndarray:
    """The SKETCHES sketches of a text's k-mers; none for a text without a word."""
    n = len(labelled)
    if not n:
        return np.zeros(0, dtype=np.int64)
    out = np.empty(SKETCHES, dtype=np.uint64)
    some = max(1, min(SKETCHES, 200_000 // n))
    for a in range(0, SKETCHES, some):
        seeds = _SEEDS[a : a + some, None]
        if n > LENGTH:
            hashes = labelled[None, :] * seeds
            hashes ^= hashes >> np.uint64(29)
            least = np.sort(np.argpartition(hashes, LENGTH - 1, axis=1)[:, :LENGTH], axis=1)
        else:
            least = np.broadcast_to(np.arange(n), (len(seeds), n))
        sketch = _SEEDS[a : a + some].copy()
        for column in labelled[least].T:
            sketch = _mix(sketch * _ODD + column)
        out[a : a + some] = sketch
    return out.view(np.int64)


def short_buckets(labelled: np.ndarray) -> np.ndarray:
    """The buckets of a short text besides its sketches: its k-mers in text order with up to a fifth of them left out."""
    n = len(labelled)
    if not 4 <= n <= SHORT:
        return np.zeros(0, dtype=np.int64)
    out = []
    for r in range(n // 5 + 1):
        left = np.array(list(combinations(range(n), n - r)))
        bucket = np.full(len(left), _ODD)
        for column in labelled[left].T:
            bucket = _mix(bucket * _ODD + column)
        out.append(bucket)
    return np.unique(np.concatenate(out)).view(np.int64)


def parity(labelled: np.ndarray) -> np.ndarray:
    """A bitmap in which each k-mer flips one bit; two texts' bitmaps differ in at most as many bits as they have different k-mers."""
    flips = np.bincount((labelled % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Matched over all k-mers of the best alignment inside the band; 0 where it cannot reach ``least``."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(ia) < least * (n + m - len(ia)):
        return 0.0
    band = (n + m) * (1 - least) / (1 + least) + 1
    near = np.abs(ia - ib) <= band
    ia, ib = ia[near], ib[near]
    run = ib[np.argsort(ia)]
    if len(run) and not (np.diff(run) > 0).all():
        tops: list[int] = []
        for x in run.tolist():
            at = bisect_left(tops, x)
            tops[at : at + 1] = [x]
        length = len(tops)
    else:
        length = len(run)
    return length / (n + m - length)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(3)
        for a in range(0, len(texts), 2048):
            made = [kmers(t.as_py()) for t in texts[a : a + 2048]]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c)[a : a + 2048] for c in range(3)),
                    pa.array([len(k) for k in made], pa.int32()),
                    pa.array([np.concatenate([order_minhash(k), short_buckets(k)]) for k in made], pa.list_(pa.int64())),
                ],
                names=["doc_id", "x", "y", "n", "sketches"],
            )


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", *(f"p{i}" for i in range(PARITY_BITS // 64))]
    for batch in batches:
        if batch.num_rows:
            made = np.stack([parity(kmers(t.as_py())) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(column) for column in made.T)], names=names)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    member, member_kmers = None, None
    pivots: dict[int, np.ndarray] = {}
    held = 0
    for batch in batches:
        linked = []
        for a, b, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if a != member:
                member, member_kmers = a, kmers(text_a.as_py())
            pivot_kmers = pivots.get(b)
            if pivot_kmers is None:
                pivot_kmers = kmers(text_b.as_py())
                if held > KEPT_KMERS:
                    pivots.clear()
                    held = 0
                pivots[b] = pivot_kmers
                held += len(pivot_kmers) + 64
            linked.append(aligned_similarity(member_kmers, pivot_kmers) >= SIMILARITY)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _identity() -> tuple[Column, Column]:
    """128 bits of a text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _light(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _candidates(members: DataFrame, tried: DataFrame | None, settled: DataFrame | None, n_tried: int, turn: int) -> DataFrame:
    """a, b: members of a bucket with its pivot of this turn, pairs that were not tried yet."""
    if settled is None:
        rank = F.when(F.col("band") % 2 == 0, F.struct((-F.col("spread")).alias("x"), F.col("key").alias("y"))).otherwise(
            F.struct(F.xxhash64("key", "band").alias("x"), F.col("key").alias("y"))
        )
        open_members = members
    else:
        rank = F.struct(F.xxhash64("key", "band", F.lit(turn)).alias("x"), F.col("key").alias("y"))
        open_members = members.join(_light(settled, 2 * n_tried), "key", "left_anti")
    pivots = open_members.groupBy("bucket").agg(F.min_by(F.struct("key", "n"), rank).alias("p")).select("bucket", F.col("p.key").alias("b"), F.col("p.n").alias("m"))
    fits = (F.col("key") != F.col("b")) & (F.least("n", "m") >= SIMILARITY * F.greatest("n", "m"))
    pairs = members.join(pivots, "bucket").filter(fits).select(F.col("key").alias("a"), "b")
    # each pair once, whichever of the two is the pivot
    pairs = pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max(F.struct("b", "a")).alias("p"))
    if tried is not None:
        known = tried.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        pairs = pairs.join(_light(known, n_tried), ["x", "y"], "left_anti")
    return pairs.select("p.a", "p.b")


def _open_pairs(members: DataFrame, texts: DataFrame, labels: DataFrame, n_labels: int, tried: DataFrame, n_tried: int) -> DataFrame:
    """a, b: untried pairs that share a bucket, are in different components and may be similar.

    Each has a member outside the bucket's largest component; pairs inside one need no comparison. In a bucket
    of two the first pivot has met the other.
    """
    words = [f"p{i}" for i in range(PARITY_BITS // 64)]
    placed = members.select("bucket", "key", "n").join(_light(labels, n_labels), "key", "left").select("bucket", "key", "n", F.coalesce("label", "key").alias("label"))
    held = placed.groupBy("bucket", "label").agg(F.count("*").alias("size"))
    mixed = held.groupBy("bucket").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.sum("size").alias("size"), F.count("*").alias("classes"))
    mixed = mixed.filter("classes > 1 AND size > 2").select("bucket", "main", F.expr(f"int(1 + size div {DEALT_ROWS})").alias("parts"))
    # written, so that hot buckets are skewed joins that Spark can split
    mixed = stored(placed.join(mixed, "bucket"))
    asked = texts.join(mixed.select("key").distinct(), "key", "left_semi").select("key", "text")
    bits = asked.mapInArrow(_parities, "key long, " + ", ".join(f"{w} long" for w in words)).dropDuplicates(["key"])
    mixed = stored(mixed.join(bits, "key").select("bucket", "key", "n", "label", "main", "parts", *words))
    # never null, which keeps the generated code of the comparison short
    known = {"key": "long", "n": "int", "label": "long", "main": "long", **dict.fromkeys(words, "long")}
    mixed = mixed.select("bucket", "parts", *[F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in known.items()])
    part = F.pmod("key", "parts").cast("int").alias("part")
    theirs = mixed.select("bucket", part, F.col("key").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("m"), *[F.col(w).alias(f"{w}_b") for w in words])
    mine = mixed.filter("label <> main").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("key").alias("a"), "label", "main", "n", *words)
    differ = F.expr(" + ".join(f"bit_count({w} ^ {w}_b)" for w in words))
    fits = (F.least("n", "m") >= SIMILARITY * F.greatest("n", "m")) & (differ * (1 + SIMILARITY) <= (F.col("n") + F.col("m")) * (1 - SIMILARITY) + 1e-6)
    once = (F.col("label_b") == F.col("main")) | (F.col("a") < F.col("b"))
    # small in bytes and heavy in pairs, so the number of tasks goes by the rows
    theirs = theirs.repartition(1 + mixed.count() // DEALT_ROWS, "bucket", "part")
    pairs = mine.join(theirs, ["bucket", "part"]).filter((F.col("label") != F.col("label_b")) & once & fits)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    before = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(_light(before, n_tried), ["a", "b"], "left_anti")


def _joined(labels: DataFrame, n_labels: int, late: DataFrame, n_late: int) -> DataFrame:
    """The components after the late links, found on the smaller graph whose nodes are the components before."""
    ends = late.select(F.col("a").alias("key")).union(late.select("b")).distinct()
    known = labels.join(_light(ends, 2 * n_late), "key")
    if n_late <= BROADCAST_ROWS:  # as few as a broadcast table
        label = {r["key"]: r["label"] for r in known.collect()}
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for r in late.collect():
            a, b = sorted(top(label.setdefault(r[end], r[end])) for end in ("a", "b"))
            if a != b:
                up[b] = a
        over = labels.sparkSession.createDataFrame([(x, top(x)) for x in {*label.values()}], "label long, least long")
    else:
        named = stored(ends.join(known, "key", "left").select("key", F.coalesce("label", "key").alias("label")))
        joined = late
        for end in ("a", "b"):
            joined = joined.join(named.withColumnsRenamed({"key": end, "label": f"label_{end}"}), end)
        over = components(joined.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), n_late)
        over = over.select(F.col("key").alias("label"), F.col("label").alias("least"))
    new = ends.join(_light(labels.select("key"), n_labels), "key", "left_anti").select("key", F.col("key").alias("label"))
    moved = labels.unionByName(new).join(_light(over, 2 * n_late), "label", "left")
    return stored(moved.select("key", F.coalesce("least", "label").alias("label")))


def _nodes(sketched: DataFrame) -> DataFrame:
    """key, x, y, first_doc, n, sketches of the different texts. The key is x, and another hash for all but one of the texts that share an x."""
    nodes = stored(sketched.groupBy("x", "y").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("sketches").alias("sketches")))
    shared = stored(nodes.groupBy("x").agg(F.min("y").alias("owner"), F.count("*").alias("texts")).filter("texts > 1"))
    n_shared = shared.count()
    if not n_shared:
        return nodes.withColumn("key", F.col("x"))
    joined = nodes.join(_light(shared, n_shared), "x", "left")
    return stored(joined.select(F.when(F.col("y") == F.coalesce("owner", "y"), F.col("x")).otherwise(F.xxhash64("y", "x")).alias("key"), "x", "y", "first_doc", "n", "sketches"))


def links(sketched: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """The nodes (key, x, y, first_doc), the verified links (a, b) between different texts, their number, and the components (key, label).

    ``sketched``: doc_id, x, y, n, sketches of every row; ``docs``: doc_id, x, y, text.
    """
    nodes = _nodes(sketched)
    placed = nodes.select("key", "n", F.posexplode("sketches").alias("band", "bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = stored(placed.join(shared, "bucket"))
    spread = stored(members.groupBy("key").agg(F.sum("size").alias("spread")))
    members = stored(members.join(spread, "key").select("bucket", "band", "key", "n", "spread"))
    needed = nodes.join(spread.select("key"), "key").select("key", "x", "y", F.coalesce("first_doc", F.lit(0)).alias("at"), F.col("first_doc").isNull().alias("no_id"))
    texts = docs.select("x", "y", F.coalesce("doc_id", F.lit(0)).alias("at"), F.col("doc_id").isNull().alias("no_id"), "text")
    # repeated rows give the same text more than once, which only repeats verdicts
    texts = stored(texts.join(needed, ["x", "y", "at", "no_id"]).select("key", "text"))

    def verified(pairs: DataFrame, n_pairs: int) -> DataFrame:
        pivots = texts.join(_light(pairs.select(F.col("b").alias("key")).distinct(), n_pairs), "key", "left_semi").select(F.col("key").alias("b"), F.col("text").alias("text_b"))
        pivots = stored(pivots)
        of_a = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
        if (pivots.agg(F.sum(F.octet_length("text_b") + 64).alias("bytes")).first()["bytes"] or 0) <= BROADCAST_BYTES:
            listed = pairs.groupBy("a").agg(F.collect_list("b").alias("bs"))
            asked = of_a.join(_light(listed, n_pairs), "a").select("a", F.explode("bs").alias("b"), "text_a").join(F.broadcast(pivots), "b")
        else:
            asked = of_a.join(_light(pairs, n_pairs), "a").join(pivots, "b")
        return stored(asked.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long, linked boolean"))

    tried, settled, n_tried = None, None, 0
    for turn in range(1 + ROUNDS):
        pairs = stored(_candidates(members, tried, settled, n_tried, turn))
        n_pairs = pairs.count()
        if not n_pairs:
            break
        verdicts = verified(pairs, n_pairs)
        tried = verdicts if tried is None else tried.unionByName(verdicts)
        n_tried += n_pairs
        hits = tried.filter("linked")
        settled = hits.select(F.col("a").alias("key")).union(hits.select("b")).union(tried.select("b"))
    names = nodes.select("key", "x", "y", "first_doc")
    if tried is None:
        none = docs.sparkSession.createDataFrame([], "a long, b long, key long, label long")
        return names, none.select("a", "b"), 0, none.select("key", "label")
    found = stored(tried.filter("linked").select("a", "b").distinct())
    n_found = found.count()
    labels = components(found, n_found)
    pairs = stored(_open_pairs(members, texts, labels, 2 * n_found, tried, n_tried))
    n_pairs = pairs.count()
    late = stored(verified(pairs, n_pairs).filter("linked").select("a", "b").distinct()) if n_pairs else None
    n_late = late.count() if n_pairs else 0
    if n_late:
        labels = _joined(labels, 2 * n_found, late, n_late)
        found, n_found = found.unionByName(late), n_found + n_late
    return names, found, n_found, labels


def components(edges: DataFrame, n_edges: int | None = None) -> DataFrame:
    """key, label of every node that an edge touches; the label is the least key of its component."""
    n_nodes = 2 * (edges.count() if n_edges is None else n_edges)
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stored(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("label")).select("key", F.least("key", "label").alias("label")))
    while n_nodes:
        seen = both.join(_light(labels, n_nodes), both.b == labels.key).groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        lower = seen.join(_light(labels, n_nodes), "key").select("key", "label", F.least("label", "near").alias("low"))
        far = labels.select(F.col("key").alias("low"), F.col("label").alias("jump"))
        after = stored(lower.join(_light(far, n_nodes), "low").select("key", F.col("label").alias("was"), F.least("low", "jump").alias("label")))
        labels = after.select("key", "label")
        if after.filter("was <> label").isEmpty():
            break
    return labels


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, x and y of every row, and of every text x, y, its label, class_id, same_text_id and verified_links.

    The label is the class: unlike class_id it is never null and no other class has it.
    """
    x, y = _identity()
    keyed = docs.select(F.col("doc_id").cast("long"), x.alias("x"), y.alias("y"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sketched = stored(keyed.mapInArrow(_sketch, "doc_id long, x long, y long, n int, sketches array<long>"), lasting=True)
    nodes, edges, n_edges, labels = links(sketched, keyed)
    counts = edges.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("verified_links"))
    linked = stored(nodes.join(_light(labels.join(counts, "key"), 2 * n_edges), "key"))
    # written, so that a class of many texts is a skewed join that Spark can split
    first = stored(linked.groupBy("label").agg(F.min("first_doc").alias("class_id")))
    classes = linked.join(_light(first, n_edges), "label").select("key", "label", "class_id", "verified_links")
    own = nodes.join(_light(classes.withColumn("in_class", F.lit(True)), 2 * n_edges), "key", "left").select(
        "x",
        "y",
        F.coalesce("label", "key").alias("label"),
        F.when(F.col("in_class"), F.col("class_id")).otherwise(F.col("first_doc")).alias("class_id"),
        F.col("first_doc").alias("same_text_id"),
        F.coalesce("verified_links", F.lit(0)).cast("long").alias("verified_links"),
    )
    return sketched.select("doc_id", "x", "y"), stored(own, lasting=True)


def duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, same_text_id, verified_links of every row.

    class_id is the least doc_id of the class, same_text_id that of the equal texts; verified_links counts the
    links of the text to other texts among the pairs that were compared, which in a large class are not all.
    """
    with scratch(docs.sparkSession):
        rows, own = _classes(docs)
    return rows.join(own, ["x", "y"]).select("doc_id", "class_id", "same_text_id", "verified_links")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Of each class the row of the least doc_id, a null one last; one row where rows are repeated."""
    with scratch(docs.sparkSession):
        rows, own = _classes(docs)
        first = F.struct(F.col("same_text_id").isNull().alias("no_id"), F.col("same_text_id").alias("doc_id"), "x", "y")
        chosen = own.groupBy("label").agg(F.min(first).alias("first")).select(*[F.col(f"first.{c}").alias(f"__{c}") for c in ("x", "y", "doc_id")])
        chosen = stored(chosen, lasting=True)
        repeated = not rows.groupBy("doc_id", "x", "y").count().filter("count > 1").isEmpty()
    x, y = _identity()
    marked = docs.withColumns({"__row_x": x, "__row_y": y, "__row_doc_id": F.col("doc_id").cast("long")})
    # with the id, so that the copies of one text do not meet in one task
    same = (F.col("__row_x") == F.col("__x")) & (F.col("__row_y") == F.col("__y")) & F.col("__row_doc_id").eqNullSafe(F.col("__doc_id"))
    kept = marked.join(chosen, same, "left_semi")
    kept = kept.dropDuplicates(["__row_x", "__row_y", "__row_doc_id"]) if repeated else kept
    return kept.drop("__row_x", "__row_y", "__row_doc_id")
