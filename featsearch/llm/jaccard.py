"""N-gram Jaccard join: a blocked sparse product of the incidence matrix.

Rows of the matrix are distinct shingle sets, columns are shingles. Two sets
with similarity of at least ``t`` share a column among the first
``a - ceil(t a) + 1`` columns of each in any one order of the columns, so only
that part of each row is multiplied. The order puts the most frequent columns
last, which keeps passages that many documents share out of the product.

Columns with the same sets are one column of the product, with their number as
its weight: the columns of a passage that the same documents share meet once.

The product runs by blocks of one column, frequent columns being cut into
blocks of about ``BLOCK`` sets. In a block every set meets one leader; counts of
shared columns pick one leader per set, and the pair is verified on the whole
sets. Rounds repeat that with one set per column and component, under another
order and other blocks, until a round finds few links: groups of near copies
become one component without pairing their members. What is left are pairs
inside a column whose sets lie in different components: there the sets outside
the column's largest component meet the others, the overlap counts are
accumulated per pair up to where a first shared column can lie, pairs whose
count and last shared places cannot reach the size-derived bound are discarded,
and the rest is verified. Every link between
two sets is thus either verified or lies inside a component.

Before texts move, the parity sketches of the two sets (an eighth of a byte to a
quarter per shingle) bound the overlap from above; only pairs that they leave
possible are verified.

Defined results: null, empty and wordless texts have an empty set and link to
nothing; texts with equal sets are one class; a text with fewer words than a
shingle has its whole sequence as one; null ids take part and are named by the
other ids of their component; repeated rows get equal results; an empty table
gives an empty result; other columns are not read. Sets and shingles are told
apart by 64-bit hashes, so two different ones agree by chance once in 2^64.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from featsearch.llm.common import SMALL, join_hot, join_sized, python_ready, stored, word_count
from featsearch.llm.graph import components
from featsearch.llm.shingles import shingle_set

PERCENT = 75
#: Columns known as frequent: they come last in the order and are cut in blocks.
#: Only the order and the blocks depend on it, not the result. 24 bytes each.
FREQUENT = 1 << 18
BLOCK = 1024
#: Rounds go on while the last found one in so many of all links.
FEW = 32
#: Sets of a task whose copies are not posted again, and counters of a task.
SEEN, COUNTERS = 1 << 18, 1 << 18
_SIZE = 1 << 31


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    python_ready(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity sketch of a set: every shingle flips one bit of a string of one to
    two bits a shingle (whole 64-bit words, a power of two of them).

    Two sets differ in at least as many shingles as their sketches in bits. A
    string folds to half its length by XOR of its halves, so sets of different
    sizes compare too.
    """
    words = 1 << max(-(-len(shingles) // 64) - 1, 0).bit_length()
    bit = (shingles >> np.uint64(7)).astype(np.int64) & (64 * words - 1)
    flipped = (np.bincount(bit, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(flipped, bitorder="little").view("<i8")


def _may_be_similar(sx: Column, sy: Column, a: Column, b: Column, percent: int) -> Column:
    """False only where the sketches of sets of sizes ``a``, ``b`` differ in more
    bits than similar sets may differ in shingles: (1 - t) / (1 + t) (a + b)."""

    def folded(s, other):
        half = (F.size(s) / 2).cast("int")
        twice = F.zip_with(F.slice(s, F.lit(1), half), F.slice(s, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(s) > F.size(other), twice).otherwise(s)

    bits = F.zip_with(folded(sx, sy), folded(sy, sx), lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("long"))
    differing = F.aggregate(bits, F.lit(0).cast("long"), lambda n, v: n + v)
    return differing * (100 + percent) <= (a + b) * (100 - percent)


def survey(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One pass: ``id, n_shingles, node, sketch`` of each document (node null if
    its set is empty), and rows ``col, n`` that count columns.

    Tasks count in bounded tables that keep the larger counts; their sums order
    the columns and are not used as exact frequencies.
    """
    rows = _texts(docs, id_col, text_col)
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        fresh, held = [], 0
        names = ["id", "n_shingles", "node", "sketch", "col", "n"]
        words = pa.list_(pa.int64())

        def fold(keys, counts, fresh):
            new, n = np.unique(np.concatenate(fresh), return_counts=True)
            new, n = new[n > 1], n[n > 1]
            keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            if len(keys) > COUNTERS:
                best = np.sort(np.argpartition(-counts, COUNTERS)[:COUNTERS])
                keys, counts = keys[best], counts[best]
            return keys, counts

        for b in batches:
            id_type = b.schema.field("id").type
            sets = [shingle_set(t) for t in b["text"].to_pylist()]
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b["id"], pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([_sketch(s) if len(s) else None for s in sets], words), none, none], names,
            )
            fresh += sets
            held += sum(map(len, sets))
            if held > 1 << 20:
                keys, counts = fold(keys, counts, fresh)
                fresh, held = [], 0
        if fresh:
            keys, counts = fold(keys, counts, fresh)
        if len(keys):
            none = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(keys), id_type), none, none, pa.nulls(len(keys), words), pa.array(keys.view(np.int64)), pa.array(counts)], names
            )

    return stored(rows.mapInArrow(run, f"id {kind}, n_shingles long, node long, sketch array<long>, col long, n long"))


def sketches(surveyed: DataFrame) -> DataFrame:
    """``node, size, sketch`` of every set."""
    rows = surveyed.where("node is not null").groupBy("node")
    return stored(rows.agg(F.any_value("n_shingles").alias("size"), F.any_value("sketch").alias("sketch")))


def frequent(surveyed: DataFrame, top: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """About the ``top`` columns of largest count over all documents, their order and counts.

    A histogram of the counts (sixteen levels to the double) tells from which
    level on columns are taken, and which share, by hash, of the level that
    would pass ``top``: no task sorts or merges them.
    """
    total = stored(surveyed.where("col is not null").groupBy("col").agg(F.sum("n").alias("n")))
    level = F.floor(F.log2("n") * 16)
    cut, share, left = 0, 0, top
    for r in total.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():  # 1,024 rows at most
        if r.n > left:
            cut, share = r.level + 1, 4096 * left // r.n
            break
        left -= r.n
    taken = (level >= cut) | ((level == cut - 1) & (F.pmod(F.xxhash64("col"), F.lit(4096)) < share))
    best = total.where(taken).toArrow().sort_by([("n", "descending"), ("col", "ascending")])  # 16 bytes a row
    keys = best["col"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    counts = best["n"].to_numpy()[order]
    return keys[order], (len(keys) - order).astype(np.int64), counts  # larger: more frequent, later


def postings(docs: DataFrame, often, text_col="text", percent: int = PERCENT) -> DataFrame:
    """``col, node, packed, block`` of the leading columns of every set.

    ``packed`` holds the set's size and the place of the column in it; a
    column counted ``BLOCK`` times or more is cut in blocks 1, 2, ...; block 0
    is a whole column.
    """
    shared = docs.sparkSession.sparkContext.broadcast(often)  # about 6 MB

    def run(batches):
        keys, ranks, counts = shared.value
        seen: set[int] = set()
        for b in batches:
            out = []
            for t in b["text"].to_pylist():
                s = shingle_set(t)
                node = _node(s)
                if not len(s) or node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                rank, block = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    rank = np.where(keys[at] == s, ranks[at], 0)
                    cut = (keys[at] == s) & (counts[at] >= BLOCK)
                    block = np.where(cut, node % (counts[at] // BLOCK + 1) + 1, 0)
                first = np.lexsort((s, rank))[: len(s) + 1 + (-percent * len(s)) // 100]
                out.append((s[first], node, len(s) * _SIZE + np.arange(len(first)), block[first]))
            if out:
                cols, ids, packed, blocks = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(cols).view(np.int64)), pa.array(np.repeat(ids, [len(c) for c in cols])),
                     pa.array(np.concatenate(packed)), pa.array(np.concatenate(blocks))],
                    ["col", "node", "packed", "block"],
                )

    python_ready(docs.sparkSession)
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInArrow(run, "col long, node long, packed long, block long")


def _size(packed: Column) -> Column:
    return F.shiftright(packed, 31)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(_SIZE - 1))


def shared_postings(posted: DataFrame) -> DataFrame:
    """``col, node, packed, weight`` without the columns of one set alone.

    Columns of the same sets fold into one: ``col`` is then a hash of the sets,
    ``weight`` the number of columns, ``packed`` holds the first place. Columns
    in several blocks stay as they are and whole: the blocks come from counts
    over all documents, so a set can be alone in its block and not in its column.
    """
    n = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy("col", "block")
    several = (F.min("node").over(w) != F.max("node").over(w)) | (F.col("block") > 0)
    dealt = posted.repartition(n, "col", "block").select("col", "block", "node", "packed", several.alias("several"))
    kept = dealt.where("several").select("col", "block", "node", "packed").distinct()  # no exchange: still by col, block
    members = F.xxhash64(
        F.count(F.lit(1)).over(w), *[F.bit_xor(F.xxhash64("node", F.lit(i))).over(w) for i in (1, 2)]
    )
    folded = kept.select(F.when(F.col("block") > 0, F.col("col")).otherwise(members).alias("col"), "node", "packed")
    return stored(folded.groupBy("col", "node").agg(F.min("packed").alias("packed"), F.count(F.lit(1)).alias("weight")))


def _met(rows: DataFrame, labels: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """``x, y``: one set per column and component with its block's leader."""
    order = _place(F.col("packed")) if turn == 0 else F.xxhash64("node", F.lit(turn))
    rep = F.struct(order.alias("order"), "packed", "node")
    if labels is None:  # every set is its own component
        reps = rows.select("col", F.col("node").alias("comp"), rep.alias("rep"), "weight")
    else:
        one = _labelled(rows, labels).groupBy("col", "comp").agg(F.min(rep).alias("rep"), F.max("weight").alias("weight"))
        reps = stored(one)
    large = stored(reps.groupBy("col").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BLOCK))
    part = F.pmod(F.xxhash64("comp", F.lit(turn)), F.floor(F.col("n") / BLOCK) + 1)
    reps = join_sized(reps, large, "col", "left").select(
        "col", F.coalesce(part, F.lit(0)).alias("block"), "rep", "weight"
    )
    led = reps.groupBy("col", "block").agg(F.min("rep").alias("leader"))
    mix = F.xxhash64("col", "block")  # a key of its own, so that adaptive skew handling may cut a block
    pairs = reps.select("col", mix.alias("mix"), "rep", "weight").join(led.select("col", mix.alias("mix"), "leader"), ["col", "mix"])
    near = pairs.where("rep.node <> leader.node").where(
        _may_link(F.col("rep.packed"), F.col("leader.packed"), percent)
    )
    counted = near.groupBy(F.col("rep.node").alias("x"), F.col("leader.node").alias("y")).agg(F.sum("weight").alias("shared"))
    return counted.groupBy("x").agg(F.max_by("y", F.struct("shared", F.col("y"))).alias("y"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return join_sized(rows, labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs ``x, y, px, py, weight`` (a row per shared column) that the bounds allow.

    Of the sizes a, b the overlap must reach t (a + b) / (1 + t). It is at
    most the number of shared leading columns met, folded ones by weight, plus
    what either set still has behind the last first place of them: columns that
    were not met begin behind it.
    """
    counted = pairs.groupBy("x", "y").agg(
        F.sum("weight").alias("shared"),
        F.max(_size(F.col("px"))).alias("a"), F.max(_size(F.col("py"))).alias("b"),
        F.max(_place(F.col("px"))).alias("i"), F.max(_place(F.col("py"))).alias("j"),
    )
    most = F.col("shared") + F.least(F.col("a") - F.col("i"), F.col("b") - F.col("j")) - 1
    return counted.where(most * (100 + percent) >= (F.col("a") + F.col("b")) * percent)


def _may_link(px: Column, py: Column, percent: int = PERCENT) -> Column:
    """Bound on two sets whose first shared column is this one: what either
    has from there on. Every link passes at its first shared column."""
    a, b = _size(px), _size(py)
    most = F.least(a - _place(px), b - _place(py))
    return (a * 100 >= b * percent) & (b * 100 >= a * percent) & (most * (100 + percent) >= (a + b) * percent)


def _needed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``node`` is in ``ids``; few ids are broadcast, many shuffled."""
    ids = stored(ids)
    return rows.join(F.broadcast(ids) if ids.count() <= SMALL else ids, "node", "left_semi")


def whole_sets(docs: DataFrame, ids: DataFrame, text_col="text") -> DataFrame:
    """``node, text``: for each set in ``ids`` a text that has it, packed
    (``_unpacked``), as texts move several times until their pairs are verified."""

    def named(batches):
        seen: set[int] = set()
        for b in batches:
            ids, keep = [], []
            for t in b["text"].to_pylist():
                s = shingle_set(t)
                ids.append(_node(s))
                keep.append(len(s) > 0 and ids[-1] not in seen)
                if len(seen) < SEEN:
                    seen.add(ids[-1])
            texts = [zlib.compress(t.encode(), 1) for t, own in zip(b["text"].to_pylist(), keep, strict=True) if own]
            ids = [i for i, own in zip(ids, keep, strict=True) if own]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], ["node", "text"])

    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(named, "node long, text binary")
    return stored(_needed(texts, ids).groupBy("node").agg(F.any_value("text").alias("text")))


def _unpacked(text: bytes) -> str:
    return zlib.decompress(text).decode()


def _not_excluded(pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """The pairs ``x, y`` that their sketches leave possible: no text moves for
    the others, and no similar pair is among them."""
    pairs = stored(pairs.select("x", "y"))
    some = _needed(sketched, pairs.select(F.col("x").alias("node")).union(pairs.select(F.col("y").alias("node"))).distinct())
    for end in "xy":
        pairs = join_hot(pairs, some.select(F.col("node").alias(end), F.col("size").alias(f"n{end}"), F.col("sketch").alias(f"s{end}")), end)
    return pairs.where(_may_be_similar(F.col("sx"), F.col("sy"), F.col("nx"), F.col("ny"), percent)).select("x", "y")


def verified(pairs: DataFrame, sets: DataFrame, sketched: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``x, y`` of nodes whose whole sets are similar, as ``a, b``."""

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out, last = [], (None, None)
        for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
            if last[0] != a:
                last = (a, shingle_set(_unpacked(a)))
            s, r = last[1], shingle_set(_unpacked(b))
            both = len(np.intersect1d(s, r, assume_unique=True))
            out.append(100 * both >= percent * (len(s) + len(r) - both))
        return pa.array(out, pa.bool_())

    pairs = stored(_not_excluded(pairs, sketched, percent))
    some = _needed(sets, pairs.select(F.col("x").alias("node")).union(pairs.select(F.col("y").alias("node"))).distinct())
    with_x = join_hot(pairs, some.select(F.col("node").alias("x"), F.col("text").alias("tx")), "x")
    with_y = join_hot(with_x, some.select(F.col("node").alias("y"), F.col("text").alias("ty")), "y")
    return stored(
        with_y.where(similar.asNondeterministic()("tx", "ty")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    )


def _open_columns(posted: DataFrame, labels: DataFrame) -> DataFrame:
    """The postings of columns whose sets are in several components: the others
    hold nothing new, now or later."""
    lab = _labelled(posted, labels)
    several = lab.groupBy("col").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("col")
    return stored(join_hot(posted, several, "col"))


def links(docs: DataFrame, often, sketched: DataFrame, text_col="text", percent: int = PERCENT) -> DataFrame:
    """``a, b``: verified links between sets that span every component."""
    posted = shared_postings(postings(docs, often, text_col, percent))
    sets = whole_sets(docs, posted.select("node").distinct(), text_col)
    found = verified(_met(posted, None, 0, percent), sets, sketched, percent)
    n_found = n_new = found.count()
    turn = 0
    labels = components(found)
    posted = _open_columns(posted, labels)
    while n_new * FEW > n_found:  # the last round still found its share
        turn += 1
        new = verified(_met(posted, labels, turn, percent), sets, sketched, percent)
        n_new = new.count()
        if n_new:
            found, n_found = found.union(new), n_found + n_new
            labels = components(found)
    lab = stored(_labelled(posted, labels))
    per = lab.groupBy("col", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("col").agg(
        F.max_by("comp", F.struct("n", F.col("comp"))).alias("main"), F.count(F.lit(1)).alias("comps")
    ).where("comps > 1")
    open_cols = stored(join_hot(lab, main, "col"))
    some = _needed(sketched, open_cols.select("node").distinct()).select("node", "sketch")
    open_cols = stored(join_hot(open_cols, some, "node"))
    px, py = F.col("px"), F.col("py")
    few = open_cols.where("comp <> main").select(
        "col", F.col("node").alias("x"), F.col("packed").alias("px"), F.col("comp").alias("cx"), "main", F.col("sketch").alias("sx"), "weight"
    )
    # of two components the smaller one meets the larger only
    mates = open_cols.where("comp = main or comps > 2").select(
        "col", F.col("node").alias("y"), F.col("packed").alias("py"), F.col("comp").alias("cy"), F.col("sketch").alias("sy")
    )
    met = few.withColumn("__mix", F.xxhash64("col", F.lit(1))).join(
        mates.withColumn("__mix", F.xxhash64("col", F.lit(1))), ["col", "__mix"]
    ).where(
        (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x") < F.col("y")))
        & _may_link(px, py, percent)
        & _may_be_similar(F.col("sx"), F.col("sy"), _size(px), _size(py), percent)
    )
    swap = F.col("x") > F.col("y")  # a pair may be met from either side in different columns
    met = met.select(
        "weight", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"),
        F.when(swap, py).otherwise(px).alias("px"), F.when(swap, px).otherwise(py).alias("py"),
    )
    return found.union(verified(_possible(met, percent), sets, sketched, percent))


def classes(docs: DataFrame, id_col="doc_id", text_col="text", percent: int = PERCENT) -> DataFrame:
    """``id, n_shingles, component_id`` of every document."""
    surveyed = survey(docs, id_col, text_col)
    named = surveyed.where("col is null").select("id", "n_shingles", "node")
    labels = components(links(docs, frequent(surveyed), sketches(surveyed), text_col, percent))
    full = stored(
        join_sized(named, labels, "node", "left").select("id", "n_shingles", F.coalesce("comp", "node").alias("comp"))
    )
    least = full.where("comp is not null").groupBy("comp").agg(F.min("id").alias("component_id"))
    return join_hot(full, least, "comp", "left").select(
        "id", "n_shingles", F.coalesce("component_id", "id").alias("component_id")
    )


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component.

    Null ids are larger than every id: a component without ids keeps one of its
    rows, found by the digest of its text. Texts without words are linked with
    nothing and all stay.
    """
    own, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    digest = F.when(own.isNull(), F.md5(text)).otherwise("")
    wordless = own.isNull() & (word_count(text) == 0)
    key = F.struct(own.isNull().alias("none"), own.alias("id"), digest.alias("digest"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), text.alias("text"), wordless.alias("wordless")
    )
    first = classes(rows.where("not wordless"), "key", "text", percent).where("id = component_id").select(
        F.col("id.none").alias("n"), F.col("id.id").alias("i"), F.col("id.digest").alias("d")
    ).distinct()
    same = (F.col("key.none") == F.col("n")) & F.col("key.id").eqNullSafe(F.col("i")) & (F.col("key.digest") == F.col("d"))
    kept = rows.where("not wordless").join(first, same, "left_semi")
    nameless = kept.where("key.none").groupBy("key.digest").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    named = kept.where("not key.none").select("row").unionByName(rows.where("wordless").select("row"))
    return named.unionByName(nameless.select("row")).select("row.*")
