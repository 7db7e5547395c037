"""Near-duplicate documents by an inverted join over the coordinates of MinHash signatures.

Every distinct shingle set gets a signature of ``K`` coordinates. Two sets with similarity
``J`` agree in about ``K * J`` of them, so pairs that agree in at least ``T`` are the candidates
(a pair at 0.8 falls below 36 of 64 with a chance of 4e-6) and full sets decide.

Candidates are found the way a merge of posting lists with a count threshold finds them:

* sets are posted under each (coordinate, value); values that only one set has cannot
  collide and end there;
* ``T`` collisions out of ``K`` coordinates imply one among any ``K - T + 1``, so a set is only
  looked up under its ``K - T + 1`` rarest postings (prefix), and the frequent lists are skipped;
* the collisions of the pairs found are then counted on the two signatures.

Every set is first paired with one other alone, the head of one of its lists. From then on lists know the component of each member, and only pairs of different components are of interest.
Lists with few of those for their length are compared pair by pair. In a list with many (two large groups of near
copies that resemble each other but are not similar) links are found through differences from a head:
two sets that both lie near it can only be similar if their differences coincide enough, and differences that
few sets share are looked up first. The members that share a difference form a list again, in which a
group that hangs together costs no pair. No link between groups is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterline.llm.graph import components
from quarterline.llm.words import batches, shingle_sets, sliced
from quarterline.session import small_batches, stage

K = 64
T = 36
WIDTH = 4
#: links need 100 * shared >= PERCENT * union
PERCENT = 80
#: pairs per member up to which the members of a list that are not connected yet are compared one by one
SHORT = 48
#: heads that a set is compared with before anything else
HEADS = 2
#: members of one component in a list that make it a large group there
LARGE = 16
#: heads after which a list is compared pair by pair however many there are
DEPTH = 4
#: ids up to which a list of them is broadcast (8 bytes each)
BROADCAST_IDS = 1_000_000

_SEEDS = np.random.default_rng(7)
_TIMES = _SEEDS.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _SEEDS.integers(1, 1 << 63, K, dtype=np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each of ``K`` hash functions over the set, 32 bits each."""
    low = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at: at + 2048, None] * _TIMES + _PLUS
        np.minimum(low, part.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _signatures(width: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            sizes, keys, coordinates = [], [], []
            for _, raws in batches(part.column(1).to_pylist()):
                for shingles in shingle_sets(raws, width):
                    sizes.append(len(shingles))
                    keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest())
                    coordinates.append(minhash(shingles).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()),
                pa.ListArray.from_arrays(
                    np.arange(len(sizes) + 1, dtype=np.int32) * K,
                    np.concatenate(coordinates) if coordinates else np.zeros(0, np.int32)),
            ], names=["doc_id", "n_shingles", "set_key", "signature"])
    return run


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, a key of the whole set, its signature; one row per row of ``docs``."""
    return docs.select("doc_id", "text").mapInArrow(
        _signatures(width),
        "doc_id bigint, n_shingles bigint, set_key string, signature array<int>")


def _sets(width: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            sets = [
                shingles.tobytes() for _, raws in batches(part.column(1).to_pylist())
                for shingles in shingle_sets(raws, width)
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sets, pa.binary())], names=["id", "members"])
    return run


def _similar(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, a_members, b_members) whose sets are similar enough."""
    for part in parts:
        hits = []
        for a, b in zip(part.column("a_members"), part.column("b_members")):
            x, y = (np.frombuffer(side.as_buffer(), np.uint64) for side in (a, b))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            hits.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
        yield part.select(["a", "b"]).filter(pa.array(hits, pa.bool_()))


def _matches(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, x: total + x)


def prefix_postings(sets: DataFrame) -> DataFrame:
    """(at, value, id, n_shingles, n_shared): each set's rarest postings, one of which a partner must share."""
    posted = sets.select("id", "n_shingles", F.posexplode("signature").alias("at", "value"))
    shared = posted.groupBy("at", "value").agg(F.count("*").alias("length")).filter("length > 1")
    rarest = Window.partitionBy("id").orderBy("length", "at")
    whole = Window.partitionBy("id")
    return (
        posted.join(shared, ["at", "value"])
        .withColumn("place", F.row_number().over(rarest))
        .withColumn("n_shared", F.count("*").over(whole))
        .filter(F.col("place") <= F.col("n_shared") - (T - 1))
        .select("at", "value", "id", "n_shingles", "n_shared")
    )


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, members) of the documents in ``ids``, members as sorted 64-bit hashes.

    A list of ids that fits is sent to the texts; a longer one meets them in a shuffle.
    """
    wanted = ids.select(F.col("id").alias("doc_id")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return stage(docs.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(width), "id bigint, members binary"))


def _with_members(pairs: DataFrame, full: DataFrame) -> DataFrame:
    return pairs.join(
        full.select(F.col("id").alias("b"), F.col("members").alias("b_members")), "b"
    ).join(full.select(F.col("id").alias("a"), F.col("members").alias("a_members")), "a")


def _links(pairs: DataFrame, sets: DataFrame, full: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that collide often enough and whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("signature").alias("a_signature"))
    right = sets.select(F.col("id").alias("b"), F.col("signature").alias("b_signature"))
    close = (
        pairs.join(right, "b").join(left, "a")
        .filter(_matches(F.col("a_signature"), F.col("b_signature")) >= T).select("a", "b")
    )
    return _with_members(close, full).mapInArrow(_similar, "a bigint, b bigint")


#: a posting list, or the members of one that share a difference from its head: (at, value)
_LIST = ("at", "value")
#: what is known of a member there: ``linked`` with the list's head, ``d`` differences from it, ``place`` of the shared one
_MEMBER = ("id", "component", "n_shingles", "linked", "d", "place")


def _star(entries: DataFrame, by: str) -> DataFrame:
    """Pairs (a, b) of each member with up to ``HEADS`` heads of its lists, those with the largest ``by``.

    The head of a list is its member with the largest ``by``, so sets of one group choose the same few heads.
    """
    heads = stage(entries.groupBy(*_LIST).agg(F.min(F.struct((-F.col(by)).alias("rank"), F.col("id").alias("head"))).alias("best")))
    chosen = entries.join(heads, [*_LIST]).filter(F.col("id") != F.col("best.head")).groupBy("id").agg(
        F.slice(F.array_sort(F.collect_set("best")), 1, HEADS).alias("best"))
    # a head's own heads rank before it, so no pair comes twice
    return chosen.select("id", F.explode("best.head").alias("head")).select(
        F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))


def _placed(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of posting lists with the columns of ``labels``; there is no head yet that they could differ from."""
    return postings.join(labels, "id", "left").withColumns({
        "component": F.coalesce("component", "id"), "at": F.col("at").cast("bigint"), "value": F.col("value").cast("bigint"),
        "linked": F.lit(False), "d": F.lit(0), "place": F.lit(0)})


def _open_lists(members: DataFrame) -> DataFrame:
    """Members of lists with several components, with their list's ``length``, its largest component ``main``, and the
    number of ``pairs`` of different components, of all and (``large_pairs``) of those with ``LARGE`` members there.

    Two sets that are linked with the head are connected: a list without any other is not open.
    """
    held = members.groupBy(*_LIST, "component").agg(F.count("*").alias("held"), F.bool_and("linked").alias("linked"))
    large = F.when(F.col("held") >= LARGE, F.col("held")).otherwise(0)
    lists = held.groupBy(*_LIST).agg(
        F.count("*").alias("parts"), F.sum("held").alias("length"), F.sum(F.col("held") * F.col("held")).alias("within"),
        F.sum(large).alias("large"), F.sum(large * large).alias("large_within"),
        F.bool_and("linked").alias("linked"), F.max(F.struct("held", "component")).alias("top"))
    lists = stage(lists.filter("parts > 1 AND NOT linked").selectExpr(
        *_LIST, "length", "(length * length - within) div 2 AS pairs", "(large * large - large_within) div 2 AS large_pairs",
        "top.component AS main"))
    return members.join(lists, [*_LIST])


def _cross_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of one list whose components differ and that sizes, and differences from the head, allow."""
    x = members.filter("component <> main").select(*_LIST, *[F.col(c).alias(f"x_{c}") for c in _MEMBER])
    y = members.select(*_LIST, "main", *[F.col(c).alias(f"y_{c}") for c in _MEMBER])
    sizes = (F.col("x_n_shingles"), F.col("y_n_shingles"))
    fits = F.least(*sizes) * 100 >= F.greatest(*sizes) * PERCENT
    # two members outside the main component meet twice: once is enough
    once = (F.col("y_component") == F.col("main")) | (F.col("x_id") < F.col("y_id"))
    needed = F.col("x_d") + F.col("y_d") - (sizes[0] + sizes[1]) / 9
    possible = 2 * (F.least(F.col("x_d") - F.col("x_place"), F.col("y_d") - F.col("y_place")) + 1)
    return x.join(y, [*_LIST]).filter(
        (F.col("x_component") != F.col("y_component")) & once & fits & ~(F.col("x_linked") & F.col("y_linked"))
        & (possible >= needed - 1e-6)
    ).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()


def _differences(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, id, sizes, differences): what b has beyond its head a, and what it lacks of it, marked."""
    for part in parts:
        a_sizes, b_sizes, found = [], [], []
        for a, b in zip(part.column("a_members"), part.column("b_members")):
            x, y = (np.frombuffer(side.as_buffer(), np.uint64) for side in (a, b))
            lacking = np.sort(np.setdiff1d(x, y, assume_unique=True) ^ _TIMES[0])
            found.append(np.concatenate((np.setdiff1d(y, x, assume_unique=True), lacking)).view(np.int64))
            a_sizes.append(len(x))
            b_sizes.append(len(y))
        yield pa.RecordBatch.from_arrays([
            part.column("a"), part.column("b"), pa.array(a_sizes, pa.int64()), pa.array(b_sizes, pa.int64()),
            pa.array(found, pa.list_(pa.int64())),
        ], names=["head", "id", "head_size", "size", "differences"])


def _by_differences(members: DataFrame, full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of lists' heads with members linked to them, entries of the members under their differences from the head).

    Sets of sizes n and m are linked if and only if they differ in at most (n + m) / 9 elements. With
    d(x) the number of differences of x from the head, x and y differ in d(x) + d(y) less twice
    the differences they share. Sets linked with the head are connected by it, so one
    of the two, x, has d(x) above (n(x) + n(head)) / 9. Then the shared differences number at least
    0.9 * (d(x) - (n(x) + n(head)) / 9), at least d(x) - n(x) / 4 since m is at most 5/4 n, and
    (d(y) + (n(head) - n(y)) / 9) / 2. All sets order their differences alike, those that the fewest sets share
    first. So only the first few of each need be looked up, and the places of the one found bound how many can follow.

    Entries carry the component of their member. Those under one difference are a list again: members of a large
    group that share it are one component there, and cost no pair.
    """
    # the head is the member of most long lists, then of most links: the lists of a group share it
    listed = members.join(members.groupBy("id").agg(F.count("*").alias("lists")), "id")
    heads = stage(listed.groupBy(*_LIST).agg(
        F.min(F.struct(-F.col("lists"), -F.col("degree"), "id"))["id"].alias("head")))
    family = members.join(heads, [*_LIST]).filter("id <> head").select(
        F.col("head").alias("a"), F.col("id").alias("b"), "component", "degree").distinct()
    apart = _with_members(family.select("a", "b"), full).mapInArrow(
        _differences, "head bigint, id bigint, head_size bigint, size bigint, differences array<bigint>")
    d = F.size("differences")
    each = apart.select(
        "head", "id", "size", d.alias("d"), "differences",
        (d * 9 <= F.col("size") + F.col("head_size")).alias("linked"),
        (d - (F.col("size") + F.col("head_size")) / 9).alias("beyond"),
        ((d + (F.col("head_size") - F.col("size")) / 9) / 2).alias("half"))
    each = stage(each.join(family.select(F.col("a").alias("head"), F.col("b").alias("id"), "component", "degree"), ["head", "id"]))
    own = each.filter("linked").select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b"))
    least = F.greatest(F.ceil(F.when(F.col("linked"), F.col("half")).otherwise(
        F.greatest(F.col("beyond") * 0.9, F.col("d") - F.col("size") / 4)) - 1e-6), F.lit(1))
    known = ("at", "id", "component", "degree", "n_shingles", "linked", "d", "least")
    each = each.withColumns({"at": F.col("head"), "n_shingles": F.col("size"), "least": least.cast("int")})
    every = each.select(*known, F.explode("differences").alias("value"))
    counts = stage(every.groupBy(*_LIST).agg(F.count("*").alias("members")).filter("members > 1"))
    # the rarest first: differences of one member alone take the first places and need no entry
    ranked = every.join(counts, [*_LIST], "left").groupBy(*known).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("members", F.lit(1)).alias("members"), "value"))).alias("differences"))
    looked_up = F.slice("differences", F.lit(1), F.greatest(F.col("d") - F.col("least") + 1, F.lit(0)).cast("int"))
    entries = ranked.select(*known, F.posexplode(looked_up).alias("place", "difference")).filter("difference.members > 1").select(
        *known, F.col("difference.value").alias("value"), (F.col("place") + 1).alias("place"))
    return own, entries


def _remaining_pairs(entries: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components, in one list, among which all links that are left must be.

    Lists with few pairs of different components, in proportion to their members, are compared pair by pair. A list with
    many is cut into the lists of its members' differences from a head. There, numbers of differences rule out nearly all
    pairs of sets that stand alone; only where large groups meet, their lists are cut again with the head of another
    group. What is left after ``DEPTH`` heads is compared pair by pair, too, so no case is left out.
    """
    found = []
    for depth in range(DEPTH + 1):
        members = stage(_open_lists(entries))
        few = F.col("large_pairs" if depth else "pairs") <= F.col("length") * SHORT
        if depth == DEPTH or members.filter(~few).isEmpty():
            found.append(_cross_pairs(members))
            break
        found.append(_cross_pairs(members.filter(few)))
        own, entries = _by_differences(members.filter(~few), full)
        found.append(own)
        entries = stage(entries)
    return reduce(DataFrame.unionAll, found).distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of characters other than space and 0x09-0x0D, A-Z lower-cased; a set holds the
    distinct runs of ``width`` words. Rows whose sets are equal, or have 100 * shared >=
    80 * union, are linked; ``component_id`` is the smallest doc_id reachable and ``kept``
    marks the row that has it. Texts without words, empty or NULL, have n_shingles 0 and stand alone.
    Repeated rows are copies of each other, and rows with one doc_id are one vertex. Other columns are ignored;
    an empty table gives an empty result. A NULL doc_id is kept, alone, with a NULL component.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = stage(signatures(docs, width))
    worded = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # staged, so that the joins below are placed by themselves and a set with very many copies can be split
    classes = stage(worded.groupBy("set_key").agg(F.min("doc_id").alias("id")))
    sets = stage(
        worded.withColumnRenamed("doc_id", "id").join(classes, ["set_key", "id"])
        .dropDuplicates(["id", "set_key"]).select("id", "n_shingles", "set_key", "signature")
    )
    postings = stage(prefix_postings(sets))
    full = full_sets(docs, postings, width)
    links = stage(_links(_star(postings, "n_shared"), sets, full))
    # labels that are equal only within a component are enough to tell which pairs are left
    labels = stage(components(links, rounds=2))
    degrees = links.unionAll(links.select(F.col("b"), F.col("a"))).groupBy(F.col("a").alias("id")).agg(
        F.count("*").alias("degree"))
    entries = _placed(postings, labels.join(degrees, "id")).withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))
    rest = _remaining_pairs(entries, full)
    # rows of one class hang together, and so do rows with one doc_id
    own = worded.select("set_key", F.col("doc_id").alias("b")).join(classes, "set_key").select(F.col("id").alias("a"), "b")
    renamed = own.groupBy("b").agg(F.min("a").alias("low"), F.max("a").alias("high")).filter("low <> high")
    repeated = own.join(renamed.select("b"), "b", "left_semi").select("a", "b")
    merged = components(
        _links(rest, sets, full).unionAll(labels.select(F.col("component").alias("a"), F.col("id").alias("b")))
        .unionAll(repeated))
    named = classes.join(merged, "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    found = signed.join(named, "set_key", "left").withColumn(
        "component_id",
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")))
    return found.select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
