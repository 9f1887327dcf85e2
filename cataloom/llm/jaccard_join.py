"""Exact n-gram Jaccard join with set-relation skipping.

A text's set is its distinct runs of five words (A-Z lower-cased; fewer words: the whole sequence as one; no word: empty).
Two texts link when ``100 * |intersection| >= 75 * |union|``; components are the classes of texts that links connect.

1. *Equal sets* are one node from the start, so copies never meet each other.
2. *Index lists.* Shingles have one global order: common ones last, else by hash. Two linked sets share a shingle among the first
   ``n - ceil(0.75 n) + 1`` of each, so these prefixes are the index. Shingles that one text has are dropped by a count that map
   tasks combine; the rest form lists ``shingle -> (node, size, position)``.
3. *Derived answers.* In a long list every set is compared with one pivot, the set with the most shared shingles. A set that links
   to pivots follows one of them, its leader ``p``, and keeps its difference from it: ``d`` shingles of ``p`` that it lacks, and
   those that it adds. Two followers ``a``, ``b`` share ``|p| - d(a) - d(b)`` shingles, and those that both differences hold.
   With ``key = 7 d + 3 n`` they link for certain if ``key(a) + key(b) <= 7 |p|``: such links are counted from the numbers of
   followers by key, and no pair is formed. The others are decided by their differences alone, in blocks of followers by key;
   pairs of blocks that are certain as a whole are skipped unread.
4. *Skipping.* Other pairs of a list are formed only between followers of different leaders, only if sizes allow a link, and only if
   the positions leave room for the overlap needed: what two sets share before this shingle is in lists of both, so it is at most the smaller
   number of their list entries passed so far (a common shingle that precedes it in one set precedes it in the other, and so is in
   both prefixes); behind it, at most what the shorter rest holds. A pair needs so many common prefix shingles that the rest of
   both sets can supply the missing ones; few pairs pass that.
5. *Verification* compares the whole sets of the two texts.

Common shingles are those found in more than a share ``COMMON`` of the texts. A shingle of that kind is in at least that share
of some block of texts, so each task reports the shingles common in its blocks, and those whose reports add up are broadcast:
``2 * mean set size / COMMON`` numbers at most. The order only steers the work; links do not depend on it.

Shingles and sets are known by 64-bit hashes. Null, empty and wordless texts have size 0 and are their own component. A null doc_id
has no component and links with nothing. Equal rows are one node; rows that share a doc_id are one document of several texts, and so in
one component. The links of a row are counted in other rows with an id, equal ones included.

Bounds: what two blocks of followers hold in one task is ``FOLLOWERS`` rows and ``BYTES`` of differences each (or one difference, if it
is longer). The number of pairs of blocks that cannot be skipped grows with the square of the followers that lie more than a seventh of
the leader's set apart.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.llm.common import aside, keyed, mix, on_key, shingles, texts, U64, words, written

NEED, OF, COMMON, LONG = 3, 7, 0.002, 24  # overlap >= 3/7 of both sizes together is a similarity of 0.75
ROWS, PAIRS = 2048, 512  # texts and pairs whose sets a task holds at once
FOLLOWERS, BYTES = 256, 4 << 20  # rows and bytes of differences of a block, on average
BANDS, COLUMNS = 32, 4096  # blocks by key to a leader's set size; shingles of two blocks that are compared at once


def _slices(batch: pa.RecordBatch, rows: int):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def text_set(text: bytes | None) -> np.ndarray:
    return shingles(words(text))


def _node(found: np.ndarray) -> int:
    """A set's 64-bit name."""
    return int((mix(found).sum(dtype=U64) + U64(len(found))).astype(np.int64)) if len(found) else 0


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the global order."""
    n = len(found)
    length = n - -(-3 * n // 4) + 1
    if len(common):
        at = np.searchsorted(common, found)
        at[at == len(common)] = 0
        late = common[at] == found
        found = np.concatenate([found[~late], found[late]])
    return found[:length]


def sets(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, th, n, node`` of every row, and the common shingles, from one pass.

    Common are those in at least ``COMMON / 2`` of the texts, all in ``COMMON`` or more among them; sorted.
    """
    names = ["doc_id", "th", "n", "node", "shingle"]

    def read(batches):
        for batch in (part for whole in batches for part in _slices(whole, ROWS)):
            found = [text_set(t) for t in texts(batch)]
            nodes = [_node(s) for s in found]
            n = [len(s) for s in found]
            own = [batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, pa.nulls(len(n), pa.int64())], names=names)
            each = dict(zip(nodes, found))
            every, times = np.unique(np.concatenate(list(each.values())), return_counts=True) if each else (np.zeros(0, U64), np.zeros(0))
            many = times >= max(2, COMMON / 2 * batch.num_rows)
            k = int(many.sum())
            blank = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [blank, blank, pa.array(times[many].astype(np.int64)), blank, pa.array(every[many].view(np.int64))], names=names
            )

    found = written(keyed(docs).mapInArrow(read, "doc_id bigint, th bigint, n bigint, node bigint, shingle bigint"), "sets")
    rows = found.where("shingle is null").drop("shingle")
    counted = found.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n"))
    common = counted.where(F.col("n") >= max(2.0, COMMON / 2 * rows.count())).select("shingle").toArrow()
    return rows, np.sort(common.column("shingle").to_numpy().view(U64))


def _entries(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """``shingle, node, n, pos`` of the prefixes of all texts with an id; equal sets of a batch once."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def read(batches):
        for batch in (part for whole in batches for part in _slices(whole, ROWS)):
            found = {_node(s): s for s in map(text_set, texts(batch)) if len(s)}
            firsts = [prefix(s, shared.value) for s in found.values()]
            size = [len(p) for p in firsts]
            if not size:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(firsts).view(np.int64)),
                    pa.array(np.repeat(np.array(list(found), np.int64), size)),
                    pa.array(np.repeat([len(s) for s in found.values()], size).astype(np.int32)),
                    pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in size])),
                ],
                names=["shingle", "node", "n", "pos"],
            )

    with_id = docs.where("doc_id is not null").select("text")
    return with_id.mapInArrow(read, "shingle bigint, node bigint, n int, pos int")


def index_lists(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """The entries of shingles that several sets have, each once, with the length and the pivot of their list, and the number of
    entries of the same set at earlier positions (``passed``)."""
    entries = _entries(docs, common)
    # tables of their own: a join straight above a grouping by the same key cannot be split where a key is hot
    several = written(entries.groupBy("shingle").count().where("count > 1").select(F.col("shingle").alias("s")), "several")
    lists = entries.join(several, F.col("shingle") == F.col("s")).drop("s").distinct()
    # the set with the most shared shingles is the pivot: edits make shingles of their own
    own = Window.partitionBy("node")  # no more rows than the prefix of one text has
    passed = F.row_number().over(own.orderBy("pos")) - 1
    lists = written(lists.select("*", F.count("*").over(own).alias("degree"), passed.alias("passed")), "lists")
    first = F.max(F.struct("degree", "node", "n"))
    head = lists.groupBy("shingle").agg(F.count("*").alias("length"), first.alias("p")).where("length > 1")
    head = head.select(F.col("shingle").alias("s"), "length", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"))
    head = written(head, "heads")
    return written(lists.join(head, F.col("shingle") == F.col("s")).drop("s", "degree"), "lists")


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id, th, z``: compressed texts, for joins that move them."""

    def pack(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = [squeeze.compress(t or b"") for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(z, pa.binary())], names=["doc_id", "th", "z"])

    return keyed(docs).where("doc_id is not null").mapInArrow(pack, "doc_id bigint, th bigint, z binary")


LINKS = "a bigint, b bigint, n bigint, p bigint, d bigint, diff binary"


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, differences: bool = False) -> DataFrame:
    """The pairs ``a, b`` of nodes that link; their sizes ``n, p``; with ``differences``, the number ``d`` of shingles that only b
    has and the hashes ``diff`` that only one of them has, else null."""
    pairs = written(pairs, "pairs")
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    chosen = needed.join(nodes.select("node", "doc_id", "th"), "node").select("node", F.col("doc_id").alias("d"), F.col("th").alias("t"))
    held = _packed(docs).join(chosen, (F.col("doc_id") == F.col("d")) & (F.col("th") == F.col("t"))).select("node", "z")
    held = written(held, "texts")
    both = pairs.join(held.toDF("a", "za"), "a").join(held.toDF("b", "zb"), "b")

    def compare(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for batch in (part for whole in batches for part in _slices(whole, PAIRS)):
            known: dict[int, np.ndarray] = {}
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for name, z in ((a, batch.column("za").to_pylist()), (b, batch.column("zb").to_pylist())):
                for node, packed in zip(name, z):
                    if node not in known:
                        known[node] = text_set(open_.decompress(packed))
            found = []
            for x, y in zip(a, b):
                overlap = len(np.intersect1d(known[x], known[y], assume_unique=True))
                n, p = len(known[x]), len(known[y])
                if OF * overlap >= NEED * (n + p):
                    diff = np.setxor1d(known[x], known[y], assume_unique=True).tobytes() if differences else None
                    found.append((x, y, n, p, p - overlap if differences else None, diff))
            names = ["a", "b", "n", "p", "d", "diff"]
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in found], t) for k, t in enumerate(kinds)], names=names)

    # rows equal in id and text give a pair several times
    return written(both.select("a", "b", "za", "zb").mapInArrow(compare, LINKS).dropDuplicates(["a", "b"]), "links")


def _leaders(star_links: DataFrame) -> DataFrame:
    """``node, lead, n, p, d, diff``: each set that links to pivots, and each pivot of such, under the pivot that most sets link to."""
    links = star_links.select(F.col("a").alias("node"), F.col("b").alias("lead"), "n", "p", "d", "diff")
    pivots = links.groupBy("lead").agg(F.count("*").alias("followers"), F.max("p").alias("p"))
    itself = pivots.select(F.col("lead").alias("node"), "lead", F.col("p").alias("n"), "p", F.lit(0).alias("d"), F.lit(b"").alias("diff"))
    size = written(pivots.select(F.col("lead").alias("pivot"), "followers"), "pivots")
    every = links.unionByName(itself)
    narrow = every.select("node", "lead").join(size, F.col("lead") == F.col("pivot"))
    chosen = narrow.groupBy("node").agg(F.max(F.struct("followers", "lead")).alias("c")).select(F.col("node").alias("k"), F.col("c.lead").alias("l"))
    chosen = written(chosen, "chosen")
    return written(every.join(chosen, (F.col("node") == F.col("k")) & (F.col("lead") == F.col("l"))).drop("k", "l"), "leaders")


def _block_links(rows):
    """``node, links`` of two blocks of followers of one leader (or of one block): links that their keys leave open."""
    size = int(rows["p"].iloc[0])
    left, right = (rows[rows["side"] == k].reset_index(drop=True) for k in (0, 1))
    alone = not len(right)
    right = left if alone else right
    ids = [[np.frombuffer(d, U64) for d in part["diff"]] for part in (left, right)]
    of = [np.repeat(np.arange(len(part)), [len(d) for d in part]) for part in ids]
    flat = [np.concatenate(part) if part else np.zeros(0, U64) for part in ids]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    common = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, len(shared), COLUMNS):
        some = shared[at : at + COLUMNS]
        holds = []
        for hashes, owner, part in zip(flat, of, (left, right)):
            place = np.minimum(np.searchsorted(some, hashes), len(some) - 1)
            hit = some[place] == hashes
            matrix = np.zeros((len(part), len(some)), np.float32)
            matrix[owner[hit], place[hit]] = 1
            holds.append(matrix)
        common += holds[0] @ holds[1].T
    lacking = left["key"].to_numpy()[:, None] + right["key"].to_numpy()[None, :] - OF * size
    linked = (lacking > 0) & (OF * common >= lacking)
    if alone:
        np.fill_diagonal(linked, False)
    out = left[["node"]].assign(links=linked @ right["w"].to_numpy())
    if not alone:
        import pandas as pd

        out = pd.concat([out, right[["node"]].assign(links=left["w"].to_numpy() @ linked)])
    return out[out["links"] > 0]


def _derived(leaders: DataFrame, weights: DataFrame) -> DataFrame:
    """``node, links``: links between followers of one leader, in rows of the other set (``weights``: ``k, w``); several rows a node."""
    members = leaders.join(weights, F.col("node") == F.col("k")).drop("k").withColumn("key", OF * F.col("d") + NEED * F.col("n"))
    members = members.withColumn("band", F.floor(F.col("key") * BANDS / F.col("p")))
    members = written(members, "followers")
    room = OF * F.col("p") - F.col("key")
    # followers by key, and the keys up to which they are asked for, in one order; both at most 10 p rows a leader
    have = members.groupBy("lead", "key").agg(F.sum("w").alias("w"))
    asked = members.select("lead", room.alias("key")).distinct().withColumn("w", F.lit(None).cast("bigint"))
    upto = Window.partitionBy("lead").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    sums = have.unionByName(asked).withColumn("upto", F.coalesce(F.sum("w").over(upto), F.lit(0))).where("w is null")
    sums = written(sums.select(F.col("lead").alias("l"), F.col("key").alias("room"), "upto"), "sums")
    itself = F.when(F.col("key") <= room, F.col("w")).otherwise(0)
    sure = members.join(sums, (F.col("lead") == F.col("l")) & (room == F.col("room"))).select("node", (F.col("upto") - itself).alias("links"))

    blocks = members.groupBy("lead", "band").agg(
        F.max("key").alias("most"), F.max("p").alias("p"),
        F.greatest(F.ceil(F.count("*") / FOLLOWERS), F.ceil(F.sum(F.length("diff")) / BYTES)).alias("cuts"),
    )
    blocks = written(blocks.withColumnsRenamed({"lead": "l", "band": "g"}), "blocks")
    # bands that differ in key, at most 10 x BANDS to a leader
    second = blocks.select(F.col("l").alias("l2"), F.col("g").alias("g2"), F.col("most").alias("most2"), F.col("cuts").alias("cuts2"))
    met = (F.col("l") == F.col("l2")) & (F.col("g") <= F.col("g2")) & (F.col("most") + F.col("most2") > OF * F.col("p"))
    bands = written(blocks.join(second, met).select("l", "g", "cuts", "g2", "cuts2"), "bands")
    spread = lambda n: F.pmod(F.xxhash64("node"), n)
    cell = ["lead", "g", "g2", "s", "s2"]
    held = ["node", "p", "key", "w", "diff"]
    first = members.join(bands, (F.col("lead") == F.col("l")) & (F.col("band") == F.col("g"))).withColumn("s", spread(F.col("cuts")))
    first = first.withColumn("s2", F.explode(F.sequence(F.lit(0), F.col("cuts2") - 1))).where("g < g2 or s <= s2")
    other = members.join(bands, (F.col("lead") == F.col("l")) & (F.col("band") == F.col("g2"))).withColumn("s2", spread(F.col("cuts2")))
    other = other.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).where("g < g2 or s < s2")
    sides = first.select(*cell, *held, F.lit(0).alias("side")).unionByName(other.select(*cell, *held, F.lit(1).alias("side")))
    return sure.unionByName(sides.groupBy(*cell).applyInPandas(_block_links, "node bigint, links bigint"))


def components(links: DataFrame) -> DataFrame:
    """``node, label``: for each node of a link the smallest node that links reach, by hooking and pointer jumping."""
    edges = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        names = labels.toDF("n2", "l2")
        near = edges.join(names, F.col("b") == F.col("n2")).groupBy("a").agg(F.min("l2").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        far = hooked.join(names, F.col("next") == F.col("n2"), "left")
        moved = written(far.select("node", "label", F.coalesce("l2", "next").alias("next")), "labels")
        labels = moved.select("node", F.col("next").alias("label"))
        if moved.where("label <> next").isEmpty():
            return labels


def _links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows ``doc_id, th, n, node``; the links ``a, b`` to pivots; ``node, lead, ...`` of sets that have a leader; all other
    links ``a, b``. Links between followers of one leader are derived from the third (``_derived``)."""
    rows, common = sets(docs)
    full = rows.where("doc_id is not null and n > 0")
    nodes = written(full.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("k")).select("node", "k.doc_id", "k.th"), "nodes")
    lists = index_lists(docs, common)
    fits = lambda m: 4 * F.least("n", m) >= 3 * F.greatest("n", m)
    star = lists.where((F.col("length") > LONG) & (F.col("node") != F.col("pivot")) & fits(F.col("pivot_n")))
    star_links = _verified(star.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), docs, nodes, differences=True)
    leaders = _leaders(star_links)
    own = lists.join(leaders.select(F.col("node").alias("k"), "lead"), F.col("node") == F.col("k"), "left")
    own = written(own.select("shingle", "node", "n", "pos", "passed", F.coalesce("lead", "node").alias("lead")), "lists")
    other = own.toDF("s2", "node2", "n2", "pos2", "passed2", "lead2")
    most = F.least("passed", "passed2") + F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    wanted = F.col("n") + F.col("n2")
    met = own.join(
        other,
        (F.col("shingle") == F.col("s2")) & (F.col("node") < F.col("node2")) & (F.col("lead") != F.col("lead2"))
        & fits(F.col("n2")) & (OF * most >= NEED * wanted),
    )
    shared = met.groupBy("node", "node2").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("n2").alias("n2"))
    # what lies beyond the prefix can supply ceil(3n/4) - 1 of the larger set
    beyond = F.ceil(F.greatest("n", "n2") * 3 / 4) - 1
    enough = shared.where(OF * (F.col("c") + beyond) >= NEED * wanted)
    links = _verified(enough.select(F.col("node").alias("a"), F.col("node2").alias("b")), docs, nodes)
    return rows, star_links.select("a", "b"), leaders, links.select("a", "b")


def _classes(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label``: the class of each set that stands in a row with an id."""
    nodes = rows.where("doc_id is not null and n > 0").select("node").distinct()
    named = nodes.join(components(links).withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left")
    return written(named.select("node", F.coalesce("label", "node").alias("label")), "named")


def link_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row of ``docs``."""
    rows, star_links, leaders, links = _links(docs)
    every = rows.where("doc_id is not null and n > 0")
    weights = written(every.groupBy(F.col("node").alias("k")).agg(F.count("*").alias("w")), "weights")
    across = links.union(links.select("b", "a")).join(weights, F.col("b") == F.col("k")).select(F.col("a").alias("node"), F.col("w").alias("links"))
    equal = weights.where("w > 1").select(F.col("k").alias("node"), (F.col("w") - 1).alias("links"))
    counted = _derived(leaders, weights).unionByName(across).unionByName(equal).groupBy("node").agg(F.sum("links").alias("links"))
    counted = written(counted.where("links > 0").select(F.col("node").alias("counted"), "links"), "counted")
    # texts that share an id are one document
    several = every.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select(F.col("doc_id").alias("d"), "a")
    one = every.select("doc_id", "node").distinct().join(written(several, "several"), F.col("doc_id") == F.col("d"))
    joined = star_links.union(links).union(one.where("node <> a").select("a", F.col("node").alias("b")))
    of_node = _classes(rows, joined).toDF("k", "label")
    full = rows.where("doc_id is not null and n > 0").select("doc_id", "node").distinct()
    of_id = written(full.join(of_node, F.col("node") == F.col("k")).select("doc_id", "label").distinct(), "labels")
    least = written(of_id.groupBy(F.col("label").alias("l")).agg(F.min("doc_id").alias("component")), "least")
    of_id = written(of_id.join(least, F.col("label") == F.col("l")).select(F.col("doc_id").alias("d"), "component"), "components")
    found = rows.join(of_id, F.col("doc_id") == F.col("d"), "left")
    found = found.join(counted, F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("node")) == F.col("counted"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their class, each once: the smallest (doc_id, text hash).

    Every text counts by itself here, so one that shares its id with others goes only with texts like it. Rows without an id
    stay, and those without words; rows equal in id and text are one document, and one of them stays.
    """
    own, _, back = aside(docs, ("doc_id", "text"))
    own = own.withColumn("th", F.xxhash64("text"))
    rows, star_links, _, links = _links(docs.select("doc_id", "text"))
    named = _classes(rows, star_links.union(links))
    keys = rows.where("doc_id is not null and n > 0").select("doc_id", "th", "node").distinct()
    labels = keys.join(named.toDF("k", "label"), F.col("node") == F.col("k"))
    stays = labels.groupBy("label").agg(F.min(F.struct("doc_id", "th")).alias("s")).select("s.doc_id", "s.th", F.lit(True).alias("stays"))
    marks = on_key(written(labels.select("doc_id", "th"), "members"), written(stays, "stays"), "left").where("stays is null")
    left = on_key(own, written(marks.select("doc_id", "th"), "gone"), "leftanti")
    # only rows that stand twice move once more
    twice = written(rows.where("doc_id is not null").groupBy("doc_id", "th").count().where("count > 1").drop("count"), "twice")
    if not twice.isEmpty():
        order = F.xxhash64(*[c for c in left.columns if c not in ("doc_id", "th")])
        nth = F.row_number().over(Window.partitionBy("doc_id", "th").orderBy(order))
        once = on_key(left, twice, "leftsemi").withColumn("nth", nth).where("nth = 1").drop("nth")
        left = on_key(left, twice, "leftanti").unionByName(once)
    return left.select(*back)
