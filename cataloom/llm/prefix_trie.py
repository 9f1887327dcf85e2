"""The prefix trie of rebuilt conversations, by van Emde Boas recursion over depth.

``rebuilt`` gives every conversation the first turns of another one (see there). A *node* is a distinct sequence of first turns; its
name is a digest that stands for the sequence.

1. *Cut.* Sequences are cut at half depth, the halves again, down to blocks of ``BLOCK`` turns. The digest of every block of a
   conversation comes first, digests of twice as long stretches are made of two each, level by level (``_stretches``).
2. *Name cut prefixes.* From the whole depth down, the upper half of a stretch keeps the prefix that the stretch begins with, the lower
   half begins with that prefix and the digest of the upper half (``_cuts``). All stretches of a level are done at once.
3. *Tries and forests.* Within a block a prefix is named by the block's own chain of digests under the name of its cut prefix. So the
   upper trie and the lower forests of all cuts are built side by side, one grouping by name makes the nodes of all of them.
4. *Graft totals upward.* A node is owned by the smallest conversation that passes it; what a conversation owns is the end of its
   sequence, so a subtree's total is the sum, over the conversations that pass its top, of what they own from there on. That is a sum
   within a block, and the totals of the lower stretches grafted on by the same levels, upwards (``_after``).

Nothing is gathered by conversation: a conversation that holds a third of all turns is numbered by range, cut into blocks and
summed by stretches. Groups by name combine in the map tasks, joins on them can be split. A node's list of ended conversations has to
go through one SHA-256, which has no parallel form: the ids are joined to strings of up to 2^CHUNK_BITS ids first, and one task
streams those of a node, one at a time.

Null role or text is empty. Turns are in order of ``turn`` (null first; ties: role, hash of the text; equal rows are turns of their
own). Rows without a conv_id belong to no conversation and are left out. An empty table gives no node, not even a root. ``%`` takes the
sign of the id (as in SQL). Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.llm.common import written
from cataloom.llm.turns import KEYS, cleaned, in_order

#: Turns of a stretch that is not cut any more; a digest has 16 bytes.
BLOCK = 32
#: Conversations come in families of this many, and lend up to ``LENT`` turns.
FAMILY, LENT = 5, 8
CHUNK_BITS = 12
ROW_BITS = 33  # of monotonically_increasing_id below the partition
NO_TURN = b""


def _digest(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, d, digest, bytes, n``: each turn with its place from 1 and the number of turns of its conversation.

    Turns are dealt by range and counted by task, so the place is known without gathering a conversation.
    """
    rows = cleaned(conversations).where("conv_id is not null")
    size = F.octet_length("role").cast("string")
    rows = rows.select(*KEYS, _digest(size, F.lit(":"), F.col("role"), F.col("text")).alias("digest"), F.octet_length("text").alias("bytes"))
    placed = in_order(rows).select(
        "conv_id", "digest", "bytes", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("row"),
    )
    placed = written(placed, "turns")
    # one row for each task that wrote
    sizes = placed.groupBy("part").agg(F.count("*").alias("k"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("ahead"))
    placed = placed.join(F.broadcast(starts), F.col("part") == F.col("p")).withColumn("at", F.col("row") + F.col("ahead"))
    convs = placed.groupBy(F.col("conv_id").alias("c")).agg(F.min("at").alias("begin"), F.count("*").alias("n"))
    convs = written(convs, "conversations")
    found = placed.join(convs, F.col("conv_id") == F.col("c"))
    return found.select("conv_id", (F.col("at") - F.col("begin") + 1).alias("d"), "digest", "bytes", "n")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, d, digest, bytes, last`` of rebuilt conversations, and ``conv_id, length`` of all.

    A conversation c has the first ``h`` turns of conversation ``c - c % FAMILY`` (as many as there are), then its own turns after its
    first ``h``; h is the CRC-32 of its decimal id modulo 9.
    """
    turns = written(numbered(conversations), "places")
    sizes = turns.where("d = 1").select(F.col("conv_id").alias("c"), "n")
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % (LENT + 1)).alias("h")
    own = sizes.select("c", "n", h, (F.col("c") - F.col("c") % FAMILY).alias("base"))
    lenders = sizes.select(F.col("c").alias("b"), F.col("n").alias("base_n"))
    kept = F.least("h", F.coalesce("base_n", F.lit(0)))
    length = kept + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = own.join(lenders, F.col("base") == F.col("b"), "left").select("c", "h", "base", kept.alias("kept"), length.alias("length"))
    convs = written(convs, "families")
    kept_own = turns.join(convs, F.col("conv_id") == F.col("c")).where("d > h")
    kept_own = kept_own.withColumn("d", F.col("kept") + F.col("d") - F.col("h"))
    lent = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("d") <= LENT))
    lent = lent.join(convs, (F.col("conv_id") == F.col("base")) & (F.col("d") <= F.col("kept")))
    columns = [F.col("c").alias("conv_id"), "d", "digest", "bytes", (F.col("d") == F.col("length")).alias("last")]
    return written(kept_own.select(*columns).union(lent.select(*columns)), "rebuilt"), convs.select(F.col("c").alias("conv_id"), "length")


def _blocks(turns: DataFrame) -> DataFrame:
    """``conv_id, b, turns, chain``: the turns of each block in order, and the digests of its prefixes."""
    block = F.floor((F.col("d") - 1) / BLOCK).alias("b")
    gathered = turns.groupBy("conv_id", block).agg(F.array_sort(F.collect_list(F.struct("d", "digest", "bytes", "last"))).alias("turns"))
    chain = F.aggregate(
        "turns", F.array(F.lit(NO_TURN)), lambda done, t: F.concat(done, F.array(_digest(F.element_at(done, -1), t["digest"])))
    )
    return gathered.withColumn("chain", F.slice(chain, F.lit(2), F.size("turns")))


def _stretches(blocks: DataFrame, n_blocks: int) -> list[DataFrame]:
    """``conv_id, s, digest`` of all whole stretches of 1, 2, 4, ... blocks."""
    found = [written(blocks.select("conv_id", F.col("b").alias("s"), F.element_at("chain", -1).alias("digest")), "stretches")]
    while 1 << len(found) < n_blocks:
        half = lambda k: F.max(F.when(F.col("s") % 2 == k, F.col("digest")))
        both = found[-1].groupBy("conv_id", F.floor(F.col("s") / 2).alias("s")).agg(half(0).alias("upper"), half(1).alias("lower"))
        both = both.where("upper is not null and lower is not null")
        found.append(written(both.select("conv_id", "s", _digest(F.col("upper"), F.col("lower")).alias("digest")), "stretches"))
    return found


def _cuts(stretches: list[DataFrame]) -> DataFrame:
    """``conv_id, b, root``: the name of the prefix that ends where block b begins, for every block behind a whole one."""
    heads = stretches[0].where("s = 0").select("conv_id", "s", F.lit(NO_TURN).alias("root"))
    for level in reversed(stretches):
        upper = heads.select("conv_id", (F.col("s") * 2).alias("s"), "root")
        # the upper half is whole: the prefix goes on through it
        through = level.where("s % 2 = 0").select(F.col("conv_id").alias("c"), F.col("s").alias("at"), "digest")
        lower = upper.join(through, (F.col("conv_id") == F.col("c")) & (F.col("s") == F.col("at")))
        lower = lower.select("conv_id", (F.col("s") + 1).alias("s"), _digest(F.col("root"), F.col("digest")).alias("root"))
        heads = written(upper.union(lower), "cuts")
    return heads.where("s > 0").select("conv_id", F.col("s").alias("b"), "root")


def named(turns: DataFrame) -> tuple[DataFrame, int]:
    """``conv_id, d, b, name, parent, bytes, last``: every turn with the names of the prefix it ends and of the one before; the number of blocks."""
    blocks = written(_blocks(turns), "blocks")
    n_blocks = (blocks.agg(F.max("b")).first()[0] or 0) + 1
    full = F.size("turns") == BLOCK
    plain = blocks.withColumns({"root": F.lit(NO_TURN), "next": F.lit(None).cast("binary")})
    if not blocks.where(full).isEmpty():
        # a level above the blocks for every doubling, so that the last cut is named too
        cuts = _cuts(_stretches(blocks.where(full), n_blocks + 1))
        begin, end = cuts.toDF("c", "at", "root"), cuts.toDF("c2", "at2", "next")
        long = blocks.where((F.col("b") > 0) | full)
        long = long.join(begin, (F.col("conv_id") == F.col("c")) & (F.col("b") == F.col("at")), "left")
        long = long.join(end, (F.col("conv_id") == F.col("c2")) & (F.col("b") + 1 == F.col("at2")), "left")
        long = long.select(*blocks.columns, F.coalesce("root", F.lit(NO_TURN)).alias("root"), "next")
        plain = plain.where((F.col("b") == 0) & ~full).union(long)
    # the last prefix of a whole block is a cut, which has its name from above
    names = F.transform("chain", lambda link, i: F.when((i == BLOCK - 1) & F.col("next").isNotNull(), F.col("next")).otherwise(_digest(F.col("root"), link)))
    rows = plain.withColumn("names", names).withColumn("parents", F.slice(F.concat(F.array("root"), "names"), F.lit(1), F.size("turns")))
    rows = rows.select("conv_id", "b", F.explode(F.arrays_zip("turns", "names", "parents")).alias("z"))
    return rows.select("conv_id", "z.turns.d", "b", F.col("z.names").alias("name"), F.col("z.parents").alias("parent"), "z.turns.bytes", "z.turns.last"), n_blocks


TOTALS = ["leaf", "saved"]


def _after(totals: DataFrame, n_blocks: int) -> DataFrame:
    """``conv_id, b, after_*``: what a conversation owns behind block b, grafted on from the lower stretches, level by level."""
    levels = [written(totals, "totals")]
    while 1 << len(levels) < 2 * n_blocks:
        up = levels[-1].groupBy("conv_id", F.floor(F.col("s") / 2).alias("s")).agg(*[F.sum(t).alias(t) for t in TOTALS])
        levels.append(written(up, "totals"))
    after = levels[-1].select(F.col("conv_id").alias("c"), F.col("s").alias("at"), *[F.lit(0).cast("bigint").alias(f"after_{t}") for t in TOTALS])
    for level in reversed(levels[:-1]):
        lower = level.where("s % 2 = 1").select(F.col("conv_id").alias("c2"), F.col("s").alias("at2"), *[F.col(t).alias(f"lower_{t}") for t in TOTALS])
        found = level.select("conv_id", "s").join(after, (F.col("conv_id") == F.col("c")) & (F.floor(F.col("s") / 2) == F.col("at")))
        found = found.drop("c", "at").join(lower, (F.col("conv_id") == F.col("c2")) & (F.col("s") % 2 == 0) & (F.col("s") + 1 == F.col("at2")), "left")
        sums = [(F.col(f"after_{t}") + F.coalesce(f"lower_{t}", F.lit(0))).alias(f"after_{t}") for t in TOTALS]
        after = written(found.select(F.col("conv_id").alias("c"), F.col("s").alias("at"), *sums), "after")
    return after


def _subtree_totals(prefixes: DataFrame, nodes: DataFrame, n_blocks: int) -> DataFrame:
    """``depth, name, leaf, saved``: the sums over each node's subtree."""
    mine = nodes.select(F.col("conv_id").alias("o"), F.col("depth").alias("od"), *TOTALS)
    rows = prefixes.select("conv_id", "d", "b", "name").join(mine, (F.col("conv_id") == F.col("o")) & (F.col("d") == F.col("od")), "left")
    within = Window.partitionBy("conv_id", "b").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "d", "b", "name", *[F.coalesce(t, F.lit(0)).alias(t) for t in TOTALS])
    rows = rows.select("conv_id", "d", "b", "name", *TOTALS, *[F.sum(t).over(within).alias(f"end_{t}") for t in TOTALS])
    if n_blocks > 1:
        rows = written(rows, "owned")
        block_sums = rows.groupBy("conv_id", F.col("b").alias("s")).agg(*[F.sum(t).alias(t) for t in TOTALS])
        after = _after(block_sums, n_blocks)
        rows = rows.join(after, (F.col("conv_id") == F.col("c")) & (F.col("b") == F.col("at")))
        rows = rows.select("d", "name", *[(F.col(f"end_{t}") + F.col(f"after_{t}")).alias(f"end_{t}") for t in TOTALS])
    return rows.groupBy(F.col("d").alias("depth"), "name").agg(*[F.sum(f"end_{t}").alias(t) for t in TOTALS])


def _ends(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """``depth, name, ends_sha256`` of the nodes where conversations end."""
    turnless = convs.where("length = 0").select(F.lit(0).cast("bigint").alias("depth"), F.lit(NO_TURN).alias("name"), "conv_id")
    rows = prefixes.where("last").select(F.col("d").alias("depth"), "name", "conv_id").union(turnless)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = rows.groupBy("depth", "name", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(ids.alias("ids"))

    def digests(batches):
        now, sha = None, None
        names = ["depth", "name", "ends_sha256"]

        def rows_of(out):
            kinds = [pa.int64(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            out = []
            for depth, name, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "name", "ids"))):
                if now == (depth, name):
                    sha.update(b",")
                else:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (depth, name), hashlib.sha256()
                sha.update(text.encode())
            if out:
                yield rows_of(out)
        if now is not None:
            yield rows_of([(*now, sha.hexdigest())])

    dealt = chunks.repartition("depth", "name").sortWithinPartitions("depth", "name", "chunk")
    return dealt.mapInArrow(digests, "depth bigint, name binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``conv_id`` is the smallest conversation that passes the node; with ``depth`` it names the node.
    """
    turns, convs = rebuilt(conversations)
    prefixes, n_blocks = named(turns)
    prefixes = written(prefixes, "prefixes")
    grouped = prefixes.groupBy(F.col("d").alias("depth"), "name").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes")
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(
        F.lit(0).cast("bigint").alias("depth"), F.lit(NO_TURN).alias("name"), "conv_id", "n_convs",
        F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("bytes"),
    )
    nodes = written(grouped.unionByName(root), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("cd"), F.col("parent").alias("cn"))
    children = children.agg(F.count("*").alias("n_children"))
    at = lambda depth, name: (F.col("depth") == F.col(depth)) & (F.col("name") == F.col(name))
    counted = nodes.join(children, at("cd", "cn"), "left").select(
        "depth", "name", "conv_id", "n_convs", "parent", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.col("n_children").isNull().cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    counted = written(counted, "nodes")
    sums = _subtree_totals(prefixes, counted.where("depth > 0"), n_blocks)
    every = counted.agg(*[F.sum(t).alias(t) for t in TOTALS]).select(F.lit(0).cast("bigint").alias("depth"), F.lit(NO_TURN).alias("name"), *TOTALS)
    sums = sums.unionByName(every).select(F.col("depth").alias("sd"), F.col("name").alias("sn"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    ends = _ends(prefixes, convs).select(F.col("depth").alias("ed"), F.col("name").alias("en"), "ends_sha256")
    above = counted.select((F.col("depth") + 1).alias("pd"), F.col("name").alias("pn"), F.col("conv_id").alias("parent_conv_id"))
    found = counted.drop(*TOTALS).join(sums, at("sd", "sn")).join(ends, at("ed", "en"), "left")
    found = found.join(above, (F.col("depth") == F.col("pd")) & (F.col("parent") == F.col("pn")), "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
