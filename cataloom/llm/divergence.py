"""Source divergence audit by chunk factorization.

Which terms set a source apart from its language, and how far the sources of a language are from each other.

1. *Chunks are counted per document.* Documents are taken in blocks of up to ``BLOCK_BYTES``; a block keeps, for each document, the
   distinct white-space chunks and how often they stand in it, as numbers into the block's list of distinct chunks.
2. *Each globally distinct chunk is tokenized once.* The lists, without the counts, are dealt by chunk; a bucket meets every chunk
   in one place, so it is tokenized when first seen.
3. *Terms are joined back* to the blocks: the bucket's answers go back to each block that asked, and a document's terms are the union of
   those of its chunks, so ``The``, ``the`` and ``the,`` in one document are one document and three occurrences.
4. Blocks add up to occurrences and distinct documents by (lang, source, term), dealt by term.

A chunk is in a block's list once however often it stands there, so no bucket is hot, and counts meet by term only after each block has
added its own. A block and bucket is one row: its strings joined by blanks, its numbers as bytes. What the whole vocabulary needs is
never in one place.

Sources are compared by blocks of terms: a task holds TILE x TILE sources and the share of a language's kept terms that falls into its bucket,
and gives its part of the sums. A term that neither tile's sources have adds the same value to a pair each time, so those are only counted.

Terms are runs of ASCII letters and of anything beyond ASCII; only A-Z are lower-cased. All arithmetic is on whole numbers. Null
text, lang and source are read as empty; a document without terms counts for its group; each row is a document, equal rows too. An
empty table gives no row. Very long texts are read in segments. Only ``text, lang, source`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.llm.common import U64, hash_words, segments, texts, written

#: A term in UTF-8: letters of ASCII and all bytes of other characters.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Documents of its language that a kept term is in; what p is scaled to; smoothing; top terms of a group.
LEAST_DOCS, SCALE, SMOOTH, TOP = 10, 1_000_000_000, 2, 10
#: Bytes of text in a block; bytes split at once; sums that a bucket holds before it adds them up.
BLOCK_BYTES, SPLIT_BYTES, HELD = 12 << 20, 4 << 20, 1 << 20
#: Sources of a tile; kept terms of a bucket, on average, for the largest language.
TILE, BUCKET_ROWS = 64, 1 << 16
LARGE = 9_000_000_000  # counts up to here keep SCALE * count within 64 bits

_KINDS = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    """A record batch from Python columns or Arrow arrays, by a DDL schema."""
    fields = [f.split() for f in schema.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def to_bytes(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers as bytes, all low ones first: the high ones are mostly zero and compress to nothing."""
    return np.ascontiguousarray(numbers.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()


def from_bytes(data: bytes, kind: str = "<u4") -> np.ndarray:
    size = np.dtype(kind).itemsize
    parts = np.frombuffer(data, np.uint8).reshape(size, len(data) // size)
    return np.ascontiguousarray(parts.T).reshape(-1).view(kind).astype(np.int64)


def _bucket_of(values: pa.Array, buckets: int) -> np.ndarray:
    """A number below ``buckets`` for each string; none is empty."""
    if not len(values):
        return np.zeros(0, np.int64)
    values = pa.concat_arrays([values])
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8)[: ends[-1]]
    return (hash_words(data, ends[:-1], ends[1:]) % U64(buckets)).astype(np.int64)


def _order(key: np.ndarray) -> np.ndarray:
    """The stable order of some keys from 0 on; keys and places are sorted as one number where they fit."""
    bits = max(1, len(key)).bit_length()
    if int(key.max(initial=0)).bit_length() + bits > 62:
        return np.argsort(key, kind="stable")
    return np.sort((key << bits) | np.arange(len(key))) & ((1 << bits) - 1)


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each bucket, in order."""
    order = _order(bucket)
    first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    yield from zip(bucket[order][first].tolist(), np.split(order, first[1:]))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each group of the given sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(_starts(sizes), sizes)


def _joined(values: pa.Array, sizes: list[int]) -> pa.Array:
    """Runs of strings, each joined by blanks."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values), " ")


def _split(parts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The chunks of texts, and the text of each."""
    lists = pc.ascii_split_whitespace(pa.array(parts, pa.binary()).view(pa.string()))
    chunks, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(chunks), 0)
    return chunks.filter(full), owner[full.to_numpy(zero_copy_only=False)]


def chunk_counts(found: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct chunks of some documents, and document, chunk and count of every pair that occurs."""
    lists, docs, ids, counts, seen = [], [], [], [], 0
    held, owners, size = [], [], 0

    def flush():
        nonlocal seen, size
        chunks, owner = _split(held)
        if len(chunks):
            coded = chunks.dictionary_encode()
            wide = len(coded.dictionary)
            pair, n = np.unique(np.array(owners)[owner] * wide + coded.indices.to_numpy(), return_counts=True)
            lists.append(coded.dictionary)
            docs.append(pair // wide)
            ids.append(pair % wide + seen)
            counts.append(n)
            seen += wide
        held.clear()
        owners.clear()
        size = 0

    for doc, text in enumerate(found):
        for part in segments(text):
            if held and size + len(part) > SPLIT_BYTES:
                flush()
            held.append(part)
            owners.append(doc)
            size += len(part)
    if held:
        flush()
    if not lists:
        return pa.array([], pa.string()), *(np.zeros(0, np.int64) for _ in range(3))
    coded = pa.concat_arrays(lists).dictionary_encode()
    doc, chunk, n = np.concatenate(docs), coded.indices.to_numpy()[np.concatenate(ids)].astype(np.int64), np.concatenate(counts)
    # a long document stands in several parts, with the same chunks
    wide = len(coded.dictionary)
    pair = doc * wide + chunk
    if len(lists) > 1:
        order = _order(pair)
        first = np.flatnonzero(np.diff(pair[order], prepend=-1))
        pair, n = pair[order][first], np.add.reduceat(n[order], first)
    return coded.dictionary, pair // wide, pair % wide, n


_COUNTED = "block bigint, bucket bigint, first bigint, chunks string, langs array<string>, sources array<string>, sizes binary, ids binary, counts binary"


def count_chunks(docs: DataFrame, buckets: int) -> DataFrame:
    """Per block a row with its documents (bucket -1: group and number of pairs of each, chunk and count of each pair), and a row for
    each bucket with the block's distinct chunks that fall into it; ``first`` is the place of the first one in the block's list.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])

    def block_rows(block: int, found: list[bytes], groups: list[tuple[str, str]]):
        chunks, doc, ids, n = chunk_counts(found)
        dealt = list(_dealt(_bucket_of(chunks, buckets)))
        order = np.concatenate([at for _, at in dealt]) if dealt else np.zeros(0, np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        about = [[[g[k] for g in groups]] for k in (0, 1)]
        numbers = [[to_bytes(np.bincount(doc, minlength=len(found)))], [to_bytes(place[ids])], [to_bytes(n, "<u8")]]
        yield _batch(_COUNTED, [[block], [-1], [None], [None], *about, *numbers])
        if dealt:
            sizes, none = [len(at) for _, at in dealt], [None] * len(dealt)
            joined = _joined(chunks.take(pa.array(order)), sizes)
            yield _batch(_COUNTED, [[block] * len(dealt), [b for b, _ in dealt], _starts(np.array(sizes)), joined, none, none, none, none, none])

    def read(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            found, groups = texts(batch), list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            if not found:
                continue
            ends = np.cumsum([len(t) for t in found])
            parts = max(1, -(-int(ends[-1]) // BLOCK_BYTES))
            cuts = np.unique([0, *np.searchsorted(ends, [ends[-1] * k // parts for k in range(1, parts)]), len(found)])
            for a, b in zip(cuts, cuts[1:]):
                block += 1
                yield from block_rows(block, found[a:b], groups[a:b])

    return rows.mapInArrow(read, _COUNTED)


_ANSWERS = "block bigint, bucket bigint, first bigint, terms string, sizes binary"


def tokenize(chunk: bytes) -> list[bytes]:
    return TERM.findall(chunk.lower())


def _runs(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket, some at a time."""
    bucket, size = batch.column("bucket").to_numpy(), pc.binary_length(batch.column("chunks")).to_numpy()
    at, held = 0, 0
    for k in range(batch.num_rows):
        if k > at and (bucket[k] != bucket[at] or held > most):
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += int(size[k])
    if batch.num_rows:
        yield batch.slice(at)


def _answer(batches):
    """The terms of the chunks of each row; rows come by bucket, a chunk that was seen in its bucket is not tokenized again."""
    now, known = None, {}
    for batch in batches:
        for rows in _runs(batch):
            if (bucket := rows.column("bucket")[0].as_py()) != now:
                now, known = bucket, {}
            lists = pc.split_pattern(rows.column("chunks"), " ")
            coded = lists.flatten().dictionary_encode()
            distinct = coded.dictionary.cast(pa.binary()).to_pylist()
            for chunk in distinct:
                if chunk not in known:
                    known[chunk] = tokenize(chunk)
            found = [known[chunk] for chunk in distinct]
            has = np.array([len(f) for f in found], np.int64)
            terms = pa.array([t for f in found for t in f], pa.binary()).view(pa.string())
            ids = coded.indices.to_numpy()
            sizes = has[ids]
            terms = terms.take(pa.array(np.repeat(_starts(has)[ids], sizes) + _within(sizes)))
            chunks = np.cumsum(pc.list_value_length(lists).to_numpy())[:-1]
            parts = np.split(sizes, chunks)
            yield _batch(
                _ANSWERS,
                [*(rows.column(c) for c in ("block", "bucket", "first")), _joined(terms, [int(p.sum()) for p in parts]), [to_bytes(p) for p in parts]],
            )


_SUMS = "bucket bigint, langs array<string>, sources array<string>, terms string, owner binary, term binary, n binary, docs binary"


def _block_sums(about: dict, places: list[np.ndarray], terms: list[pa.Array], buckets: int) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by group and term of one block, dealt by term."""
    names = sorted(set(zip(about["langs"], about["sources"])))
    number = {g: k for k, g in enumerate(names)}
    owner = np.array([number[g] for g in zip(about["langs"], about["sources"])], np.int64)
    place = np.concatenate(places)
    coded = pa.concat_arrays(terms).dictionary_encode()
    ids, n, pairs = from_bytes(about["ids"]), from_bytes(about["counts"], "<u8"), from_bytes(about["sizes"])
    doc = np.repeat(np.arange(len(owner)), pairs)
    # the terms of each place of the block's list, one after the other
    of_place, has = coded.indices.to_numpy()[_order(place)].astype(np.int64), np.bincount(place, minlength=int(ids.max()) + 1)
    many = has[ids]
    term, doc, n = of_place[np.repeat(_starts(has)[ids], many) + _within(many)], np.repeat(doc, many), np.repeat(n, many)
    if not len(term):
        return
    wide = len(coded.dictionary)
    key = doc * wide + term
    order = _order(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))  # several chunks of a document with one term: one document
    n, key = np.add.reduceat(n, first), key[first]
    key = owner[key // wide] * wide + key % wide
    order = _order(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    groups, term, n, docs = key[first] // wide, key[first] % wide, np.add.reduceat(n, first), np.diff(first, append=len(key))
    langs, sources = [g[0] for g in names], [g[1] for g in names]
    for bucket, at in _dealt(_bucket_of(coded.dictionary, buckets)[term]):
        some, place = np.unique(term[at], return_inverse=True)
        joined = _joined(coded.dictionary.take(pa.array(some)), [len(some)])
        numbers = [[to_bytes(groups[at])], [to_bytes(place)], [to_bytes(n[at], "<u8")], [to_bytes(docs[at])]]
        yield _batch(_SUMS, [[bucket], [langs], [sources], joined, *numbers])


def _join_back(buckets: int):
    def read(batches):
        about, places, terms = None, [], []

        def done():
            if places:
                yield from _block_sums(about, places, terms, buckets)
            places.clear()
            terms.clear()

        for batch in batches:
            for k, bucket in enumerate(batch.column("bucket").to_pylist()):
                row = batch.slice(k, 1)
                sizes = from_bytes(row.column("sizes")[0].as_py())
                if bucket < 0:
                    yield from done()
                    about = {c: row.column(c)[0].as_py() for c in ("langs", "sources", "sizes", "ids", "counts")}
                elif sizes.sum():
                    places.append(np.repeat(row.column("first")[0].as_py() + np.arange(len(sizes)), sizes))
                    terms.append(pc.split_pattern(row.column("terms"), " ").flatten())
        yield from done()

    return read


_KEPT = "lang string, source string, term string, n bigint, lang_n bigint"


def _kept(batches):
    """The sums of each bucket; of them, the terms that enough documents of a language have."""
    keys = ["lang", "source", "term"]

    def added(tables):
        every = pa.concat_tables(tables).combine_chunks()
        return every.group_by(keys).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns([*keys, "n", "docs"])

    def done(tables):
        if not tables:
            return
        every = added(tables)
        whole = every.group_by(["lang", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        whole = whole.filter(pc.greater_equal(whole.column("docs_sum"), LEAST_DOCS)).select(["lang", "term", "n_sum"])
        found = every.drop_columns(["docs"]).join(whole, ["lang", "term"], join_type="inner").rename_columns([*keys, "n", "lang_n"])
        yield from found.combine_chunks().to_batches()

    now, held, size = None, [], 0
    for batch in batches:
        for k, bucket in enumerate(batch.column("bucket").to_pylist()):
            if bucket != now:
                yield from done(held)
                now, held, size = bucket, [], 0
            row = batch.slice(k, 1)
            owner, term, docs = (from_bytes(row.column(c)[0].as_py()) for c in ("owner", "term", "docs"))
            table = {c: row.column(f"{c}s")[0].values.take(pa.array(owner)) for c in ("lang", "source")}
            table["term"] = pc.split_pattern(row.column("terms"), " ").flatten().take(pa.array(term))
            held.append(pa.table(table | {"n": from_bytes(row.column("n")[0].as_py(), "<u8"), "docs": docs}))
            size += len(docs)
            if size > HELD:
                held = [added(held)]
                size = held[0].num_rows // 2  # so that large buckets are not added up for each row
    yield from done(held)


def count_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lang, source, term, n, lang_n`` of the kept terms that occur in a group, and the ``lang, source`` of every group."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = written(count_chunks(docs, buckets), "chunks", compression="zstd")
    about = counted.where("bucket < 0")
    asked = counted.where("bucket >= 0").select("block", "bucket", "first", "chunks")
    answers = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer, _ANSWERS)
    both = answers.unionByName(about.select("block", "bucket", "langs", "sources", "sizes", "ids", "counts"), allowMissingColumns=True)
    sums = both.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(_join_back(buckets), _SUMS)
    kept = sums.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_kept, _KEPT)
    groups = about.select(F.explode(F.arrays_zip("langs", "sources")).alias("g")).select("g.langs", "g.sources").distinct().toDF("lang", "source")
    return written(kept, "kept"), written(groups, "groups")


def _p(n: str, total: str, v: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 v)), exact beyond 64 bits too; null where the language keeps no term."""
    below = F.nullif(F.col(total) + SMOOTH * F.col(v), F.lit(0))
    small = F.call_function("div", F.lit(SCALE).cast("bigint") * (F.col(n) + SMOOTH), below)
    large = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (F.col(n) + SMOOTH).cast("decimal(20,0)"), below.cast("decimal(20,0)"))
    return F.when(F.col(n) < LARGE, small).otherwise(large) + 1


def _f(p: str, q: str) -> Column:
    gap = F.col(p) - F.col(q)
    return F.call_function("div", gap * gap, F.col(p) + F.col(q))


def described(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each group: ``lang, source, total, v, lang_total, place`` (among the sources of its language) and ``p0`` of an absent term."""
    kept = rows.select(F.col("lang").alias("l"), "term", "lang_n").distinct().groupBy("l")
    langs = kept.agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    sums = rows.groupBy(F.col("lang").alias("l2"), F.col("source").alias("s")).agg(F.sum("n").alias("total"))
    found = groups.join(langs, F.col("lang") == F.col("l"), "left")
    found = found.join(sums, (F.col("lang") == F.col("l2")) & (F.col("source") == F.col("s")), "left")
    found = found.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_total")], F.lit(0).alias("nothing"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # one narrow row for each source
    return written(found.select("*", place.cast("bigint").alias("place"), _p("nothing", "total", "v").alias("p0")).drop("nothing"), "described")


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = rows.withColumn("rank", F.row_number().over(order))
    return found if most is None else found.where(F.col("rank") <= most)


def top_terms(rows: DataFrame, about: DataFrame) -> DataFrame:
    """``lang, source, item, value, rank``: the terms that a group has more of than its language, by divergence."""
    found = rows.join(about, ["lang", "source"]).withColumns({"p": _p("n", "total", "v"), "q": _p("lang_n", "lang_total", "v")})
    return _ranked(found.where("p > q").select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value")), TOP)


def _pair_sums(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of f over the bucket's terms for each pair of sources of two tiles, and how many terms those are."""
    lang, a, b = (key[i].as_py() for i in range(3))
    place, p0 = right.column("place").to_numpy(), right.column("p0").to_numpy()
    term = left.column("term").combine_chunks().dictionary_encode()
    col, row, p = term.indices.to_numpy(), left.column("place").to_numpy(), left.column("p").to_numpy()
    out: list[np.ndarray] = []
    mine, other = place[place // TILE == a], place[place // TILE == b]
    zero = dict(zip(place.tolist(), p0.tolist()))
    line = {s: np.full(len(term.dictionary), z, np.int64) for s, z in zero.items()}
    order = np.argsort(row, kind="stable")
    for s, at in zip(*(lambda u, i: (u.tolist(), np.split(order, i[1:])))(*np.unique(row[order], return_index=True))):
        line[s][col[at]] = p[at]
    for s in mine.tolist():
        for r in other.tolist():
            if a != b or s < r:
                gap = line[s] - line[r]
                out.append((s, r, int((gap * gap // (line[s] + line[r])).sum())))
    k = len(out)
    s, r, total = (np.array(c, np.int64) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"lang": pa.array([lang] * k, pa.string()), "s": s, "r": r, "total": total, "terms": np.full(k, len(term.dictionary), np.int64)})


def pair_values(rows: DataFrame, about: DataFrame) -> DataFrame:
    """``lang, source, item, value, rank``: every other source of the language, by divergence."""
    found = rows.join(about, ["lang", "source"]).select("lang", "place", "term", _p("n", "total", "v").alias("p"))
    buckets = max(1, rows.count() // BUCKET_ROWS)
    tiles = about.groupBy(F.col("lang").alias("l")).agg((F.floor(F.max("place") / TILE) + 1).alias("tiles"))
    tile = F.floor(F.col("place") / TILE)
    # a source meets its own tile and every other one, as the first or the second of the two
    partner = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))
    meet = lambda df: df.join(tiles, F.col("lang") == F.col("l")).withColumn("with", partner).withColumns(
        {"a": F.least(tile, "with"), "b": F.greatest(tile, "with")}
    )
    left = meet(found).select("lang", "a", "b", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"), "place", "term", "p")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))).alias("bucket")
    right = meet(about).select("lang", "a", "b", every, "place", "p0")
    keys = ["lang", "a", "b", "bucket"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own, as both come from `about`
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_pair_sums, "lang string, s bigint, r bigint, total bigint, terms bigint")
    sums = written(sums.groupBy("lang", "s", "r").agg(F.sum("total").alias("total"), F.sum("terms").alias("terms")), "pairs")
    one = lambda k: about.select(F.col("lang").alias(f"l{k}"), F.col("place").alias(f"place{k}"), F.col("source").alias(f"source{k}"), F.col("p0").alias(f"p{k}"), F.col("v").alias(f"v{k}"))
    both = sums.join(one(1), (F.col("lang") == F.col("l1")) & (F.col("s") == F.col("place1")))
    both = both.join(one(2), (F.col("lang") == F.col("l2")) & (F.col("r") == F.col("place2")))
    both = both.withColumn("value", F.coalesce(F.col("total") + (F.col("v1") - F.col("terms")) * _f("p1", "p2"), F.lit(0)))
    shown = lambda mine, other: both.select("lang", F.col(mine).alias("source"), F.col(other).alias("item"), "value")
    return _ranked(shown("source1", "source2").unionByName(shown("source2", "source1")))


def audit(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: parts ``pair`` (all other sources) and ``term`` (the top ``TOP``) of each group."""
    rows, groups = count_terms(docs)
    about = described(rows, groups)
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shown(pair_values(rows, about), "pair").unionByName(shown(top_terms(rows, about), "term"))
