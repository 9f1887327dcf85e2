"""Collision-free target names, equal to copying the files one by one.

In ``scan_seq`` order each file takes its own name or, where that is taken,
the first free one of ``name_1.ext``, ``name_2.ext``, ... Names at the
destination and names given out earlier both count as taken.

How that becomes a Spark job
----------------------------
* All files that ask for one name form a queue. A file's place in its queue
  (``rank``, from 0) is a distributed running count, in slices of
  ``2**slice_bits`` consecutive ``scan_seq`` values.
* As long as nobody else asks for ``name_k.ext``, the suffix *is* the rank, or
  rank + 1 where the name exists at the destination.
* Only where ``name.ext`` overflows and some ``name_k.ext`` is also asked for,
  or exists, does the order of events matter. Then ``_settle`` plays them out,
  from small records: the length of the queue of ``name.ext`` and, for each
  ``name_k.ext``, how many files had queued for ``name.ext`` before the first
  one that wants ``name_k.ext``. Consecutive numbers with equal values are
  folded into one run first, so neither many files with one name nor long rows
  of numbered names make the records many.
* ``_settle`` answers with ranges of ranks and what to add to them, cut into
  tiles of ``2**TILE_BITS`` ranks, and with ranges of numbers given away. Spark turns
  both back into rows; handing them to the files is an equi join without hot
  keys.
* A family of names with more than ``2**FAMILY_BITS`` records is not settled by
  one task. A run of numbers maps ``s``, the numbers passed over before it, to
  ``max(s, min(s + length, d))``. The runs among ``2**ISLAND_BITS`` numbers are
  composed into one such map with more corners, all groups at once; one stream
  of narrow rows, the corners, carries ``s`` from group to group; then every
  group is settled by itself. A name that may lose itself to the overflow of its
  parent waits for it, so there is one such pass for each level of numbering.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.functions.names import raw_extension, stem
from cataloom.session import materialise

NAME = ["category", "filename"]
SLICE_BITS = 20
TILE_BITS = 12
ISLAND_BITS = 16
FAMILY_BITS = 16
_NUMBERS = r"((?:_[1-9][0-9]{0,17})+)\z"
_NUMBERED_LOOK = r"_[1-9][0-9]{0,17}(\.[^.]*)?\z"
_NUMBERED = r"(?s)^(.*)_([1-9][0-9]{0,17})\z"

_ANSWERS = (
    "category string, filename string, tile long, "
    "pieces array<struct<first:long,last:long,add:long>>, lost_from long, lost_until long, lost_n long"
)
_GROUP = ["category", "parent", "slice"]
_CORNERS = "category string, parent string, slice long, start_k long, x long, y long"
_STARTS = "category string, parent string, slice long, s long, place long, next_k long"
_OUTCOMES = (
    "category string, filename string, first long, last long, add long, lost_from long, lost_until long, lost_n long"
)


def numbered(filename: Column, suffix: Column) -> Column:
    """``name_<suffix>.ext``, or the name itself for suffix 0."""
    return F.when(suffix == 0, filename).otherwise(
        F.concat(stem(filename), F.lit("_"), suffix.cast("string"), raw_extension(filename))
    )


def _with_parent(names: DataFrame) -> DataFrame:
    """Add ``parent`` and ``k`` where the name reads as number ``k`` of another name."""
    base = F.regexp_extract(stem(F.col("filename")), _NUMBERED, 1)
    k = F.regexp_extract(stem(F.col("filename")), _NUMBERED, 2)
    parent = F.concat(base, raw_extension(F.col("filename")))
    # "_1.txt" is not a numbered ".txt": that name has no extension, so its numbers go elsewhere
    real = (base != "") & (stem(parent) == base)
    return names.withColumns(
        {"parent": F.when(real, parent), "k": F.when(real, k.try_cast("long"))}
    )


def _family(filename: Column) -> Column:
    """A key shared by a name and all names numbered from it."""
    return F.concat(
        F.regexp_replace(stem(filename), r"(_[1-9][0-9]{0,17})+\z", ""), F.lit("/"), raw_extension(filename)
    )


def _queue_lengths(rows: DataFrame, taken: DataFrame | None) -> DataFrame:
    """One row per name: files that ask for it, the first of them, and whether it exists already."""
    asked = rows.select(
        *NAME, F.lit(1).cast("long").alias("n"), F.col("scan_seq").alias("first_seq"), F.lit(False).alias("taken")
    )
    if taken is not None:
        asked = asked.unionAll(
            taken.select(*NAME, F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(True))
        )
    return asked.groupBy(*NAME).agg(
        F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"), F.max("taken").alias("taken")
    )


def _contests(names: DataFrame) -> DataFrame:
    """Numbered names whose parent may overflow into them.

    A parent can overflow if it is asked for twice, exists already, or looks
    as if it could lose its own name to the overflow of *its* parent.
    """
    numbered_look = F.col("filename").rlike(_NUMBERED_LOOK)
    parents = names.where((F.col("n") > 0) & ((F.col("n") > 1) | F.col("taken") | numbered_look)).select(
        "category",
        F.col("filename").alias("parent"),
        F.struct("n", "taken").alias("parent_queue"),
    )
    # the cheap test first: most names are no numbered ones
    return _with_parent(names.where(numbered_look)).join(parents, ["category", "parent"])


def _ranked(rows: DataFrame, slice_bits: int, marks: DataFrame | None = None) -> DataFrame:
    """``ahead``: how many files are further ahead in the same queue.

    ``marks`` take a place in a queue without being counted; they tell how
    many files had queued at that moment. Every queue is counted in slices of
    ``2**slice_bits`` consecutive ``scan_seq`` values, files and marks alike, so
    that a task holds one slice of a hot name at most. Rows move once, by name
    and slice; the counts per slice are narrow and find them in place.
    """
    part = F.shiftright("scan_seq", slice_bits)
    events = rows.select(*NAME, "scan_seq", F.lit(1).alias("weight"), F.struct("*").alias("row"))
    if marks is not None:
        events = events.unionByName(
            marks.select(
                "category",
                F.col("parent").alias("filename"),
                F.col("first_seq").alias("scan_seq"),
                F.lit(0).alias("weight"),
                F.col("filename").alias("mark"),
            ),
            allowMissingColumns=True,
        )
    events = events.withColumn("slice", part)
    keys = [*NAME, "slice"]
    earlier = Window.partitionBy(*NAME).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # marks are counted too, as 0: one may stand in a slice without files
    starts = (
        events.groupBy(*keys)
        .agg(F.sum("weight").alias("n"))
        .select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    )
    here = Window.partitionBy(*keys).orderBy("scan_seq").rowsBetween(Window.unboundedPreceding, -1)
    columns = [*NAME, "row"] if marks is None else [*NAME, "row", "mark"]
    placed = events.withColumn("inside", F.coalesce(F.sum("weight").over(here), F.lit(0))).join(starts, keys)
    return placed.select(*columns, (F.col("inside") + F.col("start")).cast("long").alias("ahead"))


def _runs(contests: DataFrame, ranked: DataFrame, island_bits: int) -> DataFrame:
    """Numbered names, runs of equals folded; windows are cut so that none grows with the queue."""
    ahead = ranked.where("mark is not null").select("category", F.col("mark").alias("filename"), "ahead")
    alike = ["category", "parent", "slice", "n", "taken", "ahead"]
    order = F.row_number().over(Window.partitionBy(*alike).orderBy("k"))
    return (
        contests.join(ahead, NAME, "left")
        .withColumn("slice", F.shiftright("k", island_bits))
        .withColumn("run", F.col("k") - order)
        .groupBy(*alike, "run")
        .agg(F.min("k").alias("k"), F.max("k").alias("until"))
    )


def _records(contests: DataFrame, ranked: DataFrame, island_bits: int) -> DataFrame:
    """Queues that may overflow (with a name) and runs of their numbers (without one)."""
    queues = contests.select(
        "category", F.col("parent").alias("filename"), F.col("parent_queue.n"), F.col("parent_queue.taken")
    ).distinct()
    runs = _runs(contests, ranked, island_bits).select(*_GROUP, "k", "until", "n", "taken", "ahead")
    return (
        _with_parent(queues)
        .unionByName(runs, allowMissingColumns=True)
        .select("category", "filename", "parent", "slice", "k", "until", "n", "taken", "ahead")
        .withColumn("family", _family(F.coalesce("filename", "parent")))
    )


def _ranges(n: int, own: bool, skips: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Ranges of ranks with what each adds: ``skips`` is (overflow place, numbers passed over)."""
    out, start, add = [], 0, 0
    if own:
        out.append((0, 0, 0))
        start = 1
    else:
        add = 1
    for place, passed in skips:
        rank = place - 1 + own  # overflow places count from 1
        if rank > start:
            out.append((start, rank - 1, add))
            start = rank
        add += passed
    if start < n:
        out.append((start, n - 1, add))
    return out


def _walk(overflow: int, own: bool, runs: list[tuple], s: int = 0) -> tuple[list, list]:
    """Numbers passed over and numbers taken away from their own first file.

    Overflowing files walk the numbers upwards. ``s`` numbers have been passed
    over so far, so number ``k`` meets overflow place ``k - s``. That file
    takes the number unless it exists or somebody asked for it earlier.
    """
    skips, lost = [], []
    for k, until, n, taken, ahead in sorted(runs):
        place = k - s
        earlier = 0 if taken else max(ahead - own, 0)  # overflow places before the number's first file
        won = max(0, min(earlier - place + 1, until - k + 1, overflow - place + 1))
        if won and lost and lost[-1][1] == k - 1 and lost[-1][2] == n:
            lost[-1] = (lost[-1][0], k + won - 1, n)
        elif won:
            lost.append((k, k + won - 1, n))
        place += won
        if place > overflow:
            break
        passed = until - k + 1 - won
        if passed and skips and skips[-1][0] == place:
            skips[-1] = (place, skips[-1][1] + passed)
        elif passed:
            skips.append((place, passed))
        s += passed
    return skips, lost


def _chunks(category: str, name: str, start: int, end: int, n: int) -> list[tuple]:
    """Numbers ``start`` to ``end`` as answer rows that each stand for a bounded number of names."""
    size = 1 << ISLAND_BITS
    return [
        (category, name, None, None, low, min(low + size - 1, end), n) for low in range(start, end + 1, size)
    ]


def _settle(records: pd.DataFrame) -> pd.DataFrame:
    """Play out the contests of one family of names, from short names to long ones."""
    queues: dict[str, tuple[int, bool]] = {}
    own_number: dict[str, dict[int, str]] = {}
    runs: dict[str, list[tuple]] = {}
    for name, parent, k, until, n, taken, ahead in zip(
        records["filename"], records["parent"], records["k"], records["until"],
        records["n"], records["taken"], records["ahead"],
    ):
        if name is None:
            runs.setdefault(parent, []).append((int(k), int(until), int(n), bool(taken), 0 if taken else int(ahead)))
        else:
            queues[name] = (int(n), bool(taken))
            if parent is not None:
                own_number.setdefault(parent, {})[int(k)] = name

    category = records["category"].iloc[0]
    given_away: set[str] = set()
    rows = []
    for name in sorted(queues, key=len):
        n, taken = queues[name]
        own = not taken and name not in given_away
        skips, lost = _walk(n - own, own, runs.get(name, []))
        tiles: dict[int, list[dict]] = {}
        for first, last, add in _ranges(n, own, skips):
            for tile in range(first >> TILE_BITS, (last >> TILE_BITS) + 1):
                low, high = max(first, tile << TILE_BITS), min(last, ((tile + 1) << TILE_BITS) - 1)
                tiles.setdefault(tile, []).append({"first": low, "last": high, "add": add})
        rows.extend((category, name, tile, pieces, None, None, None) for tile, pieces in tiles.items())
        for start, end, lost_n in lost:
            # numbers with an overflowing queue of their own are settled in their turn
            queued = own_number.get(name, {})
            for k in sorted(k for k in queued if start <= k <= end):
                given_away.add(queued[k])
                rows.extend(_chunks(category, name, start, k - 1, lost_n))
                start = k + 1
            rows.extend(_chunks(category, name, start, end, lost_n))
    out = pd.DataFrame(
        rows, columns=["category", "filename", "tile", "pieces", "lost_from", "lost_until", "lost_n"]
    )
    return out.astype({c: "Int64" for c in ("tile", "lost_from", "lost_until", "lost_n")})


def _mapped(corners: tuple[np.ndarray, np.ndarray], s: np.ndarray) -> np.ndarray:
    """``s`` behind a map given by its corners; between them and beyond it rises by 0 or 1."""
    x, y = corners
    i = np.searchsorted(x, s, "right") - 1
    rising = np.where(i < 0, y[0] - (x[0] - s), y[i] + (s - x[i]))
    return np.where(i + 1 < len(x), np.minimum(rising, y[np.minimum(i + 1, len(x) - 1)]), rising)


def _after(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The corners of map ``two`` after map ``one``."""
    (x, y), wanted = one, two[0]
    i = np.searchsorted(y, wanted, "left")
    near = np.minimum(i, len(x) - 1)
    x = np.union1d(x, x[near] + (wanted - y[near]))
    y = _mapped(two, _mapped(one, x))
    flat = np.concatenate([[False], np.diff(y) == 0, [False]])
    turn = flat[1:] != flat[:-1]
    return (x[turn], y[turn]) if turn.any() else (x[:1], y[:1])


def _compose(runs: pd.DataFrame) -> pd.DataFrame:
    """What one group of numbers does to ``s``, for every ``s`` there can be before it."""
    runs = runs.sort_values("k")
    start, own, overflow = int(runs["k"].iloc[0]), int(runs["own"].iloc[0]), int(runs["overflow"].iloc[0])
    earlier = np.where(runs["taken"], 0, np.maximum(runs["ahead"] - own, 0))
    d = (runs["until"] - np.minimum(earlier, overflow)).to_numpy(np.int64)
    length = (runs["until"] - runs["k"] + 1).to_numpy(np.int64)
    maps = [(np.array([high - n, high]), np.array([high, high])) for high, n in zip(d, length)]
    while len(maps) > 1:
        rest = maps[len(maps) & ~1 :]
        maps = [_after(one, two) for one, two in zip(maps[::2], maps[1::2])] + rest
    x = maps[0][0]
    x = np.unique(np.concatenate([[0], x[(x > 0) & (x < start - 1)], [start - 1]]))
    out = pd.DataFrame({"x": x, "y": _mapped(maps[0], x)})
    return out.assign(start_k=start, **{c: runs[c].iloc[0] for c in _GROUP})[[*_GROUP, "start_k", "x", "y"]]


def _carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``s`` before each group, the place of its first number, and where the next group starts.

    A map is the least of ``y + max(0, s - x)`` over its corners, so they can pass in any order, batch by batch.
    """
    here, s, place, best = None, 0, 1, None
    for batch in batches:
        out = []
        for group, corners in batch.groupby([*_GROUP, "start_k"], sort=False):
            if group != here:
                follows = here is not None and here[:2] == group[:2]
                if here is not None:
                    out.append((*here[:3], s, place, group[3] if follows else None))
                s = best if follows else 0
                place = group[3] - s if follows else 1
                here, best = group, None
            least = int((corners["y"] + np.maximum(0, s - corners["x"])).min())
            best = least if best is None else min(best, least)
        yield pd.DataFrame(out, columns=[*_GROUP, "s", "place", "next_k"]).astype({"next_k": "Int64"})
    if here is not None:
        last = pd.DataFrame([(*here[:3], s, place, None)], columns=[*_GROUP, "s", "place", "next_k"])
        yield last.astype({"next_k": "Int64"})


def _resolve(runs: pd.DataFrame) -> pd.DataFrame:
    """Ranges of ranks with what each adds, and numbers given away, of one group."""
    one = runs.iloc[0]
    own, overflow, s, start = int(one["own"]), int(one["overflow"]), int(one["s"]), int(one["place"])
    skips, lost = _walk(
        overflow, own, list(runs[["k", "until", "n", "taken", "ahead"]].itertuples(index=False, name=None)), s
    )
    rows = []
    for place, passed in skips:
        if place > start:
            rows.append((start - 1 + own, place - 2 + own, s + 1 - own, None, None, None))
            start = place
        s += passed
    end = overflow if pd.isna(one["next_k"]) else min(overflow, int(one["next_k"]) - s - 1)
    if start <= end:
        rows.append((start - 1 + own, end - 1 + own, s + 1 - own, None, None, None))
    rows.extend((None, None, None, *given) for given in lost)
    numbers = ["first", "last", "add", "lost_from", "lost_until", "lost_n"]
    out = pd.DataFrame(rows, columns=numbers).astype("Int64")
    return out.assign(category=one["category"], filename=one["parent"])[["category", "filename", *numbers]]


def _tiled(ranges: DataFrame) -> DataFrame:
    """Ranges of ranks as one row for each tile they touch."""
    low = F.shiftleft(F.col("tile"), TILE_BITS)
    piece = F.struct(
        F.greatest("first", low).alias("first"),
        F.least("last", low + ((1 << TILE_BITS) - 1)).alias("last"),
        F.col("add").alias("add"),
    )
    tiles = F.sequence(F.shiftright("first", TILE_BITS), F.shiftright("last", TILE_BITS))
    return (
        ranges.withColumn("tile", F.explode(tiles)).groupBy(*NAME, "tile").agg(F.collect_list(piece).alias("pieces"))
    )


def _settled_in_groups(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tiles of the queues and the numbers given away, for families of any size."""
    queues = records.where("filename is not null").select(
        *NAME, "n", "taken", F.regexp_count(F.regexp_extract(stem(F.col("filename")), _NUMBERS, 1), F.lit("_")).alias("level")
    )
    runs = records.where("filename is null").select(
        *_GROUP, "k", "until", "n", "taken", F.coalesce("ahead", F.lit(0)).cast("long").alias("ahead")
    )
    # a level takes two signs of a file name at least, so there are few
    levels = sorted(row.level for row in queues.select("level").distinct().collect())
    given, tiles, lost = None, [], []
    for level in levels:
        here = queues.where(F.col("level") == level)
        own = ~F.col("taken")
        if given is not None:
            here = here.join(given.select(*NAME, F.lit(True).alias("away")), NAME, "left")
            own = own & F.col("away").isNull()
        here = here.select("category", F.col("filename").alias("parent"), own.alias("own"), F.col("n").alias("queue"))
        met = materialise(
            runs.join(here, ["category", "parent"]).withColumn("overflow", F.col("queue") - F.col("own").cast("long"))
        )
        corners = met.groupBy(*_GROUP).applyInPandas(_compose, _CORNERS)
        starts = (
            corners.repartition("category", "parent").sortWithinPartitions(*_GROUP).mapInPandas(_carry, _STARTS)
        )
        outcomes = materialise(met.join(starts, _GROUP).groupBy(*_GROUP).applyInPandas(_resolve, _OUTCOMES))
        tiles.append(outcomes.where("first is not null").select(*NAME, "first", "last", "add"))
        numbers = outcomes.where("lost_from is not null").select(
            *NAME, F.explode(F.sequence("lost_from", "lost_until")).alias("k"), F.col("lost_n").alias("n")
        )
        given = numbers.select("category", numbered(F.col("filename"), F.col("k")).alias("filename"), "n")
        lost.append(given.join(queues, NAME, "left_anti"))  # the others are settled in their turn
    return _tiled(reduce(DataFrame.unionAll, tiles)), reduce(DataFrame.unionAll, lost)


def assign_names(
    rows: DataFrame,
    taken: DataFrame | None = None,
    slice_bits: int = SLICE_BITS,
    island_bits: int = ISLAND_BITS,
    family_size: int = 1 << FAMILY_BITS,
) -> DataFrame:
    """Add ``target`` and ``n_suffix`` (0 for none) to ``rows``.

    ``rows`` needs ``category``, ``filename`` and a unique, gap-poor
    ``scan_seq`` such as ``with_scan_seq`` gives;
    ``taken`` lists ``(category, filename)`` at the destination. The queue
    lengths of the names that can matter are counted at once and checkpointed,
    because the rest of the plan depends on whether there are contests at all.
    Families with more than ``family_size`` records are settled in groups of
    ``2**island_bits`` numbers, with the same result.
    """
    lengths = _queue_lengths(rows, taken)
    # a name asked for once, free and without a number never matters
    matters = (F.col("n") > 1) | F.col("taken") | F.col("filename").rlike(_NUMBERED_LOOK)
    names = materialise(lengths.where(matters))
    contests = materialise(_contests(names))
    files = _ranked(rows, slice_bits).withColumn("tile", F.shiftright("ahead", TILE_BITS))
    answers = []
    if taken is not None:
        answers.append(_moved_up(names, contests))
    if not contests.isEmpty():
        answers.append(_settled(rows, contests, slice_bits, island_bits, family_size))
    suffix = F.col("ahead")
    if answers:
        files = files.join(reduce(DataFrame.unionByName, answers), [*NAME, "tile"], "left")
        piece = F.filter("pieces", lambda p: (p["first"] <= F.col("ahead")) & (p["last"] >= F.col("ahead")))
        suffix = suffix + F.coalesce(F.get(piece, F.lit(0)).getField("add"), F.lit(0))
    return files.select(
        "row.*",
        numbered(F.col("filename"), suffix).alias("target"),
        suffix.cast("long").alias("n_suffix"),
    )


def _settled(rows: DataFrame, contests: DataFrame, slice_bits: int, island_bits: int, family_size: int) -> DataFrame:
    """Tiles for all names in a contest."""
    parents = contests.select("category", F.col("parent").alias("filename")).distinct()
    queues = rows.select(*NAME, "scan_seq").join(parents, NAME, "left_semi")
    marks = contests.where("n > 0 and not taken")
    ranked = _ranked(queues, slice_bits, marks)
    records = materialise(_records(contests, ranked, island_bits))
    family = ["category", "family"]
    large = materialise(records.groupBy(*family).count().where(F.col("count") > family_size).select(*family))
    by_family = records.join(large, family, "left_anti")
    answers = materialise(by_family.groupBy(*family).applyInPandas(_settle, _ANSWERS))
    lost = answers.where("tile is null").select(
        "category",
        "filename",
        F.explode(F.sequence("lost_from", "lost_until")).alias("k"),
        F.col("lost_n").alias("n"),
    )
    tiles = answers.where("tile is not null").select(*NAME, "tile", "pieces")
    tiles = tiles.unionByName(_one_more(lost.withColumn("filename", numbered(F.col("filename"), F.col("k")))))
    if large.isEmpty():
        return tiles
    ranges, given = _settled_in_groups(records.join(large, family, "left_semi"))
    return tiles.unionByName(ranges).unionByName(_one_more(given))


def _one_more(names: DataFrame) -> DataFrame:
    """Tiles for names that none of their own files gets: each moves up by one."""
    zero = F.lit(0).cast("long")
    last = F.col("n") - 1
    whole = F.struct(zero.alias("first"), last.alias("last"), F.lit(1).cast("long").alias("add"))
    return names.select(
        *NAME, F.explode(F.sequence(zero, F.shiftright(last, TILE_BITS))).alias("tile"), F.array(whole).alias("pieces")
    )


def _moved_up(names: DataFrame, contests: DataFrame) -> DataFrame:
    """Tiles for names that exist at the destination and are in no contest."""
    parents = contests.select("category", F.col("parent").alias("filename"))
    return _one_more(names.where("taken and n > 0").join(parents, NAME, "left_anti"))
