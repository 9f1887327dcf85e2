"""Language identification with interpolated Kneser-Ney character models.

Letters. A text is reduced to lower-case letters, runs of anything else to one blank. A letter is one symbol, or two where it is
an ideograph, a Hangul syllable or of a script that ``SINGLE`` does not name; no two letters are spelled alike.

Training. Of every text that may be learned from its runs of symbols of length ``ORDER`` are counted for each language in Spark: map tasks add up what they see, one
shuffle by run adds the rest. From these counts joins and groupings make the interpolated Kneser-Ney probabilities of
all orders: the highest order uses counts, lower orders use the number of distinct characters that precede a run.

Model. For each order a sorted array of the codes of all runs counted and, beside it, the log-probability for every language; where a
language has not seen a run, the table holds what its lower orders give, so one look-up serves all languages. A run that
no language has seen is looked up one order below, times the weight of its context. The full run is stored, so no run is
taken for another. The tables are cut by a hash of the run into shards of at most ``SHARD`` numbers, as many as the runs
need; each is collected and broadcast by itself, so neither the driver nor a worker holds more than one, unless all of them
together have at most ``HELD`` numbers. Else a worker reads texts in larger blocks and goes through the shards for each.
Besides its shards and the rows that Spark hands over a worker holds a few numbers for each of ``BLOCK`` or ``PART`` symbols, whatever
the length of the texts and of the batches.

Prediction. The language with the least cross-entropy per character wins (ties: the first by name). ``score`` is its
share of ``exp(-SHARPNESS * cross-entropy)`` over all languages. ``rejected`` is true where the text has no letter or its
cross-entropy is above that of nearly all calibration texts of the language: the value that a share ``QUANTILE`` of those that
are predicted as labelled stay below, plus ``MARGIN`` and ``SHORT / sqrt(characters)`` nats. So a few garbled or mislabelled texts
do not lift it, however many rows there are. A language with fewer than ``FEW`` such texts takes that value of all languages together,
or its own median if that is higher; without any such text in any language nothing but letterless texts is rejected. Calibration texts
are kept out of the counts.

Null, empty and letterless texts give ``und``, score 0, rejected. Rows whose language is null teach nothing. With nothing
to learn from, every text is ``und``. Repeated rows count as often as they occur; only ``text`` (and, in training, the
language column) is read, so extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cataloom.llm.common import U64, aside, mix, written

ORDER, CHAR_BITS, MAX_LANGUAGES = 5, 12, 256
SHARD, HELD = 1 << 23, 1 << 24  # numbers of four bytes
DISCOUNT, SHARPNESS, MARGIN, SHORT, QUANTILE, FEW = 0.75, 4.0, 1.0, 6.0, 0.95, 20
PART, BLOCK = 1 << 17, 1 << 21  # characters handled at once; runs a worker keeps before it counts them or goes through shards
UNKNOWN = "und"
_MASK = (1 << CHAR_BITS) - 1


#: Code points whose letters are one symbol: all up to Hangul Jamo, Khmer, further Latin and Greek, kana.
SINGLE = (0, 0x1200), (0x1780, 0x1800), (0x1E00, 0x2000), (0x3040, 0x3130)


@lru_cache(1)
def fold_table() -> np.ndarray:
    """Code point -> the symbol of its lower-case letter, plus a second one times 2^CHAR_BITS; 0 for what is no letter."""
    lows = {p: ord(chr(p).lower()[0]) for p in range(0x110000) if chr(p).isalpha()}
    letters = sorted(set(lows.values()))
    single = [x for x in letters if any(a <= x < b for a, b in SINGLE)]
    code = {x: 1 + i for i, x in enumerate(single)}
    lead = {h: 1 + len(single) + i for i, h in enumerate(sorted({x >> 10 for x in letters if x not in code}))}
    second = 1 + len(single) + len(lead)
    assert second + 1024 <= 1 << CHAR_BITS
    table = np.zeros(0x110000, np.uint32)
    for point, low in lows.items():
        table[point] = code[low] if low in code else lead[low >> 10] | (second + (low & 1023)) << CHAR_BITS
    return table


def runs(text: str | None, fold: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """Keys of the runs of ORDER symbols of a text, in parts; each run ends at another symbol. The characters, the letters."""
    tail = np.zeros(ORDER - 1, np.int64)
    for at in range(0, len(text or ""), PART):
        found = fold[np.frombuffer(text[at : at + PART].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        both = np.concatenate([tail[-1:], found])
        found = found[(found != 0) | (both[:-1] != 0)]
        if not len(found):
            continue
        n, letters = len(found), int(np.count_nonzero(found))
        wide = found > _MASK
        if wide.any():
            ends = np.cumsum(1 + wide) - 1
            symbols = np.repeat(found & _MASK, 1 + wide)
            symbols[ends[wide]] = found[wide] >> CHAR_BITS
            found = symbols
        chars = np.concatenate([tail, found])
        key = np.zeros(len(found), np.int64)
        for k in range(ORDER):
            key = (key << CHAR_BITS) | chars[k : k + len(found)]
        tail = chars[len(chars) - ORDER + 1 :]
        yield key, n, letters


def singly(found: pa.Array | list) -> Iterator[str | None]:
    """The values of an Arrow array one at a time, so that no second copy of all texts is made."""
    return iter(found) if isinstance(found, list) else (x.as_py() for x in found)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return (mix(key.astype(U64)) % U64(shards)).astype(np.int64)


#: Sorted keys of a shard, and their log-probabilities (rows x languages). Plain arrays, so that executors need no code to unpickle them.
Shard = tuple[np.ndarray, np.ndarray]


def find(shard: Shard, key: np.ndarray) -> np.ndarray:
    """Row of each key in a shard, -1 where there is none."""
    keys = shard[0]
    if not len(keys):
        return np.full(len(key), -1, np.int64)
    order = np.argsort(key)  # neighbours in the table are looked up one after the other
    row = np.empty(len(key), np.int64)
    row[order] = np.searchsorted(keys, key[order])
    row[row == len(keys)] = 0
    return np.where(keys[row] == key, row, -1)


def added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``n`` for each."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
    return key[first], np.add.reduceat(n, first)


def add_logs(shard: Shard, total: np.ndarray, owner: np.ndarray, row: np.ndarray) -> None:
    """Add the logs of rows to the totals of their owners (ascending)."""
    for part in range(0, len(row), 8192):
        own = owner[part : part + 8192]
        first = np.append(0, np.flatnonzero(own[1:] != own[:-1]) + 1)
        total[own[first]] += np.add.reduceat(shard[1][row[part : part + 8192]], first, axis=0, dtype=np.float64)


@dataclass
class Model:
    """Per order (1 to ORDER): the shards of the runs and of the contexts, all broadcast."""

    languages: list[str]
    tables: dict[int, list[Broadcast]]
    contexts: dict[int, list[Broadcast]]
    held: bool
    floor: float
    fold: Broadcast

    def _each(self, shards: list[Broadcast], key: np.ndarray) -> Iterator[tuple[Shard, np.ndarray]]:
        """Every shard that has some of the keys, and which: at most PART at once."""
        of = np.zeros(len(key), np.int32)
        for at in range(0, len(key) if len(shards) > 1 else 0, PART):
            of[at : at + PART] = shard_of(key[at : at + PART], len(shards))
        for i, shared in enumerate(shards):
            some = False
            for at in range(0, len(key), PART):
                mine = at + np.flatnonzero(of[at : at + PART] == i)
                if len(mine):
                    some = True
                    yield shared.value, mine
            if some:
                if not self.held and getattr(shared, "_path", None):
                    vars(shared).pop("_value", None)  # read again from the executor's disk when wanted

    def add(self, total: np.ndarray, owner: np.ndarray, key: np.ndarray) -> None:
        """Add the log-probabilities of runs, by language, to the totals of their owners (ascending)."""
        for order in range(ORDER, 0, -1):
            if not self.tables[order]:
                continue
            lacking = np.ones(len(key), bool)
            for shard, mine in self._each(self.tables[order], key):
                row = find(shard, key[mine])
                hit = row >= 0
                lacking[mine[hit]] = False
                add_logs(shard, total, owner[mine[hit]], row[hit])
            key, owner = key[lacking], owner[lacking]
            if not len(key):
                return
            if order > 1:
                # the context is the run without its last symbol; a language that has not seen it adds nothing
                context = key >> CHAR_BITS
                for shard, mine in self._each(self.contexts[order], context):
                    row = find(shard, context[mine])
                    add_logs(shard, total, owner[mine[row >= 0]], row[row >= 0])
                del context
                key &= (1 << CHAR_BITS * (order - 1)) - 1
        total += np.bincount(owner, minlength=len(total))[:, None] * self.floor

    def read(self, found: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the cross-entropy per character by language, the characters and the letters."""
        total = np.zeros((len(found), len(self.languages)))
        n, letters = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        block = PART if self.held else BLOCK
        keys: list[np.ndarray] = []
        owners: list[int] = []
        size = 0

        def settle() -> None:
            if keys:
                owner, key = np.repeat(np.array(owners, np.int32), [len(k) for k in keys]), np.concatenate(keys)
                keys.clear()
                owners.clear()
                self.add(total, owner, key)

        for i, text in enumerate(singly(found)):
            for key, chars, some in runs(text, self.fold.value):
                keys.append(key)
                owners.append(i)
                n[i], letters[i], size = n[i] + chars, letters[i] + some, size + len(key)
                if size >= block:
                    settle()
                    size = 0
        settle()
        return -total / np.maximum(n, 1)[:, None], n, letters


def count_runs(batches: Iterator[pa.RecordBatch], fold: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``lang, key, n`` of batches of ``text, lang``; a run can come more than once."""
    fresh: dict[str, list[np.ndarray]] = {}
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    size = 0

    def settle():
        for name in list(fresh):
            key, n = np.unique(np.concatenate(fresh.pop(name)), return_counts=True)
            if name in held:
                key, n = added(np.concatenate([held[name][0], key]), np.concatenate([held[name][1], n]))
            held[name] = key, n

    def emit():
        for name in list(held):
            key, n = held.pop(name)
            for at in range(0, len(key), PART):
                part = [pa.array(x[at : at + PART], pa.int64()) for x in (key, n)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part[0]), pa.string()), *part], names=["lang", "key", "n"])

    for batch in batches:
        for text, name in zip(singly(batch.column("text")), singly(batch.column("lang"))):
            for key, _, _ in runs(text, fold):
                fresh.setdefault(name, []).append(key)
                size += len(key)
                if size > BLOCK // 4:
                    settle()
                    size = 0
                    if sum(len(key) for key, _ in held.values()) > BLOCK // 4:
                        yield from emit()
    settle()
    yield from emit()


def _counted(docs: DataFrame, lang: str) -> DataFrame:
    """``lang, key, n``: how often each run occurs in the texts of each language."""
    fold = docs.sparkSession.sparkContext.broadcast(fold_table())  # one number for each code point
    found = docs.select("text", F.col(lang).alias("lang")).where("text is not null and lang is not null")
    seen = found.mapInArrow(lambda batches: count_runs(batches, fold.value), "lang string, key bigint, n bigint")
    return seen.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _probabilities(counts: DataFrame, languages: list[str]) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Per order: runs with their probability by language, and contexts with their weight by language."""
    levels = {ORDER: written(counts, "runs")}
    for order in range(ORDER - 1, 0, -1):
        # continuation counts: how many distinct characters stand before the run
        shorter = F.col("key").bitwiseAND(F.lit((1 << CHAR_BITS * order) - 1))
        levels[order] = levels[order + 1].groupBy("lang", shorter.alias("key")).agg(F.count("*").alias("n"))
    out: dict[int, tuple[DataFrame, DataFrame]] = {}
    lower = None
    for order in range(1, ORDER + 1):
        own = levels[order].withColumn("context", F.shiftright("key", CHAR_BITS))
        context = own.groupBy("lang", "context").agg(F.sum("n").alias("all_n"), F.count("*").alias("kinds"))
        context = context.withColumn("weight", F.col("kinds") * DISCOUNT / F.col("all_n"))
        seen = own.select("key").distinct()
        # every run that some language has seen, for every language (at most MAX_LANGUAGES rows each)
        every = F.explode(F.array(*map(F.lit, languages))).alias("lang")
        grid = seen.select("key", every, F.shiftright("key", CHAR_BITS).alias("context"))
        full = grid.join(own.select("lang", "key", "n"), ["lang", "key"], "left").join(
            context.select("lang", "context", "all_n", "weight"), ["lang", "context"], "left"
        )
        if lower is None:
            below = F.lit(1.0 / (1 << CHAR_BITS))
        else:
            full = full.withColumn("short", F.col("key").bitwiseAND(F.lit((1 << CHAR_BITS * (order - 1)) - 1)))
            full = full.join(lower.select("lang", F.col("key").alias("short"), F.col("p").alias("below")), ["lang", "short"], "left")
            below = F.col("below")
        own_share = F.greatest(F.coalesce(F.col("n"), F.lit(0)) - DISCOUNT, F.lit(0.0)) / F.col("all_n")
        p = F.when(F.col("all_n").isNull(), below).otherwise(own_share + F.col("weight") * below)
        lower = written(full.select("lang", "key", p.alias("p")), "probabilities")
        out[order] = lower, context.select("lang", F.col("context").alias("key"), F.col("weight").alias("p"))
    return out


def _shards(found: DataFrame, languages: list[str], absent: float) -> tuple[list[Broadcast], int]:
    """All keys with their log-probabilities in broadcasts of at most about SHARD numbers; the numbers in all."""
    place = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))])
    pairs = F.collect_list(F.struct(place[F.col("lang")].alias("i"), F.log("p").cast("float").alias("log")))
    rows = written(found.groupBy("key").agg(pairs.alias("logs")), "rows")
    numbers = rows.count() * (len(languages) + 2)  # a key is two
    shards = -(-numbers // SHARD)

    def cut(batches):
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard_of(key, shards))], names=[*batch.schema.names, "shard"])

    if shards > 1:
        schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.LongType())])
        rows = written(rows.mapInArrow(cut, schema).repartition("shard"), "rows")
    out = []
    for i in range(shards):
        got = (rows.where(F.col("shard") == i) if shards > 1 else rows).select("key", "logs").toArrow()
        keys = got.column("key").to_numpy()
        logs = np.full((len(keys), len(languages)), absent, np.float32)
        lists = got.column("logs").combine_chunks()
        row = np.repeat(np.arange(len(keys)), np.diff(lists.offsets.to_numpy())) if len(keys) else np.zeros(0, np.int64)
        flat = lists.flatten()
        logs[row, flat.field("i").to_numpy(zero_copy_only=False)] = flat.field("log").to_numpy(zero_copy_only=False)
        order = np.argsort(keys, kind="stable")
        out.append(found.sparkSession.sparkContext.broadcast((keys[order], logs[order])))
    return out, numbers


def train(docs: DataFrame, lang: str = "lang") -> Model:
    """A model of every language in ``docs`` (``text`` and a language column)."""
    found = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull()).select(F.col(lang).alias("l")).distinct()
    languages = sorted(r.l for r in found.limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    empty = {o: [] for o in range(1, ORDER + 1)}
    fold = docs.sparkSession.sparkContext.broadcast(fold_table())
    model = Model(languages, dict(empty), dict(empty), True, float(-CHAR_BITS * np.log(2)), fold)
    if languages:
        numbers = 0
        for order, (full, context) in _probabilities(_counted(docs, lang), languages).items():
            model.tables[order], own = _shards(full, languages, 0.0)
            model.contexts[order], further = _shards(context, languages, 0.0)
            numbers += own + further
        model.held = numbers <= HELD
    return model


def _scored(docs: DataFrame, model: Model, limits: dict[str, float], keep: list[str]) -> DataFrame:
    """``keep`` and ``lang_pred, score, entropy, chars, rejected`` of every row of ``docs``."""
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + T._parse_datatype_string("lang_pred string, score double, entropy double, chars bigint, rejected boolean").fields
    )

    def predict(batches):
        for batch in batches:
            out = []
            found = batch.column("text")
            entropies, chars, letters = model.read(found) if model.languages else (None, None, np.zeros(len(found)))
            for i, some in enumerate(letters):
                if not some:
                    out.append((UNKNOWN, 0.0, None, 0, True))
                    continue
                entropy, n = entropies[i], int(chars[i])
                best = int(np.argmin(entropy))
                share = 1.0 / float(np.exp(-SHARPNESS * (entropy - entropy[best])).sum())
                name, least = model.languages[best], float(entropy[best])
                out.append((name, share, least, n, least > limits.get(name, np.inf) + SHORT / n**0.5))
            cols = list(zip(*out)) if out else [()] * 5
            kinds = pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=schema.names
            )

    return docs.select(*keep, *({"text"} - set(keep))).mapInArrow(predict, schema)


def limits(docs: DataFrame, model: Model, lang: str = "lang") -> dict[str, float]:
    """Per language the cross-entropy above which a text is not of it, from texts the model has not learned from."""
    named = docs.select(F.col(lang).alias("named"), "text").where("named is not null")
    found = _scored(named, model, {}, ["named"]).where("lang_pred = named")
    value = F.expr(f"entropy - {SHORT} / sqrt(chars)")
    most = F.percentile_approx(value, [0.5, QUANTILE], 10_000)
    rows = found.rollup("named").agg(F.count("*").alias("n"), most.alias("most")).collect()
    pooled = next((r.most[1] for r in rows if r.named is None and r.n), np.inf)
    out = dict.fromkeys(model.languages, pooled + MARGIN)
    for r in rows:
        if r.named is not None:
            out[r.named] = (r.most[1] if r.n >= FEW else max(pooled, r.most[0])) + MARGIN
    return out


def identify(docs: DataFrame, train_on: DataFrame, calibrate_on: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred, score, entropy, chars, rejected``."""
    model = train(train_on)
    return _scored(docs, model, limits(calibrate_on, model) if model.languages else {}, keep)


def fold_of(doc_id: Column | str) -> Column:
    """The fold (0 to 3) of a document: the CRC of its id as text, modulo 4."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def by_folds(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Learn from folds 0 and 3, calibrate on 1, never look at the language of 2."""
    fold = fold_of("doc_id")
    learn = docs.select("text", "lang", fold.alias("fold"))
    return identify(docs, learn.where("fold in (0, 3)"), learn.where("fold = 1"), keep)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is of a known language; its columns unchanged."""
    renamed, names, back = aside(docs, ("doc_id", "text", "lang"))
    return by_folds(renamed, names).where("not rejected").select(*back)
