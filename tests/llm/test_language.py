import random

import numpy as np
from cataloom.llm import language


def test_no_two_letters_are_spelled_alike():
    table = language.fold_table()
    lows = {p: ord(chr(p).lower()[0]) for p in range(0x110000) if chr(p).isalpha()}
    spelled = {low: int(table[point]) for point, low in lows.items()}
    assert len(set(spelled.values())) == len(spelled)
    assert all(table[point] == spelled[low] for point, low in lows.items())
    (key, chars, letters), = language.runs("한국 ab", table)
    assert (len(key), chars, letters) == (7, 5, 4)


def test_every_run_is_in_the_shards(make, monkeypatch):
    draw = random.Random(15)
    text = {name: ["".join(draw.choice(some) for _ in range(4000)) for _ in range(10)] for name, some in (("a", "abcdefghijkl"), ("b", "한국日本語çघगखक"))}
    docs = make([(i, t, name, None) for i, (name, all_of) in enumerate(text.items()) for t in all_of])
    keys = [k for all_of in text.values() for t in all_of for k, _, _ in language.runs(t, language.fold_table())]
    keys = np.unique(np.concatenate(keys))
    whole = language.train(docs)
    monkeypatch.setattr(language, "SHARD", 100_000)
    monkeypatch.setattr(language, "HELD", 0)
    cut = language.train(docs)
    assert whole.held and not cut.held
    assert len(whole.tables[5]) == 1 < len(cut.tables[5])
    for model in (whole, cut):
        assert (np.sort(np.concatenate([s.value[0] for s in model.tables[5]])) == keys).all()
        for order in range(1, 5):
            shorter = np.unique(keys & ((1 << language.CHAR_BITS * order) - 1))
            assert (np.sort(np.concatenate([s.value.keys for s in model.tables[order]])) == shorter).all()
    new = [text["a"][0], None, "", "abcabc unseen 한국 日本語ab", text["b"][0] + "zzz"]
    for one, other in zip(whole.read(new), cut.read(new)):
        assert np.allclose(one, other)
    kept = ["doc_id", "text"]
    rows = [language._scored(docs, m, {}, kept).select("lang_pred", "chars", "rejected").collect() for m in (whole, cut)]
    assert rows[0] == rows[1]


def test_labelled_noise_does_not_switch_rejection_off(make):
    draw = random.Random(16)
    tongues = {"en": ["the", "and", "thing", "shall", "with", "other"], "fr": ["que", "les", "dans", "mais", "être", "nous"]}

    def noise():
        return " ".join("".join(draw.choice("qxzjkvw") for _ in range(8)) for _ in range(40))

    learn, calibrate = ([(i, " ".join(draw.choice(tongues[t]) for _ in range(40)), t, None) for i in range(100) for t in tongues] for _ in range(2))
    few = [(i, "ђеља њива жућа " * 10, "sr", None) for i in range(3)]
    docs = make([(0, noise(), None, None), (1, calibrate[0][1], None, None), (2, few[0][1], None, None)])
    odd = [(1000 + i, noise(), t, None) for i in range(3) for t in tongues]
    model = language.train(make(learn + few))
    found = language._scored(docs, model, language.limits(make(calibrate + odd), model), ["doc_id"]).collect()
    assert {r.doc_id: r.rejected for r in found} == {0: True, 1: False, 2: False}
    assert np.isfinite(language.limits(make(calibrate), model)["sr"])


SHIPS = """
import sys, tempfile
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config(
    "spark.checkpoint.dir", tempfile.mkdtemp()).getOrCreate()
from cataloom.llm import language
docs = spark.createDataFrame([(i, t, l) for i in range(60) for t, l in (("the house and the sea " * 3, "en"), ("das haus und der see " * 3, "de"))], "doc_id bigint, text string, lang string")
found = language.by_folds(docs.withColumn("held_out", language.fold_of("doc_id") == 2), ["lang"]).collect()
assert found and all(r.lang == r.lang_pred for r in found), found[:3]
spark.stop()
"""


def test_runs_where_executors_lack_the_package(tmp_path):
    import os
    import subprocess
    import sys

    import cataloom

    root = os.path.dirname(os.path.dirname(cataloom.__file__))
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SHIPS.format(root=root)], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_sorted_arrays_find_every_key():
    import numpy as np

    keys = np.sort(np.unique(np.random.default_rng(1).integers(-(1 << 60), 1 << 60, 1000)))
    asked = np.concatenate([keys[::-3], keys + 1, [keys[-1] + 5, keys[0] - 5]])
    row = language.find((keys, np.zeros((len(keys), 1), np.float32)), asked)
    assert (row >= 0).tolist() == np.isin(asked, keys).tolist() and (keys[row[row >= 0]] == asked[row >= 0]).all()
    assert language.find((keys[:0], np.zeros((0, 1), np.float32)), asked).max() == -1


def test_counts_add_up_whatever_is_held(monkeypatch):
    from collections import Counter

    import pyarrow as pa

    draw = random.Random(17)
    rows = [("".join(draw.choice("abc é한") for _ in range(draw.randint(0, 900))), draw.choice(["a", "b"])) for _ in range(60)]
    fold = language.fold_table()
    wanted = Counter((name, int(k)) for text, name in rows for key, _, _ in language.runs(text, fold) for k in key)
    batches = [pa.table({"text": [t for t, _ in part], "lang": [x for _, x in part]}).to_batches()[0] for part in (rows[:1], rows[1:50], rows[50:])]
    for part, block in ((language.PART, language.BLOCK), (100, 4000), (7, 40)):
        monkeypatch.setattr(language, "PART", part)
        monkeypatch.setattr(language, "BLOCK", block)
        found = Counter()
        for out in language.count_runs(iter(batches), fold):
            for name, key, n in zip(*(out.column(c).to_pylist() for c in ("lang", "key", "n"))):
                found[name, key] += n
        assert found == wanted


def test_a_worker_needs_the_same_memory_for_larger_batches():
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    draw = np.random.default_rng(18)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    found = ["".join(draw.choice(letters, 5000)) for _ in range(1600)]
    fold = language.fold_table()
    keys = np.unique(np.concatenate([k for t in found[:20] for k, _, _ in language.runs(t, fold)]))
    shared = {}
    for order in range(1, language.ORDER + 1):
        some = np.unique(keys & ((1 << language.CHAR_BITS * order) - 1))
        of = language.shard_of(some, 2)
        shared[order] = [SimpleNamespace(value=(some[of == i], np.full((int((of == i).sum()), 2), -1, np.float32))) for i in range(2)]
    batch = pa.table({"text": pa.array(found), "lang": pa.array(["a", "b"] * 800)}).to_batches()[0]

    def peak(use) -> float:
        tracemalloc.start()
        try:
            use()
            return tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    for held, most in ((True, 20), (False, 140)):
        model = language.Model(["a", "b"], shared, shared, held, -8.0, SimpleNamespace(value=fold))
        assert peak(lambda: model.read(found)) < most
        for one, other in zip(model.read(found[:9]), model.read(batch.column("text")[:9])):
            assert (one == other).all()
    assert peak(lambda: [b.num_rows for b in language.count_runs(iter([batch]), fold)]) < 80


def test_every_cut_array_has_the_runs_of_its_order(make, monkeypatch):
    docs = make([(i, t, name, None) for i in range(5) for t, name in (("abcab cabba " * 30, "a"), ("한국日本語 çघगखक " * 30, "b"))])
    keys = np.unique(np.concatenate([k for r in docs.collect() for k, _, _ in language.runs(r.text, language.fold_table())]))
    monkeypatch.setattr(language, "SHARD", 100)
    monkeypatch.setattr(language, "HELD", 0)
    model = language.train(docs)
    assert not model.held and len(model.tables[5]) > 1
    for order in range(1, language.ORDER + 1):
        some = np.unique(keys & ((1 << language.CHAR_BITS * order) - 1))
        assert (np.sort(np.concatenate([s.value[0] for s in model.tables[order]])) == some).all()
