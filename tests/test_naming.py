"""Names against the loop that copies one file after the other."""

import os
import random

import pytest
from cataloom.operators.naming import assign_names

POOL = [
    "a.t", "a_1.t", "a_2.t", "a_3.t", "a_4.t", "a_5.t", "a_1_1.t", "a_2_1.t", "a_1_1_1.t", "a_01.t", "a_1_2.t",
    "_1.t", ".t", ".t_1", "b", "b_1", "..", "a_99999999999999999999.t",
]


def one_by_one(rows, taken):
    used, out, tried = set(taken), [], {}
    for path, category, filename, seq in sorted(rows, key=lambda r: r[3]):
        name, ext = os.path.splitext(filename)
        k = tried.get((category, filename), 0)  # names never become free again
        target = filename if k == 0 else f"{name}_{k}{ext}"
        while (category, target) in used:
            k += 1
            target = f"{name}_{k}{ext}"
        used.add((category, target))
        tried[category, filename] = k
        out.append((path, target, k))
    return sorted(out)


def check(spark, rows, taken=None, **options):
    files = spark.createDataFrame(rows, "path string, category string, filename string, scan_seq long").repartition(4)
    names = None
    if taken is not None:
        names = spark.createDataFrame(sorted(taken), "category string, filename string")
    found = sorted((r.path, r.target, r.n_suffix) for r in assign_names(files, names, **options).collect())
    assert found == one_by_one(rows, taken or ())


def rows_of(*names, category="c"):
    return [(f"/{i}", category, n, i) for i, n in enumerate(names)]


@pytest.mark.parametrize("names", [
    ("a.t", "a.t", "a_1.t"), ("a_1.t", "a.t", "a.t"), (".b", ".b"), ("a.t",) * 5, ("a_1.t", "a_1.t", "a.t", "a.t", "a.t"),
])
def test_order_decides(spark, names):
    check(spark, rows_of(*names))


def test_existing_names(spark):
    check(spark, rows_of("a.t", "a.t", "b.t"), {("c", "a.t"), ("d", "b.t")})
    check(spark, rows_of("a.t"), {("c", "a.t"), ("c", "a_1.t"), ("c", "a_3.t")})
    check(spark, rows_of("a.t"), set())


@pytest.mark.parametrize("slice_bits, options", [
    (20, {}), (2, {}), (4, {"family_size": 0, "island_bits": 1}), (5, {"family_size": 0}), (6, {"family_size": 6, "island_bits": 2}),
])
def test_random_families(spark, slice_bits, options):
    rnd = random.Random(slice_bits)
    rows, taken = [], set()
    for case in range(700):
        pool = rnd.sample(POOL, rnd.choice([2, 3, 4, 6, len(POOL)]))
        taken |= {(f"c{case}", f) for f in pool if rnd.random() < 0.15}
        rows += [(f"c{case}", rnd.choice(pool)) for _ in range(rnd.randint(1, 14))]
    order = rnd.sample(range(len(rows)), len(rows))
    check(spark, [(f"/{i}", c, f, order[i]) for i, (c, f) in enumerate(rows)], taken, slice_bits=slice_bits, **options)


def test_one_family_over_many_groups(spark):
    """Some 100 000 runs of one family in random order, over 196 groups; some numbers exist, some overflow themselves."""
    rnd = random.Random(4)
    numbers = list(range(1, 100_001))
    names = [f"a_{k}.t" for k in numbers] + ["a.t"] * 60_000 + [f"a_{k}.t" for k in rnd.choices(numbers, k=20_000)]
    names += [f"a_{rnd.randint(1, 99)}_{rnd.randint(1, 9)}.t" for _ in range(3000)]
    rnd.shuffle(names)
    taken = {("c", f"a_{k}.t") for k in rnd.sample(range(1, 130_000), 9000)}
    check(spark, rows_of(*names), taken, island_bits=9)


def test_hot_name_and_long_runs(spark):
    """A third of all files share one name, another third are its numbers, some of which exist."""
    rnd = random.Random(9)
    names = ["a.t"] * 4300 + [f"a_{k}.t" for k in range(1, 2501)] + [f"x{i}.t" for i in range(2500)]
    taken = {("c", f"a_{k}.t") for k in range(2000, 5200)}
    for shuffled in (False, True):
        if shuffled:
            rnd.shuffle(names)
        check(spark, rows_of(*names), taken, slice_bits=6)
        check(spark, rows_of(*names))
        check(spark, rows_of(*names), taken, family_size=0, island_bits=5)


def test_numbered_names_alone_do_not_contend(spark):
    check(spark, rows_of(*[f"IMG_{i}.jpg" for i in range(50)], "IMG.jpg"))
