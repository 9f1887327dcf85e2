import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from cataloom.llm import common, decontaminate, fingerprint, quality, suffix_dedup, token_count


def test_words_are_those_of_the_pattern():
    text = "A\tbb  Ccc\n" + "x" * 9000 + " a " + "y" * 5000 + "\x0b\x0cé\xa0z bb"
    found = re.findall(r"[^\x20\x09-\x0d]+", text.lower())
    hashes = common.words(text.encode()).tolist()
    assert len(hashes) == len(found)
    assert len(set(hashes)) == len(set(found))
    assert all((a == b) == (x == y) for a, x in zip(found, hashes) for b, y in zip(found, hashes))


def test_segments_do_not_change_words(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode()
    whole = common.words(text)
    monkeypatch.setattr(common.segments, "__defaults__", (100,))
    assert (common.words(text) == whole).all()


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 30])
def test_shingles(n):
    words = [f"w{i % 7}" for i in range(n)]
    runs = {tuple(words[i : i + 5]) for i in range(max(1, n - 4))} if n else set()
    assert len(common.shingles(common.words(" ".join(words).encode()))) == len(runs)


def test_index_finds_every_repeated_window():
    draw = random.Random(1)
    base = "".join(draw.choice("abcd ") for _ in range(700)).encode()
    units = [base[a : a + draw.randrange(200, 337)] for a in (draw.randrange(0, 450) for _ in range(20))] + [b"a" * 300, b"xy" * 140, b"q" * 200]
    seen = {}
    for u in units:
        for i in range(len(u) - 199):
            seen[u[i : i + 200]] = seen.get(u[i : i + 200], 0) + 1
    expected = [[i for i in range(len(u) - 199) if seen[u[i : i + 200]] > 1] for u in units]
    assert [x.tolist() for x in suffix_dedup.repeated_windows(units)] == expected


def test_suffix_order():
    draw = random.Random(2)
    for _ in range(20):
        units = [[draw.randint(1, 2) for _ in range(draw.randint(1, 40))] for _ in range(draw.randint(1, 6))]
        symbols = np.array([s for u in units for s in [*u, 0]], np.uint16)
        ends = {p: k for k, p in enumerate(np.flatnonzero(symbols == 0))}
        letters = [(0, ends[i]) if s == 0 else (1, s) for i, s in enumerate(symbols.tolist())]
        assert suffix_dedup.suffix_order(symbols).tolist() == sorted(range(len(letters)), key=lambda i: letters[i:])


def test_entropy_of_each_window():
    buf = np.random.default_rng(1).integers(97, 110, 400).astype(np.uint8)
    full, term = fingerprint._FULL, fingerprint._TERM
    slow = [(full - int(term[np.bincount(buf[i : i + 64])].sum())) * 1000 // full for i in range(len(buf) - 63)]
    assert fingerprint.entropy_levels(buf).tolist() == slow


def test_likeness():
    maker = fingerprint.Maker(np.arange(fingerprint.LEVELS + 1)[::-1].copy())
    draw = random.Random(3)
    a, b = ("".join(draw.choice("abcdefgh ") for _ in range(30_000)).encode() for _ in range(2))
    of = {k: maker.filters(v) for k, v in {"a": a, "b": b, "mix": a[:20_000] + b[:10_000], "none": b""}.items()}
    assert fingerprint.likeness(of["a"], of["a"]) == 1.0
    assert fingerprint.likeness(of["a"], of["mix"]) > 0.5 > 0.1 > fingerprint.likeness(of["a"], of["b"])
    assert fingerprint.likeness(of["none"], of["none"]) == 1.0
    assert fingerprint.likeness(of["none"], of["a"]) == 0.0


def _levenshtein_fit(item, text):
    cost = [0] * (len(text) + 1)
    for i, word in enumerate(item):
        new = [i + 1]
        for j, other in enumerate(text):
            new.append(min(cost[j] + (word != other), cost[j + 1] + 1, new[-1] + 1))
        cost = new
    return min(cost)


def test_best_stretch_is_the_least_edit_distance():
    draw = random.Random(4)
    for _ in range(200):
        item = [draw.randint(0, 5) for _ in range(draw.randint(1, 12))]
        text = [draw.randint(0, 5) for _ in range(draw.randint(1, 25))]
        edits, first, last = decontaminate.best_stretch(np.array(item), np.array(text))
        assert edits == _levenshtein_fit(item, text)
        assert 0 <= first <= last <= len(text)


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.2])
def test_recall_of_edited_items(words, rate):
    draw = random.Random(int(rate * 10))
    items = [(i, [draw.choice(words) for _ in range(draw.randint(15, 60))]) for i in range(60)]
    block = decontaminate.Block([(i, common.words(" ".join(w).encode())) for i, w in items]).prepared()
    found = 0
    for i, item in items:
        item = list(item)
        for _ in range(int(rate * len(item))):
            at, kind = draw.randrange(len(item)), draw.choice("sid")
            if kind == "d":
                del item[at]
            else:
                item[at : at + (kind == "s")] = [draw.choice(words)]
        text = [draw.choice(words) for _ in range(50)] + item + [draw.choice(words) for _ in range(50)]
        hits = block.hits(" ".join(text).encode())
        assert {h["item_id"] for h in hits} <= {i}
        found += bool(hits)
    assert found >= (60 if rate == 0 else 57)


@pytest.mark.parametrize("kind", ["s", "i", "d"])
@pytest.mark.parametrize("n", [15, 48, 60, 150, 300, 600, 2000])
def test_recall_does_not_fall_with_length(words, n, kind):
    draw = random.Random(n)
    found, trials = 0, 40 if n <= 300 else 20
    for _ in range(trials):
        item = [draw.choice(words) for _ in range(n)]
        block = decontaminate.Block([(1, common.words(" ".join(item).encode()))]).prepared()
        edited = list(item)
        for at in sorted(draw.sample(range(n), n // 5), reverse=True):
            edited[at : at + (kind != "i")] = [] if kind == "d" else [draw.choice(words)]
        text = [draw.choice(words) for _ in range(50)] + edited + [draw.choice(words) for _ in range(50)]
        found += bool(block.hits(" ".join(text).encode()))
    assert found >= 0.95 * trials


def test_a_long_item_needs_all_its_parts(words):
    draw = random.Random(3)
    item = [draw.choice(words) for _ in range(300)]
    block = decontaminate.Block([(1, common.words(" ".join(item).encode()))]).prepared()
    text = [draw.choice(words) for _ in range(300)]
    text[100:200] = item[100:200]
    assert block.hits(" ".join(text).encode()) == []
    hit = block.hits(" ".join(text[:100] + item + text[200:]).encode())
    assert hit == [{"item_id": 1, "first_word": 100, "last_word": 400, "edits": 0}]


def test_texts_beside_an_item_are_clean(words):
    draw = random.Random(9)
    item = [draw.choice(words) for _ in range(40)]
    block = decontaminate.Block([(1, common.words(" ".join(item).encode()))]).prepared()
    assert block.hits(" ".join(item[:20] + [draw.choice(words) for _ in range(40)]).encode()) == []
    assert block.hits(b"") == [] and block.hits(None) == []
    assert block.hits(" ".join(item).encode())[0] == {"item_id": 1, "first_word": 0, "last_word": 40, "edits": 0}


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return token_count.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def _library(encoder, text):
    return len(encoder.tokenizer.encode(text, add_special_tokens=False)) if text else 0


def test_token_counts_equal_the_library(encoder):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    odd = ["", " ", "\n\n ", "it's we'll 'S", "a<|endoftext|>b <|endoftext|>", "x…—. a.b'c", "\xa0 a b", "日本 語", "😀😀 a", "a1b2 3.4,5", "<|endof", "_a_ __"]
    for text in texts + odd:
        assert encoder.count(text) == _library(encoder, text)


def test_spliced_counts_equal_the_library(encoder):
    draw = random.Random(7)
    parts = ["a", " ", "  ", "é", "\n", "x<|endoftext|>", "日本", "\xa0", ".", "'s", " the", "1"]
    for _ in range(30):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 900)))
        assert token_count.spliced_count(text, encoder.ends, 64, 4) == _library(encoder, text)
    for text in ("a" * 3000, " " * 2000, "ab " * 1000, "a" * 500 + " " + "b" * 900):
        assert token_count.spliced_count(text, encoder.ends, 100, 8) == _library(encoder, text)


def test_features_are_scaled():
    at, value = quality.features(b"one two two")
    assert len(at) == len(value) and np.isfinite(value).all()
    assert len(quality.features(None)[0]) == len(quality.features(b"")[0])


def test_levels_of_joined_texts_and_blocks(monkeypatch):
    draw = np.random.default_rng(3)
    texts = [draw.integers(97, 120, n).astype(np.uint8).tobytes() for n in (10, 64, 300, 900, 2000, 65, 300)]
    for a in texts[2:5]:
        for b in texts[2:5]:
            joined = fingerprint.joined_levels(a[:200], fingerprint.levels_of(a), b[:150], fingerprint.levels_of(b))
            assert (joined == fingerprint.entropy_levels(np.frombuffer(a[:200] + b[:150], np.uint8))).all()
    monkeypatch.setattr(fingerprint, "BLOCK", 1000)
    slow = np.concatenate([fingerprint.entropy_levels(np.frombuffer(t, np.uint8)) for t in texts if len(t) >= 64])
    assert np.concatenate(list(fingerprint._blocks(texts + [None, b""]))).tolist() == slow.tolist()
