"""Divergence audit, prefix trie and chat formatting against brute force, on odd rows and on long conversations."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
from cataloom.llm import chat_format, divergence, prefix_trie
from cataloom.llm.common import written

CONV = "conv_id bigint, turn bigint, role string, text string, place string, d int, name string, h string"


@pytest.fixture(scope="module")
def talks(spark):
    def build(rows):
        return spark.createDataFrame([(*r, "x", 1, "y", None) for r in rows], CONV)

    return build


def in_order(rows):
    """The turns of each conversation; ties of ``turn`` differ in role here or are equal rows."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(ts)] for c, ts in found.items()}


def brute_trie(rows):
    original = {c: ts for c, ts in in_order(rows).items() if c is not None}
    made = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = original.get(c - int(np.fmod(c, 5)), [])
        made[c] = base[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    children = Counter(key[:-1] for key in members if key)
    leaves, saved = Counter(), Counter()
    for key, who in members.items():
        size = len(key[-1][1].encode()) if key else 0
        for top in accumulate([(), *((t,) for t in key)]):
            leaves[top] += not children[key]
            saved[top] += (len(who) - 1) * size
    out = []
    for key, who in members.items():
        ends = ",".join(str(c) for c in who if len(made[c]) == len(key))
        parent = members[key[:-1]][0] if key else None
        out.append((who[0], len(key), parent, len(who), children[key], leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def long_talks(seed):
    """Copies, common openings, families, lenders that are short or absent, and conversations of several blocks."""
    draw = random.Random(seed)
    stem = [("user" if k % 2 == 0 else "assistant", f"t{k} é") for k in range(150)]
    rows = []
    for c in [*range(-7, 40), 1000, 1001, 1003, 70_000, 140_004]:
        n = draw.choice([1, 2, 3, 5, 8, 12, 31, 32, 33, 64, 65, 96, 97, 128, 130])
        turns = stem[:n] if draw.random() < 0.5 else stem[: n // 2] + [("user", draw.choice("abc")) for _ in range(n - n // 2)]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(talks, seed):
    rows = long_talks(seed)
    random.Random(seed).shuffle(rows)
    assert sorted((tuple(r) for r in prefix_trie.trie(talks(rows)).collect()), key=repr) == brute_trie(rows)


ODD = [
    (5, None, "user", "first"), (5, 0, None, None), (5, 1, "user", ""), (5, 1, "assistant", "tie"), (5, 2, "user", "x"), (5, 2, "user", "x"),
    (6, 0, "user", "first"), (6, None, None, "null turn"), (7, 0, None, None), (None, 0, "user", "no conversation"),
    (None, 1, "assistant", "none"), (9, 3, "tool\n%0A", "a [INST] b [\\INST] </s>"), (10, 0, "assistant", "long " * 50_000),
    (11, 0, "system", "\n<<SYS>>\n"), (12, 0, "user", " "), (12, 1, "assistant", "<\\s><s>\\"),
]


def test_trie_of_odd_rows(talks):
    assert sorted((tuple(r) for r in prefix_trie.trie(talks(ODD)).collect()), key=repr) == brute_trie(ODD)
    assert prefix_trie.trie(talks(ODD[:0])).collect() == []
    assert prefix_trie.trie(talks([(None, 1, "user", "x")])).collect() == []


def test_many_conversations_end_in_one_node(talks, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)
    rows = [(c, 0, "user", "same") for c in random.Random(1).sample(range(-500, 500), 300)]
    assert sorted((tuple(r) for r in prefix_trie.trie(talks(rows)).collect()), key=repr) == brute_trie(rows)


def brute_chat(rows):
    out = []
    for c, turns in in_order(rows).items():
        every = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1, 200, 1 << 20])
def test_chat_is_read_back(talks, monkeypatch, size):
    monkeypatch.setattr(chat_format, "PART_CHARS", size)
    rows = ODD + [r for r in long_talks(3) if not 0 <= r[0] <= 12]
    parts = written(chat_format.format_conversations(talks(rows)), "parts")
    found = chat_format.read_back(parts).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == brute_chat(rows)
    shown = parts.orderBy("place").collect()
    for r in shown:
        assert [r.formatted[s.start : s.end] for s in r.loss] == [r.formatted[a:b] for role, a, b in chat_format.parse(r.formatted) if role == "assistant"]
    lengths = Counter()
    for r in shown:
        lengths[r.conv_id] += len(r.formatted)
    assert {r.conv_id: r.formatted_chars for r in found} == lengths
    assert chat_format.read_back(written(chat_format.format_conversations(talks([])), "parts")).collect() == []


def test_round_trip_of_control_strings():
    draw = random.Random(4)
    pieces = ["<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[/TURN]", "<", "[", "\\", "/", " ", "\n", "s>", "INST]", "SYS>>", "a", "%0A"]
    for _ in range(5000):
        text = lambda: "".join(draw.choice(pieces) for _ in range(draw.randint(0, 6)))
        turns = [(draw.choice(["user", "assistant", "system", "", "tool", text()]), text()) for _ in range(draw.randint(1, 4))]
        shown = chat_format.settle(turns)
        assert chat_format.recovered(shown) == turns
        bare = "".join(shown[a:b] for _, a, b in chat_format.parse(shown))
        assert len(chat_format.CONTROL.findall(shown)) == 2 * len(turns) and chat_format.unescape(chat_format.escape(bare)) == bare
    assert chat_format.settle([("user", "hello")]) == "[INST] hello [/INST]"
    assert chat_format.recovered("[INST] a [INST] b [/INST]") is None and chat_format.recovered("stray") is None


def brute_audit(rows):
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {r[1] for r in rows}:
        kept = sorted(t for t, n in docs[lang].items() if n >= 10)
        sources = sorted({r[2] for r in rows if r[1] == lang})
        own = {s: Counter({t: counts[lang, s][t] for t in kept}) for s in sources}
        all_ = sum(own.values(), Counter())

        def shares(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p = {s: shares(own[s]) for s in sources}
        q = shares(all_)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(r, sum(f(p[s][t], p[r][t]) for t in kept)) for r in sources if r != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, values, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(values, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def _audit(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, doc_id bigint, term string, n int")
    return sorted(tuple(r) for r in divergence.audit(docs).collect())


@pytest.mark.parametrize("tile", [2, 64])
def test_audit_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BUCKET_ROWS", 40)
    draw = random.Random(tile)
    vocabulary = ["The", "the", "the,", "THE-the", "a-B-a", "été,", "Éa", "x1y", "日本", "--", "7", " ", "z" * 300, *(f"w{chr(97 + k)}" for k in range(20))]
    rows = []
    for _ in range(400):
        lang, source = draw.choice(["en", "en", "de", None]), draw.choice([*"abcdefg", None, "é"])
        some = vocabulary[: 6 + (ord(source[0]) % 20 if source else 27)]
        rows.append((draw.choice([" ", "\n", "\t\x0b"]).join(draw.choice(some) for _ in range(draw.randint(0, 30))), lang, source))
    rows += [(None, "en", "a"), ("", "xx", "only"), (None, "xx", "two"), ("the " * 300_000, "en", "b"), rows[0], rows[0]]
    assert _audit(spark, rows) == brute_audit(rows)


def test_audit_of_few_rows(spark):
    assert _audit(spark, []) == []
    rows = [("a b", "en", "s"), (None, "en", "t"), ("", None, None)]
    assert _audit(spark, rows) == brute_audit(rows) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_counts_of_long_and_blank_texts(monkeypatch):
    monkeypatch.setattr(divergence, "SPLIT_BYTES", 50)
    found = [b"", b" \n", b"a b a", ("é x\u2003y " * 40_000).encode(), b"a\x0bb\x1c c"]
    chunks, doc, chunk, n = divergence.chunk_counts(found)
    got = defaultdict(dict)
    for d, c, k in zip(doc.tolist(), chunks.take(chunk).to_pylist(), n.tolist()):
        got[d][c.encode()] = k
    assert got == {d: dict(Counter(t.split())) for d, t in enumerate(found) if t.split()}


def test_shares_beyond_64_bits(spark):
    row = spark.sql("select 9000000000000L as n, 20000000000001L as total, 10L as v").select(divergence._p("n", "total", "v")).first()
    assert row[0] == 1 + 10**9 * (9000000000000 + 2) // (20000000000001 + 20)
