"""Prefix trie, shards and spelling variants against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeboard.llm import prefix_trie, sharding, spelling_variants, toxicity

TURNS = "conv_id long, turn long, role string, text string, _block int, pos string, item string, depth double"


def turn_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "i", 0.5) for r in rows], TURNS)


def brute_trie(rows, stride=20, heads=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [r[-1] for r in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h, r = zlib.crc32(str(c).encode()) % heads, c - (abs(c) % stride) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(r, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        own_saved = (len(members) - 1) * len(p[-1][1].encode().split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += own_saved
    return sorted((
        min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
        hashlib.sha256(",".join(str(c) for c in sorted(m) if paths[c] == p).encode()).hexdigest(),
    ) for p, m in nodes.items())


def trie_rows(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def test_trie_equals_brute_force(spark):
    rng = random.Random(3)
    said = [("user", "hello there"), ("assistant", "good day  to you"), ("user", ""), (None, None), ("tool", "x " * 40), ("user", "é\x0bü")]
    rows = []
    for c in [*range(-25, 90), 1000, 1001]:
        if c in (40, 60):
            continue  # conversations whose first turns others would take
        for t in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([t, t, t, None, 2]), *rng.choice(said)))
    rows += [(None, 0, "user", "nobody's")] + rows[:5] + [(81, 99, "user", "very long " * 50_000)]
    assert trie_rows(prefix_trie.conversation_trie(turn_frame(spark, rows))) == brute_trie(rows)


def test_trie_of_no_turns_and_of_one_long_chain(spark):
    assert trie_rows(prefix_trie.conversation_trie(turn_frame(spark, []))) == []
    rows = [(0, i, "user", f"turn {i % 5}") for i in range(400)] + [(20, i, "user", f"turn {i % 5}") for i in range(250)] + [(40, 0, "user", "turn 0")]
    assert trie_rows(prefix_trie.conversation_trie(turn_frame(spark, rows))) == brute_trie(rows)


def test_running_columns_go_over_many_blocks(spark):
    """One conversation in several range partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(20 * (i % 3 == 0), i, "user", f"t{i}") for i in range(300)]
        assert trie_rows(prefix_trie.conversation_trie(turn_frame(spark, rows))) == brute_trie(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


DOCS = "doc_id long, text string, size int, shard string, digest string, row int, _bin int"


def doc_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", "d", 2, 3) for r in rows], DOCS)


def brute_shards(texts, shards):
    """Capacity and the sizes of shards that groups of their own and the greedy walk give."""
    groups = Counter()
    for t in texts:
        groups[hashlib.sha256((t or "").encode()).digest()] += len((t or "").encode()) + 1
    left, own = sum(groups.values()), []
    for k, b in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        if len(own) == shards - 1 or b * (shards - len(own)) <= left:
            break
        own.append(k)
        left -= b
    rest = [(k, groups[k]) for k in sorted(groups) if k not in own]
    parts = shards - len(own)

    def greedy(capacity):
        out, used = [[]], 0
        for k, b in rest:
            if b > capacity:
                return None
            if used + b > capacity:
                out, used = [*out, []], 0
            out[-1].append(k)
            used += b
        return out if len(out) <= parts else None

    low, high = 0, left
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(mid) else (mid, high)
    place = {k: i for i, k in enumerate(own)}
    for i, keys in enumerate(greedy(high) if rest else []):
        place.update({k: len(own) + i for k in keys})
    return place


@pytest.mark.parametrize("bins", [1 << 14, 8])
def test_shards_equal_brute_force(spark, bins, monkeypatch):
    """Few bins need several rounds of division."""
    monkeypatch.setattr(sharding, "BINS", bins)
    rng = random.Random(5)
    rows = [(i, "x" * rng.choice([1, 10, 50, 50, 400, 3000]) + str(rng.randrange(150))) for i in range(400)]
    rows += [(900, None), (901, ""), (None, "a b"), (None, "a b"), (7, rows[7][1])] + [(1000 + i, "hot copy " * 30) for i in range(300)] + [(2000, "long " * 40_000)]
    for shards in (1, 5, 16):
        got = sharding.assign(doc_frame(spark, rows), shards).collect()
        place = brute_shards([t for _, t in rows], shards)
        want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), place[hashlib.sha256((t or "").encode()).digest()]) for i, t in rows)
        assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard) for r in got) == want
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_few_rows_and_written_shards(spark, tmp_path):
    assert sharding.assign(doc_frame(spark, [])).collect() == []
    assert [(r.shard, r.slot) for r in sharding.assign(doc_frame(spark, [(1, None)])).collect()] == [(0, 0)]
    rows = [(i, f"text {i}") for i in range(50)]
    sharding.write_shards(doc_frame(spark, rows), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and set(DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")) <= set(back.columns)


def near(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    form, out = {}, []
    for w, n in counts.items():
        close = sorted((-counts[v], v) for v in counts if near(w, v))
        form[w] = close[0][1] if close and -close[0][0] >= 2 * n else None
        out.append((w, n, len(close)))
    rows = []
    for w, n, k in out:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, k, counts[form[w]] if form[w] else None))
    return sorted(rows, key=str)


@pytest.mark.parametrize("letters", ["ab", "abcdeéÿ"])
def test_variants_equal_brute_force(spark, letters):
    rng = random.Random(11)
    counts = {}
    for _ in range(150):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(4, 12)))
        i = rng.randrange(len(w))
        for v in (w, w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:]):
            counts[v] = rng.randrange(1, 40)
    got = spelling_variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_variants(counts)


def test_every_word_keeps_a_gram():
    rng = random.Random(2)
    for _ in range(2000):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(4, 12)))
        grams = {spelling_variants.padded(w)[i : i + 2] for i in range(len(w)) if rng.random() < 0.5}
        for c in (len(w), len(w) - 1):
            most = spelling_variants.longest_gram(c)
            found = spelling_variants.decompose(w, grams, most)
            assert spelling_variants.affected(found, len(w), most) < len(found)


def test_words_of_texts(spark):
    rng = random.Random(8)
    said = ["Straße", "strasse", "straßen", "HOUSE", "house", "houses", "mouse", "a", "é", "naïve", "×÷×÷×"]
    rows = [(i, " ".join(rng.choice(said) for _ in range(40)) + "-x9") for i in range(30)] + [(None, "house mouse"), (5, None), (6, ""), (7, "house " * 30_000)]
    want = Counter()
    for i, t in rows:
        lowered = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in t or "")
        run = ""
        for ch in lowered + " ":
            if "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                run += ch
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                k = h % len(run)
                want[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
                run = ""
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    frame = doc_frame(spark, rows).withColumn("word", F.lit(1)).withColumn("entry", F.lit("e"))
    got = spelling_variants.spelling_variants(frame).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_variants(want)
    assert spelling_variants.spelling_variants(doc_frame(spark, [])).collect() == []


def test_toxicity_of_tables_with_any_columns(spark):
    rows = [(1, "good day", 0.1, "w"), (2, None, 0.2, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _score double, _whole string")
    out = toxicity.score(docs, toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0))
    assert out.columns == ["doc_id", "text", "_score", "_whole", "_score_"] and sorted((r.doc_id, r._score, r._score_) for r in out.collect()) == [(1, 0.1, 0.5), (2, 0.2, 0.5)]
