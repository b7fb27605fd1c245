"""Operators of the llm subpackage against brute force, on hand-made rows with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticeboard.llm import decontamination, exact_dedup, html_blocks, jaccard_join, language_id, mixing, substring_dedup, suffix_arrays, suffix_dedup, surrogates, toxicity
from noticeboard.llm.common import components

EXTRA = "doc_id long, text string, lang string, source string, n long, key string, _row string, digest string, _hits int, score double"


def frame(spark, rows):
    """rows of (doc_id, text[, source]) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "a", 1, "k", "r", "d", 2, 0.5) for r in rows], EXTRA)


def words(rng, n, size=50):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    base, passage = words(rng, 120, 400), words(rng, 60, 400)
    rows = [(1, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, "  \n"), (7, "one"), (8, "one"), (9, passage + " " + words(rng, 30)), (10, words(rng, 40) + " " + passage), (11, "x y " * 90), (12, words(rng, 3000))]
    edited = base.split()
    edited[60] = "changed"
    rows += [(13, " ".join(edited)), (None, base), (2, base), (14, "é" * 500 + passage), (15, "É\x0b" + passage.upper())]
    return rows


def brute_words(texts, k=35):
    seen = Counter(tuple(w[i : i + k]) for w in texts for i in range(len(w) - k + 1))
    out = []
    for w in texts:
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def test_substring_dedup_equals_brute_force(spark, corpus):
    got = substring_dedup.remove_repeats(frame(spark, corpus), window=35).collect()
    want = brute_words([(t or "").encode().split() for _, t, *_ in corpus])
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((str(c[0]), *w) for c, w in zip(corpus, want))
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed


def test_repeated_paths_compact(spark, corpus):
    docs = frame(spark, corpus).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    spans = substring_dedup.repeated_paths(docs)[1].where("path is not null AND doc_id = 1").collect()
    assert max(s.end - s.start for s in spans) > 60  # several anchors in one span


def brute_bytes(texts, k):
    seen = Counter(t[i : i + k] for t in texts for i in range(len(t) - k + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - k + 1):
            if seen[t[i : i + k]] > 1:
                gone[i : i + k] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard_bytes", [2_000_000, 600])
def test_suffix_dedup_equals_brute_force(spark, corpus, shard_bytes):
    """Small shards split every anchor by a second one."""
    got = suffix_dedup.remove_repeats(frame(spark, corpus), length=120, inner=20, shard_bytes=shard_bytes).collect()
    want = brute_bytes([(t or "").encode() for _, t, *_ in corpus], 120)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(c[0]), *w) for c, w in zip(corpus, want))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_hot_anchor_fills_no_shard(spark, monkeypatch):
    """A passage shorter than a string, in other words in every text: both anchors lie within it."""
    rng = random.Random(6)
    passage = words(rng, 25, 400)[:95]
    rows = [(i, f"{words(rng, 60, 9999)} {passage} {words(rng, 60, 9999)}") for i in range(150)]
    rows += [(200 + i, "another beginning " * (i % 3) + rows[i][1][250:-200] + words(rng, 9)) for i in range(0, 40, 3)] + [(7, rows[7][1]), (300, "z" * 5000), (None, rows[9][1] + "é")]
    whole = suffix_dedup._sort_shard

    def bounded(table, length):
        if sum(len(b.as_buffer()) for b in table["bytes"]) > 4 * 4000:
            raise ValueError("too much in one task")
        return whole(table, length)

    monkeypatch.setattr(suffix_dedup, "_sort_shard", bounded)
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=120, inner=20, shard_bytes=4000).collect()
    want = brute_bytes([t.encode() for _, t in rows], 120)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(c[0]), *w) for c, w in zip(rows, want))
    assert sum(r.n_removed > 0 for r in got) > 15 and sum(r.n_removed == 0 for r in got) > 100


def test_only_blocks_alike_around_their_anchor_are_sorted(spark, monkeypatch):
    """A short phrase in every text makes blocks under one anchor that differ next to it; passages of just a string's length are still found."""
    rng = random.Random(8)
    phrase = words(rng, 8, 400)
    rows = [(i, f"{words(rng, 60, 9999)} {phrase} {words(rng, 60, 9999)}") for i in range(60)]
    begin = rows[5][1].index(phrase)
    for i, before in enumerate((0, 1, 30, 60, 90)):  # exactly 120 bytes in common, the anchor anywhere in them
        rows.append((100 + i, "#" + words(rng, 20, 9999) + "#" + rows[5][1][begin - before : begin - before + 120] + "#" + words(rng, 20, 9999)))
    sizes, sort = [], suffix_dedup.repeated_starts
    monkeypatch.setattr(suffix_dedup, "repeated_starts", lambda text, length: sizes.append(len(text)) or sort(text, length))
    table = pa.table({
        "doc_id": pa.array([i for i, _ in rows]), "text_key": pa.array([0] * len(rows)), "anchor": pa.array(np.zeros(len(rows), np.int64)), "n": pa.array([1] * len(rows)),
        "inner": pa.array([20] * len(rows), pa.int32()), "start": pa.array([0] * len(rows), pa.int32()), "bytes": pa.array([t.encode() for _, t in rows]),
    })
    place = suffix_dedup.mix(suffix_dedup.Spans(suffix_dedup.BYTE_VALUES[np.frombuffer(phrase.encode(), np.uint8)]).rolling(20) + np.uint64(0x2C1B3C6D))
    table = table.set_column(2, "anchor", pa.array(np.full(len(rows), place[5]).view(np.int64)))
    got = suffix_dedup._sort_shard(table, 120).to_pylist()
    assert {r["doc_id"] for r in got} == {5, 100, 101, 102, 103, 104}
    assert sum(sizes) < 0.2 * sum(len(t) for _, t in rows)
    found = suffix_dedup.remove_repeats(frame(spark, rows), length=120, inner=20).collect()
    want = brute_bytes([t.encode() for _, t in rows], 120)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == sorted((c[0], *w) for c, w in zip(rows, want))


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(120):
        text = np.append(rng.integers(1, 2 + trial % 4, rng.integers(1, 70)), 0) * (5000 if trial % 3 == 0 else 1)  # inner levels have many symbols
        if trial % 5 == 0:
            text = np.append(np.tile(rng.integers(1, 3, 3), 15), 0)
        array = suffix_arrays.suffix_array(text)
        assert array.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        common = suffix_arrays.permuted_prefixes(text, array, 1 << 40)
        for a, b in zip(array, array[1:]):
            n = next(k for k in range(len(text)) if text[a + k] != text[b + k])
            assert common[b] == n


def brute_links(rows, ngram, percent):
    sets = []
    for _, t, *_ in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        sets.append({tuple(w[i : i + ngram]) for i in range(len(w) - ngram + 1)} if len(w) >= ngram else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted((str(r[0]), len(s), str(smallest[find(i)] if s else r[0])) for i, (r, s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("ngram,percent", [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, corpus, ngram, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)  # many blocks
    rng = random.Random(9)
    rows = list(corpus)
    for family in range(4):
        base = words(rng, 150, 1000).split()
        for k in range(12):  # chains of edits: some link only through others
            if rng.random() < 0.7:
                base[rng.randrange(150)] = f"e{family}_{k}"
            rows.append((100 + family * 20 + k, " ".join(base)))
    got = jaccard_join.linked_documents(frame(spark, rows), ngram, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_links(rows, ngram, percent)


def test_jaccard_join_of_many_sizes_under_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(21)
    rows = []
    for i in range(60):  # two words only: most shingles are shared by texts of any length
        base = [rng.choice("ab") if rng.random() < 0.6 else f"w{rng.randrange(400)}" for _ in range(rng.choice((3, 8, 21, 40, 90, 180)))]
        rows.append((i * 10, " ".join(base)))
        for k in range(1, rng.randrange(1, 4)):  # longer and longer: the ends of a chain may be too unequal to link directly
            base += [f"x{i}_{k}_{m}" for m in range(max(1, len(base) // 14))]
            rows.append((i * 10 + k, " ".join(base)))
    got = jaccard_join.linked_documents(frame(spark, rows), 3, 90).collect()
    want = brute_links(rows, 3, 90)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert sum(d != c for d, _, c in want) > 20


def test_representatives_keep_one_of_each_group(spark, corpus):
    rows = [(i, t) for i, t, *_ in corpus if i is not None]
    kept = jaccard_join.representatives(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert 1 in ids and 3 not in ids and {4, 5, 6, 7} <= set(ids) and 8 not in ids


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == got[500] == 500


def test_exact_dedup(spark, corpus):
    rows = frame(spark, corpus)
    groups = defaultdict(list)
    for i, t, *_ in corpus:
        groups[t or ""].append(i)
    got = exact_dedup.dedup(rows, files_per_trigger=1).collect()
    want = [(str(i), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in corpus]
    assert sorted((str(r.id), str(r.stay), r.n, r.sha256) for r in got) == sorted(want)
    assert Counter(r.sha256 for r in got if r.kept) == Counter({r.sha256: 1 for r in got})
    kept = exact_dedup.kept_documents(rows)
    assert kept.columns == rows.columns and sorted(r.text or "" for r in kept.collect()) == sorted(groups)


def test_exact_dedup_compares_bytes_on_a_hit(spark, corpus):
    """A digest that makes all texts clash changes nothing."""
    full = exact_dedup.dedup(frame(spark, corpus)).drop("digest").collect()
    weak = exact_dedup.dedup(frame(spark, corpus), digest=lambda c: F.length(c) % 2).drop("digest").collect()
    assert sorted(map(str, full)) == sorted(str(r) for r in weak)


def plain(text):
    return "".join(c for c in text.lower() if c not in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").split()


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(2)
    items = [(k, words(rng, rng.choice([3, 9, 20, 31]), 300)) for k in range(12)] + [(50, None), (51, ""), (52, "!!"), (None, words(rng, 25, 300)), (53, "w1 w2 w3 w4 w5 w6")]
    rows = [(1, None), (2, ""), (3, words(rng, 400, 300))]
    for k in range(40):
        item = items[k % 12][1].split()
        if k % 3 == 1 and len(item) > 15:
            item[0] = "other"
        if k % 3 == 2:
            item = [w.upper() + "!" for w in item]
        rows.append((10 + k, " ".join([words(rng, rng.randrange(30), 300), *item, words(rng, rng.randrange(30), 300)])))
    rows.append((90, items[3][1]))
    rows.append((90, items[3][1]))
    rows.append((91, items[13 + 2][1] or "w9 w8"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((str(r.doc_id), str(r.item_id)) for r in decontamination.contaminated(frame(spark, rows), benchmark).collect())
    want: Counter = Counter()
    for i, t in rows:
        w = plain(t or "")
        for k, item in items:
            p = plain(item or "")
            n, size = min(len(p), len(w)), min(5, len(p))
            if not p or len(w) < size:
                continue
            bag = Counter(tuple(p[a : a + size]) for a in range(len(p) - size + 1))
            best = max(decontamination.weighted_jaccard(Counter(tuple(w[s + a : s + a + size]) for a in range(n - size + 1)), bag) for s in range(len(w) - n + 1))
            want[str(i), str(k)] += best >= 0.8
    assert got == +want and sum(got.values()) > 25
    blocks = Counter((str(r.doc_id), str(r.item_id)) for r in decontamination.contaminated(frame(spark, rows), benchmark, items_per_pass=4).collect())
    assert blocks == got
    clean = decontamination.clean_documents(frame(spark, rows), benchmark)
    assert clean.columns == frame(spark, rows).columns and {str(r.doc_id) for r in clean.collect()} == {str(i) for i, _ in rows} - {a for a, _ in got}


def test_hamming_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    index = decontamination.Index(pa.table({"item_id": list(range(40)), "text": [" ".join(f"q{rng.integers(1000)}" for _ in range(12)) for _ in range(40)]}))
    prints = index.prints[12]
    probes = prints[rng.integers(0, 40, 300)].copy()
    for k in range(300):
        for bit in rng.choice(64, k % 30, replace=False):
            probes[k] ^= np.uint64(1) << np.uint64(bit)
    found = set(zip(*(x.tolist() for x in index.candidates(12, probes))))
    assert found == {(k, i) for k in range(300) for i in range(40) if int(np.bitwise_count(probes[k] ^ prints[i])) <= decontamination.RADIUS}


def test_mixing_deviates_less_than_a_block(spark):
    rows = [(i, f"t{i}", ["a", "b", "c", None][(i * i) % 7 % 4]) for i in range(700)] + [(5, "t5", "b"), (None, None, "c")]
    weights = {"a": 5, "b": 3, "c": 1}
    out = mixing.mix(frame(spark, rows).withColumn("slot", F.lit("mine")), weights, block=4)
    got = out.collect()
    assert len(got) == len(rows) and sorted(r.mix_position for r in got) == list(range(len(rows)))
    assert out.columns[:-5] == frame(spark, rows).columns
    slots = {r.slot: r.source or "" for r in got}
    sizes = Counter(slots.values())
    assert sorted(slots) == list(range(len(slots)))
    for phase in mixing.phases(dict(sizes), {s: weights.get(s, 1.0) for s in sizes}):
        given, total = Counter(), sum(phase.weights.values())
        for k in range(phase.slots):
            given[slots[phase.first_slot + k]] += 1
            assert all(abs(given[s] - (k + 1) * w / total) < 1 for s, w in phase.weights.items())
    assert all(r.slot_release <= r.slot < r.slot_deadline for r in got)


@pytest.mark.parametrize("sources", [300, 2000])
def test_mixing_many_sources(spark, sources):
    rows = [(i, f"t{i}", f"s{i * i % 7919 % sources}") for i in range(3000)]
    weights = {f"s{k}": 1 + k % 5 for k in range(sources)}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights, block=2).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000)) and sorted(r.mix_position for r in got) == list(range(3000))
    slots = {}
    for r in got:
        slots.setdefault(r.slot, set()).add((r.source, r.source_block))
    assert all(len(v) == 1 for v in slots.values()) and sorted(slots) == list(range(len(slots)))
    assert all(r.slot_release <= r.slot < r.slot_deadline for r in got)


def test_toxicity_learns_words_and_spellings(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(400):
        text = [f"s{rng.randrange(300)}ab" for _ in range(rng.randrange(10, 120))]
        if k % 4 == 0:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["horrible", "nastiest"])
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(k % 4 == 0)))
    rows += [(1000, "s1ab s2ab horribble s3ab s4ab"), (1001, "s1ab s2ab s5ab s3ab s4ab"), (1002, None), (1003, ""), (1003, ""), (1004, "s7ab " * 30_000)]
    docs, table = frame(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(docs, table)
    scored = toxicity.score(docs, model, column="tox")
    assert scored.columns == [*docs.columns, "tox"]
    score = {r.doc_id: r.tox for r in scored.collect()}
    held = [k for k in range(400) if __import__("zlib").crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(score[k] >= 0.5) == (k % 4 == 0) for k in held]) > 0.95
    assert score[1000] > 2 * score[1001] and all(0 <= v <= 1 for v in score.values())
    nothing = toxicity.fitted(docs, table.limit(0))
    assert toxicity.score(docs.limit(0), nothing).count() == 0 and toxicity.score(docs, nothing, ["doc_id"]).select("_score").distinct().count() == 1


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """The driver neither gathers the sample nor fits the model."""
    driver, whole = os.getpid(), toxicity.train

    def elsewhere(rows, labels):
        if os.getpid() == driver:
            raise MemoryError("fitted on the driver")
        return whole(rows, labels)

    rows = [(k, f"a{k % 7} b{k % 5} " + "horrible" * (k % 4 == 0)) for k in range(60)] + [(1, "once more")] * 50
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(60)], "doc_id long, toxic int")
    sampled = sorted((r.doc_id, r.text, r.toxic) for r in toxicity.sample(frame(spark, rows), labels).collect())
    monkeypatch.setattr(toxicity, "train", elsewhere)
    got = toxicity.fitted(frame(spark, rows), labels, most=20)
    assert np.isfinite(got.margin).all() and len(got.margin) == toxicity.BUCKETS
    got = toxicity.fitted(frame(spark, rows), labels, most=4000)
    want = whole(pa.RecordBatch.from_pydict({"text": [t for _, t, _ in sampled]}), np.array([x for *_, x in sampled]))
    assert np.array_equal(got.margin, want.margin) and got.bias == want.bias


def test_language_id_leaves_no_language_out(spark):
    """More than 200 languages; one with texts of a few letters only, one with very long texts only."""
    rows = [(k * 20 + i, " ".join(f"q{k}x{j % (3 + i)}" for j in range(20)), f"l{k:03}") for k in range(210) for i in range(4)]
    rows += [(5000 + i, "zzyzx", "short") for i in range(9)] + [(6000 + i, "\u00fc\u00f6 \u00e4\u00df " * 2000, "long") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    batch, labels = language_id.sample(docs)
    learned = {lang for k, _, lang in rows if __import__("zlib").crc32(str(k).encode()) % 4 != 2}
    assert len(learned) > 200 and set(labels) == learned and max(map(len, batch["text"].to_pylist())) <= 4000


def test_language_id_sections_of_long_texts_add_up():
    import pyarrow as pa

    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh \u00e9") for _ in range(2_400_000))
    texts = next(language_id.pieces(iter([pa.record_batch({"text": ["one", None, long, "two", ""]})])))
    assert len(texts) == 2
    texts = language_id.Texts(pa.record_batch({"text": ["one", None, long, "two", ""]}), "text")
    got, owner = zip(*language_id.presence(texts))
    want, text = language_id._presence(texts.buffer, texts.offsets, language_id.PIECE)
    assert len(got) == 5 and (np.concatenate(got) == want).all() and (np.concatenate(owner) == text).all()


def test_language_id_held_out(spark):
    rng = random.Random(6)
    syllables = {"aa": ["ba", "lo", "mi", "ta"], "bb": ["str", "cht", "ung", "pf"], "cc": ["ña", "ción", "rro", "lle"]}
    rows = []
    for k in range(300):
        lang = list(syllables)[k % 3]
        rows.append((k, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(rng.randrange(8, 60))), lang))
    rows += [(900, None, "aa"), (901, "", None), (902, "12 34 !!", "bb"), (903, "balomi ta " * 20_000, None), (903, "balomi ta " * 20_000, None)]
    docs = spark.createDataFrame([(i, t, lang, "x") for i, t, lang in rows], "doc_id long, text string, lang string, lang_pred string")
    out = language_id.identify(docs, language_id.fit(*language_id.sample(docs)))
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert all(got[k][0] == rows[k][2] for k in range(300)) and got[903][0] == "aa"
    assert all(got[k] == ("und", 0.0) for k in (900, 901, 902)) and all(0 <= s <= 1 for _, s in got.values())
    blank = language_id.fit(*language_id.sample(docs.limit(0)))
    assert {r.lang_pred for r in language_id.identify(docs, blank).collect()} == {"und"}


def test_html_blocks(spark):
    prose = ["The first paragraph has several words.", "Another one follows, with a comma.", "Short one."]
    page = (
        '<html><head><title>No</title><style>p{}</style></head><body><header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a><li>B</ul></nav>'
        '<div class="cookie-banner">We use cookies here.</div><article><h1>A &amp; B&nbsp;title</h1>' + "".join(f"<p>{p}<script>var a = '<p>';</script>" for p in prose)
        + '<div class="ad">Buy this now.</div></article><section id="comments"><p>Great article, thanks for it.</p></section><aside class="sidebar"><p>Related stories of today.</p></aside>'
        '<form><label>Mail</label><input></form><footer>&copy; 2024</footer>'
    )
    broken = "<article><p>One <b>bold<p>two\n  lines &lt;here&gt;</i></article"
    rows = [(1, "u", page), (2, "v", None), (3, None, ""), (4, "w", "<nav>"), (None, "x", page), (1, "u", page), (5, "y", broken), (6, "z", "<article>" + "<p>Line of text.</p>" * 3000 + "</article>")]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, text string")
    net = html_blocks.train(html_blocks.sample(pages), made=1200, epochs=5)
    got = {r.page_id: r for r in html_blocks.extract(pages, net).collect()}
    assert got[1].text == "\n".join(["A & B title", *prose]) == got[None].text
    assert [got[k].text for k in (2, 3, 4)] == ["", "", ""] and got[5].text == "One bold\ntwo lines <here>"
    assert got[6].n_chars == 3000 * len("Line of text.") + 2999 and html_blocks.extract(pages, net).count() == len(rows)


def test_late_names_of_an_attribute_count():
    """Layout classes in front of the telling name, at the article as well as at what is not main text."""
    layout = "mt-4 px-2 flex flex-col w-full bg-white rounded shadow p-6 text-sm "
    late = html_blocks.blocks_of(f'<div class="{layout}comments"><p>One.</p></div>')[0].path
    assert late[-2:] == (".comments", "p") and len(set(late)) == len(late)
    said = [f"<p class='{layout}leading'>Some text number {i}, which is a sentence.</p>" for i in range(5)]
    for name in ("comments", "sidebar", "advert", "related"):
        page = '<html><body><article class="{0}article-body">{2}</article><div class="{0}{1}">{3}</div></body></html>'
        pages = [page.format(x, name, "".join(said), "".join(said[:4])) for x in (layout, "")]
        styled, plain = (html_blocks.features(html_blocks.blocks_of(x)) for x in pages)
        assert (styled == plain).all(), name  # layout classes change nothing
    assert (html_blocks.features(html_blocks.blocks_of(pages[0].replace(name, "unknown"))) != styled).any()


def test_all_words_of_a_block_count():
    block = lambda text: html_blocks.features([html_blocks.Block(("html", "p"), text, 0)])[0, html_blocks.PATH : html_blocks.PATH + html_blocks.WORDS]
    once = block("Alpha beta gamma.")
    assert np.allclose(block("Alpha beta gamma. " * 400), once) and np.allclose(block("Alpha " * 64 + "beta " * 936), 0.064 * block("alpha") + 0.936 * block("beta"))


def test_labeller_gradients():
    rng = np.random.default_rng(2)
    net = html_blocks.Labeller()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask, want = rng.normal(size=(4, 3, html_blocks.WIDTH)), np.array([[1, 1, 1], [1, 1, 0], [1, 1, 0], [1, 0, 0]], float), rng.integers(0, 2, (4, 3)).astype(float)

    def loss():
        raw = net.logits(x, mask)[0]
        return float(((np.logaddexp(0, raw) - want * raw) * mask).sum() / mask.sum())

    grad = net.learn(x, mask, want)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        for k in rng.choice(len(flat), 4):
            old, e = flat[k], 1e-4
            flat[k] = old + e
            up = loss()
            flat[k] = old - e
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * e) - grad[name].reshape(-1)[k]) < 1e-3


def test_surrogates(spark):
    texts = [
        "Mail Ann.Lee9@Mail0.example.com or ann.lee9@mail0.example.com.", "Call +1 (743) 555-3824 or 743-555-3824!", "From 227.5.221.1, card 4111 1111 1111 1111 and 4111111111111111",
        "123-45-6789, Mr. James Miller, Mary Miller, Frau Weber, Иван Петров", None, "", "nothing 2024-01-15 here", "Call +1 (743) 555-3824 or 743-555-3824!",
    ]
    docs = frame(spark, list(enumerate(texts)))
    out = surrogates.replaced(docs, "key")
    assert out.columns == [*docs.columns, "_entities"]
    got = {r.doc_id: (r.text, [(e.kind, e.surrogate) for e in r._entities]) for r in out.collect()}
    assert [len(got[k][1]) for k in range(8)] == [2, 2, 3, 5, 0, 0, 0, 2]
    assert got[4][0] is None and got[5][0] == "" and got[6][0] == texts[6] and got[7] == got[1]
    kinds = [k for d in range(4) for k, _ in got[d][1]]
    assert kinds == ["email", "email", "phone", "phone", "ip", "card", "card", "ssn", "name", "name", "name", "name"]
    # one entity, one surrogate, in the format of the mention
    assert got[0][1][0][1].lower() == got[0][1][1][1] and got[1][1][0][1].replace("(", "").replace(") ", "-")[-12:] == got[1][1][1][1]
    assert got[2][1][1][1].replace(" ", "") == got[2][1][2][1] and got[1][0].startswith("Call +1 (") and got[2][1][1][1][4] == " "
    digits = [int(c) for c in got[2][1][2][1]]
    assert sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    james, mary, ivan = (got[3][1][k][1] for k in (1, 2, 4))
    assert james.split()[1] in surrogates.GIVEN[0] and mary.split()[0] in surrogates.GIVEN[1] and ivan.split()[0] in surrogates.GIVEN[2]
    assert james.split()[2] == mary.split()[1]  # the same surname
    for text, (new, found) in zip(texts, (got[k] for k in range(8))):
        assert not found or not any(piece in new for piece in ("743-555", "4111 1111", "James", "Miller", "Ann.", "227.5"))
    assert surrogates.replaced(docs, "other").where("doc_id = 1").first().text != got[1][0]
    assert surrogates.replaced(docs.limit(0), "key").count() == 0


def test_surrogates_of_one_shape_stay_distinct(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.format_string("555-010-%04d x%d@a.com 10.0.%d.%d", "id", "id", F.floor(F.col("id") / 250).cast("int"), (F.col("id") % 250).cast("int")).alias("text"))
    found = surrogates.entities(docs, "key")
    assert found.count() == 3000 == found.select("kind", "surrogate").distinct().count() and surrogates.collisions(docs, "key").count() == 0


@pytest.mark.parametrize("run", [
    substring_dedup.remove_repeats, suffix_dedup.remove_repeats, jaccard_join.linked_documents, exact_dedup.dedup, mixing.mix, exact_dedup.kept_documents,
    lambda d: decontamination.contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text")),
])
def test_empty_tables(spark, run):
    assert run(frame(spark, [])).count() == 0


def test_mixing_query_keeps_whole_rows(spark):
    from noticeboard.llm import registry

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = registry.op1_mixing(spark, "/root/testdata/sf0.001").select(docs.columns)
    assert kept.count() == docs.count() and not kept.exceptAll(docs).count()
