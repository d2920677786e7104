"""Each operator against a brute-force version, on a small table of the hard cases and on the smallest test data."""

import collections
import hashlib
import math
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import chat, decontaminate, licences, lines, packing, quality, sharding, simhash, substring, toxicity
from lodestone.llm.common import read_table

SPACE = re.compile("[^\x20\x09-\x0d]+")
CLASH = ("w", "fp", "d", "t", "x", "r", "n", "h", "score", "gone", "ls", "held_out", "predicted", "n_near", "times", "component", "line", "place", "item_id", "kept_text", "_t", "_row", "_id")
NUMBER = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
P20 = " ".join(f"p{i}" for i in range(20))
HARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two"), (6, "a b c"), (7, f"x {P20} y"), (8, f"{P20} z {P20}"), (9, P20), (9, P20),
    (None, P20), (None, None), (10, "na " * 300), (11, "è" * 5000 + " naïve 𝒳𝒴 'tis don't\n\n\n  end  "), (12, "\\ <|end|> </s>"), (13, " ".join(f"u{i % 700}" for i in range(3000))),
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", 0, *["clash"] * len(CLASH)) for i, t in rows], NUMBER)


@pytest.fixture(scope="module")
def hard(spark):
    return table(spark, HARD)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(x):
    return tuple((v is not None, v if v is not None else 0) for v in x)


def test_decontaminate(spark, sf_dir, docs, hard):
    items = [(r["item_id"], r["text"]) for r in read_table(spark, sf_dir, "benchmark").collect()]
    more = [(900, "one"), (901, "P0 p1, p2 p3 p4 p5 p6 p7 p8"), (902, None), (903, ""), (901, "one two"), (904, "na na na"), (905, "a b c")]
    for df, items in ((docs, items), (hard, more), (docs, []), (hard.where("false"), more)):
        bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
        word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
        split = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        known = collections.defaultdict(set)
        for i, t in items:
            w = split(t)
            n = min(8, len(w))
            for j in range(len(w) - n + 1 if n else 0):
                known[tuple(w[j : j + n])].add(str(i))
        want = []
        for d, t in texts(df):
            w, hit, ids = split(t), set(), set()
            for n in {len(k) for k in known}:
                for j in range(len(w) - n + 1):
                    if tuple(w[j : j + n]) in known:
                        hit.update(range(j, j + n))
                        ids |= known[tuple(w[j : j + n])]
            want.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(ids) >= 2))
        assert sorted(map(tuple, decontaminate.contamination(df, bench).collect()), key=key) == sorted(want, key=key)


def brute_print(t):
    w = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    n = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(s))


def components(prints, distance=3):
    kinds = list(dict.fromkeys(prints.values()))
    parent = {k: k for k in kinds}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    return {k: find(k) for k in kinds}


def test_simhash(spark, docs, hard):
    for df in (docs, hard, hard.where("false")):
        rows = texts(df)
        prints = dict(enumerate(brute_print(t) for _, t in rows))
        root = components(prints)
        low = {}
        for i, (d, _) in enumerate(rows):
            if d is not None:
                r = root[prints[i]]
                low[r] = min(low.get(r, d), d)
        want = [(d, f"{prints[i]:016x}", low.get(root[prints[i]])) for i, (d, _) in enumerate(rows)]
        got = simhash.simhash_components(df).select("doc_id", "fingerprint", "component_id").collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_simhash_chains_and_crowds(spark):
    import random

    rng = random.Random(5)
    prints = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([2, 3, 40])):  # random walks: chains whose ends are far apart
            prints.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                x ^= 1 << b
        crowd = rng.getrandbits(64)
        prints.update(crowd ^ (1 << a) ^ (1 << b) for a, b in (rng.sample(range(64), 2) for _ in range(20)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    root = components(dict(enumerate(prints)))
    got = {r["fp"] % (1 << 64): r["component"] for r in simhash.link_components(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    assert len(got) == len(prints)
    assert len({(root[p], got[p]) for p in prints}) == len(set(root.values())) == len(set(got.values()))


def test_toxicity(spark, hard):
    import random

    rng = random.Random(1)
    bad = ["vilex", "grumox", "blatch"]
    rows, marks = [], []
    for i in range(3000):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 60))]
        if i % 8 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad)
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", "s", "ing"])
        rows.append((i, " ".join(w)))
        marks.append((i, int(i % 8 == 0), 1))
    df = table(spark, rows)
    labels = spark.createDataFrame([*marks, (None, 1, 1), (5, None, 1), (7, 0, 1), (7, 0, 1)], "doc_id long, toxic int, text int")
    got = toxicity.toxicity(df, labels).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(r["predicted"], int(r["doc_id"] % 8 == 0)) for r in got if r["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert toxicity.toxicity(hard, labels, df).count() == len(HARD)
    assert {(r["score"], r["predicted"]) for r in toxicity.toxicity(hard, labels.where("false")).collect()} == {(0.0, 0)}
    assert toxicity.toxicity(hard.where("false"), labels).count() == 0
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity(df, flipped).collect()} == {r["doc_id"]: r["score"] for r in got}


def test_toxicity_counts_different_words_before(spark):
    rows = [("start " + " ".join(f"a{i} the" for i in range(300)), False)] * 3 + [(" ".join(f"b{i} the" for i in range(70)) + " a1 the", True), ("the", True), (None, False), ("", True)]
    want = collections.defaultdict(lambda: [set(), set()])
    for t, toxic in rows:
        w = (t or "").split()
        for x, y in zip(["", *w], w, strict=False):
            want[y][not toxic].add(x)
    got = toxicity.count_types(spark.createDataFrame(rows, "text string, toxic boolean").repartition(3)).collect()
    names = {int(toxicity.expressions([w], toxicity.fold_table())[0][0]): w for w in want}
    assert {names[r["word"]]: [r["t"], r["o"]] for r in got} == {w: [len(x) for x in v] for w, v in want.items()}
    assert [r["t"] for r in got if names[r["word"]] == "the"] == [72]


def test_toxicity_looks_words_up_exactly(spark, monkeypatch):
    import numpy as np

    word, stem, _ = toxicity.expressions(["vilex mild"], toxicity.fold_table())
    near = [int(word[0]) % 4_194_301 + 4_194_301 * i for i in (1, 2)]  # the same bucket once, other words
    assert np.array_equal(toxicity.look_up(np.sort(word), np.array([1.0, 2.0]), np.array(near)), [np.nan] * 2, equal_nan=True)
    pairs = "key long, w double"
    words, stems = spark.createDataFrame([(int(word[0]), 3.0), (near[0], -9.0)], pairs), spark.createDataFrame([(int(stem[1]), 0.5), (int(stem[0]), 7.0)], pairs)
    rows = [(1, "vilex mild other"), (2, "vilexes, vilexes"), (3, None), (4, ""), (None, "vilex"), (5, "vilex"), (5, "vilex"), (6, "mild mild vilex !")]
    weights = {"vilex": 3.0, "mild": 0.5, "vilexes": 7.0}
    for most in (toxicity.MODEL_ROWS, 0):
        monkeypatch.setattr(toxicity, "MODEL_ROWS", most)
        model = toxicity.Model(words, stems)
        assert (model.arrays is None) == (most == 0)
        got = [(r["doc_id"], round(r["x"], 9), round(r["r"], 9)) for r in toxicity.mean_ratio(table(spark, rows), model, ["doc_id"]).collect()]
        want = []
        for d, t in rows:
            w = re.findall(r"\w+", t or "")
            total, n = sum(weights.get(x, 0.0) for x in w), max(1, len(w))
            want.append((d, round(total / n, 9), round(total / math.sqrt(n), 9)))
        assert sorted(got, key=key) == sorted(want, key=key)


def test_toxicity_counts_all_but_the_calibrating_rows(spark, monkeypatch):
    seen = []
    count = toxicity.count_types
    monkeypatch.setattr(toxicity, "count_types", lambda df: seen.extend(r["text"] for r in df.collect()) or count(df))
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 20)
    rows = [(i, f"text{i} of words") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    toxicity.toxicity(table(spark, rows), labels)
    sums = {i: zlib.crc32(str(i).encode()) for i in range(400)}
    tune = sorted((c, i) for i, c in sums.items() if c % 5 == 1)
    assert len(tune) > 40
    left = {i for i, c in sums.items() if c % 5} - {i for _, i in tune[:20]}
    assert sorted(seen) == sorted(f"text{i} of words" for i in left)


def test_licences(spark, hard):
    mit = licences.TEXTS["MIT"]
    rows = [(1, f"Copyright (c) 2020 A. Person\n\n{mit.upper()}"), (2, f"{mit} And more."), (3, "words\nreleased under the mit LICENCE\nRELEASED under the MIT License!"), (4, None), (4, None), (5, "Released under the MIT License."), (5, "Released under the MIT License.")]
    got = licences.scan(table(spark, rows), licences.known_digests(spark)).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0], r[1])) == [(1, 0, "MIT", "MIT"), (2, 0, "", None), (3, 2, "MIT", None), (4, 0, "", None), (4, 0, "", None), (5, 1, "MIT", "MIT"), (5, 1, "MIT", "MIT")]
    full = licences.whole_texts()
    assert set(full) == {"MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Apache-2.0", "GPL-3.0", "CC-BY-SA-4.0"}
    rows = [(i, f"{t.upper()}\n\n(c) 2001 Somebody") for i, t in enumerate(t for ts in full.values() for t in ts)] + [(10**6, f"{t} x") for t in full["GPL-3.0"][:1]]
    got = {r["doc_id"]: r["whole_licence"] for r in licences.scan(table(spark, rows), licences.known_digests(spark)).collect()}
    assert got == dict(enumerate(k for k, ts in full.items() for _ in ts)) | {10**6: None}
    assert licences.scan(hard, licences.known_digests(spark)).count() == len(HARD)
    assert licences.scan(hard.where("false"), licences.known_digests(spark)).count() == 0


def test_substring(spark, docs, hard):
    for df in (docs, hard, hard.where("false")):
        rows = texts(df)
        seen, at = set(), {}
        for d, t in sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or "")):
            w = SPACE.findall(t or "")
            gone = set()
            for i in range(len(w) - 19):
                k = tuple(w[i : i + 20])
                if k in seen:
                    gone.update(range(i, i + 20))
                seen.add(k)
            at[d] = [x for i, x in enumerate(w) if i not in gone]
        want = []
        for d, t in rows:
            w = SPACE.findall(t or "")
            kept = at.get(d, w)
            want.append((d, len(w), len(w) - len(kept), " ".join(kept)))
        for options in ({}, {"most": 0}, {"first": 5}) if df is docs else ({}, {"first": 5, "most": 0}):  # both sides of the broadcast, other levels
            assert sorted(map(tuple, substring.remove_repeats(df, **options).collect()), key=key) == sorted(want, key=key)


def test_packing(spark, docs, hard):
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    tok = Tokenizer.from_file(path)
    tricky = [(50 + i, t) for i, t in enumerate([" ", "  a", "a\n\n b", "\t\tx ", "it's we'll 'd", "٣٤ ²½ x²", "a   b", "é‍😀!? ,.", "\r\n\r\n", "<|endoftext|> x", "a <|endoftext|> b<|endoftext|>", "a'b s'"])]
    for df in (docs, hard, table(spark, tricky), hard.where("false")):
        rows = texts(df)
        pieces = packing.pack_documents(df.repartition(3), path).collect()
        ids = collections.defaultdict(list)
        for d, t in rows:
            ids[d].append([*tok.encode(t or "", add_special_tokens=False).ids, packing.END_ID])
        by_window = collections.defaultdict(list)
        got = collections.Counter()
        for p in pieces:
            by_window[p["sequence_id"]].append((p["offset"], p["length"]))
            fits = [x for x in ids[p["doc_id"]] if len(x) == p["doc_tokens"] and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x[p["start"] : p["start"] + p["length"]])) == p["ids_crc32"]]
            assert fits and p["length"] > 0
            got[p["doc_id"]] += p["length"]
        assert got == {d: sum(map(len, x)) for d, x in ids.items()}
        for spans in by_window.values():
            end = 0
            for offset, length in sorted(spans):
                assert offset == end
                end += length
            assert end <= packing.WINDOW
        if df is docs:
            total = sum(got.values())
            assert len(by_window) <= math.ceil(1.03 * total / packing.WINDOW) + 6


def test_sharding(spark, docs, hard):
    for df in (docs, hard, hard.where("false")):
        got = sharding.place(df).collect()
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts(df))
        slots = collections.defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    wide = spark.range(40000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    n = collections.Counter(r["shard"] for r in sharding.place(wide).collect())
    assert len(n) == 16 and max(n.values()) < 1.1 * 2500 and min(n.values()) > 0.9 * 2500


def brute_shard(doc_id, shards, weights):
    """The shard of a doc_id, by the draws of the tree's levels."""
    import struct

    def draw(level, names):
        best = None
        for name, weight in names.items():
            h = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
            h = xxhash.xxh64_intdigest(struct.pack("<i", name), xxhash.xxh64_intdigest(level.encode(), h))
            cost = -math.log(((h >> 11) + 0.5) / 2**53) / weight
            best = min(best or (cost, name), (cost, name))
        return best[1]

    weigh = lambda x: sum(map(weigh, x.values())) if isinstance(x, dict) else x
    node, path = sharding.topology(shards, weights=weights), "root"
    while isinstance(node, dict):
        name = draw(path, {k: weigh(v) for k, v in node.items()}) if len(node) > 1 else next(iter(node))
        node, path, last = node[name], f"{path}/{name}", name
    return last


def test_sharding_by_weights(spark):
    df = table(spark, [(i * 7919 - 50, "x") for i in range(600)] + [(None, "y")])
    shards = {}
    for weights in (None, {5: 3.0}, {5: 3.0, 2: 0.0}):
        got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.place(df, weights=weights).collect()}
        assert got == {d: (brute_shard(d, 16, weights), brute_shard(d, 17, weights)) for d in got}
        shards[str(weights)] = {d: s for d, (s, _) in got.items()}
    even, heavy, without = shards.values()
    assert 2 not in without.values() and 2 in heavy.values()
    moved = {(even[d], heavy[d]) for d in even if even[d] != heavy[d]}
    assert moved
    for old, new in moved:  # only into shard 5, or into its rack, or region, from outside of it
        assert new // 4 == 1 and (old // 4 != 1 or (new // 2 == 2 and (old // 2 != 2 or new == 5)))
    with pytest.raises(ValueError):
        sharding.topology(2, weights={0: 0.0, 1: 0.0})


def brute_weights(rows, prune, least):
    """Log ratios of words and stems, by the formulas, from (text, toxic)."""
    before = collections.defaultdict(lambda: [set(), set()])
    for t, toxic in rows:
        w = t.split()
        for x, y in zip(["", *w], w, strict=False):
            before[y][not toxic].add(x)
    n = {w: tuple(map(len, v)) for w, v in before.items()}
    stems = collections.defaultdict(lambda: [0, 0, 0])
    for w, (t, o) in n.items():
        for i, v in enumerate((t, o, 1)):
            stems[w[:5]][i] += v
    total = [sum(v[i] for v in n.values()) for i in (0, 1)]
    tox = total[0] / sum(total)
    d = toxicity.DISCOUNT
    p = {s: [max(v[i] - d, 0) / total[i] + d * sum(x[i] > 0 for x in stems.values()) / total[i] * v[2] / len(n) for i in (0, 1)] for s, v in stems.items()}
    tells = lambda t, o: 2 * sum(x * math.log(x / ((t + o) * q)) for x, q in ((t, tox), (o, 1 - tox)) if x) >= prune
    words = {}
    for w, v in n.items():
        s = stems[w[:5]]
        part = sum(v) / (s[0] + s[1])
        q = [max(v[i] - d, 0) / total[i] + d * sum(x[i] > 0 for x in n.values()) / total[i] * p[w[:5]][i] * part for i in (0, 1)]
        words[w] = (tells(*v), math.log(q[0] / q[1]))
    stem = {s: (tells(*v[:2]), math.log(p[s][0] / p[s][1])) for s, v in stems.items()}
    return [{k: r for k, (tell, r) in x.items() if tell and abs(r) >= least} for x in (words, stem)]


def test_toxicity_weights(spark):
    import random

    rng = random.Random(8)
    rows = [(" ".join(rng.choice(["grumox", "vilexing", "vilexed"] if i % 5 == 0 and rng.random() < 0.5 else [f"word{j}" for j in range(30)]) for _ in range(30)), i % 5 == 0) for i in range(120)]
    types = toxicity.count_types(spark.createDataFrame(rows, "text string, toxic boolean"))
    for prune, least in ((0.0, 0.0), (toxicity.PRUNE, toxicity.LEAST_RATIO)):  # every word has an entry; only telling ones
        for got, want, part in zip(toxicity.weigh(types, prune, least), brute_weights(rows, prune, least), (0, 1), strict=True):
            name = lambda w: int(toxicity.expressions([w], toxicity.fold_table())[part][0])  # noqa: B023, E731
            assert want and {r["key"]: round(r["w"], 9) for r in got.collect()} == {name(w): round(x, 9) for w, x in want.items()}


def test_toxicity_compares_whole_class_models(spark, monkeypatch):
    import random

    rng = random.Random(9)
    mild = [f"word{j}" for j in range(30)] + [f"{c}{j}" for j in range(20) for c in "xyz"]
    rows = [(" ".join(rng.choice(["grumox", "vilexing", "vilexed"] if i % 5 == 0 and rng.random() < 0.2 else mild) for _ in range(30)), i % 5 == 0) for i in range(120)]
    types = toxicity.count_types(spark.createDataFrame(rows, "text string, toxic boolean"))
    before = collections.defaultdict(lambda: [set(), set()])
    for t, toxic in rows:
        for x, y in zip(["", *t.split()], t.split(), strict=False):
            before[y][not toxic].add(x)
    n = {w: [len(x) for x in v] for w, v in before.items()}
    stems = collections.defaultdict(lambda: [0, 0, 0])
    for w, v in n.items():
        stems[w[:5]] = [a + b for a, b in zip(stems[w[:5]], [*v, 1], strict=True)]
    assert [df.count() for df in toxicity.weigh(types)] == [len(n), len(stems)]  # nothing is left out

    def likelihood(w, c):
        """Of a word in a class; what both classes share of a new word or stem is left out."""
        total, lost = sum(v[c] for v in n.values()), toxicity.DISCOUNT
        rest, stem_rest = (lost * sum(v[c] > 0 for v in x.values()) / total for x in (n, stems))
        if w[:5] not in stems:
            return rest * stem_rest
        s = stems[w[:5]]
        of_stem = max(s[c] - lost, 0) / total + stem_rest * s[2] / len(n)
        return max(n[w][c] - lost, 0) / total + rest * of_stem * sum(n[w]) / (s[0] + s[1]) if w in n else rest * of_stem

    texts = ["word1 word2 grumox", "vilexes x3 word3", "unheard of, z7 z7", "", None, "vilexing " * 3 + "word4 " * 500, "word1 word2 grumox"]
    want = []
    for i, t in enumerate(texts):
        w = re.findall(r"\w+", t or "")
        both = [[likelihood(x, c) for x in w] for c in (0, 1)]
        by_length = [sum(map(math.log, p)) / max(1, len(w)) for p in both]
        odds = [a / b for a, b in zip(*both, strict=True)]
        want.append((i, round(by_length[0] - by_length[1], 9), round(math.log(sum(odds) / len(w)) if w else 0.0, 9)))
    for most in (toxicity.MODEL_ROWS, 0):
        monkeypatch.setattr(toxicity, "MODEL_ROWS", most)
        model = toxicity.Model(*toxicity.class_models(types))
        got = toxicity.mean_ratio(table(spark, list(enumerate(texts))), model, ["doc_id"]).collect()
        assert sorted((r["doc_id"], round(r["x"], 9), round(r["e"], 9)) for r in got) == want


def test_chat(spark):
    rows = [(1, 2, "user", "<|end|> \\ \\\\ <s>[INST]"), (1, 1, "system", None), (1, 3, "assistant", "a<|sep|>\nb"), (1, 3, "assistant", "a<|sep|>\nb"), (2, None, None, "x"), (None, 1, "assistant", "é𝒳"), (3, 1, "<|start|>", "")]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = chat.digest_chats(chat.format_chats(log)).collect()
    got = {r["conv_id"]: r for r in chat.digest_chats(chat.format_chats(chat.fold_events(chat.as_events(log)))).collect()}
    assert got == {r["conv_id"]: r for r in plain}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(said) and got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
    assert chat.format_chats(log.where("false")).count() == 0


def test_chat_events(spark):
    log = [(1, 1, 1, None, "user", "hi"), (1, 5, 2, "delta", "assistant", "lo"), (1, 4, 2, "delta", "assistant", "hel"), (1, 6, 2, "regenerate", "assistant", "new"), (1, 7, 2, "delta", None, " text"), (1, 8, 1, "edit", "user", "hello")]
    df = spark.createDataFrame(log, "conv_id long, seq long, message_id long, kind string, role string, text string")
    assert sorted(map(tuple, chat.fold_events(df).collect())) == [(1, 1, "user", "hello"), (1, 4, "assistant", "new text")]


def test_quality(spark, docs, hard):
    for df in (docs, hard, hard.where("false")):
        want = []
        for d, t in texts(df):
            w = SPACE.findall(t or "")
            n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
            hit = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
            lines = [x for x in (t or "").split("\n") if SPACE.search(x)]
            want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
        got = quality.judge(df).collect()
        assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(want, key=key)
        assert not any(r["kept"] and r["base_failed"] for r in got)


def brute_perplexity(texts, order=5):
    """Log perplexities of texts by an interpolated modified Kneser-Ney model of the same texts."""
    lines = [list(" " * (order - 1) + re.sub("[\x20\x09-\x0d]+", " ", t or "")) for t in texts]
    lines = [x[: order - 1] + x[order:] if x[order - 1 : order] == [" "] else x for x in lines]
    counts = [collections.Counter(tuple(x[i - order + 1 : i + 1]) for x in lines for i in range(order - 1, len(x)))]
    while len(counts) < order:
        counts.insert(0, collections.Counter(g[1:] for g in counts[0]))
    tables = []
    for n in counts:
        d = [0.0, *quality.discounts([sum(v == i for v in n.values()) for i in (1, 2, 3, 4)])]
        total, left = collections.Counter(), collections.Counter()
        for g, v in n.items():
            total[g[:-1]] += v
            left[g[:-1]] += d[min(v, 3)]
        tables.append((n, d, total, left))

    def p(g):
        if not g:
            return 1 / (len(counts[0]) + 1)
        n, d, total, left = tables[len(g) - 1]
        return (n[g] - d[min(n[g], 3)] + left[g[:-1]] * p(g[1:])) / total[g[:-1]]

    memo = {g: -math.log(p(g)) for g in counts[-1]}
    sums = [[memo[tuple(x[i - order + 1 : i + 1])] for i in range(order - 1, len(x))] for x in lines]
    return [sum(s) / len(s) if s else None for s in sums]


def test_quality_perplexity(spark, docs, hard):
    for df, options in ((docs.where("doc_id < 60"), {}), (hard, {}), (hard, {"most": 0})):  # both sides of the broadcast
        rows = texts(df)
        want = sorted(((d, None if x is None else round(x, 4)) for (d, _), x in zip(rows, brute_perplexity([t for _, t in rows]), strict=True)), key=key)
        got = sorted(((r["doc_id"], None if r["log_ppl"] is None else round(r["log_ppl"], 4)) for r in quality.judge(df, **options).collect()), key=key)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 2e-3) for (_, a), (_, b) in zip(got, want, strict=True))


def test_quality_bands(spark, docs):
    got = quality.judge(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for lang in {r["lang"] for r in got}:
        fine = [r for r in got if r["lang"] == lang and not r["base_failed"]]
        x = sorted(r["log_ppl"] for r in fine)
        low, mid, high = (x[max(0, math.ceil(len(x) * q) - 1)] for q in (0.25, 0.5, 0.75))
        for r in fine:
            assert r["kept"] == (mid + quality.BAND * (low - mid) <= r["log_ppl"] <= mid + quality.BAND * (high - mid))


def test_quality_wide_alphabets():
    import numpy as np

    text = "".join(chr(0x4E00 + i) for i in range(9000)) + " ab ab"
    rows, which, ends = quality.ngrams(*quality.code_points([text, "", "ab"]))
    assert ["".join(map(chr, r)) for r in rows[which[:3]]] == [f"{' ' * (4 - i)}{text[: i + 1]}" for i in range(3)]
    assert ends.tolist() == [0, len(text), len(text), len(text) + 2] and "".join(map(chr, rows[which[-1]])) == "   ab"
    assert len(np.unique(quality.gram_hash(*quality.two_longs(rows)))) == len(rows)


def test_quality_rejects_noise(spark, docs, sf_dir):
    import random

    rng = random.Random(2)
    noise = [(10**9, "".join(rng.choice("qxzjkvwQXZJKVW0!?") + rng.choice(["", "", " "]) for _ in range(1200)))]
    both = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(*r, "en") for r in noise], "doc_id long, text string, lang string"))
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(both).collect()}
    assert not any(kept[i] for i, _ in noise)
    good = [r["doc_id"] for r in read_table(spark, sf_dir, "labels").where("quality = 1").collect()]
    base = {r["doc_id"] for r in quality.judge(docs).where("base_failed").collect()}
    fine = [d for d in good if d not in base]
    assert sum(kept[d] for d in fine) / len(fine) > 0.95


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def mutate(rng, t, n):
    for _ in range(n):
        i = rng.randrange(len(t) + 1)
        t = rng.choice([t[:i] + rng.choice("abé𝒳 ") + t[i:], t[:i] + t[i + 1 :], t[:i] + rng.choice("xyz") + t[i + 1 :]])
    return t


def test_banded_distance(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(400):
        a = "".join(rng.choice("abcdé𝒳") for _ in range(rng.randrange(8, 60)))
        b = mutate(rng, a, rng.randrange(0, 5))
        rows.append((i, max(a, b, key=len), min(a, b, key=len)))
    for edits in (1, 2, 3):
        df = spark.createDataFrame(rows, "i int, longer string, shorter string")
        assert {r["i"] for r in lines.verified(df, edits, 8).collect()} == {i for i, a, b in rows if edit_distance(a, b) <= min(edits, len(b) // 8)}


def test_lines(spark):
    import random

    rng = random.Random(4)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(38, 70))) for _ in range(25)] + ["short", "shart", "  ", "", "naïve " * 9, "nineteen characters", "ninetaen characters", "one of twenty letter", "one of twenty lettar", "one of twenty letters"]
    rows = [(i, "\n".join(mutate(rng, x, rng.choice([0, 0, 0, 1, 2, 3])) if len(x) > 30 else x for x in rng.sample(base, rng.randrange(1, 8)))) for i in range(80)]
    for n in (19, 20, 21, 38, 39, 40, 41, 42, 43):  # about the lengths where the allowance changes
        x = "".join(rng.choice("abcde ") for _ in range(n))
        rows += [(1000 * n + i, mutate(rng, x, i % 4)) for i in range(8)]
    rows += [(None, base[0]), (None, base[0]), (5, rows[5][1]), (81, None), (82, "")]
    df = table(spark, rows)
    for edits in (2, 1):
        seen, kept = [], {}
        order = lambda r: (r[0] is not None, r[0] or 0)
        for d, t in sorted(dict.fromkeys(rows), key=order):
            out = []
            for x in (t or "").split("\n"):
                if SPACE.search(x):
                    if not any(x == y or (abs(len(x) - len(y)) <= edits and edit_distance(x, y) <= min(edits, len(x) // 20, len(y) // 20)) for y in seen):
                        out.append(x)
                    seen.append(x)
                else:
                    out.append(x)
            kept[d, t] = "\n".join(out)
        got = [(r["doc_id"], r["kept_text"]) for r in lines.dedup_lines(df, edits).collect()]
        assert sorted(got, key=key) == sorted(((d, kept[d, t]) for d, t in rows), key=key)
    assert lines.dedup_lines(df.where("false")).count() == 0
