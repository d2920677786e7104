"""The pipeline, stage by stage, against brute force; and the hard cases through all stages."""

import collections
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lodestone.llm import toxicity  # noqa: E402
from lodestone.llm.common import read_table  # noqa: E402
from tests.llm.test_ops import HARD, SPACE, brute_print, components, edit_distance, key, table  # noqa: E402


def near(x, y):
    edits = min(2, min(len(x), len(y)) // 20)
    if not edits or abs(len(x) - len(y)) > edits:
        return False
    a, b = collections.Counter(x), collections.Counter(y)
    return (a - b).total() <= edits and (b - a).total() <= edits and edit_distance(x, y) <= edits


def brute_lines(docs):
    seen, by_length, out = set(), collections.defaultdict(list), {}
    for d in sorted(docs):
        left = []
        for x in docs[d].split("\n"):
            if not SPACE.search(x) or not (x in seen or any(near(x, y) for n in range(len(x) - 2, len(x) + 3) for y in by_length[n])):
                left.append(x)
            if SPACE.search(x) and x not in seen:
                seen.add(x)
                by_length[len(x)].append(x)
        out[d] = "\n".join(left)
    return out


def test_stages(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"]
    raw = read_table(spark, sf_dir, "documents")
    held = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    one = stages["toxicity"](spark, raw, sf_dir).cache()
    assert one.columns == raw.columns
    bad = {r["doc_id"] for r in toxicity.toxicity(raw, read_table(spark, sf_dir, "labels")).collect() if r["predicted"]}
    assert held(one) == {d: t for d, t in held(raw).items() if d not in bad}
    two = stages["line_dedup"](spark, one, sf_dir).cache()
    assert two.columns == raw.columns and held(two) == brute_lines(held(one))
    three = stages["simhash"](spark, two, sf_dir).cache()
    prints = {d: brute_print(t) for d, t in held(two).items()}
    root = components(prints)
    first = {}
    for d in sorted(prints):
        first.setdefault(root[prints[d]], d)
    assert three.columns == raw.columns and held(three) == {d: t for d, t in held(two).items() if d in first.values()}
    four = stages["decontamination"](spark, three, sf_dir).cache()
    assert four.columns == raw.columns and set(held(four)) <= set(held(three))
    pieces = stages["packing"](spark, four, sf_dir)
    whole = collections.Counter()
    for p in pieces.collect():
        whole[p["doc_id"]] += p["length"] - p["doc_tokens"] * (p["start"] == 0)
    assert set(whole) == set(held(four)) and not any(whole.values())
    run = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in run.select("doc_id").collect()} == set(held(four))


def test_hard_cases(spark, sf_dir):
    docs = table(spark, HARD)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = out
    left = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=key)
    ids = [d for d, _ in left if d is not None]
    assert len(ids) == len(set(ids)) and all(t is not None for _, t in left)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= len(left)
    empty = table(spark, HARD).where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0


def test_documents_of_one_item_go(spark, sf_dir):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    windows = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    items = [w for r in read_table(spark, sf_dir, "benchmark").collect() if (w := split(r["text"]))]
    known = {min(8, len(w)): set() for w in items}
    for w in items:
        known[min(8, len(w))] |= windows(w, min(8, len(w)))
    long = next(w for w in items if len(w) >= 12)
    rows = [(1, f"before it {' '.join(long[2:10])} after it"), (2, " ".join(long)), (3, " ".join(long[2:9])), (4, "nothing of it"), (None, " ".join(long)), (5, None)]
    plain = read_table(spark, sf_dir, "documents")
    for df in (table(spark, rows), plain):
        texts = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        clean = [(d, t) for d, t in texts if not any(known[n] & windows(split(t), n) for n in known)]
        assert len(clean) < len(texts)
        got = [(r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["decontamination"](spark, df, sf_dir).select("doc_id", "text").collect()]
        assert sorted(got, key=key) == sorted(clean, key=key)
