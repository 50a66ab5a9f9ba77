"""Near copies of the pipeline against all pairs of shingle sets."""

import random

import numpy as np

import corpus_pipeline
from test_corpus_queries import brute_components, brute_print
from trackloom.llm import common, nearcopies, simhash
from trackloom.llm.common import row_key


def changed(words, at):
    return " ".join("new" if k in at else w for k, w in enumerate(words))


def texts(rnd):
    out = [None, "", " \n", "a b", "A  b", "one two three four five", "one two three four five six"]
    for g in range(12):
        w = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.choice((30, 120, 400)))]
        out += [" ".join(w)] * 2 + [changed(w, {rnd.randrange(len(w)) for _ in range(k)}) for k in range(1, 9)]
    hot = [f"h{k}" for k in range(100)]
    out += [changed(hot, {k}) for k in range(100)]  # one large group
    out += [" ".join(hot[:40] + [f"x{i}y{k}" for k in range(60)]) for i in range(20)]  # a passage they have in common, and nothing else
    return out


def brute(own):
    """The component of each text, by all pairs."""
    sets = [frozenset(nearcopies.shingles(t).tolist()) for t in own]
    prints = brute_components(brute_print(t) for t in own)
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            alike = prints[brute_print(own[a])] == prints[brute_print(own[b])]
            if alike or sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return [find(k) for k in range(len(own))]


def test_near_copies_against_all_pairs(spark):
    own = texts(random.Random(3))
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    least = {}
    for i, r in enumerate(brute(own)):
        least.setdefault(r, i)
    got = nearcopies.without_near_copies(df)
    assert sorted(r.doc_id for r in got.collect()) == sorted(least.values())


def test_stage_drops_copies_with_changed_words(spark, sf):
    w = [f"w{random.Random(k).randint(0, 9999)}" for k in range(300)]
    pair = [" ".join(w), changed(w, {20, 90, 160, 230})]
    assert (simhash.fingerprint(pair[0]) ^ simhash.fingerprint(pair[1])).bit_count() > simhash.THRESHOLD
    df = spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_copies(spark, df, sf).collect()] == [0]


def test_cells_find_partners_and_join_roots_once():
    rnd = random.Random(7)
    base = [f"w{k}" for k in range(200)]
    own = [changed(base, set(rnd.sample(range(200), rnd.randint(0, 6)))) for _ in range(300)]
    sets = [nearcopies.shingles(t) for t in own]
    right, root = np.array([k % 2 == 1 for k in range(300)]), np.array([k if k % 5 else 0 for k in range(300)])
    similar = {(a, b) for a in range(0, 300, 2) for b in range(1, 300, 2) if root[a] != root[b] and 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    place = np.array([len(s) * nearcopies.PLACE for s in sets])
    hit = nearcopies.may_meet(right, place, root, [nearcopies.parities(s) for s in sets], 0.8)
    assert all(hit[a] and hit[b] for a, b in similar)
    found = nearcopies.joining_links(right, root, np.array([len(s) for s in sets]), np.concatenate(sets).view(np.int64), 0.8)
    assert set(found) <= similar and len(found) < len(set(root.tolist())) < len(similar)
    parts = [simple_components(root.tolist(), pairs) for pairs in (found, similar)]
    assert parts[0] == parts[1]


def simple_components(root, pairs):
    label = list(root)
    for a, b in pairs:
        old, new = label[a], label[b]
        label = [new if x == old else x for x in label]
    return {frozenset(k for k, x in enumerate(label) if x == y) for y in label}


def test_cells_cut_by_batches():
    import pyarrow as pa

    keys = [(1, 0, 0)] * 3 + [(1, 0, 1)] * 4 + [(2, 0, 0)] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*keys, strict=True)], names=list(nearcopies.CELL))
    for step in (1, 2, 5, 12):
        got = [c.num_rows for c in nearcopies.each_cell(batch.slice(k, step) for k in range(0, 12, step))]
        assert got == [3, 4, 5]


def test_fingerprint_links_of_the_stage_keep_replicas_from_the_driver(spark, monkeypatch):
    plans, plain = [], simhash.links

    def seen(prints, *more):
        found = plain(prints, *more)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(simhash, "links", seen)
    own = [(k, " ".join(f"w{k}x{i}" for i in range(20))) for k in range(30)]
    keyed = spark.createDataFrame(own, "doc_id long, text string").select("*", *row_key("doc_id", "text"))
    nearcopies.near_copies(keyed, "doc_id", "text")
    assert plans and not any("Broadcast" in p for p in plans)


def test_tables_that_grow_with_the_documents_stay_from_the_driver(spark, monkeypatch):
    plans, plain = {}, common.stage_table

    def seen(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label)

    for module in (common, nearcopies):
        monkeypatch.setattr(module, "stage_table", seen)
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)  # as if there were more rows to look up
    own = list(enumerate(texts(random.Random(3))[:30]))
    got = nearcopies.without_near_copies(spark.createDataFrame(own + own[9:12], "doc_id long, text string"))
    plans["result"] = [got._jdf.queryExecution().executedPlan().toString()]
    del plans["shared-shingles"]  # common shingles of the sample are bounded
    assert {"sets", "bounded-pairs", "roots", "cells", "set-apart", "result"} <= set(plans)
    assert [k for k, own in plans.items() if any("Broadcast" in p for p in own)] == []
