"""Sketches, hard negatives and whitening against brute force, with odd rows, hot copies and lists of any size."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trackloom.llm import negatives, sketch, succession, vectors, whitening
from trackloom.llm import queries as q
from trackloom.llm.common import stage_table


def hashes(text):
    """All distinct shingle hashes: words hashed, then five of the hashes in turn as 8-byte numbers."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    own = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    out = set()
    for k in range(max(1, len(own) - 4) if own else 0):
        h = 42
        for v in own[k : k + 5]:
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return out


def bottom(values, k=sketch.K):
    return sorted(values)[:k]


def likeness(a, b, k=sketch.K):
    both = bottom(set(a) | set(b), k)
    return len(set(both) & set(a) & set(b)) / len(both) if both else 1.0


def spelled(values):
    return base64.b64encode(b"".join((v % (1 << 64)).to_bytes(8, "big") for v in values)).decode()


def tie(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_fingerprints(spark, sf, rows):
    docs = sorted(((i, t or "") for i, t, *_ in rows[0]), key=lambda d: (d[0] is None, d[0] or 0, tie(d[1])))
    want = []
    for at, (i, t) in enumerate(docs):
        nxt = docs[(at + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = (bottom(hashes(x)) for x in (t, edited, nxt))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), spelled(a), spelled(b), likeness(a, b), likeness(a, c)))
    got = [tuple(r[:5]) + (r.near_edited, r.near_next) for r in q.op11_fingerprints(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_next_row_over_many_buckets(spark, monkeypatch):
    """Clustered and sparse ids, null ids, several upper buckets."""
    monkeypatch.setattr(succession, "ROWS", 3)
    monkeypatch.setattr(succession, "BUCKETS", 4)
    rnd = random.Random(3)
    for ids in (list(range(-5, 60)), [rnd.randint(-(1 << 62), 1 << 62) for _ in range(50)], [1, 2, 3, 10**15] + [None] * 40, [7], [None] * 9, [None]):
        own = [(i, f"t{k}") for k, i in enumerate(ids)]
        rnd.shuffle(own)
        df = spark.createDataFrame(own, "i bigint, t string")
        got = {r.t: r.n for r in succession.with_next(df, "i", ("t",), {"t": "n"}).collect()}
        order = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, tie(r[1])))
        assert got == {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_sketch_estimates(spark):
    """Merging parts gives the sketch of the whole; estimates stay within five standard errors."""
    rnd = random.Random(2)
    words = [f"w{rnd.randint(0, 10**6)}" for _ in range(9000)]
    a, b = " ".join(words[:6000]), " ".join(words[3000:])
    df = spark.createDataFrame([(a, b)], "a string, b string").select(sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"))
    r = df.select(sketch.resemblance("a", "b").alias("j"), sketch.containment("a", "b").alias("c"), sketch.distinct(F.col("a")).alias("n")).first()
    true = len(hashes(a) & hashes(b)) / len(hashes(a) | hashes(b))
    assert abs(r.j - true) < 5 * math.sqrt(true * (1 - true) / sketch.K)
    assert abs(r.c - 0.5) < 0.35 and abs(r.n / 5996 - 1) < 5 / math.sqrt(sketch.K)
    parts = [(g, " ".join(rnd.choices(words, k=40))) for g in ("x", "x", "x", "y") for _ in range(6)] + [("z", ""), (None, "one")]
    got = {r.g: r.sketch for r in sketch.merged(sketch.with_sketch(spark.createDataFrame(parts, "g string, text string")), ["g"]).collect()}
    assert got == {g: bottom(set().union(*(hashes(t) for h, t in parts if h == g))) for g in {p[0] for p in parts}}


def steps(x):
    return [math.floor(256 * np.float64(np.float32(c))) for c in x]


def taking_part(rows, dims=6):
    return [(i, steps(x), y) for i, x, y in rows if x is not None and len(x) == dims and all(c is not None and math.isfinite(c) for c in x)]


def negatives_by_hand(rows, anchors, n_pos, n_neg, low, high):
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out, done = [], set()
    for i, x, y in rows:
        if i is None or not anchors(i) or (i, tuple(x), y) in done:
            continue
        done.add((i, tuple(x), y))
        scored = [(j, sum(a * b for a, b in zip(x, v, strict=True)), z) for j, v, z in rows]
        for p in sorted((s for s in scored if s[2] == y and s[0] != i), key=order)[:n_pos]:
            inside = sorted((s for s in scored if s[2] != y and low * p[1] <= 100 * s[1] <= high * p[1]), key=order)[:n_neg]
            out += [(i, p[0], k + 1, s[0], p[1], s[1]) for k, s in enumerate(inside)]
    return sorted(out, key=repr)


def test_hard_negatives(spark, sf, vecs):
    rows = [(i, x, (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, x, y in taking_part(vecs) if y is not None]
    got = sorted((tuple(r) for r in q.op12_hard_negatives(spark, sf).collect()), key=repr)
    assert got == negatives_by_hand(rows, lambda i: i % 50 == 0, 5, 3, 50, 95) and len(got) > 50


@pytest.mark.parametrize("scale", [1, 1 << 12, 1 << 20])
def test_hard_negatives_over_small_blocks(spark, monkeypatch, scale):
    """Many blocks, parts and lists that the first visits leave out; numbers beyond 32 and 64 bits of a float."""
    for name, value in {"BLOCK": 40, "PART": 5, "FIRST": 2, "CELLS": 100}.items():
        monkeypatch.setattr(negatives, name, value)
    rnd = random.Random(4)
    mid = [[rnd.randint(-300, 300) for _ in range(4)] for _ in range(9)]
    rows = [(k, [scale * (m + rnd.randint(-20, 20)) for m in mid[k % 9]], k % 4) for k in range(240)]
    df = spark.createDataFrame([(i, y, x) for i, x, y in rows], "id bigint, label int, x array<bigint>")
    got = sorted((tuple(r) for r in negatives.mine(df, F.col("id") % 20 == 0, 4, 6, 30, 99, lists=12).collect()), key=repr)
    assert got == negatives_by_hand(rows, lambda i: i % 20 == 0, 4, 6, 30, 99)


def test_search_leaves_lists_out(spark):
    """Far clusters aren't visited."""
    rnd = random.Random(6)
    mid = [[1000 * math.cos(k), 1000 * math.sin(k)] for k in range(20)]
    rows = [(k, k % 3, [round(m + rnd.randint(-5, 5)) for m in mid[k % 20]]) for k in range(600)]
    own = stage_table(spark.createDataFrame(rows, "id bigint, label int, x array<bigint>"), "rows")
    index = negatives.build(own, 60)
    asked = own.where("id < 40").select(F.col("id").alias("anchor_id"), F.xxhash64("id").alias("key"), "label", "x", F.lit(0).alias("part"), F.array(F.lit(-negatives.NO_ID)).alias("lo"), F.array(F.lit(negatives.NO_ID)).alias("hi"), F.array(F.lit(900_000)).alias("least"))
    late = negatives._visits(index, asked, False).count()
    assert late < 0.2 * 40 * index.blocks.sum()


def whitened_by_hand(rows, k):
    once = np.array(sorted({tuple(x) for _, x, _ in rows}), dtype=np.float64)
    n, s = len(once), [sum(int(v) for v in c) for c in once.T]
    v = np.cov(once.T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return {(i, c + 1, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))): (abs((np.array(x) - np.array(s) / n) @ u[:, c] / math.sqrt(e[c])), e[c] / np.trace(v), n) for i, x, _ in rows for c in range(k)}


def test_whitening(spark, sf, vecs):
    rows = taking_part(vecs)
    want = whitened_by_hand(rows, 4)
    got = q.op13_whitening(spark, sf).collect()
    assert len(got) == 4 * len(rows)
    for r in got:
        w, share, n = min((v for key, v in want.items() if key == (r.vec_id, r.component, r.deviation)), key=lambda v: abs(v[0] - abs(r.whitened)))
        assert abs(abs(r.whitened) - w) < 1e-9 and abs(r.explained / share - 1) < 1e-9 and r.n == n and r.identity_error < 1e-9
    for c in range(1, 5):  # the same sign for all rows: whitened vectors of distinct rows have mean 0
        own = {r.vec_id: r.whitened for r in got if r.component == c and r.vec_id is not None and r.vec_id % 3}
        assert min(own.values()) < 0 < max(own.values())


def test_whitening_of_few_and_of_large_vectors(spark):
    made = lambda rows: whitening.fit(spark.createDataFrame([(x,) for x in rows], "x array<bigint>"))
    assert made([]) is None
    model, once = made([[3, 4]] * 5)
    assert model.n == 1 and whitening.identity_error(once, model, 2) == 1.0
    assert [tuple(r) for r in whitening.apply(once, model, 4).collect()] == [(0, [0.0, 0.0])]
    big = 1 << 40
    model, once = made([[big, 0], [0, big], [-big, 1], [5, 7]])
    sums = [sum(c) for c in zip([big, 0], [0, big], [-big, 1], [5, 7], strict=True)]
    assert list(model.sums) == sums and whitening.identity_error(once, model, 2) < 1e-9
    assert all(r.deviation is None for r in whitening.apply(once.where("x[0] != 5"), model, 2).collect())  # 2^82
    small = spark.createDataFrame([([5, 7],)], "x array<bigint>")
    want = sum((4 * a - b) ** 2 for a, b in zip([5, 7], sums, strict=True))
    assert [r.deviation for r in whitening.apply(small, model, 2).collect()] == [want if want < 1 << 63 else None]


def test_vectors_without_dimension(spark):
    none = spark.createDataFrame([(1, None), (2, []), (3, [float("inf")])], "i int, v array<double>")
    assert vectors.integer_vectors(none, "v").collect() == []
    mixed = spark.createDataFrame([(1, [0.5]), (2, [1.0, -0.001]), (3, [2.0])], "i int, v array<double>")
    assert [(r.i, r.x) for r in vectors.integer_vectors(mixed, "v").orderBy("i").collect()] == [(1, [128]), (3, [512])]
