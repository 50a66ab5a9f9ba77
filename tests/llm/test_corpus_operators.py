"""Parts of the operators, and what queries don't show."""

import random
import string

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackloom.llm import decontam, langid, linededup, secrets, shards, simhash, spbpe, tokencount, toxicity
from trackloom.llm.common import TwoAges, new_path

ODD = st.text(st.one_of(st.sampled_from(list("abeth \n\t▁é0ß日😀́\x1c '<|>")), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_pieces_like_the_library(text):
    sp = test_pieces_like_the_library.__dict__.setdefault("sp", sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")))
    t = spbpe.table(public_tokenizers.path("piece_bpe_32k.model"))
    ids = sp.encode(text)
    assert t.encode(text) == ids
    assert t.summary(text) == (len(ids), ",".join(map(str, ids)), sp.decode(ids))
    assert t.decode(ids) == sp.decode(ids)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_counts_like_the_library(text):
    own = test_counts_like_the_library.__dict__.setdefault("t", tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert tokencount.merger(public_tokenizers.path("byte_bpe_50k.json")).count(text) == len(own.encode(text, add_special_tokens=False).ids)


def test_ids_and_decoded_columns(spark):
    df = spark.createDataFrame([(1, "Hello there"), (2, None), (3, "")], "doc_id long, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in spbpe.with_decoded(spbpe.with_ids(df, path), path).collect()}
    assert got[1].decoded == "Hello there" and got[2].ids == [] and got[3].decoded == ""


def test_memo_is_bounded():
    m = TwoAges(10)
    for k in range(1000):
        m.put(k, k)
    assert len(m.young) <= 10 and len(m.old) <= 10 and m.young[999] == 999


def test_golay_covering():
    low, high, levels = simhash.golay_tables()
    assert (levels[0] >= 0).sum() == 2048 and levels[0].shape[1] == 1  # perfect: one word within the radius
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 400, dtype=np.uint64)
    home = dict(zip(*simhash.anchors(x, 0), strict=True))
    assert len(home) == 400
    for bits in ([], [3], [7, 60], [0, 22], [5, 30], [24, 45], [63, 62]):
        y = x.copy()
        for b in bits:
            y ^= np.uint64(1 << b)
        i, a = simhash.anchors(y, 2)
        visits = set(zip(i.tolist(), a.tolist(), strict=True))
        assert all((k, home[k]) in visits for k in range(400))
        assert 50 < len(i) / 400 < 75


def test_links_against_brute_force(spark):
    rnd = random.Random(2)
    own = {rnd.getrandbits(64) for _ in range(300)}
    for base in list(own)[:25]:
        for _ in range(12):
            f = base
            for _ in range(rnd.randint(1, 3)):
                f ^= 1 << rnd.randrange(64)
            own.add(f)
    own = sorted(own)
    signed = [f - 2**64 if f >= 2**63 else f for f in own]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for j, b in enumerate(signed) if i < j and (own[i] ^ own[j]).bit_count() <= 2}
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fingerprint long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_single_characters_need_no_comparison():
    path = public_tokenizers.path("piece_bpe_32k.model")
    table, sp = spbpe.PrefixTable(path), sentencepiece.SentencePieceProcessor(model_file=path)
    asked, plain = [], table.compatible
    table.compatible = lambda a, b: asked.append(b) or plain(a, b)
    for text in ("qzxv wkjq zzzz", "aaaa    bbb▁▁c", "xqéßjq 日本語 😀q", "Unverständlichkeiten oeuvre"):
        assert table.encode(text) == sp.encode(text)
    assert asked and all(len(table.piece[b]) > 1 for b in asked)


def test_replicas_at_anchors_are_not_broadcast(spark):
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1 << 20
    found = simhash.links(spark.range(1000).select(F.xxhash64("id").alias("fingerprint")))
    assert found.collect() is not None
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_components_of_a_long_chain(spark):
    ids = list(range(60))
    random.Random(4).shuffle(ids)
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(ids, ids[1:], strict=False)] + [(100, 101), (101, 103)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {got[i] for i in range(60)} == {0} and got[103] == got[101] == 100


def test_one_row_of_each_component_stays(spark):
    rows = [(5, "some words that are here", "x"), (2, "some words that are here", "x"), (2, "some words that are here", "x"), (2, "quite another text under the same id", "y"), (None, "a text without an id stays", "z"), (None, "a text without an id stays", "z"), (9, None, "n"), (8, "", "n")]
    got = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, removed string")).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, [(2, "some words that are here"), (2, "quite another text under the same id"), (None, "a text without an id stays"), (8, "")]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), st.integers(1, 4), st.randoms(use_true_random=False))
def test_wu_manber(words, m, rnd):
    patterns = [tuple(rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(m)) for _ in range(6)]
    own = decontam.WuManber([w for p in patterns for w in p], [(k * m, k) for k in range(6)], m)
    found = [(at, k) for at in range(len(words) - m + 1) for k, p in enumerate(patterns) if tuple(words[at : at + m]) == p]
    assert sorted(own.search(words)) == found


def test_items_of_any_length(spark, monkeypatch):
    """Items are cut, dealt to blocks, and found as if they weren't."""
    rnd = random.Random(4)
    items = [(k, " ".join(f"w{rnd.randrange(4000)}" for _ in range(n))) for k, n in enumerate((3, 9, 10, 25, 26, 27, 400, 3000))]
    items += [items[6], (None, items[3][1])]
    docs = [(0, items[7][1]), (1, " ".join(items[6][1].split()[100:130])), (2, "w1 " + items[0][1] + " w2"), (3, None), (4, " ".join(items[7][1].split()[-10:])), (5, " ".join(items[3][1].split()[:9]))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((r.doc_id, r.n_hit, r["items"]) for r in decontam.find_benchmark(df, bench).collect())
    assert [w[1] for w in want][:5] == [3000, 30, 3, 0, 10] and want[0][2] == ["7"]
    monkeypatch.setattr(decontam, "PIECE", 26)
    for chars in (1 << 20, 6000):
        assert sorted((r.doc_id, r.n_hit, r["items"]) for r in decontam.find_benchmark(df, bench, block_chars=chars).collect()) == want


def test_line_dedup_removes_later_windows_only(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "b\nc\nd\nz"), (4, "a\nb"), (5, "k\nk\nk\nk\nk"), (6, None), (7, "\n\n\n\n")]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].text for i in range(1, 8)] == ["a\nb\nc\nd", "x\ny", "z", "a\nb", "k", None, "\n\n\n\n"]
    assert [(s.start, s.end) for s in got[2].removed] == [(1, 4)] and got[6].n_lines == 0


#: The least share of random strings of 24 or more, of 32 or more, and of 48 or more characters that must be found.
RECALL = ((24, 0.85), (32, 0.92), (48, 0.96))


@pytest.mark.parametrize("letters", [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", secrets.UPPER + "234567", secrets.DIGITS + secrets.LOWER, secrets.DIGITS + secrets.UPPER, secrets.DIGITS + "ABCDEF", secrets.LOWER])
def test_random_strings_are_found(letters):
    rnd = random.Random(len(letters))
    for n in (24, 28, 32, 40, 48, 64):
        keys = ["".join(rnd.choice(letters) for _ in range(n)) for _ in range(200)]
        found = sum(secrets.discoveries([(0, n, t)]) == [(0, n)] for t in keys)
        assert found >= 200 * max(r for least, r in RECALL if n >= least)


def test_written_strings_are_not_found():
    plain = ["thisIsAnOrdinaryIdentifierName", "some_quite_long_snake_case_name", "usr/local/lib/python/site-packages", "internationalization" * 2, "12345678901234567890", "aaaaaaaaaaaaaaaaaaaaaaaa", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "CONSTANT_NAME_IN_CAPITALS", "com/example/project/module/FileName", "item-2024-11-28-0001-rev2", "0000000000000000000000"]
    assert not any(secrets.discoveries([(0, len(t), t)]) for t in plain)


def test_stretches_are_cut_at_base_spans():
    rnd = random.Random(6)
    a, b = ("".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(60)) for _ in range(2))
    a, b = a[:-1] + "Z", "Q" + b[1:]
    text = f"the key {a}{'0123456789abcdef' * 2}{b} and password=abcdef012345 ok"
    assert secrets.scan(text) == [(8, 3, 68), (68, 2, 100), (100, 3, 160), (165, 0, 186)]
    assert list(secrets.outside(0, 10, [(2, 4), (3, 5), (9, 12)])) == [(0, 2), (5, 9)] and list(secrets.outside(3, 5, [(0, 9)])) == []
    assert secrets.scan(None) == [] == secrets.scan("")


def test_masking(spark):
    df = spark.createDataFrame([("a password=abcdef012345 b",), (None,), ("",)], "text string")
    assert [r.text for r in secrets.without_secrets(df).collect()] == ["a [secret] b", None, ""]


def test_language_margins():
    en, de = ("the of and to in that was his with for on are as they " * 60).encode(), ("der die und in den von zu das mit sich des auf ist im dem " * 60).encode()
    c = langid.Classifier([("en", en), ("de", de)])
    assert c.predict("that was with the and for his in the")[0] == "en"
    assert c.predict("das ist mit der und von dem zu den")[0] == "de"
    assert not c.predict("zz")[2]
    assert c.predict("123 !?") == ("und", 0.0, False) == c.predict(None)
    assert langid.Classifier([]).predict("abc")[0] == "und"


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 47, 48, 49, 200):
        stream, first, owner = toxicity.windows(np.array([n, 3]))
        seen = set(stream[(first[owner == 0][:, None] + np.arange(toxicity.SPAN)).reshape(-1)].tolist()) if n else set()
        assert set(range(n)) <= seen
        assert (owner == 1).sum() == 1 and (owner == 0).sum() == (0 if not n else max(0, -(-(n - 32) // 16)) + 1)


def test_words_and_their_bytes():
    long = "x" * 60
    own = toxicity.Words(["An id*t, an ID*T!", None, "", f"{long} é ***"])
    spelt = [bytes(b[b > 0]).decode() for b in own.bytes]
    assert own.count.tolist() == [4, 0, 0, 4]
    assert [spelt[k] for k in own.which] == ["an", "id*t", "an", "id*t", "x" * 24, "x" * 24, "x" * 12, "é"]


def test_gradients():
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(rng.choice(list(string.ascii_lowercase[:6]), rng.integers(1, 9))) for _ in range(40)) for _ in range(12)]
    own = toxicity.Words(texts)
    vocabulary = toxicity.vocabulary_of(own.hash, np.bincount(own.which), 50)
    net = toxicity.Network(vocabulary, rng.standard_normal(len(vocabulary.keys) + 1), np.zeros((0, toxicity.LONGEST), np.uint8))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    index = vocabulary(own.hash)
    place = own.which[np.arange(5 * 32).reshape(5, 32)]
    place[2, 20:] = -1
    label = np.array([1, 0, 1, 0, 1.0])

    def loss():
        x = net.embed(index, net.told[index], own.bytes)
        z = net.logits(x, np.where(place >= 0, place, len(x)).reshape(-1), np.arange(5) * 32)
        return float(np.mean(np.log1p(np.exp(-np.where(label == 1, z, -z)))))

    grad = net.gradients(place, index, net.told[index], own.bytes, label)
    for name, v in net.p.items():
        used = np.argwhere(np.abs(grad[name]) > 1e-6) if name[:4] in ("word", "char") else np.argwhere(np.ones(v.shape))
        for k in rng.permutation(used)[:5]:
            k = tuple(k)
            old = v[k]
            v[k] = old + 1e-2
            up = loss()
            v[k] = old - 1e-2
            down = loss()
            v[k] = old
            assert grad[name][k] == pytest.approx((up - down) / 2e-2, abs=2e-4), name


def test_misspelt_words_are_known():
    """Toxic words with a letter inside replaced or doubled, in texts that the network hasn't seen."""
    rnd = random.Random(3)
    fresh = lambda: "".join(rnd.choice("th er on an re he in ed nd ha at es".split()) for _ in range(rnd.randint(1, 3)))
    insults = ["dreadful", "blockhead", "numbskull", "wretched", "scoundrel"]

    def text(bad):
        w = [fresh() for _ in range(rnd.randint(10, 90))]
        for _ in range(3 * bad):
            w.insert(rnd.randrange(len(w)), rnd.choice(insults))
        return " ".join(w)

    labels = [k % 2 for k in range(400)]
    net = toxicity.train([text(y) for y in labels], labels)
    fold = lambda t, f: " ".join(w[:3] + f(w[3]) + w[4:] if len(w) > 4 else w for w in t.split())
    for way in (lambda c: c, lambda c: "*", lambda c: c + c):
        got = net.scores([fold(text(k % 2), way) for k in range(100)]) >= 0.5
        assert got[1::2].sum() >= 45 and got[::2].sum() <= 3


def test_no_labels_no_network(spark, sf_empty):
    docs, labels = (spark.read.parquet(f"{sf_empty}/{n}.parquet") for n in ("documents", "labels"))
    assert toxicity.fit(docs, labels, F.lit(True)) is None
    df = spark.createDataFrame([(1, "idiot")], "doc_id long, text string")
    assert toxicity.with_toxicity(df, None).first().toxicity == 0.0


def test_shard_store(spark):
    store = shards.ShardStore(spark, new_path(spark, "store"), target_bytes=40_000, fan=3)
    assert store.read().count() == 0
    rows = spark.range(4000).withColumn("text", F.sha2(F.col("id").cast("string"), 256))
    for k in range(7):
        store.append(rows.where(F.col("id") % 7 == k).repartition(2))
    before = store.manifest()
    assert before.version == 7 and len(before.shards) == 14 and sum(s.rows for s in before.shards) == 4000
    after = store.compact()
    assert after.version > 7 and len(after.shards) < 14
    assert sorted(r.id for r in store.read().collect()) == list(range(4000))
    assert sorted(r.id for r in store.read(7).collect()) == list(range(4000))  # old versions stay readable until vacuumed
    assert store.vacuum() > 0 and store.versions() == [after.version]
    assert store.read().count() == 4000
    assert store.compact() == after  # nothing left to merge


def test_commits_are_exclusive(spark):
    root = new_path(spark, "store")
    a, b = shards.ShardStore(spark, root), shards.ShardStore(spark, root)
    now = a.manifest()
    a.commit(shards.Manifest(now.version + 1, None, ()))
    with pytest.raises(shards.Conflict):
        b.commit(shards.Manifest(now.version + 1, None, ()))
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert b.append(df).version == 2  # tried anew on the newest version
    assert b.append(df.limit(0)).version == 3 and b.read().count() == 1
