"""The pipeline against a brute-force version of its stages."""

import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline
from test_corpus_queries import WS, brute_components, brute_hits, brute_print, row_order
from trackloom.llm import queries, toxicity


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_hand(spark, sf, rows):
    docs, _, bench = rows
    net = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), ~queries.held_out(5, 0))
    left = [d[:2] for d, s in zip(docs, net.scores([d[1] for d in docs]), strict=True) if s < 0.5]
    seen, cut = set(), {}
    for d in sorted(set(left), key=lambda r: (r[0] is None, r[0] or 0, row_order(spark, r))):
        lines = d[1].split("\n") if d[1] is not None else []
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if "".join(w).strip(WS):
                gone |= {k, k + 1, k + 2} if w in seen else set()
                seen.add(w)
        new = None if d[1] is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        cut[d] = None if gone and not new.strip(WS) else (new,)
    left = [(i, cut[(i, t)][0]) for i, t in left if cut[(i, t)] is not None]
    prints = {d: brute_print(d[1]) for d in left}
    root = brute_components(prints.values())
    groups = {}
    for d in sorted(set(left), key=lambda r: (r[0] is None, r[0] or 0, row_order(spark, r))):
        groups.setdefault(root[prints[d]], d)
    left = [d for d in groups.values() if d[0] == 500 or not brute_hits(d[1], bench)[1]]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return sorted(((i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for i, t in left for ids in [sp.encode(t or "")]), key=repr)


def test_pipeline(spark, sf, rows):
    got = corpus_pipeline.run(spark, sf)
    own = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()), key=repr)
    assert own == by_hand(spark, sf, rows)
    assert all(len(r.ids) == r.n_tokens for r in got.collect())


def test_stages_keep_columns(spark, sf_clash):
    docs = spark.read.parquet(f"{sf_clash}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_clash)
        assert got.schema.simpleString() == docs.schema.simpleString(), name
        assert got.where("removed <> 'own' OR toxicity <> 'own' OR root <> 'own'").count() == 0 < got.count()


def test_empty(spark, sf_empty):
    assert corpus_pipeline.run(spark, sf_empty).collect() == []
