"""Every stage against plain Python over what the one before kept."""

import math
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from matchloom.llm import queries, simhash, toxicity
from test_exact import normal
from test_mixing import water_filled
from test_simhash import brute_components


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
    return out


def test_columns(kept):
    for df in kept[1:-1]:
        assert df.columns == kept[0].columns and df.dtypes == kept[0].dtypes


def test_toxic_documents_go(spark, sf_dir, kept):
    model = queries.toxicity_model(kept[0], spark, sf_dir)
    scores = {r.id: r.score for r in toxicity.score(kept[0], model).collect()}
    assert {r.doc_id for r in kept[1].collect()} == {d for d, s in scores.items() if s < 0.7}


def test_one_of_equal_texts_stays(kept):
    best = {}
    for r in kept[1].collect():
        mine = (-len(r.text or ""), r.doc_id)
        best[normal(r.text)] = min(mine, best.get(normal(r.text), mine))
    assert sorted(r.doc_id for r in kept[2].collect()) == sorted(d for _, d in best.values())


def test_one_of_near_texts_stays(kept):
    prints = {r.doc_id: simhash.fingerprint(r.text, 3) for r in kept[2].collect()}
    assert sorted(r.doc_id for r in kept[3].collect()) == sorted(set(brute_components(prints, 3).values()))


def test_sources_come_near_their_targets(kept):
    words = lambda t: len((t or "").encode().split())
    sizes, taken, texts = defaultdict(int), defaultdict(int), {}
    for r in kept[3].collect():
        sizes[r.source] += words(r.text)
        texts[r.doc_id] = r
    for r in kept[4].collect():
        taken[r.source] += words(r.text)
        whole = texts[r.doc_id]
        assert r.text == whole.text or whole.text.split()[: words(r.text)] == r.text.split()
        assert r.n_chars == len(r.text)
    targets = water_filled(sizes, [3, 1, 2], 1.5, 2.0)
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items())


def test_sequences_hold_the_mix(kept):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2] for r in kept[4].collect())
    pieces, rows = defaultdict(list), kept[5].collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for parts in sequences.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    assert sum(len(i) for p in pieces.values() for _, i in p) == sum(map(len, want))
    by_doc = defaultdict(list)
    for ids in want:
        by_doc[len(ids), tuple(ids[:5])].append(ids)
    for (_, n), parts in pieces.items():
        firsts = [ids for start, ids in parts if start == 0]
        assert firsts and all((n, tuple(f[:5])) in by_doc or len(f) < 5 for f in firsts)
    assert math.isclose(sum(n for p in sequences.values() for _, n in p), sum(map(len, want)))


def test_run_gives_the_last_stage(spark, sf_dir, kept):
    """Which pieces there are depends on how the rows are split over files, not which tokens."""
    whole = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id").agg({"length": "sum"}).collect())
    assert whole(corpus_pipeline.run(spark, sf_dir)) == whole(kept[-1])


CLASHING = "_row _hash _copy _key _epoch _words _own_digest row key hash copy words position size taken digest row_key Text_ id fp".split()


def test_odd_rows_keep_their_columns(spark, sf_dir, odd):
    """Each stage on rows with nulls, copies, a long text and columns called what operators call theirs."""
    extra = [c for c in CLASHING if c not in odd.columns]
    docs = odd.selectExpr("*", *[f"concat_ws(':', '{c}', doc_id, source) AS `{c}`" for c in extra])
    was = {tuple(r) for r in docs.drop("text", "n_chars").collect()}
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf_dir).cache()
        assert left.columns == docs.columns and left.dtypes == docs.dtypes, name
        assert {tuple(r) for r in left.drop("text", "n_chars").collect()} <= was, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, left, sf_dir).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in left.collect()}
    assert {1, None, 6, 7} <= {p["doc_id"] for p in pieces}


def test_an_empty_table_goes_through(spark, sf_dir, empty):
    left = empty
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, sf_dir)
        assert left.collect() == [], name
