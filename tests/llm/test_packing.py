import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from matchloom.llm import queries
from matchloom.llm.packing import Limits, pack, pack_documents
from matchloom.llm.tokens import tokenized, word_tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_are_the_documents(spark, sf_dir, texts, plain):
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in queries.op4_vector_packing(spark, sf_dir).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids, at = np.array([*plain(text), 2], dtype="<u4"), 0
        for p in sorted(pieces[doc], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    used = padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
        used += at
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded <= 0.001 * used


@pytest.mark.parametrize(
    "text",
    ["", " ", "It's we'll don't", "A.b,c..., end.", "İstanbul ΣΑΣ ς", "a\x1c\x1db \x85  x", "é é ñ",
     "<|endoftext|> <|start", "a <|endoftext|> b", "x.<|startoftext|>é <|EndOfText|>. <|endoftext|>,", "naïve,Über. 12 x3", "\U0001f642 日本語 ﬁ", ".", ",.,", "ǅ ʰ"],
)
def test_cached_words_give_the_tokenizers_ids(text, plain):
    with open(PATH, encoding="utf-8") as f:
        words = word_tokenizer(f.read())
    for _ in range(2):
        assert np.frombuffer(words.text(text), dtype="<u4").tolist() == plain(text)


@pytest.mark.parametrize(
    "text", ["word).", 'word",', "100%.", "x!.", "?!...", "foo(bar),", "“é”.", "é).", "İ.", "क़.", "٣.", "a''s x'Re.", "a\x00b."]
)
def test_runs_of_marks_are_one_unit(text, plain):
    with open(PATH, encoding="utf-8") as f:
        words = word_tokenizer(f.read())
    for _ in range(2):
        assert np.frombuffer(words.text(text), dtype="<u4").tolist() == plain(text)


def test_conversations_keep_all_three_limits_uncut(spark, sf_dir):
    """Instruction data: a turn of the assistant bears loss, the turns before it do not."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr(
        "conv_id * 1000 + turn AS doc_id", "text", "CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS bears"
    )
    examples = tokenized(turns, PATH, 2).join(turns.selectExpr("doc_id AS id", "bears"), "id")
    examples = examples.selectExpr("id", "ids", "tokens", "tokens * bears AS loss_tokens")
    longest = examples.agg({"tokens": "max", "loss_tokens": "max"}).first()
    limits = Limits(2 * longest["max(tokens)"], 12, 2 * longest["max(loss_tokens)"])
    rows = pack(examples.coalesce(2), limits, cut=False, loss_col="loss_tokens").collect()
    assert sorted(r.id for r in rows) == sorted(r.id for r in examples.collect())
    sums = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        assert r.start == 0 and r.length == r.doc_tokens
        for k, x in enumerate((r.length, 1, r.loss)):
            sums[r.sequence_id][k] += x
    most = (limits.tokens, limits.segments, limits.loss_tokens)
    assert all(x <= m for s in sums.values() for x, m in zip(s, most, strict=True))
    total = [sum(s[k] for s in sums.values()) for k in range(3)]
    # No packing needs fewer sequences than the tightest limit asks for.
    least = max(t / m for t, m in zip(total, most, strict=True))
    assert len(sums) <= 1.15 * least + 8


def test_cutting_splits_the_loss(spark):
    docs = spark.createDataFrame([(1, "a " * 99), (2, "b " * 49)], "doc_id long, text string").coalesce(1)
    examples = tokenized(docs, PATH, 2).selectExpr("id", "ids", "tokens", "tokens div 2 AS l")
    rows = pack(examples, Limits(64, 4, 20), loss_col="l").collect()
    assert {i: sum(r.loss for r in rows if r.id == i) for i in (1, 2)} == {1: 50, 2: 25}
    assert {i: sum(r.length for r in rows if r.id == i) for i in (1, 2)} == {1: 100, 2: 50}
    for s in {r.sequence_id for r in rows}:
        own = [r for r in rows if r.sequence_id == s]
        assert sum(r.length for r in own) <= 64 and sum(r.loss for r in own) <= 20 and len(own) <= 4


def test_what_is_too_large_uncut_is_an_error(spark):
    docs = spark.createDataFrame([(1, "a " * 99)], "doc_id long, text string")
    with pytest.raises(Exception, match="beyond the limits"):
        pack(tokenized(docs, PATH, 2), Limits(64, 4, 64), cut=False).collect()


def test_odd_rows(odd, empty):
    rows = pack(tokenized(odd, PATH, 2), Limits(4096, 64, 4096)).collect()
    assert sum(r.length for r in rows if r.id is None) > 2
    assert sum(r.length for r in rows if r.id == 4) == 1
    assert sum(r.length for r in rows if r.id == 6) == 30_002
    assert pack(tokenized(empty, PATH, 2)).collect() == []


def test_one_worker_a_task_and_the_segment_limit(spark, odd, empty):
    """Short texts reach the limit of segments before that of tokens; texts go through one Python function."""
    docs = spark.range(1000).selectExpr("id AS doc_id", "'tiny text' AS text").coalesce(1)
    pieces = pack_documents(docs, PATH, 2, Limits(4096, 64, 4096))
    assert pieces._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    sizes = defaultdict(int)
    for r in pieces.collect():
        sizes[r.sequence_id] += 1
    assert max(sizes.values()) == 64 and sum(sizes.values()) >= 1000
    both = [
        sorted((r.id is None, r.id or 0, r.start, r.length, r.doc_tokens) for r in rows.collect())
        for rows in (pack_documents(odd.coalesce(1), PATH, 2), pack(tokenized(odd.coalesce(1), PATH, 2)))
    ]
    assert both[0] == both[1]
    assert pack_documents(empty, PATH, 2).collect() == []
