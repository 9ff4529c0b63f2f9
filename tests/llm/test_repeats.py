import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from matchloom.llm import parsing, queries, repeats, windows


def words_removed(rows, window):
    """(id, text) rows -> per row (words, removed, kept), by a dictionary of all windows."""
    count = defaultdict(int)
    split = [(t or "").encode().split() for _, t in rows]
    for words in split:
        for i in range(len(words) - window + 1):
            count[b" ".join(words[i : i + window])] += 1
    for words in split:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if count[b" ".join(words[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        yield len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g)


def bytes_removed(rows, length):
    first = {}
    for doc, text in rows:
        t, place = (text or "").encode(), float("inf") if doc is None else doc
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            first[s] = min(place, first.get(s, place))
    for doc, text in rows:
        t, place = (text or "").encode(), float("inf") if doc is None else doc
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < place:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        yield len(t), int(gone.sum()), int((np.diff(np.append([0], gone.astype(int))) == 1).sum()), kept


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_words_of_the_table(spark, sf_dir, texts):
    rows = sorted(texts.items())
    want = {d: (n, r, sha(k)) for (d, _), (n, r, k) in zip(rows, words_removed(rows, 35), strict=True)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op9_super_kmers(spark, sf_dir).collect()}
    assert got == want
    assert sum(r > 0 for _, r, _ in want.values()) > 0


def test_bytes_of_the_table(spark, sf_dir, texts):
    rows = sorted(texts.items())
    want = {d: (*x[:3], sha(x[3])) for (d, _), x in zip(rows, bytes_removed(rows, 50), strict=True)}
    found = queries.op7_prefix_free_parse(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == want
    assert sum(x[1] > 0 for x in want.values()) > 0


def repetitive(seed, letters):
    """Texts of few symbols with shared passages, periods and copies."""
    rnd = random.Random(seed)
    passages = [[rnd.choice(letters) for _ in range(rnd.randint(20, 60))] for _ in range(4)]
    rows = []
    for doc in range(40):
        text = []
        for _ in range(rnd.randint(0, 5)):
            if rnd.random() < 0.5:
                text += rnd.choice(passages)
            elif rnd.random() < 0.3:
                text += [rnd.choice(letters)] * rnd.randint(1, 90)
            else:
                text += [rnd.choice(letters) for _ in range(rnd.randint(1, 60))]
        rows.append((rnd.choice([doc, doc, doc - 1 if doc else 0, None]), text))
    return rows + rows[:2]


@pytest.mark.parametrize("frequent", [repeats.FREQUENT, 3])
@pytest.mark.parametrize(("chunk_bytes", "buckets"), [(200, 8), (200, 1 << 18), (1 << 20, 50)])
def test_small_alphabets_in_any_layout(spark, frequent, chunk_bytes, buckets):
    limits = {"frequent": frequent, "chunk_bytes": chunk_bytes}
    for seed in range(2):
        rows = [(d, " ".join(t)) for d, t in repetitive(seed, ["a", "b", "cc", "é", "longer"])]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = windows.remove_repeated(df, 12, 4, **limits).collect()
        want = [(d, *x) for (d, _), x in zip(rows, words_removed(rows, 12), strict=True)]
        order = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
        assert sorted(((r.id, r.n_words, r.n_removed, r.kept.encode()) for r in got), key=order) == sorted(want, key=order)

        rows = [(d, "".join(t)) for d, t in repetitive(seed + 10, "abé")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = parsing.remove_repeated(df, 20, 6, **limits, bucket_keys=buckets).collect()
        want = [(d, *x) for (d, _), x in zip(rows, bytes_removed(rows, 20), strict=True)]
        found = [(r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got]
        assert sorted(found, key=order) == sorted(want, key=order)


def test_suffix_runs_are_in_order():
    phrases = [b"abracadabra", b"cadabra", b"abracad"]
    order, run = parsing.suffix_runs(phrases, 4)
    suffixes = [p[i : i + 4] for p in phrases for i in range(len(p) - 3)]
    assert [suffixes[k] for k in order] == sorted(suffixes)
    assert len(set(run.tolist())) == len(set(suffixes))


def test_packed_numbers_come_back():
    for kind in ("<u4", "<i8", "u1", "<u8"):
        for numbers in (np.arange(300).astype(kind), np.empty(0, dtype=kind), np.array([-1]).astype(kind)):
            assert parsing._unpacked(parsing._packed(numbers), kind).tolist() == numbers.tolist()


def test_keys_tell_triggers_apart_by_bucket():
    values = parsing.Bytes(bytes(random.Random(1).choices(range(97, 123), k=20_000))).values
    plain = repeats.Windows(50, 24, parsing.Bytes, per_document=True).phrases(values)
    for bits in (0, 3, 31):
        bounds, keys = parsing.Keyed(50, 24, parsing.Bytes, per_document=True, bits=bits).phrases(values)
        assert (bounds == plain[0]).all() and len(set(keys.tolist())) == len(set(plain[1].tolist()))
        found = list(parsing._buckets(np.unique(keys)))
        assert [at.start for _, at in found[1:]] == [at.stop for _, at in found[:-1]]
        assert all(0 <= b < 1 << bits for b, _ in found)
        assert bits != 3 or len(found) == 8


def test_odd_rows(odd, empty):
    for module, size in ((windows, 5), (parsing, 20)):
        rows = module.remove_repeated(odd, size, 3).collect()
        assert len(rows) == odd.count()
        assert module.remove_repeated(empty, size, 3).collect() == []
    assert {r.n_removed for r in windows.remove_repeated(odd, 5, 3).collect() if r.id in (1, 2)} == {5}
    assert {(r.id, r.n_removed) for r in parsing.remove_repeated(odd, 20, 3).collect() if r.id in (1, 2)} == {(1, 0), (2, 30)}
