import hashlib
import re
from collections import defaultdict

import pytest

from matchloom.llm import queries, secrets

# The base kinds in another notation; \x20 aside, letters of the first are meant in either case.
ASSIGN = re.compile(
    r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace(
        "password|passwd|secret|token|api_?key",
        "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
        + "|[aA][pP][iI]_?[kK][eE][yY]",
    )
)


def base(text):
    out = []
    for rank, (name, pattern, group, least) in enumerate(
        (("assign", ASSIGN, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
    ):
        out += [(m.start(), rank, m.end(), name) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return sorted(out)


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def test_base_findings(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")  # the smallest table holds none
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{big}/documents.parquet").collect()}
    rows = queries.op8_secret_ownership(spark, big).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0
    for r in rows:
        want = base(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w[3] == k for w in want) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        assert set(filter(None, listed(want).split(","))) <= set(r.spans.split(","))


CASES = [
    "password = abcdef", "PassWord:'abcdef'", 'api_key": "x-y_z.=12', "apikey=abc", "token=secret=abcdef",
    "password: token:abcdefgh", "tokens: abcdef token : abcdef, token:abcde", "🙂 secret=ünter secret=unter6",
    "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAAKIA" + "0" * 16 + "z", "0" * 24, "f" * 23 + "g" + "a" * 25,
    "paſſword=abcdefg toKen=abcdefg", "", "passwd=\nabcdef", "secret" * 30 + "=" * 30,
]


def test_edges(spark):
    docs = spark.createDataFrame([(k, t, f"s{k}") for k, t in enumerate(CASES)], "doc_id long, text string, source string")
    for r in secrets.find_secrets(docs).collect():
        found = [(s["start"], s["end"], s["kind"]) for s in sorted(r.base, key=lambda s: (s["start"], s["rank"]))]
        assert found == [(s, e, k) for s, _, e, k in base(CASES[r.id])], CASES[r.id]


def test_ownership_tells_examples_from_live_values(spark):
    opaque = "Zk3" + "q7RtY" * 6
    rows = [(k, f"copy token=EXAMPLE123 here {opaque if k == 0 else ''}", f"owner{k % 4}") for k in range(40)]
    rows += [(100, "token=mine4567", "owner0"), (101, "token=mine4567", "owner0"), (102, opaque + "x", "owner1")]
    rows += [(103, opaque + "x", "owner2")]
    found = {r.id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    verdicts = defaultdict(list)
    for key, r in found.items():
        for s in r.spans:
            verdicts[key].append((s["kind"], s["verdict"]))
    assert verdicts[5] == [("assign", "example")]
    assert sorted(verdicts[0]) == [("assign", "example"), ("opaque", "live")]
    assert verdicts[100] == verdicts[101] == [("assign", "live")]
    assert 102 not in verdicts and 103 not in verdicts
    assert found[0].n_live == 1 and found[0].n_example == 1


def test_odd_rows(odd, empty):
    rows = secrets.find_secrets(odd).collect()
    assert len(rows) == odd.count() and all(r.spans == [] for r in rows)
    assert secrets.find_secrets(empty).collect() == []


@pytest.mark.parametrize("times", [3])
def test_repeated_rows_count_once(spark, times):
    docs = spark.createDataFrame([(1, "token=abcdef1 token=abcdef2", None)] * times, "doc_id long, text string, source string")
    rows = secrets.find_secrets(docs).collect()
    assert [(len(r.spans), r.n_live) for r in rows] == [(2, 2)] * times
