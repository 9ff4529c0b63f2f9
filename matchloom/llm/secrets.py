"""Secrets in texts, told apart by how many owners hold them; in Spark expressions alone.

Candidates are found by pattern. Their hashes are counted over the corpus by distinct repositories and
owners: a value that many owners hold is a copied example, one that a single owner holds looks live.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import renamed
from matchloom.session import materialise


@dataclass(frozen=True)
class Kind:
    """A pattern; ``group`` is the part that must have ``least`` characters, and is the secret."""

    name: str
    pattern: str
    group: int
    least: int
    hint: str  # a cheaper pattern that every text with a finding matches


# The kinds of the base search, in their order.
BASE = (
    Kind(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    ),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Kind("hex", r"[0-9a-f]+", 0, 24, r"(?<![0-9a-f])[0-9a-f]{24}"),
)
# Long opaque words: secrets of no known form, which only their ownership tells from examples.
OPAQUE = Kind("opaque", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+", 0, 24, r"[A-Za-z0-9+/_-]{24}")
EXAMPLE_OWNERS = 3  # a value with as many owners is a copied example

_FOUND = "array<struct<start:int,end:int,secret:string>>"


def findings(text: Column, kind: Kind) -> Column:
    """``array<struct<start, end, secret>>``: the leftmost non-overlapping matches, in code points, less those
    whose secret is too short. A match starts after the gaps and matches before it."""
    pattern = F.lit(kind.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    secret = whole if kind.group == 0 else F.regexp_extract_all(text, pattern, F.lit(kind.group))
    parts = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), whole.alias("whole"), secret.alias("secret"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("found"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["gap"])
        end = begin + F.length(p["whole"])
        new = F.struct(begin.alias("start"), end.alias("end"), p["secret"].alias("secret"))
        long = F.length(p["secret"]) >= kind.least
        found = F.when(long, F.concat(state["found"], F.array(new))).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    # The last gap has no match after it.
    zipped = F.filter(parts, lambda p: p["whole"].isNotNull())
    hit = F.aggregate(zipped, start, step, lambda s: s["found"])
    return F.when(text.rlike(kind.hint), hit).otherwise(F.array().cast(_FOUND))


def _spelt(kind: Column, span: Column) -> Column:
    return F.concat_ws(":", kind, span["start"].cast("string"), span["end"].cast("string"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, by start, then by kind as listed, joined by commas."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: _spelt(s["kind"], s)))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """``id, key, owner, spans`` of every row; ``spans`` holds ``start, rank, end, kind, secret`` of the base
    findings and of opaque words outside them."""
    rows = renamed(docs, id=id_col, text=text_col, owner=owner_col)
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    kinds = (*BASE, OPAQUE)
    rows = rows.select("id", "owner", F.xxhash64("text").alias("key"), *[findings(F.col("text"), k).alias(k.name) for k in kinds])

    def spans(rank: int, kind: Kind) -> Column:
        return F.transform(
            kind.name,
            lambda f: F.struct(
                f["start"].alias("start"), F.lit(rank).alias("rank"), f["end"].alias("end"),
                F.lit(kind.name).alias("kind"), f["secret"].alias("secret"),
            ),
        )

    base = F.concat(*[spans(r, k) for r, k in enumerate(BASE)])
    mixed = lambda f: f["secret"].rlike("[0-9]") & f["secret"].rlike("[a-z]") & f["secret"].rlike("[A-Z]")
    free = lambda f: ~F.exists("base", lambda b: (b["start"] < f["end"]) & (f["start"] < b["end"]))
    rows = rows.withColumn("base", base)
    own = F.filter(spans(len(BASE), OPAQUE), lambda f: mixed(f) & free(f))
    return rows.select("id", "key", "owner", F.concat("base", own).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """``secret_hash, owners, repositories`` over the corpus, for rows (secret_hash, owner, id). Distinct
    triples first, then pairs: each step is combined ahead of its shuffle, so a value that
    most of the corpus holds is spread by whoever holds it. A null owner is an owner."""
    named = found.select("secret_hash", F.struct("owner").alias("owner"), F.struct("id").alias("id")).distinct()
    by_owner = named.groupBy("secret_hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("secret_hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """One row per row of ``docs``: ``id, spans, base, n_live, n_example``.

    ``base`` holds the base findings, whatever their ownership; ``spans`` also the opaque words that a
    single owner holds. Each has ``start, end, kind, verdict``: ``live`` if one owner holds the
    value, ``example`` from ``example_owners`` owners on, ``shared`` between. The document stands for the
    repository. Values are counted by their SHA-256, and nothing but that leaves the document's row.

    Nulls: a null text is empty; null ids and owners count as one id, one owner. Repeated rows find the same and
    count once. Documents without findings have empty lists. Empty table: no rows.
    """
    rows = materialise(candidates(docs, id_col, text_col, owner_col), "secrets")
    span = F.explode("spans").alias("span")
    found = rows.filter(F.size("spans") > 0).select("id", "key", "owner", span)
    found = found.withColumn("secret_hash", F.sha2(F.col("span.secret"), 256))
    counts = ownership(found)
    verdict = F.when(F.col("owners") == 1, "live").when(F.col("owners") >= example_owners, "example").otherwise("shared")
    judged = (
        found.select("id", "key", "owner", "span", "secret_hash")
        .join(counts, "secret_hash")
        .filter((F.col("span.kind") != OPAQUE.name) | (F.col("owners") == 1))
        .groupBy("id", "key", "owner")
        .agg(F.collect_set(F.struct("span.start", "span.rank", "span.end", "span.kind", verdict.alias("verdict"))).alias("spans"))
    )
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"j.{c}")) for c in ("id", "key", "owner")]
    met = same[0] & same[1] & same[2]
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,verdict:string>>")
    spans = F.coalesce(F.col("j.spans"), none)
    with_verdict = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return (
        rows.select("id", "key", "owner").alias("d")
        .join(judged.alias("j"), met, "left")
        .select("d.id", spans.alias("spans"))
        .withColumn("base", F.filter("spans", lambda s: s["kind"] != OPAQUE.name))
        .select("id", "spans", "base", with_verdict("live").alias("n_live"), with_verdict("example").alias("n_example"))
    )
