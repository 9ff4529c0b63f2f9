"""Document fingerprints by a homomorphic multiset hash, in Spark expressions alone.

Each part of a text (a paragraph's sentence) is hashed to a wide vector of small numbers, and the
vectors are summed, each lane modulo a power of two. The sum does not depend on the order of the parts, a
part can be added or taken away later, and the lanes, read as a random projection, tell how alike two
multisets of parts are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import pieces_of, renamed

#: Ends of paragraphs, and of sentences within them.
PART_ENDS = r"[\n\r]+|(?<=[.!?])\x20+"
LANE_BITS = 20  # lanes are sums modulo 2**20, one bit apart, three in a 64-bit word
_STRIDE, _LANES = LANE_BITS + 1, 3
_ONE = sum(1 << (k * _STRIDE) for k in range(_LANES))
_MASK = _ONE * ((1 << LANE_BITS) - 1)
_GUARD = _ONE << LANE_BITS
ROWS_PER_BUCKET = 4096
MOST_BUCKETS = 4096


def parts(text: Column) -> Column:
    return F.filter(F.split(text, PART_ENDS), lambda p: p != "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def vector(parts_: Column) -> Column:
    """``array<bigint>``: 42 words of three lanes, then the number of parts.

    Bit k of a part's two 64-bit hashes adds to lane k: every lane is how many parts have that bit.
    """
    hashes = F.transform(
        parts_, lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.concat(p, F.lit("\n"))).alias("b"))
    )

    def words(known: Column, which: str) -> Column:
        def word(shift: Column) -> Column:
            def add(total: Column, h: Column) -> Column:
                bits = F.call_function("shiftrightunsigned", h[which], shift).bitwiseAND(F.lit(_ONE))
                return (total + bits).bitwiseAND(F.lit(_MASK))

            return F.aggregate(known, F.lit(0).cast("long"), add)

        return F.transform(F.sequence(F.lit(0), F.lit(_STRIDE - 1)), word)

    def whole(known: Column) -> Column:
        count = F.size(known).cast("long").bitwiseAND(F.lit((1 << LANE_BITS) - 1))
        return F.concat(words(known, "a"), words(known, "b"), F.array(count))

    return _once(hashes, whole)


def union(a: Column, b: Column) -> Column:
    """The vector of both multisets together: the insertion of ``b`` into ``a``."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(_MASK)))


def difference(a: Column, b: Column) -> Column:
    """The vector of ``a`` after the deletion of ``b``, which it holds."""
    return F.zip_with(a, b, lambda x, y: (x.bitwiseOR(F.lit(_GUARD)) - y).bitwiseAND(F.lit(_MASK)))


def as_text(v: Column) -> Column:
    return F.concat_ws("", F.transform(v, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")))


def _lanes(v: Column) -> Column:
    """Each lane as twice its count less the number of parts: a sum of one random sign a part."""
    low = F.lit((1 << LANE_BITS) - 1)
    n = F.element_at(v, -1)
    words = F.slice(v, 1, 2 * _STRIDE)
    split = F.transform(words, lambda w: F.array(*[F.shiftright(w, k * _STRIDE).bitwiseAND(low) for k in range(_LANES)]))
    return F.transform(F.flatten(split), lambda c: (2 * c - n).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one less the squared distance of the two multisets, as a share of both their squared sizes;
    estimated from the lanes. 1 for equal vectors, about the shared share for texts of one size."""
    zero = F.lit(0.0)
    both = F.zip_with(_lanes(a), _lanes(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def near(pairs: Column) -> Column:
        apart = F.aggregate(pairs, zero, lambda t, p: t + (p["x"] - p["y"]) * (p["x"] - p["y"]))
        size = F.aggregate(pairs, zero, lambda t, p: t + p["x"] * p["x"] + p["y"] * p["y"])
        share = F.when(size == 0, zero).otherwise(1 - apart / size)
        return F.greatest(zero, F.least(F.lit(1.0), share))

    return F.when(a == b, F.lit(1.0)).otherwise(_once(both, near))


def summed(rows: DataFrame, keys: list[str], part: str) -> DataFrame:
    """``keys`` and ``vector`` of the multiset of parts that the rows of each key hold, a null part being
    none: what ``vector`` gives for an array, as plain sums that compile. A text of more than 2**21 parts,
    beyond which a lane would run over, has zeros there."""
    some = F.col(part).isNotNull()
    hashed = rows.withColumns(
        {
            "_a": F.when(some, F.xxhash64(part)),
            "_b": F.when(some, F.xxhash64(F.concat(part, F.lit("\n")))),
        }
    )
    shifts = [(h, k) for h in ("_a", "_b") for k in range(_STRIDE)]
    sums = [F.try_sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_ONE))).alias(f"_{h}{k}") for h, k in shifts]
    words = [F.coalesce(f"_{h}{k}", F.lit(0)).bitwiseAND(F.lit(_MASK)) for h, k in shifts]
    count = F.col("_n").bitwiseAND(F.lit((1 << LANE_BITS) - 1))
    made = hashed.groupBy(*keys).agg(*sums, F.count(part).alias("_n"))
    return made.select(*keys, F.array(*words, count).alias("vector"))


def _bucket(key: Column, edges: list[int]) -> Column:
    """How many of the sorted ``edges`` are not above ``key``, in two steps of their square root."""
    if not edges:
        return F.lit(0)
    step = max(1, int(len(edges) ** 0.5))
    groups = [edges[k : k + step] for k in range(0, len(edges), step)]
    below = lambda e: F.size(F.filter(e, lambda x: x <= key))
    long = lambda g: F.array(*[F.lit(x).cast("long") for x in g])
    group = below(long([g[0] for g in groups]))
    inner = F.element_at(F.array(*[long(g) for g in groups]), F.greatest(group, F.lit(1)))
    return F.when(group == 0, 0).otherwise((group - 1) * step + below(inner))


def _dealt(rows: DataFrame, rows_per_bucket: int) -> DataFrame:
    """``rows`` dealt to buckets by quantiles of the id, with their order ``_k``. The first row of each
    bucket is also ``_lent`` to the one before it (that of the first to the last), so that every row finds the
    next in its own bucket. The driver sees at most MOST_BUCKETS ids."""
    key = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))
    ids = rows.select(key.alias("_k"))
    n = min(MOST_BUCKETS, pieces_of(ids.count(), rows_per_bucket))
    shares = [k / n for k in range(1, n)]
    found = ids.agg(F.percentile_approx("_k", shares, 20 * n)).first()[0] if shares else []
    bucket = _bucket(F.col("_k"), sorted(set(found or [])))
    firsts = sorted(ids.groupBy(bucket.alias("b")).agg(F.min("_k")).collect())
    dealt = rows.withColumn("_k", key)
    own = dealt.withColumn("_bucket", bucket).withColumn("_lent", F.lit(False))
    if not firsts:
        return own
    lent = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    heads = rows.sparkSession.createDataFrame(lent, "_k long, _bucket int")
    return own.unionByName(dealt.join(F.broadcast(heads), "_k").withColumn("_lent", F.lit(True)))


def with_next(rows: DataFrame, carried: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``rows`` (with ``id`` and ``text``) with ``next_<name>`` of the row that follows in the order of id
    (null first), then of a hash of the text; the first row follows the last. Also ``_bucket``, the row's
    number ``_row`` in it, and ``_lent`` rows, for their users to drop. No task orders more than a bucket."""
    order = Window.partitionBy("_bucket").orderBy("_lent", "_k", F.xxhash64("text"))
    new = {f"next_{name}": F.lead(name).over(order) for name in carried}
    return _dealt(rows, rows_per_bucket).withColumns({**new, "_row": F.row_number().over(order)}).drop("_k")


def edited_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Every document with the fingerprint of its edited text, in which the last quarter of the code
    points gives way to the first as many of the next document: ``id, n_chars, vector, edited_sha256,
    edited_vector, next_vector``.

    Texts are shuffled once, to the buckets that give each its next; their parts are summed where they are.

    A null text is an empty one, and an empty text has the zero vector; rows without an id come first in
    the order, and of rows alike in id the order is that of a hash of the text; a single row is its own
    next; an empty table gives no rows; extra columns are not looked at.
    """
    rows = renamed(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = with_next(rows.withColumn("n_chars", F.length("text").cast("long")), ["text"], rows_per_bucket)
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter)
    edited = F.concat(kept, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter))
    keys = ["_bucket", "_row", "_lent", "id", "n_chars", "edited_sha256", "_side"]
    sides = (
        rows.withColumn("edited", edited)
        .withColumn("edited_sha256", F.sha2("edited", 256))
        .select(*keys[:-1], F.posexplode(F.array(parts(F.col("text")), parts(F.col("edited")))).alias("_side", "_parts"))
    )
    made = summed(sides.select(*keys, F.explode_outer("_parts").alias("_part")), keys, "_part")
    order = Window.partitionBy("_bucket").orderBy("_row", "_side")
    return (
        made.withColumn("edited_vector", F.lead("vector", 1).over(order))
        .withColumn("next_vector", F.lead("vector", 2).over(order))
        .filter("_side = 0 AND NOT _lent")
        .select("id", "n_chars", "vector", "edited_sha256", "edited_vector", "next_vector")
    )
