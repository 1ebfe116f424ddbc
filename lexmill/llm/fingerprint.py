"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text's paragraphs are its lines, empty ones too.  Each is hashed to a wide
vector; a document's fingerprint is the sum of them, lane by lane, modulo powers
of two.  So the order of paragraphs does not matter, equal multisets of
paragraphs have equal fingerprints, and a paragraph is inserted or deleted by
adding or subtracting its vector.

The vector has two parts.  8 lanes of the paragraph's SHA-256, summed modulo
2^32, tell multisets apart.  80 lanes count bits of the SHA-256 of its clauses,
two lanes to a word; read as random signs, they estimate the cosine between the
clauses of two texts, which is their likeness.  A lane has 31 bits, more than a
text that fits a column has clauses.

Built from DataFrame operations only; a document's paragraphs are summed in the
task that reads it, and only vectors are shuffled.  Running tables of one row a
part (20,000 ids) are ordered in one task.

A null text is the empty text, which has no paragraphs; its fingerprint is all
zeros, and two empty texts have likeness 1.  Repeated rows give repeated rows.
Texts of any length are read whole.  A row without a doc_id has no next document:
its edited text loses its last third and ``near_next`` is 0.  Where several rows
have the next doc_id, that with the greatest beginning is the next one.  An empty
table gives an empty table.  Columns beyond ``doc_id`` and ``text`` are not read,
whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts_for, step

#: Where a paragraph is cut into clauses.
CLAUSE_END = r"(?<=[.!?,;:])[ \t]+"
#: Words of the two parts; a word of the second has two lanes.
EXACT, SIGNS = 8, 40
LANE_BITS = 31
_SPREAD = 1 | 1 << LANE_BITS
_LANE = (1 << LANE_BITS) - 1
#: Hexadecimal digits of a clause's digest that make a number, and the words taken from it.
DIGITS, WORDS_A_NUMBER = 15, 20


def _number(digest: F.Column, first: int, digits: int) -> F.Column:
    return F.conv(F.substring(digest, first + 1, digits), 16, 10).cast("long")


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and the arrays ``exact`` and ``signs`` and the count ``units`` (clauses) of each distinct key, with ``copies``.

    Rows that agree in all keys must have equal texts; they are counted in
    ``copies`` and summed once.
    """
    paragraphs = F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(F.col(text), "\n"))
    clauses = F.filter(F.flatten(F.transform(paragraphs, lambda p: F.split(p, CLAUSE_END))), lambda c: c != "")
    kinds = F.concat(F.transform(paragraphs, lambda p: F.struct(F.lit(True).alias("whole"), p.alias("s"))), F.transform(clauses, lambda c: F.struct(F.lit(False).alias("whole"), c.alias("s"))))
    units = texts.select(*keys, F.posexplode_outer(kinds).alias("pos", "unit")).select(*keys, "pos", F.col("unit.whole").alias("whole"), F.sha2("unit.s", 256).alias("digest"))
    # Lanes of the first part from paragraphs, words of the second from clauses.
    digests = units.select(
        *keys, "pos", "whole",
        *[F.when(F.col("whole"), _number(F.col("digest"), 8 * i, 8)).alias(f"v{i}") for i in range(EXACT)],
        *[F.when(~F.col("whole"), _number(F.col("digest"), DIGITS * k, DIGITS)).alias(f"n{k}") for k in range(SIGNS // WORDS_A_NUMBER)],
    )
    none = F.lit(0).cast("long")
    signs = [F.shiftrightunsigned(F.col(f"n{j // WORDS_A_NUMBER}"), j % WORDS_A_NUMBER).bitwiseAND(F.lit(_SPREAD)) for j in range(SIGNS)]
    named = digests.select(
        *keys, "pos", F.coalesce((~F.col("whole")).cast("long"), none).alias("u"),
        *[F.coalesce(f"v{i}", none).alias(f"v{i}") for i in range(EXACT)],
        *[F.coalesce(x, none).alias(f"v{EXACT + j}") for j, x in enumerate(signs)],
    )
    sums = named.groupBy(*keys).agg(
        F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, 1).otherwise(0)).cast("long").alias("copies"),
        F.sum("u").alias("u"),
        *[F.sum(f"v{i}").alias(f"v{i}") for i in range(EXACT + SIGNS)],
    )
    once = [F.expr(f"v{i} div copies") for i in range(EXACT + SIGNS)]
    return sums.select(
        *keys,
        "copies",
        F.expr("u div copies").alias("units"),
        F.array(*[v.bitwiseAND(F.lit((1 << 32) - 1)) for v in once[:EXACT]]).alias("exact"),
        F.array(*once[EXACT:]).alias("signs"),
    )


def as_text(exact: F.Column, signs: F.Column, units: F.Column) -> F.Column:
    """A fingerprint in hexadecimal."""
    hexes = lambda a, n: F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), n, "0")), "")
    return F.concat(hexes(exact, 8), F.lpad(F.lower(F.hex(units)), 16, "0"), hexes(signs, 16))


def likeness(a: str, b: str) -> F.Column:
    """Likeness, 0 to 1, of the fingerprints in the columns ``{a}_exact`` and so on."""

    def lanes(at: str) -> F.Column:
        counts = F.flatten(F.transform(F.col(f"{at}_signs"), lambda x: F.array(*[F.shiftright(x, LANE_BITS * k).bitwiseAND(F.lit(_LANE)) for k in range(2)])))
        return F.transform(counts, lambda c: (c * 2 - F.col(f"{at}_units")).cast("double"))

    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    of = dot(lanes(a), lanes(a)) * dot(lanes(b), lanes(b))
    same = reduce(lambda x, y: x & y, [F.col(f"{a}_{k}") == F.col(f"{b}_{k}") for k in ("exact", "units", "signs")])
    return F.when(F.col(f"{b}_exact").isNull(), 0.0).when(same, 1.0).when(of <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(lanes(a), lanes(b)) / F.sqrt(of))))


def next_ids(docs: DataFrame, n_rows: int, ids_per_part: int = 20_000) -> DataFrame:
    """``doc_id`` and ``next_id``: the next smaller id; after the least comes the greatest.

    Ids are dealt out by range, ordered within each part, and only one row a
    part is needed to join the parts up.
    """
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    dealt = cut(ids.repartitionByRange(parts_for(n_rows, ids_per_part), "doc_id").select("doc_id", F.spark_partition_id().alias("part")))
    tops = dealt.groupBy("part").agg(F.max("doc_id").alias("top"))
    below = tops.select("part", F.lag("top").over(Window.orderBy("part")).alias("below"), F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("greatest"))
    inside = dealt.withColumn("inner", F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return inside.join(below, "part").select("doc_id", F.coalesce("inner", "below", "greatest").alias("next_id"))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last third replaced by the beginning of the next
    document, in descending order of doc_id.  Texts are shuffled once: the rows
    that lend their beginnings and those that take them read the same exchange.
    """
    with step(docs.sparkSession):
        n_rows = docs.select(F.count(F.lit(1))).first()[0]
        follows = cut(next_ids(docs, n_rows))
        repeated = follows.count() < n_rows
    every = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = every.filter(F.col("doc_id").isNotNull())
    th, third = F.xxhash64("text"), F.expr("length(text) div 3").cast("int")
    wants = base.select("doc_id", th.alias("of"), third.alias("k"))
    wants = (wants.distinct() if repeated else wants).join(follows, "doc_id").select("next_id", F.col("doc_id").alias("to"), "of", "k")
    lent = base.join(wants, F.col("doc_id") == F.col("next_id")).select("to", "of", "next_id", th.alias("next_th"), F.substring(F.col("text"), F.lit(1), F.col("k")).alias("head"))
    if repeated:
        lent = lent.groupBy("to", "of", "next_id").agg(F.max(F.struct("head", "next_th")).alias("x")).select("to", "of", "next_id", "x.next_th", "x.head")
    mine = F.col("doc_id") == F.col("to")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.col("head"))
    columns = ["doc_id", th.alias("th"), F.length("text").cast("long").alias("n_chars"), "next_id", "next_th", "text", edited.alias("edited")]
    whole = base.join(lent, mine & (th == F.col("of")) if repeated else mine).select(*columns)
    if repeated:  # as are rows that have no id
        alone = every.filter(F.col("doc_id").isNull()).select("*", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("next_id"), F.lit(None).cast("long").alias("next_th"), F.lit("").alias("head"))
        whole = whole.unionByName(alone.select(*columns))
    both = whole.select(
        "doc_id", "th", "n_chars", "next_id", "next_th", F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))).alias("x"),
    ).select("doc_id", "th", "n_chars", "next_id", "next_th", "edited_sha256", "x.which", "x.body")
    keys = ["doc_id", "th", "n_chars", "next_id", "next_th", "edited_sha256", "which"]
    found = cut(fingerprints(both, keys, "body"))
    vec = ["exact", "signs", "units"]
    own = found.filter("which = 0").select(*keys[:-1], "copies", *[F.col(c).alias(f"a_{c}") for c in vec])
    edited = found.filter("which = 1").select(F.col("doc_id").alias("e_id"), F.col("th").alias("e_th"), *[F.col(c).alias(f"b_{c}") for c in vec])
    after = found.filter("which = 0").select(F.col("doc_id").alias("n_id"), F.col("th").alias("n_th"), *[F.col(c).alias(f"c_{c}") for c in vec])
    rows = (
        own.join(edited, F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("th") == F.col("e_th")))
        .join(after, (F.col("next_id") == F.col("n_id")) & (F.col("next_th") == F.col("n_th")), "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("a_exact"), F.col("a_signs"), F.col("a_units")).alias("fingerprint"),
        as_text(F.col("b_exact"), F.col("b_signs"), F.col("b_units")).alias("edited_fingerprint"),
        likeness("a", "b").alias("near_edited"),
        likeness("a", "c").alias("near_next"),
    )
