"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of text in it, without
the lines that several of its pieces share (licenses and the like), and equally
long.  A text, in lower case and with one space for whatever is no letter, is
encoded in blocks against every dictionary and gets the language whose encoding
is smallest; where the two smallest are within a few bytes, encoders that search
more are asked instead.  A margin between the smallest and the next that is too
narrow is a rejection.

Nulls and texts without any letter are ``und`` with score 0 and are rejected;
so is every text if there is nothing labelled to learn from.  Ties go to the
language that sorts first.  Repeated rows get equal results.  Whole texts are
encoded, however long.  An empty table gives an empty table.
Columns beyond ``doc_id``, ``text`` and ``lang`` are passed through, but one
named like a result gives way to it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UNDETERMINED = "und"
#: Bounds of the sample that dictionaries are made of: pieces of a language, their characters, and bytes of all dictionaries together.
PIECES, PIECE_CHARS, TOTAL_BYTES = 160, 1200, 64_000_000
#: Dictionaries are cut to the shortest, but to no less than this.
LEAST_BYTES = 48_000
#: Text is encoded in blocks of so many bytes, so that the dictionary and not the text's own past decides.
BLOCK_BYTES = 1024
LEVEL = 6
#: Where the two smallest encodings differ by fewer bytes, whatever the text's size, encoders that search more decide.
CLOSE_BYTES, CLOSE_LEVEL = 16, 12
#: Share of the second smallest size by which the smallest must be less.
MIN_MARGIN = 0.002
#: Score: odds double with so many bytes of difference.
BYTES_A_DOUBLING = 2.0


def learn(docs: DataFrame, seed: int = 5, pieces: int = PIECES, piece_chars: int = PIECE_CHARS) -> dict[str, bytes]:
    """Dictionaries by language from rows with ``doc_id``, ``text``, ``lang``.

    The sample is at most ``pieces`` pieces of ``piece_chars`` characters for
    each language: documents are chosen by a hash of their id and the place of
    the piece in the document by another.  The driver gets one count a language
    and that sample.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not known:
        return {}
    # Only about twice the sample reaches the window, however large a language is.
    spark = docs.sparkSession
    keep = spark.createDataFrame([(k, min(1.0, 2.0 * pieces / n + 16.0 / n)) for k, n in known.items()], "lang string, share double")
    pick = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.greatest(F.lit(1), F.length("text") - F.lit(piece_chars))).cast("int")
    chosen = (
        rows.join(F.broadcast(keep), "lang")
        .withColumn("pick", pick)
        .filter(F.col("pick") < F.col("share"))
        .select("lang", "pick", "doc_id", F.substring(F.col("text"), place + F.lit(1), F.lit(piece_chars)).alias("piece"))
        .withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("pick", "doc_id", "piece")))
        .filter(F.col("k") <= pieces)
    )
    parts: dict[str, list[tuple[int, list[str]]]] = {}
    seen: Counter[str] = Counter()
    for r in chosen.select("lang", "k", "piece").collect():
        lines = [plain(x) for x in r["piece"].split("\n")]
        seen.update(set(lines))
        parts.setdefault(r["lang"], []).append((r["k"], lines))
    most = TOTAL_BYTES // len(parts)
    kept = {k: " ".join(x for _, lines in sorted(v) for x in lines if seen[x] < 2) for k, v in parts.items()}
    made = {k: (v or " ".join(x for _, lines in sorted(parts[k]) for x in lines)).encode()[:most] for k, v in kept.items()}
    # A longer dictionary has dearer offsets, so lengths must not differ between languages with text enough.
    length = max(LEAST_BYTES, min(map(len, made.values())))
    return {k: v[:length] for k, v in made.items()}


Encoders = list[tuple[str, zstandard.ZstdCompressor]]


@lru_cache(maxsize=2)
def encoders(model: tuple[tuple[str, bytes], ...]) -> tuple[Encoders, Encoders]:
    """Encoders by language, for all texts and for close calls."""
    out: tuple[Encoders, Encoders] = ([], [])
    for level, made in zip((LEVEL, CLOSE_LEVEL), out, strict=True):
        for lang, content in model:
            d = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            made.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def plain(text: str) -> str:
    """Lower case, and one space for every run of other characters than letters."""
    return _OTHER.sub(" ", text.lower()).strip()


def _sizes(blocks: list[bytes], by_language: Encoders) -> list[tuple[int, str]]:
    """Bytes of the blocks' encodings, smallest first."""
    return sorted((sum(map(len, map(c.compress, blocks))), lang) for lang, c in by_language)


def decide(text: str | None, by_level: tuple[Encoders, Encoders]) -> tuple[str, float, float]:
    """Language, score and margin of one text."""
    if not text or not by_level[0] or not _LETTER.search(text):
        return UNDETERMINED, 0.0, 0.0
    data = plain(text).encode()
    blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    sizes = _sizes(blocks, by_level[0])
    if len(sizes) == 1:
        return sizes[0][1], 1.0, 1.0
    if sizes[1][0] - sizes[0][0] < CLOSE_BYTES:
        sizes = _sizes(blocks, by_level[1])
    (best, lang), (second, _) = sizes[:2]
    score = 1.0 / sum(math.exp2(-min(500.0, (s - best) / BYTES_A_DOUBLING)) for s, _ in sizes)
    return lang, score, (second - best) / second


#: Rows that are turned into Python strings at a time.
ROWS_AT_ONCE = 200


def _decided(batches: Iterator[pa.RecordBatch], by_level: tuple[Encoders, Encoders]) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, float, float]]]]:
    """Some rows at a time, with what is found of each."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS_AT_ONCE):
            some = b.slice(k, ROWS_AT_ONCE)
            yield some, [decide(t, by_level) for t in some.column(some.schema.get_field_index("text")).to_pylist()]


RESULTS = {"lang_pred": "string", "score": "double", "margin": "double", "accepted": "boolean"}


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def classify(docs: DataFrame, model: dict[str, bytes], min_margin: float = MIN_MARGIN, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``margin``, ``accepted``, and without the text if it isn't to be kept; map-only."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(sorted(model.items())))  # at most TOTAL_BYTES
    docs = docs.drop(*RESULTS)
    kept = docs.schema if keep_text else docs.drop("text").schema
    names = kept.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, found in _decided(batches, encoders(sent.value)):
            lang, score, margin = ([x[i] for x in found] for i in range(3))
            accepted = [x != UNDETERMINED and m >= min_margin for x, m in zip(lang, margin, strict=True)]
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(c)) for c in names), *made], [*names, *RESULTS])

    return docs.mapInArrow(run, ", ".join([_ddl(kept), *(f"{k} {v}" for k, v in RESULTS.items())]))


def keep_identified(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` without the rows that are rejected; learns from the rows with a language.

    Each row goes to a Python worker once, and only those that stay come back.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tuple(sorted(learn(docs).items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, found in _decided(batches, encoders(sent.value)):
            yield some.filter(pa.array([x != UNDETERMINED and m >= min_margin for x, _, m in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
