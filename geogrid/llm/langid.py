"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named
from .tokens import slices

UND = "und"
LEVEL = 9  # of compression
SLACK = 3
LEAD, LEADS = 3000, 3  # bytes of a dictionary that go before a text where languages tie, and how many such parts do in turn
SALTS = 16  # of the ranking of a language's texts
RESULT = "lang_pred string, score double, margin double, rejected boolean"


def learn(
    docs: DataFrame, texts_per_lang: int = 120, longest_text: int = 6000, dictionary_bytes: int = 120_000
) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from labelled rows (doc_id, text, lang).

    The sample is bounded: of each language at most ``texts_per_lang`` whole texts of at most ``longest_text``
    characters, those with the smallest hash of text and id, up to ``dictionary_bytes`` bytes. A text counts once in
    each language, however many rows have it, so copies fill neither the sample nor a dictionary. Rows with null text or language
    are not used; an empty table gives no dictionary. The driver gets the sample and a count for each language;
    languages come in order of how many rows they have, the most frequent first. Other columns are not looked at,
    whatever they are called.
    """
    rows = docs.where(F.col("lang").isNotNull() & (F.col("lang") != UND) & (F.length("text") <= longest_text))
    slim = rows.groupBy("lang", F.xxhash64("text").alias("of")).agg(F.min(F.xxhash64("doc_id", "text")).alias("h"))
    # Ranked within salts of a language first, so that what one task ranks in the end doesn't grow with the tasks.
    salt = F.pmod(F.xxhash64("of"), F.lit(SALTS))
    first = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy("h", "of"))
    some = slim.withColumn("salt", salt).withColumn("nth", first("salt")).where(F.col("nth") <= texts_per_lang)
    chosen = some.withColumn("nth", first()).where(F.col("nth") <= texts_per_lang)
    keys = chosen.select("nth", F.col("of").alias("kh"), F.col("lang").alias("kl"))  # texts_per_lang rows a language
    texts = rows.join(F.broadcast(keys), (F.xxhash64("text") == F.col("kh")) & (F.col("lang") == F.col("kl")))
    texts = texts.groupBy("lang", "nth").agg(F.min("text").alias("text"))  # one of all copies
    found: dict[str, list[bytes]] = {}
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["nth"])):
        found.setdefault(r["lang"], []).append(r["text"].lower().encode())
    out = {}
    for lang in [r["lang"] for r in counts]:
        parts = found[lang]
        taken, size = [], 0
        for p in parts:
            if size + len(p) <= dictionary_bytes or not taken:
                taken.append(p)
                size += len(p) + 1
        out[lang] = b"\n".join(taken)
    return out


def predict(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    keep: tuple[str, ...] = ("doc_id",),
    least_margin: float = 0.005,
    least_saved: float = 0.01,
    per_byte: float = 0.35,
    result: str = "language",
) -> DataFrame:
    """Per row: the columns of ``keep``, and a struct ``result`` of lang_pred, score, margin, rejected.

    The whole text, in lower case, is compressed with each language's dictionary; the language with the fewest bytes
    is predicted. Of languages with equally few, LEADS parts from the start of each dictionary go before the text in
    turn, so that its letters have a language's frequencies, and what the text adds to all is compared; of equal ones
    the first in ``dictionaries`` is taken. Texts of any length go the same way. Sizes are read as costs: ``score`` is the share
    of exp(-per_byte * bytes) that the predicted language has, from 1 / number of languages to 1, and ``margin`` is
    how many bytes the second language needs beyond the first, as a share of the first's. A prediction is
    ``rejected`` where that is below ``least_margin``: no dictionary explains the text clearly better than another.
    It is also rejected where the best dictionary saves less than ``least_saved`` of the bytes that the text takes
    without one, beyond SLACK bytes that chance may cost: no language explains it, as with foreign scripts and codes.

    Null text, empty text and text without a letter give ``und``, score 0, margin 0, rejected; so does every text if
    there is no dictionary. With one dictionary score and margin are 1. Rows that repeat, and null ids, are rows like
    others; an empty table gives no rows. Columns are carried along if ``keep`` names them, whatever they are called
    but ``result``.
    """
    langs = list(dictionaries)
    if result.lower() in {c.lower() for c in keep}:
        raise ValueError(f"the column {result} is there already; name another result")

    def compressors() -> tuple:
        import zstandard as z

        def of(data: bytes) -> "z.ZstdCompressor":
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False)

        after = [of(dictionaries[x][LEADS * LEAD :]) for x in langs]
        lead = [[dictionaries[x][k * LEAD : (k + 1) * LEAD] for k in range(LEADS)] for x in langs]
        begun = [[(c, x, len(c.compress(x))) for x in parts] for c, parts in zip(after, lead, strict=True)]
        return [of(dictionaries[x]) for x in langs], begun, z.ZstdCompressor(level=LEVEL, write_content_size=False)

    def sizes(data: bytes, whole: list, begun: list, bare) -> tuple[list[int], bool]:  # noqa: ANN001
        found = [len(c.compress(data)) for c in whole]
        told = min(found) <= (1 - least_saved) * len(bare.compress(data)) + SLACK
        if found.count(min(found)) > 1:
            found = [sum(len(c.compress(lead + data)) - n for c, lead, n in parts) for parts in begun]
        return found, told

    def of(text: str | None, made: tuple) -> tuple[str, float, float, bool]:
        if not text or not langs or not (text[:1].isalpha() or any(map(str.isalpha, text))):
            return UND, 0.0, 0.0, True
        found, told = sizes(text.lower().encode("utf-8", "replace"), *made)
        low = sorted(found)
        score = 1 / math.fsum(math.exp(-per_byte * (s - low[0])) for s in found)
        margin = (low[1] - low[0]) / max(1, low[0]) if len(low) > 1 else 1.0
        return langs[found.index(low[0])], score, margin, margin < least_margin or not told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compressors()
        for b in slices(batches, "text"):
            found = [dict(zip(names, of(t, made), strict=True)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(found, kind)], names=["row", "found"])

    names = ("lang_pred", "score", "margin", "rejected")
    kind = pa.struct(list(zip(names, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)))
    # The columns go as one, so that none of their names matters.
    rows = docs.select(F.struct(*map(named, keep)).alias("row"), F.col("text").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("found", T.StructType.fromDDL(RESULT))])
    made = rows.mapInArrow(run, schema)
    return made.select(*[F.col("row").getField(c).alias(c) for c in keep], F.col("found").alias(result))


def held_out() -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 1 when divided by 3. A null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
