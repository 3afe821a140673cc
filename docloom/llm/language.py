"""Language identification by compression.

A raw-content zstandard dictionary is made for each language from a bounded
sample of labelled rows: ``SLICES`` slices of ``SLICE`` characters, drawn by a
hash from all slices of whole documents, so that every part of a text is as
likely as any other. A text is cut into blocks of one length, each block is
compressed with each dictionary by two match finders, whose errors differ, and the language with the smallest sum wins. A
text is rejected if its winner leads by less than ``MIN_MARGIN`` of the
runner-up's size, or if it has no letter (``und``).

Defined results: null or letterless texts get ``und`` and score 0, and are
rejected; of equal sums the first language in code-point order wins, with
margin 0; every row gets a row; without training rows all are ``und``. lang,
source and doc_id are never used to predict.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import begin, pieces, schema, sliced, text_of

SLICES, SLICE, BLOCK, MIN_MARGIN = 96, 1200, 2048, 0.002
BATCH_BYTES = 1 << 20
_LETTER, _NO_LETTERS = regex.compile(r"\p{L}"), re.compile(r"[\W\d_]+")


def dictionaries(docs: DataFrame, use: Callable[[Column], Column], slices: int = SLICES, slice_chars: int = SLICE) -> dict[str, bytes]:
    """Raw content for each language, from documents for whose id ``use`` holds and whose lang isn't null.

    Documents far down the order of a hash of id and text are left out before any text is cut: a hash over a bound
    that four times as many documents as there are slices are expected to stay under. A language that this would
    leave with too few documents is small, and all of its documents count. The slices of what is left are drawn by
    a hash of their own.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("lang")).filter(F.col("lang").isNotNull() & use(F.col("doc_id")) & (F.length(F.trim("text")) > 0))
    counts = {r["lang"]: r["n"] for r in docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & use(F.col("doc_id"))).groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not counts:
        return {}
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    bound = F.lit(1.0)
    for lang, n in counts.items():
        if n > 8 * slices:
            bound = F.when(F.col("lang") == lang, F.lit(4.0 * slices / n)).otherwise(bound)
    cut = rows.filter(h <= bound).select("lang", "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{slice_chars}}}"), F.lit(0))).alias("at", "slice"))
    cut = cut.withColumn("h", F.xxhash64("doc_id", "at", "slice"))
    best = cut.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "at", "slice"))).filter(F.col("k") <= slices)
    out: dict[str, bytes] = {}
    for r in best.orderBy("lang", "k").collect():  # ``slices`` of each language at most
        out[r["lang"]] = out.get(r["lang"], b"") + plain(r["slice"])
    return out


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def plain(text: str) -> bytes:
    """Lower-case letters with single spaces: what is said, without its dress."""
    return _NO_LETTERS.sub(" ", text.lower()).encode()


class Identifier:
    def __init__(self, content: dict[str, bytes], block: int = BLOCK):
        import zstandard

        self.langs, self.block = sorted(content), block
        common = {"window_log": 18, "hash_log": 17, "min_match": 4, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        quick = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_DFAST, chain_log=16, search_log=1, **common)
        lazy = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, chain_log=16, search_log=2, **common)

        def compressor(lang: str, params):
            raw = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=raw, compression_params=params).compress

        self.compressors = [(compressor(x, quick), compressor(x, lazy)) for x in self.langs]

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes by language, by both match finders together."""
        b = plain(text)
        blocks = [b[i : i + self.block] for i in range(0, len(b), self.block)]
        return [sum([len(f(x)) + len(g(x)) for x in blocks]) for f, g in self.compressors]

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, score from 0 to 1, margin as a part of the runner-up's size."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, 0.0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        if len(order) == 1:
            return self.langs[0], 1.0, 1.0
        best, second = sizes[order[0]], sizes[order[1]]
        margin = (second - best) / max(second, 1)
        # Odds of 2 for each byte saved, up to the weight of 32 bytes.
        return self.langs[order[0]], 1.0 / (1.0 + 2.0 ** -min(32.0, float(second - best))), margin


def identify(docs: DataFrame, content: dict[str, bytes], min_margin: float = MIN_MARGIN, *keep: str) -> DataFrame:
    """doc_id, lang_pred, score, margin and rejected of each document. The dictionaries' size is bounded by their number of languages."""
    out = schema("doc_id long, lang_pred string, score double, margin double, rejected boolean")

    def run(batches):
        begin("language")
        model = Identifier(content)
        for rows in pieces(batches, BATCH_BYTES, "doc_id", "text"):
            found = [(r[0], *model.predict(r[1])) for r in rows]
            ids, langs, scores, margins = zip(*found, strict=True)
            rejected = [x == "und" or m < min_margin for x, m in zip(langs, margins, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(rejected, pa.bool_())], out.names)

    return text_of(docs).mapInArrow(run, out)


def keep_identified(docs: DataFrame, content: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't rejected."""
    out = docs.schema

    def run(batches):
        begin("language")
        model = Identifier(content)
        for batch in sliced(batches, 256):
            keep = []
            for text in batch.column("text").to_pylist():
                lang, _, margin = model.predict(text or "")
                keep.append(lang != "und" and margin >= min_margin)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, out)
