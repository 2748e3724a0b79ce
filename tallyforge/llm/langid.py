"""Language ID by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import long_rows

NOT_LETTERS = re.compile(r"[\W\d_]+")
#: A lazy parse with short matches: languages differ in syllables, which the faster strategies don't see.
PARAMETERS = {"compression_level": 1, "strategy": zstandard.STRATEGY_LAZY, "min_match": 4, "hash_log": 17, "chain_log": 17, "search_log": 3, "window_log": 18}
#: Bytes that are compressed from the dictionary alone.  Later in a text a compressor finds what it needs in the text itself.
PIECE_BYTES = 16 << 10
#: Labels that get a dictionary; every text is compressed with each.
MOST_LABELS = 500


def letters_only(text: str) -> str:
    """Lower case, each run of anything but letters as one space."""
    return NOT_LETTERS.sub(" ", text.lower())


def pieces(b: bytes) -> list[bytes]:
    """``b`` in as few parts of at most PIECE_BYTES as there can be, of equal size to a byte."""
    n = -(-len(b) // PIECE_BYTES)
    edges = [i * len(b) // n for i in range(n + 1)] if n else [0]
    return [b[i:j] for i, j in zip(edges, edges[1:])]


def train_dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = 64, dict_bytes: int = 128 << 10) -> dict[str, bytes]:
    """A raw-content dictionary for each label, from a bounded sample of the labelled rows.

    At most ``sample_rows`` texts a label, chosen by hash of the text, each giving its first ``dict_bytes // 32`` characters.
    Of these the last ``dict_bytes`` bytes make the dictionary.  Rows with a null label, or a text that is null or has no letter, don't
    count.  Labels are languages: more than MOST_LABELS are an error.
    """
    if labelled.select(lang).distinct().limit(MOST_LABELS + 2).count() > MOST_LABELS + 1:
        raise ValueError(f"more than {MOST_LABELS} labels")
    w = Window.partitionBy("lang").orderBy("h", "text")
    rows = (
        labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
        .where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .select("lang", F.substring("text", 1, dict_bytes // 32).alias("text"), F.xxhash64("text").alias("h"))
        .withColumn("n", F.row_number().over(w))
        .where(F.col("n") <= sample_rows)
        .orderBy("lang", "n")
        .toPandas()
    )
    return {name: "\n".join(map(letters_only, part["text"])).encode()[-dict_bytes:] for name, part in rows.groupby("lang")}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = 0.001, min_bytes: int = 200) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` (0 to 1) and ``lang_kept``.

    The letters of the whole text are compressed with each dictionary, in pieces that each start from the dictionary anew, so that
    every part of a long text counts alike, and the smallest sum wins.  The score is the margin: by what share the smallest sum is under the second smallest.  ``lang_kept`` is false where that is under ``min_margin`` in a text of at
    least ``min_bytes`` of letters; shorter ones have too little evidence to be rejected on.

    Null and empty texts, texts without a letter, and every text if there is no dictionary are 'und', score 0 and not kept.  With
    one dictionary the score is 1.  Ties go to the first name.  Columns of the new names in ``docs`` are replaced; all others,
    and repeated rows, stay as they are.
    """
    docs = long_rows(docs).drop("lang_pred", "lang_score", "lang_kept")
    names = sorted(dictionaries)
    raw = [dictionaries[n] for n in names]
    schema = T.StructType([*docs.schema.fields]).add("lang_pred", "string").add("lang_score", "double").add("lang_kept", "boolean")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for x in raw:
            d = zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters(**PARAMETERS)
            d.precompute_compress(compression_params=p)
            made.append(zstandard.ZstdCompressor(compression_params=p, dict_data=d))
        for batch in batches:
            pred, score, kept = [], [], []
            for t in batch.column(at).cast(pa.string()):
                t = t.as_py()
                if not made or not t or not any(map(str.isalpha, t)):
                    pred.append("und"), score.append(0.0), kept.append(False)
                    continue
                b = letters_only(t).encode()
                parts = pieces(b)
                sizes = sorted((sum(len(c.compress(x)) for x in parts), n) for c, n in zip(made, names, strict=True))
                margin = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
                pred.append(sizes[0][1]), score.append(margin), kept.append(len(b) < min_bytes or margin >= min_margin)
            added = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return docs.mapInArrow(run, schema)


def is_held_out(doc_id: Column) -> Column:
    """True for the third of documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_dictionaries(docs.where(~is_held_out(F.col("doc_id"))).select("text", "lang"))
    out = classify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_kept").alias("kept"))
