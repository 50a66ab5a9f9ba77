"""Language identification by compression against per-language dictionaries.

For every language seen in training a raw-content Zstandard dictionary is made of
training texts. A text belongs to the language whose dictionary makes it
smallest. Where the smallest and the second smallest size are closer than
``MARGIN`` of the smallest, the prediction is marked as not accepted.

A text is compressed in blocks of ``BLOCK`` bytes, each against every dictionary,
and the sizes are summed: a compressor looks back over a bounded window only, so
without blocks no dictionary would have a say past the beginning of a long text.

Texts are compared lower-cased and with all ASCII characters but letters as
single spaces. Null texts and texts without a letter are "und". Of equal sizes
the language with more training rows wins, then the first by name. Rows without
a language or id aren't learned from; without any training row every text is
"und". Repeated rows each get their result; extra columns stay; an output column
of a name that exists replaces it; empty tables give empty results.

The dictionaries are a bounded fit: about ``ROWS`` rows a language, drawn by a
hash of the id at a rate from the language's own count, of those of at most
``LONGEST`` characters. Whole texts of all rows drawn make the dictionary.
Everything else reads all rows; very long texts are compressed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from trackloom.llm.common import small_batches

ROWS, LONGEST = 80, 8_000
MARGIN = 0.02
LEVEL = 6
BLOCK = 16_384
UNKNOWN = "und"
#: UTF-8 bytes: ASCII but lower-case letters becomes a space.
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def shape(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(FOLD).split())


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text))


class Classifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, samples: list[tuple[str, bytes]]):
        """samples: (language, raw content), the likelier language first."""
        self.names = [n for n, _ in samples]
        self.coders = []
        for _, raw in samples:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=4096, dict_size=len(raw), min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
            d.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, text: str) -> list[int]:
        own = shape(text)
        # bytes of a cut character do no harm
        blocks = [own[k : k + BLOCK] for k in range(0, len(own), BLOCK)] or [own]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted)."""
        if not self.names or not has_letter(text):
            return UNKNOWN, 0.0, False
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        least = sizes[best]
        # four bytes count as a factor of two
        score = 1 / sum(2.0 ** (-min(s - least, 2000) / 4) for s in sizes)
        second = min((s for k, s in enumerate(sizes) if k != best), default=least * 2 + 2)
        return self.names[best], score, second - least >= max(1.0, MARGIN * least)


def fit(df: DataFrame, lang_col: str, text_col: str, id_col: str, learn: Column) -> list[tuple[str, bytes]]:
    """Dictionaries from the rows of ``df`` for which ``learn`` holds, the most frequent language first."""
    rows = df.where(learn & F.col(lang_col).isNotNull() & (F.length(text_col) <= LONGEST)).select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"), F.xxhash64(F.col(id_col).cast("string"), F.lit("dictionary")).alias("h"))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = df.sparkSession.createDataFrame([(name, min(1.0, ROWS / n)) for name, n in counts.items()], "l string, share double")
    drawn = rows.join(F.broadcast(share), "l").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))

    raw: dict[str, list[bytes]] = {}
    for r in drawn.select("l", "h", "t").distinct().orderBy("l", "h", "t").collect():
        raw.setdefault(r.l, []).append(shape(r.t))
    order = sorted(raw, key=lambda n: (-counts[n], n))
    return [(n, b" ".join(raw[n]) or b" " * 8) for n in order]


def with_language(df: DataFrame, samples: list[tuple[str, bytes]], text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score (0 to 1) and accepted."""
    small_batches(df.sparkSession)
    names = ["lang_pred", "score", "accepted"]
    sent = df.sparkSession.sparkContext.broadcast(samples)

    @arrow_udf("lang_pred string, score double, accepted boolean")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Classifier(sent.value)
        for texts in batches:
            got = [own.predict(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], names=names)

    got = df.withColumn("_lang", predicted(F.col(text_col)))
    return got.select(*[c for c in df.columns if c not in names], *[F.col(f"_lang.{n}").alias(n) for n in names])
