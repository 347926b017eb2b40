"""Token counts of whole texts by the whole-token shortcut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm import bpe
from hazegrid.llm.common import map_texts


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
                 vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    Vocabulary strings that the library itself encodes alone as one token are proven before the first text
    (`bpe.whole_tokens`) and counted as they are; only other pre-tokens are merged, once per worker.
    No shuffle; a worker holds at most a bounded table of words and one slice of texts.

    Null and empty texts have 0 bytes and 0 tokens. A null id stays null. Repeated rows give repeated rows,
    an empty table an empty result; other columns are ignored."""
    sized = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                      F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("n_bytes"))
    counted = map_texts(sized, {"doc_id": "doc_id", "n_bytes": "n_bytes"}, "text", "n_tokens long",
                        lambda: lambda texts: [bpe.words(vocabulary).counts(texts)])
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
