"""Small tables with every awkward case: nulls, empty and long texts, repeated rows, ties, and columns whose names the operators use themselves."""

import random

import pytest
from pyspark.sql import types as T

CLASHING = ["text_sha256", "n", "h", "bucket", "row", "owner", "size", "key", "position", "positions", "score", "c0", "label", "rank", "length",
            "n_chars", "kept", "rest", "host", "spans", "piece", "target", "u", "number", "__text"]

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType())] + [T.StructField(c, T.StringType()) for c in CLASHING])


def documents():
    draw = random.Random(5)
    words = ["wind", "dust", "rain,", "Smoke", "a", "über", "côté", "x1", "it's", "<b>", "the", "of", "and", "###", "naïve", "日本語", "don't", "3.14", "é"]
    out = [
        (1, "the cat sat on the mat and the cat sat on the mat", "en", "b"),
        (2, None, "en", "a"), (3, "", None, None), (4, " \t\n\x0b ", "de", ""),
        (None, "a text without an id of its own but with eight words", "en", "a"),
        (5, "the  cat sat\non the mat and the cat sat on the mat", "en", "b"),
        (6, "one two", "fr", None), (6, "one two", "fr", None),
        (7, "<|endoftext|> is special <|STARTOFTEXT|> is not \x1c\x85 here", "en", "c"),
        (8, "İstanbul ΣΑΣ ſ Å q̣̇", "xx", "c"),
        (9, " ".join(draw.choice(words) for _ in range(30_000)), "en", "a"),
        (10, "word" * 5_000, "en", "z"),
    ]
    base = [draw.choice(words) + str(draw.randrange(300)) for _ in range(60)]
    for i in range(20):
        w = list(base)
        for _ in range(draw.randrange(4)):
            w[draw.randrange(len(w))] = f"changed{draw.randrange(1000)}"
        out.append((100 + i, " ".join(w), draw.choice(["en", "de", None]), draw.choice(["a", "b", "c", None])))
    for i in range(30):
        out.append((200 + i, "\n".join(" ".join(draw.choice(words) for _ in range(draw.randrange(12))) for _ in range(draw.randrange(1, 25))),
                    draw.choice(["en", "fr", "es"]), draw.choice(["a", "b", "c", "d", None])))
    out += [(300, out[-1][1], "en", "a"), (301, out[-1][1], "en", "a"), (302, out[-2][1], "en", "b")]
    return out


@pytest.fixture(scope="session")
def rows_of_documents():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents")
    spark.createDataFrame([(*d, *(["clash"] * len(CLASHING))) for d in documents()], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def library_ids():
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids
