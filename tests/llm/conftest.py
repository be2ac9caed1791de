import random

import pytest
from pyspark.sql import types as T

CLASHES = ["rid", "key", "n", "sketch", "spans", "start", "end", "bucket", "h", "body", "rep", "v"]
DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in CLASHES])


def prose(rng, n, syllables=("ta", "re", "no", "shi", "lo", "mé", "ku", "ras", "in", "the", "ed")):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    """Nulls, empty and long texts, copies, near copies, passages, periodic texts, repeated rows and ids."""
    rng = random.Random(5)
    out = [(i, prose(rng, rng.choice([3, 5, 40, 120, 300]))) for i in range(60)]
    base = [prose(rng, 400) for _ in range(6)]
    out += [(100 + i, b) for i, b in enumerate(base)] + [(110 + i, b) for i, b in enumerate(base[:3])]
    for k in range(25):  # near copies with some words changed
        w = base[k % 6].split(" ")
        for _ in range(rng.choice([1, 2, 8, 14, 20, 40])):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append((120 + k, " ".join(w)))
    passage = prose(rng, 130)
    out += [(200 + k, prose(rng, 90) + ".\n" + passage + "\n" + prose(rng, 60)) for k in range(20)]
    out += [(300, None), (301, ""), (302, "   \n\t "), (303, "one"), (304, "ONE"), (305, "a b c d"), (306, "日本語 текст 👩‍👧 é"), (307, "A " * 900), (308, "that, " * 500), (309, "x" * 3000)]
    out += [(310, "\x00\x1f odd \x85  white  space \n b"), (311, prose(rng, 9000)), (1, out[1][1]), (1, "the same id again, another text"), (None, "no id"), (None, base[0]), (312, "one"), (313, "token <|endoftext|> don't")]
    return out


@pytest.fixture(scope="session")
def corpus_rows():
    return corpus()


def write(spark, folder, rows, languages=("en", "fr", None)):
    full = [(i, t, languages[k % len(languages)], f"src{k % 3}" if k % 7 else None, len(t) if t is not None else None, *(["x"] * len(CLASHES))) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, DOCUMENTS).repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def folder(spark, corpus_rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    write(spark, d, corpus_rows)
    return d


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    write(spark, d, [])
    return d
