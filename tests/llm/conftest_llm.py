import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: Documents that bring up every special case: NULL and empty texts, a NULL id, repeated rows,
#: ties, white space of all kinds, letters beyond ASCII and a very long text.
LONG = " ".join(f"w{i % 4999}x{i % 7}" for i in range(30_000))
PASSAGE = (
    "The committee met in the old hall on the hill above the river. Its members spoke of bridges and of "
    "tolls for most of the day. Nobody recalled who had asked for the meeting. In the evening a clerk read "
    "the list of debts aloud and the room emptied by twos and threes. The last to leave put out the lamps."
)
ROWS = [
    (1, "First line of text here\n  SAME line Here \t\nshort\nÉcole Straße İstanbul ß ǅ"),
    (2, "same LINE here\nother words follow after that\n\nSAME line here\nécole straße"),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r "),
    (6, LONG),
    (7, LONG.replace("w17x3", "changed", 1)),
    (8, "one two"),
    (9, "one two"),
    (9, "one two"),
    (None, "same line here\nand a text of its own"),
    (10, "a b c d e f g h a b c d e f g h a b c d e f g h i j k l"),
    (11, "emoji \U0001f600 and ́combining space \x1cfs  it's 12.5% <|endoftext|> </s>[INST]"),
    (12, "alpha beta gamma. " + PASSAGE + "\ndelta epsilon zeta."),
    (13, "eta theta iota.\n" + PASSAGE + " kappa lambda mu."),
    (14, "a" * 5000),
    (15, "x\n" * 50 + "x"),
    (16, "՘࢏ new letters \U0003fc3b and spaces　 here\x85there"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The special documents with further columns, some of them named like the operators' own."""
    rows = [
        (i, t, None if k == 3 else f"src{k % 3}", None if t is None else len(t), k, "x", [k], 0.5)
        for k, (i, t) in enumerate(ROWS)
    ]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, source string, n_chars bigint, row int, kept string, ids array<int>, score double"
    ).repartition(3)


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)



@pytest.fixture(scope="session")
def table(spark, sf_dir, docs):
    """The driver's documents and the special ones."""
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "doc_id + 1000 as doc_id", "text", "source", "n_chars", "0 as row", "'x' as kept", "array(1) as ids", "0.5 as score"
    )
    return own.unionByName(docs).repartition(4)
