import base64
import random

import tiktoken
from pyspark.sql import functions as F

from graphloom.llm import token_counts as T
from graphloom.llm.queries import QUERIES

RAW = open(T.VOCABULARY, "rb").read()
ENCODING = tiktoken.Encoding("own", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks={base64.b64decode(a): int(b) for a, b in (x.split() for x in RAW.splitlines() if x)}, special_tokens={})


def test_edits_against_whole_texts():
    rng, counter = random.Random(5), T.Counter(RAW)
    letters = ["'", "r", "e", "l", " ", "  ", "\n", "é", "9", "!", " ", "word", "don't", "😀", "\x1c", "\x85"]
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for size in (0, 1, 3, 10, 200, 2000):
        for _ in range(30):
            text = make(size)
            pieces = T.PATTERN.findall(text)
            assert "".join(pieces) == text
            tree = T.Tree(list(map(len, pieces)), counter.counts(pieces))
            for _ in range(12):
                a = rng.randrange(len(text) + 2)
                text, _ = T.edit(text, tree, counter, a, a + rng.choice([0, 0, 1, 2, 5, 300]), make(rng.choice([0, 1, 2, 30, 400])))
                pieces = T.PATTERN.findall(text)
                assert tree.pieces() == (list(map(len, pieces)), counter.counts(pieces))
                assert tree.tokens[1] == len(ENCODING.encode_ordinary(text)) and tree.chars[1] == len(text)


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op3_token_counts"](spark, sf).collect()
    assert len(rows) == len(texts) and all(r.n_edits == 3 for r in rows)
    assert all(r.n_tokens == len(ENCODING.encode_ordinary(texts[r.doc_id])) for r in rows)
    assert sum(r.encoded_chars for r in rows) < 1.3 * sum(map(len, texts.values()))


def test_kept_trees_and_odd_rows(spark):
    rows = [(1, None, None), (2, "", [(0, 0, "new")]), (3, "a b c", [(2, 3, None), (None, None, "x"), (-5, 99, "all new")]), (None, "it's", [(9, 9, "re")]), (3, "a b c", []), (4, "long text " * 30000, [(150000, 150001, "Z")])]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits {T.EDITS}").withColumn("tree", F.lit("x"))
    got = sorted(T.count_tokens(docs, "edits", keep=True).collect(), key=str)
    assert all(r.n_tokens_after == len(ENCODING.encode_ordinary(r.text_after)) == sum(r.tree_after.counts) for r in got)
    assert {(r.id, r.text_after) for r in got if r.id != 4} == {(1, ""), (2, "new"), (3, "all new"), (None, "it'sre"), (3, "a b c")}
    assert next(r for r in got if r.id == 4).encoded_chars < 300100
    kept = spark.createDataFrame([(r.id, r.text_after, r.tree_after, [(0, 0, "A ")]) for r in got], f"doc_id long, text string, t struct<lengths: array<int>, counts: array<int>>, e {T.EDITS}")
    again = T.count_tokens(kept, "e", trees="t", keep=True).collect()
    assert all(r.n_tokens_after == len(ENCODING.encode_ordinary(r.text_after)) and r.encoded_chars < 30 for r in again)
    assert T.count_tokens(docs.limit(0), "edits").count() == 0
