import random
import re

from graphloom.llm.minhash_dedup import near_duplicates, one_of_each


def brute(rows, percent=85):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def check(spark, rows):
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_chains_of_edits(spark):
    rng, rows = random.Random(1), []
    for g in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 60, 200]))]
        for _ in range(rng.choice([1, 2, 8])):
            rows.append((rng.randrange(10**9), " ".join(words)))
            if rng.random() < 0.7:
                words = list(words)
                words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
    check(spark, rows)


def test_odd_texts(spark):
    rows = [(9, None), (8, ""), (7, " \t"), (6, "One two"), (5, "one\vTWO"), (4, "two one"), (3, "a b c d e"), (2, "a b c d e"), (1, "é " * 30000)]
    check(spark, rows)


def test_empty_table_and_more_columns(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(1, "a b", 3, "x"), (1, "a b", 3, "x"), (None, "a b", 4, None)], "doc_id long, text string, key long, rep string")
    got = sorted(near_duplicates(rows).collect(), key=str)
    assert [(r.id, r.component_id, r.kept) for r in got] == [(1, 1, True), (1, 1, True), (None, None, True)]


def test_texts_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a + " end"), (3, "start " + b), (0, b), (5, c), (1, c + " x"), (7, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = sorted((r.id, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == sorted([(1, 1, True), (1, 0, False), (1, 0, False), (2, 1, False), (3, 0, False), (0, 0, True), (5, 1, False), (1, 1, True), (7, 7, True)])
    left = one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(1, a), (0, b), (1, c + " x"), (7, "")])
