import collections
import math
import random
import zlib

from graphloom.llm import lm_scoring
from graphloom.llm.lm_scoring import score_texts


def automaton(texts, strength=lm_scoring.STRENGTH):
    """Explicit states with their arcs (probabilities), the weight of the failure arc and the state it leads to."""
    seen, arcs = collections.Counter(), collections.defaultdict(collections.Counter)
    for w in texts:
        for i, x in enumerate(w):
            for h in [(), tuple(["<s>", *w][i : i + 1]), tuple(w[i - 2 : i])][: 3 if i >= 2 else 2] + ([("<s>", w[0])] if i == 1 else []):
                arcs[h][x] += 1
                seen[h] += 1
    n, v = seen[()], len(arcs[()])
    root = {x: (c + 1) / (n + v + 1) for x, c in arcs[()].items()}
    states = {(): (root, 1 / (n + v + 1), None)}

    def p(h, x):
        if not h:
            return root.get(x, 1 / (n + v + 1))
        return (arcs[h][x] + strength * p(h[1:], x)) / (seen[h] + strength) if h in seen else p(h[1:], x)

    for h in [h for h in seen if h]:
        states[h] = ({x: p(h, x) for x in arcs[h]}, strength / (seen[h] + strength), h[1:])
    return states, n


def walk(states, w):
    """From left to right: the state is carried, failure arcs are taken until one has the word's arc."""
    total, history = 0.0, ("<s>",)
    for x in w:
        state = next(h for h in (history[-2:], history[-1:], ()) if h in states)
        while True:
            arcs, failure, shorter = states[state]
            if x in arcs or shorter is None:
                total += math.log10(arcs.get(x, failure))
                break
            total += math.log10(failure)
            state = shorter if shorter in states else ()
        history = (*history, x)[-2:]
    return total


def brute(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    docs = [(i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, [*lower(t).split(), "</s>"]) for i, t in rows]
    states, n = automaton([w for _, held, w in docs if not held])
    root, missing, _ = states[()]
    return [(i, held, len(w), sum(x in root for x in w), n, sum(math.log10(root.get(x, missing)) for x in w), walk(states, w)) for i, held, w in docs]


def agree(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=lambda r: (r[0] is None, r)), sorted(want, key=lambda r: (r[0] is None, r))):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) and abs(a[6] - b[6]) < 1e-6 * max(1, abs(b[6])), (a, b)


def test_against_counts(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["The", "the", "a", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "new words only"), (None, "the a"), (5, rows[5][1]), (903, "z " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "'x' as block", "0 as held_out").repartition(5)
    agree(score_texts(docs).collect(), brute(rows))


def test_text_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    agree(score_texts(docs).collect(), brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_empty_table_and_no_training_rows(spark):
    from pyspark.sql import functions as F

    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), held=F.lit(True)).first()
    assert (got.n_known, got.train_tokens, got.base_score, got.score) == (0, 0, 0.0, 0.0)


def test_packing():
    import numpy as np

    sorted_hashes = np.array([0, 5, 2**40, 2**64 - 1], np.uint64)
    assert (lm_scoring._unpack_sorted(lm_scoring._pack_sorted(sorted_hashes)) == sorted_hashes).all()

    for a in (np.arange(5), np.array([2**63], np.uint64), np.array([-3, 4]), np.zeros(0, np.int64), np.array([300, 70000])):
        assert (lm_scoring._unpack(lm_scoring._pack(a))[0] == a).all()


def test_states_sum_to_one():
    states, _ = automaton([w.split() for w in ("a b c </s>", "a b a </s>", "b b c a </s>")])
    words = sorted(states[()][0])
    for h in states:
        # and one word that training lacks
        total = sum(10 ** walk_from(states, h, x) for x in [*words, "?"])
        assert abs(total - 1) < 1e-9, h


def walk_from(states, state, x):
    log = 0.0
    while True:
        arcs, failure, shorter = states[state]
        if x in arcs or shorter is None:
            return log + math.log10(arcs.get(x, failure))
        log += math.log10(failure)
        state = shorter


def test_many_blocks_and_buckets(spark, monkeypatch):
    """Blocks of a few texts, more buckets than partitions."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(30)))) for i in range(400)]
    monkeypatch.setattr(lm_scoring, "BUCKET", 1 << 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    agree(score_texts(docs).collect(), brute(rows))


def test_differing_readings_are_an_error():
    import pyarrow as pa
    import pytest

    for bucket, texts in ((-1, b""), (0, None)):
        rows = [[7], [bucket], [None], [None], [0], [0], [texts]]
        with pytest.raises(RuntimeError):
            lm_scoring._score(pa.Table.from_batches([lm_scoring._table(lm_scoring._BACK, rows)]), 4.0)


def test_blocks_alike_in_all(spark):
    """Tasks whose rows are the same, ids too."""
    row = (4, "a b c a b")
    docs = spark.createDataFrame([row], "doc_id long, text string")
    agree(score_texts(docs.union(docs).union(docs)).collect(), brute([row] * 3))
