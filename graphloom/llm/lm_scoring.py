"""Language-model scoring by a weighted backoff automaton (operator 8).

The model is a smoothed trigram model over whole words. As an automaton: a state for each pair of words, each
word and the start of a text that training holds, and a root; an arc for each word seen after a state in
training; and a failure arc from each state to the one of its last word, from that to the root, whose arcs are
the smoothed unigrams. A text is read once from left to right: the next word selects an arc of the state it is
in or, by way of failure arcs, one of a shorter state, and leads to the longest state that its last two words
have. With c for training counts, N and V for all and distinct training tokens,

    root:         p(w)      = (c(w) + 1) / (N + V + 1)
    failure arc:  a(h)      = STRENGTH / (c(h) + STRENGTH)             (1 where training lacks h: it is no state)
    arc:          p(w | h)  = c(h w) / (c(h) + STRENGTH) + a(h) p(w | h without its first word)

(Dirichlet smoothing), so that each state's probabilities sum to 1. As a state follows from the last two words,
the states of all of a block's texts are looked up as arrays, and a text's sum is taken over its places.

The automaton grows with the corpus and never meets in one place: words, and pairs with the words after them,
of blocks of texts (8 MB) go to buckets by their hashes, once per block and bucket and packed as arrays. Words
and pairs go by 64 bits, a word after a pair by 40 bits of its own among that pair's. Buckets, as many as the
bytes of the texts ask, add up the counts and send each block those of its own, which form the part of the
automaton that its texts can reach. All of N and V reach a block the same way, as each bucket tells its share.
Hot words cost a bucket one entry a block. The texts themselves are read a second time and meet the counts in
the last shuffle only. Both readings must cut the same blocks, as those of a table do; a block's name is a
fingerprint of its ids and words, so an error, not a wrong score, follows where they differ (then use staged()).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tables import partitions
from graphloom.llm.words import mix, slices, words

#: Bytes of text in a block, and for each bucket.
BLOCK, BUCKET = 8 << 20, 16 << 20
STRENGTH = 16.0
END, START = np.uint64(0x00E17D), np.uint64(0x57A127)
_SENT = "key long, block long, words binary, word_counts binary, pairs binary, pair_counts binary, after binary"
_BACK = "block long, bucket long, words binary, pairs binary, v long, n long, texts binary"
_SCORED = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _table(schema: str, columns: list) -> pa.RecordBatch:
    """Columns as a batch, by the schema's names and types."""
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, compressed; each in the narrowest type, its bytes by place."""
    out = []
    for a in arrays:
        kind = np.min_scalar_type(int(a.max())) if len(a) and a.dtype.kind in "ui" and a.min() >= 0 else a.dtype
        a = np.ascontiguousarray(a.astype(kind))
        planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b""
        body = pa.compress(planes, codec="zstd", asbytes=True)
        out += [np.array([len(body), len(planes), a.itemsize, ord(a.dtype.kind)], np.int64).tobytes(), body]
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(data):
        n, size, width, kind = np.frombuffer(data, np.int64, 4, at)
        planes = pa.decompress(data[at + 32 : at + 32 + n], int(size), codec="zstd", asbytes=True) if size else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).reshape(-1).view(f"{chr(kind)}{width}") if size else np.zeros(0, f"{chr(kind)}{width}"))
        at += 32 + n
    return out


def _pack_sorted(hashes: np.ndarray) -> bytes:
    return _pack(np.diff(hashes, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data)[0], dtype=np.uint64)


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's hashes begin in sorted hashes: a bucket is a range of hashes."""
    step = ((1 << 64) + buckets - 1) // buckets
    return np.append(np.searchsorted(hashes, np.array([i * step for i in range(buckets)], np.uint64)), len(hashes))


def _pairs(seq: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct pairs of a block, and the place of each word's pair among them.

    seq: places of words in hashes, text after text; first: where texts begin.
    """
    code = np.empty(len(seq), np.int64)
    code[1:] = seq[:-1]
    code[first] = len(hashes)
    code *= len(hashes) + 1
    code += seq
    made, place = np.unique(code, return_inverse=True)
    place = place.astype(np.int32)
    known = np.append(hashes, START)
    both = mix(known[made // (len(hashes) + 1)] * np.uint64(0x2545F4914F6CDD1D) + known[made % (len(hashes) + 1)])
    order = np.argsort(both)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return both[order], rank[place]


def _after(seq: np.ndarray, first: np.ndarray, place: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pair and the word after it, of each distinct triple by pair and word, and the place of each word's triple.

    A text's first word has none: -1.
    """
    inner = np.ones(len(seq), bool)
    inner[first] = False
    code = place[:-1][inner[1:]].astype(np.int64)
    code *= n_words
    code += seq[inner]
    made, own = np.unique(code, return_inverse=True)
    triple = np.full(len(seq), -1, np.int32)
    triple[inner] = own
    return made // n_words, made % n_words, triple


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each block of a task: its name (a fingerprint of ids and words), its rows, their numbers of tokens, all tokens' hashes."""
    for part in slices(batches, limit=BLOCK):
        w = words(part.column("text"))
        lengths = np.diff(w.doc_at) + 1
        last = np.cumsum(lengths) - 1
        tokens = np.empty(len(w.hashes) + part.num_rows, np.uint64)
        inner = np.ones(len(tokens), bool)
        inner[last] = False
        tokens[inner], tokens[last] = w.hashes, END
        del w, inner
        ids = part.column("id").fill_null(-1).to_numpy().astype(np.uint64)
        name = np.sum(mix(tokens + np.arange(len(tokens), dtype=np.uint64))) + np.sum(mix(ids * END + np.arange(len(ids), dtype=np.uint64)))
        yield int(name >> np.uint64(1)), part, lengths, tokens


def _send(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part, lengths, tokens in _blocks(batches):
            first = np.cumsum(lengths) - lengths
            train = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool), lengths)
            hashes, seq = np.unique(tokens, return_inverse=True)
            seq = seq.astype(np.int32)
            del tokens
            counts = np.bincount(seq[train], minlength=len(hashes))
            pairs, place = _pairs(seq, first, hashes)
            pair_counts = np.bincount(place[train], minlength=len(pairs))
            pair_of, word_of, triple = _after(seq, first, place, len(hashes))
            triple_counts = np.bincount(triple[train & (triple >= 0)], minlength=len(pair_of))
            followers = np.bincount(pair_of, minlength=len(pairs))
            next_words = hashes[word_of] >> np.uint64(24)
            cw, cp = _cuts(hashes, buckets), _cuts(pairs, buckets)
            ct = np.searchsorted(pair_of, cp)
            out = []
            for b in range(buckets):
                i, j, t = (slice(c[b], c[b + 1]) for c in (cw, cp, ct))
                out.append((b, block, _pack_sorted(hashes[i]), _pack(counts[i]), _pack_sorted(pairs[j]), _pack(pair_counts[j]), _pack(followers[j], next_words[t], triple_counts[t])))
            yield _table(_SENT, list(zip(*out)))

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's texts as places of words, the most frequent word first."""
    for block, part, lengths, tokens in _blocks(batches):
        hashes, seq = np.unique(tokens, return_inverse=True)
        by_use = np.argsort(-np.bincount(seq), kind="stable")
        rank = np.empty(len(by_use), np.int64)
        rank[by_use] = np.arange(len(by_use))
        ids, held = part.column("id"), part.column("held_out").to_numpy(zero_copy_only=False)
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        small = np.min_scalar_type(len(by_use))
        sent = _pack(ids.fill_null(0).to_numpy(), named.astype(np.uint8), held.astype(np.uint8), lengths, rank[seq], rank.astype(small)) + _pack_sorted(hashes)
        yield _table(_BACK, [[block], [-1], [None], [None], [0], [0], [sent]])


def _sums(found: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The totals of each hash, and for each block those of its own."""
    made, place = np.unique(np.concatenate(found), return_inverse=True)
    totals = np.bincount(place, weights=np.concatenate(counts).astype(np.float64), minlength=len(made)).astype(np.int64)
    return np.split(totals[place], np.cumsum([len(x) for x in found])[:-1]), totals


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's counts, back to the blocks. Each bucket is a partition of its own."""
    received = list(batches)
    if not received:
        return
    table = pa.Table.from_batches(received)
    get = lambda c: table.column(c).to_pylist()
    w, totals = _sums([_unpack_sorted(x) for x in get("words")], [_unpack(x)[0] for x in get("word_counts")])
    pairs = [_unpack_sorted(x) for x in get("pairs")]
    p, _ = _sums(pairs, [_unpack(x)[0] for x in get("pair_counts")])
    keys, counts = [], []
    for own, x in zip(pairs, get("after")):
        followers, next_words, c = _unpack(x)
        keys.append(mix(np.repeat(own, followers.astype(np.int64)) * np.uint64(0x9FB21C651E98DF25) + next_words.astype(np.uint64)))
        counts.append(c)
    t, _ = _sums(keys, counts)
    n = table.num_rows
    v, all_tokens = int((totals > 0).sum()), int(totals.sum())
    packed = [_pack(x, y) for x, y in zip(p, t)]
    yield _table(_BACK, [table.column("block").to_pylist(), get("key"), [_pack(x) for x in w], packed, [v] * n, [all_tokens] * n, [None] * n])


def _score(table: pa.Table, strength: float) -> pa.Table:
    """A block's texts with its part of the automaton."""
    bucket = table.column("bucket").to_numpy()
    texts = np.flatnonzero(bucket < 0)
    # blocks that are alike in all share a name, and each one's counts are the same
    found, back = np.unique(bucket, return_index=True)
    if not len(texts) or len(found) < 2 or len(table) != len(texts) * len(found):
        raise RuntimeError("two readings of the texts differ; write them to a table first")
    get = lambda c: [table.column(c)[int(i)].as_py() for i in back[1:]]
    c_word = np.concatenate([_unpack(x)[0].astype(np.int64) for x in get("words")])
    counts = [_unpack(x) for x in get("pairs")]
    c_pair, c_triple = (np.concatenate([x[k].astype(np.int64) for x in counts]) for k in (0, 1))
    of_each = [_walk(table.column("texts")[int(i)].as_py(), c_word, c_pair, c_triple, sum(get("v")), sum(get("n")), strength) for i in texts]
    return pa.Table.from_batches(of_each)


def _walk(sent: bytes, c_word: np.ndarray, c_pair: np.ndarray, c_triple: np.ndarray, v: int, n: int, strength: float) -> pa.RecordBatch:
    """Reads texts through the automaton: the state before each word, the arcs that it takes, their sum by text."""
    ids, named, held, lengths, ranks, rank, steps = _unpack(sent)
    hashes = np.cumsum(steps, dtype=np.uint64)
    place = np.empty(len(hashes), np.int64)
    place[rank] = np.arange(len(hashes))
    seq, lengths = place[ranks].astype(np.int32), lengths.astype(np.int64)
    first = np.cumsum(lengths) - lengths
    _, pair = _pairs(seq, first, hashes)
    _, _, triple = _after(seq, first, pair, len(hashes))
    # the root's arcs, then those of one word's state: a text's start was seen as often as an end
    root = ((c_word + 1) / (n + v + 1))[seq]
    seen = np.append(c_word, c_word[np.searchsorted(hashes, END)])
    before = np.append(-1, seq[:-1])
    before[first] = len(hashes)
    p = (c_pair[pair] + strength * root) / (seen[before] + strength)
    # the arcs of the states of two words, and the failure arcs that lead from them
    at = np.flatnonzero(triple >= 0)
    p[at] = (c_triple[triple[at]] + strength * p[at]) / (c_pair[pair[at - 1]] + strength)
    per_text = lambda x: np.add.reduceat(x, first)
    known = per_text((c_word[seq] > 0).astype(np.int64))
    row_ids = pa.array(ids.astype(np.int64), mask=named == 0)
    return _table(_SCORED, [row_ids, held.astype(bool), lengths, known, np.full(len(ids), n), per_text(np.log10(root)), per_text(np.log10(p))])


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, strength: float = STRENGTH) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs.

    held marks the rows that the model doesn't learn from (remainder 2 of 7, if none is given). A null or empty
    text is one token, its end. base_score sums log10 of the root's arcs, score those the automaton takes.
    strength is how much a state's shorter one counts against what was seen in it.
    docs is read three times (its bytes, counts, texts) and must read alike each time, as tables do.
    Repeated rows count as often as they occur. Without training rows all counts are 0. Empty table: empty result.
    """
    held = held_out(F.col(id_col), 7, 2) if held is None else held
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(held, F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-size // BUCKET))
    counted = rows.mapInArrow(_send(buckets), _SENT).repartitionById(buckets, F.col("key").cast("int")).mapInArrow(_add, _BACK)
    both = counted.unionByName(rows.mapInArrow(_texts, _BACK))
    return both.repartition(buckets, "block").groupBy("block").applyInArrow(lambda t: _score(t, strength), _SCORED)
