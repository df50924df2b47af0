"""Benchmark decontamination by latent semantic retrieval (operator 1).

1. Document frequencies of hashed words over all documents; the buckets of each text's words are kept from the same reading.
2. A randomised SVD of the TF-IDF matrix of passages: all words of all documents (each text once, so that copies
   do not count more) and of the benchmark's items, in runs of PASSAGE words. A first pass over the distributed rows
   multiplies by A'A, a second one tells the inner products of A with the range found, which is all that Rayleigh-Ritz needs of A'A there;
   only one matrix of BUCKETS rows and a small one meet on the driver, whatever the input. The passages of a text weigh
   LONG at most together, so that long texts and items don't crowd out short ones; where those of the documents weigh more than
   BALANCE, the items weigh more in proportion, so that a larger table leaves them their share of the subspace.
3. Every window of every document is projected and compared with the items by cosine: the inner product within
   the subspace over the whole vectors' norms, divided by the share of the item's own energy that the subspace
   holds. A copy scores 1, and text about other things little, however few dimensions there are. Windows of whose norm the
   subspace holds too little for any item's cosine are not compared with the items.
   Beside that, items of at most SHORT words are found by words: a text that shares enough of an item's words in order holds, within
   some stretch, at least as many of them less those left out as too common. Counted by cells of half an item's
   length, this loses no stretch of up to one and a half times the item's length. The cosine of such a place must
   reach COSINE_BY_WORDS only, so that a few frequent words in order are not taken for a short item.
4. Candidates are verified on the words: the longest common subsequence of item and region must cover
   LCS_SHARE of the item, or PARAPHRASE_SHARE of it with the item's answer (its last sentence) in the region.

Windows come in a few sizes, each a fixed number of blocks of STEP words, so that all window sums come from
one sum per block. An item of more than SHORT words is cut into pieces of at most a widest window's length (PIECE
words); each piece is compared with the windows of the size nearest its own, and a piece that is found
proposes where the whole item would stand. If a text keeps a share of an item in order, it keeps at least that
share of one of its pieces, and of one in many pieces mostly far more, so long items need no search by words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.sampling import SUMS, groups, parts_of, summed, total_of
from graphloom.llm.tables import drop, staged
from graphloom.llm.words import mix, slices, words

BUCKETS, RANK, OVERSAMPLED, ITEM_WEIGHT = 16384, 64, 72, 30.0
PASSAGE, LONG, BALANCE = 48, 4, 60_000
#: So many passages are multiplied together, and by one task; buckets with more than FREQUENT words of those together are summed one by one.
TOGETHER, A_TASK, FREQUENT = 2_000, 500_000, 32
#: So many rows of matrices are added up or multiplied at a time: they stay in a core's cache.
ROWS = 512
#: So many bytes of text are cut into passages or searched at a time (or one text), and so many are cut into words, for the same reason.
BYTES, TOKENIZED = 1 << 18, 1 << 16
#: The columns of _tokens; a task remembers so many texts.
TOKENS, SEEN = ["part", "salt", "sums", "key", "other", "words"], 200_000
STEP, WINDOWS, STRIDES = 4, (4, 8, 13), (1, 2, 3)  # in blocks of STEP words
LEAST_COSINE, LCS_SHARE, PARAPHRASE_SHARE, ANSWER_SHARE = 0.5, 0.6, 0.4, 0.8
PIECE = STEP * WINDOWS[-1]
#: Items of up to so many words are whole pieces and are found by words too; pieces of longer ones need a lower cosine only.
SHORT, PIECE_COSINE = 80, 0.4
#: The least cosine of places found by words.
COSINE_BY_WORDS = 0.25
#: Words are looked up by so many values of their hashes first.
SIEVE = 1 << 18
#: So many postings are looked at together, and so many words of regions.
POSTINGS, REGIONS = 1_000_000, 1 << 16
#: So many cosines are in memory together, or those of 64 windows; windows are kept for them until there are so many.
MATRIX, WINDOWS_AT_ONCE = 4_000_000, 8_192
#: Of the words that a match needs, this share may be of those not looked up; and items in one index of words.
COMMON, ITEMS_AN_INDEX = 0.6, 2_000
#: Items are compared so many, and so many bytes of them, at a time; more take another pass over the documents.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 20_000, 32 << 20


def bucketed(texts: pa.Array):
    w = words(texts, chunk=TOKENIZED)
    return w, (w.hashes >> np.uint64(50)).astype(np.int64)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: the buckets of each text's words, with the text's hashes; and, as in summed(), in how many texts each bucket occurs and the number of texts. Copies in a task mostly come once, so that no text has many rows."""
    total, seen = np.zeros(BUCKETS + 1), set()
    for part in groups(batches):
        w, bucket = bucketed(part.column("text"))
        held = np.zeros((part.num_rows, BUCKETS), bool)
        held[w.doc_of(), bucket] = True
        total[:-1] += held.sum(0)
        total[-1] += part.num_rows
        if len(seen) > SEEN:
            seen.clear()
        words_of = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((2 * w.doc_at).astype(np.int32)), pa.py_buffer(bucket.astype(np.int16))])
        nulls = [pa.nulls(part.num_rows, x) for x in (pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*nulls, part.column("key"), part.column("other"), words_of], names=TOKENS).filter(_new(part, seen))
    rows = parts_of(total)
    yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.nulls(rows.num_rows, x) for x in (pa.int64(), pa.int64(), pa.binary()))], names=TOKENS)


def _new(part: pa.RecordBatch, seen: set[int]) -> pa.Array:
    """Which rows' texts, by two hashes as one, are not among the seen ones; now they are."""
    out = []
    for key, other in zip(part.column("key").to_pylist(), part.column("other").to_pylist()):
        both = (key << 64) + other
        out.append(both not in seen)
        seen.add(both)
    return pa.array(out, pa.bool_())


def _cut(bucket: np.ndarray, doc_at: np.ndarray, idf: np.ndarray) -> pa.RecordBatch:
    """Every word of every text, in runs of PASSAGE words of one text (its last run may be shorter): their buckets, one over the TF-IDF norm, and the weight."""
    doc = np.repeat(np.arange(len(doc_at) - 1), np.diff(doc_at))
    begins = (np.arange(len(bucket)) - doc_at[doc]) % PASSAGE == 0
    first = np.flatnonzero(begins)
    cell, count = np.unique((np.cumsum(begins) - 1) * BUCKETS + bucket, return_counts=True)
    value = count * idf[cell % BUCKETS]
    share = 1 / np.maximum(np.sqrt(np.bincount(cell // BUCKETS, value * value, len(first))), 1e-12)
    of = doc[first]
    weight = np.minimum(1.0, LONG / np.bincount(of, minlength=1)[of])
    offsets = 2 * np.append(first, len(bucket)).astype(np.int32)
    body = pa.py_buffer(bucket.astype(np.int16).tobytes())
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), body]), pa.array(share), pa.array(weight)], names=["passage", "share", "weight"])


def _passages(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=BYTES):
            w, bucket = bucketed(part.column("text"))
            yield _cut(bucket, w.doc_at, idf)

    return run


def _passages_once(idf: np.ndarray):
    """Of _tokens, where all rows of a text are in one task: each text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, "words", BYTES // 2):
            own, doc_at = _packed(part.filter(_new(part, seen)).column("words"))
            yield _cut(own.astype(np.int64), doc_at, idf)

    return run


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all rows, one after the other, and where each row's begin (and the last end)."""
    held = column.cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1] // 2 if len(held) else np.zeros(1, np.int64)
    return (np.frombuffer(held.buffers()[2], np.int16)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.int16)), offsets - offsets[0]


def passages(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(passage, share, weight) of texts, one column text."""
    return texts.mapInArrow(_passages(idf), "passage binary, share double, weight double")


def _products(batches: Iterator[pa.RecordBatch], scaled: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(buckets, their passages, sums, shares, weights) of TOGETHER passages at a time: a passage's sum is of its words' rows of scaled, whose last row is 0."""
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            own, offsets = _packed(part.column("passage"))
            # short passages are filled up with a word of no weight
            table = np.full((PASSAGE, part.num_rows), BUCKETS, np.int64)
            row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            table[np.arange(len(own)) - offsets[row], row] = own
            left, more = np.empty((part.num_rows, scaled.shape[1])), np.empty((ROWS, scaled.shape[1]))
            for lo in range(0, part.num_rows, ROWS):
                some = left[lo : lo + ROWS]
                scaled.take(table[0, lo : lo + ROWS], 0, out=some, mode="clip")
                for words_at in table[1:, lo : lo + ROWS]:
                    some += scaled.take(words_at, 0, out=more[: len(some)], mode="clip")
            yield own, row, left, part.column("share").to_numpy(), part.column("weight").to_numpy()


def _scaled(idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return np.vstack([idf[:, None] * basis, np.zeros(basis.shape[1])])


def _multiply(idf: np.ndarray, basis: np.ndarray):
    """A'A times the basis, a task's share of it; A's rows are unit TF-IDF passages times the root of their weight."""
    scaled = _scaled(idf, basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, scaled.shape[1]))  # and so basis itself isn't sent
        for own, row, left, share, weight in _products(batches, scaled):
            left *= (np.square(share) * weight)[:, None]
            _add(total, own, left, row)
        yield parts_of(idf[:, None] * total)

    return run


def _gram(idf: np.ndarray, basis: np.ndarray):
    """The basis' transpose times A'A times the basis, a task's share of it: of A times the basis, no more than its rows' inner products."""
    scaled = _scaled(idf, basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((scaled.shape[1],) * 2)
        for _, _, left, share, weight in _products(batches, scaled):
            left *= (share * np.sqrt(weight))[:, None]
            total += left.T @ left
        yield parts_of(total)

    return run


def _add(total: np.ndarray, bucket: np.ndarray, left: np.ndarray, row: np.ndarray) -> None:
    """Adds to each word's bucket its passage's row of left."""
    order = np.argsort(bucket, kind="stable")
    row, bucket = row[order], bucket[order]
    begins = np.flatnonzero(np.append(True, np.diff(bucket) > 0)[: len(bucket)])
    size = np.diff(np.append(begins, len(bucket)))
    for at, n in zip(begins[size > FREQUENT], size[size > FREQUENT]):
        total[bucket[at]] += left.take(row[at : at + n], 0).sum(0)
    # of the others, all first words together, then all second ones
    few = np.flatnonzero(size <= FREQUENT)
    few = few[np.argsort(-size[few], kind="stable")]
    sums, more = np.empty((2, ROWS, total.shape[1]))
    for lo in range(0, len(few), ROWS):
        some = few[lo : lo + ROWS]
        sums[:] = 0
        for k in range(int(size[some[0]])):
            n = int(np.searchsorted(-size[some], -k, "left"))
            sums[:n] += left.take(row[begins[some[:n]] + k], 0, out=more[:n], mode="clip")
        total[bucket[begins[some]]] += sums[: len(some)]


def latent_basis(rows: DataFrame, idf: np.ndarray) -> np.ndarray:
    """BUCKETS * RANK: the leading right singular vectors, by a random start, one power step and Rayleigh-Ritz."""
    start = np.random.default_rng(1).normal(size=(BUCKETS, OVERSAMPLED))
    once = summed(rows, _multiply(idf, start))
    if once is None:
        return start[:, :RANK]
    q = np.linalg.qr(once.reshape(BUCKETS, -1))[0]
    inner = summed(rows, _gram(idf, q)).reshape(q.shape[1], -1)
    vectors = np.linalg.eigh((inner + inner.T) / 2)[1][:, ::-1]
    return q @ vectors[:, :RANK]


@dataclass
class Weighted:
    """By bucket, and 0 for one more: the projection of its weight, and the weight's square."""

    projection: np.ndarray
    square: np.ndarray


@dataclass
class Items:
    """Benchmark items: ids, lengths, word hashes (also distinct ones and their counts), and answers (place of the last sentence).

    of, at, size, vectors: of each piece, its item, its first word there, its window size and scaled latent vector; first: each item's first piece.
    least, cell: by item, how many of its looked-up words a match has, and half its length; index: see _index.
    keys, times: of all items' words, word and item as one number (sorted), and how often; sieve: which numbers there may be.
    """

    ids: list[int]
    length: np.ndarray
    hashes: list[np.ndarray]
    known: list[tuple[np.ndarray, np.ndarray]]
    answers: list[int]
    of: np.ndarray
    at: np.ndarray
    first: np.ndarray
    size: np.ndarray
    vectors: np.ndarray
    least: np.ndarray
    cell: np.ndarray
    index: list[tuple[np.ndarray, ...]]
    keys: np.ndarray
    times: np.ndarray
    sieve: np.ndarray


def _sieved(word: np.ndarray) -> np.ndarray:
    """Places of words in a sieve."""
    return (word >> np.uint64(65 - SIEVE.bit_length())).astype(np.int64)


def _index(known: list[tuple[np.ndarray, np.ndarray]], weighted: Weighted, share: float) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """How many looked-up words a match of this share has, by item; and, of items of at most SHORT words, (the first word of each cell of a sieve, words, their first postings, postings: items, times there) for so many items at a time."""
    least, kept = np.zeros(len(known), np.int64), []
    for i, (own, times) in enumerate(known):
        if times.sum() > SHORT:
            kept.append((own[:0], times[:0]))
            continue
        needed = max(1, int(np.ceil(share * times.sum() - 1e-9)))
        spare, looked_up = int(COMMON * needed), np.ones(len(own), bool)
        for k in np.argsort(weighted.square[(own >> np.uint64(50)).astype(np.int64)], kind="stable"):
            if times[k] <= spare:
                spare, looked_up[k] = spare - times[k], False
        least[i] = needed - times[~looked_up].sum()
        kept.append((own[looked_up], times[looked_up]))
    index = []
    for at in range(0, len(kept), ITEMS_AN_INDEX):
        some = kept[at : at + ITEMS_AN_INDEX]
        word, times = (np.concatenate(x) for x in zip(*some))
        item = np.repeat(np.arange(at, at + len(some)), [len(x) for x, *_ in some])
        order = np.argsort(word, kind="stable")
        distinct, first = np.unique(word[order], return_index=True)
        # the first word in each cell, or -1
        held, cell = np.full(SIEVE, -1, np.int32), _sieved(distinct)
        held[cell[::-1]] = np.arange(len(distinct))[::-1]
        if len(word):
            index.append((held, distinct, np.append(first, len(word)), item[order], times[order]))
    return least, index


def _items(rows: list, weighted: Weighted, share: float) -> Items:
    texts = [r.text or "" for r in rows]
    w, bucket = bucketed(pa.array(texts, pa.string()))
    hashes = np.split(w.hashes, w.doc_at[1:-1])
    length = np.diff(w.doc_at)
    cuts = [np.linspace(0, n, (-(-n // PIECE) if n > SHORT else 1) + 1).astype(np.int64) for n in length]
    of = np.repeat(np.arange(len(cuts)), [len(c) - 1 for c in cuts])
    at, until = np.concatenate([c[:-1] for c in cuts]), np.concatenate([c[1:] for c in cuts])
    own = [bucket[w.doc_at[i] + a : w.doc_at[i] + z] for i, a, z in zip(of, at, until)]
    vectors = np.stack([weighted.projection[b].sum(0, dtype=np.float64) for b in own])
    norm = np.sqrt([[weighted.square[b].sum()] for b in own])
    held = (vectors * vectors).sum(1, keepdims=True) / np.maximum(norm * norm, 1e-12)
    vectors = vectors / np.maximum(norm * held, 1e-12)
    answers = []
    for i, h in enumerate(hashes):
        stops = [k for k in range(len(h) - 1) if w.body[w.ends[w.doc_at[i] + k] - 1] in b".?!"]
        answers.append(stops[-1] + 1 if stops else max(0, len(h) - 5))
    size = np.abs((until - at)[:, None] - STEP * np.array(WINDOWS)).argmin(1)
    known = [np.unique(h, return_counts=True) for h in hashes]
    least, index = _index(known, weighted, share)
    cell = np.array([max(1, -(-len(h) // 2)) for h in hashes], np.int64)
    keys = _joint(np.concatenate([x for x, _ in known]), np.repeat(np.arange(len(known)), [len(x) for x, _ in known]))
    order = np.argsort(keys)
    sieve = np.zeros(1 << max(16, int(32 * len(keys)).bit_length()), bool)
    sieve[_half(np.concatenate([x for x, _ in known]) ^ _salt(np.repeat(np.arange(len(known)), [len(x) for x, _ in known]))) >> np.uint32(33 - len(sieve).bit_length())] = True
    return Items(
        [r.item for r in rows], length, hashes, known, answers, of, at, np.searchsorted(of, np.arange(len(cuts))), size, vectors.astype(np.float32), least, cell, index,
        keys[order], np.concatenate([x for _, x in known])[order], sieve,
    )


def _joint(word: np.ndarray, item: np.ndarray) -> np.ndarray:
    """A word's hash and an item's number as one number."""
    return mix(word ^ _salt(item))


def _salt(item: np.ndarray) -> np.ndarray:
    return (item.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def _half(x: np.ndarray) -> np.ndarray:
    """The upper half of hashes."""
    return (x >> np.uint64(32)).astype(np.uint32)


def _enough(hashes: np.ndarray, items: Items, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, share: float) -> np.ndarray:
    """Which regions hold this share of the item's words in any order: no subsequence is longer than what the two have in common."""
    out = np.zeros(len(item), bool)
    needed = share * items.length
    ends = np.cumsum(hi - lo)
    first, half, salt = 0, _half(hashes), _salt(item)
    salted, shift = _half(salt), np.uint32(33 - len(items.sieve).bit_length())
    while first < len(item):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + REGIONS, "right")))
        size = (hi - lo)[first:last]
        region = np.repeat(np.arange(last - first), size)
        word = np.arange(len(region)) + (lo[first:last] - (np.cumsum(size) - size)).take(region)
        # half of each hash tells most words that are not in the item
        key = half.take(word) ^ salted[first:last].take(region)
        here = np.flatnonzero(items.sieve.take(key >> shift, mode="clip"))
        region = region[here]
        key = mix(hashes.take(word[here]) ^ salt[first:last].take(region))
        place = np.minimum(items.keys.searchsorted(key), len(items.keys) - 1)
        right = items.keys[place] == key
        at = np.sort(region[right] * len(items.keys) + place[right])
        begins = np.flatnonzero(np.append(True, np.diff(at) > 0)[: len(at)])
        n = np.minimum(np.diff(np.append(begins, len(at))), items.times[at[begins] % len(items.keys)])
        out[first:last] = np.bincount(at[begins] // len(items.keys), weights=n, minlength=last - first) >= needed[item[first:last]]
        first = last
    return out


def common_subsequence(item: np.ndarray, region: np.ndarray) -> int:
    """The length of the longest common subsequence, a bit per word of the item."""
    masks: dict[int, int] = {}
    for k, h in enumerate(item.tolist()):
        masks[h] = masks.get(h, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for h in region.tolist():
        m = masks.get(h)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _runs(x: np.ndarray) -> list[np.ndarray]:
    """For each size of windows, the sums of so many rows from each row on. A sum is of its own rows, added in pairs: what else is in x plays no part."""
    out, done, width = [x[:0]] * len(WINDOWS), [0] * len(WINDOWS), 1
    while True:
        for i, size in enumerate(WINDOWS):
            if size & width:
                more = x[done[i] :]
                out[i] = out[i][: len(more)] + more if done[i] else more
                done[i] += width
        if 2 * width > WINDOWS[-1]:
            return out
        x, width = x[:-width] + x[width:], 2 * width


def _window_sums(table: np.ndarray, weighted: Weighted) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """(first block, projections, squares), ROWS blocks of a table of blocks at a time: of the windows of each size from each of them. The last blocks, less than the longest window, may have none."""
    kinds = [(x, *(np.empty((ROWS + WINDOWS[-1] - 1, *x.shape[1:]), x.dtype) for _ in range(2))) for x in (weighted.projection, weighted.square)]
    for at in range(0, len(table) - WINDOWS[-1] + 1, ROWS):
        some, out = np.ascontiguousarray(table[at : at + ROWS + WINDOWS[-1] - 1].T), []
        for by_bucket, blocks, more in kinds:
            blocks, more = blocks[: some.shape[1]], more[: some.shape[1]]
            by_bucket.take(some[0], 0, out=blocks, mode="clip")
            for k in range(1, STEP):
                blocks += by_bucket.take(some[k], 0, out=more, mode="clip")
            out.append(_runs(blocks))
        yield at, *out


def _norm(square: np.ndarray, energy: np.ndarray) -> np.ndarray:
    """Of windows, by their squares and those of their projections. Where words repeat, the occurrences' own squares are too little; the projection alone is never more than the whole."""
    return np.sqrt(np.maximum(np.maximum(square, energy), 1e-6))


def _energy(vector: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", vector, vector)


def _found(part: pa.Array, items: Items, weighted: Weighted, limits: tuple[float, float, float]) -> list[tuple[int, int, float, float, bool, int]]:
    """(row, item, cosine, share of the item's words, whether its answer is there, first word of the window)."""
    w, bucket = bucketed(part)
    lengths = np.diff(w.doc_at)
    blocks = -(-lengths // STEP)
    # each text has so many blocks of no weight after it that windows may reach over its end
    block_at = np.append(0, np.cumsum(np.where(blocks > 0, blocks + WINDOWS[-1], 0)))
    if not block_at[-1]:
        return []
    table, word_of = np.full(block_at[-1] * STEP, BUCKETS, np.int64), w.doc_of()
    table[np.arange(len(bucket)) + (block_at[:-1] * STEP - w.doc_at[:-1])[word_of]] = bucket
    table, doc = table.reshape(-1, STEP), np.repeat(np.arange(len(lengths)), blocks)
    inside = np.arange(len(doc)) - (np.cumsum(blocks) - blocks)[doc]
    place, sought = block_at[doc] + inside, []
    for size, stride in enumerate(STRIDES):
        own = np.flatnonzero(items.size == size)
        own = own[items.length[items.of[own]] > 0]
        least = np.where(items.length[items.of[own]] > SHORT, min(limits[0], PIECE_COSINE), limits[0]).astype(np.float32)
        # a text's windows; the last ones reach over its end, so that short texts and ends have some
        first = np.flatnonzero(inside % stride == 0)
        if len(own):
            right = items.vectors[own]
            # no cosine is more than the share of a window's norm that the subspace holds, times the item's length there; less some room for rounding
            bound = np.float32((1 - 1e-4) / (np.sqrt(_energy(right)) / least).max())
            sought.append((size, own, least, right.T, bound * bound, first, place[first].searchsorted(np.arange(0, len(table) + ROWS, ROWS)), []))
    near: list[tuple[np.ndarray, ...]] = []
    half = STEP * np.array(WINDOWS) // 2

    def compare(size: int, own: np.ndarray, least: np.ndarray, right: np.ndarray, held: list) -> None:
        x, vector = (np.concatenate(y) for y in zip(*held))
        held.clear()
        together = max(64, MATRIX // len(own))
        for at in range(0, len(x), together):
            cosine = vector[at : at + together] @ right
            k = np.flatnonzero(cosine >= least)
            if len(k):
                k, i = np.divmod(k, len(own))
                block = x[at + k]
                near.append(_peaks(doc[block], own[i], inside[block] * STEP, cosine[k, i], half[size]))

    for begin, vectors, squares in _window_sums(table, weighted):
        for size, own, least, right, bound, first, cuts, held in sought:
            x = first[cuts[begin // ROWS] : cuts[begin // ROWS + 1]]
            energy = _energy(vectors[size])
            norm = _norm(squares[size], energy)
            row = place[x] - begin
            some = np.flatnonzero((energy >= bound * (norm * norm)).take(row))
            if len(some):
                row = row[some]
                held.append((x[some], vectors[size].take(row, 0) / norm.take(row)[:, None].astype(np.float32)))
                if sum(len(y) for y, _ in held) >= WINDOWS_AT_ONCE:
                    compare(size, own, least, right, held)
    for size, own, least, right, *_, held in sought:
        if held:
            compare(size, own, least, right, held)
    # once more, as these were cut apart
    row, piece, start, cosine = _all(near, (np.int64, np.int64, np.int64, np.float64))
    row, piece, start, cosine = _proposals(_peaks(row, piece, start, cosine, half[items.size[piece]]), items)
    item, k, window = items.of[piece], len(piece), start // STEP
    by_word = _all(_by_words(w, items), (np.int64, np.int64, np.int64))
    row, item = np.append(row, by_word[0]), np.append(item, by_word[1])
    cell = items.cell[by_word[1]]
    start, cosine = np.append(start - items.at[piece], by_word[2] * cell), np.append(cosine, np.full(len(cell), np.nan))
    begin, end = w.doc_at[row], w.doc_at[row + 1]
    lo, hi = begin + start, begin + start
    around = items.length[item[:k]] // 2 + STEP
    lo[:k] -= around
    hi[:k] += around + np.maximum(items.length[item[:k]], STEP * np.array(WINDOWS)[items.size[piece]])
    hi[k:] += 4 * cell
    lo, hi, start = np.maximum(lo, begin), np.minimum(hi, end), np.maximum(start, 0)
    kept = np.flatnonzero(_enough(w.hashes, items, item, lo, hi, min(limits[1:]) - 1e-9))
    # the cosines of both kinds alike, so that the same window has the same one: of the window found, or of those that begin in the region the best
    window, piece = np.append(window, start[k:] // STEP), np.append(piece, items.first[item[k:]])
    windows = np.append(np.ones(k, np.int64), -(-(hi[k:] - w.doc_at[row[k:]]) // STEP) - window[k:])
    for at in range(0, len(kept), 8192):
        some = kept[at : at + 8192]
        x, n = block_at[row[some]] + window[some], windows[some]
        rows, best = np.maximum(n, 0) + WINDOWS[-1], np.full(len(some), -1.0)
        offset = np.cumsum(rows) - rows
        own = np.repeat(np.arange(len(some)), rows)
        j = np.arange(len(own)) - offset[own]
        for first, vectors, squares in _window_sums(table[np.minimum(x[own] + j, len(table) - 1)], weighted):
            for size in range(len(WINDOWS)):
                held = first + np.flatnonzero((j < n[own])[first : first + ROWS] & (items.size[piece[some[own[first : first + ROWS]]]] == size))
                vector = vectors[size].take(held - first, 0)
                np.maximum.at(best, own[held], np.einsum("ij,ij->i", vector, items.vectors[piece[some[own[held]]]]) / _norm(squares[size].take(held - first), _energy(vector)))
        cosine[some] = best
    kept = kept[(kept < k) | (cosine[kept] >= COSINE_BY_WORDS)]
    top: dict[tuple[int, int], tuple[float, float, bool, int]] = {}
    for row_, i, at, z, begins, found in zip(*(x[kept].tolist() for x in (row, item, lo, hi, start, cosine))):
        own, region = items.hashes[i], w.hashes[at:z]
        share = common_subsequence(own, region) / len(own)
        best = top.get((row_, i))
        if share < limits[2] or (best is not None and share < best[1]):
            continue
        answer = own[items.answers[i] :]
        answered = common_subsequence(answer, region) >= ANSWER_SHARE * len(answer)
        if share >= limits[1] or answered:
            if best is None or (share, found) > (best[1], best[0]):
                top[row_, i] = (found, share, answered, begins)
    return [(row, i, *found) for (row, i), found in top.items()]


def _proposals(near: list[np.ndarray], items: Items) -> list[np.ndarray]:
    """Of the pieces of a long item that propose about the same place for it (to a quarter of its length), the one with the highest cosine."""
    row, piece, start, cosine = near
    item = items.of[piece]
    many = items.length[item] > SHORT
    place = np.where(many, (start - items.at[piece]) // np.maximum(items.length[item] // 4, 1), start)
    order = np.lexsort((start, -cosine, place, np.where(many, -1, piece), item, row))
    key = np.stack([row, item, np.where(many, -1, piece), place])[:, order]
    best = order[np.append(True, (np.diff(key) != 0).any(0))[: len(order)]]
    return [x[best] for x in near]


def _all(parts, kinds: tuple) -> list[np.ndarray]:
    """Tuples of arrays as one array a column."""
    parts = list(parts)
    return [np.concatenate([p[k] for p in parts]).astype(kind) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds)]


def _by_words(w, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, items, cells): cells (each once) from which four hold as many looked-up words of the item as a match has at least."""
    doc = w.doc_of()
    # a range of words reaches so far into the next that no four cells are divided
    reach = 2 * SHORT + 4
    sieved = _sieved(w.hashes)
    for held, known, first, item, most in items.index:
        place = held.take(sieved, mode="clip")
        at = np.flatnonzero(place >= 0)
        place, word = place[at].astype(np.int64), w.hashes[at]
        # another word than the cell's first one may be a later one
        other = np.flatnonzero(known.take(place) != word)
        place[other] = np.minimum(known.searchsorted(word[other]), len(known) - 1)
        right = known.take(place) == word
        at, place = at[right], place[right]
        upto = np.cumsum(first[place + 1] - first[place])
        begin = 0
        while begin < len(at):
            stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + POSTINGS, "right")))
            more = int(np.searchsorted(at, at[stop - 1] + reach, "right")) if stop < len(at) else stop
            yield _in_cells(at[begin:more], place[begin:more], w, doc, items, first, item, most)
            begin = stop


def _in_cells(at: np.ndarray, place: np.ndarray, w, doc: np.ndarray, items: Items, first: np.ndarray, item: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
    """_by_words for some of the words, at and their places in the index."""
    out = []
    times = first[place + 1] - first[place]
    posting = np.arange(times.sum()) + np.repeat(first[place] - (np.cumsum(times) - times), times)
    at = np.repeat(at, times)
    kept = _dense_places(at - at[0], item.take(posting), items)
    at, posting = at[kept], posting[kept]
    if not len(at):
        return _all(out, (np.int64,) * 3)
    of = item[posting]
    cell = (at - w.doc_at[doc[at]]) // items.cell[of] + 3
    # so many cells a text that the next text's are never in reach
    cells, base = int(cell.max()) + 4, int(of.min())
    count = int(of.max()) - base + 1
    # an item's word has one posting
    key = np.sort((((doc[at] * count + of - base) * cells + cell) * len(item)) + posting)
    # a word counts in a cell at most as often as in the item
    begins = np.flatnonzero(np.append(True, np.diff(key) > 0))
    n = np.minimum(np.diff(np.append(begins, len(key))), most[key[begins] % len(item)])
    key = key[begins] // len(item)
    begins = np.flatnonzero(np.append(True, np.diff(key) > 0))
    key, n = key[begins], np.add.reduceat(n, begins)
    of = key // cells % count + base
    gap = np.diff(key, prepend=-9)
    for empty in range(4):
        # from so many cells before this one, all of them without looked-up words
        total = n.copy()
        for k in range(1, min(4 - empty, len(key))):
            total[:-k] += n[k:] * (key[k:] - key[:-k] < 4 - empty)
        start = key % cells - 3 - empty
        enough = (total >= items.least[of]) & (gap > empty) & (start >= 0)
        out.append((key[enough] // (cells * count), of[enough], start[enough]))
    return tuple(_all(out, (np.int64,) * 3))


def _dense_places(at: np.ndarray, of: np.ndarray, items: Items) -> np.ndarray:
    """Which postings (places of words and their items) may be among as many within four cells as a match has: such places lie in two bins of that length, one after the other."""
    base = int(of.min())
    length = 4 * items.cell[base : int(of.max()) + 1] + 1
    bins = at[-1] // length + 3  # the last ones stay empty
    bin_at = np.cumsum(bins) - bins
    own = of - base
    own = bin_at.take(own) + (at * (1.0 / length).take(own)).astype(np.int64)
    n = np.bincount(own, minlength=bins.sum())
    most = n + np.maximum(np.append(n[1:], 0), np.append(0, n[:-1]))
    return np.flatnonzero(most.take(own) >= items.least.take(of))


def _peaks(row: np.ndarray, item: np.ndarray, start: np.ndarray, cosine: np.ndarray, half: int | np.ndarray) -> tuple[np.ndarray, ...]:
    """(rows, items, starts, cosines): the best of the windows that begin within half a window's length; their regions overlap almost whole."""
    order = np.lexsort((start, -cosine, start // half, item, row))
    key = np.stack([row, item, start // half])[:, order]
    best = order[np.append(True, (np.diff(key) != 0).any(0))[: len(order)]]
    return row[best], item[best], start[best], cosine[best]


class Retriever:
    """What the matching pass needs, fitted to the documents and the benchmark."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str) -> None:
        spark = docs.sparkSession
        texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        named = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
        # read and cut into words once for both: the frequencies, and the passages, which need them
        keyed = texts.select("text", F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), "text").alias("other"))
        tokens = staged(keyed.mapInArrow(_tokens, f"{SUMS}, key long, other long, words binary"), "tokens")
        counts = total_of(tokens.where("part is not null").select("part", "salt", "sums"))
        df, n = (counts[:-1], counts[-1]) if counts is not None else (np.zeros(BUCKETS), 0.0)
        idf = np.log((n + 1) / (df + 1)) + 0.05
        once = tokens.where("part is null").select("key", "other", "words").repartition("key")
        own = staged(once.mapInArrow(_passages_once(idf), "passage binary, share double, weight double"), "passages")
        drop(tokens)
        count, weighed = own.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        weight = ITEM_WEIGHT**2 * max(1.0, weighed / BALANCE)
        # each task sends a whole matrix of sums, so there are few for a small table
        rows = own.coalesce(max(8, -(-count // A_TASK))).unionByName(passages(named.select("text"), idf).withColumn("weight", F.col("weight") * F.lit(weight)))
        # per bucket: its projection, and what it adds to a vector's squared norm (each occurrence on its own)
        projection = np.vstack([idf[:, None] * latent_basis(rows, idf), np.zeros(RANK)]).astype(np.float32)
        drop(own)
        self.weighted = spark.sparkContext.broadcast(Weighted(projection, np.append(idf * idf, 0.0)))
        n_items, n_bytes = named.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        self.benchmark, self.groups = named, max(1, -(-n_items // ITEMS_AT_ONCE), -(-n_bytes // BYTES_AT_ONCE))
        self.spark = spark

    def item_groups(self, share: float) -> Iterator:
        """The items, at most about ITEMS_AT_ONCE and BYTES_AT_ONCE in each broadcast; share: the least of an item's words that a match has."""
        for g in range(self.groups):
            rows = self.benchmark.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.groups)) == g).collect()
            if rows:
                yield self.spark.sparkContext.broadcast(_items(sorted(rows, key=lambda r: (r.item is None, r.item or 0, r.text)), self.weighted.value, share))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_cosine: float = LEAST_COSINE, lcs_share: float = LCS_SHARE, paraphrase_share: float = PARAPHRASE_SHARE) -> DataFrame:
    """(id, item_id, cosine, lcs, answered, word): the documents that hold an item, and each item they hold.

    lcs: the share of the item's words, in order, in the document near word (from 0). Null and empty texts hold
    nothing; items without words are held by nothing. Of places with equal shares that of the highest cosine is
    told, of these the first. Whole texts of any length are searched; docs' other columns play no part. Repeated rows of docs or of the benchmark repeat their rows
    here. Empty tables: empty result.
    """
    fitted = Retriever(docs, benchmark, text_col, item_col, item_text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answered", pa.bool_()), ("word", pa.int64())])
    limits, weighted = (least_cosine, lcs_share, paraphrase_share), fitted.weighted
    out = docs.sparkSession.createDataFrame([], "id long, item_id long, cosine double, lcs double, answered boolean, word long")
    for k, items in enumerate(fitted.item_groups(min(lcs_share, paraphrase_share))):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, limit=BYTES):
                found = _found(part.column("text"), items.value, weighted.value, limits)
                ids = part.column("id").to_pylist()
                yield pa.RecordBatch.from_pylist([{"id": ids[r], "item_id": items.value.ids[i], "cosine": min(c, 1.0), "lcs": s, "answered": bool(a), "word": at} for r, i, c, s, a, at in found], schema=schema)

        more = rows.mapInArrow(run, "id long, item_id long, cosine double, lcs double, answered boolean, word long")
        out = out.unionByName(more) if k else more
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs whose texts hold no benchmark item, all columns as they are, whatever their names.

    No join: each whole text is judged as it passes, as often as it occurs. Null and empty texts stay; items
    without words are held by nothing. Empty tables: nothing goes.
    """
    fitted = Retriever(docs, benchmark, text_col, item_col, item_text_col)
    limits, weighted, out = (LEAST_COSINE, LCS_SHARE, PARAPHRASE_SHARE), fitted.weighted, docs
    for items in fitted.item_groups(min(limits[1:])):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text_col, BYTES):
                held = {r for r, *_ in _found(part.column(text_col), items.value, weighted.value, limits)}
                yield part.filter(pc.invert(pa.array([i in held for i in range(part.num_rows)], pa.bool_()))) if held else part

        out = out.mapInArrow(run, out.schema)
    return out
