"""Secret scans by a linear-chain conditional random field (operator 7).

Tokens (runs of word characters, runs of punctuation) are tagged B, I or O from their shape, length, hex, digit and
vowel content, whether they touch their neighbours, words that name secrets and separators before them, the
nearest words on either side, and two features of the whole text. The field is trained in two steps: on the driver on
made-up lines with secrets of many kinds (SECRETS) and with what looks like them (LOOKALIKES); then on these together with
windows of all documents: around everything the fixed patterns find, around every other token that isn't O in every best path
of the field so far, and from anywhere in texts without either. Each task sums its windows' gradient, one array a step, however many there are. Decoding is exact Viterbi: a token whose best
secret tag trails O by more than any transitions can make up for is O in every best path, so only the short runs
between such tokens need the recursion. The fixed patterns' own matches are always reported.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.sampling import distinct_sample
from graphloom.llm.tables import drop, staged
from graphloom.llm.words import slices, words

WINDOWS, PER_TEXT, STEPS, RATE, DECAY, AROUND, LENGTH = 1_500, 4, 100, 0.15, 1e-3, 12, 32
#: Made-up lines with a secret that the field learns from; as many with a lookalike, and half as many plain ones.
EXAMPLES = 1_200
#: Steps on the documents' windows together with the made-up lines. Windows with secrets weigh at most WINDOWS together, as do those without.
JOINT_STEPS = 30
#: So many windows are summed together, and by one task.
TOGETHER, A_TASK = 4_000, 200_000
#: So many windows are one row of the table that each step reads again.
A_ROW = 16
#: What the patterns are, in the order in which they are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Parts of words that name secrets.
STEMS = ("passw", "pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "private", "signature")

_STEM_PAIRS = np.zeros(1 << 16, bool)
_STEM_PAIRS[[ord(x[0]) << 8 | ord(x[1]) for x in STEMS]] = True

B, I, O = range(3)
_CLASS = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 4 digit, 8 other
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[33:48] = 1, 2, 4, 8
_CLASS[[*range(58, 65), *range(91, 97), *range(123, 256)]] = 8
_PARTS = np.ones(256, np.uint8)
_PARTS[[32, *range(9, 14)]] = 0
_PARTS[[*range(33, 43), 44, 46, *range(58, 65), 91, 92, 93, 94, 96, *range(123, 127)]] = 2
_PARTS[61] = 3  # a token apart from the marks beside it: some secrets end with it
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*range(48, 58), *range(97, 103)]] = True
_IS_VOWEL, _IS_JOINT = np.zeros(256, bool), np.zeros(256, bool)
_IS_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]], _IS_JOINT[[ord(c) for c in "_-"]] = True, True
#: Bytes that are counted in each token (digits, hex digits, letters, vowels, joints), as one number: BITS of it for each count.
BITS = 10
_COUNTED = np.sum([x.astype(np.uint64) << np.uint64(BITS * k) for k, x in enumerate((_CLASS == 4, _IS_HEX, (_CLASS == 1) | (_CLASS == 2), _IS_VOWEL, _IS_JOINT))], 0, dtype=np.uint64)
_LENGTHS = np.array([1, 2, 3, 5, 8, 12, 16, 20, 24, 32])
NEIGHBOURS = 4096
#: Values of each feature: shape, length, hex and digits, switches between kinds, what stands before, what after, the text, touching neighbours, vowels and joints, the nearest word before, after.
SIZES = (16, 11, 10, 5, 12, 4, 6, 8, 10, NEIGHBOURS, NEIGHBOURS)
_AT = np.concatenate([[0], np.cumsum(SIZES)]).astype(np.int16)
#: Features that stand as one number in the windows' rows, so that a sum over a token's weights takes four places in place of eleven.
TOGETHER_AS = ((0, 1, 2, 7), (3, 4, 5, 6, 8), (9,), (10,))


def _named(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each token holds a word that names secrets, whatever its case."""
    low = body | np.uint8(32)
    out = np.zeros(len(starts), bool)
    pair = low[:-1].astype(np.uint16) << np.uint16(8) | low[1:]
    may = np.flatnonzero(_STEM_PAIRS[pair])
    pair = pair[may]
    for stem in STEMS:
        at = may[pair == (ord(stem[0]) << 8 | ord(stem[1]))]
        at = at[at <= len(low) - len(stem)]
        for k, c in enumerate(stem[2:], 2):
            at = at[low[at + k] == ord(c)]
        token = np.searchsorted(starts, at, "right") - 1
        out[token[at + len(stem) <= ends[token]]] = True
    return out


def token_features(texts: pa.Array):
    """The tokens, and for each the places of its features in the weight table."""
    w = words(texts, kinds=_PARTS)
    n = len(w.hashes)
    if not n:
        return w, np.zeros((0, len(SIZES)), np.int16)
    kind, length = _CLASS[w.body], (w.ends - w.starts).astype(np.int32)
    bits = np.bitwise_or.reduceat(kind, w.starts)

    def count(numbers: np.ndarray) -> np.ndarray:
        upto = np.zeros(len(numbers) + 1, numbers.dtype)
        np.cumsum(numbers, out=upto[1:])
        return upto[w.ends] - upto[w.starts]

    change = np.zeros(len(kind), bool)
    change[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    counted = _COUNTED[w.body]
    if length.max() < 1 << BITS:  # all counts by one running sum
        counted += change.astype(np.uint64) << np.uint64(5 * BITS)
        sums = count(counted)
        own_counts = [(sums >> np.uint64(BITS * k) & np.uint64((1 << BITS) - 1)).astype(np.int32) for k in range(6)]
    else:
        own_counts = [count((counted >> np.uint64(BITS * k) & np.uint64(1)).astype(np.int32)) for k in range(5)] + [count(change.astype(np.int32))]
    digits, hexes, letters, vowelled, joints, changes = own_counts
    switches = changes - change[w.starts]
    doc = w.doc_of().astype(np.int32)
    key = _named(w.body, w.starts, w.ends) & (length <= 24)
    first = w.body[w.starts]
    sign = (first == 58) | (first == 61)
    quote = (first == 34) | (first == 39)

    def back(mask: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(n, bool)
        out[k:] = mask[: max(n - k, 0)] & (doc[k:] == doc[: max(n - k, 0)])
        return out

    near_sign = back(sign, 1) | (back(quote, 1) & back(sign, 2))
    near_key = back(key, 1) | back(key, 2) | back(key, 3) | back(key, 4)
    before = near_sign * 1 + near_key * 2 + back(quote, 1) * 4
    before = np.where(key, 8 + np.minimum(before, 3), before)
    after = np.concatenate([(doc[1:] == doc[:-1]) * (1 + sign[1:] + 2 * quote[1:] * ~sign[1:]), [0]])
    n_texts = len(w.doc_at) - 1
    assigns = np.zeros(n, bool)
    for k in (1, 2):
        assigns[: max(n - k, 0)] |= key[: max(n - k, 0)] & sign[k:] & (doc[k:] == doc[: max(n - k, 0)])
    held = np.bincount(doc[assigns], minlength=n_texts)
    share = np.bincount(doc, weights=digits, minlength=n_texts) / np.maximum(np.diff(w.byte_at), 1)
    text = (np.minimum(held, 1) * 3 + np.digitize(share, [0.002, 0.03]))[doc]
    hexed = (hexes == length) * 5 + np.minimum(digits * 5 // np.maximum(length, 1), 4)
    touching = np.zeros(n + 1, bool)
    touching[1:-1] = (w.starts[1:] == w.ends[:-1]) & (doc[1:] == doc[:-1])
    mark = _PARTS[first] > 1
    glue = touching[:-1] * 1 + touching[1:] * 2 + mark * 4
    vowels = np.where(letters > 0, np.digitize(vowelled / np.maximum(letters, 1), [0.12, 0.22, 0.32]), 4)
    sound = vowels * 2 + (joints > 0)
    # the nearest word on either side; long ones and those with digits count as none in particular
    own = np.where((digits == 0) & (length <= 14), 2 + (w.hashes >> np.uint64(52)).astype(np.int64) % (NEIGHBOURS - 2), 1)
    place = np.arange(n)
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(mark, -1, place))[:-1]])
    follows = np.concatenate([np.minimum.accumulate(np.where(mark, n, place)[::-1])[::-1][1:], [n]])
    beside = lambda at: np.where((at >= w.doc_at[doc]) & (at < w.doc_at[doc + 1]), own[np.clip(at, 0, n - 1)], 0)
    columns = (bits, np.searchsorted(_LENGTHS, length, "right"), hexed, np.digitize(switches, [1, 2, 4, 7]), before, np.minimum(after, 3), text, glue, sound, beside(last), beside(follows))
    return w, np.stack([c.astype(np.int16) for c in columns], 1) + _AT[:-1]


def packed(f: np.ndarray) -> np.ndarray:
    """Features as one number for each of TOGETHER_AS, in the last axis."""
    own = f - _AT[:-1]
    out = np.zeros((*f.shape[:-1], len(TOGETHER_AS)), np.int16)
    for k, columns in enumerate(TOGETHER_AS):
        for j in columns:
            out[..., k] = out[..., k] * SIZES[j] + own[..., j]
    return out


def unpacked(codes: np.ndarray) -> np.ndarray:
    """The features that packed() made these numbers of."""
    out = np.zeros((*codes.shape[:-1], len(SIZES)), np.int16)
    for k, columns in enumerate(TOGETHER_AS):
        left = codes[..., k].copy()
        for j in reversed(columns):
            out[..., j] = left % SIZES[j] + _AT[j]
            left //= SIZES[j]
    return out


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself), in code points, by start and then kind."""
    out = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        out += [(kind, m.start(), m.end(), m.start()) for m in pattern.finditer(text) if m.end() - m.start() >= LEAST[kind]]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _may_match(part: pa.Array, body: np.ndarray, byte_at: np.ndarray) -> np.ndarray:
    """The texts that the patterns could match: all that hold a : or =, AKIA, or 24 hex digits in a row."""
    marks = np.flatnonzero((body == 58) | (body == 61))
    runs = np.cumsum(_IS_HEX[body], dtype=np.int32)
    long = np.flatnonzero(runs[24:] - runs[:-24] == 24) + 24 if len(runs) > 24 else marks[:0]
    if len(runs) >= 24 and runs[23] == 24:
        long = np.append(long, 23)
    a = np.flatnonzero(body[:-3] == 65) if len(body) > 3 else marks[:0]
    a = a[(body[a + 1] == 75) & (body[a + 2] == 73) & (body[a + 3] == 65)]
    return np.unique(np.searchsorted(byte_at, np.concatenate([marks, long, a]), "right") - 1)


class Field:
    """Weights of token features, transitions between tags and from the start; all soft."""

    def __init__(self) -> None:
        self.w, self.t = np.zeros((int(_AT[-1]), 3)), np.zeros((4, 3))

    def emissions(self, f: np.ndarray) -> np.ndarray:
        out = self.w[f[:, 0]]
        for j in range(1, f.shape[1]):
            out = out + self.w[f[:, j]]
        return out

    def gradient(self, f: np.ndarray, tags: np.ndarray, mask: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """f: sequences * LENGTH * features; of the weighted sum of negative log-likelihoods. mask: the places that a sequence has, its first ones."""
        return Sums(self).of(packed(f), np.where(mask, tags, -1), weight)

    def train(self, f: np.ndarray, tags: np.ndarray, mask: np.ndarray, windows: Callable[[Field], DataFrame] | None = None) -> None:
        """Adam on the mean negative log-likelihood: STEPS on these sequences; then JOINT_STEPS on them and the rows that windows makes for the field so far (packed_windows)."""
        state = [np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.t), np.zeros_like(self.t)]
        own, table = np.ones(len(tags)), None
        total, kinds = own.sum(), {}
        codes, tags = packed(f), np.where(mask, tags, -1)
        for step in range(1, STEPS + 1 + (JOINT_STEPS if windows else 0)):
            if step == STEPS + 1:
                table = windows(self)
                counts = table.agg(F.sum("others"), F.sum("hits")).first()
                number = {hit: n for hit, n in zip((False, True), counts) if n}
                kinds = {hit: min(1.0, WINDOWS / n) for hit, n in number.items()}
                total += sum(kinds[hit] * n for hit, n in number.items())
                # each task sends a whole gradient, so there are few for a small table
                rows = table.select("f", "tags").coalesce(max(8, -(-sum(number.values()) // A_TASK)))
            grads = Sums(self).of(codes, tags, own)
            for more in rows.mapInArrow(_gradients(self, kinds), "w binary, t binary").collect() if kinds else ():
                grads = [g + np.frombuffer(bytes(x)).reshape(g.shape) for g, x in zip(grads, more)]
            for x, g, m, v in ((self.w, grads[0], *state[:2]), (self.t, grads[1], *state[2:])):
                g = g / total + DECAY * x
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        if table is not None:
            drop(table)

    def doubted(self, codes: np.ndarray) -> np.ndarray:
        """The tokens, by their packed features, at which a secret tag trails O by no more than transitions can make up for; all others are O in every best path."""
        t, sums = self.t, Sums(self)
        made_up = max(0.0, max(t[a, s] - t[a, O] for a in range(4) for s in (B, I)) + max(max(t[s, b] - t[O, b] for b in range(3)) for s in (B, I)), max(t[a, s] - t[a, O] for a in range(4) for s in (B, I)))
        # a little more, as sums in another order differ by rounding
        return np.flatnonzero(np.maximum(*(sums.lead(s, codes.T) for s in (B, I))) >= -made_up - 1e-6)

    def tags(self, f: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
        """The best path of each text, exactly."""
        out = np.full(len(f), O, np.int8)
        t = self.t
        open_ = self.doubted(packed(f))
        if not len(open_):
            return out
        e = self.emissions(f[open_])
        starts = np.zeros(len(f) + 1, bool)
        starts[doc_at] = True
        split = np.ones(len(open_), bool)
        split[1:] = (np.diff(open_) > 1) | starts[open_[1:]]
        first = np.flatnonzero(split)
        length = np.diff(np.append(first, len(open_)))
        order = np.argsort(-length, kind="stable")
        here, length = first[order], length[order]
        first = open_[here]
        came = np.where(starts[first], 3, O)
        best, back = t[came] + e[here], []
        for k in range(1, int(length[0])):
            n = int(np.searchsorted(-length, -k, "left"))  # runs longer than k
            ways = best[:n, :, None] + t[None, :3]
            back.append(ways.argmax(1))
            best[:n] = ways.max(1) + e[here[:n] + k]
        follows = ~starts[first + length]
        best = best + np.where(follows[:, None], t[None, :3, O], 0)
        tag = best.argmax(1)
        for k in range(int(length[0]) - 1, -1, -1):
            n = int(np.searchsorted(-length, -k, "left"))
            out[first[:n] + k] = tag[:n]
            if k:
                tag[:n] = back[k - 1][np.arange(n), tag[:n]]
        return out


class Sums:
    """Gradients of a field's weighted negative log-likelihood, by scaled forward and backward sums.

    A tag's likelihood stands in proportion to that of O, so two of the three tags need tables; the gradient by O's weights
    is what the other two leave, as a token's probabilities add up to 1, and so do its tags.
    """

    def __init__(self, field: Field) -> None:
        self.tables = [[self._joined(field.w[:, s] - field.w[:, O], columns) for columns in TOGETHER_AS] for s in (B, I)]
        self.move, self.start = np.exp(field.t[:3]), np.exp(field.t[3])

    @staticmethod
    def _joined(w: np.ndarray, columns: tuple[int, ...]) -> np.ndarray:
        """The sum of the columns' weights for each number that stands for them."""
        out = np.zeros(1)
        for j in columns:
            out = (out[:, None] + w[_AT[j] : _AT[j + 1]]).reshape(-1)
        return out

    def lead(self, tag: int, columns: Iterable[np.ndarray]) -> np.ndarray:
        """By how much a tag's emission is above that of O."""
        tables = zip(self.tables[tag], columns)
        table, c = next(tables)
        out = table.take(c)
        for table, c in tables:
            out += table.take(c)
        return out

    def of(self, codes: np.ndarray, tags: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """codes: sequences * places * packed features; tags of -1 are beyond a sequence's end."""
        return self.apart(self.joint(codes, tags, weight))

    def joint(self, codes: np.ndarray, tags: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """The gradient by the transitions, and by each packed number for B and then I: arrays that add up over sequences."""
        length = (tags >= 0).sum(1)
        if (length[1:] > length[:-1]).any():
            order = np.argsort(-length, kind="stable")
            codes, tags, weight, length = codes[order], tags[order], weight[order], length[order]
        size = int(length.max(initial=0))
        # by place: a step of the sums is one row, of the sequences that reach so far
        reach = [int(np.searchsorted(-length, -k, "left")) for k in range(size + 1)]
        at = np.concatenate([[0], np.cumsum(reach[:size])]).astype(np.int64)
        cells = lambda x: np.concatenate([x[:n, k] for k, n in enumerate(reach[:size])]) if size else x[:0, 0]
        columns, gold = [cells(codes[:, :, j]).astype(np.intp) for j in range(codes.shape[2])], cells(tags)
        likely = np.ones((3, len(gold)))
        for s in (B, I):
            np.exp(self.lead(s, columns), out=likely[s])
        alpha, scale = np.empty_like(likely), np.empty(len(gold))
        for k, n in enumerate(reach[:size]):
            here = slice(at[k], at[k] + n)
            ahead = (self.move.T @ alpha[:, at[k - 1] : at[k - 1] + n] if k else self.start[:, None]) * likely[:, here]
            np.add(np.add(ahead[0], ahead[1], out=scale[here]), ahead[2], out=scale[here])
            np.divide(ahead, scale[here], out=alpha[:, here])
        likely /= scale
        off, grad_t = np.empty((2, len(gold))), np.zeros((4, 3))
        beta = np.ones((3, len(tags)))
        for k in range(size - 1, -1, -1):
            n, m = reach[k], reach[k + 1]
            here = alpha[:, at[k] : at[k] + n]
            if m:
                ahead = likely[:, at[k + 1] : at[k + 1] + m] * beta[:, :m]
                beta[:, :m] = self.move @ ahead
                grad_t[:3] += (here[:, :m] * weight[:m]) @ ahead.T
            np.multiply(here[:2], beta[:2, :n], out=off[:, at[k] : at[k] + n])
            if not k:
                grad_t[3] = (here * beta[:, :n]) @ weight[:n]
        grad_t[:3] *= self.move
        own = np.concatenate([weight[:n] for n in reach[:size]]) if size else weight[:0]
        pair = gold[: len(gold) - reach[0]] if size else gold
        if size:
            pair = np.concatenate([gold[at[k] : at[k] + reach[k + 1]] for k in range(size)]) * 3 + gold[reach[0] :]
            grad_t[:3] -= np.bincount(pair, weights=own[reach[0] :], minlength=9).reshape(3, 3)
            grad_t[3] -= np.bincount(gold[: reach[0]], weights=weight[: reach[0]], minlength=3)
        for s in (B, I):
            off[s] -= gold == s
            off[s] *= own
        return [grad_t] + [np.bincount(c, weights=off[s], minlength=len(table)) for s in (B, I) for table, c in zip(self.tables[s], columns)]

    @staticmethod
    def apart(joint: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The gradient by each feature's weights, and by the transitions."""
        grad_w = np.zeros((int(_AT[-1]), 3))
        for k, sums in enumerate(joint[1:]):
            columns = TOGETHER_AS[k % len(TOGETHER_AS)]
            sums = sums.reshape([SIZES[j] for j in columns])
            for axis, j in enumerate(columns):
                grad_w[_AT[j] : _AT[j + 1], k // len(TOGETHER_AS)] = sums.sum(tuple(x for x in range(sums.ndim) if x != axis))
        grad_w[:, O] = -grad_w[:, B] - grad_w[:, I]
        return grad_w, joint[0]


def _chars(rng: random.Random, alphabet: str, least: int, most: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(least, most)))


_HEX, _LOW, _UP, _NUM = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ANY = _LOW + _UP + _NUM
_WORDS = "hunter summer dragon winter monkey purple coffee tiger rocket silver garden orange shadow falcon marble pepper".split()


def _mixed(rng: random.Random, least: int, most: int, alphabet: str = _ANY) -> str:
    """At least a digit and a letter of either case, however short."""
    body = list(_chars(rng, alphabet, least, most))
    for at, kind in zip(rng.sample(range(len(body)), 3), (_NUM, _LOW, _UP)):
        body[at] = rng.choice(kind)
    return "".join(body)


def _spelled(rng: random.Random) -> str:
    word = rng.choice(_WORDS)
    return "".join(rng.choice([word, word.title(), word.replace("e", "3").replace("o", "0")]) + _chars(rng, _NUM, 1, 4) for _ in range(rng.randint(1, 2)))


#: Kinds of secrets: what they look like, and what may stand before them.
SECRETS: dict[str, tuple[Callable[[random.Random], str], tuple[str, ...]]] = {
    "access": (lambda r: "AKIA" + _chars(r, _UP + "234567", 16, 16), ("", "", "key ", "aws_access_key_id = ", "id: ")),
    "hex": (lambda r: _chars(r, _HEX, 24, 64), ("password=", "token = \"", "secret: ", "api_key='", "auth: ", "digest key ", "")),
    "mixed": (lambda r: _mixed(r, 16, 44), ("token = ", "api_key='", "auth: bearer ", "Authorization: Bearer ", "key=", "secret: \"", "client_secret=", "private key ", "bearer ")),
    "base64": (lambda r: _mixed(r, 30, 60, _ANY + "+/") + "=" * r.randint(0, 2), ("AccountKey=", "secret_key: ", "signature=", "private key ", "aws_secret_access_key = ")),
    "spelled": (_spelled, ("db_pass: ", "pwd=", "pwd: ", "passwd = ", "password: ", "MYSQL_PWD=", "login pass: ", "admin_password = \"", "user_pass='")),
    "forge": (lambda r: r.choice(["ghp_", "gho_", "ghs_"]) + _mixed(r, 30, 40), ("", "", "token ", "git clone with ", "export GH=", "use ")),
    "payments": (lambda r: r.choice(["sk_live_", "sk_test_", "rk_live_"]) + _mixed(r, 20, 34), ("", "", "stripe ", "key: ", "charge with ")),
    "chat": (lambda r: r.choice(["xoxb-", "xoxp-", "xapp-"]) + _chars(r, _NUM, 10, 12) + "-" + _chars(r, _NUM, 10, 12) + "-" + _mixed(r, 24, 24), ("", "", "slack ", "bot token ", "SLACK=")),
    "web": (lambda r: "eyJ" + _mixed(r, 14, 34) + ".eyJ" + _mixed(r, 24, 60) + "." + _mixed(r, 30, 44, _ANY + "_-"), ("", "", "jwt ", "Authorization: Bearer ", "session=", "cookie: ")),
    "maps": (lambda r: "AIza" + _mixed(r, 35, 35, _ANY + "_-"), ("", "", "key=", "maps key ", "?key=")),
    "lab": (lambda r: "glpat-" + _mixed(r, 20, 20, _ANY + "_-"), ("", "", "ci token ", "PRIVATE-TOKEN: ")),
    "packages": (lambda r: r.choice(["npm_", "pypi-", "dop_v1_"]) + _mixed(r, 36, 50), ("", "", "publish with ", "_authToken=")),
    "mail": (lambda r: "SG." + _mixed(r, 22, 22) + "." + _mixed(r, 43, 43), ("", "", "sendgrid ", "api key ")),
}
#: What looks like a secret and is none.
LOOKALIKES: tuple[Callable[[random.Random], str], ...] = (
    lambda r: f"{r.choice(['order', 'invoice', 'parcel', 'tracking', 'part', 'ticket', 'flight', 'booking', 'serial', 'model', 'ISBN', 'case', 'lot', 'batch', 'SKU'])} {r.choice(['', 'no ', 'number ', '#', 'id '])}{_mixed(r, 6, 18, _UP + _NUM).upper()}",
    lambda r: f"{r.choice(['id', 'uuid', 'request', 'trace', 'run'])} {_chars(r, _HEX, 8, 8)}-{_chars(r, _HEX, 4, 4)}-{_chars(r, _HEX, 4, 4)}-{_chars(r, _HEX, 4, 4)}-{_chars(r, _HEX, 12, 12)}",
    lambda r: f"{r.choice(['https://', 'http://', 'www.'])}{_chars(r, _LOW, 4, 12)}.{r.choice(['com', 'org', 'net', 'example.org'])}/{_chars(r, _LOW + '-', 4, 14)}/{_chars(r, _LOW + _NUM + '-', 4, 20)}",
    lambda r: f"{_chars(r, _LOW, 3, 9)}.{_chars(r, _NUM, 1, 3)}@{_chars(r, _LOW, 3, 8)}{_chars(r, _NUM, 0, 1)}.{r.choice(['example.com', 'org', 'mail.net'])}",
    lambda r: f"v{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 99)}{r.choice(['', '-rc1', '-beta2', '.post3'])}",
    lambda r: f"20{r.randint(10, 30)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}Z",
    lambda r: f"/{_chars(r, _LOW, 3, 8)}/{_chars(r, _LOW + '_', 3, 12)}/{_chars(r, _LOW + _NUM, 3, 10)}.{r.choice(['py', 'txt', 'html', 'jpg'])}",
    lambda r: f"{r.choice(['get', 'set', 'make', 'parse'])}{_chars(r, _LOW, 3, 8).title()}{_chars(r, _LOW, 3, 8).title()}({_chars(r, _LOW, 1, 6)})",
    lambda r: "_".join(_chars(r, _LOW, 2, 9) for _ in range(r.randint(2, 4))) + f" = {r.randint(0, 5000)}",
    lambda r: f"{r.choice(['+44 ', '+1-', '0'])}{_chars(r, _NUM, 3, 4)}{r.choice(['-', ' '])}{_chars(r, _NUM, 3, 4)}{r.choice(['-', ' '])}{_chars(r, _NUM, 3, 4)}",
    lambda r: "-".join(_chars(r, _NUM, 4, 4) for _ in range(4)),
    lambda r: f"{r.choice(['password', 'token', 'key', 'secret', 'pass', 'auth', 'bearer'])} {r.choice(['was', 'of', 'is the', 'for', 'and', 'reset', 'required', 'field', 'holder'])}",
    lambda r: f"{r.choice(['monkey', 'keyboard', 'author', 'passage', 'privately', 'turkey', 'tokenizer', 'passenger'])}{r.choice([': ', ' = ', ' '])}{_chars(r, _LOW, 3, 9)}",
    lambda r: f"#{_chars(r, _HEX, 6, 6)}",
    lambda r: f"{r.choice(['commit', 'revision', 'build'])} {_chars(r, _HEX, 7, 10)}",
    lambda r: ":".join(_chars(r, _HEX, 2, 2) for _ in range(6)),
    lambda r: f"{r.choice(['width', 'colour', 'name', 'status', 'level', 'title', 'sort', 'page'])}{r.choice(['=', ': ', ' = '])}{r.choice([_chars(r, _LOW, 3, 12), _chars(r, _NUM, 1, 6)])}",
    lambda r: _chars(r, _LOW, 14, 34),
    lambda r: _chars(r, _NUM, 6, 16),
    lambda r: r.choice(["***", "####", "$$$ ", "%%% ", "&&&"]) + _chars(r, _NUM, 4, 12) + r.choice(["", "***", "###"]),
)
_PLAIN = "the value of this setting was changed on monday see page 12 and version 3.2 for details call 555 0142 in 2024 room b12 total 1,250 items id 48213 ok".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(_PLAIN) if rng.random() < 0.4 else _chars(rng, "aeiounrstlthdéñß", 2, 13) for _ in range(n))


def examples(count: int = EXAMPLES, seed: int = 7, without: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> list[tuple[str, list[tuple[int, int]]]]:
    """Made-up lines, and where the secrets in them are (code points); kinds of SECRETS may be left out."""
    rng, out = random.Random(seed), []
    kinds = [k for k in (only or SECRETS) if k not in without]
    for k in range(count):
        make, leads = SECRETS[kinds[k % len(kinds)]]
        secret, lead = make(rng), rng.choice(leads)
        line = " ".join(x for x in (prose(rng, rng.randrange(0, 9)), lead) if x)
        line += "" if lead else " " * bool(line)
        close = lead[-1] if lead and lead[-1] in "\"'" else rng.choice(["", "", "", ",", ";", ". ", "\n"])
        out.append((f"{line}{secret}{close} {prose(rng, rng.randrange(0, 9))}", [(len(line), len(line) + len(secret))]))
        out.append((f"{prose(rng, rng.randrange(0, 9))} {rng.choice(LOOKALIKES)(rng)}{rng.choice(['', '', ',', '.'])} {prose(rng, rng.randrange(0, 9))}", []))
        if k % 2:
            out.append((prose(rng, rng.randrange(4, 20)), []))
    return out


def _sequences(texts: list[str], found: list[list[tuple[int, int]]], per_text: int = PER_TEXT):
    """Windows of LENGTH tokens around secrets (or from anywhere), of a text those with the least hashes: features, tags, hashes of text and place."""
    w, f = token_features(pa.array(texts, pa.string()))
    rows, tags, ranks = [], [], []
    for i, (text, spans) in enumerate(zip(texts, found)):
        lo, hi = int(w.doc_at[i]), int(w.doc_at[i + 1])
        tag = np.full(hi - lo, O, np.int64)
        s, e = w.starts[lo:hi] - w.byte_at[i], w.ends[lo:hi] - w.byte_at[i]
        for a, z in spans:
            a, z = len(text[:a].encode()), len(text[:z].encode())
            inside = np.flatnonzero((s < z) & (e > a))
            tag[inside] = I
            tag[inside[:1]] = B
        hits = np.flatnonzero(tag == B)
        at = [max(0, int(k) - AROUND) for k in hits] if len(hits) else [zlib.crc32(text[:50].encode()) % max(1, hi - lo - LENGTH)]
        own = zlib.crc32(text.encode())
        for rank, k in sorted((zlib.crc32(str(k).encode(), own), k) for k in at)[:per_text]:
            if hi - lo > k:
                ranks.append(rank)
                rows.append(f[lo + k : min(hi, lo + k + LENGTH)])
                tags.append(tag[k : k + LENGTH])
    return rows, tags, ranks


def _samples(per_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            rows, tags, ranks = _sequences(texts, [[(s[3], s[2]) for s in base_spans(t)] for t in texts], per_text)
            yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([t.astype(np.int8).tobytes() for t in tags], pa.binary()), pa.array([bool((t == B).any()) for t in tags], pa.bool_())], names=["rank", "f", "tags", "hit"])

    return run


def training_windows(docs: DataFrame, sample_docs: int, windows: int = WINDOWS, per_text: int = PER_TEXT) -> list[tuple[bytes, bytes]]:
    """A bounded sample, which no query trains on (see windows_of). docs: one column, text. The sample: texts whose hashes fall under sample_docs in all (about), each once however many copies it has.

    At most windows with secrets and as many without, those with the least hashes of text and place; per_text of a text.
    """
    sampled = distinct_sample(docs, sample_docs, docs.count(), 7).mapInArrow(_samples(per_text), "rank long, f binary, tags binary, hit boolean")
    least = lambda rows: rows.orderBy("rank", "f", "tags").limit(windows)
    return [(bytes(r.f), bytes(r.tags)) for r in least(sampled.where("hit")).unionByName(least(sampled.where("not hit"))).collect()]


def _windows_in(field: Field):
    """Windows of LENGTH tokens: around each secret that the patterns find, around every token in doubt that no window holds yet, and from anywhere in a text without either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w, f = token_features(part.column("text"))
            tag, doubt = np.full(len(f) + 1, O, np.int8), field.doubted(codes := packed(f))
            for i in map(int, _may_match(part.column("text"), w.body, w.byte_at)):
                text, lo, hi = part.column("text")[i].as_py(), int(w.doc_at[i]), int(w.doc_at[i + 1])
                for s in base_spans(text):
                    a, z = (int(w.byte_at[i]) + len(text[:k].encode()) for k in (s[3], s[2]))
                    first, last = lo + int(np.searchsorted(w.ends[lo:hi], a, "right")), lo + int(np.searchsorted(w.starts[lo:hi], z, "left"))
                    tag[first:last] = I
                    tag[first : min(first + 1, last)] = B
            begin, hits = [], np.flatnonzero(tag == B)
            hit_at, doubt_at = np.searchsorted(hits, w.doc_at), np.searchsorted(doubt, w.doc_at)
            for i, (lo, hi) in enumerate(zip(w.doc_at[:-1].tolist(), w.doc_at[1:].tolist())):
                own = [max(lo, k - AROUND) for k in hits[hit_at[i] : hit_at[i + 1]].tolist()]
                held = np.zeros(hi - lo, bool)
                for k in own:
                    held[k - lo : k - lo + LENGTH] = True
                for k in doubt[doubt_at[i] : doubt_at[i + 1]].tolist():
                    if not held[k - lo]:
                        at = max(lo, k - AROUND)
                        while at > lo and tag[at] == I:  # not from within a secret
                            at -= 1
                        own.append(at)
                        held[at - lo : max(at + LENGTH, k + 1) - lo] = True
                if not own and hi > lo:
                    own = [lo + int(w.hashes[lo] % np.uint64(max(1, hi - lo - LENGTH)))]
                begin += [(k, hi) for k in own]
            at, until = np.array(begin, np.int64).reshape(-1, 2).T
            place = at[:, None] + np.arange(LENGTH)
            there = place < until[:, None]
            place = np.where(there, place, 0)
            tags = np.where(there, tag[place], -1).astype(np.int8)
            text = np.searchsorted(w.doc_at, at, "right") - 1
            key = part.column("own").take(pa.array(text))
            yield pa.RecordBatch.from_arrays([key, pa.array(at - w.doc_at[text]), _rows_of(np.where(there[:, :, None], codes[place], 0).astype(np.int16) if len(f) else codes), _rows_of(tags), pa.array((tags == B).any(1))], names=["own", "place", "f", "tags", "hit"])

    return run


def _rows_of(array: np.ndarray) -> pa.Array:
    size = array[0].nbytes if len(array) else 0
    return pa.Array.from_buffers(pa.binary(), len(array), [None, pa.py_buffer(np.arange(0, size * len(array) + 1, size, dtype=np.int32) if size else np.zeros(1, np.int32)), pa.py_buffer(np.ascontiguousarray(array))])


def _array_of(rows: pa.Array, kind: type) -> np.ndarray:
    """What rows of bytes hold, one after the other."""
    held = rows.cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    return np.frombuffer(held.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)


def _arrays_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """f (windows * LENGTH * numbers a token) and tags of a batch, however many windows are in a row."""
    tags = _array_of(batch.column("tags"), np.int8).reshape(-1, LENGTH)
    return _array_of(batch.column("f"), np.int16).reshape(len(tags), LENGTH, -1), tags


_WINDOW = "own long, place long, f binary, tags binary, hit boolean"


def _rowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A_ROW windows as one row, those of a task's batch that are left over too."""
    for batch in batches:
        own, place = (np.ascontiguousarray(batch.column(c).to_numpy(zero_copy_only=False)).astype(np.int64) for c in ("own", "place"))
        f, tags = _arrays_of(batch)
        cuts = range(0, len(tags), A_ROW)
        hit = (tags == B).any(1)
        hits = np.array([hit[k : k + A_ROW].sum() for k in cuts], np.int64)
        size = np.array([len(hit[k : k + A_ROW]) for k in cuts], np.int64)
        yield pa.RecordBatch.from_arrays([*(pa.array([x[k : k + A_ROW].tobytes() for k in cuts], pa.binary()) for x in (own, place, f, tags)), pa.array(hits), pa.array(size - hits)], names=["own", "place", "f", "tags", "hits", "others"])


def packed_windows(docs: DataFrame, field: Field) -> DataFrame:
    """(own, place, f, tags, hits, others): windows_of, up to A_ROW of them in a row, with f as packed features; and how many hold a secret or none."""
    rows = docs.withColumn("own", F.xxhash64("text")).mapInArrow(_windows_in(field), _WINDOW)
    # in order, so that sums and with them the field are the same each time
    rows = rows.distinct().sortWithinPartitions("own", "place")
    return staged(rows.mapInArrow(_rowed, "own binary, place binary, f binary, tags binary, hits long, others long"), "windows")


def _written_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            codes, tags = _arrays_of(batch)
            f = np.where(tags[:, :, None] >= 0, unpacked(codes), 0).astype(np.int16)
            own, place = (pa.array(_array_of(batch.column(c), np.int64)) for c in ("own", "place"))
            yield pa.RecordBatch.from_arrays([own, place, _rows_of(f), _rows_of(tags), pa.array((tags == B).any(1))], names=["own", "place", "f", "tags", "hit"])


def windows_of(docs: DataFrame, field: Field) -> DataFrame:
    """(own, place, f, tags, hit) of all texts in docs, one column text: each text (own, its hash) once, however many copies it has. Tags of -1: places beyond the text's end."""
    return packed_windows(docs, field).mapInArrow(_written_out, _WINDOW)


def _gradients(field: Field, weights: dict[bool, float]):
    """A task's sum of gradients, by whether a window holds a secret weighted so. f as features or packed, one window or more in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = None, Sums(field)
        for batch in batches:
            all_codes, all_tags = _arrays_of(batch) if batch.num_rows else (None, ())
            for at in range(0, len(all_tags), TOGETHER):
                codes, tags = all_codes[at : at + TOGETHER], all_tags[at : at + TOGETHER]
                if codes.shape[2] == len(SIZES):
                    codes = packed(np.where(tags[:, :, None] < 0, _AT[:-1], codes))
                weight = np.where((tags == B).any(1), weights.get(True, 0.0), weights.get(False, 0.0))
                more = sums.joint(codes, tags, weight)
                total = [a + b for a, b in zip(total, more)] if total else more
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in sums.apart(total)], names=["w", "t"])

    return run


def fit(docs: DataFrame | None, made_up: int = EXAMPLES, without: tuple[str, ...] = ()) -> Field:
    """The field, trained on made-up examples and on the windows of all texts of docs (none: examples alone)."""
    rows, tags, _ = _sequences(*map(list, zip(*examples(made_up, without=without))))
    f, t, mask = np.zeros((len(rows), LENGTH, len(SIZES)), np.int16), np.zeros((len(rows), LENGTH), np.int64), np.zeros((len(rows), LENGTH), bool)
    for i, (r, g) in enumerate(zip(rows, tags)):
        f[i, : len(r)], t[i, : len(g)], mask[i, : len(g)] = r, g, True
    field = Field()
    field.train(f, t, mask, None if docs is None else lambda field: packed_windows(docs, field))
    return field


def tagged(field: Field, texts: pa.Array):
    """The tokens, and (text, start, end) of each tagged secret, in bytes of its text. A blank ends a secret."""
    w, f = token_features(texts)
    tags = field.tags(f, w.doc_at)
    at = np.flatnonzero(tags != O)
    if not len(at):
        return w, []
    doc = np.searchsorted(w.doc_at, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (tags[at[1:]] == B) | (w.starts[at[1:]] != w.ends[at[:-1]]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    wordy = np.logical_or.reduceat(_PARTS[w.body[w.starts[at]]] == 1, first)
    spans = zip(doc[first].tolist(), (w.starts[at[first]] - w.byte_at[doc[first]]).tolist(), (w.ends[at[last]] - w.byte_at[doc[first]]).tolist())
    return w, [s for s, ok in zip(spans, wordy) if ok]


def spans_of(field: Field, texts: pa.Array) -> dict[int, tuple[str, list[tuple[str, int, int]]]]:
    """By text that has some: the text, and (kind, start, end) of its secrets by start and then kind, in code points."""
    w, found = tagged(field, texts)
    own: dict[int, list[tuple[int, int]]] = {}
    for i, a, z in found:
        own.setdefault(i, []).append((a, z))
    out = {}
    for i in sorted({*map(int, _may_match(texts, w.body, w.byte_at)), *own}):
        raw = w.body[w.byte_at[i] : w.byte_at[i + 1]]
        text = raw.tobytes().decode("utf-8", "replace")
        spans = [s[:3] for s in base_spans(text)]
        if i in own:
            places = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)])
            more = [("crf", int(places[a]), int(places[z])) for a, z in own[i]]
            spans += [t for t in more if not any(s[1] <= t[1] and t[2] <= s[2] for s in spans)]
        if spans:
            out[i] = (text, sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): one row per row of docs; its other columns, whatever their names, play no part.

    spans: array<struct<kind, start, end, value>> by start and then kind (assign, access, hex, crf); start and
    end in code points, end exclusive. crf spans that lie within a pattern's match are not repeated. Null and
    empty texts have no spans; texts of any length are read whole. Of paths that score alike, the one that tags B
    before I before O is taken. Repeated rows give repeated results, a null id is kept; empty table: empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    field = docs.sparkSession.sparkContext.broadcast(fit(rows.select("text")))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = spans_of(field.value, part.column("text"))
            spans = [[{"kind": k, "start": a, "end": z, "value": found[i][0][a:z]} for k, a, z in found[i][1]] if i in found else [] for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(spans, kind)], names=["id", "spans"])

    return rows.mapInArrow(run, "id long, spans array<struct<kind: string, start: long, end: long, value: string>>")


def without_spans(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with each span replaced by the mark, overlapping ones by one."""
    out, done = [], 0
    for _, a, z in spans:
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, z)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each secret replaced by a mark, overlapping spans by one; one row per row of docs.

    All other columns pass as they are, whatever their names. Null texts stay null and empty ones empty, texts of any
    length are read whole, and repeated rows stay as often as they occur. Empty table: empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    field = docs.sparkSession.sparkContext.broadcast(fit(docs.select(text.alias("text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            column = part.column(text_col)
            found = spans_of(field.value, column)
            if found:
                hit = np.zeros(part.num_rows, bool)
                hit[list(found)] = True
                clean = pa.array([without_spans(*found[i], mark) for i in sorted(found)], column.type)
                part = part.set_column(part.schema.get_field_index(text_col), text_col, pc.replace_with_mask(column, pa.array(hit), clean))
            yield part

    return docs.mapInArrow(run, docs.schema)
