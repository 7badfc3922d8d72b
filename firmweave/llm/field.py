"""A linear-chain conditional random field over the tokens of texts, in flat arrays.

Tokens are runs of letters, digits, ``+/_.-`` and characters beyond ASCII, and single other
characters that are no white space.  Everything is computed over the bytes of many texts
at once: a task's Arrow buffer is read as it lies, in pieces of ``PIECE`` bytes with
``MARGIN`` bytes of context, so neither a batch of texts nor one very long text is ever
held as a list of tokens.  Every token of every text is decoded.

A token has ``FEATURES`` hashed features: its shape (kinds of characters, length, changes
of kind, vowels, hexadecimal or not), its first bytes, the words around it (key words and
separators by name, others by rough kind), whether white space stands before it, and the
measures of its text.  Tags are begin, inside and outside; inside follows begin or
inside without white space between.
"""

from __future__ import annotations

import numpy as np

BITS = 15
B, I, O = 0, 1, 2
PIECE, MARGIN = 1 << 20, 1 << 12
#: tokens of a block that is decoded at once, and how many its neighbours share with it
BLOCK, SHARED = 96, 16
STEPS, RATE, DECAY = 70, 0.5, 3e-6
BARRED = -1e6

# Words that stand beside secrets, by the kind of thing they name.
LEXICON = {
    "password": 1, "passwd": 1, "pwd": 1, "pass": 1, "passphrase": 1, "passcode": 1,
    "secret": 2, "client_secret": 2, "private_key": 2, "privatekey": 2, "private": 2, "signature": 2,
    "token": 3, "access_token": 3, "refresh_token": 3, "bearer": 3, "session": 3, "jwt": 3,
    "key": 4, "apikey": 4, "api_key": 4, "api-key": 4, "access_key": 4, "accesskey": 4,
    "auth": 5, "authorization": 5, "credential": 5, "credentials": 5, "login": 5, "pin": 5,
}

SPACE, RUN, OTHER = 0, 1, 2
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[128:] = RUN
_KIND = np.zeros(256, np.uint8)
for _letters, _kind in (
    (b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 4), (b"+/_.-", 8),
):
    _CLASS[list(_letters)] = RUN
    _KIND[list(_letters)] = _kind
_KIND[128:] = 16
_FLAGS = _KIND | np.where(np.isin(np.arange(256), list(b"0123456789abcdef")), 0, 32).astype(np.uint8)
_VOWEL = np.isin(np.arange(256), list(b"aeiouyAEIOUY")).astype(np.uint8)

# neighbours: text's edge, plain word, word with a digit, then separators and key words
EDGE, PLAIN, NUMBER, SEPARATORS, KEYS = 0, 1, 2, 8, 140
_LOW = np.uint64(0x2020202020202020)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
FEATURES = 14


def _name(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (first | _LOW) * _MIX[0] ^ (second | _LOW) * _MIX[1] ^ length.astype(np.uint64)


def _heads(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second eight bytes of each token, zero beyond its end."""
    words = np.lib.stride_tricks.as_strided(
        np.concatenate([data, np.zeros(16, np.uint8)])[:].view(), (len(data) + 9, 8), (1, 1)
    )
    out = []
    for skip in (0, 8):
        at = np.minimum(starts + skip, len(data) + 8)
        value = np.ascontiguousarray(words[at]).view("<u8").ravel()
        left = np.clip(lengths - skip, 0, 8).astype(np.uint64)
        mask = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))
        out.append(value & mask)
    return out[0], out[1]


def _lexicon() -> tuple[np.ndarray, np.ndarray]:
    words = [w.encode() for w in LEXICON]
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    names = _name(*_heads(data, starts, lengths), lengths)
    order = np.argsort(names)
    return names[order], np.array(list(LEXICON.values()))[order]


_NAMES, _GROUPS = _lexicon()


class Tokens:
    """The tokens of a piece: ``start``, ``end``, ``text`` (number of their text), ``gap`` (white
    space or an edge before) and their features ``x`` [n, FEATURES]."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray, measures: np.ndarray):
        """``data``: bytes; ``cuts``: where texts begin in it; ``measures``: a number for each text."""
        self.start = self.end = self.text = np.zeros(0, np.int64)
        self.gap, self.x = np.zeros(0, bool), np.zeros((0, FEATURES), np.int32)
        if not len(data):
            return
        kind = _CLASS[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[cuts[cuts < len(data)]] = True
        before = np.empty_like(kind)
        before[0], before[1:] = SPACE, kind[:-1]
        fresh = begins[:-1]
        edge = (kind == OTHER) | ((kind != before) | fresh)
        at = np.flatnonzero(edge)
        if not len(at):  # white space alone, joined to the edge before it
            return
        is_token = kind[at] != SPACE
        start, end = at[is_token], np.append(at[1:], len(data))[is_token]
        if not len(start):
            return
        text = np.searchsorted(cuts, start, side="right") - 1
        lengths = end - start
        flags = np.bitwise_or.reduceat(_FLAGS[data], at)[is_token].astype(np.int64)
        kinds = _KIND[data]
        moves = np.empty(len(data), np.uint8)
        moves[0], moves[1:] = 0, kinds[1:] != kinds[:-1]
        moves[at] = 0
        changes = np.add.reduceat(moves, at, dtype=np.int32)[is_token]
        vowels = np.add.reduceat(_VOWEL[data], at, dtype=np.int32)[is_token]
        first, second = _heads(data, start, lengths)
        self.start, self.end, self.text = start, end, text
        self.gap = (before[start] == SPACE) | fresh[start]
        word = self._words(data, start, lengths, flags, first, second)
        self.x = self._features(word, lengths, flags, changes, vowels, first, measures[text])

    def _words(self, data, start, lengths, flags, first, second) -> np.ndarray:
        word = np.where((flags & 4) > 0, NUMBER, PLAIN)
        single = _CLASS[data[start]] == OTHER
        word = np.where(single, SEPARATORS + data[start], word)
        names = _name(first, second, lengths)
        at = np.minimum(np.searchsorted(_NAMES, names), len(_NAMES) - 1)
        known = (_NAMES[at] == names) & (lengths <= 16)
        return np.where(known, KEYS + _GROUPS[at], word).astype(np.int64)

    def _features(self, word, lengths, flags, changes, vowels, first, measures) -> np.ndarray:
        def beside(by: int, what: np.ndarray) -> np.ndarray:
            out = np.full(len(what), EDGE, what.dtype)
            if by < 0:
                same = self.text[-by:] == self.text[:by]
                out[-by:][same] = what[:by][same]
            else:
                same = self.text[by:] == self.text[:-by]
                out[:-by][same] = what[by:][same]
            return out

        p1, p2, n1, n2 = (beside(by, word) for by in (-1, -2, 1, 2))
        size = np.where(lengths < 4, lengths, np.minimum(4 + (lengths - 4) // 4, 12))
        busy = np.minimum(np.where(changes > 3, 3 + changes // 4, changes), 7)
        vocal = np.minimum(4 * vowels // np.maximum(lengths, 1), 3)
        kinds = flags & 31
        hexed = (lengths >= 8) & ((flags & 32) == 0)
        upper = (first & np.uint64(0xFFFFFFFF)).astype(np.int64)
        single = word >= SEPARATORS
        shape = np.where(
            single, word, 1024 + ((((kinds * 13 + size) * 8 + busy) * 4 + vocal) * 2 + hexed)
        )
        rough = np.where(single, word, 1024 + (kinds * 4 + np.minimum(size // 3, 3)) * 4 + np.minimum(busy, 3))
        gap = self.gap.astype(np.int64)
        parts = [
            (shape, 0, 0), (word, gap, 0), (p1, gap, 0), (n1, 0, 0), (p2, p1, gap), (n1, n2, 0),
            (p1, rough, gap), (p2 * 256 + p1, rough, 0), (np.where(lengths >= 8, upper, 0), 0, 0),
            (measures, rough, 0), (kinds * 16 + size, n1, gap), (np.zeros_like(word), 0, 0),
            (beside(-1, rough), rough, gap), (beside(1, rough), rough, beside(1, gap) * 2 + gap),
        ]
        x = np.empty((len(word), FEATURES), np.int32)
        for k, (a, b, c) in enumerate(parts):
            mixed = (
                np.asarray(a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                + np.asarray(b).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                + np.asarray(c).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
                + np.uint64(0xE7037ED1A0B428DB * (k + 1) % 2**64)
            )
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0x94D049BB133111EB)
            x[:, k] = (mixed >> np.uint64(64 - BITS)).astype(np.int32)
        return x


def measure(size: int, signs: bool, known: bool) -> int:
    """The features of a text as a whole: its size class, signs of assignments, key words."""
    return (min(size.bit_length() // 3, 7) * 2 + signs) * 2 + known


class Field:
    """Weights of the features by tag, and of the moves between tags."""

    def __init__(self, weight: np.ndarray, moves: np.ndarray):
        self.weight, self.moves = weight, moves

    def emissions(self, tokens: Tokens) -> np.ndarray:
        out = np.zeros((len(tokens.x), 3), self.weight.dtype)
        for k in range(tokens.x.shape[1]):
            out += self.weight[tokens.x[:, k]]
        out[tokens.gap, I] += BARRED  # a secret holds no white space
        return out

    def decode(self, tokens: Tokens) -> np.ndarray:
        """The best tags (Viterbi), in blocks that share ``SHARED`` tokens with each neighbour."""
        emit = self.emissions(tokens)
        n = len(emit)
        count = max(1, -(-n // BLOCK))
        if count == 1:
            return best_path(emit[None], self.moves)[0]
        padded = np.full((SHARED + count * BLOCK + SHARED, 3), BARRED, emit.dtype)
        padded[:, O] = 0
        padded[SHARED:SHARED + n] = emit
        wide = BLOCK + 2 * SHARED
        lanes = np.lib.stride_tricks.sliding_window_view(padded, wide, axis=0)[::BLOCK].transpose(0, 2, 1)
        tags = best_path(lanes, self.moves)
        return tags[:, SHARED:SHARED + BLOCK].reshape(-1)[:n]


def best_path(emit: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of each lane, [lanes, length, 3] -> [lanes, length]."""
    lanes, length, _ = emit.shape
    score = emit[:, 0].astype(np.float32)
    score[:, I] += BARRED
    back = np.empty((length, lanes, 3), np.uint8)
    for k in range(1, length):
        new = np.empty_like(score)
        for tag in range(3):
            total = score + moves[:, tag].astype(np.float32)
            back[k, :, tag] = total.argmax(axis=1)
            new[:, tag] = total.max(axis=1)
        score = new + emit[:, k]
    tags = np.empty((lanes, length), np.uint8)
    tags[:, -1] = score.argmax(axis=1)
    every = np.arange(lanes)
    for k in range(length - 1, 0, -1):
        tags[:, k - 1] = back[k, every, tags[:, k]]
    return tags


# -- training -----------------------------------------------------------------


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def constraints() -> np.ndarray:
    barred = np.zeros((3, 3))
    barred[O, I] = BARRED
    return barred


def slope(
    weight: np.ndarray, moves: np.ndarray, x: np.ndarray, y: np.ndarray, gap: np.ndarray, sizes: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray]:
    """(negative log-likelihood, its gradients by ``weight`` and ``moves``): forward-backward.

    x [tokens, features], y and gap [tokens] of windows one after the other; ``sizes``: theirs.
    """
    n, length = len(sizes), int(sizes.max())
    mask = np.arange(length) < sizes[:, None]
    both = mask[:, 1:]
    flat = np.zeros((len(x), 3))
    for k in range(x.shape[1]):
        flat += weight[x[:, k]]
    flat[gap, I] += BARRED
    emit = np.zeros((n, length, 3))
    emit[mask] = flat
    step = moves + constraints()
    ahead = np.zeros((n, length, 3))
    ahead[:, 0] = emit[:, 0] + np.array([0.0, BARRED, 0.0])
    for k in range(1, length):
        new = _sum_exp(ahead[:, k - 1, :, None] + step, 1) + emit[:, k]
        ahead[:, k] = np.where(mask[:, k, None], new, ahead[:, k - 1])
    back = np.zeros((n, length, 3))
    for k in range(length - 2, -1, -1):
        new = _sum_exp(step + (emit[:, k + 1] + back[:, k + 1])[:, None, :], 2)
        back[:, k] = np.where(mask[:, k + 1, None], new, 0.0)
    total = _sum_exp(ahead[:, -1], 1)
    chance = np.exp(np.clip(ahead + back - total[:, None, None], -700, 0))[mask]
    pairs = np.exp(np.clip(
        ahead[:, :-1, :, None] + step + (emit[:, 1:] + back[:, 1:])[:, :, None, :]
        - total[:, None, None, None], -700, 0,
    )) * both[..., None, None]
    tags = np.zeros((n, length), np.int64)
    tags[mask] = y
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (tags[:, :-1][both], tags[:, 1:][both]), 1)
    path = flat[np.arange(len(y)), y].sum() + (gold_moves * step).sum()
    over = chance - np.eye(3)[y]
    gradient = np.zeros_like(weight)
    for tag in range(3):
        for k in range(x.shape[1]):
            gradient[:, tag] += np.bincount(x[:, k], weights=over[:, tag], minlength=len(weight))
    return float(total.sum() - path), gradient, pairs.sum(axis=(0, 1)) - gold_moves


def train_field(windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], groups: int = 8) -> Field | None:
    """Maximum likelihood over (features [n, f], tags [n], gaps [n]) by adaptive gradient steps."""
    if not windows:
        return None
    # windows of about one length go through the recursions together
    ordered = sorted(windows, key=lambda w: len(w[1]))
    size = -(-len(ordered) // groups)
    packed = [
        (*(np.concatenate([w[c] for w in part]) for c in range(3)), np.array([len(w[1]) for w in part]))
        for part in (ordered[k:k + size] for k in range(0, len(ordered), size))
    ]
    n = len(windows)
    weight, moves = np.zeros((1 << BITS, 3)), np.zeros((3, 3))
    speed, moves_speed = np.full(weight.shape, 1e-8), np.full((3, 3), 1e-8)
    for _ in range(STEPS):
        by_weight, by_moves = DECAY * weight, DECAY * moves
        for x, y, gap, sizes in packed:
            _, own, own_moves = slope(weight, moves, x, y, gap, sizes)
            by_weight = by_weight + own / n
            by_moves = by_moves + own_moves / n
        speed += by_weight**2
        moves_speed += by_moves**2
        weight -= RATE * by_weight / np.sqrt(speed)
        moves -= RATE * by_moves / np.sqrt(moves_speed)
    return Field(weight.astype(np.float32), (moves + constraints()).astype(np.float32))
