"""Secret scans: base patterns, and a linear-chain conditional random field.

Base spans, leftmost and non-overlapping per kind, matches that are too short
dropped: ``assign`` (a key word, a separator, a value of 6 or more characters),
``access`` (AKIA..., 20 or more) and ``hex`` (24 or more).  Places are code
points of the whole text, ends exclusive; an assignment's span is its whole match.

The field (``llm.field``) tags every token of every text as begin, inside or outside of a
secret and is decoded by Viterbi.  Its spans, of kind ``model``, are what the base spans
leave over: a value that goes on behind a base span's end adds the rest.  They hold no
white space and ``LEAST`` characters or more, and go on to the end of the value that they
reach into (``DELIMITER``); full stops, colons and dashes at their end are cut.

Training.  Windows of text are drawn by a hash of the text, by a threshold that counts over
all documents set: up to ``POSITIVE`` windows around base spans and ``NEGATIVE`` windows of
any documents.  The patterns' values are tagged as secrets.  So that the field learns more
than the patterns, each window also stands with other key words (``RENAMED``), with other
values (random letters and digits, words run together, symbols inside or behind, prefixes
of public token formats), and with no key word where the value tells by itself; windows
without secrets also stand with a key word before an ordinary word, which stays outside.
These variants are drawn by a generator seeded with the window.

Defined cases: missing or empty text -> no spans; documents without any base
span in the corpus -> no training windows, base spans only; repeated rows give
repeated results; empty table -> no rows.  A text of any length is read in pieces of
``field.PIECE`` bytes; a token longer than that is cut there.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firmweave.llm import field as crf
from firmweave.llm.field import Field, Tokens, measure, train_field
from firmweave.llm.tables import map_batches

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is never split, so shorter runs simply do not count
KEYWORDS = ("passw", "secret", "token", "api")
#: what Spark looks for to find texts with base spans
LIKELY = r"(?i:passw|secret|token|api_?key)[^\n]{0,8}[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"

#: windows drawn from texts with base spans and from any texts, and from one text
POSITIVE, NEGATIVE, PER_TEXT = 800, 1600, 3
#: characters of a window on each side, and the least of a span that the field adds
SIDE, LEAST = 110, 6
#: tokens of a training window
LONGEST = 60
#: what ends a value, looked for in so many bytes behind the field's last token
DELIMITER, GROWTH = re.compile(rb"""[\s"'`,;()\[\]{}<>]"""), 512

# Key words that the patterns lack, and prefixes of public token formats.
RENAMED = (
    "pwd", "pass", "passphrase", "passcode", "auth", "authorization", "Authorization: Bearer", "bearer",
    "credential", "credentials", "private_key", "privatekey", "client_secret", "access_key", "accesskey",
    "login", "session", "signature", "jwt", "PWD", "DB_PASS", "AUTH", "Bearer", "key", "pin",
)
PREFIXES = ("ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "sk-", "AIza", "eyJ", "npm_", "pypi-")


# -- base spans ---------------------------------------------------------------


def _has_keyword(text: str) -> bool:
    low = text.lower()
    return any(k in low for k in KEYWORDS)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value), sorted."""
    found = []
    if ("=" in text or ":" in text) and _has_keyword(text):
        found += [
            (m.start(), 0, m.end(), m.start(2))
            for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6
        ]
    if "AKIA" in text:
        found += [
            (m.start(), 1, m.end(), m.start())
            for m in ACCESS.finditer(text) if m.end() - m.start() >= 20
        ]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


# -- training windows -----------------------------------------------------------

Window = tuple[str, list[tuple[int, int]]]  # text, spans of its secrets


def _letters(rng: random.Random, least: int, most: int) -> str:
    letters = rng.choice([string.ascii_letters, string.ascii_letters + string.digits])
    return "".join(rng.choices(letters, k=rng.randint(least, most)))


def _value(rng: random.Random) -> str:
    """A secret value of one of many shapes."""
    def of(letters: str, least: int, most: int) -> str:
        return "".join(rng.choices(letters, k=rng.randint(least, most)))

    def word() -> str:
        return "".join(
            rng.choice("bcdfghjklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))
        )

    alnum = string.ascii_letters + string.digits
    kind = rng.randrange(9)
    if kind == 0:
        return "".join(word().capitalize() for _ in range(rng.randint(2, 4)))
    if kind == 1:
        return of(string.ascii_letters, 10, 40)
    if kind == 2:
        return of(alnum, 10, 44)
    if kind == 3:
        return of(alnum + "+/", 20, 60) + rng.choice(["", "=", "=="])
    if kind == 4:
        return of("0123456789abcdef", 10, 23)
    if kind == 5:
        return of(alnum, 5, 16) + rng.choice("!@#$%^&*") + of(alnum, 1, 8) + rng.choice(["", "!", "?", "#"])
    if kind == 6:
        return word().capitalize() + rng.choice(["", "-", "_", "."]) + of(string.digits, 2, 6) + rng.choice(["", "!", "$"])
    if kind == 7:
        return rng.choice(PREFIXES) + of(alnum, 16, 40)
    return of(string.ascii_uppercase + string.digits, 12, 32)


def _ordinary(rng: random.Random) -> str:
    """Something that looks odd and is no secret."""
    def of(letters: str, least: int, most: int) -> str:
        return "".join(rng.choices(letters, k=rng.randint(least, most)))

    low, digits = string.ascii_lowercase, string.digits
    name = of(low, 3, 9)
    return rng.choice([
        f"http{rng.choice(['', 's'])}://www.{name}.com/{of(low, 2, 8)}/{of(low, 2, 8)}?id={of(digits, 1, 6)}",
        f"https://{name}.org/{of(low, 3, 9)}.html", f"{name}.{of(low, 3, 8)}@{of(low, 4, 9)}.{rng.choice(['com', 'org', 'net'])}",
        f"+{of(digits, 2, 2)} {of(digits, 3, 3)} {of(digits, 6, 8)}", f"({of(digits, 3, 3)}) {of(digits, 3, 3)}-{of(digits, 4, 4)}",
        f"20{of(digits, 2, 2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T1{rng.randint(0, 9)}:00:00Z", f"v{rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}",
        f"/usr/{name}/{of(low, 2, 8)}/{of(low, 2, 8)}.py", f"{name}_{of(low, 2, 8)}({of(low, 1, 6)}={of(digits, 1, 4)})",
        f"{of(digits, 1, 3)}.{of(digits, 1, 3)}.{of(digits, 1, 3)}.{of(digits, 1, 3)}", of(digits, 4, 16), f"{of(digits, 1, 3)},{of(digits, 3, 3)}.{of(digits, 2, 2)}",
        f"#{of('0123456789abcdef', 6, 6)}", f"{of(string.ascii_uppercase, 2, 4)}-{of(digits, 2, 6)}", f"{name.capitalize()}{of(low, 3, 7).capitalize()}",
        name.upper(), f"{of(low, 2, 6)}={of(low, 2, 8)}", f"{of(low, 2, 6)}: {of(low, 2, 8)}", f"{name}-{of(low, 3, 8)}-{of(low, 3, 8)}",
    ])


def _inserted(text: str, at: tuple[int, int], key: str, value: str, rng: random.Random) -> Window:
    """``text`` with key and value in the place ``at``, and the span of the value."""
    quote = rng.choice(["", "", '"', "'"])
    bare = key.lower().endswith("bearer") and rng.random() < 0.7
    sign = " " if bare else rng.choice(["=", " = ", ": ", ":", "=", " := "]) if key else ""
    before = text[: at[0]] + key + sign + quote
    after = quote + rng.choice(["", "", ",", ";", "."]) * (text[at[1]: at[1] + 1] in ("", " "))
    return before + value + after + text[at[1]:], [(len(before), len(before) + len(value))]


def variants(text: str, rng: random.Random) -> list[Window]:
    """The window as the patterns tag it, and others that go beyond them."""
    spans = base_spans(text)
    own = [(text, [(value, end) for _, _, end, value in spans])]
    if not spans:
        words = [m.span() for m in re.finditer(r"\S+", text)]
        if len(words) < 4:
            return own
        at = words[rng.randrange(1, len(words) - 1)]
        plain = text[at[0]: at[1]].strip(".,;:!?\"'()").lower()
        if plain.isalpha():
            cue = rng.choice([*RENAMED, "password", "token", "secret", "key"])
            shown = cue + rng.choice([" ", " is ", " and ", ": the ", ", "])
            made = text[: at[0]] + shown + plain + text[at[1]:]
            own.append((made, [(v, e) for _, _, e, v in base_spans(made)]))
        made = " ".join([text[: at[0]], _ordinary(rng), text[at[0]: at[1]], _ordinary(rng), text[at[1]:]])
        own.append((made, [(v, e) for _, _, e, v in base_spans(made)]))
        key, value = rng.choice(RENAMED), _value(rng)
        if rng.random() < 0.2:
            key, value = "", rng.choice(PREFIXES) + _letters(rng, 20, 40)
        made, ((begin, end),) = _inserted(text, (at[0], at[0]), key, value + " ", rng)
        own.append((made, [(begin, end - 1)]))
        return own
    start, _, end, _ = spans[rng.randrange(len(spans))]
    if sum(start < e and a < end for a, _, e, _ in spans) > 1:
        return own  # base spans in one another, such as a hexadecimal value of an assignment
    known = rng.choice(["password", "token", "secret", "api_key", "passwd"])
    made = [
        _inserted(text, (start, end), rng.choice(RENAMED), _value(rng), rng),
        _inserted(text, (start, end), known, _value(rng), rng),
    ]
    if rng.random() < 0.7:
        made.append(_inserted(text, (start, end), "", rng.choice(PREFIXES) + _letters(rng, 20, 40), rng))
    rest = [(v, e) for a, _, e, v in spans if e <= start]
    return own + [(t, rest + found) for t, found in made if not any(a >= end for a, *_ in spans)]


def windows_of(text: str, positive: bool) -> list[str]:
    """Windows around base spans, or at places that a hash of the text names; whole words."""
    if positive:
        places = [(a, b) for a, _, b, _ in base_spans(text)]
    else:
        seed = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")
        rng = random.Random(seed)
        places = [(at, at) for at in (rng.randrange(len(text)) for _ in range(PER_TEXT))] if text else []
    ranked = sorted(places, key=lambda p: hashlib.blake2b(f"{p}:{len(text)}".encode(), digest_size=8).digest())
    found = []
    for begin, end in ranked[:PER_TEXT]:
        begin, end = max(0, begin - SIDE), min(len(text), end + SIDE)
        while 0 < begin and not text[begin - 1].isspace() and begin % 64:
            begin -= 1
        while end < len(text) and not text[end].isspace() and end % 64:
            end += 1
        if end - begin <= 6 * SIDE:
            found.append(text[begin:end])
    return found


def examples(windows: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, tags, gaps) of the variants of some windows."""
    made = []
    for text in windows:
        rng = random.Random(int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big"))
        made += variants(text, rng)
    raw = [text.encode() for text, _ in made]
    cuts = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    measures = np.array([_measure(text) for text, _ in made])
    tokens = Tokens(np.frombuffer(b"".join(raw), np.uint8), cuts[:-1], measures)
    tags = np.full(len(tokens.start), crf.O, np.int8)
    for k, (text, spans) in enumerate(made):
        first, last = np.searchsorted(tokens.text, [k, k + 1])
        for a, b in spans:
            begin = cuts[k] + len(text[:a].encode())
            end = begin + len(text[a:b].encode())
            inside = first + np.flatnonzero((tokens.start[first:last] < end) & (tokens.end[first:last] > begin))
            if len(inside):
                tags[inside] = crf.I
                # a value that white space splits goes on as another one
                tags[inside[tokens.gap[inside]]] = crf.B
                tags[inside[0]] = crf.B
    bounds = np.searchsorted(tokens.text, np.arange(len(made) + 1))
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a > LONGEST:  # the tokens around the first secret, else the first ones
            secret = np.flatnonzero(tags[a:b] != crf.O)
            a += max(0, int(secret[0]) - LONGEST // 3) if len(secret) else 0
            b = min(b, a + LONGEST)
            tags[a] = crf.B if tags[a] == crf.I else tags[a]
        if b > a:
            out.append((tokens.x[a:b], tags[a:b], tokens.gap[a:b]))
    return out


def _measure(text: str) -> int:
    return measure(len(text), "=" in text, _has_keyword(text))


def sampled_windows(docs: DataFrame, positive: int, negative: int) -> list[str]:
    """The training windows, at most ``positive`` and ``negative``, whatever the partitions.

    A text enters if its hash lies below a threshold, which the number of texts of its sort
    sets so that about as many as wanted pass; equal windows are one.
    """
    texts = docs.select(
        F.col("text"), F.col("text").rlike(LIKELY).alias("likely"),
        F.pmod(F.xxhash64("text"), F.lit(1 << 32)).alias("h"),
    ).where("text <> ''")
    counts = texts.agg(F.count_if("likely").alias("likely"), F.count("*").alias("all")).first()

    def below(wanted: int, count: int) -> int:
        return min(1 << 32, (wanted << 32) // max(1, count))

    chosen = texts.where(
        (F.col("likely") & (F.col("h") < below(positive, counts["likely"])))
        | (F.col("h") < below(negative, counts["all"]))
    ).select("text", (F.col("likely") & (F.col("h") < below(positive, counts["likely"]))).alias("likely"),
             (F.col("h") < below(negative, counts["all"])).alias("any"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, likely, other in zip(*(batch.column(k).to_pylist() for k in range(3))):
                out += [(True, w) for w in windows_of(text, True)] if likely else []
                out += [(False, w) for w in windows_of(text, False)] if other else []
            columns = list(zip(*sorted(set(out)), strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.bool_()), pa.array(columns[1], pa.string())],
                names=["positive", "text"],
            )

    rows = map_batches(chosen, run, "positive boolean, text string").distinct().collect()
    ranked = sorted(rows, key=lambda r: hashlib.blake2b(r["text"].encode(), digest_size=8).digest())
    return [r["text"] for r in ranked if r["positive"]][:positive] + [
        r["text"] for r in ranked if not r["positive"]][:negative]


def train(docs: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> Field | None:
    """A field fit on at most so many windows and their variants; None without base spans."""
    windows = sampled_windows(docs, positive, negative)
    if not any(base_spans(w) for w in windows):
        return None
    return train_field(examples(windows))


# -- spans of the field -----------------------------------------------------------


def _pieces(lengths: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, behind the last, begin and end in the only text): ``PIECE`` bytes or so."""
    first = held = 0
    for k, size in enumerate(lengths.tolist()):
        if size > crf.PIECE:
            if first < k:
                yield first, k, 0, -1
            for at in range(0, size, crf.PIECE):
                yield k, k + 1, at, min(size, at + crf.PIECE)
            first, held = k + 1, 0
        elif held + size > crf.PIECE:
            yield first, k, 0, -1
            first, held = k, size
        else:
            held += size
    if first < len(lengths):
        yield first, len(lengths), 0, -1


def field_spans(field: Field, column: pa.Array, measures: list[int]) -> dict[int, list[tuple[int, int]]]:
    """The field's spans in bytes, (begin, end) by place of the text in the column."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    known = np.array(measures, np.int64)
    found: dict[int, list[tuple[int, int]]] = {}
    for first, last, begin, end in _pieces(np.diff(offsets)):
        low, high = offsets[first], offsets[last]
        if end >= 0:  # a piece of one text, with its surroundings
            low, high = max(low, low + begin - crf.MARGIN), min(high, low + end + crf.MARGIN)
        cuts = np.maximum(offsets[first:last], low) - low
        tokens = Tokens(data[low:high], cuts, known[first:last])
        if not len(tokens.start):
            continue
        for a, b in _tagged(tokens, field.decode(tokens)):
            text = first + int(tokens.text[a])
            from_, to = int(tokens.start[a] + low - offsets[text]), int(tokens.end[b] + low - offsets[text])
            to = _grown(data, int(offsets[text]), to, int(offsets[text + 1] - offsets[text]))
            while to > from_ and data[offsets[text] + to - 1] in b".-:":
                to -= 1
            if to - from_ >= LEAST and (end < 0 or begin <= from_ < end):
                found.setdefault(text, []).append((from_, to))
    return found


def _grown(data: np.ndarray, offset: int, end: int, size: int) -> int:
    """The end of the value that a span reaches into: white space, a quote, a bracket, a comma."""
    stop = DELIMITER.search(data[offset + end: offset + min(size, end + GROWTH)].tobytes())
    return end + (stop.start() if stop else min(size - end, GROWTH))


def _tagged(tokens: Tokens, tags: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first token, last token) of each span."""
    own = tags != crf.O
    follows = np.zeros(len(tags), bool)
    follows[1:] = own[:-1]
    begins = own & ((tags == crf.B) | ~follows | tokens.gap)
    stops = np.append(np.flatnonzero(begins | ~own), len(tags))
    for a in np.flatnonzero(begins).tolist():
        yield a, int(stops[np.searchsorted(stops, a, side="right")]) - 1


def _code_points(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in bytes as spans in characters."""
    if text.isascii():
        return spans
    raw = np.frombuffer(text.encode(), np.uint8)
    out, at, seen = [], 0, 0
    for a, b in sorted(spans):
        seen += int(np.count_nonzero((raw[at:a] & 0xC0) != 0x80))
        inside = int(np.count_nonzero((raw[a:b] & 0xC0) != 0x80))
        out.append((seen, seen + inside))
        at, seen = b, seen + inside
    return out


def _outside(span: tuple[int, int], base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a span that no base span covers."""
    at, end = span
    for a, _, b in base:
        if b <= at or a >= end:
            continue
        if a > at:
            yield at, a
        at = max(at, b)
    if at < end:
        yield at, end


def spans_of(column: pa.Array, field: Field | None) -> Iterator[tuple[list, list]]:
    """Base spans and all spans of each text, each (start, kind, end), sorted."""
    texts = [t or "" for t in column.to_pylist()]
    added = {} if field is None else field_spans(field, column, [_measure(t) for t in texts])
    for k, text in enumerate(texts):
        base = [(a, kind, b) for a, kind, b, _ in base_spans(text)]
        more = [
            (a, 3, b) for span in _code_points(text, added.get(k, [])) for a, b in _outside(span, base)
        ]
        yield base, sorted(base + more)


def all_spans(text: str | None, field: Field | None) -> tuple[list, list]:
    """Base spans and all spans of one text."""
    return next(spans_of(pa.array([text], pa.string()), field))


# -- jobs ---------------------------------------------------------------------


def scan(docs: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    field = docs.sparkSession.sparkContext.broadcast(train(texts, positive, negative))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, spans in spans_of(batch.column(1), field.value):
                counts = [sum(k == kind_of for _, k, _ in base) for kind_of in range(3)]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return map_batches(
        texts, run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def cut_out(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with each stretch covered by spans replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in spans:
        if start > at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> DataFrame:
    """The rows of ``docs`` with secrets cut out of ``text``, ``n_chars`` to match."""
    packed = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("doc"),
        F.col("text").cast("string").alias("text"),
    )
    field = docs.sparkSession.sparkContext.broadcast(train(packed, positive, negative))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            texts = batch.column(1).to_pylist()
            for text, (_, spans) in zip(texts, spans_of(batch.column(1), field.value)):
                found.append(cut_out(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.string())], names=["doc", "text"]
            )

    clean = map_batches(packed, run, packed.schema)
    columns = [F.col("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    cleaned = clean.select(*columns)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn(
            "n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))
        )
    return cleaned
