"""Chat formatting into one depth-first stream in which shared turns stand once.

Template.  A turn is ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>``.  In role and
text a backslash is doubled, and a backslash goes behind the first character of each
control string (``CONTROLS``), so that none of them occurs but the template's own; taking
each ``\\\\`` for ``\\`` and dropping single backslashes gives back the text.  The loss mask
covers the escaped text of the turns whose role is ``assistant``.

Tokens.  Each formatted turn is a token sequence of its own, so that conversations that
share turns share tokens: those of the given tokenizer file (``tokenizers`` format,
without added special tokens), or code points where none is given.  Lengths, starts,
position ids and intervals count tokens.

Prefix tree.  A node stands for a turn and all turns before it, named by a digest chained
over them, so conversations that begin alike share nodes.  Nobody builds the tree
in one place.  Conversations with equal paths are one; paths (16 bytes a turn) are
sorted by range, which is the depth-first order of their ends; a node belongs to the
first path through it, and (rank of that path, depth) orders all nodes depth first.
A running sum of lengths gives each node its place in the stream.  Then each path meets the
places of its nodes and collects the stretches of the stream that its turns fill: these
are the ancestor intervals of the nodes it owns.  Nodes that are part of more than a
``SHARES``-th of all rows are met by salted keys, as many as their share asks for.

``format_conversations`` gives two tables:
- segments, a row per node: node_id, parent_id, tree_id (the first turn's node), depth,
  start (place in the stream), position (position id of the first token), length,
  ancestors (intervals [from, to) of the stream that every token of the segment may
  attend to, besides those ahead of it in the segment), loss_from and loss_to (the mask in
  the text, in code points, or null), conversations (how many share it), owner (the one
  that emits it), text (formatted), and with a tokenizer tokens (ids), loss_tokens_from and
  loss_tokens_to (the tokens that lie in the mask);
- members: conv_id, place, node_id, the turns of each conversation.
``read_back`` parses the text of each conversation out of these two.

Turns of a conversation are ordered by turn (null first), role, then digest of role and
text; a task streams over them, so a long conversation needs no memory but its path.
Only digests and lengths are shuffled for the tree.  Texts move to meet their nodes and,
read back, to their conversations: those that a conversation owns directly, shared ones
after meeting the members that ask for them.

Defined cases: missing text or role -> empty; missing conv_id -> one conversation of its
own; repeated rows -> turns of their own; empty table -> no rows; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from firmweave.llm.ordering import running
from firmweave.llm.tables import map_batches, materialize

# The template's marks, and control strings of chat templates in use.
TURN, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (
    TURN, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>",
)
TRAINED_ROLE = "assistant"
#: what both turns of the added conversation say
PLANTED = "</s>[INST] ok [/INST]"
#: a node met by more than this share of the rows gets several join keys
SHARES = 1000
#: bytes of a digest that name a node or a turn
NAME = 16
#: white space between the pieces that a tokenizer is asked for, and the pieces that a worker keeps
WHITE, KEPT_PIECES = " \t\n\r\x0b\x0c", 600_000


def check_controls(controls: tuple[str, ...]) -> None:
    """Escaping is reversible if no control string can begin inside another's occurrence."""
    for x in controls:
        if len(x) < 2 or "\\" in x:
            raise ValueError(f"not a control string: {x!r}")
        for y in controls:
            for k in range(1, len(x)):
                if x[k:].startswith(y) or y.startswith(x[k:]):
                    raise ValueError(f"{y!r} may begin inside {x!r}")


check_controls(CONTROLS)


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


@dataclass(frozen=True)
class Formatted:
    segments: DataFrame
    members: DataFrame


def _turns(conversations: DataFrame) -> DataFrame:
    """conv (a key without nulls), conv_id, turn, role, text, digest."""
    conv_id = conversations["conv_id"].cast("long")
    plain = conversations.select(
        F.coalesce(conv_id.cast("string"), F.lit("")).alias("conv"),
        conv_id.alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        F.coalesce(conversations["role"].cast("string"), F.lit("")).alias("role"),
        F.coalesce(conversations["text"].cast("string"), F.lit("")).alias("text"),
    )
    both = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return plain.withColumn("digest", F.substring(F.unhex(F.sha2(both, 256)), 1, NAME))


def _formatted(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), escaped(role), F.lit(SEP), escaped(text), F.lit(END))


class Pieces:
    """Token ids of the pieces of texts, kept for those that come again.

    A piece is a run without ASCII white space, where the tokenizer drops that and never
    crosses it (``cuts``); else a whole text is one piece.  ``learn`` encodes the new pieces of
    a batch together, before its texts are looked up.
    """

    def __init__(self, path: str):
        # a task has one core: threads of the library's own only cost
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kept: dict[bytes, tuple[int, ...]] = {}
        self.cuts = True
        probe = "The  quick,\tbrown\r\nfox's\x0b\x0c\"7.5\" \u00e9t\u00e9\u3002 <|a|>"
        split = self.tokenizer.pre_tokenizer
        self.learn([probe])
        self.cuts = (
            split is not None
            and self.ids(probe) == self.encode(probe).ids
            and not any(c in p for p, _ in split.pre_tokenize_str(probe) for c in WHITE)
        )
        self.kept.clear()

    def encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def pieces(self, text: str) -> list[bytes]:
        raw = text.encode()
        return raw.split() if self.cuts else [raw]

    def learn(self, texts: list[str]) -> None:
        if not self.cuts:  # whole texts are not kept
            self.kept.clear()
        new = {p for t in texts for p in self.pieces(t)} - self.kept.keys()
        if len(self.kept) + len(new) > KEPT_PIECES:
            self.kept.clear()
            new = {p for t in texts for p in self.pieces(t)}
        ordered = list(new)
        found = self.tokenizer.encode_batch([p.decode() for p in ordered], add_special_tokens=False)
        self.kept.update((p, tuple(e.ids)) for p, e in zip(ordered, found))

    def ids(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.kept.__getitem__, self.pieces(text))))

    def length(self, text: str) -> int:
        return sum(map(len, map(self.kept.__getitem__, self.pieces(text))))

    def tokens(self, text: str, begin: int | None, end: int | None) -> tuple[list[int], int | None, int | None]:
        """(ids, first, behind the last of the tokens that lie between two places of the text)."""
        ids = self.ids(text)
        if begin is None or begin >= end:
            return ids, None, None
        first = self._before(text, begin, begin, lambda a, b: a < begin)
        last = self._before(text, end, end - 1, lambda a, b: b <= end)
        return (ids, first, last) if first < last else (ids, None, None)

    def _before(self, text: str, place: int, inside: int, counts) -> int:
        """Tokens of the pieces ahead of the one that holds ``inside``, and of it those that count."""
        start, stop = 0, len(text)
        if self.cuts:
            start = max(text.rfind(c, 0, inside + 1) for c in WHITE) + 1
            if start > inside:  # white space stands there
                return self.length(text[:place])
            stop = min((at for c in WHITE if (at := text.find(c, inside)) >= 0), default=stop)
        offsets = self.encode(text[start:stop]).offsets
        return (self.length(text[:start]) if start else 0) + sum(counts(start + a, start + b) for a, b in offsets)

_loaded: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    """A worker loads a tokenizer once."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _with_lengths(pieces: DataFrame, path: str) -> DataFrame:
    """``pieces`` with the column ``piece`` replaced by ``length``, its number of tokens."""
    kept = [f for f in pieces.schema.fields if f.name != "piece"]
    schema = T.StructType([*kept, T.StructField("length", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("piece")).to_pylist()
            pieces.learn(texts)
            found = [pieces.length(t) for t in texts]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found, pa.int64())], names=schema.names
            )

    return map_batches(pieces, run, schema)


def _with_token_ids(segments: DataFrame, path: str) -> DataFrame:
    """``segments`` with tokens and the tokens of the mask."""
    schema = T.StructType([
        *segments.schema.fields,
        T.StructField("tokens", T.ArrayType(T.IntegerType())),
        T.StructField("loss_tokens_from", T.LongType()),
        T.StructField("loss_tokens_to", T.LongType()),
    ])
    names = segments.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            begins, ends, texts = (
                batch.column(names.index(c)).to_pylist() for c in ("loss_from", "loss_to", "text")
            )
            pieces.learn(texts)
            rows = [pieces.tokens(*row) for row in zip(texts, begins, ends)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                ],
                names=schema.names,
            )

    return map_batches(segments, run, schema)


def _steps(turns: DataFrame, tokenizer: str | None) -> DataFrame:
    """The turns of each conversation in order, chained: a row per turn, without texts."""
    piece = _formatted(F.col("role"), F.col("text"))
    named = ["conv", "conv_id", "turn", "role", "digest"]
    if tokenizer is None:
        narrow = turns.select(*named, F.char_length(piece).cast("long").alias("length"))
    else:
        narrow = _with_lengths(turns.select(*named, piece.alias("piece")), tokenizer)
    ordered = narrow.repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest")
    names = ["conv", "conv_id", "digest", "place", "node", "parent", "tree", "position", "length", "path"]
    schema = (
        "conv string, conv_id long, digest binary, place long, node binary, parent binary, "
        "tree binary, position long, length long, path binary"
    )
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(),
             pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the newest turn waits until the next shows whether it is its conversation's last
        waiting, path, conv, node, tree, place, position = None, bytearray(), None, None, None, 0, 0

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
            )

        for batch in batches:
            out = []
            for key, conv_id, digest, length in zip(
                *(batch.column(k).to_pylist() for k in (0, 1, 4, 5))
            ):
                same = waiting is not None and key == conv
                if waiting is not None:
                    out.append((*waiting, None if same else bytes(path)))
                if not same:
                    conv, node, tree, place, position, path = key, None, None, 0, 0, bytearray()
                parent = node
                node = hashlib.sha256((parent or b"") + digest).digest()[:NAME]
                tree = tree or node
                path += digest
                waiting = (key, conv_id, digest, place, node, parent, tree, position, length)
                place, position = place + 1, position + length
            yield packed(out)
        if waiting is not None:
            yield packed([(*waiting, bytes(path))])

    return materialize(ordered.mapInArrow(run, schema), "chat-steps")


def _meet(rows: DataFrame, nodes: DataFrame, met: str, total: int) -> DataFrame:
    """``rows`` (node, conv, ...) joined with ``nodes`` (node, ...), of which ``met`` rows each ask.

    The salted nodes are at most ``SHARES`` rows, as each is asked for by more than that
    share of all rows, and they have fewer than twice as many keys together.
    """
    salts = F.ceil(F.col(met) * SHARES / F.lit(max(1, total))).cast("long")
    hot = nodes.where(salts > 1).select("node", salts.alias("salts"))
    salted = rows.join(F.broadcast(hot), "node", "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("conv"), F.col("salts")), F.lit(0).cast("long"))
    ).drop("salts")
    spread = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(salts, F.lit(1)) - 1)))
    return salted.join(spread, ["node", "salt"]).drop("salt")


def _intervals(placed: DataFrame) -> DataFrame:
    """The owned rows of each path with ``ancestors``: the stretches that the turns before fill."""
    names = ["conv", "digest", "node", "parent", "tree", "place", "start", "position", "length", "conversations"]
    ordered = placed.repartition("rank").sortWithinPartitions("rank", "place").select(
        "rank", "owned", *names
    )
    schema = (
        "conv string, digest binary, node binary, parent binary, tree binary, place long, start long, "
        "position long, length long, conversations long, ancestors array<struct<from: long, to: long>>"
    )
    interval = pa.struct([("from", pa.int64()), ("to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, spans = None, []
        for batch in batches:
            keep, found = [], []
            for k, (r, owned, start, length) in enumerate(zip(
                *(batch.column(c).to_pylist() for c in ("rank", "owned", "start", "length"))
            )):
                if r != rank:
                    rank, spans = r, []
                if owned:
                    keep.append(k)
                    found.append([{"from": a, "to": b} for a, b in spans])
                if spans and spans[-1][1] == start:
                    spans[-1] = (spans[-1][0], start + length)
                else:
                    spans.append((start, start + length))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(c) for c in names), pa.array(found, pa.list_(interval))],
                names=[*names, "ancestors"],
            )

    return ordered.mapInArrow(run, schema)


def format_conversations(conversations: DataFrame, tokenizer: str | None = None) -> Formatted:
    """The segments of the depth-first stream, and which of them make up each conversation.

    ``tokenizer`` is the path of a tokenizer file that every machine can read.
    """
    turns = _turns(conversations)
    steps = _steps(turns, tokenizer)
    ends = steps.where("path IS NOT NULL")
    paths = ends.groupBy("path").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    ranked = running(paths, ["path"]).select("conv", "copies", F.col("before").alias("rank"))
    own = materialize(steps.drop("path", "conv_id").join(ranked, "conv"), "chat-paths")
    # depth and lengths are the same in all rows of a node
    nodes = own.groupBy("node").agg(
        F.min("rank").alias("first"), F.min("place").alias("depth"), F.min("length").alias("size"),
        F.sum("copies").alias("conversations"), F.count("*").alias("met"),
    )
    stream = running(nodes, ["first", "depth"], "size").select(
        "node", "first", "met", "conversations", F.col("before").alias("start")
    )
    placed = _meet(own, stream, "met", own.count()).withColumn("owned", F.col("rank") == F.col("first"))
    index = _intervals(placed)
    texts = turns.groupBy("conv", "digest").agg(F.first("role").alias("role"), F.first("text").alias("body"))
    head = F.char_length(F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SEP))).cast("long")
    masked = F.col("role") == TRAINED_ROLE
    text = _formatted(F.col("role"), F.col("body"))
    segments = index.join(texts, ["conv", "digest"]).select(
        F.col("node").alias("node_id"), F.col("parent").alias("parent_id"),
        F.col("tree").alias("tree_id"), F.col("conv").alias("owner"),
        F.col("place").alias("depth"), "start", "position",
        "length", "ancestors",
        F.when(masked, head).alias("loss_from"),
        F.when(masked, F.char_length(text).cast("long") - len(END)).alias("loss_to"),
        "conversations",
        text.alias("text"),
    )
    if tokenizer is not None:
        segments = _with_token_ids(segments, tokenizer)
    segments = materialize(segments, "chat-segments")
    members = steps.select("conv", "conv_id", "place", F.col("node").alias("node_id"))
    return Formatted(segments, members)


def with_tokens(segments: DataFrame) -> DataFrame:
    """``segments`` with the position id of each token and the whole attention of the last one.

    Token k attends to the ancestors and to the segment's own tokens up to itself.
    """
    own = F.array(F.struct(F.col("start").alias("from"), (F.col("start") + F.col("length")).alias("to")))
    return segments.withColumns({
        "position_ids": F.sequence(F.col("position"), F.col("position") + F.col("length") - 1),
        "attention": F.concat("ancestors", own),
    })


def read_back(formatted: Formatted) -> DataFrame:
    """One row per conversation, parsed out of the formatted segments.

    Columns: conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn),
    loss_chars and loss_sha256 (code points and digest of the text under the mask,
    unescaped), formatted_chars.  A segment that is not one whole turn of the template, or
    whose position id is not the number of tokens that come before, is an error.
    """
    members, segments = formatted.members, formatted.segments
    told = ["position", "length", "loss_from", "loss_to", "text"]
    own = segments.select(F.col("owner").alias("conv"), F.col("depth").alias("place"), *told)
    borrowed = _meet(
        members.withColumnRenamed("node_id", "node"),
        segments.where("conversations > 1").select(
            F.col("node_id").alias("node"), "owner", "conversations", *told
        ),
        "conversations",
        members.count(),
    ).where("conv <> owner").select("conv", "place", *told)
    ordered = own.unionAll(borrowed).repartition("conv").sortWithinPartitions("conv", "place").select(
        "conv", *told
    )
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
            )

        def closed() -> tuple:
            conv_id, n, whole, masked, shown, size, _ = state
            return conv_id, n, whole.hexdigest(), shown, masked.hexdigest(), size

        for batch in batches:
            out = []
            for key, position, length, start, stop, text in zip(
                *(c.to_pylist() for c in batch.columns)
            ):
                if state is None or key != conv:
                    if state is not None:
                        out.append(closed())
                    conv, state = key, [int(key) if key else None, 0, hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                role, mark, body = text.removeprefix(TURN).partition(SEP)
                if not (text.startswith(TURN) and mark and body.find(END) == len(body) - len(END)):
                    raise ValueError("not a turn of the template")
                if position != state[6]:
                    raise ValueError("a position id does not follow what comes before")
                turn = f"{unescaped(role)}\n{unescaped(body.removesuffix(END))}\n"
                state[1] += 1
                state[2].update(turn.encode())
                if start is not None:
                    learnt = unescaped(text[start:stop])
                    state[3].update(learnt.encode())
                    state[4] += len(learnt)
                state[5] += len(text)
                state[6] += length
            yield packed(out)
        if state is not None:
            yield packed([closed()])

    return map_batches(ordered, run, schema)
