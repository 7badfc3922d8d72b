"""N-gram Jaccard self-join by partitioning the universe of shingles.

A document's set holds its distinct five-word shingles (words
``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; fewer words: the whole sequence
as one).  Two documents link when 100 * |A and B| >= percent * |A or B|.

Method.  Sizes fall in bands.  In a band, a hash deals the universe of shingles
into m segments, where m is one more than the largest possible difference of two
linked sets.  By the pigeonhole principle linked sets agree in some segment.
More exactly: if a set gives segment i the threshold v[i] in {-1, 0, 1} and the
sum of (v[i] + 1) exceeds the largest possible difference, each partner differs
from it by at most v[i] in some segment i.  Threshold 0 is met by the hash of the
segment's subset, threshold 1 by subsets with one element deleted on one of the
sides, -1 costs nothing.  Subsets without rare elements meet many strangers; each
set spends its thresholds where the expected number of rows met (``MEETS``, by rare
elements) is least, so segments that are empty or hold nothing but a passage that
many documents share are left out and made up for by a deletion neighbourhood
elsewhere.  Which shingles are frequent is counted over all documents; the table
of the ``FREQUENT`` most frequent guides costs only, never what is found.  Residents of a band index all their segments, and deletions in the
first few; sets of the band below whose partners may be larger only probe.

Candidates.  Rows with an equal key form a bucket.  First each row meets the
bucket's first probing row only, so a bucket of k near copies costs k pairs, not
k * k.  Then, in buckets that still hold several components, rows of different
components meet, unless sizes or a parity sketch of 1024 bits prove that they cannot
link (each differing shingle flips one bit, so the sketches' distance never
exceeds the true difference).  All survivors are verified on their whole texts.
No link between different sets is lost: pairs left out are in one component
already or proven apart.

Equal sets are one class from the start, by a 128-bit hash: a task emits keys only
for the first document of each class that it reads, and only the smallest id of
a class is verified.

Defined cases: no text or no words -> n_shingles 0, linked with nothing; missing
doc_id -> n_shingles, component_id missing; rows that repeat a doc_id are one
document whose links are those of all its texts; empty table -> no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from firmweave.llm.components import smallest_reachable
from firmweave.llm.tables import map_batches, materialize
from firmweave.llm.wordhash import U, Words, chunks, constants, mix, windows

WIDTH = 5
PERCENT = 80
#: rows a probe meets in a segment of 0, 1, 2, ... rare elements, relative to many
MEETS = (1_000_000, 16, 4, 1)
#: size of the table of frequent shingles, and the documents that make one frequent
FREQUENT, OFTEN = 65_536, 40
#: shingles counted together in a task, and how many of these counts it forwards
COUNTED, FORWARDED = 2_000_000, 4096
#: classes a task remembers so as not to emit a copy's keys again
REMEMBERED = 200_000
#: 64-bit numbers of a set's parity sketch
SKETCH = 16
#: members verified together with one copy of their centre's text
MEMBERS = 256
SEED = 10


# -- sets ---------------------------------------------------------------------


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle numbers of each text."""
    short = constants(width, SEED + 1)
    for _, run in chunks(texts):
        words = Words(run, fold=True)
        shingles = windows(words.number, width, SEED)
        for place in range(len(run)):
            begin, end = int(words.first[place]), int(words.first[place + 1])
            if end - begin >= width:
                yield np.unique(shingles[begin : end - width + 1])
            elif end == begin:
                yield np.zeros(0, U)
            else:
                with np.errstate(over="ignore"):
                    total = (words.number[begin:end] * short[: end - begin]).sum(dtype=U)
                    yield mix(total + constants(1, SEED + 2 + end - begin))


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set."""
    with np.errstate(over="ignore"):
        sums = [mix(shingles ^ c).sum(dtype=U) for c in constants(2, SEED + 20)]
        ends = mix(np.array(sums, U) + U(len(shingles)))
    low, high = ends.view(np.int64).tolist()
    return low, high


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """Parities of 64 * ``SKETCH`` bins as 64-bit numbers."""
    at = (mix(shingles ^ constants(1, SEED + 30)) >> U(32)) * U(64 * SKETCH) >> U(32)
    bins = np.bincount(at.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bins.astype(np.uint8)).view(np.int64)


# -- signatures ---------------------------------------------------------------


def most_apart(a: int, b: int, percent: int) -> int:
    """The largest difference of linked sets of ``a`` and ``b`` elements."""
    return (a + b) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=4)
def band_starts(limit: int = 1 << 31) -> list[int]:
    starts = [1]
    while starts[-1] < limit:
        starts.append(max(starts[-1] + 1, starts[-1] * 3 // 2))
    return starts


def _scheme(band: int, percent: int) -> tuple[int, int]:
    """Segments of a band, and how many of them index deletions."""
    top = band_starts()[band + 1] - 1
    segments = most_apart(top, top, percent) + 1
    return segments, min(segments, 4 + segments // 32)


def allot(counts: np.ndarray, rare: np.ndarray, need: int, deletable: int) -> np.ndarray:
    """Thresholds v with sum(v + 1) >= need and the least expected rows met.

    ``counts`` and ``rare``: elements and rare elements of each segment.
    """
    v = np.zeros(len(counts), dtype=np.int8)
    cost = np.array(MEETS)
    last = len(MEETS) - 1
    meets = cost[np.minimum(rare, last)]
    worst = np.argsort(rare, kind="stable")
    spare = len(counts) - need
    v[worst[:spare]] = -1
    raised = (counts[:deletable] + 1) * cost[np.clip(rare[:deletable] - 1, 0, last)]
    best = [i for i in np.argsort(raised, kind="stable") if v[i] == 0]
    for i in worst[spare:]:
        if rare[i] >= last:
            break
        if v[i] != 0:
            continue
        while best and v[best[0]] != 0:
            best.pop(0)
        if not best or best[0] == i or raised[best[0]] >= meets[i]:
            continue
        v[i], v[best.pop(0)] = -1, 1
    return v


def _band_keys(
    shingles: np.ndarray, rare: np.ndarray, band: int, partner: int, resident: bool, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Keys and probe marks of one set in one band."""
    segments, deletable = _scheme(band, percent)
    salt = constants(3, SEED + 100 + band)
    with np.errstate(over="ignore"):
        dealt = mix(shingles ^ salt[0])
        place = (((dealt >> U(32)) * U(segments)) >> U(32)).astype(np.int64)
        value = mix(dealt + salt[1])
        order = np.argsort(place, kind="stable")
        place, value = place[order], value[order]
        counts = np.bincount(place, minlength=segments)
        sums = np.zeros(segments, U)
        held = np.flatnonzero(counts)
        sums[held] = np.add.reduceat(value, (np.cumsum(counts) - counts)[held])
        tag = mix(np.arange(segments, dtype=np.int64).astype(U) + salt[2])
        rares = np.bincount(place, weights=rare[order], minlength=segments).astype(np.int64)
        v = allot(counts, rares, most_apart(len(shingles), partner, percent) + 1, deletable)
        whole = np.flatnonzero(v >= 0) if not resident else np.arange(segments)
        keys, probes = mix(sums[whole] ^ tag[whole]), v[whole] >= 0
        cut = (place < deletable) if resident else (v[place] == 1)
        at = place[cut]
        if len(at):
            keys = np.concatenate([keys, mix((sums[at] - value[cut]) ^ tag[at])])
            probes = np.concatenate([probes, v[at] == 1])
    return keys, probes


def keys_of(
    shingles: np.ndarray, percent: int = PERCENT, frequent: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a set and which of them probe; ``frequent``: sorted shingles."""
    rare = np.ones(len(shingles), bool)
    if frequent is not None and len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        rare = frequent[at] != shingles
    size = len(shingles)
    if not size:
        return np.zeros(0, U), np.zeros(0, bool)
    starts = band_starts()
    band = int(np.searchsorted(starts, size, side="right")) - 1
    largest = size * 100 // percent
    found = []
    while starts[band] <= largest:
        resident = starts[band] <= size
        partner = min(starts[band + 1] - 1, largest)
        found.append(_band_keys(shingles, rare, band, partner, resident, percent))
        band += 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# -- jobs ---------------------------------------------------------------------

_PARITIES = [f"k{i}" for i in range(SKETCH)]
_NAMES = ["doc_id", "n_shingles", "c0", "c1", *_PARITIES]
_META = "doc_id long, n_shingles int, " + ", ".join(f"{c} long" for c in _NAMES[2:])


def _describe(docs: DataFrame, width: int) -> DataFrame:
    """A row per document, and rows of counted shingles (n_shingles -1, c0, count c1)."""

    def table(ids: list, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * (len(_NAMES) - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(columns[0], pa.int32())]
            + [pa.array(c, pa.int64()) for c in columns[1:]],
            names=_NAMES,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, waiting = _Seen(), [], 0
        for batch in batches:
            ids, rows, counted = batch.column(0).to_pylist(), [], []
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                name = class_of(s)
                rows.append((len(s), *name, *sketch_of(s).tolist()))
                if not seen.add(name):
                    held.append(s)
                    waiting += len(s)
                if waiting >= COUNTED:
                    counted += _counted(held)
                    held, waiting = [], 0
            yield table(
                ids + [None] * len(counted), rows + [(-1, c, n, *[0] * SKETCH) for c, n in counted]
            )
        counted = _counted(held)
        yield table([None] * len(counted), [(-1, c, n, *[0] * SKETCH) for c, n in counted])

    return map_batches(docs, run, _META)


class _Seen:
    """The last classes a task has read."""

    def __init__(self) -> None:
        self.names: OrderedDict[tuple[int, int], None] = OrderedDict()

    def add(self, name: tuple[int, int]) -> bool:
        """Remember ``name``; whether it was known."""
        known = name in self.names
        self.names[name] = None
        if len(self.names) > REMEMBERED:
            self.names.popitem(last=False)
        return known


def _counted(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """The most frequent shingles of some sets and their numbers of sets."""
    if not sets:
        return []
    shingle, n = np.unique(np.concatenate(sets), return_counts=True)
    often = np.flatnonzero(n >= 3)
    often = often[np.argsort(-n[often], kind="stable")][:FORWARDED]
    return list(zip(shingle[often].view(np.int64).tolist(), n[often].tolist(), strict=True))


def _frequent(meta: DataFrame) -> np.ndarray:
    """The sorted table of frequent shingles, of a fixed size at most."""
    top = (
        meta.where("n_shingles = -1").groupBy("c0").agg(F.sum("c1").alias("n"))
        .where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "c0").limit(FREQUENT)
    )
    return np.sort(np.array([r.c0 for r in top.select("c0").collect()], np.int64).view(U))


def _signatures(docs: DataFrame, frequent: np.ndarray, width: int, percent: int) -> DataFrame:
    """(key, doc, probe): one row per key of the documents a task has no copy of yet."""
    table = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            rows = 0
            for doc, s in zip(ids, shingle_sets(batch.column(1).to_pylist(), width), strict=True):
                if doc is None or not len(s) or seen.add(class_of(s)):
                    continue
                keys, probes = keys_of(s, percent, table.value)
                held.append((keys.view(np.int64), np.full(len(keys), doc, np.int64), probes))
                rows += len(keys)
                if rows >= 1 << 18:
                    yield _rows(held)
                    held, rows = [], 0
            if held:
                yield _rows(held)

    return map_batches(docs, run, "key long, doc long, probe boolean")


def _rows(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["key", "doc", "probe"]
    )


def _may_link(a: str, b: str, percent: int) -> Column:
    """False only where sizes or sketches prove that two sets cannot link."""
    small, large = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
    apart = sum(
        (F.bit_count(F.col(a + k).bitwiseXOR(F.col(b + k))) for k in _PARITIES), F.lit(0)
    )
    return (small.cast("long") * 100 >= large.cast("long") * percent) & (
        apart.cast("long") * (100 + percent)
        <= (F.col(f"{a}n") + F.col(f"{b}n")).cast("long") * (100 - percent)
    )


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets truly link.

    ``b``'s text travels to its centre ``a``; a centre with many members is dealt
    over several groups, each with its own copy of the centre's text.
    """
    if pairs.isEmpty():
        return pairs
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("groups"))
    dealt = pairs.join(sizes, "a").select(
        "a", "b", "groups", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g")
    )
    wanted = dealt.select(F.col("b").alias("doc"), "a", "g", F.lit(1).alias("role")).unionAll(
        dealt.select("a", "g").distinct().select(
            F.col("a").alias("doc"), "a", "g", F.lit(0).alias("role")
        )
    )
    carried = texts.join(materialize(wanted, "jaccard-wanted"), texts["doc_id"] == F.col("doc"))
    dealt_texts = carried.select("a", "g", "role", "doc", "text").repartition("a", "g")
    # the narrow key sorts first: the text is carried along, centres ahead of members
    sorted_texts = dealt_texts.sortWithinPartitions("a", "g", "role", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centres = None, []
        for batch in batches:
            a, g, role, doc = (batch.column(k).to_pylist() for k in range(4))
            found = []
            for k, s in enumerate(shingle_sets(batch.column(4).to_pylist(), width)):
                if (a[k], g[k]) != group:
                    group, centres = (a[k], g[k]), []
                if role[k] == 0:
                    centres.append(s)
                    continue
                for centre in centres:
                    small, large = sorted((len(s), len(centre)))
                    if small * 100 < large * percent:
                        continue
                    both = len(np.intersect1d(s, centre, assume_unique=True))
                    if both * 100 >= (small + large - both) * percent:
                        found.append((a[k], doc[k]))
                        break
            columns = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["a", "b"]
            )

    return map_batches(sorted_texts, run, "a long, b long").distinct()


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = materialize(_describe(texts, width), "jaccard-sets")
    meta = described.where("n_shingles >= 0")
    known = meta.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = known.groupBy("c0", "c1").agg(F.min("doc_id").alias("rep"))
    nodes = materialize(
        known.join(classes, ["c0", "c1"]).select(
            F.col("doc_id").alias("doc"), "rep", F.col("n_shingles").alias("n"), *_PARITIES
        ).distinct(),
        "jaccard-nodes",
    )

    # each row of a bucket meets the bucket's first probing row
    first = Window.partitionBy("key").orderBy(F.desc("probe"), "doc")
    bucket = _signatures(texts, _frequent(described), width, percent).select(
        "key", "doc", "probe",
        F.first("doc").over(first).alias("centre"), F.first("probe").over(first).alias("met"),
    )
    members = materialize(bucket.where("met AND doc <> centre").drop("met"), "jaccard-buckets")

    def side(prefix: str) -> DataFrame:
        return nodes.select([F.col(c).alias(prefix + c) for c in nodes.columns])

    star = (
        members.select("centre", "doc").distinct()
        .join(side("x_"), F.col("centre") == F.col("x_doc"))
        .join(side("y_"), F.col("doc") == F.col("y_doc"))
        .where(F.col("x_rep") != F.col("y_rep"))
        .where(_may_link("x_", "y_", percent))
        .select(*_ordered(F.col("x_rep"), F.col("y_rep")))
        .distinct()
    )
    tried = materialize(star, "jaccard-pairs")
    links = materialize(_verified(tried, texts, width, percent), "jaccard-links")
    # rows that repeat a doc_id with another text tie the classes of those texts
    tied = nodes.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("z"))
    same = nodes.join(tied.where("a <> z").drop("z"), "doc").where("rep <> a").select(
        "a", F.col("rep").alias("b")
    )
    placed = _placed(nodes, smallest_reachable(links.unionAll(same)))
    rest = materialize(_across(members, placed, tried, percent), "jaccard-pairs")
    if not rest.isEmpty():
        more = materialize(_verified(rest, texts, width, percent), "jaccard-links")
        placed = _placed(nodes, smallest_reachable(links.unionAll(more).unionAll(same)))
    final = placed.groupBy(F.col("doc").alias("doc_id")).agg(F.min("comp").alias("comp"))
    return meta.join(final, "doc_id", "left").select(
        "doc_id",
        F.col("n_shingles").cast("long").alias("n_shingles"),
        F.coalesce("comp", "doc_id").alias("component_id"),
    )


def _placed(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with the component of their class."""
    return materialize(
        nodes.join(labels, nodes["rep"] == labels["node"], "left").select(
            nodes["*"], F.coalesce("label", "rep").alias("comp")
        ),
        "jaccard-placed",
    )


def _across(members: DataFrame, placed: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a bucket and may yet link."""
    short = placed.groupBy("doc").agg(F.min("comp").alias("comp"))
    at_centre = short.select(F.col("doc").alias("centre"), F.col("comp").alias("centre_comp"))
    parted = (
        members.select("centre", "doc").distinct()
        .join(short, "doc").join(at_centre, "centre")
        .where("comp <> centre_comp").select("centre", "doc")
    )
    mixed = members.join(parted, ["centre", "doc"], "left_semi").select("key").distinct()
    rows = members.join(mixed, "key", "left_semi")
    rows = rows.select("key", "doc", "probe").unionAll(
        rows.select("key", F.col("centre").alias("doc"), F.lit(True).alias("probe")).distinct()
    )
    full = materialize(rows.join(placed, "doc"), "jaccard-mixed")

    def side(prefix: str) -> DataFrame:
        return full.select([F.col(c).alias(prefix + c) for c in full.columns])

    met = side("x_").join(
        side("y_"),
        (F.col("x_key") == F.col("y_key"))
        & (F.col("x_comp") < F.col("y_comp"))
        & (F.col("x_probe") | F.col("y_probe"))
        & _may_link("x_", "y_", percent),
    )
    return (
        met.select(*_ordered(F.col("x_rep"), F.col("y_rep"))).distinct()
        .join(tried, ["a", "b"], "left_anti")
    )


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of linked texts.

    Groups are of texts, not of ids: rows that repeat a doc_id with unlike texts are
    documents of their own, and all of them stay unless linked texts go.  Of a group
    the smallest doc_id stays, then the smallest hash of a text; of rows equal in
    both, the one whose other columns come first as JSON.  So the choice does not
    depend on the order of the rows.  Documents without an id stay.
    """
    held = "`{}`".format
    packed = docs.select(
        F.struct(*[docs[held(c)] for c in docs.columns]).alias("doc"),
        docs["doc_id"].cast("long").alias("id"),
        docs["text"].cast("string").alias("body"),
        F.to_json(
            F.struct(*[docs[held(c)] for c in docs.columns if c not in ("doc_id", "text")])
        ).alias("rest"),
    ).withColumn("digest", F.coalesce(F.md5("body"), F.lit("")))
    known = packed.where("id IS NOT NULL")
    numbered = _numbered_texts(known.select("id", "digest"))
    keyed = known.withColumn("key", F.col("id"))
    if numbered is not None:
        keyed = known.join(numbered, ["id", "digest"], "left").withColumn(
            "key", F.coalesce("number", "id")
        ).drop("number")
    joined = jaccard_join(
        keyed.select(F.col("key").alias("doc_id"), F.col("body").alias("text")), width, percent
    ).distinct().select(F.col("doc_id").alias("key"), F.col("component_id").alias("comp"))
    if numbered is None:
        kept = joined.where("key = comp").select("key")
    else:
        named = joined.join(
            numbered.select(F.col("number").alias("key"), F.col("id"), F.col("digest")), "key", "left"
        )
        order = F.struct(
            F.coalesce("id", "key").alias("id"), F.coalesce("digest", F.lit("")).alias("digest")
        )
        kept = named.groupBy("comp").agg(F.min_by("key", order).alias("key")).select("key")
    kept = materialize(kept, "jaccard-kept")
    once = (
        keyed.join(kept, "key", "left_semi")
        .groupBy("key").agg(F.min_by("doc", "rest").alias("doc")).select("doc")
    )
    return once.unionAll(packed.where("id IS NULL").select("doc")).select("doc.*")


def _numbered_texts(texts: DataFrame) -> DataFrame | None:
    """(id, digest, number) of all texts of an id but its first: ``number`` is unused as an id.

    None where no id has several texts.  The numbers are written, so that a lost
    executor cannot change them.  Ids may reach one end of the range of long, not both.
    """
    many = materialize(
        texts.groupBy("id").agg(F.min("digest").alias("first"), F.max("digest").alias("last"))
        .where("first <> last").select("id", "first"),
        "jaccard-many",
    )
    if many.isEmpty():
        return None
    least, greatest = texts.agg(F.min("id"), F.max("id")).first()
    place = F.monotonically_increasing_id()
    # the ids above all others, or those below where ids reach the end of the range
    number = F.lit(greatest) + 1 + place if greatest < 2**62 else F.lit(least) - 1 - place
    others = texts.join(many, "id").where("digest <> first").select("id", "digest").distinct()
    return materialize(others.withColumn("number", number), "jaccard-texts")
