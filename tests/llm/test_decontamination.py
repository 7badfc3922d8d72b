import math
import random
import re

from pyspark.sql import functions as F

from firmweave.llm import decontamination as d
from tests.llm.samples import SF, awkward, none, sentence

BENCH = "item_id long, text string, doc_id long, seed long"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())


def plain(docs, items, by_length=False):
    """Best aligned run over all diagonals that share a masked window."""
    found = {}
    for item, text in items:
        y = words(text)
        for doc, body in docs:
            x = words(body)
            if doc is None or item is None:
                continue
            n = len(y)
            if by_length and n < 9:
                if (x == y if n < 5 else any(x[i:i + n] == y for i in range(len(x)))) and n:
                    found[doc, item] = n
                continue
            diagonals = set()
            for mask in (*d.MASKS, *((d.SHORT_MASK, d.LOOSE_MASK) if by_length and n < 15 else ())):
                kept = [k for k, c in enumerate(mask) if c == "1"]
                at = {}
                for j in range(len(y) - len(mask) + 1):
                    at.setdefault(tuple(y[j + k] for k in kept), []).append(j)
                for i in range(len(x) - len(mask) + 1):
                    diagonals |= {i - j for j in at.get(tuple(x[i + k] for k in kept), ())}
            for g in diagonals:
                now = best = equal = 0
                for j, w in enumerate(y):
                    if 0 <= g + j < len(x):
                        equal += x[g + j] == w
                        now = max(0, now + (1 if x[g + j] == w else -2))
                        best = max(best, now)
                asked = min(10, max(6, math.ceil(n * 0.4))) if by_length else d.LEAST_SCORE
                if best >= asked or by_length and equal >= n - n // 5:
                    found[doc, item] = max(best, found.get((doc, item), 0))
    return found


def check(docs, bench, **how):
    want = plain(
        [tuple(r) for r in docs.select("doc_id", "text").collect()],
        [tuple(r) for r in bench.select("item_id", "text").collect()],
        by_length="least" in how,
    )
    assert {(r.doc_id, r.item_id): r.score for r in d.overlaps(docs, bench, **how).collect()} == want
    return want


def made(rng):
    items = [(k, sentence(rng, n)) for k, n in enumerate((14, 30, 45, 12, 9, 40))]
    items += [(50, items[2][1]), (60, None), (None, items[1][1]), (61, ""), (62, "one"), (63, "the the the " * 8)]
    rows = []
    for doc in range(40):
        base = items[doc % 6][1].split()
        for _ in range(doc // 8):
            base[rng.randrange(len(base))] = f"z{rng.randrange(99)}"
        if doc % 3 == 0:
            base = base[: len(base) // 2]
        rows.append((200 + doc, f"{sentence(rng, doc)} {' '.join(base)}, {sentence(rng, 20)}".upper() if doc % 2 else " ".join(base), "a"))
    rows += [(300, sentence(rng, 500), "a"), (301, "the the the the the the the the the the the the the", "a")]
    return rows, items


def test_substituted_passages(spark):
    rows, items = made(random.Random(4))
    docs = awkward(spark, rows)
    bench = spark.createDataFrame([(*i, 1, 2) for i in items], BENCH)
    want = check(docs, bench)
    assert len(want) > 20
    clean = d.clean(docs, bench)
    assert clean.columns == docs.columns
    left = {r.doc_id for r in clean.select("doc_id").collect()}
    assert left == {r.doc_id for r in docs.collect()} - {doc for doc, _ in want}
    assert {None, 1, 2, 3, 5, 6, 300} <= left


def test_given_documents(spark):
    assert check(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))


def test_empty_tables(spark):
    docs, bench = awkward(spark), spark.createDataFrame([], BENCH)
    assert d.overlaps(docs, bench).count() == 0
    assert d.clean(docs, bench).count() == docs.count()
    assert d.overlaps(none(spark), spark.createDataFrame([(1, "a b c", 1, 1)], BENCH)).count() == 0


def test_only_native_operators(spark):
    rows, items = made(random.Random(4))
    plan = d.overlaps(awkward(spark, rows), spark.createDataFrame([(*i, 1, 2) for i in items], BENCH))
    text = plan._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", text)


def by_length(docs, bench):
    return {(r.doc_id, r.item_id): r.score for r in d.overlaps(docs, bench, least=None).collect()}


def test_recall_of_short_items_by_planted_truth(spark):
    """Half of the vocabulary is new words, so a passage can only stem from its item."""
    rng = random.Random(8)
    items, rows, planted = [], [], {}
    # words of the item, substitutions, least share to be found
    cases = ((5, 0, 1), (6, 0, 1), (7, 0, 1), (8, 0, 1), *((n, n // 5, 1 if n < 15 else 0.95) for n in (*range(9, 22), 25, 30, 40)))
    for n, misses, _ in cases:
        for _ in range(40):
            item = len(items)
            base = [f"i{item}w{k}" if k % 2 else f"{rng.choice('abcd')}{rng.randrange(300)}" for k in range(n)]
            items.append((item, " ".join(base)))
            for k in rng.sample(range(n), misses):
                base[k] = f"z{rng.randrange(999)}"
            rows.append((1000 + item, f"{sentence(rng, 30)} {' '.join(base)} {sentence(rng, 20)}", "a"))
            planted.setdefault((n, misses), set()).add((1000 + item, item))
    docs = awkward(spark, rows)
    bench = spark.createDataFrame([(*i, 1, 2) for i in items], BENCH)
    found = by_length(docs, bench)
    for n, misses, least in cases:
        own = planted[n, misses]
        assert len(own & found.keys()) >= least * len(own), (n, misses)
    assert found.keys() <= set.union(*planted.values())
    left = {r.doc_id for r in d.clean(docs, bench, least=None).select("doc_id").collect()}
    assert left == {r.doc_id for r in docs.collect()} - {doc for doc, _ in found}


def test_by_length_against_all_diagonals(spark):
    rows, items = made(random.Random(4))
    rng = random.Random(6)
    items += [(70 + n, sentence(rng, n)) for n in range(3, 16)]
    for item, text in items[-13:]:
        for misses in range(4):
            base = text.split()
            for k in rng.sample(range(len(base)), min(misses, len(base) - 1)):
                base[k] = f"z{rng.randrange(99)}"
            rows.append((1000 + 10 * item + misses, f"{sentence(rng, misses % 2 * 7)} {' '.join(base)} {sentence(rng, misses)}", "a"))
    docs = awkward(spark, rows)
    bench = spark.createDataFrame([(*i, 1, 2) for i in items], BENCH)
    assert len(check(docs, bench, least=None)) > 50
    given = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    check(*given, least=None)


def test_the_table_grows_with_the_seeds(spark):
    """Ten times the items leave as few places of unrelated texts; the table stays within its bound."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, sentence(rng, 400)) for k in range(20)], "doc_id long, text string")
    for n, bits in ((10, 20), (6000, 20), (60_000, 23)):
        bench = spark.range(n).selectExpr("id AS item_id", "array_join(transform(sequence(1, 20), k -> 'q' || (id * 20 + k)), ' ') AS text")
        seeds = d.item_seeds(bench, True)
        table, size = d.bit_table(seeds)
        assert size == bits
        filled = spark.range(1).select(F.aggregate(table, F.lit(0), lambda a, w: a + F.bit_count(w)).alias("n")).first().n
        assert filled <= 0.5 * 2**size
        assert d.candidates(docs, bench, True).count() == 0


def test_items_below_the_masks(spark):
    rng = random.Random(9)
    items = [(1, "one"), (2, "Alpha beta, gamma"), (3, "five words in a row"), (4, ""), (5, "a b c d e f g h")]
    rows = [
        (400, "alpha BETA gamma!", "a"), (401, "alpha beta gamma delta", "a"), (402, f"{sentence(rng, 9)} five words in a row", "a"),
        (403, "five words in a", "a"), (404, "one two", "a"), (405, "a b c d e f g", "a"), (406, "x a b c d e f g h", "a"),
        (407, "b c d e f g h", "a"),
    ]
    bench = spark.createDataFrame([(*i, 1, 2) for i in items], BENCH)
    assert by_length(awkward(spark, rows), bench) == {(4, 1): 1, (400, 2): 3, (402, 3): 5, (406, 5): 8}


def test_by_length_finds_what_the_fixed_score_finds(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    fixed = {(r.doc_id, r.item_id): r.score for r in d.overlaps(docs, bench).collect()}
    found = by_length(docs, bench)
    assert fixed.items() <= found.items()
    assert not re.search("Python|Arrow|Pandas", d.overlaps(docs, bench, least=None)._jdf.queryExecution().toString())
