"""The manifest against plain lists, and proofs that fail when they should."""

import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from firmweave.llm import merkle
from tests.llm.samples import SF, awkward, collected, none

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    values = (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, fanout):
    """(root, siblings of each node by level)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[k:k + fanout]) for k in range(0, len(last), fanout)])
    paths = []
    for place in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            start = place // fanout * fanout
            run = level[start:start + fanout]
            path.append((run[:place - start], run[place - start + 1:]))
            place //= fanout
        paths.append(path)
    return levels[-1][0], paths


def plain(rows, fanout=8):
    rows = [dict(r.asDict()) for r in rows]
    for r in rows:
        r["leaf"] = leaf(r, r["text"])
    rows.sort(key=lambda r: (r["lang"] is not None, (r["lang"] or "").encode(), r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"]))
    groups = [list(g) for _, g in groupby(rows, key=lambda r: r["lang"])]
    trees = [climb([r["leaf"] for r in g], fanout) for g in groups]
    if not trees:
        return []
    root, above = climb([t[0] for t in trees], fanout)
    out = []
    for g, (subroot, paths), rest in zip(groups, trees, above):
        for r, path in zip(g, paths):
            whole = path + rest
            text, i = r["text"], r["doc_id"]
            if text is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0:
                text = text.translate({c: c + 32 for c in range(65, 91)})
            f = leaf(r, text)
            for left, right in whole:
                f = H(*left, f, *right)
            proof = H(*[d for left, right in whole for d in left + right])
            out.append((i, r["leaf"], subroot, root, proof, f, f == root))
    return sorted(out, key=repr)


def got(docs, fanout=8):
    return collected(merkle.manifest(docs, fanout).drop("lang", "path"))


def made(n, lang):
    return [(k, f"Text {k}", lang(k), "s", k) for k in range(n)]


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 130])
def test_sizes_around_the_fanout(spark, n):
    docs = spark.createDataFrame(made(n, lambda k: "en"), SCHEMA).repartition(3)
    assert got(docs) == plain(docs.collect())


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_groups_of_all_sizes(spark, fanout):
    """A hot group, small ones, lone leaves, more groups than the fanout, null and empty langs."""
    langs = [None, "", "é", "z", "Z", *[f"l{k}" for k in range(8)]]
    rows = made(100, lambda k: "en" if k % 3 else langs[k % len(langs)])
    rows += [(None, "No id", "en", None, None), (None, None, None, None, None), (5, "Text 5", "en", "s", 5),
             (5, "Text 5", "en", "s", 5), (6, "", "zz", "", -1), (7, "İßſ " * 3000 + "Q", "zz", "a:b", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(docs, fanout) == plain(docs.collect(), fanout)


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert got(docs) == plain(docs.collect())
    assert got(none(spark)) == []


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain(docs.collect())
    assert got(docs) == want
    assert {r[6] for r in want} == {True, False}


def test_any_change_breaks_the_proof(spark):
    docs = spark.createDataFrame(made(30, lambda k: f"l{k % 3}"), SCHEMA)
    rows = merkle.manifest(docs)
    folded = rows.select("root", merkle.fold(F.concat(F.substring("leaf", 1, 63), F.lit("_")), "path").alias("f"))
    assert folded.where("f = root").count() == 0
    other = rows.select("root", merkle.fold(F.col("leaf"), F.reverse("path").alias("p")).alias("f"))
    assert other.where("f = root").count() < 30
