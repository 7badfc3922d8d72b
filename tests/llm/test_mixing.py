import hashlib
import re
from fractions import Fraction

from pyspark.sql import functions as F

from firmweave.llm import mixing
from tests.llm.samples import SF, awkward, none


def filled(sizes: dict) -> dict:
    """Targets by sharing again and again until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, held = Fraction(sum(sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in held]
        left = total - sum(held.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return {**held, **share}
        held |= {s: Fraction(3 * sizes[s]) for s in over}


def check(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes: dict = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    targets = filled(sizes)
    want = []
    for r in rows:
        n, t = sizes[r.source], targets[r.source]
        rate = min(float(t) / n, 3.0) if n else 0.0
        key = "" if r.doc_id is None else str(r.doc_id)
        draw = int(hashlib.md5(f"mix-1:{key}".encode()).hexdigest()[:13], 16) / 2**52
        copies = int(rate) + (draw < rate - int(rate))
        want.append((r.doc_id, size(r.text), n, round(float(t), 6), copies * size(r.text), copies))
    got = [(*r[:3], round(r[3], 6), *r[4:]) for r in mixing.mix_report(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_against_plain_water_filling(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_awkward_rows(spark):
    check(awkward(spark, [(20 + k, "w " * (k % 9 + 1), f"s{k % 4}") for k in range(60)]))


def test_mix_repeats_whole_rows(spark):
    docs = awkward(spark)
    report = mixing.mix_report(docs)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == report.agg(F.sum("copies")).first()[0]
    assert mixing.mix(none(spark)).count() == 0


def test_taken_near_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    report = mixing.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id")
    rows = report.groupBy("source", "target").agg(F.sum("taken").alias("t")).collect()
    assert len(rows) == 20
    assert all(abs(r.t - r.target) < 0.2 * r.target for r in rows)
    assert abs(sum(r.t for r in rows) / sum(r.target for r in rows) - 1) < 0.03
