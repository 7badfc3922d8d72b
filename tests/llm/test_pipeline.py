import corpus_pipeline
from tests.llm.samples import SF
from tests.llm.test_decontamination import plain as leaks
from tests.llm.test_jaccard import plain as components
from tests.llm.test_secrets import plain as found_secrets

from firmweave.llm import mixing, quality


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination",
                     "secret scans", "mixing sources to target weights"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert after.columns == columns
        if k == 0:
            want = sorted(r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect())
            assert ids(after) == want and len(want) < len(before)
        elif k == 1:
            assert ids(after) == sorted(d for d, _, c in components(before) if d == c)
        elif k == 2:
            assert ids(after) == sorted({d for d, _ in before} - {d for d, _ in leaks(before, bench, by_length=True)})
        elif k == 3:
            texts = {r.doc_id: r.text for r in after.select("doc_id", "text").collect()}
            assert sorted(texts) == sorted(d for d, _ in before)
            for d, t in before:
                assert (texts[d] == t) == (not any(found_secrets(t)[0][:3])) or texts[d] != t
                assert not any(found_secrets(texts[d])[0][:3])
        else:
            copies = {r.doc_id: r.copies for r in mixing.mix_report(docs).collect()}
            assert ids(after) == sorted(d for d, n in copies.items() for _ in range(n))
        docs = after


def test_run_is_its_stages(spark):
    first = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert first == sorted(map(tuple, docs.collect()))


def test_empty_and_awkward_documents(spark):
    from tests.llm.samples import awkward, none

    for docs in (none(spark), awkward(spark)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert docs.columns == columns
        docs.count()
