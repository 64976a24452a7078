import hashlib
from collections import Counter

import corpus_pipeline
from gneiss.llm import quality, simhash
from gneiss.llm.common import table
from tests.llm.fixtures import texts
from tests.llm.test_operators import contaminated, removed, unlike


def test_stages_one_by_one(spark, data, tmp_path):
    """Each stage against a brute-force version of its decision, on its own input."""
    docs = table(spark, data, "documents")
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append({r["doc_id"]: r for r in docs.collect()})
        docs = stage(spark, docs, data)
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
    good = {r["doc_id"] for r in quality.query(spark, data).where("predicted = 1").collect()}
    assert set(seen[1]) == good
    first = spark.read.parquet(str(tmp_path / "0"))
    one = {r["component_id"] for r in simhash.near_duplicates(first).collect()}
    assert set(seen[2]) == unlike([(i, seen[1][i]["text"]) for i in one])
    want = {i: (n, h) for (i, _, n, h) in removed([(i, r["text"]) for i, r in seen[2].items()])}
    for i, r in seen[3].items():
        assert hashlib.sha256(" ".join((r["text"] or "").encode().split() and [x.decode() for x in r["text"].encode().split()]).encode()).hexdigest() == want[i][1]
        assert r["n_chars"] == len(r["text"])
        assert want[i][0] or r["text"] == seen[2][i]["text"]
    items = [(r["item_id"], r["text"]) for r in table(spark, data, "benchmark").collect()]
    hit = {c[0] for c in contaminated([(i, r["text"]) for i, r in seen[3].items()], items) if c[3] >= 1}
    assert set(seen[4]) == set(seen[3]) - hit
    assert {r["doc_id"] for r in docs.collect()} == set(seen[4])


def test_run_is_the_stages(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "best-fit packing"]
    assert corpus_pipeline.run(spark, data).count() > 100


def awkward(spark, rows):
    """With columns that are named like what the stages use inside."""
    ddl = "doc_id long, text string, `quality score` double, `hash of the text` string, n_chars int, chunk int, bucket string, score double, `part` int, `x to find` int"
    return spark.createDataFrame([(i, t, -1.0, "h", None if t is None else len(t), 5, "b", 2.0, 3, 4) for i, t in rows], ddl)


def test_stages_on_awkward_rows(spark, data):
    docs = awkward(spark, texts())
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        assert stage(spark, docs.where("false"), data).count() == 0
        if i == 4:
            assert {r["doc_id"] for r in out.collect()} == {i for i, _ in texts()}
            continue
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = out.collect()
        assert all((r["quality score"], r["hash of the text"], r["chunk"], r["bucket"], r["score"], r["part"], r["x to find"]) == (-1.0, "h", 5, "b", 2.0, 3, 4) for r in got)
        ids = [r["doc_id"] for r in got]
        if i == 1:  # of all texts without words the smallest id stays, of like rows one
            assert len(ids) == len(set(ids)) and 1 in ids and not {2, 3, 7, None} & set(ids) and 0 in ids
        if i == 2:
            kept = lambda t: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest()
            assert Counter((r["doc_id"], kept(r["text"])) for r in got) == Counter((w[0], w[3]) for w in removed(texts()).elements())
        if i == 3:
            assert {1, 2, 3, None} <= set(ids)


def test_a_pipeline_of_an_empty_table(spark, data, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        t = table(spark, data, name)
        (t.where("false") if name == "documents" else t).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
