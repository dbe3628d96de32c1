"""The pipeline and its stages, each on its own input, against plain Python."""

import pyarrow as pa
import pytest

import corpus_pipeline as P
from recollex.llm import bpe, common, mixing, neardup, pii, toxicity

D = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").cache()
    columns = docs.columns
    labels = spark.read.parquet(f"{D}/labels.parquet")
    clean = P.toxicity(spark, docs, D).cache()
    assert clean.columns == columns
    net = toxicity.fitted(docs, labels)
    assert clean.count() == toxicity.score(docs, net).where("predicted = 0").count() < docs.count()
    single = P.near_duplicates(spark, clean, D).cache()
    assert single.columns == columns
    kept = {r.doc_id for r in neardup.near_duplicates(clean).where("kept").collect()}
    assert {r.doc_id for r in single.collect()} == kept
    hidden = P.personal_data(spark, single, D).cache()
    before = {r.doc_id: r.text for r in single.collect()}
    assert hidden.columns == columns
    assert all(r.text == pii.redacted(before[r.doc_id]) and r.n_chars == len(r.text) for r in hidden.collect())
    mixed = P.mixture(spark, hidden, D).cache()
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= kept
    taken = {r.doc_id: r.taken for r in mixing.mix(hidden).collect()}
    assert all(taken[r.doc_id] > 0 or not r.text.strip() for r in mixed.collect())
    out = P.tokens(spark, mixed, D)
    t = bpe.tokenizer(bpe.default_path())
    assert out.count() == mixed.count() and all(r.decoded == t.decode(r.ids) for r in out.limit(50).collect())


def test_near_duplicates_keep_one_row_of_a_doc_id(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "en", "a", 5)] * 4 + [(2, text, "en", "b", 5)] * 2 + [(3, "quite another text", None, None, None)] * 3 + [(4, "one", "en", "a", 3), (4, "two", "en", "a", 3)] + [(None, text, None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in P.near_duplicates(spark, docs, D).collect()]
    assert sorted(got, key=str) == [1, 3, 4, None, None]


def test_run(spark):
    before = set(common._open)
    rows = P.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and rows.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    left = set(common._open) - before
    assert len(left) == 1 and all("mixture" in x for x in left)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, rows in (("none", []), ("odd", [(1, None, None, None, None), (None, "a b c", None, None, None), (2, "", "x", "y", 0), (2, "", "x", "y", 0)])):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in P.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() >= 0, name


@pytest.mark.parametrize("stage", ["toxicity", "personal_data", "tokens"])
def test_stages_that_end_in_python_send_few_texts_at_a_time(spark, stage):
    """Ten thousand texts in a batch, on both sides of the pipe, took an executor over its memory."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = spark.conf.get(rows)
    try:
        for held, want in (("10000", common.BATCH_ROWS), ("0", common.BATCH_ROWS), ("200", 200)):
            spark.conf.set(rows, held)
            dict(P.STAGES)[stage](spark, docs, "/root/testdata/sf0.001")
            assert int(spark.conf.get(rows)) == want
    finally:
        spark.conf.set(rows, before)


def test_a_worker_keeps_the_vocabulary_only(monkeypatch):
    """What a task had worked out on tokens stayed in each waiting worker, and the edges of tokens had no bound."""
    monkeypatch.setattr(bpe, "EDGES", 50)
    e = bpe.Encoder(bpe.default_path())
    e.learn({"".join(chr(97 + i * k % 26) for k in range(1, 9)) for i in range(26)})
    t = e.tokenizer
    assert t._next and t._beside and 0 < len(t._left) <= 50 and 0 < len(t._right) <= 50
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words, and others"])], ["doc_id", "text"])
    for _ in bpe._encoded(bpe.default_path(), False, iter([batch])):
        assert t._next
    assert not (t._next or t._beside or t._left or t._right or t._whole)
