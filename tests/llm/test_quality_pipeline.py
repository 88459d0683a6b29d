"""The classifier on held-out rows, and the pipeline end to end."""

import brute
import pytest
from pyspark.sql import functions as F

from regioscope.llm import co_training
from regioscope.llm.queries import table, vocabulary

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    """Labels of a third of the ids are kept from the fit."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    out = co_training.add_scores(docs, labels.where(~apart))
    assert out.count() == docs.count() and out.columns[:len(docs.columns)] == docs.columns
    rows = out.join(labels.where(apart), "doc_id").select(
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"), "kept", "toxic").collect()
    clean = [r["kept"] for r in rows if r["good"]]
    junk = [r["kept"] for r in rows if not r["good"] and not r["toxic"]]
    assert sum(clean) >= 0.9 * len(clean) and sum(junk) <= 0.2 * len(junk)


def test_too_few_labels_keep_everything(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (2, 1, 0), (None, 1, 1), (3, None, None)],
                                   "doc_id long, quality int, toxic int")
    out = co_training.add_scores(documents, labels)
    assert out.where("kept and score is null").count() == documents.count()
    assert co_training.keep_good(documents, labels).columns == documents.columns
    assert co_training.add_scores(documents.limit(0), labels).collect() == []


def test_hostile_rows_are_scored(spark, documents, texts):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = co_training.fit(docs, labels)
    out = model.add_scores(documents.drop("score", "kept"))
    assert out.count() == len(texts) and out.where("score is null or isnan(score)").count() == 0


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline
    folder = tmp_path_factory.mktemp("stages")
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        stage(spark, given, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out[name] = (given, docs)
    return out


def test_stage_names_and_columns(spark, stages):
    assert list(stages) == ["quality", "lines", "near_duplicates", "decontaminate", "encode"]
    plain = table(spark, SF, "documents").columns
    assert all(given.columns == plain for given, _ in stages.values())
    assert stages["encode"][1].columns == ["doc_id", "ids"]


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_lines_stage(stages):
    given, got = stages["lines"]
    assert texts_of(got).keys() == texts_of(given).keys()
    small = given.where("doc_id < 150")
    from regioscope.llm import line_dedup
    assert texts_of(line_dedup.dedup_lines(small)) == brute.deduped_lines(texts_of(small))
    assert sum(map(len, texts_of(got).values())) < sum(map(len, texts_of(given).values()))


def test_near_duplicates_stage(stages):
    given, got = (texts_of(df) for df in stages["near_duplicates"])
    want = brute.near_documents(given)
    assert set(got) == {d for d, (_, _, kept) in want.items() if kept}
    assert all(got[d] == given[d] for d in got)


def test_decontaminate_stage(spark, stages):
    given, got = (texts_of(df) for df in stages["decontaminate"])
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    hits = brute.benchmark_hits(given.items(), items)
    assert set(got) == {d for d, (n, h, _) in hits.items() if not (h and 20 * h >= n)}


def test_encode_stage(stages):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(vocabulary())
    given, got = stages["encode"]
    want = texts_of(given)
    for r in got.collect():
        assert r["ids"] == lib.encode(want[r["doc_id"]] or "", add_special_tokens=False).ids


def test_stages_on_hostile_rows_and_on_none(spark, tmp_path):
    """Null ids and texts, repeated rows, no rows: defined results."""
    import corpus_pipeline
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(None, long, "en", None, 1), (None, None, None, "s", None), (1, long, "en", "s", 1), (1, long, "en", "s", 1),
            (2, long + " more", None, "s", 2), (3, "", "en", "s", 0), (4, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    got = sorted(map(tuple, stages["near_duplicates"](spark, docs, SF).collect()), key=str)
    assert got == sorted((r for r in rows if r[0] != 2), key=str)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), SF).write.parquet(str(tmp_path / name))
        assert spark.read.parquet(str(tmp_path / name)).count() == 0
    assert stages["lines"](spark, docs, SF).count() == stages["decontaminate"](spark, docs, SF).count() == len(rows)
    assert stages["encode"](spark, docs, SF).count() == len(rows)


def test_registered_queries(spark):
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names
