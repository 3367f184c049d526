"""Every query of the operators, and the pipeline, on awkward and on empty tables."""

import hashlib

import pytest

import corpus_pipeline
from cairn.llm import byte_bpe, decontaminate, simhash_dedup, toxicity
from cairn.llm.queries import QUERIES

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SHARED = "one line that many of the documents share with each other\n"
ITEM = " ".join(f"item{k}" for k in range(20))


def texts():
    long = "a very long text goes on and on " * 3000
    plain = [f"{SHARED if i % 3 == 0 else ''}document number {i} tells of rivers{i}, stones{i} and trees{i} that nobody{i} else has seen{i}" + (" vile" if i % 5 == 1 else "") for i in range(40)]
    near = " ".join(f"word{k} tale{k}" for k in range(150))
    return [None, "", " \n\t", "x", long, near, near.replace("word40 ", "other40 "), near, "before " + ITEM.upper() + " after", *plain]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = [(i, t, None, "s", None if t is None else len(t)) for i, t in enumerate(texts())]
    rows += [rows[9], (None, "no id here", None, None, 1), (None, None, None, None, None)]
    other = [("a.com/en/x", 1), (None, 2), ("no scheme", 3), ("http://" + "a" * 5000 + ".com/" + "b/" * 2000, 4), ("http://example.com/en/7", 5), ("http://example.com/en/7", 5), ("http://q.org/", None)]
    vectors = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(120)] + [(50, [1.0, 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (200, None), (250, [0.0, 0.0, 0.0])]
    found = {}
    for name in ("full", "empty"):
        path = str(tmp_path_factory.mktemp(name))
        for table, data, kind in (
            ("documents", rows, DOCUMENTS), ("labels", [(i, 1, int(i % 5 == 4)) for i in range(9, 49)] + [(None, None, 1)], "doc_id long, quality int, toxic int"), ("benchmark", [(1, ITEM), (None, None), (2, "")], "item_id long, text string"),
            ("pages", [(i, u, "<p>", "clash") for u, i in other], "page_id long, url string, html string, host string"), ("embeddings", vectors, "vec_id long, embedding array<float>"),
        ):
            spark.createDataFrame(data if name == "full" else [], kind).write.parquet(f"{path}/{table}.parquet")
        found[name] = path
    return found


ROWS = {"op1_toxicity": 52, "op2_simhash": 52, "op4_url_filter": 7, "op6_token_counts": 52, "op8_byte_bpe": 52, "op9_line_dedup": 52, "op10_lm_scoring": 52, "op3_decontamination": 1, "op7_license_scan": 0}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_awkward_and_empty_tables(spark, tables, name):
    got = QUERIES[name](spark, tables["full"]).collect()
    if name in ROWS:
        assert len(got) == ROWS[name]
    if name == "op5_ann":
        assert {r.query_id for r in got} == {0, 50, 100} and all(r.query_id != r.vec_id for r in got)
    if name == "op6_token_counts":
        size = {r.doc_id: r for r in got}
        assert size[4].n_bytes == len(texts()[4].encode()) and size[4].over_limit and not size[3].over_limit and size[0].n_bytes == size[0].n_tokens == 0
    if name == "op10_lm_scoring":
        assert all(r.score < 0 and r.n_known <= r.n_tokens for r in got) and len({round(r.score, 3) for r in got if r.doc_id == 9}) == 1
    assert QUERIES[name](spark, tables["empty"]).count() == 0


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(tables["full"] + "/documents.parquet")
    found, counts = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, found, tables["full"])
        if name != "byte_bpe":
            assert found.columns == docs.columns
        found = spark.createDataFrame(found.collect(), found.schema)
        counts[name] = {r.doc_id for r in found.collect()}
    assert 8 in counts["simhash_near_dedup"] and 8 not in counts["decontamination"]
    assert counts["line_dedup"] == counts["toxicity"] and {5, 7} & counts["simhash_near_dedup"] == {5}
    own = {r.doc_id: r for r in found.collect()}
    assert own[3].n_tokens == 1 and own[3].decoded_sha256 == hashlib.sha256(b"x").hexdigest()


def test_run_on_tables(spark, tables):
    got = {r.doc_id for r in corpus_pipeline.run(spark, tables["full"]).collect()}
    assert 5 in got and 7 not in got and 8 not in got and None in got
    assert corpus_pipeline.run(spark, tables["empty"]).count() == 0


def test_filters_on_rows_without_ids(spark, tables):
    docs = spark.read.parquet(tables["full"] + "/documents.parquet")
    assert simhash_dedup.keep_one_of_each_group(docs).where("doc_id is null").count() == 2
    bench = spark.read.parquet(tables["full"] + "/benchmark.parquet")
    assert decontaminate.drop_contaminated(docs, bench).count() == docs.count() - 1
    kept = toxicity.reject_toxic(docs, toxicity.fit(docs, spark.read.parquet(tables["full"] + "/labels.parquet")))
    assert kept.where("doc_id is null").count() == 2 and kept.columns == docs.columns
    unlearnt = toxicity.fit(docs, spark.read.parquet(tables["empty"] + "/labels.parquet"))
    assert toxicity.reject_toxic(docs, unlearnt).count() == docs.count()
    assert byte_bpe.encode_texts(docs.limit(0), ids=True).count() == 0
