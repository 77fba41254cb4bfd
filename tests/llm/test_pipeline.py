"""The pipeline and the registered queries on the given tables."""

import pytest

import corpus_pipeline
from tessera.llm import decontaminate, exact_dedup, langid, mixing, registry, simhash
from tools.oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, sf_dir, name):
    result = compare(spark, duck(sf_dir), name, registry.QUERIES[name], registry.ORACLES[name], sf_dir)
    assert result["status"] == "match", result


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"pipeline"}))
def test_query_returns_every_row(spark, sf_dir, name):
    table = "pages" if name.startswith("op2_") else "documents"
    assert registry.QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, None
    checks = {
        "language_id": lambda d: langid.language_of(d).where("lang_pred = 'und'"),
        "exact_dedup": lambda d: exact_dedup.exact_duplicates(d).where("NOT kept"),
        "simhash_near_dedup": lambda d: simhash.near_duplicates(d).where("doc_id != component_id"),
        "benchmark_decontamination": lambda d: decontaminate.contamination(
            d, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        gone = checks[name](docs).select("doc_id").distinct()
        want = docs.join(gone, "doc_id", "left_anti").count()
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and docs.count() == want
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert mixed.columns == mixing.mix_to_weights(docs).columns and mixed.count() == docs.count()
    before = sorted(map(tuple, mixed.collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == before


def test_empty_documents_run_through(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_null_and_repeated_ids_keep_their_clean_documents(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    a, b, leak = " ".join(words[:60]), " ".join(words[60:120]), " ".join(words[120:180])
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")

    def left(stage, *rows):
        frame = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
        return sorted((r["doc_id"] or 0, r["text"]) for r in stage(frame).collect())

    profile = (1, a)
    assert left(langid.keep_identified, profile, (None, b), (None, "12 34"), (7, b), (7, "..."), (None, None)) == [
        (0, b), (1, a), (7, b)]
    assert left(exact_dedup.keep_one_copy, (None, a), (None, b), (7, a), (7, leak)) == [(0, b), (7, a), (7, leak)]
    assert left(simhash.keep_one_of_group, (1, a), (None, a), (None, b), (1, leak)) == [(0, b), (1, a), (1, leak)]
    assert left(simhash.keep_one_of_group, (None, a), (None, a.upper()), (None, a)) in ([(0, a)], [(0, a.upper())])
    assert left(simhash.keep_one_of_group, (3, b), (3, b), (3, b.upper())) in ([(3, b)], [(3, b.upper())])
    assert left(lambda d: decontaminate.keep_clean(d, bench), (None, a), (None, leak), (7, b), (7, leak)) == [
        (0, a), (7, b)]
