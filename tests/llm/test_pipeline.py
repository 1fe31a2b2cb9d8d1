"""The pipeline, each stage against a plain version on what the stage before kept."""

from collections import Counter

import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from tallymark.llm import queries
from tallymark.llm.toxicity import score_toxicity
from test_text_operators import plain_components, plain_fingerprint, plain_ids, plain_line_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) of every stage, written and read again as the pipeline does."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        found[name] = (before, docs)
    return found


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert list(stages) == ["toxicity", "line_dedup", "simhash_dedup", "mixing", "packing"]
    for name, (before, after) in stages.items():
        assert name == "packing" or after.dtypes == before.dtypes


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r["row"]["doc_id"]: r["score"] for r in score_toxicity(before, labels).collect()}
    assert rows_of(after).keys() == {i for i, s in scores.items() if s < 0.7}
    assert len(scores) == before.count()


def test_shared_lines_go(stages):
    before, after = stages["line_dedup"]
    plain = {i: kept for i, _, _, kept in plain_line_dedup([(r["doc_id"], r["text"]) for r in before.collect()])}
    found = rows_of(after)
    assert {i: r["text"] for i, r in found.items()} == plain
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_one_of_each_group_stays(stages):
    before, after = stages["simhash_dedup"]
    texts = {i: r["text"] for i, r in rows_of(before).items()}
    component = plain_components(list(texts), [plain_fingerprint(t) for t in texts.values()])
    assert Counter(r["doc_id"] for r in after.collect()) == Counter({i for i, c in component.items() if i == c})


def test_mixing_keeps_all_and_repeats_within_the_limit(stages):
    before, after = stages["mixing"]
    drawn = Counter(after.collect())
    assert set(drawn) == set(before.collect()) and max(drawn.values()) <= 2


def test_packed_ids_are_those_of_the_documents(stages):
    before, after = stages["packing"]
    docs = before.collect()
    expected = Counter(zip((r["doc_id"] for r in docs), plain_ids([r["text"] for r in docs])))
    whole, parts = Counter(), {}
    for r in after.collect():
        if r["length"] == r["doc_tokens"]:
            whole[(r["doc_id"], bytes(r["ids"]))] += 1
        else:
            parts.setdefault((r["doc_id"], r["start"]), []).append(bytes(r["ids"]))
    for (doc_id, ids), times in expected.items():
        if (doc_id, ids) in whole:
            assert whole[(doc_id, ids)] == times
        else:
            starts = sorted(s for i, s in parts if i == doc_id)
            assert b"".join(parts[(doc_id, s)][0] for s in starts) == ids
            assert all(len(parts[(doc_id, s)]) == times for s in starts)


def test_run_and_registration(spark, stages):
    assert entry_module.queries()["pipeline"] is corpus_pipeline.run
    assert ("pipeline" in entry_module.oracle_sql()) == bool(corpus_pipeline.ORACLE_SQL)
    tokens = corpus_pipeline.run(spark, SF).selectExpr("sum(length) AS n").first()["n"]
    assert tokens == stages["packing"][1].selectExpr("sum(length) AS n").first()["n"]


def test_empty_and_null_documents(spark):
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "a line of some words", "en", "a", 1), (3, "a line of some words", "en", "b", 1)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert (docs.count() > 0) == bool(rows)


def test_the_rest_does_not_need_it():
    import ast
    import pathlib

    root = pathlib.Path(entry_module.__file__).parent
    for file in [*root.glob("tallymark/**/*.py"), *root.glob("workload/*.py")]:
        if "llm" in file.parts:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [a.name for a in node.names] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
            module = getattr(node, "module", None) or ""
            imported = [part for name in [module, *names] for part in name.split(".")]
            assert "llm" not in imported and "corpus_pipeline" not in imported, (file, node.lineno)
    assert queries.tokenizer_path().endswith(".json")


def test_rows_that_share_an_id_keep_their_texts(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(3, one, "en", "a", 1), (5, one, "en", "a", 1), (5, other, "en", "a", 1), (5, other, "en", "b", 1), (9, other, "en", "a", 1), (None, one, "en", "a", 1)]
    left = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter([(3, one), (5, other), (None, one)])
