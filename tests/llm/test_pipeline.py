import __spark_entry__ as entry
import corpus_pipeline
import pytest
from compare import connect, difference
from eventwatch.llm import decontaminate, oracles, queries, toxicity

import brute

SF = "/root/testdata/sf0.001"
ORACLES = oracles.ORACLES


def test_registry():
    names = set(entry.queries())
    assert set(queries.queries()) <= names and {f"op{n}_" for n in range(1, 11)} <= {q[:q.index("_") + 1] for q in names if q.startswith("op")}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert difference(queries.queries()[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece"]
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    kept = steps["toxicity"](spark, docs, SF)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    assert set(rows(kept)) == set(rows(docs)) - bad and kept.columns == docs.columns

    before, cut = rows(docs), steps["line_dedup"](spark, docs, SF)
    gone = brute.removed_lines(list(before.items()))
    assert rows(cut) == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in before.items()}
    assert cut.columns == docs.columns and all(r.n_chars == len(r.text) for r in cut.collect())

    single = steps["ngram_jaccard_join"](spark, docs, SF)
    assert set(rows(single)) == {d for d, (n, c) in brute.components(list(before.items()), 5, 80).items() if n == 0 or c == d}

    clean = steps["benchmark_decontamination"](spark, docs, SF)
    found = {r.doc_id for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(rows(clean)) == set(before) - found and clean.columns == docs.columns

    tokens = steps["sentencepiece"](spark, docs, SF)
    assert tokens.count() == docs.count() and tokens.filter("not same").isEmpty()
