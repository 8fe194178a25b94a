"""The pipeline's stages, each held against brute force on its own input."""

import corpus_pipeline as cp
import pytest
from tests.llm.test_corpus_operators import brute_components, corpus
from tests.llm.helpers import docs_of  # noqa: F401
from tidemark.llm import catalog, packing, secrets
from tidemark.llm.common import stage

LONG = " ".join(f"clean{k} words" for k in range(60))


@pytest.fixture(scope="module")
def steps(spark, docs_of):
    rows = [*corpus(), (1, None), (2, "short"), (3, LONG), (3, LONG), (None, LONG + " x"),
            (5, " ".join(f"pass{k} token" for k in range(60)) + " password=hunter2hunter"), (6, " ".join(f"j{k}### $$" for k in range(99)))]
    docs, out = docs_of(rows), [docs_of(rows)]
    for name, f in cp.STAGES:
        docs = stage(f(spark, docs, ""), f"test-{name}")
        out.append(docs)
    return out


def test_stages_in_order_and_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "mixing", "packing"]
    for df in steps[1:5]:
        assert df.columns == cp.COLUMNS
    assert set(catalog.QUERIES) >= {"pipeline"} and sum(n.startswith("op") for n in catalog.QUERIES) == 13


def test_quality_stage_drops_only_rejected(steps):
    ids = {r.doc_id for r in steps[1].collect()}
    assert not ids & {1, 2, 6} and {3, 5, None} <= ids


def test_one_document_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    want = brute_components(rows, 5, 80)
    got = [r.doc_id for r in steps[2].collect()]
    assert sorted(i for i in got if i is not None) == sorted({c for _, c in want.values()}) and got.count(None) == 1


def test_secrets_are_replaced(steps):
    before, after = ({r.doc_id: r for r in df.collect()} for df in steps[2:4])
    assert {i: secrets.redact(r.text) for i, r in before.items()} == {i: r.text for i, r in after.items()}
    assert "hunter2" not in after[5].text and all(r.n_chars == len(r.text) for r in after.values())


def test_mixing_samples_and_packing_takes_all(steps):
    kept = [r.doc_id for r in steps[4].collect()]
    assert 0 < len(kept) < steps[3].count()
    pieces = steps[5].collect()
    assert sorted({str(r.doc_id) for r in pieces}) == sorted(map(str, kept))
    code = packing.TokenBytes(packing.vocabulary_path())
    for r in steps[4].collect():
        assert sum(p.length for p in pieces if p.doc_id == r.doc_id) == len(code.encode(r.text)) // 4 + 1


def test_no_text_vanishes_with_its_doc_id(spark, docs_of):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(2, a), (5, a), (5, b), (5, b), (7, b.replace("b59", "changed")), (9, c), (None, a), (None, a), (8, ""), (8, "")]
    kept = cp.near_dedup(spark, docs_of(rows), "")
    assert kept.columns == cp.COLUMNS
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(2, a), (5, b), (9, c), (0, a), (0, a), (8, ""), (8, "")])
    assert cp.near_dedup(spark, docs_of(rows).where("false"), "").count() == 0
