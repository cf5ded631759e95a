"""The stages on a small table, each held against a plain version of its decision."""

import re
from pathlib import Path

import pytest

import corpus_pipeline as pipeline
from graphloom.llm import catalog, decontaminate, mixing, near_copies, quality
from graphloom.llm.common import stored, table

from .test_decontaminate import brute as leaks
from .test_near_copies import brute as copies

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test data not present")


@pytest.fixture(scope="module")
def net(spark):
    """Trained once for all stages and tests."""
    return quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))


@pytest.fixture(scope="module")
def steps(spark, net):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "train", lambda *_: net)
        out = [table(spark, SF, "documents")]
        for name, stage in pipeline.STAGES:
            out.append(stored(stage(spark, out[-1], SF), name))
        yield out


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_names_and_columns(steps):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_copies", "decontamination", "personal_data", "mixing"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert all(a.dtypes == steps[0].dtypes for a in steps[:-1])


def test_quality_keeps_what_the_network_accepts(spark, net, steps):
    want = [(i, t) for i, t in texts(steps[0]) if net.probability((t or "").encode()) >= 0.5]
    assert texts(steps[1]) == want and len(want) < steps[0].count()
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {i for i, _ in want}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)


def test_one_document_of_each_group_of_near_copies_stays(steps):
    rows = texts(steps[1])
    assert [i for i, _ in texts(steps[2])] == sorted({c for _, c, _ in copies(rows)})


def test_documents_with_benchmark_items_go(spark, steps):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {i for i, *_ in leaks(texts(steps[2]), items)}
    assert [i for i, _ in texts(steps[3])] == [i for i, _ in texts(steps[2]) if i not in bad]


def test_personal_data_is_gone_and_the_rest_is_untouched(steps):
    before, after = dict(texts(steps[3])), dict(texts(steps[4]))
    assert before.keys() == after.keys()
    for i, text in after.items():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text or "")
        if not re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", text or ""):
            assert text == before[i]
    assert all(r.n_chars == len(r.text) for r in steps[4].collect())


def test_rates_cover_all_documents(steps):
    rows = steps[5].collect()
    assert {r.doc_id for r in rows} == set(dict(texts(steps[4]))) and all(r.rate >= 0 for r in rows)


def test_registry():
    names = [n for n in catalog.QUERIES if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11)) and "pipeline" in catalog.QUERIES
    assert pipeline.ORACLE_SQL is None and mixing.TARGETS and decontaminate.SIMILARITY == near_copies.SIMILARITY == 0.8


def test_empty_documents(spark, steps):
    docs = steps[0].limit(0)
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"empty-{name}")
        assert docs.count() == 0
