"""Columns of the documents may have any name, those of helper columns too."""

import pytest

from strataline.llm import decontaminate as D
from strataline.llm import jaccard as J
from strataline.llm import repeats as R

NAMES = ["_id", "_h", "_n", "_row", "_spans", "_cut_id", "_cut_h", "_cut_n", "_cut_base", "_cut_starts", "_cut_ends", "c0", "row", "first", "node", "doc id"]
LONG = " ".join(f"w{k}" for k in range(60))
ROWS = [(1, LONG), (2, LONG), (2, LONG), (3, "other words entirely here"), (4, None), (None, LONG), (5, "x " + LONG + " and a good deal more " + " ".join(f"z{k}" for k in range(200)))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"x{k}", k, *r, *(f"{n}{k}" for n in NAMES)) for k, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "own string, number int, doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


def checked(found, docs):
    assert found.schema.names == docs.schema.names and [t for _, t in found.dtypes] == [t for _, t in docs.dtypes]
    rows = found.collect()
    for r in rows:
        assert r["own"] == f"x{r['number']}" and all(r[n] == f"{n}{r['number']}" for n in NAMES)
    return sorted(r["number"] for r in rows)


def test_representatives(docs):
    assert checked(J.keep_representatives(docs), docs) == [0, 3, 4, 5, 6]


def test_repeats(docs):
    assert checked(R.cut_repeats(docs), docs) == [0, 3, 4, 5, 6]


@pytest.mark.parametrize("block", [D.BENCHMARK_BYTES, 200])
def test_benchmark_in_one_block_and_in_several(spark, docs, monkeypatch, block):
    monkeypatch.setattr(D, "BENCHMARK_BYTES", block)
    items = spark.createDataFrame([(1, LONG), (2, " ".join(f"q{k}" for k in range(50)))], "item_id long, text string")
    assert checked(D.drop_contaminated(docs, items), docs) == [3, 4]
    assert checked(D.remove_spans(docs, items), docs) == list(range(7))
