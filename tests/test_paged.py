"""Paged datasets."""

import json
import random

import pytest

from cartoloom.sources import paged


def test_saved_pages_and_what_they_lack(spark):
    page = lambda dataset, offset, total, items, fetched=None: (json.dumps({"dataset": dataset, "offset": offset, "total": total, "fetched": fetched, "items": [{"id": x} for x in items]}),)
    rows = [page("a", 0, 10, [0, 1, 2]), page("a", 2, 10, [22, 3]), page("a", 6, 10, [6]), page("b", 0, 2, [5, 6]), page("b", 0, 2, [7, 8], 9), page("c", 3, 5, [1, 2]), ("broken",), (None,), page("d", 0, 0, [])]
    pages = spark.createDataFrame(rows, "body string").repartition(4)
    got = sorted((r.dataset, r.n, r.id) for r in paged.page_rows(pages, "id long").collect())
    assert got == [("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("a", 6, 6), ("b", 0, 7), ("b", 1, 8), ("c", 3, 1), ("c", 4, 2)]
    assert sorted(map(tuple, paged.missing_ranges(pages).collect())) == [("a", 4, 6), ("a", 7, 10), ("c", 0, 3)]


@pytest.mark.parametrize("page, of_range", [(7, 2), (100, 1), (1, 5)])
def test_ranges_of_pages_are_read_in_partitions(spark, tmp_path, page, of_range):
    rng = random.Random(1)
    items = [{"id": k, "text": "x" * rng.randrange(4), "other": 1} for k in range(53)]
    (tmp_path / "items").write_text("\n".join(map(json.dumps, items)))
    paged.register(spark)
    read = lambda total, **more: spark.read.format("paged").schema("text string, id long, none int").options(fetch="cartoloom.sources.paged:replay", key=str(tmp_path / "items"), total=total, page=page, range=of_range, wait="0", **more).load()
    got = read(53)
    assert sorted((r.id, r.text, r.none) for r in got.collect()) == [(x["id"], x["text"], None) for x in items]
    assert got.rdd.getNumPartitions() == -(-53 // (page * of_range)) and read(0).count() == 0 and read(60).count() == 53
    with pytest.raises(Exception):
        spark.read.format("paged").schema("id long").options(fetch="cartoloom.sources.paged:replay", key="/no/such/file", total=5, wait="0").load().collect()
