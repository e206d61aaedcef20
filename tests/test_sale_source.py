"""The source of sales against Spark's own reading of the same pages."""

import json
import os

from pricelens.sources import pages, sale_source
from pricelens.sources.state import shared_folder


def test_rows_equal_those_of_landed_pages(spark):
    path = shared_folder(spark)
    local = path.removeprefix("file://")
    for feed in ("a", "b"):
        os.makedirs(f"{local}/{feed}")
        for page in range(1, 4):
            rows = [{"id": f" {feed}{page}-{k}", "status": "sold", "soldAt": "2026-01-01", "price": k * 1.5} for k in range(5)] + [{"id": None}, {"id": ""}, {"status": "x"}]
            with open(f"{local}/{feed}/{page}.json", "w") as f:
                json.dump({"info": {"currentPage": page}, "results": rows}, f)
    got = sale_source.sale_rows(spark, path)
    want = pages.rows_of(pages.landed(spark, path)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 30
    assert got.rdd.getNumPartitions() == 6
    dear = got.where("feed = 'b' and price > 4 and page in (1, 3) and status is not null and length(id) > 2")
    assert sorted(r.id for r in dear.collect()) == ["b1-3", "b1-4", "b3-3", "b3-4"]
    assert dear.rdd.getNumPartitions() == 3  # files of the other feed are not opened
    plan = dear._jdf.queryExecution().executedPlan().toString()
    above = plan.split("BatchScan")[0]
    assert "length(id" in above and "price" not in above.replace("price#", "") and "= b" not in above


def test_bad_lines_and_types_are_no_rows(spark):
    path = shared_folder(spark)
    local = path.removeprefix("file://")
    os.makedirs(f"{local}/feed=x")
    lines = ["", "no json", "[1]", "{}", '{"results": 3}', '{"results": [1, null, {"id": 7, "price": "9"}, {"id": "ok", "price": 2}]}', '{"info": {"currentPage": "z"}, "results": [{"id": "é", "price": true}]}']
    with open(f"{local}/feed=x/part-0.txt", "w") as f:
        f.write("\n".join(lines))
    open(f"{local}/_SUCCESS", "w").close()
    got = sale_source.sale_rows(spark, path)
    assert sorted((r.feed, r.page, r.place, r.id, r.price) for r in got.collect()) == [("x", None, 0, "é", None), ("x", None, 2, "7", None), ("x", None, 3, "ok", 2.0)]
    assert sale_source.sale_rows(spark, shared_folder(spark)).count() == 0
