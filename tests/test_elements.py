"""Arrays of large documents, in blocks, against the json module over whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quern.sources import readers, sinks


@pytest.mark.parametrize("block", [100, 3000, 1 << 20])
@pytest.mark.parametrize("indent", [2, None])
def test_elements_over_borders(spark, tmp_path, block, indent):
    draw = random.Random(block)
    word = lambda: "".join(draw.choice(['a', '"', "\\", "{", "}", "[", "]", ",", "\n", "é", '"recipes": [']) for _ in range(draw.randrange(9)))
    rows = [{"id": i, "title": word(), "deep": {"list": [{"x": word()}, [1]]}} for i in range(150)]
    document = {"first": {"recipes": [{"id": -1}]}, "note": word(), "recipes": rows, "last": [{"id": -2}], "more": {"id": -3}}
    (tmp_path / "d.json").write_text(json.dumps(document, indent=indent, ensure_ascii=False))
    got = readers.pool(spark, str(tmp_path / "d.json"), "id int, title string, deep struct<list:array<string>>", block)
    assert sorted((r.id, r.title) for r in got.collect()) == [(r["id"], r["title"]) for r in rows]
    if indent and block == 100:
        assert got.rdd.getNumPartitions() > 50


def test_pool_round_trip(spark, tmp_path):
    rows = spark.range(500).select("id", F.concat(F.lit('x "'), F.col("id").cast("string")).alias("title"), F.when(F.col("id") % 2 == 0, F.array(F.lit("a"))).alias("items"))
    sinks.pool(rows, F.col("id"), str(tmp_path / "p"), kb_version="v0", counts={"a": [1]})
    text = "".join(p.read_text() for p in sorted((tmp_path / "p").glob("part-*")))
    whole = json.loads(text)
    assert whole["kb_version"] == "v0" and [r["id"] for r in whole["recipes"]] == list(range(500))
    assert sorted(readers.pool(spark, str(tmp_path / "p"), "id long, title string, items array<string>", 700).collect()) == sorted(rows.collect())
    sinks.pool(rows.limit(0), F.col("id"), str(tmp_path / "none"))
    assert readers.pool(spark, str(tmp_path / "none"), "id long").count() == 0
