import os

import pytest

from lexweft.llm import minhash
from lexweft.llm.common import FEW_PARTS
from lexweft.llm.components import connected_components
from lexweft.sources.shared import recorded


@pytest.fixture
def many_partitions(spark):
    """As where Spark doesn't merge small partitions."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _left(paths):
    return [p for p in paths if os.path.exists(p.removeprefix("file://"))]


def test_few_links_take_few_files_and_rounds_go(spark, many_partitions):
    links = [(i + 1, i) for i in range(500)] + [(1000 + i, 1000) for i in range(1, 300)]
    edges = spark.createDataFrame(links, "u long, v long").repartition(40)
    with recorded() as paths:
        star = connected_components(edges)
    want = {(i, 0) for i in range(1, 501)} | {(1000 + i, 1000) for i in range(1, 300)}
    assert {tuple(r) for r in star.collect()} == want
    assert len(paths) > 3 and _left(paths) == paths[-1:]
    assert len(star.inputFiles()) <= FEW_PARTS


def test_dedup_leaves_only_what_its_result_reads(spark, many_partitions):
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) + end for i in range(6) for end in ("", " more", " most")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with recorded() as paths:
        kept = minhash.dedup_stage(spark, docs, "")
    assert len(_left(paths)) == 1 and _left(paths)[0].endswith("/keepers")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 6, 9, 12, 15]
