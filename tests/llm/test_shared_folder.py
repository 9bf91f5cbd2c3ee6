"""What operators leave in the shared folder: stored results, nothing else."""

from pathlib import Path

import pytest

import corpus_pipeline as cp
from sampleloom.llm import credential_scan, queries
from sampleloom.llm.common import lend, release

#: The stored result of each query that has one.
RESULTS = {
    "op1_ogg": [], "op2_language_id": [], "op3_secret_scan": [], "op4_multiprobe": ["nearest"], "op5_near_duplicates": ["near-duplicates"], "op6_repair": ["token-ids"], "op7_pareto_mix": ["mixed"],
    "op8_license_digest": ["licences"], "op9_length_buckets": ["packed"], "op10_rule_ensemble": ["quality"], "op11_simplex_kmeans": ["clusters"], "op12_alignment": ["aligned"], "op13_prefix_counts": ["token-counts"],
}
SF = "/root/testdata/sf0.001"


class Shared:
    """What is new in the shared folder."""

    def __init__(self, spark):
        self.folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
        self.before = set(self.folder.iterdir())

    def new(self):
        return sorted(p for p in self.folder.iterdir() if p not in self.before)

    def left(self):
        return [p.name.rsplit("-", 1)[0] for p in self.new()]


@pytest.fixture
def shared(spark):
    release(spark)
    return Shared(spark)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_a_query_leaves_its_result_alone(spark, shared, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
    assert shared.left() == RESULTS[name]


def test_the_pipeline_leaves_its_result_and_no_credential(spark, shared, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    secrets = [f"Xq{i}Zw{i * 7919 % 10007}" for i in range(40)]
    planted = spark.createDataFrame([(50_000 + i, f"the words of document {i} stand here, password = {s} and so on", "en", "src1", 60) for i, s in enumerate(secrets)], docs.schema)
    docs.unionByName(planted).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() > 0
    assert shared.left() == ["stage-4"]
    assert "text" not in spark.read.parquet(*map(str, shared.new())).columns
    found = credential_scan.scan(docs.unionByName(planted), credential_scan.fit(docs.unionByName(planted)))
    assert found.where("n_assign > 0").count() >= len(secrets) and shared.left() == ["stage-4"]


def test_stages_lend_small_tables_until_they_are_released(spark, shared):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage, lent in ((cp.deduplicated, ["chosen"]), (cp.mixed, ["copies"]), (cp.packed, ["pack-lengths"])):
        assert stage(spark, docs, SF).count() > 0
        assert shared.left() == lent
        release(spark)
        assert shared.left() == []
    held = lend(spark.range(3), "some")
    assert held.count() == 3 and shared.left() == ["some"]
    release(spark)
    release(spark)
    assert shared.left() == []
