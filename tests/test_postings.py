import random

import pytest

from bidweave.operators import postings

FIELDS = ["title", "description"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abC%_\\ é1") for _ in range(rnd.randint(0, 9)))
    rows = [(i, word() + word(), rnd.choice([None, word()])) for i in range(400)] + [(400, None, None), (401, "", "ab"), (7, "Abcab", None)]
    records = spark.createDataFrame(rows, "id long, title string, description string").repartition(3).cache()
    path = str(tmp_path_factory.mktemp("postings") / "p")
    postings.write(records, FIELDS, path)
    return records, path


def test_search_equals_like(spark, kept):
    records, path = kept
    rnd = random.Random(4)
    terms = ["", "ab", "abc", "a%b", "_b_", "C1", "zzz", "a\\%", "\\", "1\\", "é", "b%C%1", "ab c"] + ["".join(rnd.choice("abc%_\\ é") for _ in range(rnd.randint(3, 6))) for _ in range(25)]
    for term in terms:
        got = postings.search(records, FIELDS, path, term)
        pattern = "%" + (term + "\\" if term.endswith("\\") and not term.endswith("\\\\") else term) + "%"
        try:
            want = records.where(postings.F.coalesce(postings.F.col("title").ilike(pattern), postings.F.lit(False)) | postings.F.coalesce(postings.F.col("description").ilike(pattern), postings.F.lit(False)))
            wanted = sorted(map(str, want.collect()))
        except Exception as e:  # an escape before another sign is an error of LIKE itself
            with pytest.raises(type(e)):
                got.collect()
            continue
        assert sorted(map(str, got.collect())) == wanted, term


def test_grams_of_a_pattern():
    assert postings.grams_of_pattern("%ABcd%ef_gh\\%i%") == ["abc", "bcd", "gh%", "h%i"]
    assert postings.grams_of_pattern("%ab%") == [] == postings.grams_of_pattern("%")


def test_a_selective_term_reads_its_own_folders(spark, kept):
    records, path = kept
    plan = postings.search(records, FIELDS, path, "abc")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [" in plan and "gram" in plan and "BroadcastNestedLoop" not in plan
    assert postings.candidates(spark, path, "%ab%") is None and postings.candidates(spark, path, "%zzz%").count() == 0


def test_a_large_bucket_is_dealt_to_several_tasks(spark, tmp_path):
    records = spark.range(30_000).selectExpr("id", "concat('aaa', id) title", "cast(null as string) description").repartition(6)
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
        postings.write(records, FIELDS, str(tmp_path / "p"))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    bucket = spark.range(1).select(postings.bucket_of(postings.F.lit("aaa"))).first()[0]
    assert len(list((tmp_path / "p" / f"bucket={bucket}").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "p")).where("gram = 'aaa'").count() == 30_000 == postings.candidates(spark, str(tmp_path / "p"), "%aaa%").count()
