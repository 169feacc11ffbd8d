"""The stages by planted cases, the registry, and the queries that SQL can express."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check import rows
from locusframe.llm.catalog import SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


def test_registry():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(docs.filter("lang = 'en'").orderBy("doc_id").first()["text"].split())
    # a passage that one other document has, and no copy of it
    texts = {r["doc_id"]: " ".join(r["text"].split()) for r in docs.filter("lang = 'en'").collect()}
    starts = [" ".join(t.split()[:60]) for i, t in sorted(texts.items()) if t != long and len(t) > 1500]
    other = next(p for p in starts if sum(w in t for w in (p[:120], p[-120:]) for t in texts.values()) == 2)
    more = [
        (100001, long, "en", "s", 1), (100002, long + " ", "en", "s", 1), (100003, long + " the end", "en", "s", 1), (100004, "12345 !!", "en", "s", 1),
        (100005, None, None, None, None), (100006, "Все счастливые семьи похожи друг на друга", None, "s", 1), (100007, "hereand theon thting " + other, "en", "s", 1),
        (100001, long, "en", "s", 1),
    ]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{corpus_pipeline.scratch(spark, 'stage')}"
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "best-fit packing":
            assert after.columns == docs.columns
        left[name], docs = after, after
    ids = {n: {r["doc_id"] for r in f.select("doc_id").collect()} for n, f in left.items()}
    assert not ids["language ID"] & {100004, 100005, 100006} and {100001, 100002, 100007} <= ids["language ID"]
    assert len(ids["exact dedup"] & {100001, 100002}) <= 1
    assert not ids["MinHash near-dedup"] & {100001, 100002, 100003}
    texts = {r["doc_id"]: r["text"] for r in left["substring dedup"].collect()}
    assert texts[100007] == "hereand theon thting"
    assert ids["best-fit packing"] == ids["substring dedup"]
    assert left["exact dedup"].count() == len(ids["exact dedup"])


def test_stages_keep_columns_of_any_name(spark):
    """Columns that stages might use themselves, null ids that share a text, repeated rows, an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["_id", "_version", "_kept", "row_key", "what", "id", "version", "kept_text", "text_"]
    odd = docs.limit(40).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    text = docs.filter("lang = 'en'").orderBy("doc_id").first()["text"]
    for given in (None, None, 900001, 900001):
        odd = odd.unionByName(odd.limit(1).withColumns({"doc_id": F.lit(given).cast("bigint"), "text": F.lit("new start " + text), "lang": F.lit("en")}))
    path = corpus_pipeline.scratch(spark, "odd")
    odd.write.parquet(path)
    odd = spark.read.parquet(path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, SF)
        assert got.columns == odd.columns, name
        for r in got.collect():
            if r["doc_id"] is not None and r["doc_id"] < 900000:
                assert all(r[n] == f"{n}{r['doc_id']}" for n in names), name
        assert stage(spark, odd.limit(0), SF).count() == 0, name
    assert corpus_pipeline.packing(spark, odd.limit(0), SF).count() == 0
    kept = corpus_pipeline.exact_dedup(spark, odd, SF).filter(F.col("text").startswith("new start")).collect()
    assert len(kept) == 1 and kept[0]["doc_id"] is None
