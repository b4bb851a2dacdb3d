"""The pipeline's stages against the queries and brute force, and the queries against their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstat.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def test_registered():
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in QUERIES}
    assert {*QUERIES, "pipeline"} <= {*__spark_entry__.queries()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got, want = QUERIES[name](spark, DATA), con.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.select(*columns).fetchall())


def test_stages(spark, tmp_path):
    docs = start = spark.read.parquet(f"{DATA}/documents.parquet")
    after = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after.append(docs)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(after[0]) == ids(QUERIES["op10_quality_rules"](spark, DATA).where("kept"))
    assert all(a.columns == start.columns for a in after[:4])
    from quillstat.llm.jaccard_join import near_duplicates

    assert ids(after[1]) == ids(near_duplicates(after[0]).where("doc_id = component_id"))
    dirty = QUERIES["op8_decontaminate"](spark, DATA).where("contaminated")
    assert ids(after[2]) == ids(after[1]) - ids(dirty)
    assert ids(after[3]) == ids(after[2]) and after[3].where(F.length("text") != F.col("n_chars")).count() == 0
    joined = after[4].join(after[3].select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")), "doc_id")
    assert joined.where("h = decoded_sha256").count() == after[3].count()


def test_texts_go_to_python_once(spark):
    """Each stage that runs in Python has one pass of workers, and sends them each text once."""
    import re

    import public_tokenizers

    from quillstat.llm import byte_bpe, decontaminate

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sent = lambda df: re.findall(r"MapInArrow run\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())
    names = lambda x: [re.sub(r"#.*", "", c.strip()) for c in x.split(",")]
    assert [names(x) for x in sent(corpus_pipeline.byte_bpe(spark, docs, DATA))] == [["doc_id", "lang", "source", "__text"]]
    assert [names(x) for x in sent(corpus_pipeline.decontaminate(spark, docs, DATA))] == [["row"]]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    odd = spark.createDataFrame([(1, "a  b\n é 語", "x"), (2, None, "y"), (3, "", None), (4, "<|endoftext|>" * 3, "")], "i int, text string, decoded string")
    plain = byte_bpe.encode(odd, path, public_tokenizers.PATTERN)
    assert plain.columns == ["i", "text", "decoded", "ids"] and [names(x) for x in sent(plain)] == [["i", "text", "decoded"]]
    assert sorted(plain.select(*odd.columns).collect()) == sorted(odd.collect())
    once, twice = byte_bpe.encode(odd, path, public_tokenizers.PATTERN, decoded="decoded"), byte_bpe.decode(plain, path)
    assert once.columns == ["i", "ids", "decoded"]
    assert {(r["i"], *r["ids"], bytes(r["decoded"])) for r in once.collect()} == {(r["i"], *r["ids"], bytes(r["decoded"])) for r in twice.collect()}
    assert {r["i"]: bytes(r["decoded"]).decode() for r in once.collect()} == {r["i"]: r["text"] or "" for r in odd.collect()}
    # a text column of another name, over many batches, and one that is null everywhere
    many = spark.range(0, 30_000, 1, 1).selectExpr("id", "if(id % 3 = 0, null, concat('w', id, ' one two three four five six seven')) body", "cast(null as string) text")
    bench = spark.createDataFrame([(1, "w29999 one two three four five six seven")], "item_id long, text string")
    left = decontaminate.remove_documents(many, bench, text="body")
    assert left.columns == many.columns and left.count() == 29_999 and left.where("id = 29999").isEmpty()


def test_run_of_odd_rows(spark, tmp_path):
    """Nulls, repeated ids and rows, empty and very long texts, extra and clashing columns; nothing is left behind."""
    import random

    from quillstat.llm.common import shared_folder

    rng = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    word = lambda k: (rng.choice(words) + rng.choice(["", "s", "ed", "ing"])).capitalize() if k % 10 == 0 else rng.choice(words) + rng.choice(["", "s", "ed", "ing"])
    prose = lambda n: " ".join(map(word, range(n))) + "."
    same, clash, long = prose(60), prose(60), prose(100_000)
    bench = prose(40)
    rows = [(i, prose(rng.randrange(20, 90))) for i in range(300)]
    rows += [(900, same), (901, same), (901, clash), (902, clash + " more"), (None, same), (None, prose(50)), (903, None), (904, ""), (905, long), (906, bench), (907, prose(40) + " Mr. John Smith.")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "x", 1.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, items string, n_hit double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    after = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, after, str(tmp_path))
        assert after.columns == docs.columns
    kept = {(r["doc_id"], r["text"], r["items"], r["n_hit"]) for r in after.where("doc_id is null or doc_id >= 900").collect()}
    # of the copies the least id, of the near copies too; null and empty texts and the benchmark passage are gone
    assert {(i, len(t)) for i, t, _, _ in kept if i != 907} == {(900, len(same)), (901, len(clash)), (None, len(rows[305][1])), (905, len(long))}
    assert {k[2:] for k in kept} == {("x", 1.5)} and not any("Smith" in t for _, t, _, _ in kept)
    before = {p for p in os.listdir(shared_folder(spark).removeprefix("file:")) if p.startswith("pipeline-")}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == after.count() and out.where("doc_id = 905").first()["n_tokens"] > 100_000
    (own,) = {p for p in os.listdir(shared_folder(spark).removeprefix("file:")) if p.startswith("pipeline-")} - before
    assert os.listdir(os.path.join(shared_folder(spark).removeprefix("file:"), own)) == ["4"]
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
