"""The pipeline against its stages applied by hand, and with odd rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from loomstat.llm import decontaminate, packing, secrets, simhash

SMALL = "/root/testdata/sf0.001"


def test_stages_and_their_decisions(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SMALL)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        before, after = ({r.doc_id for r in x.select("doc_id").collect()} for x in (docs, kept))
        assert after <= before
        if name == "SimHash near-dedup":
            group = {r.doc_id: r.group_id for r in simhash.near_duplicates(docs).collect()}
            assert after == {d for d in before if group.get(d, d) == d}
        elif name == "benchmark decontamination":
            leaks = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
            assert after == before - leaks
        elif name == "secret scans":
            assert after == before
            assert {r.doc_id: r.text for r in kept.collect()} == {r.doc_id: secrets.redacted(r.text) for r in docs.collect()}
        docs = kept
    last = sorted(map(tuple, packing.pack(docs).collect()))
    assert last == sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect()))


def test_stages_take_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    odd = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    docs = docs.unionByName(docs.limit(3)).unionByName(odd).withColumns({c: F.lit(1) for c in ("group_id", "item_id", "rank", "windows")})
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, rows, SMALL)
            if name in ("secret scans",):
                assert out.count() == rows.count()
            out.count()


def test_run_takes_odd_tables(spark, tmp_path):
    """Null, repeated and clashing columns through all five stages; copies and rows without an id go, clean ones stay."""
    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = {r.doc_id: r.text for r in corpus_pipeline.keep_good(spark, base, SMALL).collect()}
    leak = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    some = sorted(good, key=lambda i: -len(good[i]))[:3]
    rows = [(i, good[i], "en", None, 1) for i in some] * 2 + [(None, good[some[0]], None, "web", None)] * 2 + [(None, None, None, None, None), (7, "", None, None, None), (None, leak, "en", "web", 1), (2**40, leak, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("_key", "group_id", "rank", "place")})
    for table in (docs, docs.limit(0)):
        table.write.parquet(str(tmp_path / str(table is docs) / "documents.parquet"))
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(str(tmp_path / str(table is docs) / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "False")).count() == 0
    out = docs.select([c for c in docs.columns if c != "_key"])
    for _, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, out, SMALL)
    kept = [(r.doc_id, r.text) for r in out.collect()]
    copies = {i for i, _ in kept if i in some}
    assert copies and all(sum(t == good[i] for _, t in kept) <= 1 for i in some) and (None, None) in kept and (7, "") in kept
    assert not any(t == leak for _, t in kept)
    packed = corpus_pipeline.run(spark, str(tmp_path / "True"))
    assert packed.columns == ["doc_id", "piece", "n_words", "bin_id", "bin_offset"] and {r.doc_id for r in packed.collect()} <= {*some, None, 2**40}
