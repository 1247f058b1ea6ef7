"""The pipeline's stages follow one another as their operators decide."""

import corpus_pipeline as P
from loomtext.llm import decontam, ngram_join


def test_stages_on_the_smallest_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    seen = [docs]
    for name, stage in P.STAGES[:-1]:
        out = P.saved(stage(spark, seen[-1], sf))
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= seen[-1].count()
        seen.append(out)
    found = ngram_join.ngram_join(seen[2])
    assert seen[3].count() == found.select("component_id").distinct().count()
    assert decontam.contamination(seen[4], bench).where("contaminated").count() == 0
    packed = P.STAGES[-1][1](spark, seen[4], sf)
    assert packed.select("doc_id").distinct().count() == seen[4].select("doc_id").distinct().count()
    assert {r.doc_id for r in P.run(spark, sf).select("doc_id").distinct().collect()} == {r.doc_id for r in packed.select("doc_id").distinct().collect()}


def test_stages_on_odd_rows_and_empty_tables(spark, sf):
    """Nulls, empty and long texts, repeated rows, shared ids and clashing columns go through every stage; so does a table without rows."""
    good = "The and attion of the ndere in a text. Thand erin to ontion the. Another of the andere here, and is of some length to pass."
    rows = [(1, good), (1, good), (2, good + " More."), (3, None), (None, None), (4, ""), (None, good.replace("text", "note") * 40), (5, "x" * 9000), (6, "a\n\nb\na"), (7, good[::-1]), (7, "other " + good[::-1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, row_ string, label string")
    for start in (docs, docs.limit(0)):
        for name, stage in P.STAGES[1:-1] + P.STAGES[:1]:
            out = stage(spark, start, sf)
            assert out.columns == docs.columns, name
            found = out.collect()
            assert len(found) <= start.count(), name
        packed = P.STAGES[-1][1](spark, start, sf)
        assert packed.where("piece = 0").count() == start.count()
    left = ngram_join.drop_near_duplicates(docs).collect()
    assert sum(r.text == good for r in left) == 1 and sum(r.text is None for r in left) == 2
