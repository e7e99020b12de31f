"""Columns whose names the code uses inside, or that hold dots, pass every stage of the pipeline as they are."""

import corpus_pipeline

ODD = ["__no", "__N", "__k1", "mix_copy", "mix_key", "meta.url", "no", "cid"]


def test_stages_keep_odd_columns(spark):
    rows = [(None if i % 2 else i, f"some words of text number {i // 2} that are long enough {'x ' * (i // 2)}", "en", "a", *(100 * i + k for k in range(len(ODD)))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in ODD))
    given = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        kept = [tuple(r) for r in out.collect()]
        assert kept and set(kept) <= given, name
