"""The pipeline beside a plain version of its rules, and on a table with odd rows."""

import re

import corpus_pipeline
from finlark.llm import language_id, pii
from tests.llm.test_exact import plain_groups


def kept_by_language(docs):
    """The classifier's rule, text by text."""
    model = language_id.fit(docs)
    coders = model.compressors()
    kept = []
    for r in docs.select("doc_id", "text").collect():
        words = language_id.normal(r.text or "")
        if words.strip():
            data = words.encode()
            sizes = sorted(sum(len(c.compress(data[i : i + model.chunk])) for i in range(0, len(data), model.chunk)) for _, c in coders)
            if len(sizes) == 1 or (sizes[1] - sizes[0]) / sizes[1] >= 0.005:
                kept.append((r.doc_id, r.text))
    return kept


def test_run_equals_the_plain_version(spark, sf, docs):
    import sentencepiece

    from finlark.llm.queries import model_path

    bench = [r.text.lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = kept_by_language(docs)
    groups = plain_groups(kept, 80)
    kept = [(d, t) for d, t in kept if groups[d][2]]
    kept = [(d, t) for d, t in kept if not any(b in t.lower() for b in bench)]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(got) == sorted(d for d, _ in kept)
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    for d, text in kept:
        spans = pii.base_spans(text)
        r = got[d]
        for kind, a, b in spans:
            assert text[a:b] not in r.text or text.count(text[a:b]) > 1
        if not spans and not re.search(r"[0-9@]", text):
            assert r.text == text
        assert r.n_chars == len(r.text) and library.decode(r.ids) == r.text and r.n_tokens == len(r.ids) and r.ids == library.encode(r.text)
    assert sum(sum(f"[{k.upper()}]" in r.text for k in pii.KINDS) for r in got.values()) > 0


def test_stages_keep_the_columns(spark, sf, odd, tmp_path):
    from pyspark.sql import functions as F

    docs = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.columns[:5] == corpus_pipeline.COLUMNS, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    rows = docs.collect()
    assert {r.doc_id for r in rows} >= {1, 7} and not {r.doc_id for r in rows} & {2, 3, 4, 5, 6}


def test_empty_table(spark, sf, none, tmp_path):
    from pyspark.sql import functions as F

    docs = none.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
