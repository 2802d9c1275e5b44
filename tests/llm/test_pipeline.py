"""The pipeline against brute force, stage by stage."""

import public_tokenizers
import tiktoken

import corpus_pipeline
from glyphflow.llm import bpe, quality, secrets
from tests.llm.test_operators import SF, brute_fp, brute_groups, brute_hits, brute_quality


def clean(text):
    n, chars, symbols, dup, rep = brute_quality(text)
    lines = len([x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")])
    return not (n < 50 or 100 * rep > 50 * n or 4 * symbols > n or 10 * dup > 3 * lines or chars < 2 * n or chars > 25 * n)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(r.doc_id, r.text) for r in docs if clean(r.text)]
    groups = brute_groups([(i, brute_fp(t)) for i, t in kept])
    kept = [x for k, x in enumerate(kept) if groups[k] == x[0]]
    kept = [(i, t) for i, t in kept if not brute_hits(t, items)[1]]
    ranks = secrets.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    scanner = secrets.Scanner(ranks, public_tokenizers.PATTERN)
    kept = [(i, secrets.redacted(t, scanner.spans(t), corpus_pipeline.REDACTED)) for i, t in kept]
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {i: lib.encode_ordinary(t) for i, t in kept}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(None, None, None, "x"), (1, "word " * 60, 300, "x"), (2, "", 0, "y")], "doc_id long, text string, n_chars long, _row string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 3
    assert quality.POLICIES["v2"][:2] == quality.POLICIES["v1"]
