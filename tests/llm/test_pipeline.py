import duckdb
import numpy as np

import corpus_pipeline
from ombrage.llm import ORACLES, QUERIES, near_text, piece_coding, secret_scan

from .helpers import empty, odd

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_stand_odd_rows(spark, tmp_path):
    for docs in (odd(spark), empty(spark)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
            out.write.mode("overwrite").parquet(str(tmp_path / name))


def test_run_against_plain_steps(spark):
    """The stages' decisions, made again one document at a time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF)
    near = corpus_pipeline.near_duplicates(spark, kept, SF).toPandas()
    rows = kept.toPandas()
    text_of = dict(zip(rows.doc_id, rows.text, strict=True))
    shingles = {i: set(near_text.shingle_hashes(t).tolist()) for i, t in text_of.items()}
    stays, ids = set(near.doc_id), sorted(text_of)
    alike = lambda i, j: len(shingles[i] & shingles[j]) >= near_text.ALIKE * len(shingles[i] | shingles[j])
    for i in set(ids) - stays:  # what goes is like something
        assert any(alike(i, j) for j in ids if j != i)
    assert [(i, j) for i in stays for j in stays if i < j and alike(i, j)] == []
    assert len({text_of[i] for i in stays}) == len(stays)
    clean = corpus_pipeline.secrets(spark, spark.createDataFrame(near, schema=docs.schema), SF).toPandas()
    assert dict(zip(clean.doc_id, clean.text, strict=True)) == {i: secret_scan.redact_text(t) for i, t in zip(near.doc_id, near.text, strict=True)}
    lib = piece_coding.coder(piece_coding.MODEL).lib
    last = corpus_pipeline.run(spark, SF).toPandas()
    text = dict(zip(clean.doc_id, clean.text, strict=True))
    mixed = {r["doc_id"] for r in corpus_pipeline.mixture(spark, spark.createDataFrame(clean, schema=docs.schema), SF).collect()}
    assert set(last.doc_id) == mixed <= set(text) and last.doc_id.is_unique and len(last) > 0
    for i, ids_, decoded in zip(last.doc_id, last.ids, last.decoded, strict=True):
        assert np.frombuffer(ids_, "<u4").tolist() == lib.encode(text[i], add_bos=True, add_eos=True)
        assert decoded == text[i]


def test_every_query_has_an_oracle_or_a_test():
    assert set(ORACLES) <= set(QUERIES) and [int(q[2:].split("_")[0]) for q in QUERIES] == list(range(1, 14))


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, SF).toPandas()
        want = con.sql(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        text = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).map(lambda v: round(float(v), 5) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v).itertuples(index=False, name=None)))
        assert text(got) == text(want), name
