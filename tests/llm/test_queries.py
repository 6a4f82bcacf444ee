"""The registered queries of the training-data operators on the smallest sample, and the pipeline's stages."""

import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
import public_tokenizers
from courtside.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import slow_components, slow_hits, slow_print
from tools.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not present")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    res = con.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


def test_simhash_query(spark, con):
    docs = con.execute("select doc_id, text from documents").fetchall()
    prints = [slow_print(t) for _, t in docs]
    group = slow_components(prints)
    want = {i: (f"{p:016x}", min(j for (j, _), h in zip(docs, group) if h == g)) for (i, _), p, g in zip(docs, prints, group)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash_neardup"](spark, SF).collect()} == want


def test_token_query(spark, con):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in con.execute("select doc_id, text from documents").fetchall()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op4_token_counts"](spark, SF).collect()} == want


def test_packing_query_is_near_the_bound(spark):
    got = QUERIES["op7_pack"](spark, SF).toPandas()
    assert got.sequence_id.nunique() <= -(-int(got.length.sum()) // 2048) + 1


def test_held_out_accuracy(spark, con):
    lang = dict(con.execute("select doc_id, lang from documents").fetchall())
    held = [r for r in QUERIES["op3_language_id"](spark, SF).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held) and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    rows = QUERIES["op10_toxicity"](spark, SF).collect()
    assert {r.predicted == int(r.score >= 0.5) for r in rows} == {True}


def test_pages_query(spark, con):
    import html
    import re
    got = {r.page_id: r.text for r in QUERIES["op8_html_main_text"](spark, SF).collect()}
    right = 0
    for i, page in con.execute("select page_id, html from pages").fetchall():
        inner = re.search("<article>(.*)</article>", page, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", b))).strip() for b in re.split("</?(?:p|h1|br)>", inner)]
        right += got[i] == " ".join(b for b in blocks if b)
    assert right >= 0.97 * len(got)


def test_pipeline_stages(spark, con, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = con.execute("select item_id, text from benchmark").fetchall()
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert sorted(docs.columns) == sorted(columns) and docs.join(before, columns, "left_anti").count() == 0
        if name == "near_dedup":
            rows = before.select("doc_id", "text").collect()
            group = slow_components([slow_print(r.text) for r in rows])
            assert {r.doc_id for r in docs.collect()} == {min(r.doc_id for r, h in zip(rows, group) if h == g) for g in set(group)}
        if name == "decontamination":
            gone = set()
            for r in before.collect():
                n, hits, _ = slow_hits(r.text, items)
                gone |= {r.doc_id} if hits and 20 * hits >= n else set()
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()} == gone
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}
