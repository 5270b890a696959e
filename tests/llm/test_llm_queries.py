"""The registered queries beside their SQL, or beside plain loops where SQL cannot express them."""

from html import unescape

import pytest
from llm_tables import load, tokenizer

import corpus_pipeline
import plain
from compare import compare
from streamlens.llm.oracle import LLM_ORACLE
from streamlens.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(LLM_QUERIES[name](spark, SF), LLM_ORACLE[name], SF) > 0


def test_token_ids_equal_the_tokenizer(spark):
    rows = {r.doc_id: r for r in LLM_QUERIES["op5_token_ids"](spark, SF).collect()}
    start = 0
    for doc_id, text in sorted(load(spark, SF, "documents", "doc_id", "text")):
        ids = plain.encoded(tokenizer(), text, 0)
        assert (rows[doc_id].start, rows[doc_id].n_tokens, rows[doc_id].ids_crc32) == (start, len(ids), plain.crc(ids))
        start += len(ids)


def check_pieces(rows, texts, least_fill):
    """Every id in one piece, sequences gapless from 0 and within their length, little padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids, at = plain.encoded(tokenizer(), texts[doc_id], 1), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == plain.crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
    assert total >= least_fill * 2048 * len(by_sequence)


def test_packing_holds_every_id_once(spark):
    texts = dict(load(spark, SF, "documents", "doc_id", "text"))
    check_pieces(LLM_QUERIES["op10_packing"](spark, SF).collect(), texts, 0.97)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    toxic = dict(load(spark, sf, "labels", "doc_id", "toxic"))
    rows = [r for r in LLM_QUERIES["op2_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in toxic]
    right = sum(toxic[r.doc_id] == r.predicted for r in rows)
    found = sum(r.predicted for r in rows if toxic[r.doc_id])
    assert right >= 0.97 * len(rows)
    assert found >= 0.85 * sum(toxic[r.doc_id] for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_every_page_is_rendered(spark):
    rows = dict(LLM_QUERIES["op4_html_text"](spark, SF).collect())
    pages = dict(load(spark, SF, "pages", "page_id", "html"))
    assert set(rows) == set(pages)
    for page_id, html in pages.items():
        assert "track(" not in rows[page_id] and "margin:0" not in rows[page_id]
        title = unescape(html.split("<h1>")[1].split("</h1>")[0])
        assert " ".join(title.split()) in rows[page_id]


def test_pipeline_equals_plain_loops(spark):
    docs = load(spark, SF, "documents", "doc_id", "text")
    items = load(spark, SF, "benchmark", "item_id", "text")
    docs = [(i, t) for i, t in docs if plain.quality(t)[-1]]
    docs = [(i, text) for i, _, _, text in plain.dedup_lines(docs)]
    root = plain.near_components(docs)
    docs = [(i, t) for i, t in docs if root[i][1] == i]
    docs = {i: t for i, t in docs if not plain.overlap(t, items)[-1]}
    assert docs
    check_pieces(corpus_pipeline.run(spark, SF).collect(), docs, 0.97)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES][2] == "minhash_near_dedup"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
