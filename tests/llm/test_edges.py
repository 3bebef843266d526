"""Null and repeated ids, clashing column names, ties and very long values, on the operators by themselves."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import language_id, packing, queries, substring_dedup, warc

from .test_operators import edited, places, words


def test_pack_null_and_repeated_ids_and_clashing_columns(docs_of):
    from tokenizers import Tokenizer

    rng = random.Random(11)
    texts = ["a b", "a b", None, "c", words(rng, 3000), words(rng, 3000), "", "a b"]
    ids = [7, 7, None, None, 5, 5, None, 7]
    docs = docs_of(texts, ids).selectExpr("*", "1 AS piece", "2 AS length", "3 AS offset", "4 AS sequence_id", "5 AS rank", "6 AS `a.b`")
    rows = packing.pack(docs, queries.tokenizer_path()).collect()
    inner, want = Tokenizer.from_file(queries.tokenizer_path()), Counter()
    for i, t in zip(ids, texts):
        own = inner.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(own), 4096):
            want[i, k // 4096, k, len(own[k : k + 4096]), zlib.crc32(np.array(own[k : k + 4096], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places(rows)  # equal pieces have places of their own


def test_warc_very_long_pages_and_clashing_columns(spark):
    """A page of 12 MB, longer than what is read or inflated at a time, and one just as long as revisits begin."""
    long = "<p>é\r\n\r\nWARC/1.1\r\n" * 600_000
    pages = [(1, "u", long), (2, "u", "y" * 1000), (3, None, "y" * 1000), (4, "u", "y" * 999), (5, "u", "y" * 999), (6, "u", long), (None, "u", "z"), (None, "u", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df = df.selectExpr("*", "'a' AS payload", "'b' AS record_type", "1 AS payload_bytes", "'c' AS file", "2 AS refers_to", "3 AS `a.b`")
    got = warc.read_records(warc.archive(df)).collect()
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    refers = {1: 6, 2: 3}
    want = Counter((i, u or "", "revisit" if i in refers else "response", digest(t), len((t or "").encode()), refers.get(i)) for i, u, t in pages)
    assert Counter((r.page_id, r.url, r.record_type, r.payload_digest, r.payload_bytes, r.refers_to) for r in got) == want


def test_passages_with_repeated_ids_of_near_copies_and_clashing_columns(docs_of):
    rng = random.Random(12)
    base = words(rng, 200, 10**6)
    texts = [edited(rng, base, 0.01), edited(rng, base, 0.01), edited(rng, base, 0.01), words(rng, 200, 10**6), None, base]
    docs = docs_of(texts, [1, 1, 2, 3, 4, None]).selectExpr("*", "1 AS `key`", "2 AS start", "3 AS first_id", "4 AS h1", "5 AS anchor", "6 AS `a.b`")
    rows = substring_dedup.repeated_passages(docs).collect()
    assert {(r.doc_id, r.partner_id) for r in rows} == {(2, 1)}
    covered = {p for r in rows for p in range(r.start, r.start + r.n_words)}
    assert len(covered) >= 190


def test_language_ties_repeats_clashing_columns_and_long_texts(spark):
    one, other = "the quick brown fox jumps over it ", "der schnelle braune fuchs springt "
    texts = [one * 20] * 30 + [other * 20] * 30 + [one * 20] * 30
    langs = ["zz"] * 30 + ["de"] * 30 + ["aa"] * 30
    ids = [i % 30 // 2 for i in range(90)]  # each id twice in every language
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang in zip(ids, texts, langs)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    asked = spark.createDataFrame(
        [(1, one * 100_000, 1.5, "x"), (1, one, 2.5, "y"), (1, one, 2.5, "y"), (None, other * 100_000, None, None), (2, None, 0.0, "z"), (2, " 1 2 ", 0.0, "z")],
        "doc_id long, text string, score double, lang_pred string",
    ).selectExpr("*", "1 AS bits", "2 AS lang", "3 AS `a.b`")
    found = language_id.predict(asked, model)
    assert found.columns == ["doc_id", "text", "bits", "lang", "a.b", "lang_pred", "score"]
    got = [(r.doc_id, len(r.text or ""), r.lang_pred, round(r.score, 3)) for r in found.collect()]
    # aa and zz were learned from equal texts, those of the same ids
    assert [g[:2] for g in got] == [(1, 100_000 * len(one)), (1, len(one)), (1, len(one)), (None, 100_000 * len(other)), (2, 0), (2, 5)]
    assert [g[2] for g in got] == ["aa", "aa", "aa", "de", "und", "und"] and got[1] == got[2]
    assert got[1][3] == 0.5 and got[3][3] == 1.0 and got[4][3] == 0.0
