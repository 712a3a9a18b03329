import json

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilcell.llm import tokens as tk

from .helpers import documents, odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_proven_strings_are_one_token(library):
    with open(PATH, encoding="utf-8") as file:
        whole = tk.prove_whole_tokens(file.read())
    assert len(whole) > 30_000
    assert set(lengths(library, sorted(whole)[::50])) == {1}


def test_counts_equal_the_library(spark, library):
    texts = ["", " ", "it's 'S DON'T !!'s ''' we've", "<|endoftext|> a<|startoftext|>b", "naïve Σ ΣΑΣ İ é ½ ² ª µ", "x\x1cy\x85z w", "日本語 text ÿŸ", "a ' s 's's", "1234 5,678.90",
             "é ñ", "\u0000\u0007", "ß ẞ ﬁ", "<|endoftext", "word" * 3000, "…—“quoted”", "👍🏽 ok"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + odd_rows()
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tk.token_counts(documents(spark, rows), PATH).collect())
    counts = lengths(library, [r[1] for r in rows])
    assert got == sorted((repr(d), len((t or "").encode()), n, n > 2048) for (d, t, _), n in zip(rows, counts, strict=True))
    assert tk.token_counts(documents(spark, []), PATH).count() == 0


def test_small_tables_forget_without_harm(library, monkeypatch):
    monkeypatch.setattr(tk, "REMEMBERED", 5)
    with open(PATH, encoding="utf-8") as file:
        definition = file.read()
    counter = tk.TokenCounter(definition, tk.prove_whole_tokens(definition), tuple(t["content"] for t in json.loads(definition)["added_tokens"]))
    texts = [f"some qzxw{i} wordz{i % 7}, and it's" for i in range(50)]
    assert [counter.count([t])[0] for t in texts] == lengths(library, texts) == counter.count(texts)


def test_query_equals_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in tk.op7_token_counts(spark, folder).collect()}
    assert got == dict(zip(docs, lengths(library, docs.values()), strict=True))
