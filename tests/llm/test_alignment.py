import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from veilcell.llm import alignment as al

from .helpers import documents, odd_rows

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "hello  world", "a\n\nb ", "  lead", "▁x", "x ▁", "<s> hi </s> <0x0A> <unk>", "<|endoftext|> a", "ｆｕll ﬁ éé",
         "a\tb\x00c\r\nd", "\U0001f600\U0001f44d\U0001f3fd ok", "日本語 テキスト です", "don't won't 12345 6,789.01", "word " * 50, "Ġ ĊĀ", "x" * 5000, " 　 ​"]


def letters():
    """The byte-level letters by their rule: visible bytes stand for themselves, the others follow from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@pytest.fixture(scope="module")
def plain():
    """Expected rows by the definition: all pairs of tokens whose byte ranges end together."""
    tok, pieces, table = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), letters()
    tok.encode_special_tokens = True

    def tokens(text):
        e = tok.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(table[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        b = [(i, bytes([int(p[1:-1], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode())
             for i, p in ((i, pieces.id_to_piece(i)) for i in pieces.encode(text))]
        whole = (" " + text).encode()
        return (a, b) if all(b"".join(x for _, x in side) == whole for side in (a, b)) else ([], [])

    def rows(texts):
        linked, found = [], []
        for text in texts:
            a, b = tokens(text) if text else ([], [])
            ends = [[sum(len(x) for _, x in side[:i + 1]) for i in range(len(side))] for side in (a, b)]
            links = [(x, y) for x in range(len(a)) for y in range(len(b)) if ends[0][x] == ends[1][y]]
            groups, p, q = [], 0, 0
            for x, y in links:
                groups.append(",".join(str(i) for i, _ in a[p:x + 1]) + "|" + ",".join(str(i) for i, _ in b[q:y + 1]))
                p, q = x + 1, y + 1
            linked.append([(a[x][0], b[y][0]) for x, y in links])
            found.append((len(a), len(b), len(groups), ";".join(groups)))
        counts = Counter(p for own in linked for p in own)
        top = {}
        for (_, y), n in counts.items():
            top[y] = max(top.get(y, 0), n)
        return [(n_a, n_b, n, len(own), sum(counts[p] == top[p[1]] for p in own), sum(counts[p] for p in own),
                 hashlib.sha256(g.encode()).hexdigest() if n_a else "") for (n_a, n_b, n, g), own in zip(found, linked)]
    return rows


@pytest.mark.parametrize("limit", [al.BROADCAST_PAIRS, 0])
def test_query_equals_the_definition(spark, tmp_path, monkeypatch, plain, limit):
    monkeypatch.setattr(al.with_pair_counts, "__defaults__", (limit,))
    odd = [r for r in odd_rows() if r[0] not in (5, 6, 8)]  # plain pairs of 60,000 tokens take too long
    rows = [(100 + i, t, "s") for i, t in enumerate(TEXTS)] + odd
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = al.op11_token_alignment(spark, str(tmp_path)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((d, *e)) for (d, _, _), e in zip(rows, plain([t for _, t, _ in rows])))


def test_long_texts_and_empty_tables(spark, ws):
    rows = [r for r in odd_rows() if r[0] in (5, 6, 8)]
    got = {r.doc_id: r for r in al.align(documents(spark, rows), A, B).collect()}
    for d, text, _ in rows:
        groups = [g.split("|") for g in got[d].groups.split(";")]
        assert sum(len(a.split(",")) for a, _ in groups) == got[d].n_a and sum(len(b.split(",")) for _, b in groups) == got[d].n_b
        assert sum(x.times for x in got[d].links) == got[d].n_links == len(groups)
    assert al.with_pair_counts(ws, ws.cut(al.align(documents(spark, []), A, B), "none")).count() == 0


def test_merging_by_ranks_is_the_definition():
    with open(A, encoding="utf-8") as file:
        definition = file.read()
    assert al.merges_follow_ranks(definition)
    fast, slow = al.ByteLevel(definition, True), al.ByteLevel(definition, False)
    texts = [e.decode() for e in al.byte_level_entries(definition) if e.decode(errors="ignore").encode() == e]
    rng = random.Random(8)
    pool = [chr(c) for c in range(0x250)] + ["'s", "'LL", " ", "  ", "\n", "<|endoftext|>", "12", "\u2581", "\u4e00", "\U0001f600"] * 8
    texts += [" " + "".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(5000)]
    assert fast.encode(texts) == slow.encode(texts)
    other = json.loads(definition)
    other["model"]["merges"][5], other["model"]["merges"][900] = other["model"]["merges"][900], other["model"]["merges"][5]
    assert not al.merges_follow_ranks(json.dumps(other))


def test_windows_can_be_forgotten():
    with open(A, encoding="utf-8") as file:
        a = al.Vocabulary(al.byte_level_entries(file.read()))
    with open(B, "rb") as file:
        b = al.Vocabulary(al.piece_entries(file.read()))
    tok, pieces = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    text = " ".join(f"some qz{i % 30} unforeseeable wordings" for i in range(200))
    ids = [[al.np.array(x)] for x in (tok.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text))]

    def plain(aligner, times=1):
        return [(g, links.tolist()) for g, links in aligner.texts(*[x * times for x in ids])]

    small, large = al.Aligner(a, b, remembered=3), al.Aligner(a, b)
    assert plain(small) == plain(large) == plain(large) == plain(large, 3)[1:2]
    whole = [tuple(x[0].astype(al.np.int32).tobytes() for x in ids)]  # one window without any anchor
    assert large.aligned(whole) == plain(large) and large.aligned(whole * 2) == plain(large) * 2 and len(large.windows) < 40
