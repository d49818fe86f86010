"""Alignment of two tokenizers against a plain count of every link, with the slower encoder of the first vocabulary."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from rillwood.llm import alignment

TOP = "/opt/tokenizers"
SCHEMA = "doc_id long, text string, row int, a string, first int, n_a string"


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOP}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=f"{TOP}/piece_bpe_32k.model")


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "a", 2, "x") for r in rows], SCHEMA).repartition(parts)


def groups_of(text, tools):
    """[(a ids, b ids)] by the offsets at which both sides' tokens end."""
    if not text:
        return []
    t, sp = tools
    back = alignment.byte_of_character()
    whole = f" {text}".encode()
    a = t.encode(f" {text}", add_special_tokens=False).ids
    b = sp.encode(text)
    bytes_a = [bytes(back[c] for c in t.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    out, i, j, x, y, ga, gb = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            x, i = x + len(bytes_a[i]), i + 1
            ga.append(a[i - 1])
        else:
            y, j = y + len(bytes_b[j]), j + 1
            gb.append(b[j - 1])
        if x == y:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def brute(rows, tools):
    docs = [groups_of(t, tools) for _, t in rows]
    links = [Counter((a, b) for ga, gb in d for a in ga for b in gb) for d in docs]
    held = Counter(p for m in links for p in m)
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, _), d, m in zip(rows, docs, links):
        spelled = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in d)
        sha = hashlib.sha256(spelled.encode()).hexdigest() if d else ""
        out.append((i, sum(len(g[0]) for g in d), sum(len(g[1]) for g in d), len(d), sum(m.values()), sum(n for p, n in m.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in m.items()), sha))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces  "), (5, "<|endoftext|> </s> <unk> <s>"), (6, "a▁b"), (7, "<0x0A>\n\t\0x"), (8, "ﬁ ½ ｆｕｌｌ"), (9, "日本語 текст ελληνικά 🙂🙂"),
    (9, "the same"), (9, "the same"), (None, "the same"), (10, "x" * 5000), (11, "word " * 3000), (12, "a1b2" * 700), (13, "ab" + " " * 12_000 + "c"), (14, "Éê" * 400), (15, "　  é"),
]


def test_odd_texts(spark, tools):
    got = alignment.align(table(spark, ODD))
    assert found(got) == brute(ODD, tools)
    assert {r.doc_id: r.n_a for r in got.collect()}[6] == 0  # the mark reads back as a space
    assert found(alignment.align(table(spark, []))) == []
    assert found(alignment.align(table(spark, [(1, None)]))) == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("links", [1, 5, 40, 1 << 20])
def test_link_counts_in_ranges(monkeypatch, links):
    monkeypatch.setattr(alignment, "LINKS", links)
    rng = np.random.default_rng(3)
    in_a, in_b, doc = rng.integers(1, 9, 60), rng.integers(1, 9, 60), np.sort(rng.integers(0, 7, 60))
    a, b = rng.integers(0, 6, in_a.sum()), rng.integers(0, 5, in_b.sum())
    want, at_a, at_b = Counter(), 0, 0
    for p, q, d in zip(in_a.tolist(), in_b.tolist(), doc.tolist()):
        want.update((x, y, d) for x in a[at_a : at_a + p].tolist() for y in b[at_b : at_b + q].tolist())
        at_a, at_b = at_a + p, at_b + q
    keys, times = alignment.link_counts(a, b, in_a, in_b, doc)
    assert {(k >> 44, k >> 24 & 0xFFFFF, k & 0xFFFFFF): n for k, n in zip(keys.tolist(), times.tolist())} == want and (np.diff(keys) > 0).all()


def test_small_steps(spark, tools, monkeypatch):
    """Batches and slices of side ids of a few rows."""
    for name, n in (("BATCH_DOCS", 2), ("SLICES", 400)):
        monkeypatch.setattr(alignment, name, n)
    assert found(alignment.align(table(spark, ODD, 2))) == brute(ODD, tools)


def test_long_space_with_either_encoder(spark, tools):
    rows = [(1, "x" + " " * 1_200_000 + "b"), (2, "x b")]
    assert found(alignment.align(table(spark, rows))) == brute(rows, tools)


def test_whole_table(spark, sf_dir, tools):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(alignment.align(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], tools)


def test_ids_are_those_of_the_slower_encoder(tools):
    with open(f"{TOP}/byte_bpe_50k.json", "rb") as f, open(f"{TOP}/piece_bpe_32k.model", "rb") as g:
        sides = alignment.Sides(f.read(), g.read())
    texts = [f" ab{chr(c)}cd 12{chr(c)}34 {chr(c)} {chr(c)}x, {chr(c)}!  {chr(c)}" for c in [*range(0xD800), *range(0xE000, 0x110000, 7)] if c]
    assert [sides._fast.encode_ordinary(t) for t in texts] == [e.ids for e in tools[0].encode_batch(texts, add_special_tokens=False)]
