"""The training-data operators against brute force, and on rows that are odd."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from rillwood.llm import chat, decontamination, exact_dedup, language_id, mixing, quality, sharding, substring_dedup

ODD = "doc_id long, text string, lang string, source string, n_chars long, doc int, key string, DIGEST string, rank int, shard string, score string"


def odd(spark, texts):
    """Rows with nulls everywhere, repeated ids, and extra columns whose names operators use themselves."""
    rows = [(i, t, None, None, None, 1, "k", "d", 2, "s", "x") for i, t in texts]
    return spark.createDataFrame(rows, ODD)


TEXTS = [(None, None), (None, None), (1, ""), (1, "a b"), (2, "a b"), (2, "a b"), (3, " \t "), (4, "word " * 30_000), (5, "A B")]


# -- exact dedup -------------------------------------------------------------------------------------------------------


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(odd(spark, TEXTS)).collect()
    groups = {}
    for i, t in TEXTS:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    want = []
    for i, t in TEXTS:
        g = groups[(t or "").encode().lower()]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode().lower()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(odd(spark, [])).count() == 0


def test_index_outranks_what_comes(spark):
    index = exact_dedup.DigestIndex(spark, "digest_index_test", 4)
    first = exact_dedup.exact_dedup(odd(spark, [(1, "x"), (2, "y")]), index=index)
    assert {r.doc_id: r.kept for r in first.collect()} == {1: True, 2: True}
    more = exact_dedup.exact_dedup(odd(spark, [(9, "X"), (8, "z")]), index=index)
    assert {r.doc_id: (r.keep_id, r.kept) for r in more.collect()} == {9: (1, False), 8: (8, True)}
    assert index.read().count() == 3
    index.drop()
    assert not index.exists()


# -- sharding ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4096, 4097])
def test_feistel_permutes(n):
    place = sharding.feistel(np.arange(n), n, 7)
    assert sorted(place.tolist()) == list(range(n))
    assert n < 100 or (place != sharding.feistel(np.arange(n), n, 8)).any()


def test_shards_are_even_and_repeatable(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = ({r.doc_id: tuple(r) for r in sharding.shard_documents(d).collect()} for d in (docs, docs.repartition(5)))
    assert a == b
    slots = {}
    for i, size, crc, law, shard, slot, grown in a.values():
        slots.setdefault(shard, []).append(slot)
        assert law == "rows" and grown is None
    sizes = [len(s) for s in slots.values()]
    assert len(slots) == 16 and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for r in docs.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        assert a[r.doc_id][1:3] == (len(raw) + 1, zlib.crc32(raw))


def feistel_of_one(x, n, seed):
    half = 1
    while 1 << 2 * half < n:
        half += 1
    mask, big = (1 << half) - 1, (1 << 64) - 1
    while True:
        left, right = x >> half, x & mask
        for a, b in sharding._keys(seed):
            m = ((right ^ b) * a) & big
            m = ((m ^ (m >> 29)) * 0x94D049BB133111EB) & big
            left, right = right, left ^ ((m >> 32) & mask)
        x = left << half | right
        if x < n:
            return x


def test_shards_match_one_row_at_a_time(spark, sf_dir):
    """Shard and slot of every document from its number in the order of (piece, id), by a permutation of single numbers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    facts = docs.selectExpr("doc_id", "crc32(cast(coalesce(text, '') as binary)) AS crc", "octet_length(coalesce(text, '')) + 1L AS size")
    rows = facts.selectExpr("doc_id", "crc", "size", "pmod(xxhash64(doc_id, crc, size), 4096) AS piece").collect()
    numbered = sorted(rows, key=lambda r: (r.piece, r.doc_id, r.crc, r.size))
    want = {r.doc_id: divmod(feistel_of_one(k, len(rows), 7), 16)[::-1] + (r.size, r.crc) for k, r in enumerate(numbered)}
    got = {r.doc_id: (r.shard, r.slot, r.size, r.text_crc32) for r in sharding.shard_documents(docs).collect()}
    assert got == want


def test_shards_of_odd_rows(spark):
    got = sharding.shard(odd(spark, TEXTS), ["doc_id", "text"], 4).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(4) for k in range(3)][:9] or len({(r.shard, r.slot) for r in got}) == 9
    assert sharding.shard_documents(odd(spark, [])).count() == 0


# -- mixing ------------------------------------------------------------------------------------------------------------


def test_mix_holds_its_weights(spark):
    rows = [(i, "s0" if i % 3 == 0 else f"s{1 + i % 5}", "t") for i in range(900)]
    block, docs = 4, spark.createDataFrame(rows, "doc_id long, source string, rank string")
    got = sorted(mixing.mix(docs, block=block).collect(), key=lambda r: r.mix_position)
    assert {r.doc_id for r in got} == set(range(900)) and got[0].asDict().keys() == {"doc_id", "source", "rank", "mix_position", "mix_epoch"}
    counts = mixing.write_table(mixing.source_counts(docs, "source", 251, "doc_id"), "t")
    weight = {r.src: r.c / r.h for r in mixing.blended_slots(counts, 1000, 3, 1).collect()}
    assert abs(sum(weight.values()) - 1) < 1e-9
    blocks = sorted({(r.mix_position // block, r.source) for r in got})
    seen = dict.fromkeys(weight, 0)
    full = blocks[: len(blocks) - len(weight)]  # the last blocks may be short or absent
    for slot, source in full:
        seen[source] += 1
        for s, w in weight.items():
            assert abs(seen[s] - w * (slot + 1)) < 1 + 1e-9
    assert len({r.mix_position for r in got}) == len(got)


def test_mix_of_a_row_that_comes_often(spark):
    """One row alone in its source comes again until the others are through, from many tasks."""
    docs = spark.range(40_000).selectExpr("id AS doc_id", "if(id = 7, 'rare', 'common') AS source")
    got = mixing.mix(docs, all_columns=False).collect()
    often = sorted(r.mix_epoch for r in got if r.doc_id == 7)
    assert often == list(range(len(often))) and len(often) > 2 * mixing.CHUNK
    assert len({r.mix_position for r in got}) == len(got) and {r.doc_id for r in got} == set(range(40_000))


def test_mix_of_many_sources(spark):
    docs = spark.range(3_000).selectExpr("id AS doc_id", "concat('s', id % 1500) AS source")
    got = mixing.mix(docs, block=1, all_columns=False).collect()
    assert {r.doc_id for r in got} == set(range(3_000)) and len({r.mix_position for r in got}) == len(got)
    seen = {}
    for r in sorted(got, key=lambda r: r.mix_position):
        seen[r.source] = seen.get(r.source, 0) + 1
        assert abs(seen[r.source] - (r.mix_position + 1) / 1500) < 1.001  # equal sources: a block each 1500


def test_mix_of_odd_rows(spark):
    got = mixing.mix(odd(spark, TEXTS)).collect()
    assert len(got) == 9 and all(r.mix_epoch == 0 for r in got)
    assert mixing.mix(odd(spark, [])).count() == 0


# -- decontamination -----------------------------------------------------------------------------------------------------


def brute_hits(text, items):
    w, hit, found = decontamination.words_of((text or "").encode()), set(), set()
    for item, t in items:
        iw = decontamination.words_of((t or "").encode())
        for k in range(max(1, len(iw) - 9) if iw else 0):
            window = iw[k : k + 10]
            for s in range(len(w) - len(window) + 1):
                if w[s : s + len(window)] == window:
                    hit.update(range(s, s + len(window)))
                    found.update([] if item is None else [str(item)])  # an item without an id hits all the same
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [16_000_000, 200])
def test_decontamination(spark, block_bytes, monkeypatch):
    rng = random.Random(2)
    word = lambda: rng.choice(["ab", "cd", "EF", "g1", "é"])
    items = [(k, " ".join(word() for _ in range(rng.choice([2, 9, 10, 14])))) for k in range(8)] + [(90, None), (None, "ab cd"), (91, "..")]
    texts = [(i, ", ".join(word() for _ in range(60))) for i in range(20)] + [(50, None), (51, ""), (None, items[0][1]), (52, items[3][1].upper())]
    find = decontamination.find_benchmark
    monkeypatch.setattr(decontamination, "find_benchmark", lambda d, b: find(d, b, block_bytes=block_bytes))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination_report(odd(spark, texts), bench).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *brute_hits(t, items)) for i, t in texts], key=str)
    assert find(odd(spark, texts), bench.limit(0)).filter("size(hit_items) > 0").count() == 0
    assert find(odd(spark, []), bench).count() == 0


# -- chat ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", "&amp; & &lt;", "]]>[ROLE:x]", "é\n\x00"])
def test_template_round_trip(text):
    turns = [("user", text), ("assistant", text), (text, text), ("assistant", "x")]
    formatted, mask = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in zip(mask[::2], mask[1::2], strict=True)] == [text, "x"]
    assert formatted.count(chat.ASSISTANT_END) == 2


def test_reply_trees(spark):
    rows = [("t", 1, None, 0.0, "user", "q"), ("t", 2, 1, 1.0, "assistant", "a"), ("t", 3, 1, 5.0, "assistant", "b"), ("t", 4, 2, 9.0, "user", "c"), ("t", 5, 99, 2.0, "user", "lost parent"), ("u", 1, 2, 1.0, "user", "cycle"), ("u", 2, 1, 1.0, "user", "cycle"), ("v", 1, None, None, None, None)]
    messages = spark.createDataFrame(rows, "tree string, msg long, parent long, score double, role string, text string")
    paths = {(r.tree, r.leaf): (r.path, round(r.score, 6)) for r in chat.reply_paths(messages).collect()}
    assert paths == {("t", 4): ([1, 2, 4], round(10 / 3, 6)), ("t", 3): ([1, 3], 2.5), ("t", 5): ([5], 2.0), ("v", 1): ([1], 0.0)}
    best = {(r.tree, r.rank): chat.parse_turns(r.formatted) for r in chat.format_trees(messages, 2).collect()}
    assert best == {("t", 1): [("user", "q"), ("assistant", "a"), ("user", "c")], ("t", 2): [("user", "q"), ("assistant", "b")], ("v", 1): [("", "")]}


def test_odd_conversations(spark):
    df = spark.createDataFrame([(None, 1, "user", None, 1), (7, 2, None, "x", 1), (7, 1, "assistant", "y" * 50_000, 1), (7, 1, "assistant", "y" * 50_000, 1)], "conv_id long, turn long, role string, text string, msg int")
    got = {r.conv_id: r for r in chat.conversation_digests(df).collect()}
    assert got.keys() == {None, 7, -1} and got[7].n_turns == 3 and got[7].loss_chars == 100_000
    assert got[-1].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    assert {r.conv_id for r in chat.conversation_digests(df.limit(0)).collect()} == {-1}


# -- language ------------------------------------------------------------------------------------------------------------


def test_languages_are_told_apart(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)


def test_language_is_the_smallest_encoding(spark, sf_dir):
    """Every prediction of the query against Zstandard itself, text by text."""
    import zstandard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = language_id.train_dictionaries(docs, language_id.crc_mod(language_id.F.col("doc_id"), 4) == 2)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_report(docs).collect()}
    params = zstandard.ZstdCompressionParameters(**language_id._PARAMS, write_checksum=False, write_content_size=False, write_dict_id=False)
    for r in docs.collect():
        raw, sizes = (r.text or "").encode(), {}
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        for lang, d in learned.items():
            encoder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            sizes[lang] = sum(len(encoder.compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048))
        first, second = sorted(sizes.values())[:2]
        margin = (second - first) / first
        assert sizes[got[r.doc_id][0]] == first and abs(got[r.doc_id][1] - margin / (margin + 0.01)) < 1e-12


def test_language_of_odd_rows(spark):
    learned = {"aa": b"the one and the other " * 40, "bb": "être là où ça va ".encode() * 40}
    got = {r.doc_id: r for r in language_id.identify(odd(spark, [(1, None), (2, "12 !?"), (3, "the one and the other one"), (4, "où ça va être là"), (5, "")]), learned).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["und", "und", "aa", "bb", "und"]
    assert got[1].score == 0 and got[3].source is None
    assert language_id.language_report(odd(spark, TEXTS)).filter("lang_pred <> 'und'").count() == 0  # nothing to learn from
    assert language_id.language_report(odd(spark, [])).count() == 0


# -- quality -------------------------------------------------------------------------------------------------------------


def test_quality_on_labels_it_has_not_seen(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    taught = labels.filter("doc_id % 4 > 0")
    got = quality.score_quality(docs, taught).join(labels.filter("doc_id % 4 = 0"), "doc_id").collect()
    good = [r.accepted for r in got if r.quality == 1 and r.toxic == 0]
    junk = [r.accepted for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.9 and sum(junk) / len(junk) < 0.15


def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    n, y = 300, None
    y = rng.integers(0, 2, n).astype(float)
    xt, xm = y[:, None] * 2 + rng.normal(size=(n, 1)), y[:, None] * 2 + rng.normal(size=(n, 1))
    m = quality.co_train({}, xt[:40], xm[:40], y[:40], np.arange(40) % 4 == 0, quality.pick_from(np.arange(160), xt[40:200], xm[40:200]))
    p, a, b = m.score(xt[200:], xm[200:])
    assert ((p > 0.5) == y[200:]).mean() > 0.85


def test_rounds_over_all_documents_match_arrays(spark, sf_dir, monkeypatch):
    """The rounds over the whole table against the same rounds over arrays of all documents."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = {}

    def keep(vocabulary, xt, xm, y, fold, pick):
        seen.update(args=(vocabulary, xt, xm, y, fold))
        return train(vocabulary, xt, xm, y, fold, pick)

    train = quality.co_train
    monkeypatch.setattr(quality, "co_train", keep)
    got = quality.fit_quality(docs, labels, pseudo=15, sure=0.6)
    clear = {r.doc_id for r in labels.collect()}
    rest = [r for r in docs.collect() if r.doc_id not in clear]
    assert len(rest) > 50
    ut = np.stack([quality.text_row((r.text or "").encode(), seen["args"][0]) for r in rest])
    um = np.stack([quality.meta_row(r.source, r.lang, r.n_chars) for r in rest])
    want = train(*seen["args"], quality.pick_from(np.array([r.doc_id for r in rest]), ut, um, 15, 0.6))
    for a, b in zip((got.text, got.meta, got.blend), (want.text, want.meta, want.blend), strict=True):
        assert np.allclose(a.weights, b.weights, atol=1e-6)
    alone = train(*seen["args"], lambda judges, given: [])
    assert not np.allclose(alone.text.weights, got.text.weights, atol=1e-3)  # labels were exchanged


def test_an_id_is_given_one_label_a_view(spark):
    """500 rows of one id among 100 others: it takes one place, and the others take theirs."""
    rng = np.random.default_rng(1)
    judge = (quality.Logistic(np.array([4.0, 0.0]), np.zeros(1), np.ones(1)), quality.Logistic(np.array([1.0, 0.0]), np.zeros(1), np.ones(1)))
    ids, x = np.append(np.full(500, 7), np.arange(1000, 1100)), np.append(np.full(500, 9.0), rng.uniform(2, 5, 100))[:, None]
    ((label, rows, _), _) = quality.picked(ids, x, judge, set(), 60, 0.5)
    assert label == 1.0 and len(rows) == 60 == len(set(ids[rows].tolist())) and 7 in ids[rows]
    best = sorted(range(500, 600), key=lambda r: -x[r, 0])[:40]
    assert set(ids[best].tolist()) <= set(ids[rows].tolist())


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(odd(spark, TEXTS), labels)
    assert got.count() == 9 and len(got.columns) == 15
    assert quality.score_quality(odd(spark, TEXTS), labels.limit(0)).filter("quality_score IS NULL").count() == 0
    assert quality.keep_good(odd(spark, []), labels).columns == odd(spark, []).columns


# -- substrings ----------------------------------------------------------------------------------------------------------


def brute_removed(rows, window):
    starts = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    key = lambda i: substring_dedup.NO_ID if i is None else i
    for i, w in words:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            starts[s] = min(starts.get(s, key(i)), key(i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k : k + window])] < key(i):
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 300}, {"hold_bytes": 500, "piece": 2}])
def test_substrings(spark, options):
    rng, passage = random.Random(4), [f"p{k}" for k in range(12)]
    rows = []
    for i in range(25):
        w = [rng.choice("abcdefgh") for _ in range(rng.choice([3, 8, 20]))]
        at = rng.randrange(len(w))
        rows.append((rng.choice([i, i, 3, None]), " ".join(w[:at] + passage[rng.randrange(4) :] + w[at:])))
    rows += [(7, None), (8, ""), (9, "x " * 300), (10, "x " * 40), (11, " ".join(passage)), (11, " ".join(passage))]
    got = substring_dedup.drop_repeats(odd(spark, rows), window=8, **options)
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got.collect()]
    assert sorted(got, key=str) == brute_removed(rows, 8)


def test_substrings_of_nothing(spark):
    assert substring_dedup.repeats_report(odd(spark, [])).count() == 0


# -- what a task of substring deduplication holds ----------------------------------------------------------------------


def test_repeats_count_in_what_is_held():
    """A million repeats of one passage: 32 bytes each, counted, and given on in pieces."""
    held, text = substring_dedup._Holder(), b"w " * 60
    for doc in range(1_000_000, 0, -1):
        held.add(doc, 1, 77, 0, 5, text)
    assert 32_000_000 <= held.size < 33_000_000 and len(held.repeats) * held.repeats.itemsize < held.size
    spans = set()
    for batch in held.flush(64):
        for n, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if n == 0:
                assert len(data) <= 1_600_000
                spans.update(map(tuple, np.frombuffer(data, np.int64).reshape(-1, 4).tolist()))
    assert spans == {(d, 1, 0, 5) for d in range(2, 1_000_001)} and held.size == 0


def test_held_repeats_are_flushed(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"a{i} {passage} b{i}") for i in range(300)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.n_removed for r in substring_dedup.drop_repeats(docs, hold_bytes=2_000).collect()}
    assert got == {i: 60 * (i > 0) for i in range(300)}


def test_buckets_follow_the_input():
    assert substring_dedup.bucket_count(0, 8) == 8 * substring_dedup.BUCKETS
    assert substring_dedup.bucket_count(100_000_000_000_000, 200) * 2_000_000 >= 8 * 100_000_000_000_000  # some 2 MB of packed strings each
