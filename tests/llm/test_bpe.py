import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from stratafold.llm import bpe

WORD, BYTE = public_tokenizers.path(bpe.WORD_BPE), public_tokenizers.path(bpe.BYTE_BPE)
PARTS = ["the", "ing", "é", "ß", "'s", "'", "!", "1", "23", "<|endoftext|>", "İ", "Σ", "ΑΣ", "́", "\u0085", "\x1c", "漢字", "　", "th", "...", "🙂", "<|", "</w>", "x" * 700]


def texts(n=150, seed=1):
    rnd = random.Random(seed)
    for _ in range(n):
        seps = [" ", "\n", "  ", "\t"] * rnd.choice([0, 0, 1, 3])
        yield "".join(rnd.choice(PARTS + seps) for _ in range(rnd.choice([2, 30, 300])))


def whole(t, size=1 << 16, least=bpe.OPEN):
    enc = bpe.encoder(WORD)
    ids, text = bpe.concat_all([bpe.leaf_piece(x, enc, least) for x in bpe.leaves(t.encode(), size)], enc, least)
    return [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)], text.decode(), ids


def test_equals_library():
    tok = bpe.tokenizer(WORD)
    for t in texts():
        want = tok.encode(t, add_special_tokens=False).ids
        for size, least in ((1 << 16, 2048), (64, 2048), (7, 2048), (64, 1), (300, 20), (7, 1)):
            ids, text, raw = whole(t, size, least)
            assert ids == want and text == tok.decode(want, skip_special_tokens=False) == bpe.decode(raw, WORD)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_any_text(t):
    assert whole(t, 9)[0] == whole(t, 9, 1)[0] == bpe.tokenizer(WORD).encode(t, add_special_tokens=False).ids
    assert counted(t) == len(bpe.tokenizer(BYTE).encode(t, add_special_tokens=False).ids)


def test_tree_on_unsplit_text():
    model = bpe.tokenizer(WORD).model
    rnd = random.Random(3)
    for n in (1, 129, 1000, 5000):
        s = "".join(rnd.choice("aeinrst") for _ in range(n))
        assert [i for _, _, i in bpe.tree_tokens(model, s)] == [t.id for t in model.tokenize(s)]
    assert [i for _, _, i in bpe.tree_tokens(model, "a" * 3001, 8, 2)] == [t.id for t in model.tokenize("a" * 3001)]


def test_unsplit_text_in_leaves():
    tok, rnd = bpe.tokenizer(WORD), random.Random(5)
    cases = ["a" * 70001, "".join(rnd.choice("aeinrst") for _ in range(60000)), "".join(rnd.choice(["the", "ing", "é", "'s", "'", "!!", "7", "漢", "ß", "🙂"]) for _ in range(30000)), "ab" * 20000 + " end", "!'" * 9000 + "s" + "x" * 9000]
    for t in cases:
        want = tok.encode(t, add_special_tokens=False).ids
        for size in (1 << 15, 5000, 4097):
            ids, text, _ = whole(t, size)
            assert ids == want and text == tok.decode(want, skip_special_tokens=False)


def counted(t):
    return sum(bpe.piece_tokens(p, bpe.tokenizer(BYTE), {}, 10) for p in bpe.pieces(t))


def test_counts(spark):
    tok, all_ = bpe.tokenizer(BYTE), [*texts(100, 2), "", None, "x" * 9000, "the the the"]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(all_)], "doc_id long, text string, n string").repartition(3)
    want = {k: len(tok.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(all_)}
    # all broadcast; nearly all joined; nearly all keys colliding; tasks that let go early
    for most, key in ((1 << 17, bpe.piece_key), (3, bpe.piece_key), (3, lambda p: len(p) % 5)):
        assert {r["doc_id"]: r["n_tokens"] for r in bpe.token_counts(df, BYTE, most=most, key=key).collect()} == want
    one = bpe.distinct_pieces(df.select(bpe.F.coalesce("text", bpe.F.lit("")).alias("text")), BYTE, held=5)
    every = [p for t in all_ for p in bpe.pieces(t or "") if len(p) <= bpe.LONG_PIECE]
    got = {r["word"]: (r["c"], r["same"]) for r in one.collect()}
    assert one.count() == len(got) == len(set(every)) and all(got[p] == (every.count(p), 1) for p in got)


def test_odd_documents(spark, odd_docs, no_docs):
    tok = bpe.tokenizer(WORD)
    got = bpe.encode(odd_docs, WORD, split_bytes=1000).collect()
    want = sorted((r["doc_id"] or 0, len(tok.encode(r["text"] or "", add_special_tokens=False).ids) * 4) for r in odd_docs.collect())
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in got) == want
    assert bpe.encode(no_docs, WORD).count() == 0 and bpe.token_counts(no_docs, BYTE).count() == 0
    assert {r["n_tokens"] for r in bpe.token_counts(odd_docs, BYTE).where("doc_id in (1, 2)").collect()} == {0}
