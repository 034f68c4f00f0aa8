import random

import pytest
from quarrysift.llm import tokens as K
from tokenizers import Tokenizer

PATH = K.vocabulary("word_bpe_49k.json")


def plain(text):
    return len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


TEXTS = [
    None, "", " ", "The quick brown FOX", "don't we'll I'Ve o'clock 'tis ''''s", "a\x1cb\x85c\u00a0d\u3000e", "caf\u0065\u0301 \u0301x ΣΑΣ Σ ς",
    "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|> a<|endoftext|>b", "x1y22z ½ ² Ⅷ ٣", "hello,world!?...  $$%%% &&&the", "日本語 テキスト 한국어", "a" * 5000, "\n\n\t tab\x0bvt\x0cff\rcr", "I\u0307 İstanbul ẞ ﬁ",
]


def test_against_library(spark):
    rnd = random.Random(3)
    chars = "abcdeABC '.,!?0123é\u0301ß\n\t\u00a0<|>"
    texts = TEXTS + ["".join(rnd.choice(chars) for _ in range(rnd.randrange(200))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, doc string")
    got = {r.doc_id: (r.b, r.t) for r in K.token_counts(df, PATH).selectExpr("doc.doc_id", "n_bytes b", "n_tokens t").collect()}
    assert got == {i: (len((t or "").encode()), plain(t)) for i, t in enumerate(texts)}


def test_whole_tokens_prove_themselves():
    t = Tokenizer.from_file(PATH)
    whole = K.whole_tokens(t)
    assert len(whole) > 20_000 and all(len(t.encode(w, add_special_tokens=False).ids) == 1 for w in sorted(whole)[::97])


def test_empty(spark):
    assert K.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("text", TEXTS[3:6])
def test_chunks_join(text):
    c = K.Counter(PATH)
    chunks = text.encode().split()
    c.learn(set(chunks))
    assert c.count(chunks) == plain(text)


def test_latin_letters_against_library():
    """Every printable Latin-1 sign alone, among letters, and in random words."""
    rnd = random.Random(8)
    signs = [chr(c) for c in range(33, 256) if chr(c).isprintable()]
    words = [w for s in signs for w in (s, f"a{s}b", f"{s}{s}1{s}")] + ["".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 9))) for _ in range(3000)]
    words += ["".join(rnd.choice("aeéèêàçöüßñÉÜnrst") for _ in range(rnd.randrange(1, 9))) for _ in range(3000)]
    c, t = K.Counter(PATH), Tokenizer.from_file(PATH)
    chunks = [w.encode() for w in words]
    c.learn(set(chunks))
    want = [len(e.ids) for e in t.encode_batch(words, add_special_tokens=False)]
    assert [c.count([x]) for x in chunks] == want
