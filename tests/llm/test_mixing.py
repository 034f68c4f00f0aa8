import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from quarrysift.llm import mixing as M


def slow_keys(texts):
    """Plain contexts of every byte: up to five bytes of the text, the word so far, and the word before."""
    out = []
    for words in texts:
        for i, w in enumerate(words):
            upto = b" ".join(words[:i]) + b" " * (i > 0)
            for j in range(len(w) + 1):
                seen = b" " * 5 + upto + w[:j]
                out.append([seen[len(seen) - k :] for k in M.ORDERS] + [w[:j], (words[i - 1] if i else None, w[:j])])
    return out


TEXTS = [[b"banana", b"ananas", b"a"], ["été".encode(), b"a", b"banana"], [b"x" * 400, b"banana", b"ananas"], [b"ananas"], [b"a"]]


def test_equal_contexts_share_slots():
    (p,) = M.pieces(TEXTS)
    assert p.data.tobytes() == b"".join(b" ".join(t) + b" " for t in TEXTS) and p.texts.tolist() == [0, 16, 31, 446, 453]
    keys = slow_keys(TEXTS)
    for k in range(M.PREDICTORS):
        by = {}
        for key, s in zip(keys, p.hashes[k].tolist(), strict=True):
            assert by.setdefault(key[k], s) == s < 1 << M.TABLE_BITS[k]
        assert len(by) - len(set(by.values())) < 8


@pytest.mark.parametrize("size", [1, 7, 64])
def test_pieces_of_any_size_agree(size):
    whole = [p for t in TEXTS for p in M.pieces([t])]
    small = [p for t in TEXTS for p in M.pieces([t], size)]
    for ask in (lambda p: p.data, lambda p: p.hashes, lambda p: p.ended):
        assert np.array_equal(np.concatenate([ask(p) for p in whole], axis=-1), np.concatenate([ask(p) for p in small], axis=-1))


def slow_scores(rows, held):
    """The model by plain loops, given the slots of ``pieces``; the texts are shorter than a range, so that weights stay as they begin."""
    texts = {i: (t or "").encode().lower().split() for i, (_, t) in enumerate(rows)}
    train = [i for i in texts if not held(rows[i][0])]
    n_bytes = Counter(x for i in train for w in texts[i] for x in w + b" ")
    code = M.Code([n_bytes[v] for v in range(256)])
    path = [[(int(code.node[code.offset[v] + j]), int(code.bit[code.offset[v] + j])) for j in range(code.length[v])] for v in range(256)]
    slots = {i: next(M.pieces([texts[i]])).hashes if texts[i] else None for i in texts}
    counts = Counter()

    def coded(i):
        for at, byte in enumerate(b" ".join(texts[i]) + b" "):
            yield at, [[(k, int(slots[i][k][at]) ^ node) for k in range(M.PREDICTORS)] for node, _ in path[byte]], [b for _, b in path[byte]]

    for i in train:
        for _, nodes, bits in coded(i) if texts[i] else ():
            for s, b in zip(nodes, bits, strict=True):
                counts.update((x, b) for x in s)

    def inputs(s, b, own):
        z, o = [[max(0, counts[x, v] - (own and b == v)) for x in s] for v in (0, 1)]
        return np.clip(np.rint(np.log((np.array(o) + M.PRIOR) / (np.array(z) + M.PRIOR)) / M.STEP), -127, 127)

    def gated(nodes, bits, own):
        return sum((inputs(nodes[0], bits[0], own)[M.PREDICTORS - M.GATED + j] != 0) << j for j in range(M.GATED))

    weights = np.full((M.GATES, M.PREDICTORS), M.FIRST * M.STEP)
    parts, after = {}, {}
    for i, words in texts.items():
        own = i in train
        spelt, at = [], -1
        for at, nodes, bits in coded(i) if words else ():
            g = gated(nodes, bits, own)
            cost = -sum(math.log10(1 + math.exp((1 - 2 * b) * np.clip(inputs(s, b, own) @ weights[g], -12, 12))) for s, b in zip(nodes, bits, strict=True))
            if at == 0 or (b" ".join(words) + b" ")[at - 1] == 32:
                spelt.append(0.0)
            spelt[-1] += cost
        better, out, tries, hits = [], [], Counter(), Counter()
        for j, w in enumerate(words):
            cache, gate = words[:j].count(w) / max(1, j), sum(better[-3:])
            weight = 0.0 if j == 0 else min(1 - 1e-3, max(1e-3, (M.SELF[gate] * M.SELF_WEIGHT + hits[gate]) / (M.SELF_WEIGHT + tries[gate])))
            better.append(cache > 3 * 10 ** spelt[j])
            tries[gate] += 1
            hits[gate] += better[-1]
            out.append(math.log10(weight * cache + (1 - weight) * 10 ** spelt[j]))
        if words:
            ids = np.concatenate([p.ended for p in M.pieces([words])])
            cuts = [0] + [j for j in range(2, len(words)) if int((int(ids[j - 1]) * 0x9E3779B97F4A7C15 + int(ids[j - 2])) * 0xC2B2AE3D27D4EB4F % 2**64 >> 32) % M.SEGMENT == 0] + [len(words)]
            parts[i] = [(tuple(words[a:b]), sum(out[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
        else:
            parts[i] = []
        after[i] = {(a[0], b[0]) for a, b in zip(parts[i], parts[i][1:], strict=False)}
    same = Counter(x for i in train for x in after[i])
    every = Counter()
    for (a, _), c in same.items():
        every[a] += c
    found = {}
    for i in texts:
        own = int(i in train)
        for j, (a, b) in enumerate(zip(parts[i], parts[i][1:], strict=False), 1):
            mine = sum(x == a[0] for x, _ in after[i])
            found[i, j] = (same[a[0], b[0]] - own, every[a[0]] - own * mine)
    tries, hits = Counter(), Counter()
    for (i, _), (s, e) in found.items():
        if e > 0 and i in train:
            tries[min(4, int(math.log2(e)))] += 1
            hits[min(4, int(math.log2(e)))] += s > 0
    n = sum(len(texts[i]) + 1 for i in train)
    ends = (len(train) + 0.5) / (n + 1)
    scores = []
    for i, words in texts.items():
        total = len(words) * math.log10(1 - ends) + math.log10(ends)
        for j, (_, cost) in enumerate(parts[i]):
            s, e = found.get((i, j), (0, 0))
            gate = min(4, int(math.log2(e))) if e > 0 else None
            trust = 0 if gate is None else (hits[gate] + 0.5) / (tries[gate] + 1) if tries[gate] else 0.5
            total += math.log10(trust * s / e + (1 - trust) * 10**cost) if s > 0 and e > 0 else cost + math.log10(1 - trust)
        scores.append(total)
    return scores


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    syllables = ["th", "er", "on", "an", "ing", "re", "ou", "ble"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.choice([1, 1, 2, 3, 4])))
    out = [(i, rnd.choice([" ", "\n"]).join(word() for _ in range(rnd.randrange(120))).capitalize()) for i in range(400)]
    return out + [(900, None), (901, ""), (902, "é É ß"), (7, out[7][1]), (None, "the THE the")]


@pytest.mark.parametrize("frequent", [M.FREQUENT, 5])
def test_scores(spark, rows, frequent):
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, words int, held_out string")
    got = M.score_texts(df, frequent=frequent).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split() + ["\0end"]
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out]
    bits = sum(r.bits_per_byte * max(1, len((dict(rows)[r.doc_id] or "").encode())) for r in out) / sum(max(1, len((dict(rows)[r.doc_id] or "").encode())) for r in out)
    assert bits < 2.6  # an even choice among the alphabet would take over 3
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)


def test_scores_against_plain_loops(spark, rows):
    """Repeats, copies, held-out rows and a text of one word, in several partitions."""
    some = [(d, t and t[:300]) for d, t in rows[:26]] + [(50 + d, t and t[:300]) for d, t in rows[:8]] + rows[400:]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    want = sorted(zip(map(str, (d for d, _ in some)), slow_scores(some, held), strict=True))
    got = M.score_texts(spark.createDataFrame(some, "doc_id long, text string").repartition(3)).collect()
    got = sorted((str(r.doc_id), r.score) for r in got)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-4)


def test_twins_stand_out(spark, rows):
    df = spark.createDataFrame(rows[:300] + [(1000 + i, rows[i][1]) for i in range(20)], "doc_id long, text string")
    got = {r.doc_id: r for r in M.score_texts(df).collect()}
    told = {a for i in range(20) for a, b in ((i, 1000 + i), (1000 + i, i)) if not got[b].held_out}  # by a twin that is learnt from
    twins = [r.bits_per_byte for i, r in got.items() if i in told and r.n_tokens > 60]
    alone = [r.bits_per_byte for i, r in got.items() if i not in told and r.n_tokens > 60]
    assert max(twins) < min(alone)


def test_own_words_of_all_texts_sum_to_at_most_one():
    """Words of given probabilities: those of all texts of four words add up."""
    import itertools

    costs = np.log10([0.3, 0.2, 0.4, 0.1])
    total = 0.0
    for text in itertools.product(range(4), repeat=4):
        total += 10 ** M.own_words(np.array(text, np.uint64), costs[list(text)], np.array([0])).sum()
    assert 0.99 < total <= 1.0 + 1e-9
    many = [np.array(t, np.uint64) for t in ([0, 1, 0, 0, 1], [2, 2, 2], [1], [0, 0, 3])]
    alone = [M.own_words(t, costs[t.astype(int)], np.array([0])) for t in many]
    ids = np.concatenate(many)
    assert np.allclose(M.own_words(ids, costs[ids.astype(int)], np.array([0, 5, 8, 9])), np.concatenate(alone))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert M.score_texts(df).count() == 0
    one = spark.createDataFrame([(0, "a b")], "doc_id long, text string")
    from pyspark.sql import functions as F

    r = M.score_texts(one, F.lit(True)).first()
    assert (r.n_known, r.train_tokens, r.n_tokens) == (0, 0, 3) and r.score < 0


def slow_spell(model, words, own):
    """Each byte's cost by plain loops; the weights take a step after every range."""
    (p,) = M.pieces([words], 1 << 20)
    code, begin = model.code, M._BEGIN.tolist()
    weights, cost, at = np.full((M.GATES, M.PREDICTORS), M.FIRST * M.STEP), [], 0
    while at < len(p.data):
        to = min(len(p.data), at + (M.RANGE if at < M.LATER else M.LATER))
        up, norm = np.zeros((2, M.GATES, M.PREDICTORS))
        for i in range(at, to):
            first, n = code.offset[p.data[i]], code.length[p.data[i]]
            x = np.empty((n, M.PREDICTORS))
            for j in range(n):
                bit = int(code.bit[first + j])
                slots = [begin[k] + (int(p.hashes[k, i]) ^ int(code.node[first + j])) for k in range(M.PREDICTORS)]
                x[j] = [model.less[2 * s + bit] if own else model.all[s] for s in slots]
            gate = sum((x[0, M.PREDICTORS - M.GATED + j] != 0) << j for j in range(M.GATED))
            t, b = np.clip(x @ weights[gate], -12, 12), code.bit[first : first + n].astype(int)
            cost.append(np.log10(1 + np.exp((1 - 2 * b) * t)).sum())
            up[gate] += (1 / (1 + np.exp(-t)) - b) @ x
            norm[gate] += (x * x).sum(axis=0)
        weights -= M.RATE * up / np.maximum(1e4, norm)
        at = to
    return -np.add.reduceat(cost, p.starts)


@pytest.mark.parametrize("own", [True, False])
def test_weights_learn_within_texts_of_any_length(own):
    rnd = random.Random(11)
    word = lambda: b"".join(rnd.choice([b"th", b"er", b"on", b"an", b"ing"]) for _ in range(rnd.choice([1, 2, 3])))
    texts = [[word() for _ in range(n)] for n in (300, 1, 90, 500, 1500, 20, 15000)]
    assert len(b" ".join(texts[2])) < M.RANGE < len(b" ".join(texts[0])) < 4096 and len(b" ".join(texts[-1])) > M.PIECE
    n_bytes = Counter(x for t in texts for w in t for x in w + b" ")
    counts = M.Counts(M.Code([n_bytes[v] for v in range(256)]))
    counts.add(texts)
    counts.flush()
    x = M.stretch(counts.n)
    model = M.Model(counts.code, x[0], np.ascontiguousarray(x[1:].T).ravel())
    got, _ = M.spell(model, texts, own)
    assert np.allclose(got, np.concatenate([slow_spell(model, t, own) for t in texts]), rtol=1e-3, atol=1e-4)


def test_counting_holds_little_beside_its_table():
    import tracemalloc

    rnd = random.Random(2)
    text = [bytes(rnd.choices(b"abcdefgh", k=7)) for _ in range(400_000)]
    tracemalloc.start()
    counts = M.Counts(M.Code([1] * 256))
    counts.add([text])
    counts.flush()
    most = tracemalloc.get_traced_memory()[1] - counts.n.nbytes
    tracemalloc.stop()
    assert most < 100e6
