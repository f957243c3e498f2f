"""Language-model scores, whitening and alignment against brute force, with odd and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewise.llm import alignment, bpe, recurrent, whitening
from tablewise.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " \n\t", "one", "two words", "it's <|endoftext|> </s> x", "  lead  and\n\n trail ", "日本 語", "é" * 300, "a▁b", "ﬁne ½ ①",
       "naïve café", "日本語の長い文章です" * 40, "aaaa" * 500, "tab\tand nbsp   line", "x" * 3000 + " y", "\x00 \x07", "🙂🙃 ok"]


@pytest.fixture(scope="module")
def odd(spark):
    random.seed(3)
    long = " ".join(random.choices([f"w{i}" for i in range(300)], k=20000))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([*ODD, long, long, "two words", "Two WORDS"])]
    rows += [(4, "two words", "en", "s", 1), (None, "no id here", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("score", "n_a", "key", "round", "ids", "row", "n", "copies")})


@pytest.fixture(scope="module")
def small(spark):
    return table(spark, "/root/testdata/sf0.001", "documents")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def check_scores(docs, found):
    rows = [(r["doc_id"], lower(r["text"])) for r in docs.select("doc_id", "text").collect()]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    counts = Counter(w for (_, t), h in zip(rows, held) if not h for w in WORD.findall(t))
    ends, known = sum(not h for h in held), len(counts) + any(not h for h in held)
    total = sum(counts.values()) + ends
    want = []
    for (i, t), h in zip(rows, held):
        words = WORD.findall(t)
        cs = [counts[w] for w in words] + [ends]
        base = sum(math.log10((c + 0.5) / (total + 0.5 * (known + 1))) for c in cs)
        want.append((i, h, len(cs), sum(c > 0 for c in cs), total, base))
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = sorted([tuple(r)[:6] for r in found], key=order)
    for g, w in zip(got, sorted(want, key=order), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-6 * max(1, w[2]))


@pytest.mark.parametrize("known", [1 << 18, 50, 0])
def test_base_scores_equal_brute_force(small, known):
    """Also when few or no words are looked up and the others are joined."""
    found = recurrent.log_likelihood(small, known=known, warm_tokens=2000).collect()
    check_scores(small, found)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_scores_do_not_depend_on_the_lookup(small):
    """Words looked up or joined have the same place in the model: only the head differs with the table."""
    some = [recurrent.log_likelihood(small, known=k, warm_tokens=2000).orderBy("doc_id").toPandas()["score"] for k in (1 << 18, 20_000)]
    np.testing.assert_allclose(some[0], some[1], rtol=1e-4)


def test_odd_texts_are_scored(spark, odd):
    found = recurrent.log_likelihood(odd, warm_tokens=3000).collect()
    check_scores(odd, found)
    assert all(math.isfinite(r["score"]) for r in found)
    none = spark.createDataFrame([], DOCS)
    assert recurrent.log_likelihood(none).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    one = recurrent.log_likelihood(spark.createDataFrame([(held, "all unknown", "", "", 0)], DOCS)).first()
    assert one["n_known"] == 0 and one["train_tokens"] == 0 and math.isfinite(one["score"])


def test_context_helps_on_held_out_texts(spark):
    rows = recurrent.log_likelihood(table(spark, "/root/testdata/sf0.01", "documents")).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.93 * sum(r["base_score"] for r in rows)
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.95 * len(rows)


def some_vocabulary(seed=0):
    draw = np.random.default_rng(seed)
    head = draw.integers(1, 50, recurrent.HEAD)
    head[-100:] = 0
    tail, words = draw.integers(5, 99, recurrent.TAIL), draw.integers(1, 5, recurrent.TAIL)
    empty = np.zeros(0, np.int64)
    return recurrent.Vocabulary(empty, empty, empty, head, tail, words, int(head.sum() + tail.sum()), 5000, 1)


def test_all_words_share_one():
    """After any state, the symbols' probabilities sum to one."""
    net = recurrent.Network.fresh(some_vocabulary())
    state = np.random.default_rng(1).normal(size=recurrent.HIDDEN).astype(np.float32)
    y = np.arange(recurrent.HEAD + recurrent.TAIL)
    score, _, _ = net.choices(np.repeat(state[None], len(y), 0), y)
    assert np.exp(score).sum() == pytest.approx(1, abs=1e-4)


def test_gradients_equal_differences():
    vocab = some_vocabulary()
    draw = np.random.default_rng(2)
    x, y = (draw.integers(0, recurrent.HEAD - 100, (6, 3)) for _ in range(2))
    y[2, 1], y[5, 2] = recurrent.HEAD + 3, -1
    fresh = np.zeros((6, 3), bool)
    fresh[0], fresh[3, 1] = True, True
    h = np.zeros((recurrent.HIDDEN, 3), np.float32)

    def loss(net):
        return -net.learn(x, y, fresh, h)[1]

    def copy():
        net = recurrent.Network.fresh(vocab, 4)
        return net

    # The step of the optimizer is known, so the gradient is read back from the squares it adds.
    for name in ("embed", "input", "state", "gate", "inner", "kind", "word", "word0"):
        net = copy()
        before = net.w[name].copy()
        squares = net.g2[name].copy()
        net.learn(x, y, fresh, h)
        size = np.sqrt((y >= 0).sum())
        grad = (before - net.w[name]) / recurrent.RATE * np.sqrt(net.g2[name]) * size
        at = np.unravel_index(np.argsort(-np.abs(grad).ravel())[:3], grad.shape)
        for place in zip(*at):
            low, high = copy(), copy()
            low.w[name][place] -= 0.01
            high.w[name][place] += 0.01
            assert grad[place] == pytest.approx((loss(high) - loss(low)) / 0.02, rel=0.03, abs=0.02), name
        assert (net.g2[name] >= squares).all()


def test_softmax_without_the_largest_value():
    draw = np.random.default_rng(1)
    for scale in (1, 30):  # weights that are small, and some that are not
        weights, biases = draw.normal(0, scale, (64, 16)).astype(np.float32), draw.normal(0, 5, 64).astype(np.float32)
        weights[:32] *= 0.1
        biases[::9] = -60
        biases[32:][0] = 200 if scale > 1 else 0
        assert recurrent._small(weights, biases, 2).tolist() == [True, scale == 1]
        for c, small in enumerate(recurrent._small(weights, biases, 2)):
            h = draw.uniform(-1, 1, (500, 16)).astype(np.float32)
            p = h @ weights[32 * c:32 * c + 32].T + biases[32 * c:32 * c + 32]
            exact = p.astype(np.float64)
            exact -= exact.max(axis=1, keepdims=True)
            exact -= np.log(np.exp(exact).sum(axis=1, keepdims=True))
            place = draw.integers(0, 32, 500)
            assert recurrent._log_share(p, place, small) == pytest.approx(exact[np.arange(500), place], abs=1e-4)


def test_windows_do_not_change_scores(monkeypatch):
    """A text's score is that of one run over all its tokens, however lanes and windows are cut."""
    net = recurrent.Network.fresh(some_vocabulary(), 9)
    draw = np.random.default_rng(3)
    n = np.array([1, 40, 700, 3, 90, 33])
    ids = draw.integers(0, recurrent.HEAD - 100, n.sum()).astype(np.int16)
    scores = recurrent.score_texts(net, ids, n)
    for k, (low, high) in enumerate(zip(np.cumsum(n) - n, np.cumsum(n))):
        y = ids[low:high].astype(np.int64)[:, None]
        x = np.concatenate([y[-1:], y[:-1]])
        states, _ = net.forward(x, np.arange(len(y))[:, None] == 0, np.zeros((recurrent.HIDDEN, 1), np.float32))
        whole, _, _ = net.choices(recurrent.rows_of(states[1:]), y[:, 0])
        assert scores[k] == pytest.approx(whole.sum(), rel=1e-5)
    monkeypatch.setattr(recurrent, "SCORE_LANES", 2)
    monkeypatch.setattr(recurrent, "SCORE_STEPS", 7)
    np.testing.assert_allclose(recurrent.score_texts(net, ids, n), scores, rtol=1e-5)


def exact(rows):
    x = [[math.floor(1024 * c) + 100000 for c in r] for r in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    return x, n, sums


@pytest.mark.parametrize("bits", [1, 5, 13, 30, 52])
def test_bit_planes_give_exact_products(bits):
    draw = np.random.default_rng(bits)
    for rows in (1, 63, 64, 200):
        u = draw.integers(0, 1 << bits, (rows, 5), dtype=np.uint64)
        u[-1] = (1 << bits) - 1
        sums, found = whitening.products(whitening.planes(u, bits))
        for i in range(5):
            assert int(sums[i]) == sum(map(int, u[:, i]))
            for j in range(i, 5):
                assert int(found[i, j]) == sum(int(a) * int(b) for a, b in zip(u[:, i], u[:, j]))


def test_whitening_equals_brute_force(spark):
    vectors = table(spark, "/root/testdata/sf0.001", "embeddings")
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in vectors.collect()]
    x, n, sums = exact([v for _, v in rows])
    dims = len(sums)
    matrix = np.array(x, np.float64)
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(r, sums)] for r in x])
    cov = centred.T @ centred / n
    e = np.linalg.eigvalsh(cov)[::-1]
    got = whitening.whiten(vectors).toPandas()
    assert len(got) == n * 8 and matrix.shape == (n, dims) and got["identity_error"].max() < 1e-9
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(r, sums)) for (i, _), r in zip(rows, x)}
    assert all(deviation[i] == d == int(f) for i, d, f in zip(got["vec_id"], got["deviation"], got["deviation_full"]))
    white = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    for k in range(8):
        part = got[got["component"] == k + 1]
        np.testing.assert_allclose(part["explained"], e[k] / e.sum(), rtol=1e-9)
        axis = np.linalg.lstsq(centred, white[:, k], rcond=None)[0] * np.sqrt(e[k])
        assert np.linalg.norm(axis) == pytest.approx(1, abs=1e-9)
        np.testing.assert_allclose(cov @ axis, e[k] * axis, atol=1e-7 * e[0])


def test_odd_vectors(spark):
    schema = "vec_id bigint, embedding array<double>, n string, component string, deviation string"
    make = lambda vs: spark.createDataFrame([(i, v, "x", "y", "z") for i, v in vs], schema)
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5, -3.25]), (None, [7.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 1.0]), (7, []), (8, [1.0]), (9, [1e300, 1.0]), (10, [-1e9, 2e9])]
    got = whitening.whiten(make(rows)).collect()
    x, n, sums = exact([v for i, v in rows if v is not None and len(v) == 2 and i not in (4, 5, 6, 9)])
    assert len(got) == 2 * n and {r["n"] for r in got} == {n} and {r["vec_id"] for r in got} == {1, 2, None, 10}
    want = Counter(sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x)
    assert Counter(int(r["deviation_full"]) for r in got if r["component"] == 1) == want
    assert all(r["deviation"] == (int(r["deviation_full"]) if r["deviation_full"] < 2**63 else None) for r in got)
    equal = whitening.whiten(make([(i, [0.25, 4.0, 1.0]) for i in range(5)])).collect()
    assert len(equal) == 15 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 and r["identity_error"] == 0 for r in equal)
    few = whitening.whiten(make([(0, [1.0, 2.0, 3.0]), (1, [2.0, 0.0, 1.0])])).collect()
    assert [r["whitened"] is None for r in sorted(few, key=lambda r: (r["vec_id"], r["component"]))] == [False, True, True] * 2
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, None)])).count() == 0


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(bpe.default_path())
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=alignment.piece_path())
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {chr(b): b for b in plain}
    sign |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}

    def spell_b(piece):
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    out, held = [], Counter()
    for i, text in rows:
        groups, pairs = [], Counter()
        if text:
            a = first.encode(" " + text, add_special_tokens=False)
            b = second.encode(text)
            bytes_a = [bytes(sign[c] for c in t) for t in a.tokens]
            bytes_b = [spell_b(second.id_to_piece(k)) for k in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(t) for t in bytes_a]).tolist(), np.cumsum([len(t) for t in bytes_b]).tolist()
                low = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    groups.append(([k for k, e in zip(a.ids, ends_a) if low < e <= cut], [k for k, e in zip(b, ends_b) if low < e <= cut]))
                    low = cut
                for one, two in groups:
                    pairs.update((p, q) for p in one for q in two)
        held.update(pairs.keys())
        spelled = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), pairs,
                    hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    most = Counter()
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    return sorted(((i, na, nb, g, sum(ps.values()), sum(n for p, n in ps.items() if held[p] == most[p[0]]),
                    sum(n * held[p] for p, n in ps.items()), d) for i, na, nb, g, ps, d in out), key=str)


@pytest.mark.parametrize("known", [1 << 19, 3, 0])
def test_alignment_equals_brute_force(odd, known):
    """Also when few or no pairs are looked up and the others are joined."""
    small = odd.filter("text is null or length(text) < 5000").union(odd.filter("length(text) >= 5000").withColumn("text", F.substring("text", 1, 900)))
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    got = sorted(map(tuple, alignment.align(small, known_pairs=known).collect()), key=str)
    assert got == brute_alignment(rows)


def test_alignment_of_documents(spark, small):
    some = small.orderBy("n_chars", "doc_id").limit(60)
    assert sorted(map(tuple, alignment.align(some).collect()), key=str) == brute_alignment([(r["doc_id"], r["text"]) for r in some.collect()])
    assert alignment.align(spark.createDataFrame([], DOCS)).count() == 0
    assert alignment.align(spark.createDataFrame([(1, None, "", "", 0)], DOCS)).first()["groups_sha256"] == ""


def test_large_groups_are_split(monkeypatch):
    draw = np.random.default_rng(0)
    ids_a, ids_b = draw.integers(0, 30, 400), draw.integers(0, 30, 300)
    group_a, group_b = np.sort(draw.integers(0, 5, 400)), np.sort(draw.integers(0, 5, 300))
    text_of = np.array([0, 0, 1, 1, 1])
    whole = alignment.linked_pairs(ids_a, group_a, ids_b, group_b, 5, text_of)
    want = Counter((int(text_of[g]), int(a), int(b)) for a, g in zip(ids_a, group_a) for b, k in zip(ids_b, group_b) if g == k)
    assert {(t, p // alignment._STEP, p % alignment._STEP): n for t, p, n in zip(*(x.tolist() for x in whole))} == dict(want)
    for limit in (1, 50, 5000):
        monkeypatch.setattr(alignment, "GROUP_PAIRS", limit)
        for x, y in zip(whole, alignment.linked_pairs(ids_a, group_a, ids_b, group_b, 5, text_of)):
            assert (x == y).all()


def test_aligner_keeps_texts_whole():
    aligner = alignment.Aligner(bpe.default_path(), alignment.piece_path())
    texts = [t for t in ODD if t]
    ids_a, n_a, ids_b, n_b = aligner.encode(pa.array(texts))
    want = [bool(n) for n in n_a]
    assert want == [bool(n) for n in n_b] and want[texts.index("two words")] and not want[texts.index("a▁b")]
    assert aligner.a.bytes_of(ids_a).tobytes() == aligner.b.bytes_of(ids_b).tobytes()
