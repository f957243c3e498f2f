"""Operators of the llm part against brute force, with nulls, empty texts, repeats, clashes and empty tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewise.llm import bpe, counting, language, mixing, neardup, packing, quality, rans, toxicity, vectors, warc
from tablewise.llm.common import flat, new_folder, table, text_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " \n\t", "one", "two words", "a b c d", "it's <|endoftext|> x", "  lead  and\n\n trail ", "日本 語", "é" * 300]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, a row without id, a very long text, and columns named like results."""
    random.seed(2)
    base = [f"w{i}" for i in range(400)]
    long = " ".join(random.choices(base, k=30000))
    near = random.choices(base, k=60)
    texts = [*ODD, long, " ".join(near), " ".join([*near[:-1], "other"]), " ".join(near).upper(), long]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None][i % 3], 1) for i, t in enumerate(texts)]
    rows += [rows[11], (None, "no id here", "en", "s1", 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("score", "size", "length", "n", "task", "kept", "x")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_encoder_equals_library():
    enc = bpe.encoder(bpe.default_path())
    random.seed(4)
    parts = [" ", "  ", "\n", "word", "ab", "é", "12", ".", ",", "'s", "x", "　", "Straße", "&&&"]
    texts = ODD + ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(2000)]
    ids, counts = enc.encode(pa.array(texts, pa.string()))
    at = 0
    for t, n in zip(texts, counts):
        assert ids[at:at + n].tolist() == enc.plain(t or "")
        at += n
    pieces, chars, tokens = enc.pieces(pa.array(texts, pa.string()))
    assert chars.sum() == sum(len(t or "") for t in texts) and tokens.sum() == len(ids) and len(pieces) == len(texts)


def distance(s, t):
    last = list(range(len(t) + 1))
    for i, c in enumerate(s, 1):
        row = [i]
        for j, d in enumerate(t, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        last = row
    return last[-1]


def test_automaton_equals_edit_distance():
    terms = {"stupid": 1.0, "idiot": 2.0, "worthless": 1.0, "scum": 3.0, "disgustingly": 1.0}
    auto = toxicity.LexiconAutomaton(terms)
    random.seed(0)
    for _ in range(4000):
        w = list(random.choice(list(terms)))
        for _ in range(random.randint(0, 3)):
            i = random.randrange(len(w) + 1)
            if random.random() < 0.4 or i == len(w):
                w.insert(i, random.choice("abst"))
            elif random.random() < 0.5:
                w[i] = random.choice("abst")
            else:
                del w[i]
        w = "".join(w)
        want = min(((distance(w, t), -terms[t], t) for t in terms if distance(w, t) <= auto.edits(len(t))), default=None)
        assert auto.match(w) == (want and (want[0], want[2]))


def test_quotation_is_not_abuse():
    model = toxicity.Model({"scum": 5.0}, [3.0, 1.0, 0.1, 1.0, 1.0, 1.0, -3.0])
    assert model.score("you are scum all of you") > 0.5 > model.score("he called them “scum” in court")


@pytest.mark.parametrize("word", ["m0ron", "st*pid", "(m0ron!)", "scumm", "scvm", "你是白痴吗", "moron"])
def test_disguised_spellings_hit(word):
    model = toxicity.Model({"moron": 5.0, "stupid": 5.0, "scum": 5.0, "白痴": 5.0}, [3.0, 1.0, 0.1, 1.0, 1.0, 1.0, -3.0])
    text = f"you are a {word} all of you"
    assert toxicity._suspects(pa.array([text, "you are well"]), toxicity._chunk_test(model)).tolist() == [True, False]
    hits = [found for _, _, found in toxicity.found_words(text, model.lookup) if found]
    assert len(hits) == 1 and hits[0][0] == (word not in ("moron", "你是白痴吗"))


@pytest.mark.parametrize("text, held", [
    ("he wrote “you’re an idiot” there", ["idiot"]), ("“first line\n" + "more words " * 60 + "\nidiot” scum", ["idiot"]),
    ('a 5" pipe, idiot, and "scum" here', ["scum"]), ("“one idiot\n\n“two scum” idiot", ["idiot", "scum"]),
    ("“ stray idiot “scum” idiot", ["scum"]), ("„idiot“ scum", ["idiot"]), ("»idiot« scum «scum»", ["idiot", "scum"]),
    ("‘the dog’s idiot’ scum", ["idiot"]), ("他说\"idiot\" scum", ["idiot"]), ('"idiot\nand "scum" idiot', ["scum"])])
def test_quotations_of_any_length(text, held):
    spans = toxicity.quoted_spans(text)
    assert [m.group() for m in re.finditer("idiot|scum", text) if any(a <= m.start() < b for a, b in spans)] == held


def test_long_quotation_is_not_abuse():
    model = toxicity.Model({"scum": 5.0}, [3.0, 1.0, 0.1, 1.0, 1.0, 1.0, -3.0])
    text = "In court: “" + "these are the words of that day\n" * 20 + "and you are all scum” was read."
    assert model.score(text) < 0.5 < model.score(text.replace("”", ""))


def test_lexicon_has_short_long_and_unspaced_terms(spark):
    long = "x" * 50
    rows = [(i, f"zq 你真是白痴啊 {long}" if i % 2 else "plain words", i % 2) for i in range(60)]
    terms = toxicity.lexicon(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int"))
    assert {"zq", long, "白痴"} <= set(terms)


def test_toxicity_held_out(spark, odd, none, labels):
    docs, marks = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    found = toxicity.toxicity(docs, marks).join(marks, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    right = sum(r["count"] for r in found if r["toxic"] == r["predicted"])
    assert right >= 0.95 * sum(r["count"] for r in found)
    got = rows_of(toxicity.toxicity(odd, labels))
    assert len(got) == odd.count() and all(0 <= r[2] <= 1 and r[3] == (r[2] >= 0.5) for r in got)
    assert toxicity.toxicity(none, labels).count() == 0


def test_cube_keeps_totals():
    draw = np.random.default_rng(1)
    size = draw.integers(0, 500, 300)
    out = mixing.fly(np.full(300, 0.37), size, 3)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - 111) < 1e-6 and abs((out * size).sum() - 0.37 * size.sum()) < 1e-5


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight, out = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}
    while True:
        rest = [s for s in order if s not in out]
        left = sum(sizes.values()) - sum(out.values())
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > 3 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in rest}
        out |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("name", ["odd", "none", "file"])
def test_mixing(spark, odd, none, name):
    docs = {"odd": odd, "none": none, "file": table(spark, "/root/testdata/sf0.01", "documents")}[name]
    raw = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]
    total = Counter()
    for _, s, n in raw:
        total[s] += n
    want = targets(total) if raw else {}
    got = rows_of(mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken"))
    assert sorted(map(str, [r[:3] for r in got])) == sorted(map(str, raw))
    taken = Counter()
    for _, s, n, whole, target, words in got:
        assert whole == total[s] and target == pytest.approx(want[s]) and words <= 3 * n and (not n or words % n == 0)
        taken[s] += words
    assert name != "file" or all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in want)
    assert sorted(map(str, got)) == sorted(map(str, rows_of(mixing.mix(docs, block_docs=1024).select(
        "doc_id", "source", "size", "source_size", "target", "taken"))))


def plain_best_fit(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(c, i) for i, c in enumerate(left) if c >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(capacity - n)
    return len(left), sorted(left)


def test_plan_equals_plain_best_fit():
    random.seed(5)
    for _ in range(60):
        lengths = [random.randint(1, 60) for _ in range(random.randint(0, 300))]
        used = Counter()
        for n, a, b, start, offset in packing.plan_bins(Counter(lengths), 60):
            for k in range(b - a):
                assert used[start + k] == offset
                used[start + k] += n
        assert (len(used), sorted(60 - v for v in used.values())) == plain_best_fit(lengths, 60)


def test_packing(odd, none):
    assert packing.pack(none).count() == 0
    enc = bpe.encoder(bpe.default_path())
    want = Counter()
    for r in odd.collect():
        ids = [*enc.plain(r.text or ""), 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want.update((r.doc_id, i, a, tuple(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    packed = packing.pack(odd)
    pieces, bins = Counter(), defaultdict(list)
    for r in packed.collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces[r.doc_id, r.piece, r.start, tuple(ids.tolist())] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert pieces == want
    for spans in bins.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 1024
    total = {r.sequence_id: (r.n_tokens, len(r.ids)) for r in packing.sequences(packed).collect()}
    assert total == {k: (sum(n for _, n in v), 4 * sum(n for _, n in v)) for k, v in bins.items()}


def base(text):
    words, lines, seen, dup = WORD.findall(text), text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    marks = [0] * len(words)
    for i in range(len(words) - 2):
        if grams[tuple(words[i:i + 3])] > 1:
            marks[i:i + 3] = [1] * 3
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, sum(marks)]


def test_base_counts():
    random.seed(1)
    texts = ODD + ["x\nx\nx", "\nx\n x\nx"] + ["".join(random.choices("ab é#\n\t", k=random.randint(0, 200))) for _ in range(400)]
    parts = [quality.base_counts(d, b) for _, _, d, b in text_slices(pa.array(texts, pa.string()), 4000)]
    columns = [np.concatenate(c) for c in zip(*parts)]
    for i, t in enumerate(texts):
        assert [int(c[i]) for c in columns[:5]] == base(t or "")


def test_quality(spark, odd, none, labels):
    docs, marks = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    found = quality.judge(docs, marks).filter("not base_failed").join(marks, "doc_id").select("quality", "kept").collect()
    assert sum(r.kept == bool(r.quality) for r in found) >= 0.98 * len(found)
    got = rows_of(quality.judge(odd, labels, keep=("source", "x")))
    assert len(got) == odd.count() and quality.judge(none, labels).count() == 0
    assert quality.judge(odd, labels.limit(0)).filter("kept").count() == sum(
        len(WORD.findall(r.text or "")) >= 50 and base(r.text)[4] * 2 <= base(r.text)[0] for r in odd.collect())


def quality_by_hand(texts, marks):
    """Scores from all texts and all labels (1 good, 0 bad, None), and the threshold."""
    data, bounds = flat(pa.array(texts, pa.string()))
    row, key = quality.features(data, bounds)
    raw = np.bincount(key, minlength=quality.BUCKETS)
    good = np.bincount(key[np.array([m == 1 for m in marks])[row]], minlength=quality.BUCKETS)
    ratio = np.log((good + 1) / (good.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    scores = np.bincount(row, ratio[key], len(texts)) / np.bincount(row, minlength=len(texts))
    grid = {}
    for m, s in zip(marks, np.floor(np.round(scores, 6) * 1000).astype(int).tolist()):
        if m is not None:
            grid.setdefault(s, [0, 0])[1 - m] += 1
    return scores, quality.choose_threshold([(s, *grid[s]) for s in sorted(grid)])


def test_quality_counts_every_label(spark):
    # More good and bad labels than were once taken; good and bad texts share most words.
    marks = ([0, 1] * 20_500) + [None] * 500
    texts = [" ".join(f"w{(i * 31 + k * k) % 997}" for k in range(50)) + f" {'good' if m else 'bad'}{i % 7}" for i, m in enumerate(marks)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks) if m is not None], "doc_id bigint, quality int")
    want, threshold = quality_by_hand(texts, marks)
    got = quality.judge(docs, labels).select("doc_id", "score", "base_failed", "kept").orderBy("doc_id").collect()
    assert not any(r.base_failed for r in got)
    assert np.abs(np.array([r.score for r in got]) - want).max() < 2e-6
    assert [r.kept for r in got] == [bool(r.score >= threshold) for r in got]


def test_quality_does_not_depend_on_the_join(spark, odd, labels, monkeypatch):
    marks = labels.union(labels.limit(3)).union(spark.createDataFrame([(11, 0, 1), (13, 1, 0)], labels.schema))
    want = rows_of(quality.judge(odd, marks, keep=("source",)))
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    assert sorted(map(str, rows_of(quality.judge(odd, marks, keep=("source",))))) == sorted(map(str, want))


def test_edits_count_like_encoding_anew(spark, odd, none):
    enc = bpe.encoder(bpe.default_path())
    random.seed(3)
    parts = [" ", " ", "  ", "\n", "word", "ab", "é", "12", ".", "'s", "'", "s", "re", "\t", "\n\n", "　", "语", "!"]
    for _ in range(6000):
        text = "".join(random.choices(parts, k=random.randint(0, 25)))
        tree, edits, at = counting.TokenTree(text, *enc.pretokens(text)), [], 0
        while at <= len(text) and random.random() < 0.7:
            a = random.randint(at, len(text))
            b = random.randint(a, min(len(text), a + 4))
            edits.append((a, b, "".join(random.choices(parts, k=random.randint(0, 3)))))
            at = b + 1
        counting.apply_edits(tree, edits, enc.prefix)
        want = text
        for a, b, put in sorted(edits, reverse=True):
            want = want[:a] + put + want[b:]
        assert tree.current() == want and tree.total == len(enc.plain(want))
    for r in counting.edited_counts(odd.withColumn("text", F.concat("text", F.lit(" me@x.org 12345")))).collect():
        assert r.n_tokens == len(enc.plain(r.text or "")) and r.n_tokens_after == len(enc.plain(r.text_after))
    given = odd.withColumn("edits", F.when(F.col("doc_id") > 2, F.expr("array(named_struct('start', 0, 'stop', 2, 'put', 'z '))")))
    for r in counting.edited_counts(given).collect():
        assert r.n_tokens_after == len(enc.plain(r.text_after))
    assert counting.edited_counts(none).count() == 0


@pytest.mark.parametrize("text", [
    "word  " * 4000, "line here \n" * 3000, "这是一个很长的句子。" * 1500, "a=1;b=[2,3];" * 2000, "one two " * 3000 + " ", "tab\tand\r\n\r\n" * 2000])
def test_edits_stay_local_in_any_text(text):
    """Blanks of every kind, no blanks at all: an edit encodes a few tokens."""
    enc = bpe.encoder(bpe.default_path())
    for at in (0, 1, 7000, 7001, 7003, len(text) - 1, len(text)):
        for size, put in ((0, "x"), (1, ""), (3, " new "), (2, "\n")):
            tree = counting.TokenTree(text, *enc.pretokens(text))
            tree.edit(at, at + size, put, enc.prefix)
            assert tree.total == len(enc.plain(text[:at] + put + text[at + size:])) and tree.encoded < 100


def shingles(text, size):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}


def linked_components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", ["odd", "none", "file"])
def test_near_duplicates(spark, odd, none, name):
    file = table(spark, "/root/testdata/sf0.01", "documents")
    docs = {"odd": odd, "none": none, "file": file}[name]
    sets = {r.doc_id: shingles(r.text, 4) for r in docs.collect() if r.doc_id is not None}
    index, links = defaultdict(list), []
    for d in sorted(sets):
        common = Counter(o for s in sets[d] for o in index[s])
        links += [(o, d) for o, k in common.items() if 100 * k >= 80 * (len(sets[d]) + len(sets[o]) - k)]
        for s in sets[d]:
            index[s].append(d)
    want = linked_components(sets, links)
    got = rows_of(neardup.near_duplicates(docs, 4, (80, 100)))
    assert len(got) == docs.count()
    for d, n, component, kept in got:
        assert (d is None and component is None and kept) or (n, component, kept) == (len(sets[d]), want[d], want[d] == d)


def test_texts_that_share_an_id(spark):
    """Each text of an id has its own links; one id with two near texts keeps one of them."""
    import corpus_pipeline

    random.seed(6)
    many = [" ".join(random.choices([f"w{i}" for i in range(500)], k=80)) for _ in range(24)]
    rows = [(1, t) for t in many] + [(10 + i, f"{t} tail") for i, t in enumerate(many)] + [(1, f"{many[0]} end"), (1, many[1])]
    docs = spark.createDataFrame([(d, t, "en", "s1", 1) for d, t in rows], DOCS)
    got = rows_of(neardup.near_duplicates(docs, 4, (80, 100), with_text=True))
    assert {r[2] for r in got} == {1} and all(r[3] == (r[0] == 1) for r in got) and sum(r[5] for r in got) == len(many) + 1
    left = rows_of(corpus_pipeline.drop_copies(spark, docs, ""))
    assert len(left) == len(many) and {r[0] for r in left} == {1}
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.select("doc_id", "text").distinct().filter("doc_id = 1").count() == len(many) + 1


def test_archives(spark):
    rows = [(1, "u", "<p>é</p>"), (2, "v", "<p>é</p>"), (3, None, None), (4, "a\nb", ""), (5, "u", "z" * 200000), (2, "v", "<p>é</p>"),
            (None, "w", "<p>é</p>"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha", F.lit("clash"))
    first = {}
    for i, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html or "", i)
    want = []
    for i, _, html in rows:
        data, f = (html or "").encode(), first[html or ""]
        again = i is not None and i != f
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", f if again else None))
    assert sorted(map(str, rows_of(warc.page_report(warc.archive(pages))))) == sorted(map(str, want))
    assert warc.archive(pages.limit(0)).count() == 0
    folder = new_folder(spark, "warc")
    warc.write_warc(warc.archive_records(pages), folder)
    heads = warc.read_warc(spark, folder, "record_id string, record_type string, payload_length bigint")
    assert heads.filter("record_type = 'revisit'").count() == 3 == warc.read_warc(spark, folder, types="revisit").count()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = warc.read_warc(spark, folder).filter("record_type = 'revisit' and record_id in ('urn:page:2', 'urn:page:9')")
    assert pushed.count() == 2
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_plain_and_foreign_archives(tmp_path, spark):
    import gzip

    records = [warc.record(f"urn:page:{i}", "response", "u", None, "D", b"x" * (70000 * i)) for i in range(3)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    got = rows_of(warc.read_warc(spark, str(tmp_path)).select("record_id", F.length("payload"), "payload_length"))
    assert sorted(got) == sorted([(f"urn:page:{i}", 70000 * i, 70000 * i) for i in range(3)] * 2)
    assert warc.read_warc(spark, str(tmp_path), "record_id string").count() == 6


def test_languages(spark, odd, none):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred != 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.languages(odd).collect()}
    assert found[0] == found[1] == found[2] == ("und", 0.0) and found[3][0] in ("en", "fr")
    assert language.languages(none).count() == 0


def test_coding_round_trip():
    draw = np.random.default_rng(0)
    for ids in [np.zeros(0, np.uint32), np.arange(50257, dtype=np.uint32), np.zeros(70000, np.uint32),
                *((draw.zipf(1.3, n) % 50257).astype(np.uint32) for n in (1, 63, 64, 65, 16384, 16385, 100000))]:
        data = rans.encode_segment(ids, [7, None], np.array([len(ids), 0]))
        got, docs, lengths = rans.decode_segment(data)
        assert (got == ids).all() and docs == [7, None] and lengths.tolist() == [len(ids), 0]
    part = rans.decode_segment(data, range(2, 4))[0]
    assert (part == ids[2 * rans.BLOCK_IDS:4 * rans.BLOCK_IDS]).all()
    with pytest.raises(ValueError):
        rans.decode_segment(data[:-5] + bytes([data[-5] ^ 1]) + data[-4:])


def test_token_files(odd, none):
    assert rans.token_files(none).count() == 0
    enc = bpe.encoder(bpe.default_path())
    docs = sorted(((r.doc_id, [*enc.plain(r.text or ""), 0]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(rans.token_files(odd).collect(), key=lambda r: r.start)
    at = 0
    for r, (doc, ids) in zip(got, docs, strict=True):
        assert (r.doc_id, r.start, r.n_tokens) == (doc, at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_near_vectors(spark):
    draw = np.random.default_rng(3)
    base_vectors = draw.normal(size=(60, 24))
    rows = []
    for i, v in enumerate(np.repeat(base_vectors, 4, axis=0)):
        rows.append((i, [float(x) for x in v + draw.normal(scale=[0.0, 0.1, 0.2, 0.3][i % 4], size=24)], 0))
    rows += [(900, rows[0][1], 1), (901, [2 * x for x in rows[0][1]], 1), (902, None, 1), (903, [], 1), (904, [0.0] * 24, 1),
             (905, [float("nan")] * 24, 1), (906, [None] + [1.0] * 23, 1), (907, rows[0][1][:20], 1), (900, rows[0][1], 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("links", F.lit(1))
    good = [(i, np.array(v)) for i, v, _ in rows[:-1] if v and None not in v and np.isfinite(v).all() and any(v)]
    links, n = [], Counter()
    for a in range(len(good)):
        for b in range(a):
            (i, x), (j, y) = good[a], good[b]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                links.append((i, j))
                n[a] += 1
                n[b] += 1
    want = linked_components({r[0] for r in rows if r[0] is not None}, links)
    got = rows_of(vectors.near_vectors(df))
    found, real = sum(r[1] for r in got), sum(n.values())
    assert len(got) == len(rows) and 0.98 * real <= found <= real
    assert sum(want[r[0]] == r[2] for r in got if r[0] is not None) >= len(rows) - 4
    assert all(r[3] == (r[0] is None or r[0] == r[2]) for r in got)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_hadamard_keeps_length():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose((vectors.hadamard(x) ** 2).sum(1), (x**2).sum(1)) and np.allclose(vectors.hadamard(vectors.hadamard(x)), x)
