"""Each operator against a plain, brute-force version on small fixtures with awkward rows."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import bpe, decontaminate, html, jaccard, licenses, maxent, ogg, quality, suffixes, toxicity

WORDS = ["alpha", "beta", "Gamma", "delta", "é", "ß", "zeta,", "eta."]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "x", "yz"]) for _ in range(n))


def rows():
    base = prose(1, 120)
    near = base.split()
    near[5] = "other"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t"), (7, "one two"), (7, "one two"), (8, "one two"),
        (None, "no id"), (9, prose(2, 3000)), (10, "intro " + prose(2, 3000)[:900]), (11, "All rights reserved.\nReleased under the MIT license"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 5) for i, t in rows()], "doc_id long, text string, bucket string, k long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_bpe_equals_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs).collect()}
    expected = set()
    for i, text in rows():
        e = t.encode(text or "", add_special_tokens=False)
        d = t.decode(e.ids, skip_special_tokens=False)
        expected.add((i, len(e.ids), hashlib.sha256(struct.pack(f"<{len(e.ids)}I", *e.ids)).hexdigest(), hashlib.sha256(d.encode()).hexdigest()))
    assert got == expected
    assert bpe.encode(empty).collect() == []


def test_bpe_odd_texts():
    from tokenizers import Tokenizer

    t, b = Tokenizer.from_file(bpe.default_vocabulary()), bpe.Bpe()
    r = random.Random(2)
    long = "".join(r.choice("abcdefgh") for _ in range(80_000))
    texts = ["a" * 2000, "ab" * 3000, "é" * 1001, long, "<|endoftext|>x", "ΑΣ Σ", "İ²Ⅷ٣", "\x1c\x85 x", "don't'll"]
    for text, (ids, decoded) in zip(texts, b.encode_batch(texts)):
        e = t.encode(text, add_special_tokens=False)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert decoded.decode() == t.decode(e.ids, skip_special_tokens=False)


def test_html():
    page = (
        "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div>"
        "<article><h1>Head</h1><p>One &amp; two<br>three</p><p>ok<div class=comments>said</div></article><footer>&copy; us</footer>"
    )
    assert html.main_text(page) == "Head\nOne & two\nthree\nok"
    assert html.main_text(None) == html.main_text("") == ""
    assert html.main_text("<p>" + "plain words " * 20) == ("plain words " * 20).strip()


def test_html_linked_lines_of_an_article():
    words = "Some words that make a paragraph of an article, long enough to count as text. " * 2
    page = f"""<body><nav><a href="/">Home</a></nav><article><h1><a href="/t">Linked title</a></h1><p>{words}</p>
    <ul><li><a href="/i">Linked item</a></li></ul><p><a href="/p">Linked paragraph</a></p><div class="share"><a href="/s">Share</a></div></article><p><a href="/o">Other</a></p></body>"""
    assert html.main_text(page).split("\n") == ["Linked title", words.strip(), "Linked item", "Linked paragraph"]


def test_html_without_article():
    words = "Some words that make a paragraph of a text, long enough to count as the main part of a page. " * 2
    bare = f"<body><div><a href=/>Home</a> <a href=/n>News</a></div><div id=text><h2>Head of it</h2><p>{words}</p><p>Short.</p><p>{words}</p></div><div><a href=/a>About</a></div></body>"
    assert html.main_text(bare).split("\n") == ["Head of it", words.strip(), "Short.", words.strip()]
    # windows decide beside an article too: a long block outside it counts, boilerplate within does not
    mixed = f"<article><h1>Title</h1><p>{words}</p><div class=ad>Buy now, {words}</div></article><div>{words}</div>"
    assert html.main_text(mixed).split("\n") == ["Title", words.strip(), words.strip()]


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", None), (1, "u", None), (2, None, "<article><p>x</article>")], "page_id long, url string, html string")
    assert sorted(map(tuple, html.extract(df).collect())) == [(1, "u", ""), (1, "u", ""), (2, None, "x")]


def test_ogg(spark, docs):
    for n in (0, 1, 191, 192, 193, 255 * 192, 70_000):
        data = ogg.pad(random.Random(n).randbytes(n))
        assert ogg.read_payload(ogg.mux(data))[0] == data and len(data) % 192 == 0 and len(data) > 0
    bad = bytearray(ogg.mux(ogg.pad(b"x" * 500)))
    bad[-3] ^= 1
    with pytest.raises(ogg.OggError):
        ogg.read_payload(bytes(bad))
    for r in ogg.inspect(ogg.store(docs)).collect():
        if r.doc_id == 4:
            assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (0, 192, zlib.crc32(b" " * 16))


def test_licenses(spark, docs, empty):
    got = sorted((r.doc_id, r.line_no, r.license) for r in licenses.scan(docs).collect())
    assert got == [(11, 1, "Proprietary"), (11, 2, "MIT")]
    assert licenses.scan(empty).collect() == []


def brute_hits(texts, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            found[tuple(w[k : k + window])].add(str(i))
    out = []
    for i, t in texts:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in found}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in found:
                    hit.update(range(k, k + n))
                    ids |= found[x]
        out.append((i, len(w), len(hit), len(ids), decontaminate.items_digest(ids), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark, docs, empty):
    items = [(1, prose(2, 30)), (2, "one"), (3, None), (4, "one"), (5, "..."), (6, rows()[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.report(docs, bench).collect()), key=str) == brute_hits(rows(), items)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    clean = [i for i, *_, c in brute_hits(rows(), items) if not c]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(clean, key=str)
    assert not any(r.contaminated for r in decontaminate.report(docs, empty.withColumnRenamed("doc_id", "item_id")).collect())


def test_decontamination_in_passes(spark, monkeypatch):
    items = [(i, prose(i, 15)) for i in range(5)]
    texts = [(i, f"{prose(i, 15)} and {prose((i + 1) % 5, 12)}") for i in range(8)]
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 100)
    df = decontaminate.report(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, df.collect()), key=str) == brute_hits(texts, items)


def test_decontamination_in_passes_keeps_rows(spark, monkeypatch):
    items = [(i, prose(i, 15)) for i in range(5)]
    texts = [(1, prose(0, 15)), (1, prose(0, 15)), (1, prose(1, 15) + " more"), (None, prose(2, 15)), (None, prose(2, 15)), (None, "no id"), (2, None), (2, "")]
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 100)
    df = decontaminate.report(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, df.collect()), key=str) == brute_hits(texts, items)


def brute_components(texts, words=4, percent=85):
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    own = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                own = [own[b] if x == own[a] else x for x in own]
    out = []
    for i, (key, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if own[j] == own[i] and texts[j][0] is not None]
        out.append((key, len(sets[i]), min(ids) if ids and sets[i] else key))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [2048, 3])
def test_jaccard(spark, docs, group, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", group)
    assert sorted(map(tuple, jaccard.classes(docs).collect()), key=str) == brute_components(rows())
    r, base, many = random.Random(5), prose(9, 80).split(), []
    for i in range(40):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"w{r.randint(0, 9)}"
        many.append((i, " ".join(w)))
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.classes(df).collect()), key=str) == brute_components(many)
    assert sorted(x.doc_id for x in jaccard.keep_one(df).collect()) == sorted({c for _, _, c in brute_components(many)})


def test_jaccard_near_a_large_component(spark, monkeypatch):
    """Nodes that just don't link with a large component make no pair with each of its nodes."""
    r, base, many = random.Random(3), [f"b{i}" for i in range(120)], []
    for i in range(240):
        w, at = list(base), r.randrange(4, 110)
        w[at] = f"x{i}"
        if i >= 160:  # one link short of the copies
            w[at + 2] = f"y{i}"
        many.append((i, " ".join(w)))
    verified, verify = [], jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda pairs, *rest: verified.append(pairs.count()) or verify(pairs, *rest))
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.classes(df).collect()), key=str) == brute_components(many)
    assert sum(verified) < 2000


@pytest.mark.parametrize("together", [1, 300, 128 << 10])
def test_jaccard_shingles(together, monkeypatch):
    """Columns hashed together give each text its own shingles, whatever its words."""
    monkeypatch.setattr(jaccard, "TOGETHER", together)
    r, words = random.Random(8), ["a", "a\0", "\0", "\0\0", "é", "a\u00a0b", "c\x85d", "e\x1cf", "İ"]
    words += ["x" * (n - 1) + last for n in (7, 8, 9, 16, 63, 64, 65, 130) for last in "xyz"]
    texts = [None, "", " \n\t", "one", "two words", "ONE", "one two three", "three\x0btwo\x0cone\rzero "]
    texts += [" ".join(r.choices(words, k=r.choice([1, 2, 3, 4, 5, 60]))) for _ in range(60)] + [None, "", "one"]
    for n in (1, 4, 5):
        expected = []
        for t in texts:
            w = (t or "").encode().lower().split()
            expected.append({(n, *w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {(len(w), *w)} if w else set())
        got = [g.tolist() for g in jaccard.Shingler(n).sets(pa.array(["not read", *texts])[1:])]
        assert [len(g) for g in got] == [len(e) for e in expected] and all(g == sorted(set(g)) for g in got)
        assert all(len({*a} & {*b}) == len(x & y) for a, x in zip(got, expected) for b, y in zip(got, expected))


def test_jaccard_shingles_cost_no_step_a_word():
    texts = [" ".join(f"word{i * 700 + k}" for k in range(700)) for i in range(300)]
    column = pa.array(texts)

    def least(run):
        took = []
        for _ in range(5):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    # 38 times as long as to cut the words, when a hash was looked up for each; 3 times since
    assert least(lambda: sum(map(len, jaccard.Shingler().sets(column)))) < 12 * least(lambda: sum(len(t.encode().split()) for t in texts))


def test_jaccard_ranks():
    """The table of leading bits only saves searches: ranks and prefixes are those of a plain lookup."""
    r = random.Random(6)
    known = {(r.getrandbits(4) << 60) + r.getrandbits(3): i + 1 for i in range(60)}
    sets = [sorted({*r.sample(sorted(known), r.randint(0, 20)), *((r.getrandbits(4) << 60) + r.getrandbits(3) for _ in range(r.randint(1, 40)))}) for _ in range(50)]
    by = sorted(known)
    for order, at in ((jaccard.Order(np.array(by, np.uint64), np.array([known[g] for g in by])), known), (jaccard.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64)), {})):
        for s in sets:
            grams, ranks = order.prefix(np.array(s, np.uint64), 85)
            expected = sorted(s, key=lambda g: (at.get(g, 0), g))[: len(s) - (85 * len(s) + 99) // 100 + 1]
            assert grams.tolist() == expected and ranks.tolist() == [at.get(g, 0) for g in expected]


def test_jaccard_empty(spark, empty):
    assert jaccard.classes(empty).collect() == []


def brute_repeats(texts, length):
    data = [(i, (t or "").encode()) for i, t in texts]
    count = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = set()
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone.update(range(p, p + length))
        kept = bytes(x for p, x in enumerate(b) if p not in gone)
        out.append((i, len(b), len(gone), sum(p - 1 not in gone for p in gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [64, 2])
def test_suffixes(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "HOT_IN_TASK", max(2, hot // 8))
    monkeypatch.setattr(suffixes, "HELD", 400_000 if hot == 64 else 300)
    monkeypatch.setattr(suffixes, "POSITIONS", 1 << 24 if hot == 64 else 77)
    assert sorted(map(tuple, suffixes.repeats(docs).collect()), key=str) == brute_repeats(rows(), 400)
    texts = [(i, prose(i % 7, 30) + prose(i, 20) + prose(3, 25)) for i in range(30)] + [(90, "ab" * 200), (91, "a" * 90)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, suffixes.repeats(df, 60, 20).collect()), key=str) == brute_repeats(texts, 60)


def brute_runs(texts, words):
    data = [(i, (t or "").encode().split()) for i, t in texts]
    count = Counter(tuple(w[p : p + words]) for _, w in data for p in range(len(w) - words + 1))
    out = []
    for i, w in data:
        inside = set()
        for p in range(len(w) - words + 1):
            if count[tuple(w[p : p + words])] > 1:
                inside.update(range(p, p + words))
        out.append((i, sum(p - 1 not in inside for p in inside), len(inside)))
    return sorted(out, key=str)


def test_passages_of_few_bytes_are_counted(spark, docs, empty):
    r = random.Random(5)
    short = lambda n: " ".join(r.choice("abcdefghij") + r.choice("klmnopqrst") for _ in range(n))
    passages = [short(n) for n in (50, 51, 60)]
    assert all(len(p) < 400 for p in passages)
    texts = [(i, f"{short(15)} {p}\n{short(15)}") for i, p in enumerate(passages * 2)] + [(90, passages[2]), (91, passages[2]), (92, None), (93, passages[1])]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for frame, of in ((df, texts), (docs, rows())):
        got = suffixes.repeats(frame, words=51)
        assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_words"]
        assert sorted((tuple(x[:5]) for x in got.collect()), key=str) == brute_repeats(of, 400)
        assert sorted(((x.doc_id, x.n_passages, x.passage_words) for x in got.collect()), key=str) == brute_runs(of, 51)
    assert suffixes.repeats(empty, words=51).collect() == []


def test_columns_of_any_name(spark):
    t = prose(1, 80)
    df = spark.createDataFrame([(1, f"x {t} y", "a", "b", 1), (2, f"z {t} u", "c", "d", 2), (3, None, None, None, 3)], "doc_id long, text string, _digest string, _text string, `r.d` long")
    rows = {r[0]: r for r in suffixes.remove_repeats(df).collect()}
    assert [tuple(rows[i])[2:] for i in (1, 2, 3)] == [("a", "b", 1), ("c", "d", 2), (None, None, 3)]
    assert rows[1].text == "xy" and rows[2].text == "zu" and rows[3].text is None


def test_loser_tree_merges_in_order():
    r = random.Random(3)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 20))) for _ in range(7)]
    merged = list(suffixes.LoserTree([suffixes.Run(*suffixes.front_code(x), range(len(x))) for x in runs]))
    strings = [s for s, _, _ in merged]
    assert strings == sorted(s for x in runs for s in x)
    assert [n for _, n, _ in merged][1:] == [suffixes.common_prefix(a, b) for a, b in zip(strings, strings[1:])]


def test_repeats_removed_from_rows(spark, docs, empty):
    out = suffixes.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert [r.text for r in out.where("doc_id = 4").collect()] == [None]
    assert suffixes.repeats(empty).collect() == []


def labelled(spark, n=600):
    r, docs, labels = random.Random(1), [], []
    for i in range(n):
        bad, junk = r.random() < 0.3, r.random() < 0.3
        text = prose(i, 40).replace("eta. ", "eta.\n")
        if bad:
            text += " " + r.choice(["vile", "nasty"]) + " words"
        if junk:
            text = "\n".join(" | ".join(x.split()) for x in text.split("\n"))
        docs.append((i, text))
        labels.append((i, int(not junk), int(bad)))
    docs += [(n, None), (n + 1, ""), (0, docs[0][1])]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label, part", [(toxicity, "toxic", (4, 2)), (quality, "quality", (5, 0))])
def test_held_out_accuracy(spark, module, label, part):
    docs, labels = labelled(spark)
    model = module.learn(docs, labels)
    got = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    truth = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    held = [i for i in truth if i is not None and zlib.crc32(str(i).encode()) % part[0] == part[1]]
    assert sum((got[i] >= 0.3) == bool(truth[i]) for i in held) / len(held) > 0.95
    assert all(0 <= s <= 1 for s in got.values())
    nothing = module.learn(docs, labels.limit(0))
    assert {r.score for r in module.score(docs, nothing).collect()} == {0.0}


def test_clean_texts_have_nearest_examples(spark):
    docs, labels = labelled(spark)
    model = toxicity.learn(docs, labels)
    texts = [r.text for r in docs.collect()]
    for term, i in model.terms.items():
        n = sum(any(term in toxicity.terms_of(w) for w in re.findall(r"\w+", (t or "").lower())) for t in texts)
        assert np.isclose(model.idf[i], np.log((1 + len(texts)) / (1 + n)) + 1)
    bad = {r.doc_id for r in labels.collect() if r.toxic == 1}
    clean = [r for r in toxicity.score(docs, model).collect() if r.doc_id < 600 and r.doc_id not in bad]
    assert all(r.evidence and not bad & set(r.evidence) for r in clean)


def test_block_max_search_is_exact():
    r = np.random.default_rng(0)
    examples = []
    for k in range(400):
        ids = np.sort(r.choice(30, r.integers(1, 6), replace=False))
        w = r.random(len(ids))
        examples.append((k, tuple(ids.tolist()), tuple((w / np.sqrt(w @ w)).tolist()), int(r.integers(0, 2))))
    index = toxicity.Index(examples, 30)
    for q in examples[:40]:
        ids, w = np.array(q[1]), np.array(q[2])
        distinct = {(e[1], tuple(round(x, 9) for x in e[2])) for e in examples}  # equal vectors are one point
        plain = sorted((sum(dict(zip(*e)).get(i, 0) * x for i, x in zip(q[1], q[2])) for e in distinct), reverse=True)[:15]
        assert np.allclose(index.search(ids, w)[1], plain)


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    lengths, trans = np.array([3, 1, 4]), r.normal(size=(2, 2))
    emit = r.normal(size=8)
    good, pairs, z = quality.Batch(lengths).marginals(emit, trans)
    at, expected = 0, []
    for n in lengths:
        total, p = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            s = np.exp(sum(emit[at + i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += s
            p += s * np.array(y)
        expected += (p / total).tolist()
        at += n
    assert np.allclose(good, expected)


def test_maxent_leaves_no_token_out(monkeypatch):
    monkeypatch.setattr(maxent, "TOP", 5)
    words = [b"a", b"b", b"longer-word", b"c.", b"\n", b"d", b"e", b"\xc3\xa9", b"f;"]
    counts, forms, rare = np.array([9, 8, 7, 6, 5, 4, 3, 2, 2]), maxent.forms(words), np.array([1, 1, 1])  # three tokens of form 0 are not frequent
    form_n = np.bincount(forms, counts, maxent.FORMS) + np.bincount([0], [rare.sum()], maxent.FORMS)
    form_v = np.bincount(forms, minlength=maxent.FORMS) + np.bincount([0], [len(rare)], maxent.FORMS)
    model = maxent.Model(maxent.word_hashes(words), counts, forms, int(form_n.sum()), int(form_v.sum()), form_n, form_v)
    model.set_classes(np.array([0, 3, 3, 1, 0]))  # 17 clusters have no token
    model.weights[:] = np.random.default_rng(1).normal(size=model.weights.shape) * 0.3
    for before in ([], [0], [3, 7], [-1, 2, 8]):
        # each frequent token, the three others and one unseen token of each form: together they are certain
        codes = [*range(len(words)), *(-1 - f for f in range(maxent.FORMS))]
        share = [10 ** model.log10(np.array([*before, c]), np.arange(len(before) + 1) == 0)[-1] for c in codes]
        share[len(words)] *= 1 + (rare + 1).sum()
        assert np.isclose(sum(share), 1, atol=1e-5)


def test_maxent(spark, docs, empty):
    got = maxent.score(docs).collect()
    t = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")) + ["\n"] for i, x in rows()}
    c = Counter()
    for i, _ in rows():
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(t[i])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows())
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t[r.doc_id]), sum(c[x] > 0 for x in t[r.doc_id]), n)
        assert np.isclose(r.base_score, sum(np.log10((c[x] + 1) / (n + v + 1)) for x in t[r.doc_id]))
        assert r.score < 0
    assert maxent.score(empty).collect() == []
