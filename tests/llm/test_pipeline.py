"""The pipeline's stages on a small table."""

import os
import random
import re
from collections import Counter

import pytest

from weftline.llm import suffixes

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, DATA), "test")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, docs, DATA).count() == before
    assert before > 100


def brute_passages(texts, words, length):
    """Texts without repeated runs of words or bytes."""
    data = [t.encode() for t in texts]
    found = [list(re.finditer(rb"[^ \t-\r]+", d)) for d in data]
    runs = Counter(tuple(m[0] for m in f[i : i + words]) for f in found for i in range(len(f) - words + 1))
    strings = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d, f in zip(data, found):
        gone = set()
        for i in range(len(f) - words + 1):
            if runs[tuple(m[0] for m in f[i : i + words])] > 1:
                gone.update(range(f[i].start(), f[i + words].start() if i + words < len(f) else len(d)))
        for i in range(len(d) - length + 1):
            if strings[d[i : i + length]] > 1:
                gone.update(range(i, i + length))
        out.append(bytes(b for i, b in enumerate(d) if i not in gone).decode("utf-8", "ignore"))
    return out


def prose(r, n):
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(n))


@pytest.mark.parametrize("hot", [64, 2])
def test_passages_of_over_50_words(spark, monkeypatch, hot):
    import corpus_pipeline

    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "HOT_IN_TASK", 2 if hot == 2 else 8)
    r = random.Random(4)
    passages = [prose(r, n) for n in (50, 51, 52, 58, 65)]
    assert all(len(p.encode()) < 400 for p in passages)
    texts = [" ".join([prose(r, 20 + i), p, prose(r, 20)]) for i in range(4) for p in passages]
    # white space does not tell passages apart; one long word is a passage by its bytes; copies of a short text
    texts += [prose(r, 9) + "\n" + passages[2].replace(" ", " \n"), passages[3], *(f"{prose(r, 5)} {'x7é' * 200} {prose(r, 5)}" for _ in range(2)), passages[4], passages[4], "", "a b", "a b"]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)] + [(len(texts), None, None)], "doc_id long, text string, n_chars long").repartition(3)
    got = sorted(corpus_pipeline.remove_repeats(spark, df, "").collect())
    want = brute_passages(texts, 51, 400)
    assert [x.text for x in got] == [*want, None]
    assert [x.n_chars for x in got[:-1]] == [len(t) for t in want]
    assert all(passages[0] in t for t in (want[0], want[5])) and not any(p in t for p in passages[1:] for t in want)


def brute_kept(texts, words, percent):
    sets = [{tuple(t.lower().split()[i : i + words]) for i in range(len(t.split()) - words + 1)} for t in texts]
    own = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                own = [own[b] if x == own[a] else x for x in own]
    return sorted({own.index(x) for x in own})


def test_near_copies_on_five_words(spark):
    import corpus_pipeline

    r, texts = random.Random(6), []
    for i in range(30):
        base = [f"w{r.randint(0, 9**9)}" for _ in range(200)]
        near = list(base)
        for k in r.sample(range(200), 2 + i % 5):
            near[k] = "other"
        texts += [" ".join(base), " ".join(near), " ".join(base[: 155 + i % 10])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_kept(texts, 5, 80)
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == want
    assert want != brute_kept(texts, 4, 85)


def test_run_equals_a_plain_version(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from weftline.llm import bpe

    r = random.Random(8)
    words = lambda n: [f"w{r.randint(0, 9**9)}" for _ in range(n)]
    passage, item = words(55), words(30)
    texts = [" ".join(words(80)) for _ in range(120)]
    toxic = [" ".join([*words(40), "vile", "nasty", "filthy", *words(40)]) for _ in range(40)]
    near = []
    for t in texts[:10]:
        w = t.split()
        w[40] = "other"
        near.append(" ".join(w))
    shared = [" ".join([*words(70), *passage, *words(70)]) for _ in range(6)]
    leaked = [" ".join([*words(40), *item[i : i + 10], *words(40)]) for i in range(5)] + [" ".join([*words(40), *item[:9], *words(40)])]
    every = [*texts, *toxic, *near, *shared, *leaked]
    labels = [(i, int(" vile " in t)) for i, t in enumerate(every)]
    spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(every)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(i, t) for i, t in enumerate(every) if " vile " not in t]
    kept = [kept[k] for k in brute_kept([t for _, t in kept], 5, 80)]
    kept = list(zip([i for i, _ in kept], brute_passages([t for _, t in kept], 51, 400)))
    windows = {tuple(item[i : i + 10]) for i in range(21)}
    kept = [(i, t) for i, t in kept if not any(tuple(t.split()[k : k + 10]) in windows for k in range(len(t.split())))]
    want = {i: t for i, t in kept}
    assert len(want) == len(every) - 40 - 10 - 5 and sum(len(t) < len(every[i]) for i, t in want.items()) == 6

    written, materialise = [], corpus_pipeline.materialise
    monkeypatch.setattr(corpus_pipeline, "materialise", lambda df, label: written.append(materialise(df, label)) or written[-1])
    ids = {x.doc_id: x.ids for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    got = {x.doc_id: (x.text, x.n_chars) for x in written[-2].collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    plain = bpe.encode(spark.createDataFrame(list(want.items()), "doc_id long, text string"))
    assert ids == {x.doc_id: x.ids for x in plain.collect()}


def written_tables(spark, tmp_path, docs):
    """Labels and a benchmark beside ``docs``: ids 100 to 139 are toxic."""
    r = random.Random(12)
    words = lambda n: [f"w{r.randint(0, 9**9)}" for _ in range(n)]
    item = words(20)
    learnt = [(i, " ".join([*words(40), *(["vile", "nasty", "filthy"] if 100 <= i < 140 else []), *words(40)]), None, "x", 1.5, 2) for i in range(100, 240)]
    df = spark.createDataFrame([*learnt, *docs(words, item)], "doc_id long, text string, n_chars long, digest string, `r.d` double, k int").repartition(3)
    spark.createDataFrame([(i, int(100 <= i < 140)) for i in range(100, 240)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (1, None), (2, ""), (2, "short item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return df


def test_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    made = {}

    def docs(words, item):
        long = " ".join(words(60_000))
        made["long"], made["leak"] = long, " ".join([*words(30), *item[3:14], *words(30)])
        return [
            (1, None, None, None, None, None), (1, None, None, None, None, None), (2, "", 0, "a", 0.0, 0), (3, " \n", 2, "b", 1.0, 1),
            (4, long, len(long), "c", 2.0, 2), (5, made["leak"], 0, "d", 3.0, 3), (6, "a short item here", 17, "e", 4.0, 4),
            (None, "a text without id", 17, None, None, None), (7, "one two three four five six", 27, "f", 5.0, 5), (7, "one two three four five six", 27, "f", 5.0, 5),
            (8, "one two three four five six", 27, "g", 6.0, 6), (9, "vile nasty filthy", 17, "h", 7.0, 7),
        ]

    df = written_tables(spark, tmp_path, docs)
    odd = lambda out: sorted((tuple(x) for x in out.where("doc_id IS NULL OR doc_id < 100").collect()), key=str)
    rows = odd(df)
    for stage, gone in [(corpus_pipeline.drop_toxic, {9}), (corpus_pipeline.drop_near_copies, {8}), (corpus_pipeline.remove_repeats, set()), (corpus_pipeline.drop_contaminated, {5, 6})]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, stage.__name__
        got = odd(out)
        if stage is corpus_pipeline.remove_repeats:
            assert [(x[0], *x[3:]) for x in got] == [(x[0], *x[3:]) for x in rows] and {x[1] for x in got} == {x[1] for x in rows}
        else:
            assert got == [x for x in rows if x[0] not in gone], stage.__name__
    ids = corpus_pipeline.encode(spark, df.where("doc_id < 100"), str(tmp_path)).collect()
    assert len(ids) == len(rows) - 1 and [len(x.ids) for x in ids if x.doc_id in (1, 2, 3)] == [0] * 4


def test_stages_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = written_tables(spark, tmp_path, lambda words, item: []).where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and out.columns == (["doc_id", "ids"] if name == "bpe" else docs.columns), name


def test_steps_begin_with_a_collection_in_the_executors(spark, monkeypatch):
    from weftline.llm import common

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans  # a local master has one JVM
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())
    monkeypatch.setattr(common, "REST_S", 0)
    before = full()
    assert common.materialise(spark.range(3), "test").count() == 3
    assert full() > before
