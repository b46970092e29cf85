"""The corpus pipeline, stage by stage, against plain versions of its decisions on a small corpus."""

import random
from collections import Counter

import brute
import pytest

import corpus_pipeline
from nightgrid.llm import op10_quality_rules

R = random.Random(21)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(900)]


def say(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    items = [say(R.randint(18, 40)) for _ in range(5)]
    line = "every one of these documents carries this same long line"
    rows = []
    for i in range(160):
        t = say(R.randint(30, 120)) + ("\n" + line if i % 3 == 0 else "")
        if i % 10 == 9:
            t = say(20) + " " + items[i % 5] + " " + say(20)
        if i % 20 == 5:
            t = " ".join(w + "###" for w in say(40).split())
        if i % 16 == 8:
            t = rows[i - 2][1]
        if i % 40 == 17:
            t = say(5)
        rows.append((i, t, R.choice(["en", "de"]), R.choice(["src0", "src3", "src15"])))
    rows += [(1000, None, "en", "src0"), (1001, "", None, None)]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{d}/documents.parquet")
    bad = {i for i, t, *_ in rows if t and "###" in t}
    spark.createDataFrame([(i, 0 if i in bad else 1, 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), items


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, folder):
    d, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols = docs.columns
    before = rows_of(docs)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "ngram_jaccard_join", "decontamination", "source_mixing"]

    def base_failed(t):
        w = (t or "").split()
        g = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if g[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        return len(w) < 10 or 100 * len(hit) > 20 * len(w)

    df = stages["quality_rules"](spark, docs, d)
    got = rows_of(df)
    assert df.columns == cols and set(got) == {i for i, r in before.items() if not base_failed(r["text"]) and "###" not in r["text"]}
    assert op10_quality_rules.train(docs, spark.read.parquet(f"{d}/labels.parquet"))

    df2 = stages["line_dedup"](spark, df, d)
    after = rows_of(df2)
    want = {i: s for i, _, _, s in brute.op2([(i, r["text"]) for i, r in got.items()])}
    assert df2.columns == cols and {i: brute.sha(r["text"].encode()) for i, r in after.items()} == want and all(r["n_chars"] == len(r["text"]) for r in after.values())

    df3 = stages["ngram_jaccard_join"](spark, df2, d)
    kept = rows_of(df3)
    assert df3.columns == cols and set(kept) == {i for i, _, c in brute.op3([(i, r["text"]) for i, r in after.items()]) if i == c}

    df4 = stages["decontamination"](spark, df3, d)
    clean = rows_of(df4)
    assert df4.columns == cols and set(clean) == {i for i, r in kept.items() if not any(x in r["text"] for x in items)}

    mixed = rows_of(stages["source_mixing"](spark, df4, d))
    assert set(mixed) <= set(clean) and len(mixed) > 0.5 * len(clean) and all(r["copies"] >= 1 for r in mixed.values())
    whole = rows_of(corpus_pipeline.run(spark, d))
    assert {i: r["copies"] for i, r in whole.items()} == {i: r["copies"] for i, r in mixed.items()}


def linked(a, b):
    x, y = brute.shingles(a, 5), brute.shingles(b, 5)
    return 10 * len(x & y) >= 8 * len(x | y)


def test_near_duplicates_at_five_words_and_four_fifths(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(8))
    texts = []
    for k in range(20):
        base = [word() for _ in range(100)]
        texts += [" ".join(base), " ".join(base + [word() for _ in range(15 + k)])]
    first = {2 * k for k in range(20)}
    want = first | {2 * k + 1 for k in range(20) if not linked(texts[2 * k], texts[2 * k + 1])}
    assert first < want < set(range(40))
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


def test_null_and_repeated_ids(spark, tmp_path):
    rnd = random.Random(9)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(8)) for _ in range(n))
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], cols)
    pairs = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    a, b, c, d, e = (text(60) for _ in range(5))
    rows = [(None, a), (None, a + " x"), (4, b), (4, b), (4, b), (7, c), (7, d), (6, d), (None, d), (None, None), (None, None), (8, e)]
    got = pairs(corpus_pipeline.near_duplicates(spark, frame(rows), ""))
    assert sum(got[None, t] for t in (a, a + " x")) == 1
    del got[None, a], got[None, a + " x"]
    assert got == Counter({(4, b): 1, (7, c): 1, (6, d): 1, (None, None): 2, (8, e): 1})

    item = text(30)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(3, text(60)), (None, text(60))] + [(100 + k, text(60)) for k in range(30)]
    got = pairs(corpus_pipeline.decontaminate(spark, frame(clean + [(3, text(20) + " " + item), (None, item + " " + text(20))]), str(tmp_path)))
    assert got == Counter(clean)
