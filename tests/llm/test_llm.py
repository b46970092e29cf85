"""The training-data operators against plain versions, on texts with nulls, ties, copies and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nightgrid.llm import kernels as K
from nightgrid.llm import (
    op1_suffix_array, op2_line_dedup, op3_jaccard_join, op4_surrogates, op5_decontamination, op6_phrase_automata, op7_language_id, op8_source_mixing, op9_chat_repair, op10_quality_rules,
)
from nightgrid.llm.components import connected_components

R = random.Random(3)
WORDS = ["".join(R.choice("abcdefghé") for _ in range(R.randint(1, 7))) for _ in range(400)]


def prose(n, rnd=R):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages and lines, periodic and very long texts, nulls and empties."""
    base = [prose(120) for _ in range(6)]
    passage, line = prose(60), "A line that is held by very many documents indeed. "
    rows = []
    for i, b in enumerate(base):
        rows += [b, b.upper(), b + "\n" + line, line + "\n" + passage + "\n" + prose(20)]
        w = b.split(" ")
        w[R.randrange(len(w))] = "changed"
        rows += [" ".join(w), b]
    rows += ["a" * 700, "ab" * 300, "x " * 500, None, "", " \t\n", "one two", "one two", prose(5000), passage, "\n".join([line, line.upper(), "short", line]), "ü" * 250, prose(3) + "\x0b" + prose(40)]
    return [(i, t) for i, t in enumerate(rows)] + [(3, rows[3])]  # a repeated row


def frame(spark, rows):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.withColumns({c: F.lit("x") for c in ("rk", "n", "tok", "spans", "w", "_c", "block", "kept_text")})


def check(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("max_group", [20_000, 1])
def test_op1_against_brute_force(spark, texts, max_group):
    out = op1_suffix_array.remove_repeated_bytes(frame(spark, texts), max_group=max_group)
    got = out.select("doc_id", "n_units", (F.col("n_units") - F.length("kept")).alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256)).collect()
    check(got, brute.op1(texts))


@pytest.mark.parametrize("length", [12, 40])
def test_op1_other_lengths(spark, texts, length):
    out = op1_suffix_array.remove_repeated_bytes(frame(spark, texts[:30]), min_bytes=length)
    got = out.select("doc_id", "n_units", (F.col("n_units") - F.length("kept")).alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256)).collect()
    check(got, brute.op1(texts[:30], length))


@pytest.mark.parametrize("max_group", [20_000, 1])
def test_op6_against_brute_force(spark, texts, max_group):
    out = op6_phrase_automata.remove_recurring_passages(frame(spark, texts), max_group=max_group)
    removed = F.aggregate("spans", F.lit(0), lambda a, x: a + x["e"] - x["s"])
    check(out.select("doc_id", "n_units", removed, F.sha2("kept", 256)).collect(), brute.op6(texts))


def test_op6_occurrences_come_from_the_automaton():
    rnd = random.Random(11)
    p, q = prose(50, rnd), prose(35, rnd)
    segs = [s.encode() for s in (prose(9, rnd) + " " + p + " " + q, p + " " + prose(5, rnd), q + " x", q)]
    own, m = np.array([len(s.split()) - 34 for s in segs]), np.ones(4, int)
    passages = [t for _, t in op6_phrase_automata.recurring_passages(segs, own, m, 35)]
    assert sorted(passages) == sorted([p.encode(), q.encode()])
    spans = lambda known: [op6_phrase_automata.Shard(known).occurrences(s) for s in segs]
    assert spans(passages) == [sorted([(9, 59), (59, 94)]), [(0, 50)], [(0, 35)], [(0, 35)]]
    assert spans([q.encode()]) == [[(59, 94)], [], [(0, 35)], [(0, 35)]] and spans([]) == [[]] * 4


def test_op1_and_op6_on_nothing(spark):
    empty = frame(spark, [])
    assert op1_suffix_array.remove_repeated_bytes(empty).count() == 0 and op6_phrase_automata.remove_recurring_passages(empty).count() == 0


def test_bwt_boundaries_are_common_prefixes():
    rnd = np.random.default_rng(4)
    text = np.append(rnd.integers(1, 3, 400), 0).astype(np.uint8)
    text[100:160] = text[200:260]
    order = op1_suffix_array.sorted_rotations(text, 20)
    is_open = op1_suffix_array.open_boundaries(text, order, 20)
    raw = text.tobytes()
    want = [j > 0 and raw[order[j] : order[j] + 20] == raw[order[j - 1] : order[j - 1] + 20] and order[j] + 20 <= len(raw) for j in range(len(raw))]
    assert is_open.tolist() == want and sum(want) > 30


def test_op2_against_brute_force(spark, texts):
    docs = frame(spark, texts)
    for min_docs in (2, 5):
        out = op2_line_dedup.apply_bitmaps(docs, op2_line_dedup.line_keep_bitmaps(docs, min_docs=min_docs))
        got = out.select("doc_id", "dedup.n_lines", "dedup.n_dropped", F.sha2(F.col("dedup.kept").cast("binary"), 256)).collect()
        check(got, brute.op2(texts, min_docs=min_docs))
    assert op2_line_dedup.line_keep_bitmaps(frame(spark, [])).count() == 0


def test_op2_string_ids(spark):
    line = "this one line is in every single document of all"
    docs = spark.createDataFrame([(f"d{i}", f"a\n{line}\n{i}") for i in range(8)] + [(None, line)], "doc_id string, text string")
    out = op2_line_dedup.apply_bitmaps(docs, op2_line_dedup.line_keep_bitmaps(docs)).select("doc_id", "dedup.n_dropped").collect()
    assert {r[0]: r[1] for r in out} == {f"d{i}": int(i < 7) for i in range(8)} | {None: 1}


def test_op2_hot_line_over_many_partitions(spark):
    line = "this one line is in every single document of all"
    rows = [(i, f"{prose(9)}\n{line}\n{i}") for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        out = op2_line_dedup.apply_bitmaps(docs, op2_line_dedup.line_keep_bitmaps(docs)).select("doc_id", "dedup.n_dropped").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r[0] for r in out if r[1] == 0} == {299} and all(r[1] == 1 for r in out if r[0] != 299)


def test_op2_keep_bitmap_is_compressed_bits(spark):
    line = "this one line is in every single document of all"
    docs = spark.createDataFrame([(i, f"a\n{line}\nb") for i in range(6)], "doc_id long, text string")
    maps = [zlib.decompress(r["keep"]) for r in op2_line_dedup.line_keep_bitmaps(docs).collect()]
    assert len(maps) == 5 and all(np.unpackbits(np.frombuffer(m, np.uint8), count=3).tolist() == [1, 0, 1] for m in maps)


def near(text, rnd, share):
    w = text.split(" ")
    for _ in range(int(share * len(w))):
        w[rnd.randrange(len(w))] = rnd.choice(WORDS)
    return " ".join(w)


def test_op3_against_brute_force(spark, texts):
    rnd = random.Random(8)
    rows = list(texts)
    for g in range(4):
        base = prose(150, rnd)
        for k in range(40):  # families on either side of the threshold, chains among them
            rows.append((1000 + 100 * g + k, near(base, rnd, rnd.choice([0.005, 0.01, 0.02, 0.03, 0.05]))))
            if k % 10 == 0:
                base = near(base, rnd, 0.015)
    rows += [(None, texts[0][1]), (None, None)]
    got = op3_jaccard_join.jaccard_components(frame(spark, rows)).collect()
    check(got, brute.op3(rows))
    assert op3_jaccard_join.jaccard_components(frame(spark, [])).count() == 0


def test_op3_members_that_are_subsets_of_their_centers(spark):
    rnd, rows = random.Random(5), []
    for f in range(24):
        own = lambda n: " ".join(f"{f}w{rnd.randrange(1 << 40)}" for _ in range(n))
        x = own(88)
        y = x + " " + own(10)
        rows += [(len(rows) + k, t) for k, t in enumerate([x, x + " " + own(9), y, y + " " + own(16)])]
    want = brute.op3(rows)
    assert {c for _, _, c in want} == set(range(0, 96, 4))
    check(op3_jaccard_join.jaccard_components(frame(spark, rows)).collect(), want)


def test_op3_many_rows_of_one_key_verify_one_pair(spark):
    a = prose(100)
    b = a + " one"
    got = op3_jaccard_join.jaccard_components(spark.createDataFrame([(None, a)] * 3000 + [(None, b)] * 3000 + [(5, b)], "doc_id string, text string")).collect()
    assert len(got) == 6001 and {r["component_id"] for r in got} == {"5"}


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0 and got[129] == 100


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def test_op4_surrogates(spark):
    t = "Mr. Smith met Mrs. Anna Jones, MRS. ANNA; Frau Müller, Господин Иванов. Card 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112; a.b@mail.example.com A.B@MAIL.EXAMPLE.COM, 123-45-6789, +1 (212) 555-1234, 10.0.0.1, " + "ab12" * 10
    rows = [(1, t), (2, "again Mr Smith, 10.0.0.1 and 10.0.0.2"), (3, None), (4, ""), (None, "no one here 12 34"), (1, t)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("kind", "m", "new", "at", "kinds")})
    got = [r for r in op4_surrogates.replace_entities(df).collect()]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and by[3]["text"] is None and by[4]["text"] == "" and by[None]["text"] == "no one here 12 34" and by[3]["n_entities"] == 0
    new = by[1]["text"]
    for old in ("Smith", "Jones", "Müller", "Иванов", "4111", "a.b@", "123-45", "(212)", "10.0.0.1", "ab12ab12"):
        assert old not in new
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", new)
    assert cards[0].replace(" ", "") == cards[1] and luhn(cards[1]) and not luhn(cards[2])
    mails = re.findall(r"\S+@\S+\.com", new, re.I)
    assert mails[1] == mails[0].upper()
    assert re.search(r"Господин [А-Я][а-я]+", new) and re.search(r"\+1 \(\d{3}\) 555-\d{4}", new)
    smith = re.search(r"Mr\. (\w+) met", new).group(1)
    assert f"Mr {smith}," in by[2]["text"] and not smith.endswith("a") and re.search(r"Frau \w+a[,;]", new)
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", by[2]["text"])
    assert len(set(ips)) == 2 and ips[0] in new


@pytest.mark.parametrize("digits", [128, 129, 512])
def test_op4_long_secrets(spark, digits):
    secret = "".join(random.Random(digits).choices("0123456789abcdef", k=digits))
    got = op4_surrogates.replace_entities(frame(spark, [(1, f"key {secret} end"), (2, f"no key x{secret}")])).collect()
    by = {r["doc_id"]: r for r in got}
    assert secret not in by[1]["text"] and re.fullmatch(f"key [0-9a-f]{{{digits}}} end", by[1]["text"]) and by[1]["kinds"] == {"secret": 1}
    assert by[2]["text"] == f"no key x{secret}"


def test_op4_surrogates_stay_distinct(spark):
    rows = [("ip", f"1.1.{i // 200}.{i % 200}") for i in range(500)] + [("ssn", f"{i:09d}") for i in range(500)]
    got = op4_surrogates.surrogates(spark.createDataFrame(rows, "kind string, canon string")).collect()
    assert len(got) == 1000 and len({(r["kind"], r["surrogate"]) for r in got}) == 1000 and not {(r["kind"], r["surrogate"]) for r in got} & set(rows)
    tiny = spark.createDataFrame([("phone", str(i)) for i in range(10)], "kind string, canon string")
    full = op4_surrogates.surrogates(tiny).collect()  # ten one-digit entities: no free value is left, so tags
    assert len({r["surrogate"] for r in full}) == 10


def test_op4_two_hundred_thousand_names_get_no_tag(spark):
    rows = spark.range(200_000).selectExpr("'name' AS kind", "concat('q', lower(conv(id, 10, 36)), 'w') AS canon")
    got = op4_surrogates.surrogates(rows)
    n, distinct, tags = got.agg(F.count("*"), F.count_distinct("surrogate"), F.count_if(F.col("surrogate").startswith("["))).first()
    assert (n, distinct, tags) == (200_000, 200_000, 0)


def test_op4_coreference_and_distinctness_by_hand(spark):
    """Each name word and number is replaced by one form wherever it stands, and different ones by different forms."""
    rnd = random.Random(15)
    given, family = [f"{a}{b}" for a in ("Ann", "Bor", "Cel", "Dan") for b in ("a", "is", "ia")], [f"{a}{b}" for a in ("Smith", "Jon", "Mill", "Carv") for b in ("son", "er", "ley")]
    rows, said = [], []
    for i in range(120):
        title, g, f = rnd.choice(["Mr", "Mrs", "Dr", "Prof."]), rnd.choice(given), rnd.choice(family)
        phone = f"{rnd.choice(['+1 ', ''])}(212) 555-{rnd.randrange(30):04}"
        form = rnd.choice([f"{title} {g} {f}", f"{title} {f}"])
        rows.append((i, f"here {form} left {phone} today"))
        said.append((form.split()[1:], phone))
    new, seen = {r["doc_id"]: r["text"] for r in op4_surrogates.replace_entities(frame(spark, rows)).collect()}, {}
    for i, (words, phone) in enumerate(said):
        m = re.fullmatch(r"here (?:Mr|Mrs|Dr|Prof\.) ((?:\w+ )+)left (.*) today", new[i])
        for old, now in [*zip(words, m.group(1).split(), strict=True), (phone.replace("+1 ", ""), m.group(2).replace("+1 ", ""))]:
            assert seen.setdefault(old, now) == now and old != now
        assert m.group(2).startswith("+1") == phone.startswith("+1")
    assert len(set(seen.values())) == len(seen)


def test_op4_scripts_and_other_kinds(spark):
    texts = ["Dear Ana Lopez, hello", "my name is Jane Roe", "السيد محمد هنا", "מר כהן כאן", "श्रीमती शर्मा यहाँ", "昨天王小明先生来了", "田中さんは", "김철수 씨가", "at 2001:db8::ff00:42:8329 now", "pay DE89 3704 0044 0532 0130 00 now", "lives at 12 Baker Street now", "nothing to see Here", "x" * 300_000 + " Mr Longtext"]
    got = [r for r in sorted(op4_surrogates.replace_entities(frame(spark, list(enumerate(texts)))).collect(), key=lambda r: r["doc_id"])]
    assert [r["n_entities"] for r in got] == [1] * 11 + [0, 1]
    for r, gone in zip(got, ["Lopez", "Roe", "محمد", "כהן", "शर्मा", "小明", "田中", "철수", "8329", "0532", "Baker"]):
        assert gone not in r["text"]
    script = [r"[a-zA-Z, ]+", r"[a-zA-Z ]+", r"[\u0600-\u06ff ]+", r"[\u0590-\u05ff ]+", r"[\u0900-\u097f ]+", r"[\u4e00-\u9fff]+", r"[\u4e00-\u9fff\u3040-\u30ff]+", r"[\uac00-\ud7af ]+"]
    assert all(re.fullmatch(p, r["text"]) for p, r in zip(script, got))
    iban = re.search(r"DE\d\d( \d{4}){4} \d\d", got[9]["text"]).group().replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and re.fullmatch(r"lives at \d\d \w+ Street now", got[10]["text"])


def test_op5_finds_exact_and_changed_items_and_no_others(spark):
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("bcdfgaeiou") for _ in range(6)) for _ in range(3000)]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [say(rnd.randint(15, 55)) for _ in range(20)]
    rows, want = [], set()
    for i in range(200):
        w = say(rnd.randint(50, 400))
        if i % 4 == 0:
            k = i // 4 % 20
            leak = list(items[k])
            if i % 8 == 0:
                for _ in range(len(leak) // 8):
                    leak[rnd.randrange(len(leak) - 4)] = rnd.choice(vocab)
            at = rnd.randrange(len(w))
            w[at:at] = leak
            want.add((i, k))
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " ".join(items[3]).upper()), (None, "some other words")]
    want.add((902, 3))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(98, None), (99, " ")], "item_id long, text string").withColumn("n", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in op5_decontamination.contaminated(frame(spark, rows), bench).collect()}
    assert got == want
    assert op5_decontamination.contaminated(frame(spark, rows), bench.limit(0)).count() == 0 and op5_decontamination.contaminated(frame(spark, []), bench).count() == 0


def test_op5_long_items_exact_and_changed(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [say(200), say(1000), say(30)]
    changed = lambda t, share: " ".join(word() if rnd.random() < share else x for x in t.split())
    rows = [(i, say(150)) for i in range(200)]
    for k, t in enumerate(items[:2]):
        rows += [(300 + k, say(40) + " " + t + " " + say(40)), (310 + k, say(30) + " " + changed(t, 0.25) + " " + say(70)), (320 + k, say(50) + " " + " ".join(t.split()[: len(t.split()) // 3]))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op5_decontamination.contaminated(frame(spark, rows), bench).collect()}
    assert got == {(300, 0), (301, 1), (310, 0), (311, 1)}


def test_op5_recall_against_aligning_every_document(spark):
    """Candidates from the latent space against aligning every item with every document, on changed, thinned and padded items."""
    rnd = random.Random(18)
    vocab = ["".join(rnd.choice("bcdfgaeiou") for _ in range(6)) for _ in range(2500)]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [say(rnd.randint(12, 80)) for _ in range(60)]
    rows = []
    for i in range(400):
        w, leak = say(rnd.randint(40, 200)), list(items[i % 60])
        for _ in range(int(rnd.choice([0, 0.1, 0.2, 0.3, 0.4, 0.5]) * len(leak))):
            k = rnd.randrange(len(leak))
            leak[k : k + 1] = rnd.choice([[], say(1), [leak[k], *say(1)]])
        at = rnd.randrange(len(w))
        rows.append((i, " ".join(w[:at] + leak + w[at:])))
    bench = spark.createDataFrame([(f"item {k}", " ".join(x)) for k, x in enumerate(items)], "item_id string, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op5_decontamination.contaminated(frame(spark, rows), bench).collect()}
    number = {w: k for k, w in enumerate(vocab)}
    want = set()
    for k, x in enumerate(items):
        it = op5_decontamination.Item([number[w] for w in x])
        for i, t in rows:
            share, answer = it.check([number[w] for w in t.split()])
            if share >= op5_decontamination.SURE_LCS or share >= op5_decontamination.MIN_LCS and answer >= op5_decontamination.MIN_ANSWER:
                want.add((i, f"item {k}"))
    assert len(want) > 200 and len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(got)


def test_op5_alignment():
    it = op5_decontamination.Item([1, 2, 3, 4, 5, 6, 7, 8, 9, 10])
    assert it.lcs([1, 2, 9, 3, 4, 5]) == 5 and it.check([0, 0, *range(1, 11), 0])[0] == 1.0 and it.check([5, 4, 3])[0] == 0.0


LANGS = {"xx": "kato miru seno tavi", "yy": "groß über straße zähn", "zz": "ñandu año niño caña"}


def test_op7_learns_and_handles_odd_texts(spark):
    rnd = random.Random(6)
    say = lambda k, n: " ".join(rnd.choice(LANGS[k].split()) + rnd.choice(["", "a", "o"]) for _ in range(n))
    rows = [(i, say(k, rnd.randint(5, 60)), k) for i, k in enumerate(list(LANGS) * 120)]
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 34 !!", "yy"), (1003, "GROSS ÜBER STRASSE", None), (None, "año niño", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("bits", F.lit("x"))
    model = op7_language_id.train(df)
    got = {r["doc_id"]: r for r in op7_language_id.predict(df, model).collect()}
    true = {r[0]: r[2] for r in rows}
    assert all(got[i]["lang_pred"] == true[i] for i in range(360)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002)) and got[1003]["lang_pred"] == "yy"
    held = {r["doc_id"]: r["h"] for r in df.select("doc_id", op7_language_id.held_out().alias("h")).collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(360))
    assert op7_language_id.train(df.filter("lang IS NULL")) is None
    assert {r["lang_pred"] for r in op7_language_id.predict(df, None).collect()} == {"und"}


def test_op7_learns_every_language(spark, monkeypatch):
    rnd = random.Random(4)
    langs = [f"l{k:02}" for k in range(70)]
    words = {g: ["".join(chr(0x4E00 + 40 * k + rnd.randrange(40)) for _ in range(4)) for _ in range(30)] for k, g in enumerate(langs)}
    rows = [(i, " ".join(rnd.choice(words[langs[i % 70]]) for _ in range(30)), langs[i % 70]) for i in range(70 * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert op7_language_id.train(df).langs == langs
    monkeypatch.setattr(op7_language_id, "MAX_SAMPLE", 140)
    model = op7_language_id.train(df)
    assert model.langs == langs
    want = {i: g for i, _, g in rows}
    got = op7_language_id.predict(df, model).collect()
    assert len(got) == len(rows) and sum(r["lang_pred"] == want[r["doc_id"]] for r in got) > 0.9 * len(rows)
    few = spark.createDataFrame([(k, f"{'abcdefgh'[k % 8]} text number", f"one{k}") for k in range(40)], df.schema)
    assert set(op7_language_id.train(few).langs) == {r["lang"] for r in few.filter(~op7_language_id.held_out()).collect()}


def test_op7_probabilities_sum_to_one():
    bits, rnd = op7_language_id.BITS, np.random.default_rng(1)
    pack = lambda *s: sum(x << (bits * k) for k, x in enumerate(reversed(s)))
    keys, n = np.unique(pack(*(rnd.integers(0, 4, 500) for _ in range(4))), return_counts=True)
    m = op7_language_id.Model(["a"], np.array([97], np.uint32), [(keys, n.astype(float))])
    for context in (pack(1, 2, 3), pack(15, 15, 15)):
        p = m._prob(m.tables[0], 3, context << bits | np.arange(op7_language_id.N_SYMBOLS))
        assert abs(p.sum() - 1) < 1e-9


def test_op7_held_out_accuracy_and_many_letters(spark):
    """Languages of one script with thousands of letters are told apart on documents that training never saw."""
    rnd = random.Random(14)
    words = {g: ["".join(chr(0x4E00 + rnd.randrange(1500)) for _ in range(3)) for _ in range(80)] for g in ("p", "q", "r")}
    rows = [(i, " ".join(rnd.choice(words["pqr"[i % 3]]) for _ in range(25)), "pqr"[i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows + [(None, rows[0][1], "p")] * 30 + [(9000, "", None)], "doc_id long, text string, lang string")
    held = df.filter(op7_language_id.held_out() & F.col("lang").isNotNull())
    got = op7_language_id.predict(held, op7_language_id.train(df)).collect()
    want = {i: g for i, _, g in rows}
    assert len(got) > 100 and sum(r["lang_pred"] == want[r["doc_id"]] for r in got) > 0.97 * len(got)


def test_op8_against_plain_version(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 30)), rnd.choice(["en", "de", None]), rnd.choice(["src0", "src1", "src12", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("domain", op8_source_mixing.domain_of()).withColumn("total", F.lit("x"))
    for budget in (None, 900, 60_000):
        got = {r["doc_id"]: r["copies"] for r in op8_source_mixing.mix(df, op8_source_mixing.WEIGHTS, budget).collect()}
        held, by = Counter(), {}
        for i, t, lang, source in rows:
            d = "community" if source in (None, "src12") else "web" if source == "src0" else "reference"
            k = (d, lang or "", source or "")
            held[k] += len(t.split())
            by.setdefault(k, []).append((i, len(t.split())))
        held = {k: v for k, v in held.items() if v}
        total = sum(held.values()) if budget is None else budget
        above = Counter()
        for k, v in held.items():
            above[k[:2]] += v
        plan = op8_source_mixing.plan(above, op8_source_mixing.WEIGHTS, total)
        assert sum(plan.values()) <= total
        want = {}
        for k, docs in by.items():
            if k not in held:
                continue
            full, rest = divmod(held[k] * plan.get(k[:2], 0) // above[k[:2]], held[k])
            run = 0
            for _, i, n in sorted((hashlib.md5(f"{op8_source_mixing.SEED}:{full}:{i}".encode()).hexdigest(), i, n) for i, n in docs if n):
                run += n
                if full + (run <= rest):
                    want[i] = full + (run <= rest)
        assert got == want
    assert op8_source_mixing.mix(df.limit(0), op8_source_mixing.WEIGHTS).count() == 0


def test_op8_shortage_goes_to_siblings_first():
    n = op8_source_mixing.Node
    assert op8_source_mixing.share_out(100, {"a": n(1, 10), "b": n(1, 1000), "c": n(2, 1000)}) == {"a": 10, "b": 30, "c": 60}
    assert op8_source_mixing.share_out(100, {"a": n(1, 10), "b": n(0, 50)}) == {"a": 10, "b": 0}
    held = {("web", "en"): 10, ("web", "de"): 1000, ("reference", "en"): 1000}
    w = {"web": (0.5, {"en": 0.5, "de": 0.5}), "reference": (0.5, {"en": 1.0})}
    assert op8_source_mixing.plan(held, w, 400, 1) == {("web", "en"): 10, ("web", "de"): 190, ("reference", "en"): 200}


def test_op8_repeated_rows_never_exceed_the_budget(spark):
    rows = [(None, "same words here", "en", "src0")] * 50 + [(7, "one more of these", "en", "src0")] * 9 + [(i, "w " * (i % 7 + 1), "en", "src0") for i in range(40, 60)] + [(None, None, None, None), (None, "x " * 3000, "en", "src3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("domain", op8_source_mixing.domain_of()).repartition(3)
    weights = {"web": (1.0, {"en": 1.0})}
    held = sum(len(r[1].split()) for r in rows if r[3] == "src0")
    for budget in (20, 101, 170, held + 77, 3 * held + 5):
        got = op8_source_mixing.mix(df, weights, budget).collect()
        used = sum(r["n_tokens"] * r["copies"] for r in got)
        assert budget - 7 < used <= budget and all(r["copies"] >= 1 for r in got) and len(got) <= 79


def cheapest(roles):
    """Dijkstra over (turns done, state) with single empty insertions as edges: a plain check of the dynamic program."""
    import heapq

    q = op9_chat_repair
    heap, seen = [(0, 0, q.START)], set()
    while heap:
        c, i, s = heapq.heappop(heap)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(roles) and s in q.FINAL:
            return c
        for b in q.LEGAL[s]:
            heapq.heappush(heap, (c + q.INSERT, i, b))
            if i < len(roles):
                heapq.heappush(heap, (c + (0 if b == roles[i] else q.RELABEL), i + 1, b))
        if i < len(roles) and s != q.START:
            heapq.heappush(heap, (c + q.MERGE + (0 if s == roles[i] else q.RELABEL), i + 1, s))


def test_op9_is_cheapest_and_legal(spark):
    rnd = random.Random(12)
    rows = [(c, t, rnd.choice(["system", "user", "assistant", "tool", None, "bot"]), f"text {c} {t}") for c in range(60) for t in range(rnd.randint(1, 9))]
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", "x") for t in range(1400)] + [(None, 0, "user", None), (None, 1, "assistant", "<|end|>"), (501, None, "user", "a"), (501, 1, "user", "a"), (501, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit("x"), "block": F.lit("y")})
    out = op9_chat_repair.repair_roles(df).collect()
    assert len(out) == len(rows)
    by = {}
    for r in sorted(out, key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, -1 if r["turn"] is None else r["turn"])):
        by.setdefault(r["conv_id"], []).append(r)
    given = {}
    for r in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "")):
        given.setdefault(r[0], []).append(op9_chat_repair.role_number(r[2]))
    for conv, turns in by.items():
        assert sum(r["cost"] for r in turns) == cheapest(given[conv]), conv
        shown = re.findall(r"<\|(system|user|assistant|tool)\|>", "".join(r["piece"] for r in turns))
        state = op9_chat_repair.START
        for x in shown:
            assert op9_chat_repair.ROLES.index(x) in op9_chat_repair.LEGAL[state], (conv, shown)
            state = op9_chat_repair.ROLES.index(x)
        assert state in op9_chat_repair.FINAL
    assert all(r["action"] == "keep" for r in by[500]) and "".join(r["piece"] for r in by[500]).endswith("<|end|>\n")
    assert op9_chat_repair.repair_roles(df.limit(0)).count() == 0


def test_op9_string_ids_and_turns_without_numbers(spark):
    rows = [("c-1", None, "user" if k % 3 else "tool", f"t{k:05}") for k in range(1300)] + [("c-1", 0, "assistant", "z"), ("c-0", 1, "user", "q"), (None, 1, "user", "x" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(3)
    out = op9_chat_repair.repair_roles(df).collect()
    assert len(out) == len(rows)
    given = [op9_chat_repair.role_number(r[2]) for r in sorted(rows[:1301], key=lambda r: (r[1] is not None, r[2]))]
    assert sum(r["cost"] for r in out if r["conv_id"] == "c-1") == cheapest(given)
    assert [r["new_role"] for r in out if r["conv_id"] == "c-0"] == ["user"]


def test_op10_statistics(spark, texts):
    rows = texts + [(700, "a b c d e x a b c d e"), (701, "s s s s s s s"), (702, "l1\nl1\n \nl1\n l1 #$"), (None, "A!? 12")]
    got = op10_quality_rules.with_statistics(frame(spark, rows)).select("doc_id", "text", "_qr_stats.*").collect()
    for r in got:
        t = r["text"] or ""
        w = t.encode().split()
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)), t[:60]


def test_op10_learns_and_keeps_clean(spark):
    rnd = random.Random(2)
    rows, lab = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rnd.choice(WORDS) + ("###" if bad and rnd.random() < 0.7 else "") for _ in range(rnd.randint(12, 60))]
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            lab.append((i, 0 if bad else 1))
    docs = frame(spark, rows)
    labels = spark.createDataFrame(lab + [(None, 1), (5000, None)], "doc_id long, quality int")
    rules = op10_quality_rules.train(docs, labels)
    kept = {r["doc_id"]: r["_qr_kept"] for r in op10_quality_rules.judge(docs, rules).collect()}
    assert rules and all(kept[i] == (i % 4 != 0) for i in range(400))
    assert op10_quality_rules.train(docs, labels.limit(0)) == [] and op10_quality_rules.judge(frame(spark, []), rules).count() == 0
    assert len(op10_quality_rules.train(docs, labels, max_train=40)) <= op10_quality_rules.MAX_RULES
    repeated = labels.filter("doc_id < 8").crossJoin(spark.range(100)).drop("id").unionByName(labels)
    assert op10_quality_rules.train(docs.withColumn("_qr_t", F.lit(1)), repeated, max_train=60) is not None


def test_words_and_hashes_on_slices():
    texts = ["ab cd", "", "ab  cd\n", "Ab", None, "cd ab"]
    parts = list(K.slices(pa.array(texts), limit=6))
    seen = []
    for i, j, buf, offs in parts:
        w = K.Words(buf, offs)
        for k in range(j - i):
            seen.append([buf[a:b].tobytes() for a, b in zip(w.start[w.first[k] : w.first[k + 1]], w.end[w.first[k] : w.first[k + 1]])])
    assert seen == [(t or "").encode().split() for t in texts]
    h = [K.Words(*K.flat(pa.array([t]))).hashes(lower=True).tolist() for t in ("Ab", "aB", "ba")]
    assert h[0] == h[1] != h[2]
