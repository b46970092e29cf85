"""op12 against whole-text encoding and a plain alignment."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nightgrid.llm import op12_token_alignment as op12

R = random.Random(12)
A = Tokenizer.from_file(f"{op12.TOKENIZERS}/{op12.TOKENIZER_A}")
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=f"{op12.TOKENIZERS}/{op12.TOKENIZER_B}")
BYTES_A = op12.tokenizer(f"{op12.TOKENIZERS}/{op12.TOKENIZER_A}").bytes
WORDS = ["the", "alignment", "naïve", "Straße", "日本語", "12345", "don't", "x_y", "🙂", "zusammen", "l'été", "a", "https://x.org/a?b=1", "\n", "\t", "\n\n ", "  ", "   y", "ﬁne", " nbsp", "end.\r\n", "\x1c", "_", "<s>", "<|endoftext|>"]
TEXTS = [None, "", " ", "  ", "\n", "a", "a ", " a", "a  b", "a \n b", "a\n  b c", "\x1cq \x1d r", "with ▁ mark", "<unk> </s> <0x41>", "<|endoftext|> is text", "é" * 50, "aaaa" * 300, "=" * 500 + " " * 77 + "!" * 30, " em　space"]
TEXTS += ["".join(R.choice(WORDS) + R.choice([" ", " ", " ", "", "\n"]) for _ in range(R.randint(1, 120))) for _ in range(60)]
TEXTS += [" ".join(R.choice(WORDS) for _ in range(6000)), "ab" * 40_000]


def piece_bytes(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def plain(text):
    """(A ids, B ids, groups, links) by encoding the whole text and going over its bytes."""
    if not text:
        return [], [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    ta, tb = [BYTES_A[i] for i in a], [piece_bytes(i) for i in b]
    if not b"".join(ta) == b"".join(tb) == (" " + text).encode():
        return [], [], [], []
    own_a, own_b = ([k for k, t in enumerate(x) for _ in t] for x in (ta, tb))
    links = list(dict.fromkeys(zip(own_a, own_b)))
    groups, ga, gb = [], [], []
    for k in range(len(own_a)):
        end_a, end_b = k + 1 == len(own_a) or own_a[k + 1] != own_a[k], k + 1 == len(own_b) or own_b[k + 1] != own_b[k]
        ga += [a[own_a[k]]] if end_a else []
        gb += [b[own_b[k]]] if end_b else []
        if end_a and end_b:
            groups.append((ga, gb))
            ga, gb = [], []
    return a, b, groups, [(a[x], b[y]) for x, y in links]


def brute(rows):
    done = [(i, *plain(t)) for i, t in rows]
    count = Counter(pair for *_, links in done for pair in links)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for i, a, b, groups, links in done:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("id", "rk", "at", "side", "a", "b", "n", "part")})


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("hot,stretch", [(op12.HOT_PAIRS, op12.STRETCH), (300, 1000), (0, 64)])
def test_against_brute_force(spark, monkeypatch, hot, stretch):
    monkeypatch.setattr(op12, "STRETCH", stretch)
    rows = list(enumerate(TEXTS)) + [(None, "null id"), (5, TEXTS[5]), (5, TEXTS[5]), (70, TEXTS[70]), (70, "other text")]
    events = op12._events

    def short(paths):  # the workers import the module anew, so the constant goes along
        inner = events(paths)

        def run(batches):
            op12.STRETCH = stretch
            yield from inner(batches)

        return run

    monkeypatch.setattr(op12, "_events", short)
    aligned = op12.align(frame(spark, rows))
    out = op12.summarise(aligned, op12.pair_counts(aligned), hot_pairs=hot)
    assert order(tuple(r) for r in out.collect()) == order(brute(rows))
    if stretch < 2000:
        assert aligned.filter("part > 0").count() > 0


def test_groups_and_links(spark):
    rows = list(enumerate(TEXTS[:40]))
    aligned = op12.align(frame(spark, rows))
    got = {r["id"]: [(list(g["a"]), list(g["b"])) for g in r["groups"]] for r in op12.groups(aligned).collect()}
    linked = {r["id"]: [tuple(x) for x in r["links"]] for r in op12.links(aligned).collect()}
    for i, t in rows:
        _, _, groups, links = plain(t)
        assert got[i] == groups and linked[i] == links


def test_encoding_by_stretches_equals_whole_texts():
    pool = op12._Pool((op12.tokenizer(f"{op12.TOKENIZERS}/{op12.TOKENIZER_A}"), op12.tokenizer(f"{op12.TOKENIZERS}/{op12.TOKENIZER_B}")))
    assert pool.splits
    texts = [t for t in TEXTS if t]
    (a, na), (b, nb) = pool.encode(texts)[0]
    for t, ea, eb in zip(texts, na.cumsum().tolist(), nb.cumsum().tolist()):
        assert a[:ea][-len(x := A.encode(" " + t, add_special_tokens=False).ids) :].tolist() == x
        assert b[:eb][-len(x := B.encode(t)) :].tolist() == x


def test_empty_table(spark):
    aligned = op12.align(frame(spark, []).limit(0))
    assert op12.summarise(aligned, op12.pair_counts(aligned)).collect() == []
