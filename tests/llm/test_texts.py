import os
import random

import numpy as np
import pytest

from spanlattice.llm.mixing import Mix
from spanlattice.llm.reading import Levels, _patterns, level_chances, reading_levels, respond, units_of
from spanlattice.llm.tokens import byte_characters, count_tokens, decode, encode, encode_with_offsets, load, vocabulary

pytestmark = pytest.mark.skipif(not os.path.exists(vocabulary()), reason="no tokenizer files")
DOCS = "doc_id bigint, text string, source string, bitext_id string, pair_seq bigint, ids string, n_tokens int"
TEXTS = [None, "", " ", "plain words", "plain words", "日本語のテキスト", "naïve café 🙂🙃", "<|endoftext|> is text", "a\r\nb\t c" * 3, "x" * 30_000, "👩‍🔬"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "s", None, None, "clash", 1) for i, t in enumerate(texts)], DOCS)


def test_ids(spark):
    t = load(vocabulary())
    got = {r.doc_id: r.ids for r in encode(docs(spark), "doc_id", "text", vocabulary()).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    assert got[0] == got[1] == [] and 50256 not in got[7]
    counts = {r.doc_id: r.n_tokens for r in count_tokens(docs(spark), ["doc_id"], "text", vocabulary()).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert encode(docs(spark, []), "doc_id", "text", vocabulary()).count() == 0


def test_round_trip_and_offsets(spark):
    encoded = encode_with_offsets(docs(spark), "doc_id", "text", vocabulary())
    back = {r.doc_id: r for r in decode(encoded, "doc_id", "ids", vocabulary()).collect()}
    for r in encoded.collect():
        text = TEXTS[r.doc_id] or ""
        raw = text.encode()
        assert bytes(back[r.doc_id].bytes) == raw and back[r.doc_id].text == text
        assert r.byte_from == [0, *r.byte_to][: len(r.ids)] and (not r.ids or r.byte_to[-1] == len(raw))
        for a, b, x, y in zip(r.char_from, r.char_to, r.byte_from, r.byte_to):
            assert raw[x:y] in text[a:b].encode() if a < b else True


def test_split_character(spark):
    encoded = load(vocabulary()).encode("🙂", add_special_tokens=False).ids
    cut = spark.createDataFrame([(1, encoded[:1]), (2, []), (3, None)], "doc_id bigint, ids array<int>")
    got = {r.doc_id: (r.bytes, r.text) for r in decode(cut, "doc_id", "ids", vocabulary()).collect()}
    assert len(encoded) > 1 and got[1][1] == "�" and got[2] == (b"", "") and got[3] == (None, None)
    assert len(set(byte_characters().values())) == 256


def mix_rows():
    rnd = random.Random(2)
    out = [(i, " ".join(rnd.choice(["red", "blue", "stone"]) for _ in range(rnd.randrange(1, 60))), rnd.choice(["a", " A", "b", "B ", "c", None]), f"b{i}", i, "x", 1) for i in range(1500)]
    out += [(10_000 + i, "tiny text", "small", None, None, "x", 1) for i in range(20)]
    out += [(20_000 + r[0], *r[1:]) for r in out[:50]] + [(30_000, None, "a", "b", 1, "x", 1), (30_001, "", "a", "b", 2, "x", 1), (None, "no id", "a", None, None, "x", 1)]
    return out


def test_mix(spark):
    targets = spark.createDataFrame([("a", 0.4, 2, 1), ("B", 0.3, 3, 1), ("small ", 0.2, 4, 1), ("nowhere", 0.1, 2, 1), ("c", None, 2, 1), (None, 0.5, 1, 1), ("a", 0.4, 2, 1)], "source string, target_share double, max_repeats int, rate int")
    mix = Mix(spark.createDataFrame(mix_rows(), DOCS), targets, vocabulary())
    shares = {r.source: r for r in mix.shares().collect()}
    assert set(shares) == {"a", "b", "small", "nowhere", "c"}
    for s, want in (("a", 0.4 / 0.9), ("b", 0.3 / 0.9), ("small", 0.2 / 0.9)):
        r = shares[s]
        assert abs(r.expected_share - want) < 1e-9 and abs(r.mixed_tokens - r.expected_tokens) <= 4 * r.tokens_sd + 1e-6 and r.most_copies <= r.max_repeats
        assert r.rate == pytest.approx(r.whole_copies + r.fraction) and r.short_tokens == 0
    rows = mix.selection().collect()
    assert len(rows) == len({(r.doc_id, r.copy_no) for r in rows}) and all(r.doc_id < 20_000 for r in rows)
    assert sum(r.n_tokens for r in rows) == sum(r.mixed_tokens for r in shares.values())
    again = Mix(spark.createDataFrame(mix_rows(), DOCS), targets, vocabulary()).selection().collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_copies(spark):
    """Documents of every size are repeated at their source's rate, and what a document gets depends on no other."""
    rnd = random.Random(3)
    rows = [(i, "word " * rnd.choice([1, 2, 9, 40]), rnd.choice("ab"), f"b{i}", i, "x", 1) for i in range(4000)]
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.7, 5)], "source string, target_share double, max_repeats int")
    mix = Mix(spark.createDataFrame(rows, DOCS), targets, vocabulary())
    rate, copies = {r.source: r.rate for r in mix.plan().collect()}, {r.doc_id: r.n_copies for r in mix.chosen().collect()}
    for source in "ab":
        f = rate[source] % 1
        for size in (1, 2, 9, 40):
            of = [copies.get(r[0], 0) for r in rows if r[2] == source and len(r[1]) == 5 * size]
            assert abs(sum(of) / len(of) - rate[source]) <= 4 * (f * (1 - f) / len(of)) ** 0.5 + 1e-9
    wanted = 2 * sum(r.expected_tokens for r in mix.plan().collect())  # more than the caps allow
    more = Mix(spark.createDataFrame(rows, DOCS), targets, vocabulary(), total=wanted)
    short = {r.source: r for r in more.plan().collect()}
    assert any(r.rate == r.max_repeats and r.short_tokens > 0 for r in short.values())
    assert sum(r.expected_tokens + r.short_tokens for r in short.values()) == pytest.approx(wanted)
    half = Mix(spark.createDataFrame(rows, DOCS), targets, vocabulary(), total=wanted / 4)
    assert sum(r.mixed_tokens for r in half.shares().collect()) == pytest.approx(wanted / 4, rel=0.1)


def test_mix_empty(spark):
    none = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    assert Mix(docs(spark), none, vocabulary()).selection().count() == 0
    some = spark.createDataFrame([("s", 1.0, None)], none.schema)
    empty = Mix(docs(spark, []), some, vocabulary())
    assert empty.selection().count() == 0 and empty.shares().first().actual_share is None


def leveled(n, seed):
    rnd = random.Random(seed)
    words = {1: ["cat", "dog", "sun", "egg"], 2: ["river", "because", "window"], 3: ["structure", "although", "method"], 4: ["epistemology", "notwithstanding", "polymerization"]}
    out = []
    for i in range(n):
        level = 1 + i % 4
        text = ". ".join(" ".join(rnd.choice(words[max(1, min(4, level + rnd.choice([-1, 0, 0, 0, 1])))]) for _ in range(3 * level)) for _ in range(3))
        out.append((i, text, level))
    return out


def test_levels(spark):
    made = leveled(800, 4)
    rows = [(i, t, "s", None, None, "x", 1) for i, t, _ in made] + [(9000, None, "s", None, None, "x", 1), (9001, "", "s", None, None, "x", 1), (9002, "123 .. 🙂", "s", None, None, "x", 1), (None, "cat", "s", None, None, "x", 1), (0, made[0][1], "s", None, None, "x", 1)]
    ratings = [(i, level, "x") for i, _, level in made if i % 3 == 0] + [(3, None, "x"), (6, made[6][2], "x"), (7, 9, "x"), (None, 2, "x"), (99_999, 1, "x")]
    ratings += [(9, made[9][2], "x")]
    d, r = spark.createDataFrame(rows, DOCS), spark.createDataFrame(ratings, "doc_id bigint, reading_level int, level string")
    fit = Levels(d, r)
    values = [v for _, v in fit.log]
    assert len(values) > 3 and all(a < b for a, b in zip(values, values[1:]))
    got = {x.doc_id: x for x in fit.levels.collect()}
    assert set(got) == set(range(800))
    held = [(i, level) for i, _, level in made if i % 3]
    assert sum((got[i].p_demanding > 0.5) == (level >= 3) for i, level in held) / len(held) > 0.95
    assert sum(got[i].level == level for i, level in held) / len(held) > 0.85
    difficulty = {x.unit: x.difficulty for x in fit.words().collect()}
    assert difficulty["cat"] < difficulty["river"] < difficulty["epistemology"]


def test_level_gradients():
    """The gradients of the likelihood at the documents' best difficulties are those of finite differences."""
    rng = np.random.default_rng(1)
    m, n, steps = rng.normal(0, 2, 30), rng.multinomial(2, [0.25] * 4, 30).astype(float), np.array([-1.0, 0.2, 1.5])
    value, by_m, by_steps = respond(m, n, steps)
    for i in (0, 7, 29):
        d = np.zeros(30)
        d[i] = 1e-4
        assert abs((respond(m + d, n, steps)[0] - respond(m - d, n, steps)[0]) / 2e-4 - by_m[i]) < 1e-3
    for c in range(3):
        d = np.zeros(3)
        d[c] = 1e-4
        assert abs((respond(m, n, steps + d)[0] - respond(m, n, steps - d)[0]) / 2e-4 - by_steps[c]) < 1e-3
    assert np.allclose(level_chances(m, steps).sum(axis=1), 1)


def test_levels_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, reading_level int")
    assert reading_levels(docs(spark), none).count() == 0
    one = spark.createDataFrame([(3, 2)], none.schema)
    assert reading_levels(docs(spark, []), one).count() == 0


def test_units():
    words, ends = _patterns()
    assert not units_of("12 -- ¿? 🙂", words, ends)
    assert units_of("猫はパンを食う。犬は", words, ends)["は"] == 2
    assert units_of("The cat. The dog!", words, ends)["the"] == 2
