"""Tokens, packing, garbled texts and near-duplicates."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella import staging
from tessella.llm import mojibake, neardup, packing, tokens

V = tokens.Vocabulary(open(tokens.VOCABULARY, "rb").read())
PIECES = ["a", "ab", " ", "  ", "\n", "'", "'s", "'l", "ll", "1", "23", "!!", "é", "日本", "🚀", " don't", "\t\r\n", "----", "　", "ſ", "<|endoftext|>", "\x00", "‍"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=50), st.integers(1, 40))
def test_encoding_in_windows_is_encoding_it_whole(parts, window):
    text = "".join(parts)
    assert V.encode(text, window) == V.encoding.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 9000, " " * 4000 + "x", "x" + " " * 4000, "7" * 3000 + " 1", "!" * 5000, "the" * 3000, "".join(random.Random(4).choices("etaoin", k=20000)), "\n" * 3000 + "S"])
@pytest.mark.parametrize("window", [7, 300, 1000])
def test_long_pieces_keep_a_window_in_memory(text, window):
    encoder, ids = tokens.Encoder(V, window), []
    for at in range(0, len(text), window):
        ids += encoder.feed(text[at : at + window])
        assert len(encoder._rest) <= 3 * window + 8 and len(encoder._inside) <= 4 * (V.lookahead + 4 * window)
    assert ids + encoder.finish() == V.encoding.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80), st.integers(1, 9))
def test_decoding_gives_the_text_back(text, step):
    ids, decoder = V.encode(text), tokens.Decoder(V)
    assert "".join(decoder.feed(ids[i : i + step]) for i in range(0, len(ids), step)) + decoder.finish() == text


def test_tokens_agree_with_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for text in ["Hello  world", "<|endoftext|> naïve\r\n", "日本語のテキスト", " \n\n x", "don't 'll 12345", "🚀👩🏽‍💻"]:
        assert V.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_lookahead_of_a_small_list():
    assert tokens.sufficient_lookahead({b"a": 0, b"b": 1}) == 0
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"ab": 4}
    assert tokens.sufficient_lookahead(ranks) == 1  # ab holds unless c follows
    with pytest.raises(ValueError):
        tokens.sufficient_lookahead({b"a": 0, b"abc": 1})


def test_ids_of_null_empty_long_and_repeated_texts(spark):
    data = [(1, None), (2, ""), (3, "Hi"), (3, "Hi"), (4, "x y " * 40000), (None, "null id")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "'c' AS ids", "1 AS tokens")
    got = tokens.encode_texts(df, ["doc_id"], "text", window=1000)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got.collect()) == Counter((k, tuple(V.encoding.encode_ordinary(t or ""))) for k, t in data)
    assert {r["doc_id"]: r["text"] for r in tokens.decode_ids(got, ["doc_id"], "ids").collect()} == {k: t or "" for k, t in data}
    assert tokens.encode_texts(df.where("false"), ["doc_id"], "text").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=25))
def test_patterns_hold_every_item_once_and_fit(histogram):
    patterns, placed = packing.fill_patterns(histogram, 40), Counter()
    for n, content in patterns:
        assert n > 0 and sum(k * c for k, c in content.items()) <= 40
        for k, c in content.items():
            placed[k] += n * c
    assert placed == Counter({k: n for k, n in histogram.items() if n})
    total = sum(k * n for k, n in histogram.items())
    assert sum(n for n, _ in patterns) <= 2 * -(-total // 40) + 1


def test_packing_items_of_all_sizes(spark):
    r = random.Random(5)
    sizes = [0, None, 0, 10, 10, 11, 20, 25] + [r.randrange(1, 10) for _ in range(200)] + [7] * 150
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)] + [(4, 10)], "doc_id bigint, tokens bigint").selectExpr("*", "1 AS piece", "2 AS rank")
    got = packing.pack(items, "doc_id", "tokens", 10, salts=4).collect()
    load, parts = Counter(), defaultdict(list)
    for x in got:
        if x["tokens"]:
            load[x["container_id"]] += x["tokens"]
        else:
            assert x["container_id"] is None
        parts[x["doc_id"]].append((x["piece"], x["start"], x["tokens"]))
    assert max(load.values()) <= 10 and sorted(load) == list(range(len(load)))
    assert sorted(parts[7]) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)] and sorted(parts[5]) == [(0, 0, 10), (1, 10, 1)]
    assert len(parts[4]) == 2 and {k: sum(p[2] for p in v) for k, v in parts.items() if k != 4} == {i: s or 0 for i, s in enumerate(sizes) if i != 4}
    bins = []
    for size in sorted((p[2] for v in parts.values() for p in v if p[2]), reverse=True):
        k = next((k for k, b in enumerate(bins) if b + size <= 10), None)
        bins.append(size) if k is None else bins.__setitem__(k, bins[k] + size)
    assert len(load) <= len(bins) * 1.05 + 1  # first fit, one by one
    assert packing.pack(items.where("false"), "doc_id", "tokens", 10).count() == 0
    with pytest.raises(ValueError):
        packing.fill_patterns({11: 1}, 10)


CLEAN = ["Die Prüfung bestätigt für die Geräte die Größe des Puffers", "El señor revisó la configuración según la reunión próxima", "O escritório não confirmou a função até à próxima reunião", "I can’t say “why” – see the café", "Комиссия подтвердила бюджет на следующий период", "NÃO OBSTANTE A SEÇÃO, SÃO BARRO", "夜間処理は承認のあと設定をやり直す", "├── a │ √2 ≈ 1.4"]


def read_as(data, table):
    return "".join(mojibake._TABLES[table][1][b] for b in data)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(6)
    clean = [" ".join(r.sample(s.split(), k=len(s.split()))) for s in CLEAN for _ in range(150)]
    bad = {
        "utf8_1252": read_as(CLEAN[0].encode(), "latin-1"), "utf8_mac": read_as(CLEAN[1].encode(), "mac_roman"), "utf8_437": read_as(CLEAN[2].encode(), "cp437"), "twice": "El año " + read_as(read_as("según la reunión".encode(), "cp1252").encode(), "cp1252"),
        "mac_1252": read_as(CLEAN[2].encode("mac_roman"), "cp1252"), "1251_1252": read_as(CLEAN[4].encode("cp1251"), "cp1252"), "lost": CLEAN[1].replace("ñ", "�"), "entity": "f&Atilde;¼r die Gr&Atilde;¶&Atilde;Ÿe",
    }
    data = [(i, t) for i, t in enumerate(clean)] + [(10000 + i, t) for i, t in enumerate(bad.values())] + [(20000, None), (20001, ""), (20002, "   "), (20003, "a" * 100000), (20004, "x")]
    return spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "'r' AS restored").repartition(3), bad


def test_garbled_texts_are_found_and_restored(spark, corpus):
    df, bad = corpus
    got = {r["doc_id"]: r["restored"] for r in mojibake.find_garbled(df, ["doc_id"], "text").collect()}
    assert set(got) == {10000 + i for i in range(len(bad))}
    by = dict(zip(bad, (got[10000 + i] for i in range(len(bad))), strict=True))
    assert by["utf8_1252"] == CLEAN[0] and by["utf8_mac"] == CLEAN[1] and by["utf8_437"] == CLEAN[2] and by["twice"] == "El año según la reunión"
    assert by["mac_1252"] == CLEAN[2] and by["1251_1252"] == CLEAN[4] and by["lost"] is None and by["entity"] == "für die Größe"


def test_most_sound_words_lie_in_no_run(spark, corpus):
    df, bad = corpus
    model = mojibake.Model(*mojibake.pair_counts(df, "text"))
    assert all(mojibake.improbable_runs(t, model) for t in bad.values() if "&" not in t)
    sound = [(w, t) for t in CLEAN for w in t.split() if not w.isascii()]
    in_runs = sum(len(mojibake.improbable_runs(t, model)) for t in CLEAN)
    assert in_runs < len(sound) / 2


def test_no_garbled_texts_in_nothing(spark, corpus):
    assert mojibake.find_garbled(corpus[0].where("false"), ["doc_id"], "text").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=40))
def test_segments_are_maximal(scores):
    def brute(lo, hi):
        best = None
        for i in range(lo, hi):
            for j in range(i + 1, hi + 1):
                s = sum(scores[i:j])
                if s > 0 and (best is None or s > best[0] or (s == best[0] and j - i < best[2] - best[1])):
                    best = (s, i, j)
        return [] if best is None else [*brute(lo, best[1]), best, *brute(best[2], hi)]

    got = mojibake.maximal_segments(np.array(scores, dtype=float))
    assert sum(sum(scores[i:j]) for i, j in got) == sum(s for s, _, _ in brute(0, len(scores)))
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def jaccard(a, b, width):
    s, t = ({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in (neardup.words_of(a), neardup.words_of(b)))
    return len(s & t) / len(s | t)


def family(r, n, edits):
    vocabulary = [f"w{i}" for i in range(2000)]
    out = []
    for _ in range(n):
        base = r.choices(vocabulary, k=r.randrange(40, 90))
        for e in edits:
            w = list(base)
            for _ in range(e):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
    return out


def expected(data, width, tenths, least):
    full = [(k, t) for k, t in data if k is not None and t and len(neardup.words_of(t)) >= least]
    return {(min(a, b), max(a, b)) for (a, s), (b, t) in combinations(full, 2) if jaccard(s, t, width) * 10 >= tenths - 1e-9}


def found(links, classes):
    members = defaultdict(list)
    for r in classes.collect():
        members[r["class"]].append(r["id"])
    pairs = {(min(x, y), max(x, y)) for r in links.collect() for x in members[r["a"]] for y in members[r["b"]]}
    return pairs | {p for m in members.values() for p in combinations(sorted(m), 2)}


def test_near_duplicates_are_those_of_brute_force(spark):
    r = random.Random(7)
    texts = family(r, 40, (0, 0, 1, 3, 6, 12))
    texts += [texts[0].upper() + " !!", "\n".join(texts[0].split()), "short text", None, "", "   ", " ".join(["same"] * 50), " ".join(["same"] * 60), "x" * 100000]
    data = list(enumerate(texts)) + [(None, texts[0])]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "'i' AS id", "1 AS key").repartition(3)
    links, classes = neardup.near_duplicates(df, "doc_id", "text", width=3, tenths=6, least_words=30)
    got, want = found(links, classes), expected(data, 3, 6, 30)
    assert got <= want and len(want - got) <= 0.01 * len(want)
    assert found(*neardup.near_duplicates(df, "doc_id", "text", width=3, tenths=6, least_words=30, exact=True)) == want


def test_regions_that_are_too_large_lose_nothing(spark, monkeypatch):
    """All regions of a family are above the size here: deeper prefixes and the exact join have to find all of it."""
    monkeypatch.setattr(neardup, "REGION", 3)
    r = random.Random(8)
    texts = family(r, 2, (0, 1, 1, 2, 2, 3, 3, 4, 4, 5))
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    links, classes = neardup.near_duplicates(df, "doc_id", "text", width=3, tenths=6, least_words=30)
    assert found(links, classes) == expected(data, 3, 6, 30)


def test_near_duplicates_of_nothing_and_of_copies(spark):
    df = spark.createDataFrame([(i, "one two three " * 20) for i in range(300)], "doc_id bigint, text string")
    links, classes = neardup.near_duplicates(df, "doc_id", "text", width=3, tenths=6, least_words=30)
    assert links.count() == 0 and {r["class"] for r in classes.collect()} == {0} and classes.count() == 300
    links, classes = neardup.near_duplicates(df.where("false"), "doc_id", "text", width=3, tenths=6, least_words=30)
    assert links.count() == 0 and classes.count() == 0


@pytest.mark.parametrize("exact", [False, True])
def test_near_duplicates_keep_no_table_that_was_read_for_the_last_time(spark, exact):
    staging.clear()
    df = spark.createDataFrame(list(enumerate(family(random.Random(8), 2, (0, 1, 1, 2, 2)))), "doc_id bigint, text string")
    neardup.near_duplicates(df, "doc_id", "text", width=3, tenths=6, least_words=30, exact=exact)
    assert {x.path.rpartition("/")[2].partition("-")[0] for x in staging._written} == {"candidates", "links", "classes"}
    staging.clear()


def test_a_sketch_may_fall_short_by_five_deviations(spark):
    """Of 72 agreements a pair at the threshold has 50.4 on average; one with 30 is still compared."""

    def sketch(differing):
        bits = [1 if i < differing else 0 for i in range(neardup.TREES * neardup.LEAST_DEPTH)]
        return [sum(b << 2 * i for i, b in enumerate(bits[k::3])) for k in range(3)]

    heads = spark.createDataFrame([(0, sketch(0)), (1, sketch(37)), (2, sketch(42)), (3, sketch(43))], "id bigint, sketch array<bigint>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "a bigint, b bigint")
    assert sorted(map(tuple, neardup._likely(pairs, heads, 6).collect())) == [(0, 1), (0, 2)]
