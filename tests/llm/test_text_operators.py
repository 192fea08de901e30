"""Personal data, spelling variants and collocations against plain Python and their SQL."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import catalog, collocations, pii, sql, variants
from tests.llm.test_operators import PROSE, empty, hostile
from tests.test_catalog import rows

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute_plain(text):
    found = [(m.start(), m.end(), k) for k, (kind, form) in enumerate(FORMS.items()) for m in re.finditer(form, text) if passes(kind, m.group())]
    return sorted(found, key=lambda s: (s[0], s[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "-", " ", "+", "1", "255", "4929 3483 8514 6306", "(", ")", "256", "0", "é", "_", "\n", "%", "1.2.3.4", "+1 (017) 555-7713"]), max_size=30))
def test_plain_spans_are_those_of_the_patterns(parts):
    text = "".join(parts)
    assert pii.plain(text) == brute_plain(text)
    assert [s for s, base in pii.spans(text) if base] == brute_plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([
    "joe", " at ", " dot ", "(at)", "[dot]", "@", ".", " ", "com", "mail7", "192", "one ", "two ", "seven ", "plus ", "+", "five-five-five ", "l0", "4O", "é", "е", "​",
    "&#64;", "1", "double ", "point",
]), max_size=25))
def test_the_quick_look_misses_nothing(parts):
    text = "".join(parts)
    found = pii.hidden(text, known := pii.plain(text))
    look = pii.suspicious
    try:
        pii.suspicious = lambda _: True
        assert pii.hidden(text, known) == found
    finally:
        pii.suspicious = look


DISGUISED = [
    ("mail joe.doe (at) mail7 [dot] example (dot) com now", "email", "joe.doe (at) mail7 [dot] example (dot) com"), ("joe at host dot com", "email", "joe at host dot com"),
    ("to jane.90 at mail2.example.com!", "email", "jane.90 at mail2.example.com"), ("x jоe@exаmple.cоm y", "email", "jоe@exаmple.cоm"), ("joe@exam​ple.com", "email", "joe@exam​ple.com"),
    ("joe＠example．com", "email", "joe＠example．com"), ("joe&#64;host.com", "email", "joe&#64;host.com"), ("ana.1 arroba correo punto example punto com", "email", "ana.1 arroba correo punto example punto com"),
    ("at 192[.]168[.]1[.]7 now", "ip", "192[.]168[.]1[.]7"), ("one nine two dot one six eight dot one dot one.", "ip", "one nine two dot one six eight dot one dot one"), ("10 dot 0 dot 0 dot 1", "ip", "10 dot 0 dot 0 dot 1"),
    ("a four nine two nine, three four eight three eight five one four six three zero six b", "card", "four nine two nine, three four eight three eight five one four six three zero six"),
    ("４９２９３４８３８５１４６３０６", "card", "４９２９３４８３８５１４６３０６"), ("4929 3483 85l4 63O6", "card", "4929 3483 85l4 63O6"), ("٤٩٢٩٣٤٨٣٨٥١٤٦٣٠٦", "card", "٤٩٢٩٣٤٨٣٨٥١٤٦٣٠٦"),
    ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"), ("+1 (O17) 555-77l3", "phone", "+1 (O17) 555-77l3"),
    ("plus quatre neuf un deux trois quatre cinq six sept huit", "phone", "plus quatre neuf un deux trois quatre cinq six sept huit"), ("+1 double five five 017 555 7713", "phone", "+1 double five five 017 555 7713"),
]


@pytest.mark.parametrize(("text", "kind", "span"), DISGUISED)
def test_disguises_are_found_at_their_place_in_the_source(text, kind, span):
    assert [(pii.KINDS[k], text[a:b], base) for (a, b, k), base in pii.spans(text)] == [(kind, span, False)]


@pytest.mark.parametrize("text", [
    "look at example.com today", "we met at home. One of us", "47369625730995 six", "null sept acht un deux", "point de vue, a dot and a dash", "follow me @ twitter.com", "version 1.2.3 at 5 o'clock",
    "one two three four five six seven eight nine", "привет@почта.рф", PROSE * 3, "1 plus 2 plus 3", "", "l0ll b00ks",
])
def test_clean_texts_stay_clean(text):
    assert pii.spans(text) == []


def test_plain_spans_stay_and_long_texts_take_linear_time(spark):
    text = "a.b@c.de dot uk " + "a" * 200_000 + "1" * 200_000 + "+1" + " " * 200_000 + "." * 200_000 + "@" * 100_000 + "a dot " * 50_000 + "[" * 100_000
    assert [(s, base) for s, base in pii.spans(text) if base] == [((0, 8, 0), True)]
    assert pii.spans("a" * 300_000) == [] and pii.spans("é" * 300_000) == []


def test_pii_tables(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in catalog.op11_pii(spark, sf).collect():
        base = brute_plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in range(4)]
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and (r["spans"] == joined) == (r["n_added"] == 0)
    df = spark.createDataFrame([(1, "mail a.b (at) c.de or +1 (017) 555-7713"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["redacted"] for r in pii.redact(df, "doc_id").collect()} == {1: "mail [EMAIL] or [PHONE]", 2: None}
    assert pii.digest(pii.detect(hostile(spark), "doc_id", "score"), "doc_id", "score").count() == 14
    assert pii.digest(pii.detect(empty(spark), "doc_id"), "doc_id").collect() == []


def brute_variants(texts, every=97, letters=5, least=3, times=2):
    n = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]

    out = {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        out[w] = [best if best and n[best] >= times * n[w] else None, n[w], len(close)]
    for w, x in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        x += [root, n[x[0]] if x[0] else None]
    return {w: tuple(x) for w, x in out.items()}


def found_variants(df, **options):
    return {r["word"]: (r["form"], r["n"], r["n_near"], r["root"], r["form_n"]) for r in variants.variants(df, **options).collect()}


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abé"), rng.integers(4, 8))) for _ in range(60)] + ["a" * 5, "a" * 6, "a" * 7, "aabaa", "x" * 63, "x" * 64, "x" * 65, "x" * 66, "y" + "x" * 64, "x" * 64 + "y", "x" * 63 + "y"]
    texts = []
    for i in range(150):
        words = [str(w) for w in rng.choice(base, 30)]
        texts.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    texts += [(None, " ".join(base)), (7, None), (8, ""), (3, texts[3][1]), (3, texts[3][1])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for every in (97, 3):
        assert found_variants(df, every=every) == brute_variants(texts, every)


def test_very_long_words_are_compared_too(spark):
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(list("abcdefgh"), 30_000))
    same, other = "z" * 40_000, long[:9] + "z" + long[10:]
    text = " ".join([long] * 3 + [other] * 7 + [long[1:]] * 3 + [same] * 3 + [same + "z"] * 6)
    found = found_variants(spark.createDataFrame([(None, text)], "doc_id long, text string"), every=1 << 33)
    assert {w: (x[1], x[2]) for w, x in found.items()} == {long: (3, 2), other: (7, 1), long[1:]: (3, 1), same: (3, 1), same + "z": (6, 1)}
    assert found[long][0] == other and found[same][3] == same + "z"


def test_clashing_keys_are_told_apart_by_their_strings():
    words, lo = ["abcde", "abcdx", "zzzze", "zzzzq"], np.array([4, 4, 4, 4])
    group = variants.split(np.zeros(4, np.int64), words, lo, np.zeros(4, bool))
    assert group[0] == group[1] != group[2] == group[3]
    whole = variants.split(np.zeros(2, np.int64), ["abcd", "abcde"], np.array([0, 4]), np.array([True, False]))
    assert whole[0] == whole[1]


def test_variants_of_hostile_tables(spark):
    assert len(found_variants(hostile(spark))) > 0 and found_variants(empty(spark)) == {}


def brute_collocations(texts, least=10, percent=50, best=2000):
    f, total = {}, Counter()
    for lang, text in texts:
        lang = lang or "und"
        own = f.setdefault(lang, Counter())
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lower):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            own.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        c = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in c.items():
            if any(len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and 100 * b >= percent * a for q, b in c.items()):
                continue
            s, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 300, "patterns": 7}, {"best": 5, "least": 4}])
def test_collocations_equal_brute_force(spark, options):
    rng = np.random.default_rng(11)
    words = ["the", "of", "New", "york", "a", "b", "ça", "x y", " ", "the\x1cend", "#"]
    ends = [" ", "  ", "\t", ". ", ", ", "\n", "\r\n", "!?"]
    texts = []
    for i in range(120):
        parts = rng.choice(words, 40, p=[0.2, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05, 0.03, 0.03, 0.04])
        texts.append((["en", "fr", None][i % 3], "".join(str(w) + str(rng.choice(ends, p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.04, 0.03, 0.03])) for w in parts)))
    texts += [("en", None), ("fr", ""), ("de", "new york " * 9), ("es", "!!!"), ("en", texts[0][1]), ("en", texts[0][1])]
    df = spark.createDataFrame(texts, "lang string, text string").repartition(5)
    found = sorted(tuple(r) for r in collocations.collocations(df, **options).collect())
    assert found == brute_collocations(texts, options.get("least", 10), best=options.get("best", 2000))


def test_long_texts_are_cut_without_losing_phrases(spark, monkeypatch):
    text = ("alpha beta gamma delta " * 30 + "x. ") * 20
    df = spark.createDataFrame([("en", text), ("en", "one. two")], "lang string, text string")
    stored = collocations.segments(df, "text", "lang", 500, 70).collect()
    assert len(stored) > 50 and any(r["skip"] for r in stored)
    found = []
    real = collocations.segments
    monkeypatch.setattr(collocations, "segments", lambda *a: real(*a, 70))
    found = sorted(tuple(r) for r in collocations.collocations(df, shard_bytes=500).collect())
    assert found == brute_collocations([("en", text), ("en", "one. two")])


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**13
    df = spark.createDataFrame([(big - 1, big, big + 7)], "a long, l long, r long")
    assert df.select(collocations.score(df.a, df.l, df.r)).first()[0] == 1_000_000 * (big - 1) ** 2 // (big * (big + 7))


def test_collocations_of_hostile_tables(spark):
    plain = [(r["lang"], r["text"]) for r in hostile(spark).collect()]
    assert sorted(tuple(r) for r in collocations.collocations(hostile(spark)).collect()) == brute_collocations(plain)
    assert collocations.collocations(empty(spark)).collect() == []


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_counts_of_many_shards_are_small_in_shuffles(spark):
    rng = np.random.default_rng(5)
    words = np.array(["".join(map(chr, rng.integers(97, 123, rng.integers(3, 9)))) for _ in range(40)])
    texts = [("en", " ".join(words[rng.integers(0, 40, 400)])) for _ in range(1000)]
    df = spark.createDataFrame(texts, "lang string, text string").repartition(6).localCheckpoint()
    # as many tasks as shards, so that no task sums the counts of several
    wide = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in wide}
    before = shuffled(spark)
    try:
        for k, v in wide.items():
            spark.conf.set(k, v)
        assert collocations.collocations(df, shard_bytes=1 << 17).count() == 2000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    written = sum(n for stage, n in shuffled(spark).items() if stage not in before)
    assert 10 * written < 16 * sum(len(t) for _, t in texts)


def test_sums_of_messages_equal_a_counter(spark):
    rng = np.random.default_rng(3)
    told, all_words = [], Counter()
    for _ in range(40):
        lang, part = str(rng.choice(["en", "fr"])), int(rng.integers(0, 2))
        own = {f"{part} {w}": int(rng.integers(1, 70_000)) for w in rng.choice(["a", "a b", "ça va", "d", "e"], 3, replace=False)} | ({} if part else {"": 5})
        all_words.update({(lang, w): n for w, n in own.items()})
        told.append((lang, part, collocations.squeezed("\n".join(own).encode()), collocations.planes(np.array(list(own.values())))))
    df = spark.createDataFrame(told, "lang string, part int, phrases binary, n binary")
    least = sorted(all_words.values())[len(all_words) // 2]
    expected = sorted((lang, w, len(w.split()), n) for (lang, w), n in all_words.items() if n >= least or not w)
    for most in (1, 7, 1000):
        assert sorted(tuple(r) for r in collocations.summed(df, least, most).collect()) == expected


def test_numbers_and_slots_survive_packing():
    for x in ([], [0], [7, 8, 255, 256, 65536, 2**32 - 1]):
        assert collocations.numbers(collocations.planes(np.array(x, np.int64))).tolist() == x
        assert collocations.unpacked(collocations.packed(np.array(x, np.int64))).tolist() == x


@pytest.mark.parametrize(("name", "text"), [("op12_variants", sql.VARIANTS_SQL), ("op13_collocations", sql.COLLOCATIONS_SQL)])
def test_queries_equal_their_sql(spark, sf, name, text):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert rows(catalog.queries()[name](spark, sf).toPandas()) == rows(con.sql(text).df())
