import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tipoff.llm import langid, lzprint, neardup, substrings
from tipoff.llm.suffixes import suffix_array

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "ümlaut", "中文"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    out = [prose(rng, rng.randint(1, 120)) for _ in range(150)]
    passage = prose(rng, 14)
    for k in range(20, 40):
        out[k] = out[k][:40] + passage + out[k][40:]
    out += [out[3]] * 6 + [None, "", "", "short", "a" * 700, "ab" * 400, "ab" * 380 + "x"]
    base = prose(rng, 100).split()
    for k in range(25):
        words = list(base)
        words[rng.randrange(100)] = f"edit{k}"
        out.append(" ".join(words))
    rng.shuffle(out)
    return list(enumerate(out)) + [(None, passage + "!"), (7, passage + "?"), (7, passage + "?")]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in corpus], "doc_id long, text string, node string, kept string").repartition(4).cache()


@pytest.mark.parametrize("seed", range(300))
def test_suffix_array(seed):
    rng = random.Random(seed)
    t = [rng.randint(1, rng.choice((1, 2, 3, 9))) for _ in range(rng.randint(0, 60))] + [0]
    assert suffix_array(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def remaining(corpus, length):
    key = lambda i: -(10**9) if i is None else i
    first = {}
    for i, t in corpus:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, 10**9), key(i))
    out = defaultdict(list)
    for i, t in corpus:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < key(i):
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i].append((np.frombuffer(b, np.uint8)[~gone].tobytes(), runs))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize(("length", "block", "hot"), [(50, 4 << 20, 1 << 15), (50, 3000, 1 << 15), (20, 3000, 1 << 15), (50, 4 << 20, 1), (50, 3000, 3), (20, 3000, 8)])
def test_repeats_against_all_strings(docs, corpus, length, block, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "RECOUNT", min(hot, 64))
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", block)
    got = defaultdict(list)
    for r in substrings.remove_repeats(docs, length=length).collect():
        text = (r["text"] or "").encode()
        spans = [(s["start"], s["length"]) for s in r["spans"]]
        cut = b"".join(text[a:b] for a, b in zip([0] + [s + n for s, n in spans], [s for s, _ in spans] + [len(text)]))
        assert cut == bytes(r["kept"])
        got[r["doc_id"]].append((bytes(r["kept"]), len(spans)))
    assert {i: sorted(v) for i, v in got.items()} == remaining(corpus, length)


def test_kept_text_has_whole_characters(spark):
    shared = "é" * 60
    df = spark.createDataFrame([(1, shared), (2, "xé" + shared + "ü"), (3, None)], "doc_id long, text string")
    out = {r["doc_id"]: r["kept"] for r in substrings.remove_repeats(df, length=49, as_text=True).collect()}
    assert out == {1: shared, 2: "x", 3: ""}  # the lead byte of ü is also that of é


def shingles(text):
    w = (text or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_classes_against_all_pairs(docs, corpus):
    texts = [t or "" for _, t in corpus]
    sets = [shingles(t) for t in texts]
    home = list(range(len(texts)))

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if texts[i] == texts[j] or (both and both >= 0.8 * len(sets[i] | sets[j])):
                home[find(i)] = find(j)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(corpus):
        ids[find(k)].append(i)
    want = sorted(((corpus[k][0], min((x for x in ids[find(k)] if x is not None), default=None)) for k in range(len(texts))), key=str)
    got = sorted(map(tuple, neardup.classes(docs).collect()), key=str)
    assert got == want


def test_links_inside_a_family_that_meets_one_hub(spark):
    rng = random.Random(5)
    pages = []
    for i in range(60):
        page = [f"w{k}" for k in range(600)]
        places = rng.sample(range(5, 595, 10), 14)
        for k in places[:9]:
            page[k] = f"p{i}x{k}"
        pages.append(page)
        if i < 10:
            twin = [f"w{k}" for k in range(600)]
            for k in places[:4]:
                twin[k] = page[k]
            for k in places[9:]:
                twin[k] = f"t{i}x{k}"
            pages.append(twin)
    sets = [shingles(" ".join(p)) for p in pages]
    label = list(range(len(pages)))
    for i in range(len(pages)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert len(set(label)) > 45
    df = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(pages)], "doc_id long, text string")
    assert dict(map(tuple, neardup.classes(df).collect())) == dict(enumerate(label))


def test_copies_that_repeat_a_block_more_often(spark):
    rows = []
    for i in range(10):
        page = [f"d{i}w{k}" for k in range(400)]
        copy = page[:100] * 200 + page[100:]
        for k in range(110, 395, 60):
            copy[19900 + k] = "edited"
        x, y = shingles(" ".join(page)), shingles(" ".join(copy))
        assert len(x & y) >= 0.8 * len(x | y)
        rows += [(2 * i, " ".join(page)), (2 * i + 1, " ".join(copy))]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {k: k // 2 * 2 for k in range(20)}


def test_prob_minhash_estimates_probability_likeness():
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 1 << 60, 300, dtype=np.uint64), rng.integers(1, 1 << 60, 100, dtype=np.uint64)
    x, y = dict(zip(a.tolist(), rng.uniform(0.5, 4, 300))), {}
    y.update({k: v * rng.uniform(0.5, 2) for k, v in list(x.items())[:200]})
    y.update(dict(zip(b.tolist(), rng.uniform(0.5, 4, 100))))
    truth = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in set(x) | set(y)) for i in set(x) & set(y))
    sig = [neardup.prob_minhash(np.array(list(d), np.uint64), np.array(list(d.values())), 4096) for d in (x, y)]
    assert abs((sig[0] == sig[1]).mean() - truth) < 4 * (0.25 / 4096) ** 0.5
    assert not neardup.prob_minhash(np.empty(0, np.uint64), np.empty(0)).any()


def test_components_of_a_chain_and_a_star(spark):
    chain = [(bytes([k]), bytes([k + 1])) for k in range(40)] + [(b"\xf0", bytes([200 + k])) for k in range(5)]
    labels = {bytes(r["node"]): bytes(r["label"]) for r in neardup.components(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert all(labels[bytes([k])] == b"\x00" for k in range(41))
    assert labels[b"\xf0"] == bytes([200])


def plain_fingerprint(text):
    """Phrases as strings in a set, hashes by definition, bins one by one."""
    seen, pending = set(), ""
    for c in text:
        pending += c
        if pending not in seen:
            seen.add(pending)
            pending = ""
    word, least = (1 << 64) - 1, {}
    for phrase in seen:
        h = 1
        for c in phrase:
            h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15 + 1) & word
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & word
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & word
        h ^= h >> 31
        k = h % lzprint.BINS
        least[k] = min(least.get(k, word), h // lzprint.BINS)
    return "".join(f"{((k << 57) | least[k]) % 65535 + 1 if k in least else 0:04x}" for k in range(lzprint.BINS))


def test_many_rows_of_one_id(spark):
    rows = [(i, f"text {i} " * 9) for i in range(300)] + [(150, f"same id {k} " * 7) for k in range(400)] + [(None, f"none {k} " * 5) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, heads = lzprint._buckets(df.select(F.col("doc_id").alias("id"), F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h")), 16)
    assert sum(h[2] == 150 for h in heads) > 3 and sum(not h[1] for h in heads) > 2
    place = {r["text"]: r["h"] for r in df.select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, place[r[1]]))
    want = []
    for k, (i, text) in enumerate(order):
        nxt, cut = order[(k + 1) % len(order)][1], len(text) // 4
        want.append((str(i), hashlib.sha256((text[: len(text) - cut] + nxt[:cut]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in lzprint.edited_likeness(df).collect()) == sorted(want)


def test_fingerprints(docs, corpus, spark):
    texts = {t or "" for _, t in corpus}
    place = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts], "t string").withColumn("h", F.shiftrightunsigned(F.xxhash64("t"), 1)).collect()}
    rows = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, place[r[1] or ""]))
    got = sorted((r.asDict() for r in lzprint.edited_likeness(docs).collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        text, nxt = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + nxt[:cut]
        r = got[k]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(text), hashlib.sha256(edited.encode()).hexdigest())
        prints = [lzprint.fingerprint(x) for x in (text, edited, nxt)]
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple(prints[:2])
        a, b, c = map(lzprint.from_text, prints)
        assert (r["near_edited"], r["near_next"]) == (lzprint.likeness(a, b), lzprint.likeness(a, c))
    for text in (*texts, "ab" * 30_000 + "c"):
        assert lzprint.fingerprint(text) == plain_fingerprint(text)
    same = lzprint.with_fingerprints(docs.where("text is null or text = ''")).select("fingerprint").distinct().collect()
    assert [r[0] for r in same] == ["0" * 4 * lzprint.BINS]
    one = spark.createDataFrame([(1, "only")], "doc_id long, text string")
    assert lzprint.edited_likeness(one).first()["near_next"] == 1.0


def test_languages(spark):
    rng = random.Random(2)
    stems = {"xx": ["tion", "the", "ing", "and"], "yy": ["schen", "ung", "der", "ü"], "zz": ["él", "que", "ción", "ñ"]}
    make = lambda k, n: " ".join("".join(rng.choice(stems[k]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, make(k, rng.randint(5, 80)), k) for i, k in enumerate(rng.choice(list(stems)) for _ in range(600))]
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "12 34 !?", "zz"), (1003, make("xx", 9), None), (None, make("yy", 9), "yy"), (1004, make("zz", 20000), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    filters = langid.fit(df.where(langid.learnable(df)))
    assert filters.languages == ["xx", "yy", "zz"]
    out = langid.predict(df, filters).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    judged = [r for r in out if r["lang"] and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in judged) >= 0.99 * len(judged)
    assert {r["doc_id"]: r["lang_pred"] for r in out if r["lang"] is None} == {1003: "xx", 1004: "zz"}
    nobody = langid.fit(df.where("lang = 'none'"))
    assert {r["lang_pred"] for r in langid.predict(df, nobody).collect()} == {"und"}


def test_one_long_document_a_language(spark):
    rng = random.Random(12)
    rows = []
    for k, (name, low) in enumerate((("xx", 0x61), ("yy", 0x430), ("zz", 0x4E00))):
        letters = [chr(low + j) for j in range(2000 if name == "zz" else 26)]
        rows.append((k, "".join(rng.choice(letters) if rng.random() < 0.85 else " " for _ in range(150_000)), name))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(df, fit_chars=50_000)
    assert [int(filters.bit(filters.table[0], k).any()) for k in range(3)] == [1, 1, 1]
    for r in langid.predict(df, filters).collect():
        assert r["lang_pred"] == r["lang"] and r["score"] > 0.5


def test_filters_against_sets(spark):
    rng = random.Random(13)
    make = lambda low, n: " ".join("".join(chr(low + rng.randrange(9)) for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows = [(i, make(0x61 if i % 2 else 0x64, 30), "xx" if i % 2 else "yy") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(df)
    pieces = lambda t: {f" {t} "[k : k + 4] for k in range(len(t) - 1)}
    share = {}
    for n in ("xx", "yy"):
        texts = [pieces(t) for _, t, lang in rows if lang == n]
        share[n] = {g: sum(g in p for p in texts) / len(texts) for g in set().union(*texts)}
    held = {n: {g for g, s in share[n].items() if s >= langid.SHARE * max(s, share["xx" if n == "yy" else "yy"].get(g, 0))} for n in share}
    for r in langid.predict(df, filters).collect():
        every = [f" {r['text']} "[k : k + 4] for k in range(len(r["text"]) - 1)]
        want = {n: sum(g in held[n] for g in every) / len(every) for n in held}
        assert abs(r["score"] - max(want.values())) < 0.05
        assert want[r["lang_pred"]] > max(want.values()) - 0.05


def test_more_languages_than_bits_of_a_word(spark):
    rng = random.Random(6)
    names = [f"l{k:03d}" for k in range(70)]
    letters = {n: "".join(chr(0x4E00 + 40 * k + j) for j in range(4)) for k, n in enumerate(names)}
    make = lambda n: " ".join("".join(rng.choice(letters[n]) for _ in range(3)) for _ in range(30))
    rows = [(10 * k + j, make(n), n) for k, n in enumerate(names) for j in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(df)
    assert filters.languages == names
    out = langid.predict(df, filters).collect()
    assert all(r["lang"] == r["lang_pred"] for r in out)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert substrings.remove_repeats(empty).count() == 0
    assert neardup.classes(empty).count() == 0
    assert lzprint.edited_likeness(empty).count() == 0
    assert langid.predict(empty, langid.fit(empty)).count() == 0
