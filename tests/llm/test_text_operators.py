"""Each text operator against brute force on small tables with nulls, empty texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ohlcraft.llm import decontamination, minhash, mixing, pii, repeats, sharding, token_counts, token_files, toxicity
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, items string, score double, row long, keep_0 int"


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", 0.5, 7, 1) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    draws = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "日本", "it's", "x.y"]
    texts = [" ".join(draws.choice(words) for _ in range(draws.randint(1, 160))) for _ in range(60)]
    for k in range(40):
        base = texts[draws.randrange(60)].split()
        for _ in range(draws.randint(0, 5)):
            base[draws.randrange(len(base))] = draws.choice(words)
        texts.append("\n".join([" ".join(base), texts[3]]) if k % 3 == 0 else " ".join(base))
    texts += [texts[0]] * 12 + ["", "", None, None, "   ", "one", "\t\x0b ", "a" * 5000, " ".join(texts) * 3]
    rows = [(i, t, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, texts[1], "s1"), (None, None, None)]
    draws.shuffle(rows)
    return rows


def by_id(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_shards_are_even_gapless_and_versioned(spark, corpus, tmp_path):
    out = sharding.shard(table(spark, corpus), shards=5, slots=64, path=str(tmp_path / "map")).collect()
    assert len(out) == len(corpus)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in corpus)
    for s in range(5):
        mine = sorted(r.slot for r in out if r.shard == s)
        assert mine == list(range(len(mine)))
    stored = sharding.SlotMap.load(spark, str(tmp_path / "map"), 64, 5)
    assert stored.at(0) == [s % 5 for s in range(64)]
    sizes = {s: 1 + s % 7 for s in range(64)}
    grown = stored.rebalanced(sizes, shards=6)
    load = [sum(sizes[s] for s in range(64) if grown.at()[s] == k) for k in range(6)]
    assert max(load) - min(load) <= 7 and grown.at(stored.version) == stored.at()


def brute_hits(rows, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for i, t, _ in rows:
        w, hit, ids = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    ids |= {str(x) for x in windows[tuple(w[s : s + n])] if x is not None}
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [decontamination.AUTOMATON_CHARS, 400])
def test_decontamination(spark, corpus, limit):
    long = [t for _, t, _ in corpus if t and len(t.split()) > 30]
    items = [(1, " ".join(long[0].split()[3:25])), (2, long[0].upper()), (10, "one"), (3, None), (4, "..."), (None, long[1]), (1, "x-y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.scan(table(spark, corpus), bench, limit=limit)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, len(r["hits"])) for r in found.collect())
    for r in table(spark, corpus).join(found.withColumnRenamed("items", "found"), "doc_id").collect():
        for h in r["hits"]:
            assert len(decontamination.words(r.text[h["start"] : h["end"]])) == h["word_end"] - h["word_start"]
    if limit > 1000:
        assert by_id(decontamination.report(table(spark, corpus), bench)) == brute_hits(corpus, items)
    else:
        whole = decontamination.scan(table(spark, corpus), bench)
        assert by_id(found) == by_id(whole)
    kept = decontamination.clean(table(spark, corpus), bench)
    assert kept.columns == table(spark, corpus).columns
    assert kept.count() == sum(not r[-1] for r in brute_hits(corpus, items))
    assert decontamination.report(table(spark, []), bench).count() == 0
    assert not decontamination.report(table(spark, corpus), bench.limit(0)).filter("contaminated").count()


def test_repeats(spark, corpus, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_WINDOWS", 40)
    rows = corpus
    seen = {}
    cut = [(float("inf") if i is None else i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t, _ in rows]
    for i, w in cut:
        for s in range(len(w) - 49):
            k = tuple(w[s : s + 50])
            seen[k] = min(seen.get(k, i), i)
    expect = []
    for (i, w), (doc, _, _) in zip(cut, rows, strict=True):
        gone = {k for s in range(len(w) - 49) if seen[tuple(w[s : s + 50])] < i for k in range(s, s + 50)}
        left = [x for k, x in enumerate(w) if k not in gone]
        expect.append((doc, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    assert sum(e[2] for e in expect) > 500
    assert by_id(repeats.deduplicated(table(spark, rows))) == sorted(expect, key=str)
    assert repeats.deduplicated(table(spark, [])).count() == 0


def brute_classes(rows, idf):
    texts = sorted({t or "" for _, t, _ in rows})
    link = minhash.verify(texts, idf) | np.eye(len(texts), dtype=bool)
    label = dict(zip(texts, minhash.smallest_linked(link), strict=True))
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(label[t or ""], []).append(i)
    return {t: min((i for i in groups[k] if i is not None), default=None) for t, k in label.items()}


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    draws = random.Random(8)
    base = [f"v{i}" for i in range(120)]
    cloud = []
    for k in range(40):  # one cloud of near copies, some linked only through others
        w = list(base)
        for _ in range(draws.randint(0, 5)):
            w[draws.randrange(120)] = f"u{draws.randrange(9)}"
        cloud.append((1000 + k, " ".join(w), "s9"))
    rows = corpus + cloud
    docs = table(spark, rows)
    expect = brute_classes(rows, minhash.inverse_frequencies(docs))
    got = {(r.doc_id, r.text_key): r.class_id for r in minhash.classes(docs).collect()}
    keys = {r.text: r.k for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).distinct().collect()}
    for i, t, _ in rows:
        if expect[t or ""] is not None:
            assert got[i, keys[t]] == expect[t or ""], (i, t)
    kept = minhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({v for v in expect.values() if v is not None})
    assert minhash.report(table(spark, [])).count() == 0


def test_weighted_jaccard_and_draws_agree():
    idf = np.ones(minhash.IDF_BUCKETS, np.float32)
    a = " ".join(f"a{i}" for i in range(100))
    b = a.replace("a50 ", "zz ")
    assert not minhash.verify([a, b, "c d"], idf, 91 / 101 + 1e-6)[0, 1] and minhash.verify([a, b, "c d"], idf, 91 / 101 - 1e-6)[0].tolist()[1:] == [True, False]
    hits = [(minhash.bands(f"{a} {i}", idf) == minhash.bands(f"{b} {i}", idf)).mean() for i in range(60)]
    assert abs(np.mean(hits) - (92 / 102) ** minhash.ROWS) < 0.08


def test_token_files(spark, corpus, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    rows = [r for r in corpus if r[0] is not None] + [(900, "It's 'S WE'LL <|endoftext|> a\xa0b İΣ", None), (901, "ÀÉß²½'sam 12!!'s?", None)]
    out = token_files.token_files(table(spark, rows), str(tmp_path / "t")).collect()
    at, expect = 0, {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        expect.setdefault(i, []).append((at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = {}
    for r in sorted(out, key=lambda r: r.start):
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    assert got == expect
    assert token_files.token_files(table(spark, [(None, None, None)])).collect()[0].n_tokens == 1
    assert token_files.token_files(table(spark, [])).count() == 0


def test_token_counts(spark, corpus, monkeypatch):
    import public_tokenizers

    compiled = token_counts.Compiled(public_tokenizers.path(token_counts.VOCABULARY))
    draws = random.Random(3)
    parts = ["'", "s", "re", "ll", "a", "B", "1", "  ", " ", "\n", "!", "é", "<|endoftext|>", "\xa0", "日", "'ve", "don't", "the", "ing", "😀"]
    for _ in range(2500):
        text = "".join(draws.choice(parts) for _ in range(draws.randint(0, 40)))
        monkeypatch.setattr(token_counts, "CHUNK", draws.choice([3, 9, 10, 12, 20, 1 << 16]))
        assert compiled.count(text) == len(compiled.library.encode(text, add_special_tokens=False).ids), text
    rows = token_counts.token_counts(table(spark, corpus), limit=100).collect()
    expect = [(i, len((t or "").encode()), len(compiled.library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in corpus]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=str) == sorted(expect, key=str)
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)


def test_token_counts_of_joined_documents():
    import public_tokenizers

    compiled = token_counts.Compiled(public_tokenizers.path(token_counts.VOCABULARY))
    for text in ("it's  a\n<|endoftext|>" * 5000, "<|endoftext|>" * 5000 + " b"):
        assert compiled.count(text) == len(compiled.library.encode(text, add_special_tokens=False).ids)


def test_toxicity(spark, corpus):
    draws = random.Random(1)
    plain = ["green", "tree", "river", "stone", "cloud", "house", "light", "paper"]
    rows = [(i, " ".join(draws.choices(plain, k=draws.randint(3, 60)) + ["nastyword"] * (i % 7 == 0)), None) for i in range(700)] + [(None, None, None), (800, "", None)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(700)] + [(800, None), (None, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    assert len(out) == len(rows)
    for i in range(700):
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert out[i].predicted == int(i % 7 == 0) == int(out[i].score >= 0.5)
    assert 0 <= out[800].score <= 1 and out[None].score == out[800].score and not out[None].held_out
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 100
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.report(docs, flipped).collect()} == {k: r.score for k, r in out.items()}
    assert toxicity.report(docs, labels.limit(0)).count() == len(rows)
    assert toxicity.report(table(spark, []), labels).count() == 0


def test_toxicity_of_long_texts(spark):
    draws = random.Random(2)
    plain = ["".join(draws.choices("abcdefghijklmnopqrstuvwxyz", k=draws.randint(3, 8))) for _ in range(3000)]
    bad = ["nastyword", "vilething", "awfulone"]

    def text(words, toxic):
        return " ".join(draws.choice(bad) if toxic and draws.random() < 0.04 else draws.choice(plain) for _ in range(words))

    rows = [(i, text(draws.randint(40, 200), i % 5 == 0), None) for i in range(1000)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1000)], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, rows), labels)
    for words in (1000, 30_000, 300_000):
        assert model.score(text(words, False)) < 0.5 < model.score(text(words, True)), words
    t = text(100, True)
    assert model.score((t + " ") * 1000) == pytest.approx(model.score((t + " ") * 10), rel=0.02)


def brute_spans(text):
    def luhn(s):
        return sum((lambda x: x * 2 - 9 * (x > 4) if k % 2 else x)(int(c)) for k, c in enumerate(reversed(s))) % 10 == 0

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if ok[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark):
    draws = random.Random(5)
    parts = ["a", "b@", "@c.d", "_", "é", "😀", ".", "1", "22", "255", "256", "4", "-", " ", "+1", "+", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1111", "0", "1.2.3.4",
             "x@y.z", "+1 (555) 555-1234", "\n"]
    rows = [(i, "".join(draws.choice(parts) for _ in range(draws.randint(0, 24))), None) for i in range(4000)] + [(5000, None, None), (5001, "x@y.z " * 2000, None), (None, "x@y.z", None)]
    out = {r.doc_id: r for r in pii.report(table(spark, rows)).collect()}
    for i, t, _ in rows:
        spans = brute_spans(t or "")
        assert out[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), t
        assert set(spans) <= set(out[i].spans.split(",")) or not spans
        assert [out[i][f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in spans) for k in pii.KINDS]
    assert pii.report(table(spark, [])).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"some words, call me at +1 (555) 555-{i:04d} soon", None) for i in range(20)] + [(100, "do call me at 555-123-4567 soon", None), (101, "it cost 555-123-4567 in all", None)]
    out = {r.doc_id: r for r in pii.report(table(spark, rows)).collect()}
    assert out[100].spans == "phone:14:26" and out[101].spans == "" and out[3].spans == "phone:23:40"


def test_mixing(spark, corpus):
    rows = [(i, " ".join("w" for _ in range((i * 37) % 90)), f"s{i % 4 if i % 3 else 0}" if i % 11 else None) for i in range(3000)]
    docs = table(spark, rows + [(None, None, "s1"), rows[5], rows[5]])
    first = mixing.mix(docs)
    out = first.collect()
    size, taken, target = {}, {}, {}
    for r in out:
        key = (r.source_size, r.target)
        size[key] = size.get(key, 0) + r.size
        taken[key] = taken.get(key, 0) + r.taken
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    assert all(abs(taken[k] - k[1]) <= 90 and size[k] == k[0] for k in size)
    total = sum(size.values())
    sources = sorted({r[2] for r in rows} - {None}) + [None]
    words = {s: sum(len((t or "").split()) for _, t, x in rows + [rows[5], rows[5]] if x == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * total
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * words[s]}
        if not full:
            target |= share
            break
        target |= {s: 2.0 * words[s] for s in full}
        left, free = left - sum(2.0 * words[s] for s in full), free - full
    assert sorted(round(k[1], 6) for k in size) == sorted(round(v, 6) for v in target.values())
    assert by_id(mixing.mix(docs.repartition(7))) == by_id(first)
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.copies for r in out)
    assert mixing.mix(table(spark, [])).count() == 0


def test_pivot_keeps_words_and_expectations():
    draws = np.random.default_rng(2)
    p, size = np.full(30, 0.3), draws.integers(1, 50, 30).astype(float)
    many = []
    for _ in range(4000):
        q, at = mixing.pivot(p, size, draws)
        assert abs(q @ size - p @ size) < 1e-6
        assert all(x in (0.0, 1.0) for k, x in enumerate(q) if k != at)
        many.append(q)
    assert np.abs(np.mean(many, axis=0) - 0.3).max() < 0.04


def test_words_of_more_than_65536_bytes_that_swap_letters_stay_apart(spark):
    a = "x" * 70_000
    b = "y" + a[1:65_536] + "z" + a[65_537:]
    c = "z" + a[1:65_536] + "y" + a[65_537:]
    h = minhash.word_hashes(f"{b} {c} {b}")
    assert h[0] == h[2] and h[0] != h[1]
    rest = " ".join(f"w{i}" for i in range(49))
    df = spark.createDataFrame([(1, f"{rest} {b}"), (2, f"{rest} {c}"), (3, f"{rest} {b}")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in repeats.deduplicated(df).collect()}
    assert got == {1: (50, 0), 2: (50, 0), 3: (50, 50)}


def test_identifiers_found_through_discovered_ones(spark):
    """Pattern 2 has no base seed: it is known only by numbers that pattern 1 discovers."""
    rows = [(i, f"some words, call me at +1 (555) 555-{i:04d} soon", None) for i in range(30)]
    rows += [(100 + i, f"do call me at 555-123-{i:04d} soon", None) for i in range(8)]
    rows += [(200 + i, f"then fax it to 555-123-{i:04d} today", None) for i in range(8)]
    rows += [(300, "then fax it to 777-999-1234 today", None), (301, "it cost 777-999-1235 in all", None)]
    out = {r.doc_id: r for r in pii.report(table(spark, rows)).collect()}
    assert all(out[100 + i].n_added == 1 for i in range(8)) and all(out[200 + i].n_added == 1 for i in range(8))
    assert out[300].spans == "phone:15:27" and out[301].spans == ""


def test_a_stored_slot_map_is_continued(spark, tmp_path):
    path = str(tmp_path / "map")
    rows = [(i, "x" * (i * 37 % 500), None) for i in range(3000)]
    law = lambda out, shards: [sum(r.size for r in out if r.shard == s) for s in range(shards)]
    first = sharding.shard(table(spark, rows), shards=8, slots=256, path=path).collect()
    biggest = max(r["bytes"] for r in sharding.slot_totals(sharding.sized(table(spark, rows), 256)).collect())
    assert max(law(first, 8)) - min(law(first, 8)) <= biggest
    before = sorted(map(tuple, spark.read.parquet(path).collect()))
    again = sharding.shard(table(spark, rows), shards=8, slots=256, path=path).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, first)) and sorted(map(tuple, spark.read.parquet(path).collect())) == before
    more = rows + [(5000 + i, "y" * (i * 91 % 4000), None) for i in range(300)]
    grown = sharding.shard(table(spark, more), shards=9, slots=256, path=path).collect()
    after = sorted(map(tuple, spark.read.parquet(path).collect()))
    versions = {v for v, _, _ in after}
    assert len(versions) == len({v for v, _, _ in before}) + 1 and set(before) <= set(after)  # one more version, nothing rewritten
    assert len({(v, s) for v, s, _ in after}) == len(after)
    biggest = max(r["bytes"] for r in sharding.slot_totals(sharding.sized(table(spark, more), 256)).collect())
    assert max(law(grown, 9)) - min(law(grown, 9)) <= biggest
    now = {s: k for v, s, k in after}
    assert all(r.shard == now[r.virtual_slot] for r in grown)
