"""The manifest, the quality rules and the resampling against brute force, with nulls, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ohlcraft.llm import manifest, quality, resampling

SCHEMA = ("doc_id long, source string, lang string, n_chars long, text string, key string, digest string, idx long, n long, members string, "
          "score long, rank long, short boolean, words string, kept string, place long")
WORD = re.compile("[^\x20\x09-\x0d]+")


def table(spark, rows):
    """Documents with further columns named like those that the operators make themselves."""
    return spark.createDataFrame([(*r, "k", "d", 5, 6, "m", 7, 8, True, "w", "no", 3) for r in rows], SCHEMA)


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module")
def corpus():
    draws = random.Random(9)
    words = "the of and der die la que et im Zzz über 日本 it's x.y ... - * ### | $$$ q1 q2 q3 q4".split()
    texts = [draws.choice([" ", "\n", "\t ", " \r\n"]).join(draws.choice(words) for _ in range(draws.randint(1, 120))) for _ in range(120)]
    texts += [texts[0] + "\n" + texts[0], "a b c d e f " * 40, "", None, "   ", "\n\n", "one", "A" * 3000 + " b c " + "A" * 3000, " ".join(t for t in texts) * 6, "- a\n- b\n- c " + texts[1]]
    rows = [(i if i % 31 else None, draws.choice(["s1", None, "ß"]), draws.choice(["en", "en", "en", "de", None, "ü", ""]), draws.choice([None, 3, len(t or "")]), t)
            for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[5], (None, None, None, None, None), (rows[7][0], "s9", rows[7][2], 1, "Other TEXT")]
    rows += [(1000 + i, "s", "fr", 1, "Alone")for i in range(1)]
    draws.shuffle(rows)
    return rows


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_tree(nodes):
    """Root and sibling lists (left, right), level by level, of each node."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            paths[i].append((run[: p % 8], run[p % 8 + 1 :]))
        level = [sha("".join(level[j : j + 8])) for j in range(0, len(level), 8)]
        at = [p // 8 for p in at]
    return level[0], paths


def brute_manifest(rows):
    def leaf(r, text):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[1], r[2], r[3], text)))

    groups = {}
    for r in rows:
        groups.setdefault(("" if r[2] is None else "=" + r[2]).encode(), []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    keys = sorted(groups)
    trees = {}
    for k in keys:
        groups[k].sort(key=lambda x: x[:3])
        trees[k] = brute_tree([x[2] for x in groups[k]])
    root, tops = brute_tree([trees[k][0] for k in keys])
    out = []
    for k, top in zip(keys, tops, strict=True):
        for (_, _, digest, r), path in zip(groups[k], trees[k][1], strict=True):
            proof = sha("".join("".join(a + b) for a, b in path + top))
            node = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                node = leaf(r, lowered(r[4]))
            for a, b in path + top:
                node = sha("".join([*a, node, *b]))
            out.append((r[0], digest, trees[k][0], root, proof, node, node == root))
    return out


def by_row(rows):
    return sorted(map(tuple, rows), key=str)


def test_manifest(spark, corpus):
    assert by_row(manifest.manifest(table(spark, corpus)).collect()) == by_row(brute_manifest(corpus))


def test_manifest_of_several_blocks_and_of_many_languages(spark):
    rows = [(i, None, "en", i, f"T{i}") for i in range(513)] + [(i, "s", f"l{i:04d}", None, "x") for i in range(700)] + [(i, "s", None, None, "Y") for i in range(4104)]
    got = manifest.manifest(table(spark, rows)).collect()
    assert by_row(got) == by_row(brute_manifest(rows))
    assert {r.verified for r in got} == {True, False}


def test_manifest_sees_more_than_two_rounds(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    rows = [(i, None, "en", i, f"T{i}") for i in range(600)] + [(i, None, "de", i, "u") for i in range(9)]
    assert by_row(manifest.manifest(table(spark, rows)).collect()) == by_row(brute_manifest(rows))


def brute_rules(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    times = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + j for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for j in range(5)}
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    stops = sum(x.strip(quality.EDGES).lower() in quality.STOP_WORDS for x in w)
    symbols = sum(c in quality.SYMBOLS for c in t)
    dup = len(lines) - len(set(lines))
    bullets = sum(x.lstrip(" ")[:1] in ("-", "*", "•", "·") for x in lines)
    dots = sum(x.rstrip(" ").endswith(("...", "…")) for x in lines)
    n, k = max(1, len(w)), max(1, len(lines))
    good = (not w or 2 <= sum(map(len, w)) / n <= 15 and symbols / n <= 0.1 and stops / n >= 0.05) and dup / k <= 0.3 and bullets / k <= 0.9 and dots / k <= 0.3
    return len(w), sum(map(len, w)), symbols, dup, len(inside), failed, not failed and good


def test_rules(spark, corpus):
    got = quality.report(table(spark, corpus)).drop("broken", "n_lines", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines")
    assert by_row(got.collect()) == by_row([(r[0], *brute_rules(r[4])) for r in corpus])
    kept = quality.clean(table(spark, corpus))
    assert kept.columns == table(spark, corpus).columns
    assert by_row(kept.select("doc_id", "text").collect()) == by_row([(r[0], r[4]) for r in corpus if brute_rules(r[4])[-1]])


def test_each_rule_fires_alone(spark):
    fine = "the cat of an old house and its garden lay in warm sun"
    cases = {
        "": fine,
        "mean_word_length": " ".join(["the"] + ["abcdefghijklmnopqrs" + str(i) for i in range(12)]),
        "symbols_per_word": fine + " # # $",
        "stop_word_share": "one two three four five six seven eight nine ten eleven twelve",
        "repeated_line_share": "\n".join([fine, "a b", "a b", "a b"]),
        "bullet_line_share": "\n".join("- " + x for x in (fine, "x y", "z")),
        "ellipsis_line_share": "\n".join([fine + "...", "so it is"]),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases.values())], "doc_id long, text string")
    assert [r.broken for r in quality.report(df).orderBy("doc_id").collect()] == list(cases)


def test_repeats_of_a_very_long_text(spark):
    words = [str(i) for i in range(200_000)]
    words[150_000:150_007] = words[10:17]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    assert quality.report(df).first().n_repeat_words == 14


def brute_draw(rows, items, percent=5, buckets=10_000):
    def features(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    docs = [features(r[4]) for r in rows]
    s, t = Counter(b for _, f in docs for b in f), Counter(b for x in items for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for r, (n, f) in zip(rows, docs, strict=True):
        h = int(sha(f"42:{'' if r[0] is None else r[0]}")[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[1]))
    for i, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = i + 1
    return [tuple(x[:5]) for x in out]


def test_draws(spark, corpus):
    items = [corpus[2][4], "the of and", None, "", "日本 Q1 q2"]
    target = spark.createDataFrame([(str(i), t, 1) for i, t in enumerate(items)], "item_id string, text string, rank int")
    docs = table(spark, corpus)
    assert by_row(resampling.draw(docs, target).collect()) == by_row(brute_draw(corpus, items))
    want = brute_draw(corpus, items, percent=30, buckets=512)
    assert by_row(resampling.draw(docs, target, percent=30, buckets=512).collect()) == by_row(want)
    ids = {x[0] for x in want if x[4]}
    kept = resampling.resample(docs, target, percent=30, buckets=512)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r[0]) for r in corpus if r[0] in ids)


@pytest.mark.parametrize("piece", [3, 50, 1 << 18])
def test_crc_matrices_equal_the_library(monkeypatch, corpus, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    monkeypatch.setattr(resampling, "MATRIX", 1000)
    texts = [(r[4] or "").encode() for r in corpus]
    edges = np.r_[0, np.cumsum([len(t) for t in texts])]
    words, found = resampling.text_buckets(np.frombuffer(b"".join(texts), np.uint8), edges)
    for t, n, f in zip(texts, words, found, strict=True):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t.decode()))
        assert n == len(w)
        assert Counter(np.frombuffer(f, "<u2").tolist()) == Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1))


def test_empty_tables(spark, corpus):
    none, docs = table(spark, []), table(spark, corpus)
    target = spark.createDataFrame([], "item_id string, text string")
    assert manifest.manifest(none).collect() == [] and quality.report(none).collect() == [] and quality.clean(none).collect() == []
    assert resampling.draw(none, target).collect() == [] and resampling.resample(none, target).collect() == []
    assert by_row(resampling.draw(docs, target).collect()) == by_row(brute_draw(corpus, []))
