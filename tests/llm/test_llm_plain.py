"""Corpus operators against plain versions of their rules, written out byte by byte, word by word, node by node."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from foldlake.llm import fingerprints, html_text, langid, licenses, quality, topk


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect()]


# ---------------------------------------------------------------- 2 language

def plain_vector(text, dims, seed, known):
    """The bundle of a text's trigrams, each bound from its letters alone."""
    line = [None]
    for c in text.lower():
        if c.isalpha():
            line.append(c)
        elif line[-1] is not None:
            line.append(None)
    if not any(line):
        return None
    line.append(None)

    def letter(c):
        if c not in known:
            known[c] = np.random.default_rng([seed, 0x110000 if c is None else ord(c)]).integers(0, 2, dims, dtype=np.int8).astype(np.int64) * 2 - 1
        return known[c]

    total = np.zeros(dims)
    for (a, b, c), times in Counter(zip(line, line[1:], line[2:])).items():
        total += times * np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return total


def test_language_scores_and_predictions(spark, texts):
    import zlib

    model = langid.Model([], np.empty((0, 1024)), 1024, 3, 11)
    known, sums, vectors = {}, defaultdict(lambda: np.zeros(1024)), {}
    for doc, text, lang in texts:
        vectors[doc] = plain_vector(text or "", 1024, model.seed, known)
        if zlib.crc32(str(doc).encode()) % 5 and lang and vectors[doc] is not None:
            sums[lang] += vectors[doc] / np.linalg.norm(vectors[doc])
    names = sorted(sums)
    prototypes = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string").repartition(3)
    found = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for doc, _, _ in texts:
        cosines = prototypes @ vectors[doc] / np.linalg.norm(vectors[doc])
        assert found[doc]["score"] == pytest.approx(max(0, cosines.max()), abs=1e-4)
        first, second = np.sort(cosines)[::-1][:2]
        if first - second > 1e-4:
            assert found[doc]["lang_pred"] == names[int(cosines.argmax())]
        assert found[doc]["held_out"] == (zlib.crc32(str(doc).encode()) % 5 == 0)


def test_texts_in_no_learned_language_are_told_from_short_ones(spark, texts):
    import random

    rng = random.Random(1)
    noise = {
        "hex": "".join(rng.choice("0123456789abcdef") for _ in range(2000)), "letters": " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(300)),
        "other": "привет мир это русский текст который никто не учил " * 40, "digits": "123 456 a " * 200, "none": "12 !? " * 100, "null": None,
    }
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    floor = langid.floors(docs, model)
    assert floor and all(0 < f < 0.6 for f in floor.values())
    asked = spark.createDataFrame([(k, t, None) for k, t in noise.items()] + [(str(i), t, n) for i, t, n in texts] + [("word", "Avec.", "fr"), ("two", "zz qq", None)],
                                  "doc_id string, text string, lang string")
    kept = {r["doc_id"] for r in langid.predict(asked, model).filter(langid.recognised(floor)).collect()}
    assert not kept & set(noise) and {"word", "two"} <= kept
    assert len(kept) >= 0.985 * len(texts) + 2
    assert langid.floors(docs.limit(0), model) == {}


def test_all_learned_rows_make_the_prototypes(spark):
    rows = [(k, f"{'abcdefghij'[k % 10] * 3} {'klmnopqrst'[k // 10 % 10] * 2}{k % 7 * 'u'}", "one") for k in range(4500)] + [(9000, "xyz", "two"), (9001, None, "two"), (9002, "w", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), dims=64)
    profiles = langid.Profiles(64, model.n, model.seed)
    total = sum(v / np.linalg.norm(v) for v in (profiles.vector(text).astype(float) for _, text, lang in rows if lang == "one"))
    assert model.languages == ["one", "two"]
    assert np.allclose(model.prototypes[0], total / np.linalg.norm(total), atol=1e-9)


# ---------------------------------------------------------------- 4 quality

def plain_statistics(text):
    if not text:
        return [0.0] * 15
    kinds = Counter()
    for c in text:
        kinds["upper"] += "A" <= c <= "Z"
        kinds["lower"] += "a" <= c <= "z"
        kinds["digit"] += "0" <= c <= "9"
        kinds["stop"] += c in ".,;:?'\"()-"
        kinds["bang"] += c == "!"
        kinds["space"] += c in "\t\n\v\f\r "
        kinds["beyond"] += ord(c) > 127
    kinds["symbol"] = len(text) - sum(kinds.values())
    words, lines = text.split(), text.split("\n")
    triples = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    letters, n, w = max(1, kinds["upper"] + kinds["lower"] + kinds["beyond"]), len(text), max(1, len(words))
    return [math.log(1 + n), math.log(1 + len(words)), sum(len(x) for x in words) / w, kinds["upper"] / letters, kinds["digit"] / n, kinds["symbol"] / n,
            kinds["stop"] / n, kinds["bang"] / n, kinds["space"] / n, kinds["beyond"] / n, len(set(words)) / w,
            len(set(triples)) / len(triples) if triples else 1.0, len(set(lines)) / len(lines), n / len(lines),
            sum(1 for x in words if not (x[-1].isalnum() or x[-1] in ".,;:?'\"()-")) / w]


def test_statistics_equal_plain_counts(texts):
    extra = ["", "a", "!!", "Ünï çödé 日本 😀", "a b\n\na b\n", "x" * 10_000, "1 2 3 4\t5\v6\f7\r8", "#tag $5 (a) \x00\x7f"]
    for text in [t for _, t, _ in texts] + extra:
        assert quality.statistics(text) == pytest.approx(plain_statistics(text), abs=1e-12), text[:40]


def reached(node, row, above=()):
    """Conditions on the way to every node below ``node`` that ``row`` reaches."""
    if node.getClass().getSimpleName() != "InternalNode":
        return
    split = node.split()
    right = row[split.featureIndex()] > split.threshold()
    child = node.rightChild() if right else node.leftChild()
    path = (*above, (split.featureIndex(), right, split.threshold()))
    yield path
    yield from reached(child, row, path)


def test_paths_hold_for_the_rows_that_reach_their_nodes(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0.2) & (x[:, 1] < 0.5) | (x[:, 2] > 1)).astype(float)
    names = [f"f{k}" for k in range(4)]
    table = VectorAssembler(inputCols=names, outputCol="v").transform(spark.createDataFrame([(*r, t) for r, t in zip(x.tolist(), y.tolist())], [*names, "label"]))
    forest = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=3, maxDepth=4, seed=1).fit(table)
    holds = lambda rule, row: all((row[i] > t) == above for i, above, t in rule)
    tight = lambda path: tuple(sorted(
        (i, above, (max if above else min)(t for j, b, t in path if (j, b) == (i, above))) for i, above in {(i, b) for i, b, _ in path}))
    for tree in forest.trees:
        root = tree._call_java("rootNode")
        rules = set(quality._paths(root, {}))
        seen = set()
        for row in rng.normal(size=(600, 4)).tolist():
            here = {tight(p) for p in reached(root, row)}
            assert {r for r in rules if holds(r, row)} == here
            seen |= here
        assert seen <= rules and len(seen) > 0.7 * len(rules)


def test_scores_equal_the_weighted_rules(spark, texts, sf_dir):
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    ensemble = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert len(ensemble.rules) > 3
    found = {r["doc_id"]: r for r in quality.predict(docs, ensemble).collect()}
    for doc, text, _ in texts:
        row = quality.statistics(text)
        z = ensemble.intercept + sum(w for rule, w in ensemble.rules if all((row[i] > t) == above for i, above, t in rule))
        assert found[doc]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        assert found[doc]["predicted"] == int(found[doc]["score"] >= 0.5)


def test_all_labelled_rows_are_learned(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(quality, "fit", lambda table: learned.append(table.count()))
    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    quality.learn(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    assert learned == [20_500]


# ---------------------------------------------------------------- 5 licences

def test_the_keyword_gate_loses_nothing(texts):
    """Every rule run on every text, without the prefilter."""
    every = list(licenses.rules())
    notices = ["Licensed under CC BY-SA 3.0 and the MIT License.", "SPDX-License-Identifier: GPL-2.0-or-later", "GNU Lesser General Public License v2.1",
               "Apache License, Version 2.0, http://www.apache.org/licenses/LICENSE-2.0", "All rights reserved. Tous droits réservés.", "BSD 3-Clause", "public domain cc0"]
    for text in [t for _, t, _ in texts] + notices:
        words = text.encode().lower().translate(licenses._TO_WORDS).split()
        base, found = licenses.detect(b" ".join(words).decode(), every)
        n, gated_base, gated = licenses.scan_text(text.encode())
        assert n == len(words)
        assert sorted(map(str, gated_base)) == sorted(map(str, base))
        assert sorted((d.label, d.first, d.last, d.priority) for d in gated) == sorted((d.label, d.first, d.last, d.priority) for d in found), text[:60]


# ---------------------------------------------------------------- 8 fingerprints

def plain_cuts(data, how):
    """Ends of the chunks, one byte at a time, from the recurrence of the hash."""
    gear, ends, start, h, hashes = fingerprints._gear(how.seed).tolist(), [], 0, 0, []
    for b in data:
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        hashes.append(h)
    while start < len(data):
        end = min(start + how.most, len(data))
        if len(data) - start <= how.least:
            end = len(data)
        else:
            for size in range(how.least, end - start):
                bits = how.bits_before if size <= how.normal else how.bits_after
                strict = hashes[start + size - 1] >> (32 - how.bits_before) == 0
                loose = hashes[start + size - 1] >> (32 - how.bits_after) == 0
                if strict if size < how.normal else loose if size > how.normal else strict or loose:
                    end = start + size
                    break
                assert bits
        ends.append(end)
        start = end
    return ends


@pytest.mark.parametrize("how", [fingerprints.Chunking(), fingerprints.Chunking(least=2, normal=7, most=12), fingerprints.Chunking(least=1, normal=40, most=200, bits_before=3, bits_after=2)])
def test_cuts_byte_by_byte(texts, how):
    rng = np.random.default_rng(5)
    samples = [t.encode()[:4000] for _, t, _ in texts[:60]] + [rng.integers(0, 256, int(n), dtype=np.uint8).tobytes() for n in rng.integers(0, 400, 200)]
    for data in [*samples, b"", b"a", b"a" * 500, bytes(300)]:
        assert fingerprints.cuts(data, how) == plain_cuts(data, how)


def test_likeness_to_the_edited_text(spark, texts):
    order = sorted(((i, t) for i, t, _ in texts), reverse=True)
    found = {r["doc_id"]: r for r in fingerprints.compare_with_edited(spark.createDataFrame(order, "doc_id bigint, text string")).collect()}
    how = fingerprints.Chunking()

    def digests(data):
        ends = plain_cuts(data, how)
        return {data[a:b]: b - a for a, b in zip([0, *ends], ends)}

    for k, (doc, text) in enumerate(order[:80]):
        after, half = order[(k + 1) % len(order)][1], len(text) // 2
        a, b = digests(text.encode()), digests((text[:len(text) - half] + after[:half]).encode())
        want = sum(n for c, n in a.items() if c in b) / min(sum(a.values()), sum(b.values())) if a and b else float(not a and not b)
        assert found[doc]["near_edited"] == pytest.approx(want, abs=1e-12)


def test_one_id_makes_many_ranges(spark, texts):
    rows = [(7, f"{t} {k}") for k in range(8) for _, t, _ in texts[:60]] + [(None, f"{t} {k}") for k in range(5) for _, t, _ in texts[:60]] + [(9, "a"), (5, "b"), (5, "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    split = fingerprints.with_next(docs, ranges=4, rows_per_range=50).groupBy("to").count().collect()
    assert len(split) > 10 and max(r["count"] for r in split) < 120
    names = lambda df: sorted(df.select("doc_id", "fingerprint", "edited_sha256", "near_next").collect(), key=str)
    hashed = docs.withColumn("h", F.xxhash64("text")).orderBy(F.desc_nulls_last("doc_id"), F.desc("h")).collect()
    from hashlib import sha256

    found = fingerprints.with_next(docs, ranges=4, rows_per_range=50)
    assert names(fingerprints.compare_with_edited(docs)) == names(fingerprints.compare_with_edited(docs.repartition(2), ranges=3))
    got = Counter(r["edited_sha256"] for r in fingerprints.compare_with_edited(docs).collect())
    want = Counter()
    for (_, text), after in [((r["doc_id"], r["text"]), hashed[(k + 1) % len(hashed)]["text"]) for k, r in enumerate(hashed)]:
        half = len(text) // 2
        want[sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert got == want and found.filter("not end").count() == len(rows)


# ---------------------------------------------------------------- 9 html

def test_the_passes_find_the_article_without_marks(spark, sf_dir):
    pages = [r[0] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    kept = whole = 0
    for html in pages:
        bare = re.sub(r"<(/?)(article|main)\b", r"<\1div", html, flags=re.IGNORECASE)
        assert bare != html
        want, got = Counter(html_text.main_text(html).split()), Counter(html_text.main_text(bare).split())
        assert not got - want
        kept, whole = kept + sum((want & got).values()), whole + sum(want.values())
    assert kept >= 0.99 * whole


PARAGRAPH = "<p>" + "The words of this paragraph are those that any article in the language would have, and there are enough of them for the rules to be sure of it, as they are of the next. " * 2 + "</p>"


@pytest.mark.parametrize("html, want", [
    (f"<div>{PARAGRAPH}<p>Short end.</p><p>Shorter.</p></div>", True), (f"<div>{PARAGRAPH}</div><div><p>Other.</p><p>Shorter.</p></div><div><a href=x>More links here</a></div>", False),
    (f"<article>{PARAGRAPH}<p>Shorter.</p></article>", True), (f"<div>{PARAGRAPH}<p><a href=x>Shorter.</a></p></div>", False),
])
def test_short_blocks_follow_their_siblings(html, want):
    assert ("Shorter." in html_text.main_text(html)) == want


# ---------------------------------------------------------------- 10 top-k

@pytest.mark.parametrize("scale", [1, 1 << 16, 1 << 44])
def test_thresholds_spare_products(scale):
    """Pairs that reach the cutoff are found exactly, and not all local scores are formed for it."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 32))
    rows = np.floor(256 * (centres[rng.integers(0, 20, 600)] + 0.2 * rng.normal(size=(600, 32)))).astype(np.int64) * scale
    q = rows[:40]
    exact = [[max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(u, v)))) for v in rows.tolist()] for u in q.tolist()]
    cut = np.array([sorted(e)[-6] for e in exact], dtype=np.int64)
    own = np.arange(40)[:, None] == np.arange(600)[None, :]
    scores = topk._Scores(q, rows, 4)
    i, j, found, formed = topk._collect(scores, slice(0, 40), cut, own)
    want = {(a, b): exact[a][b] for a in range(40) for b in range(600) if a != b and exact[a][b] >= cut[a]}
    assert dict(zip(zip(i.tolist(), j.tolist()), found.tolist())) == want
    if scale < 1 << 40:
        assert formed < 0.9 * 4 * own.size
