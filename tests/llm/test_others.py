"""Operators 1 to 4, 7, 8 and 10 against plain Python versions."""

import functools
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidewright.llm import compression, decontaminate, language_id, licenses, mixing, quality, token_ledger
from tidewright.llm.common import Workspace, crc_bucket

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [(None, "a null id " * 20), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (6, "x" * 200_000), (7, "  Ünïcode\x0bwörds here")]


def table(spark, rows, **columns):
    lang, source = columns.get("lang", {}), columns.get("source", {})
    return spark.createDataFrame([(i, t, lang.get(i, "en"), source.get(i, "s"), 0) for i, t in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


# 1


def goals(sizes, weights=(5, 2, 1)):
    """Targets by the contract's rounds: shares by weight, capped ones leave the sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, live, out = 1.5 * sum(sizes.values()), set(names), {}
    while live:
        level = rest / sum(weight[s] for s in live)
        full = {s for s in live if weight[s] * level >= 2 * sizes[s]}
        if not full:
            out |= {s: weight[s] * level for s in live}
            break
        for s in full:
            out[s] = 2 * sizes[s]
            rest -= out[s]
        live -= full
    return out


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_mixing(spark, bucket):
    r = random.Random(1)
    rows = EDGES + [(100 + i, "w " * r.randint(0, 60)) for i in range(200)]
    source = {i: r.choice(["a", "a", "a", "b", "Z", "é", None, "d"]) for i, _ in rows}
    docs = table(spark, rows, source=source).withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    got = mixing.mixture(docs, {"doc_id": F.col("doc_id"), "src": F.col("source")}, bucket=bucket).collect()
    assert len(got) == len(rows)
    sizes = {}
    for i, t in rows:
        sizes[source[i]] = sizes.get(source[i], 0) + len(words(t))
    want = goals(sizes)
    taken = {}
    for x in got:
        assert x["source_size"] == sizes[x["src"]] and x["target"] == pytest.approx(want[x["src"]])
        assert 0 <= x["taken"] <= 2 * x["size"]
        taken[x["src"]] = taken.get(x["src"], 0) + x["taken"]
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in sizes)
    other = mixing.mixture(docs.repartition(5), {"doc_id": F.col("doc_id"), "src": F.col("source")}, bucket=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, other))


def test_mixed_rows(spark):
    rows = EDGES + [(100 + i, f"tok{i} b c d e") for i in range(30)]
    docs = table(spark, rows, source={100 + i: "big" for i in range(25)})
    got = mixing.mixed(docs)
    taken = mixing.mixture(docs, {"doc_id": F.col("doc_id")}).agg(F.sum("taken")).first()[0]
    assert got.columns == [*docs.columns, "epoch", "words"] and got.agg(F.sum("words")).first()[0] == taken
    assert all(len(words(r["text"])) == r["words"] for r in got.collect())
    assert mixing.mixture(table(spark, []), {"doc_id": F.col("doc_id")}).count() == 0


def test_mixing_without_ansi_and_with_clashing_names(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        docs = table(spark, [*EDGES, (100, "a b c")]).withColumns({"Epoch": F.lit("x"), "words": F.lit("y"), "words_": F.lit("z")})
        got = mixing.mixture(docs, {"doc_id": F.col("doc_id")})
        assert {r["doc_id"]: (r["size"], r["source_size"]) for r in got.collect()}[1] == (0, sum(len(words(t)) for _, t in EDGES) + 3)
        assert mixing.mixed(docs).columns == [*docs.columns, "epoch_", "words__"]
        assert mixing.mixed(docs).agg(F.sum("words__")).first()[0] == got.agg(F.sum("taken")).first()[0]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


# 2


def test_compression_counts_and_verdicts(spark):
    r = random.Random(2)
    prose = " ".join("".join(r.choices("etaoinshrdlu", k=r.randint(2, 8))) for _ in range(300))
    noise = "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(3000))
    rows = [*EDGES, (20, prose), (21, "same old line here\n" * 50), (22, " ".join(noise[i : i + 20] for i in range(0, 3000, 20))), (23, ("alpha beta gamma delta " * 3 + prose[:400] + "\n") * 2), (24, "#a $b %c\n\n#a $b %c\n|<>&*\n")]
    got = {r["doc_id"]: r for r in compression.rules(table(spark, rows), {"doc_id": F.col("doc_id")}).collect()}
    for i, t in rows:
        w, seen = words(t), {}
        for p in range(len(w) - 2):
            seen.setdefault(tuple(w[p : p + 3]), []).append(p)
        covered = {p + k for v in seen.values() if len(v) > 1 for p in v for k in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        row = got[i]
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert row["base_failed"] == failed and (not failed or not row["kept"])
    assert got[20]["kept"] and not got[21]["kept"] and not got[22]["kept"]
    assert compression.rules(table(spark, []), {"doc_id": F.col("doc_id")}).count() == 0


def brute_kept(rows, base_failed):
    """The rule restated: bands of quartiles by half octave, and for chunks; outer bands for all."""
    packed = lambda d: 200 * len(d) // len(zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False).compress(d))
    whole, chunks, by = {}, {}, {}
    for i, t in rows:
        d = (t or "").encode()
        if d and not base_failed[i]:
            whole[i] = packed(d)
            chunks[i] = [packed(d[k : k + 4096]) for k in range(0, len(d) - 4095, 4096)] if len(d) > 4096 else []
            by.setdefault(int(2 * math.log2(len(d))), []).append(whole[i])
    by["chunks"] = [x for c in chunks.values() for x in c]

    def band(k):
        v = sorted(by.get(k, []))
        if len(v) < 100:
            return 0, 1e9
        quarter = -(-len(v) // 4)
        low, high = v[quarter - 1], v[3 * quarter - 1]
        return low - 4 * (high - low), high + 2.5 * (high - low)

    def outer(n):
        return next((a, b) for most, a, b in [(512, 1.05, 2.6), (2048, 1.15, 3.2), (8192, 1.3, 3.6), (65536, 1.5, 4.2), (1e18, 1.5, 5)] if n < most)

    kept = set()
    for i, t in rows:
        if i in whole:
            n = len(t.encode())
            (a, b), (c, d), (e, f) = band(int(2 * math.log2(n))), outer(n), band("chunks")
            outside = sum(not e <= x <= f for x in chunks[i])
            if a <= whole[i] <= b and 200 * c <= whole[i] <= 200 * d and outside <= 0.25 * len(chunks[i]):
                kept.add(i)
    return kept


def test_bands_match_brute_force_and_reject_planted_rows(spark):
    r = random.Random(20)
    lexicon = ["".join(r.choices("etaoinshrdlucmfw", k=r.randint(2, 9))) for _ in range(1500)]
    prose = lambda n: " ".join(r.choices(lexicon, weights=[1 / (k + 5) for k in range(1500)], k=n))
    rows = [(i, prose(r.choice([60, 120, 180, 300, 2200, 2400]))) for i in range(10, 910)]
    junk = [(1000 + i, " ".join(w + "-******-" for w in prose(120).split())) for i in range(10)]
    noise = [(2000 + i, " ".join("".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(60))) for i in range(10)]
    half = [(3000 + i, prose(1500) + " " + " ".join(f"{a} {b}" for a in lexicon[i : i + 30] for b in lexicon[i : i + 30] if a != b)) for i in range(5)]
    rows += [*junk, *noise, *half, *EDGES]
    got = {x["doc_id"]: x for x in compression.rules(table(spark, rows).withColumn("ratio", F.lit("clash")), {"doc_id": F.col("doc_id")}).collect()}
    kept = {i for i, x in got.items() if x["kept"]}
    assert kept == brute_kept(rows, {i: x["base_failed"] for i, x in got.items()})
    assert all(not got[i]["base_failed"] for i, _ in junk + noise) and not kept & {i for i, _ in junk + noise}
    assert len(kept & set(range(10, 910))) >= 890


# 3


def brute_labels(text):
    """Every block against every template."""
    w, found = terms(text), {}
    for length, shortest, longest in ((16, 0, 8), (64, 9, 32)):
        for start in range(0, max(1, len(w) - length // 2), length // 2):
            block, hits = set(w[start : start + length]), []
            for label, notice, required in licenses.TEMPLATES:
                words = set(terms(notice))
                if shortest <= len(terms(notice)) <= longest and set(terms(required)) <= block and len(words & block) >= math.ceil(0.8 * len(words) - 1e-9):
                    hits.append((label, words, len(words & block) / len(words)))
            for label, words, share in hits:
                if not any(words < other for _, other, _ in hits):
                    found[label] = max(share, found.get(label, 0))
    return found


def test_licenses(spark):
    r = random.Random(30)
    filler = lambda n: " ".join(r.choices(["the", "of", "and", "this", "work", "under", "rights", "for", "software", "notice", "permission", "x"], k=n))
    rows = [*EDGES, (20, "Free text. Released under the MIT License. mit\nlicense"), (21, "Apache-License and the GENERAL public license"), (22, "All rights\treserved."), (23, "intro\n\n" + licenses.TEMPLATES[4][1].replace("following", "subsequent").upper()), (24, "permission is hereby"), (25, "the mit licenses")]
    rows += [(30, "This article is licensed under CC BY 4.0"), (31, "This article is licensed under CC BY-SA 4.0"), (32, "licensed under CC BY-NC 4.0 by us"), (33, f"all {filler(1999).replace('rights', 'of')} rights {filler(2000).replace('rights', 'of')} reserved"), (34, filler(100_000) + " All rights reserved")]
    for i in range(100):
        notice = r.choice(licenses.TEMPLATES)[1].split()
        for _ in range(r.randint(0, 4)):
            notice[r.randrange(len(notice))] = "changed"
        rows.append((100 + i, f"{filler(r.randint(0, 90))} {' '.join(notice)} {filler(r.randint(0, 90))}"))
    docs = table(spark, rows).withColumns({"labels": F.lit("clash"), "score": F.lit(9)})
    got = {r["doc_id"]: r for r in licenses.scan(docs, {"doc_id": F.col("doc_id")}).collect()}
    for i, t in rows:
        w, places, labels = terms(t), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        row, found = got[i], brute_labels(t)
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert row["labels"] == ",".join(sorted(labels | set(found))) and row["score"] == (1 if places else max(found.values(), default=0))
    assert [got[i]["labels"] for i in (22, 23, 24, 25, 30, 31, 32, 33, 34)] == ["reserved", "bsd", "", "", "cc-by", "cc-by-sa", "cc-by-nc", "", "reserved"]
    assert len({got[100 + i]["labels"] for i in range(100)}) > 8
    assert licenses.scan(docs.limit(0), {"doc_id": F.col("doc_id")}).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, {}, templates=[("long", "word " * 33, "")])


def test_each_notice_gets_its_own_label():
    for label, notice, _ in licenses.TEMPLATES:
        assert set(brute_labels(notice)) == {label}


@pytest.mark.parametrize("containment", [0.5, 0.8, 1.0])
def test_license_join_is_exact(containment):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    templates = [(f"t{k}", " ".join(r.sample(vocabulary, r.randint(1, 12))), "") for k in range(12)]
    index = licenses.Index.build(templates, {w: r.randint(0, 50) for w in vocabulary}, containment)
    for _ in range(400):
        block = set(r.sample(vocabulary, r.randint(0, 25)))
        hits = {}
        for label, text, _ in templates:
            t = set(text.split())
            if len(t & block) >= max(1, math.ceil(len(t) * containment - 1e-12)):
                hits[label] = t
        assert index.match(block) == {k: len(t & block) / len(t) for k, t in hits.items() if not any(t < o for o in hits.values())}


# 4


def test_quality_learns_and_holds_out(spark):
    r = random.Random(4)
    good = lambda: " ".join("".join(r.choices("etaoinshrd", k=r.randint(2, 7))) for _ in range(80))
    bad = lambda: " ".join(r.choice("#$%&*") * 3 + "".join(r.choices("etaoin", k=3)) for _ in range(80))
    rows = [(i, good() if i % 2 else bad()) for i in range(10, 210)] + EDGES
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10, 210)] + [(10, 1, 0), (11, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").filter("not (doc_id = 10 and quality = 1)")
    held = crc_bucket(F.col("doc_id"), 3) == 1
    model = quality.train(table(spark, rows), labels.filter(~held))
    got = quality.score(table(spark, rows), model, {"doc_id": F.col("doc_id"), "held_out": held}).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
    tested = [x for x in got if x["held_out"] and (x["doc_id"] or 0) >= 10]
    assert {x["doc_id"] for x in tested} == {i for i in range(10, 210) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([x["predicted"] == x["doc_id"] % 2 for x in tested]) > 0.95
    none = quality.train(table(spark, rows), labels.limit(0))
    assert {x["score"] for x in quality.score(table(spark, EDGES), none, {"doc_id": F.col("doc_id")}).collect()} == {0.5}


M64 = (1 << 64) - 1


def brute_features(text, buckets):
    """The features one by one: words, pairs, n-grams within words and their edges."""
    data = (text or "").encode()
    bucket = lambda h, salt: (((h + salt) * 0x9E3779B97F4A7C15 & M64) >> 33) % (buckets - 1) + 1
    rolled = lambda codes: functools.reduce(lambda h, c: (h * 0x100000001B3 + c) & M64, codes)
    split = data.split()
    hashes = [sum(c * pow(0x100000001B3, i + 1, 1 << 64) for i, c in enumerate(w)) & M64 for w in split]
    out = [bucket(h, 1) for h in hashes] + [bucket((a * 0x100000001B3 + b) & M64, 2) for a, b in zip(hashes, hashes[1:], strict=False)]
    for w in split:
        edged = b" " + w + b" "
        for n in (2, 3, 4):
            out += [bucket(rolled(edged[i : i + n]), 3 + n) for i in range(len(edged) - n + 1)]
    return Counter([0, *out])


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_features_match_one_by_one(monkeypatch, piece):
    monkeypatch.setattr(quality, "PIECE", piece)
    r = random.Random(40)
    texts = [None, "", " \t\n", "a", "aa aa  b", " Ünï\x0bwörds\n\nhere ", "".join(r.choices("ab \n", k=300))]
    for t in texts:
        ids, n = quality.counted(t and t.encode(), 1 << 12)
        assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == brute_features(t, 1 << 12), t
        assert not t or b"".join(quality.pieces(t.encode())) == t.encode()


def test_training_matches_step_by_step():
    """The descent restated with plain lists, and the folded score against the unfolded one."""
    r = random.Random(41)
    texts = [("good words here " * 3, 1), ("bad $$ junk", 0), ("more good", 1), ("%% %% bad", 0)]
    buckets, dims, epochs = 64, 3, 2
    samples = []
    for t, y in texts:
        c = brute_features(t, buckets)
        samples.append((np.array(sorted(c)), np.array([float(c[i]) for i in sorted(c)]), y))
    model = quality.fit(samples, buckets, dims, epochs, 0.5, 7)
    rng = np.random.default_rng(7)
    vectors = [[float(x) for x in row] for row in rng.uniform(-1 / dims, 1 / dims, (buckets, dims)).astype(np.float32)]
    top = [[float(x) for x in row] for row in rng.uniform(-0.1, 0.1, (2, dims)).astype(np.float32)]
    for epoch in range(epochs):
        for k in rng.permutation(len(samples)):
            ids, counts, y = samples[k]
            share = [c / sum(counts) for c in counts]
            mean = [sum(s * vectors[i][d] for i, s in zip(ids, share, strict=True)) for d in range(dims)]
            e = [math.exp(sum(top[c][d] * mean[d] for d in range(dims))) for c in (0, 1)]
            p = [x / sum(e) - (c == y) for c, x in enumerate(e)]
            back = [sum(p[c] * top[c][d] for c in (0, 1)) for d in range(dims)]
            step, norm = 0.5 * (1 - epoch / epochs), sum(s * s for s in share)
            top = [[top[c][d] - step * p[c] * mean[d] for d in range(dims)] for c in (0, 1)]
            for i, s in zip(ids, share, strict=True):
                vectors[i] = [vectors[i][d] - step * s / norm * back[d] for d in range(dims)]
    for t in [*(t for t, _ in texts), "", "".join(r.choices("abc ", k=100))]:
        c = brute_features(t, buckets)
        mean = [sum(n * vectors[i][d] for i, n in c.items()) / sum(c.values()) for d in range(dims)]
        z = [sum(top[k][d] * mean[d] for d in range(dims)) for k in (0, 1)]
        assert model.score(t.encode()) == pytest.approx(1 / (1 + math.exp(z[0] - z[1])), abs=1e-4)


def test_quality_bounds_and_edges(spark, monkeypatch):
    rows = [(i, ("good plain words " if i % 2 else "$$ %% && ") * 20) for i in range(10, 40)] + EDGES
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10, 40)] + [(999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows).withColumns({"id": F.lit("clash"), "counts": F.lit(1), "label": F.lit(2), "n": F.lit(3)})
    model = quality.train(docs, labels)
    whole = {r["doc_id"]: r["score"] for r in quality.score(docs, model, {"doc_id": F.col("doc_id")}).collect()}
    assert whole[11] > 0.5 > whole[10]
    monkeypatch.setattr(quality, "PIECE", 50)
    long = "plain words " * 200_000
    assert model.score(long.encode()) == pytest.approx(quality.Model(model.weights).score(long.encode()))
    sizes = []
    monkeypatch.setattr(quality, "fit", lambda samples, *a, **k: sizes.append(len(samples)) or quality.Model(np.zeros(8)))
    quality.train(docs, labels, train_bytes=1000)
    quality.train(docs, labels, train_bytes=0)
    quality.train(docs.limit(0), labels)
    assert sizes[1:] == [2, 0] and 2 < sizes[0] < 20
    assert quality.score(docs.limit(0), model, {"doc_id": F.col("doc_id")}).count() == 0


# 7


@pytest.mark.skipif(not os.path.exists(token_ledger.RANKS), reason="no vocabulary")
def test_byte_bpe_round_trip():
    count = token_ledger.byte_bpe()
    encoding = token_ledger._encoding(token_ledger.RANKS, token_ledger.PATTERN)
    for text in ("", "Hello, world!  \n", "ça va 123", "x" * 5000):
        ids = encoding.encode_ordinary(text)
        assert count(text) == len(ids) and encoding.decode(ids) == text


def test_ledger_matches_a_recount(spark, tmp_path):
    counters = {"words": lambda t: len(t.split()), "chars": len}
    ledger = token_ledger.TokenLedger(spark, str(tmp_path / "ledger"), counters)
    assert ledger.totals().count() == 0
    rows = EDGES + [(100 + i, f"text number {i}") for i in range(30)]
    docs = table(spark, rows, source={100 + i: None if i % 7 == 0 else f"s{i % 3}" for i in range(30)}, lang={100: None})
    assert ledger.apply("1", token_ledger.as_changes(docs, "insert"))
    before = sorted(map(str, ledger.totals().collect()))
    assert not ledger.apply("1", token_ledger.as_changes(docs, "insert"))
    assert sorted(map(str, ledger.totals().collect())) == before
    gone = docs.filter("doc_id in (4, 105)").unionByName(docs.filter("doc_id is null"))
    assert ledger.apply("2", token_ledger.as_changes(gone, "delete"))
    new = docs.filter("doc_id between 110 and 119").withColumn("text", F.lit("a b c d e f")).withColumn("source", F.lit("moved"))
    assert ledger.apply("3", token_ledger.as_changes(new, "revise"))
    assert ledger.apply("4", token_ledger.as_changes(docs.filter("doc_id = 999"), "delete"))
    want = {}
    left = [r for r in docs.collect() if r["doc_id"] not in (4, 105, None) and not 110 <= r["doc_id"] <= 119] + new.collect()
    for r in left:
        for v, count in counters.items():
            k = (r["source"], r["lang"], v)
            d, t = want.get(k, (0, 0))
            want[k] = d + 1, t + (count(r["text"]) if r["text"] is not None else 0)
    assert {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in ledger.totals().collect()} == want


def test_ledger_survives_a_batch_cut_short(spark, tmp_path):
    ledger = token_ledger.TokenLedger(spark, str(tmp_path / "ledger"), {"chars": len})
    ledger._prepare(token_ledger.as_changes(table(spark, [(1, "abc")]), "insert"))
    assert token_ledger.TokenLedger(spark, ledger.path, ledger.counters).totals().count() == 0
    assert ledger.apply("1", token_ledger.as_changes(table(spark, [(1, "abc")]), "insert"))
    assert ledger.totals().first()["tokens"] == 3


def test_two_committers(spark, tmp_path):
    """One writer commits after the other has read the state and before it commits."""
    one, other = (token_ledger.TokenLedger(spark, str(tmp_path / "ledger"), {"chars": len}) for _ in range(2))
    docs = table(spark, [(1, "abc"), (2, "de")])

    def interrupted(batch, changes, first_batch, first):
        prepare, calls, won = other._prepare, [], []

        def slow(rows):
            folder = prepare(rows)
            if not calls:
                won.append(one.apply(first_batch, first))
            calls.append(folder)
            return folder

        other._prepare = slow
        try:
            return other.apply(batch, changes), won[0]
        finally:
            other._prepare = prepare

    insert, delete = token_ledger.as_changes(docs, "insert"), token_ledger.as_changes(docs.filter("doc_id = 1"), "delete")
    assert interrupted("b1", insert, "b1", insert) == (False, True) and one.totals().first()["tokens"] == 5
    more = token_ledger.as_changes(table(spark, [(3, "wxyz")]), "insert")
    assert interrupted("b2", more, "b3", more) == (True, True) and other.totals().first()["tokens"] == 13
    assert interrupted("b4", delete, "b5", delete) == (True, True) and other.totals().first()[-2:] == (3, 10)
    assert one.batches() == other.batches() == ["b1", "b2", "b3", "b4", "b5"]


def test_ledger_compacts(spark, tmp_path):
    ledger = token_ledger.TokenLedger(spark, str(tmp_path / "ledger"), {"chars": len}, max_pending=2)
    for i in range(7):
        assert ledger.apply(f"in{i}", token_ledger.as_changes(table(spark, [(i, "x" * i)]).withColumns({"op": F.lit("clash"), "tokens": F.lit(1)}), "insert"))
        assert ledger.apply(f"out{i}", token_ledger.as_changes(table(spark, [(i - 1, None)]), "delete"))
        assert not ledger.apply(f"in{i}", token_ledger.as_changes(table(spark, [(i, "x" * i)]), "insert"))
        assert [tuple(r[-2:]) for r in ledger.totals().collect()] == [(1, i)]
    assert ledger.compact() and ledger._read("entries").count() == 1 and len(list((tmp_path / "ledger" / "data").iterdir())) < 8
    assert ledger.apply("none", token_ledger.as_changes(table(spark, []), "revise"))
    again = token_ledger.TokenLedger(spark, ledger.path, ledger.counters)
    assert not again.apply("in3", token_ledger.as_changes(table(spark, [(3, "xxx")]), "insert")) and again.totals().first()["tokens"] == 6


# 8


@pytest.mark.parametrize("limit", [decontaminate.MAX_LITERAL, 0])
def test_contamination_matches_brute_force(spark, limit):
    r = random.Random(8)
    vocabulary = ["the", "of", "a", *(f"v{i}" for i in range(60))]
    items = [(k, " ".join(r.choices(vocabulary, k=r.choice([1, 3, 5, 9, 10, 14, 30])))) for k in range(25)] + [(30, None), (31, " ! "), (32, "the of"), (None, "v1 v2 v3"), (5, "v3 V4 v5 v6")]
    rows = list(EDGES)
    for i in range(60):
        text = r.choices(vocabulary, k=r.randint(0, 80))
        for _ in range(r.randint(0, 2)):
            item = terms(r.choice(items)[1])
            at, cut = r.randint(0, len(text)), r.randint(0, 3)
            text[at:at] = [w.upper() for w in item[cut:]]
        rows.append((100 + i, r.choice([" ", ", ", "-\n"]).join(text)))
    docs = table(spark, rows).withColumn("n_hit", F.lit(9)).withColumn("rid", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, {"doc_id": F.col("doc_id")}, max_literal=limit).collect()
    windows = {}
    for k, t in items:
        w = terms(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(k)
    want = []
    for i, t in rows:
        w, hit, found = terms(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p : p + n])) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[x] - {None}
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    assert sum(x[5] for x in want) > 20
    assert sorted([tuple(x) for x in got], key=str) == sorted(want, key=str)


def test_decontaminated_rows_and_no_items(spark):
    docs = table(spark, [*EDGES, (50, "one two three four five"), (51, "clean text")])
    bench = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(EDGES) + 1 and kept.filter("doc_id = 50").isEmpty()
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == len(EDGES) + 2
    assert decontaminate.decontaminated(table(spark, []), bench).count() == 0


# 10


def reference_vector(text, dims, seed):
    """Letter by letter: bind three vectors, rolled by place, and add up."""
    vectors, ids, out = language_id.letter_vectors(dims, seed), language_id.letter_ids(), np.zeros(dims)
    code = [0, *(int(ids[ord(c)]) for c in text), 0]
    for i in range(1, len(code) - 1):
        if code[i]:
            out += np.roll(vectors[code[i - 1]], 2) * np.roll(vectors[code[i]], 1) * vectors[code[i + 1]]
    return out


def test_bundles_match_letter_by_letter(monkeypatch):
    texts = ["Hello, world", "", None, "123", "ÉÈ éè straße", "日本語 text", "a" * 50]
    for segment in (400_000, 3):
        monkeypatch.setattr(language_id, "SEGMENT", segment)
        got, n = language_id.bundle(texts, 128, 1)
        for t, v in zip(texts, got, strict=True):
            assert (v == reference_vector(t or "", 128, 1)).all()
        assert n.tolist() == [sum(c.isalpha() for c in t or "") for t in texts]


def test_language_id(spark):
    r = random.Random(10)
    letters = {"aa": "abcdefgh", "bb": "ghijklmnop", "cc": "éèàçüö"}
    rows = [(i, " ".join("".join(r.choices(letters[k], k=r.randint(2, 8))) for _ in range(30))) for i, k in enumerate(["aa", "bb", "cc"] * 40, 100)]
    lang = {i: ["aa", "bb", "cc"][(i - 100) % 3] for i, _ in rows} | {None: "aa", 1: "bb", 6: None}
    docs = table(spark, EDGES + rows, lang=lang).withColumn("score", F.lit("clash"))
    held = crc_bucket(F.col("doc_id"), 4) == 2
    profiles = language_id.train(docs.filter(~held & (F.col("doc_id") >= 100)), "text", "lang")
    got = language_id.identify(docs, "text", profiles, {"doc_id": F.col("doc_id")}).collect()
    assert all(x["lang_pred"] == lang[x["doc_id"]] for x in got if (x["doc_id"] or 0) >= 100)
    assert {x["doc_id"] for x in got if x["lang_pred"] == "und"} == {1, 2, 3} and all(0 <= x["score"] <= 1 for x in got)
    unit = {k: sum(reference_vector(t, 1024, language_id.SEED) for i, t in rows if lang[i] == k and zlib.crc32(str(i).encode()) % 4 != 2) for k in letters}
    v = reference_vector(rows[0][1], 1024, language_id.SEED)
    best = max(float(p @ v / np.linalg.norm(p) / np.linalg.norm(v)) for p in unit.values())
    assert next(x["score"] for x in got if x["doc_id"] == 100) == pytest.approx(best, abs=1e-6)
    none = language_id.train(docs.limit(0), "text", "lang")
    assert {x["lang_pred"] for x in language_id.identify(docs, "text", none, {"doc_id": F.col("doc_id")}).collect()} == {"und"}
    assert Workspace(spark, "x").path
