"""Operators 5, 6 and 9 against plain Python versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidewright.llm import line_templates, simhash, substrings
from tidewright.llm.common import Workspace
from tidewright.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [(None, "a null id " * 20), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "two words"), (6, "x" * 5000), (7, "a\nb\nb\n\nc")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


def vocabulary(seed, n=40):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(n)]


def corpus(seed=1, n=60):
    r, words = random.Random(seed), vocabulary(seed, 400)
    passages = [r.choices(words, k=r.randint(45, 120)) for _ in range(4)]
    rows = []
    for i in range(n):
        text = r.choices(words, k=r.randint(0, 150))
        for p in r.sample(passages, r.randint(0, 2)):
            at = r.randint(0, len(text))
            text[at:at] = p
        rows.append((i, " ".join(text)))
    rows += [(n + k, rows[k][1]) for k in range(10)] + [(n + 20, "rep " * 90), (n + 21, "rep " * 70), (n + 22, "a b " * 60), (n + 23, "b a " * 60)]
    return rows


def brute_substrings(rows, window):
    last, first = (1 << 63) - 1, {}
    texts = [(last if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in texts:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for (i, w), (doc, _) in zip(texts, rows, strict=True):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((doc, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_substrings_match_brute_force(spark, batches):
    rows = corpus() + EDGES
    got = substrings.deduplicated(table(spark, rows), {"doc_id": F.col("doc_id")}, batches=batches)
    assert sorted([tuple(r)[:4] for r in got.collect()], key=str) == brute_substrings(rows, 50)


@pytest.mark.parametrize("batches", [1, 3])
def test_substrings_repeated_within_an_id(spark, batches):
    """A span of which some windows are old, more than once in a text or in two texts of one id."""
    words, rows = vocabulary(8, 400), []
    for k in range(12):
        r = random.Random(k)
        x, y, c, d, e = (r.choices(words, k=10) for _ in range(5))
        p = r.choices(words, k=r.randint(50, 80))
        block = c + p + d
        rows.append((10 * k, " ".join(x + p + y)))
        if k % 2:
            rows.append((10 * k + 1, " ".join(block + e + block + block)))
        else:
            rows += [(10 * k + 1, " ".join(block)), (10 * k + 1, " ".join(e + block)), (10 * k + 1, " ".join(e + block))]
        rows.append((10 * k + 2, " ".join(p)))
    rows += [(500, "so " * 60 + "it goes"), (501, "so " * 90 + "and so " * 40), (501, "so " * 52 + "and so " * 70)]
    got = substrings.deduplicated(table(spark, rows), {"doc_id": F.col("doc_id")}, batches=batches)
    assert sorted([tuple(r)[:4] for r in got.collect()], key=str) == brute_substrings(rows, 50)


def test_substrings_with_repeats_inside_documents(spark):
    """Few words and short windows: the same windows at many places, in rows that share ids, over several compactions."""
    for seed in (31, 32):
        r = random.Random(seed)
        lexicon = vocabulary(seed, 12)
        passages = [r.choices(lexicon, k=r.randint(10, 30)) for _ in range(6)]
        rows = []
        for i in range(60):
            text = [w for _ in range(r.randint(0, 4)) for w in [*r.choice(passages), *r.choices(lexicon, k=r.randint(0, 6))]]
            rows.append((r.choice([i, i // 2, None if i % 17 == 0 else i]), " ".join(text)))
        rows += rows[:5]
        got = substrings.deduplicated(table(spark, rows), {"doc_id": F.col("doc_id")}, window=10, anchor=4, batches=5, max_runs=1)
        want = brute_substrings(rows, 10)
        assert sorted([tuple(x)[:4] for x in got.collect()], key=str) == want and sum(x[2] for x in want) > 500


def test_substrings_take_string_ids(spark):
    rows = [(f"d{i:03d}", t) for i, t in corpus(3, 40)] + [(None, "a b " * 60), ("", "x " * 80), ("é", "x " * 70)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(x["doc_id"], x["kept_sha256"]) for x in substrings.deduplicated(docs, {"doc_id": F.col("doc_id")}, batches=3).collect()}
    order = {d: i for i, d in enumerate(sorted((d for d, _ in rows if d is not None), key=str.encode))}
    back = {i: d for d, i in order.items()}
    want = {(back.get(i), sha) for i, _, _, sha in brute_substrings([(order.get(d), t) for d, t in rows], 50)}
    assert got == want


def test_substrings_small_windows_and_extra_columns(spark):
    rows = corpus(2, 40)
    docs = table(spark, rows).withColumnsRenamed({"lang": "parts", "source": "row"})
    got = substrings.deduplicated(docs, {"doc_id": F.col("doc_id")}, window=12, anchor=6, batches=3, max_runs=1)
    assert sorted([tuple(r)[:4] for r in got.collect()], key=str) == brute_substrings(rows, 12)
    assert substrings.deduplicated(table(spark, []), {"doc_id": F.col("doc_id")}).count() == 0


def test_anchor_depends_on_the_window_only():
    words = [w.encode() for w in vocabulary(5, 300)]
    found = {}
    for cut in (0, 7, 31):
        hashed = substrings.Hashed(words[cut:])
        a, _, first, last = substrings.spans(hashed, 50, 25)
        for anchor, lo, hi in zip(a, first, last, strict=True):
            for p in range(lo, hi + 1):
                assert found.setdefault(p + cut, anchor) == anchor


def shingles_of(text, width):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return []
    return [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]


def fingerprint(text, width=4):
    """The contract's rule, step by step."""
    shingles = shingles_of(text, width)
    if not shingles:
        return 0
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark):
    r, words = random.Random(3), vocabulary(3, 200)
    rows = list(EDGES)
    for i in range(40):
        text = r.choices(words, k=r.choice([3, 40, 200, 400]))
        rows.append((100 + i, " ".join(text)))
        for k in range(r.randint(0, 4)):
            near = list(text)
            near[r.randrange(len(near))] = "Éx"
            rows.append((200 + 10 * i + k, " ".join(near).upper() if k == 3 else " ".join(near)))
    got = simhash.near_duplicates(table(spark, rows)).collect()
    prints = [fingerprint(t) for _, t in rows]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"]) for r in got) == sorted((i is None, i or 0, f"{p:016x}") for (i, _), p in zip(rows, prints, strict=True))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == sorted(str((i, least[g])) for (i, _), g in zip(rows, group, strict=True))


def test_links_are_found_at_every_distance(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(30)]
    every = set(base)
    for b in base:
        for d in range(1, 11):
            every.add(b ^ sum(1 << k for k in r.sample(range(64), d)))
    signed = [int(np.uint64(x).view(np.int64)) for x in every]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for distance in (2, 4, 5, 7, 9):
        got = sorted((r["u"], r["v"]) for r in simhash.links(df, distance).collect())
        want = sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance)
        assert got == want
    assert [len(simhash.segments(d)) for d in (1, 4, 5, 7, 9)] == [1, 3, 3, 4, 5]


def test_links_broadcast_no_variants(spark, tmp_path):
    spark.range(2000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    plan = simhash.links(spark.read.parquet(str(tmp_path / "fps")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_representatives(spark):
    rows = EDGES + [(50, "same text " * 30), (51, "same text " * 30), (51, "same text " * 30)]
    docs = table(spark, rows).withColumn("fp", F.lit("clash"))
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 1 and 50 in ids and 51 not in ids and 1 in ids and 2 not in ids
    assert simhash.representatives(table(spark, [])).count() == 0


def test_representatives_match_jaccard_alone(spark):
    """Near copies of similarity 0.8 or more go however far apart their fingerprints are."""
    r, words, rows = random.Random(12), vocabulary(12, 500), []
    for i in range(80):
        text = r.choices(words, k=r.choice([60, 120, 300]))
        near = list(text)
        for at in r.sample(range(len(near)), len(near) // (60 if i % 4 else 30)):
            near[at] = "changed"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(near))]
    sets = [set(shingles_of(t, 5)) for _, t in rows]
    prints = [fingerprint(t, 5) for _, t in rows]
    alike = [len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1]) for k in range(0, len(rows), 2)]
    far = [(prints[k] ^ prints[k + 1]).bit_count() > 9 for k in range(0, len(rows), 2)]
    assert sum(a and f for a, f in zip(alike, far, strict=True)) > 5 and not all(alike)
    want = sorted(i for i, _ in rows if i % 2 == 0 or not alike[i // 2])
    assert sorted(x["doc_id"] for x in simhash.representatives(table(spark, rows)).collect()) == want


def test_candidates_are_checked(spark, monkeypatch):
    """All texts with one fingerprint and one salt: only similar ones link, and all of these."""
    r, words, rows = random.Random(13), vocabulary(13, 500), []
    for i in range(12):
        text = r.choices(words, k=60)
        rows += [(10 * i + k, " ".join([*text, *r.choices(words, k=3 * k)])) for k in range(4)]
    real = simhash.signatures

    def fake(*args, **options):
        return real(*args, **options).withColumns({"fp": F.lit(0).cast("long"), "salts": F.array(*[F.lit(0).cast("long")] * simhash.STAGE_PARTS)})

    monkeypatch.setattr(simhash, "signatures", fake)
    assert sorted(x["doc_id"] for x in simhash.representatives(table(spark, rows)).collect()) == jaccard_representatives(rows)


def jaccard_representatives(rows, similarity=0.8):
    sets = [set(shingles_of(t, 5)) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(i, least.get(g, i))
    return sorted(least.values())


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Chains of similar texts, many of them not similar to one another, beside texts that are like none."""
    r, words, rows = random.Random(14), vocabulary(14, 600), []
    base = r.choices(words, k=150)
    for i in range(150):
        text = list(base)
        for at in r.sample(range(150), r.randint(0, 7)):
            text[at] = f"{text[at]}x{r.randint(0, 3)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(r.choices(words, k=r.choice([6, 7, 40])))) for i in range(30)] + [(2000 + i, rows[i][1].upper()) for i in range(5)]
    want = jaccard_representatives(rows)
    assert 40 < len(want) < 160
    assert sorted(x["doc_id"] for x in simhash.representatives(table(spark, rows)).collect()) == want


def test_stage_on_an_empty_table_and_clashing_names(spark):
    names = ["node", "fp", "salts", "__t", "key", "root", "first"]
    docs = table(spark, [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (None, "a b c d e f g h")]).withColumns({n: F.lit("x") for n in names})
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == [1, 3]
    assert simhash.representatives(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs).count() == 4 and simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + k) for k in range(1, 60)] + [(5, 5), (2000, 2001), (2001, 2000)]
    ws = Workspace(spark, "test")
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long"), ws).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[1000 + k] for k in range(60)} == {1000} and got[2001] == 2000
    assert connected_components(spark.createDataFrame([], "u long, v long"), Workspace(spark, "none")).count() == 0


def brute_lines(rows, min_docs=5, constant=0.6, rare=50):
    def mask(line):
        return tuple("<*>" if any("0" <= c <= "9" for c in t) else t for t in line.split())

    texts = [(1 << 63 if i is None else i, None if t is None else t.split("\n")) for i, t in rows]
    by_line, leaves, places = {}, {}, {}
    for k, (i, ls) in enumerate(texts):
        for m in {mask(x) for x in ls or []} - {()}:
            by_line.setdefault(m, set()).add((i, k))
    for m, v in by_line.items():
        leaves.setdefault((len(m), m[:3]), []).append(m)
        for p, t in enumerate(m):
            places[m[:3], len(m), p, t] = places.get((m[:3], len(m), p, t), 0) + len(v)
    templates = {}
    for (size, lead), ms in leaves.items():
        weight = sum(len(by_line[m]) for m in ms)
        for m in ms if size >= 3 and len(ms) > 1 and weight >= min_docs else []:
            fixed = [p for p, t in enumerate(m) if t != "<*>" and places[lead, size, p, t] >= max(min_docs, weight / rare)]
            for gone in [None, *(p for p in fixed if p >= 3)]:
                left = [p for p in fixed if p != gone]
                if len(left) >= constant * size - 1e-9:
                    templates.setdefault((size, tuple((p, m[p]) for p in left)), set()).add(m)
    first = {m: min(v)[0] for m, v in by_line.items() if len(v) >= min_docs}
    for ms in templates.values():
        docs = set().union(*(by_line[m] for m in ms))
        if len(docs) >= min_docs:
            first |= {m: min(min(docs)[0], first.get(m, 1 << 64)) for m in ms}
    out = []
    for (i, ls), (doc, _) in zip(texts, rows, strict=True):
        kept = [x for x in ls or [] if i <= first.get(mask(x), 1 << 64)]
        out.append((doc, len(ls or []), len(ls or []) - len(kept), None if ls is None else "\n".join(kept)))
    return sorted(out, key=str)


def test_line_templates_match_brute_force(spark):
    r, words = random.Random(6), vocabulary(6, 60)
    rows = list(EDGES)
    for i in range(60):
        lines = [" ".join(r.choices(words, k=r.randint(1, 9))) for _ in range(r.randint(1, 5))]
        if i % 3 == 0:
            lines.append("All rights reserved here")
        if i % 4 == 0:
            lines.append(f"Posted by {r.choice(words)} on day {r.randint(1, 99)} of the month")
        if i % 5 == 0:
            lines += [f"Page {i} of {i + 9}", f"Page {i} of {i + 9}"]
        r.shuffle(lines)
        rows.append((100 + i, "\n".join(lines)))
    rows += [(500, "All rights reserved here"), (500, "All rights reserved here")]
    docs = table(spark, rows).withColumn("kept", F.lit(1)).withColumn("leaf", F.lit(2))
    got = line_templates.deduplicated(docs, {"doc_id": F.col("doc_id")})
    want = brute_lines(rows)
    assert sum(w[2] for w in want) > 30
    assert sorted([tuple(x) for x in got.collect()], key=str) == want
    assert line_templates.deduplicated(table(spark, []), {"doc_id": F.col("doc_id")}).count() == 0


def dropped(spark, rows, **options):
    return sum(r["n_dropped"] for r in line_templates.deduplicated(table(spark, rows), {"doc_id": F.col("doc_id")}, **options).collect())


def test_a_field_with_a_frequent_value(spark):
    words = ["Alpha"] * 5 + ["Bravo", "Delta", "Echo", "Golf"]
    rows = [(i, f"This page was made by {w} for all of us") for i, w in enumerate(words)]
    assert dropped(spark, rows) == brute_count(rows) == 8


def brute_count(rows):
    return sum(r[2] for r in brute_lines(rows))


@pytest.mark.parametrize("n", [50, 200, 1000, 5000])
def test_a_template_is_found_at_every_size(spark, n):
    r = random.Random(n)
    names, cities = vocabulary(21, 200), vocabulary(22, 200)
    rows = [(i, f"Sent to you by {r.choice(names)}a from {r.choice(cities)}b with our best regards") for i in range(n)]
    assert dropped(spark, rows) == n - 1
    assert n > 1000 or brute_count(rows) == n - 1


def test_short_lines_and_hot_lines(spark):
    rows = [(i, "Home\nRead more\n \n" + f"own line{'abcdefghij'[i]} here") for i in range(10)]
    assert dropped(spark, rows) == dropped(spark, rows, hot=5) == brute_count(rows) == 18


def test_line_templates_take_string_ids(spark):
    rows = [(f"d{i}", "the same line here\nand more of it") for i in range(8)] + [(None, "the same line here")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in line_templates.deduplicated(docs, {"doc_id": F.col("doc_id")}).collect()}
    assert got == {None: 1, "d0": 0} | {f"d{i}": 2 for i in range(1, 8)}


def test_lines_without_ansi_and_with_clashing_names(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        names = ["drops", "line", "id", "k", "n_lines", "first", "n"]
        docs = table(spark, EDGES).withColumns({n: F.lit("x") for n in names})
        got = line_templates.deduplicated(docs, {"doc_id": F.col("doc_id"), "row": F.struct("*")}).collect()
        assert sorted(str((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"])) for r in got) == sorted(map(str, brute_lines(EDGES)))
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
