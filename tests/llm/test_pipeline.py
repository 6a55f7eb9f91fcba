"""The pipeline against a plain Python version of its stages."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from test_dedup import brute_lines, jaccard_representatives
from test_others import SCHEMA, goals, reference_vector, terms, words

import corpus_pipeline
from tidewright.llm import language_id
from tidewright.llm.common import Workspace


def languages(rows):
    """Rows that are like a known language, which they get as theirs."""
    dims, seed = language_id.DIMS, language_id.SEED
    vectors = [reference_vector(t or "", dims, seed) for _, t, *_ in rows]
    totals = {}
    for (i, t, lang, *_), v in zip(rows, vectors, strict=True):
        if t is not None and lang is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            totals[lang] = totals.get(lang, 0) + v
    def cosine(a, b):
        return float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b) or 1)
    out = []
    for r, v in zip(rows, vectors, strict=True):
        score, lang = max(((cosine(p, v), k) for k, p in totals.items()), default=(0, None))
        if v.any() and score >= corpus_pipeline.MIN_COSINE:
            out.append((*r[:2], lang, *r[3:]))
    return out


def lines(rows):
    kept = {}
    for doc, _, dropped, text in brute_lines([(r[0], r[1]) for r in rows]):
        kept[doc] = dropped, text
    out = []
    for i, t, lang, source, n in rows:
        dropped, text = kept[i]
        if dropped and not words(text):
            continue
        out.append((i, text, lang, source, len(text)) if dropped else (i, t, lang, source, n))
    return out


def one_of_each(rows):
    kept = set(jaccard_representatives([(r[0], r[1]) for r in rows]))
    return [r for r in rows if r[0] in kept]


def clean(rows, items):
    windows = set()
    for t in items:
        w = terms(t)
        n = min(10, len(w))
        windows |= {tuple(w[p : p + n]) for p in range(len(w) - n + 1 if n else 0)}
    sizes = {len(w) for w in windows}
    return [r for r in rows if not any(tuple(terms(r[1])[p : p + n]) in windows for n in sizes for p in range(len(terms(r[1])) - n + 1))]


def test_pipeline_matches_a_plain_version(spark, tmp_path):
    r = random.Random(11)
    syllables = {"aa": ["ba", "do", "ke", "li", "mu"], "bb": ["xor", "quz", "vyx", "zzu"]}
    vocabulary = {k: ["".join(r.choices(v, k=r.randint(1, 4))) for _ in range(150)] for k, v in syllables.items()}
    items = [" ".join(r.choices(vocabulary["aa"], k=14)) for _ in range(5)]
    rows = []
    for i in range(90):
        lang = r.choice(["aa", "bb"])
        body = [" ".join(r.choices(vocabulary[lang], k=r.randint(4, 14))) for _ in range(r.randint(1, 6))]
        if i % 6 == 0:
            body.append("all rights reserved by us")
        if i % 11 == 0:
            body.insert(0, items[i % 5])
        text = "\n".join(body)
        rows.append((i, text, lang, f"src{i % 3}", len(text)))
        if i % 9 == 0:
            rows.append((200 + i, text, lang, None, len(text)))
        if i % 10 == 0:
            long = " ".join(r.choices(vocabulary[lang], k=150))
            rows += [(300 + i, long, lang, "src1", len(long)), (400 + i, long + " end", lang, "src2", len(long) + 4)]
    rows += [(500, None, "aa", "x", 0), (501, "123 ###", None, "x", 7), (502, "", "bb", "src0", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    want, docs, ws = rows, spark.read.parquet(str(tmp_path / "documents.parquet")), Workspace(spark, "stages")
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:4], (languages, lines, one_of_each, lambda x: clean(x, items)), strict=True):
        docs, before = ws.save(stage(spark, docs, str(tmp_path))), len(want)
        want = plain(want)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(map(tuple, docs.collect())) == sorted(want), name
        assert name == "line dedup" or len(want) < before
    got = corpus_pipeline.run(spark, str(tmp_path))
    sizes = {}
    for _, t, _, s, _ in want:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    taken = {x["source"]: x["n"] for x in got.groupBy("source").agg(F.sum("words").alias("n")).collect()}
    assert all(taken.get(s, 0) == int(t + 1e-9) for s, t in goals(sizes).items())
    whole = {r[0]: r[1] for r in want}
    for x in got.collect():
        assert len(words(x["text"])) == x["words"] and re.sub(r"\s+", " ", whole[x["doc_id"]]).strip().startswith(re.sub(r"\s+", " ", x["text"]).strip())


def test_other_columns_and_unlabelled_rows(spark, tmp_path):
    rows = [(i, " ".join(random.Random(i).choices(["alpha", "beta", "gamma", "delta", "eta"], k=40)), "aa" if i % 3 else None, f"s{i % 2}", 0) for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"epoch": F.lit("e"), "words": F.lit("w"), "row": F.lit("r"), "lang_pred": F.lit("l")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*docs.columns, "epoch_", "words_"]
    assert {tuple(r) for r in got.select("lang", "epoch", "words", "row", "lang_pred").distinct().collect()} == {("aa", "e", "w", "r", "l")}
    assert got.select("doc_id").distinct().count() == 12


def test_stages_take_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
