"""Every stage of the pipeline against a brute-force version of it, each on what the one before left."""

from __future__ import annotations

import collections
import re

import numpy as np
import pytest

import corpus_pipeline as pipeline

from tests.conftest import DATA
from tests.llm.test_operators import brute_components, tokenizer_path


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage read and wrote."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, DATA).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs, after
        docs = after
    return out


def rows(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def test_all_but_the_last_keep_the_columns(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.dtypes == before.dtypes


def test_quality(spark, stages):
    from verdigris.llm.quality import classify

    before, after = stages["quality"]
    good = {r["doc_id"] for r in classify(before, spark.read.parquet(f"{DATA}/labels.parquet")).collect() if r["predicted"]}
    assert rows(after) == {i: t for i, t in rows(before).items() if i in good} and 0 < len(good) < before.count()


def test_exact(stages):
    before, after = map(rows, stages["exact"])
    groups = collections.defaultdict(list)
    for i, t in before.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    assert sorted(after) == sorted(min(g)[1] for g in groups.values()) and len(after) < len(before)


def test_near(stages):
    before, after = map(rows, stages["near"])
    assert sorted(after) == sorted({c for _, c in brute_components(before.items()).values()})


def test_rows_that_share_a_doc_id_or_have_none(spark):
    a, b, c = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen", "red green blue white black brown"
    data = [(1, a), (2, b), (2, a), (3, c), (3, c), (None, c), (None, "x y"), (None, "x  y"), (None, "z"), (9, "only")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    kept = lambda stage: sorted(map(repr, ((r["doc_id"], r["text"]) for r in stage(spark, docs, DATA).collect())))
    want = [(1, a), (2, b), (3, c), (None, "z"), (9, "only")]
    assert kept(pipeline.exact) == sorted(map(repr, [*want, (None, "x  y")]))
    assert [x.replace("  ", " ") for x in kept(pipeline.near)] == sorted(map(repr, [*want, (None, "x y")]))


def test_pivots_with_several_texts_are_compared_by_each():
    import pandas as pd

    from verdigris.llm.near_dedup import _verified

    a, b = "one two three four five six seven", "nine ten eleven twelve thirteen fourteen"
    pairs = pd.DataFrame({"a": [5, 5, 6], "b": [1, 1, 1], "text_a": [b, b, a], "text_b": [a, b, a]})
    assert next(_verified(5, 75)(iter([pairs]))).values.tolist() == [[5, 1], [6, 1]]


def test_mixing(stages):
    from verdigris.llm.mixing import targets

    before, after = stages["mixing"]
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, taken, own, have = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for r in before.collect():
        size[r["source"]] += count(r["text"])
        own[r["doc_id"]] = count(r["text"])
    texts = rows(before)
    for r in after.collect():
        taken[r["source"]] += count(r["text"])
        have[r["doc_id"]] += count(r["text"])
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    names = sorted(size)
    want = targets([size[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))])
    assert all(abs(taken[s] - w) <= 64 for s, w in zip(names, want, strict=True))
    assert all(n <= 2 * own[i] for i, n in have.items())


def test_packing(spark, stages):
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    direct, want, got, sequences = Tokenizer.from_file(tokenizer_path()), collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for r in before.collect():
        want[r["doc_id"]] += len(direct.encode(r["text"], add_special_tokens=False).ids) + 1
    for r in after.collect():
        got[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [a for a, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 4096 and ends[-1] & (ends[-1] - 1) == 0


def odd_table(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and further columns named as the stages' own are."""
    from pyspark.sql import functions as F

    words = "one two three four five six seven eight nine ten"
    rows = [(1, words, "en", "a", 48), (1, words, "en", "a", 48), (2, words.replace(" ", "  "), "en", "b", 57), (3, words, None, None, None), (None, words + " eleven", "en", "a", 55), (None, None, None, None, None), (None, "", "en", "a", 0)]
    rows += [(4, None, "en", "b", None), (5, "long words " * 20_000, "en", "b", 220_000), (6, "x" * 100_000, "en", "c", 100_000), (7, " \t ", "en", "c", 3), (8, "short", "en", "c", 5), (8, "other", "en", "c", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("kept", "score", "size", "shard", "digest", "row number", "scored text", "words", "carried", "queue", "group"):
        docs = docs.withColumn(name, F.lit(name))
    return docs


def test_every_stage_takes_odd_rows(spark):
    docs, texts = odd_table(spark), lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
    for name, stage in pipeline.STAGES:
        empty = stage(spark, docs.limit(0), DATA)
        assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns), name
    before = texts(docs)
    assert set(texts(pipeline.quality(spark, docs, DATA))) <= set(before)
    assert pipeline.quality(spark, docs, DATA).columns == docs.columns
    # Brute force: of equal texts the longest, then the least doc_id; null is the last.
    groups = collections.defaultdict(list)
    for (i, t), n in before.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")] += [(-len(t or ""), i is None, i or 0, t)] * n
    want = collections.Counter((None if nameless else i, t) for _, nameless, i, t in map(lambda g: min(g, key=lambda x: x[:3]), groups.values()))
    got = pipeline.exact(spark, docs, DATA)
    blank = lambda c: collections.Counter({(i, None if not (t or "").strip() else t): n for (i, t), n in c.items()})
    assert blank(texts(got)) == blank(want) and got.columns == docs.columns
    # Near copies: the three texts of ten words and that of eleven are one group; texts without words all stay.
    family = {k for k in before if (k[1] or "").split()[:2] == ["one", "two"]}
    want = collections.Counter({k: n for k, n in before.items() if k not in family} | {k: 1 for k in family if k[0] == 1})
    assert texts(pipeline.near(spark, docs, DATA)) == want
    mixed = pipeline.mixing(spark, docs, DATA)
    assert mixed.columns == docs.columns and all((t or "").split() for _, t in texts(mixed))
    packed = pipeline.packing(spark, docs, DATA).collect()
    assert sum(r["start"] == 0 for r in packed) == docs.count()


def test_run_is_the_stages(spark, stages):
    total = lambda df: df.selectExpr("count(*)", "sum(length)", "count(distinct sequence_id)").first()
    assert total(pipeline.run(spark, DATA)) == total(stages["packing"][1])
