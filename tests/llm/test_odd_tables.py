"""Nulls, empty and long texts, ties and repeated rows, empty tables, clashing columns: the defined results of each operator."""

import random
from collections import Counter

import pytest
from llmdata import CLASHES, empty, messy, text

from nearfold.llm import bpe, brown, decontaminate, keyed, minhash, passages, pii, quality, shuffled, warc

CORE = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def odd(spark):
    return messy(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return empty(spark)


def test_near_duplicates(spark, odd, none):
    got = {tuple(r) for r in minhash.near_duplicates(odd).collect()}
    assert got == {(1, 1, True), (2, 1, False), (6, 6, True), (7, 6, False)}
    kept = minhash.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter([1, 3, 4, 5, 6, 8, None, 9, 10, 11, 12])
    assert minhash.near_duplicates(none).count() == 0 and minhash.deduplicate(none).count() == 0


def test_leaks(spark, odd, none):
    items = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None), (3, "  "), (None, "x x x"), (4, "x x x x x x"), (5, "héé ü 日本語 🎉")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.leaks(odd, items).collect()}
    assert got == {(12, 1, 0), (9, 4, 0), (10, 5, 0)}
    clean = decontaminate.without_leaks(odd, items)
    assert clean.columns == odd.columns
    assert rows_of(clean) == rows_of(odd.where("doc_id IS NULL OR doc_id NOT IN (9, 10, 12)"))
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(odd, items.limit(0)).count() == 0
    assert rows_of(decontaminate.without_leaks(odd, items.limit(0))) == rows_of(odd)


def test_keyed_ids(spark, odd, none, tmp_path):
    made = keyed.write_shards(odd, str(tmp_path / "a"), shard_bytes=20_000).collect()
    assert Counter(r["doc_id"] for r in made) == Counter([1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12])
    assert next(r for r in made if r["doc_id"] == 3)["n_ids"] == 0
    assert keyed.write_shards(none, str(tmp_path / "b")).count() == 0


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "u1", "<p>a</p>", "r"), (2, "u2", "<p>a</p>", None), (2, "u2", "<p>a</p>", "r"), (3, None, "", "r"), (None, "u4", "", "r"), (5, "u5", None, "r"), (6, "u6", "é" * 50_000, "r"), (None, None, "<p>a</p>", "r")],
        "page_id long, url string, html string, warc_type string",
    )
    got = {(r["page_id"], r["url"], r["warc_type"], r["n_bytes"], r["original_page_id"]) for r in warc.write_archives(pages, str(tmp_path / "w")).collect()}
    assert got == {(1, "u1", "response", 8, 1), (2, "u2", "revisit", 8, 1), (None, None, "revisit", 8, 1), (3, None, "response", 0, 3), (None, "u4", "revisit", 0, 3), (6, "u6", "response", 100_000, 6)}
    assert warc.write_archives(pages.limit(0), str(tmp_path / "v")).count() == 0


def test_repeated_passages(spark, none):
    rng = random.Random(8)
    shared = text(rng, 60, 3000)
    base = [(20 + i, f"{text(rng, 40, 3000)} {shared} {text(rng, 33, 3000)}", "en", "s", None) for i in range(3)]
    got = [(r["doc_id"], r["kept_in"]) for r in passages.repeated(messy(spark, base=base)).collect()]
    # 1 and 2 are copies; the null doc_id can't be named; a text that repeats itself is no repeat across documents.
    assert {d for d, _ in got} == {2, 21, 22}
    assert all(k == ([1] if d == 2 else [20]) for d, k in got)
    assert passages.repeated(none).count() == 0


def test_shuffle(spark, odd, none):
    got = shuffled.shuffle(odd, bucket_bytes=10_000)
    rest = [c for c in odd.columns if c not in ("shard", "position")]
    assert rows_of(got.select(rest)) == rows_of(odd.select(rest))
    places = Counter((r["shard"], r["position"]) for r in got.collect())
    assert set(places.values()) == {1} and len({s for s, _ in places}) > 1
    assert shuffled.shuffle(none).count() == 0


def test_private_data(spark, odd, none):
    got = pii.redact(odd)
    keep = [c for c in odd.columns if c != "spans"]
    assert rows_of(got.select(keep)) == rows_of(odd.select(keep))
    assert {(r["text"] is None, r["spans"] is None) for r in got.collect()} == {(True, True), (False, False)}
    assert pii.redact(none).count() == 0


def test_quality(spark, odd, none):
    got = quality.reject_outliers(odd)
    assert got.columns == odd.columns
    assert got.where("text IS NULL OR trim(text) = ''").count() == odd.where("text IS NULL OR trim(text) = ''").count()
    assert quality.with_distance(odd.limit(9)).where("distance IS NOT NULL").count() == 0
    assert quality.reject_outliers(none).count() == 0


def test_bpe(spark, odd, none):
    got = bpe.decode(bpe.encode(odd))
    keep = [c for c in odd.columns if c not in ("ids", "decoded")]
    assert rows_of(got.select(keep)) == rows_of(odd.select(keep))
    assert got.where("NOT text <=> decoded").count() == 0
    assert got.where("text IS NULL AND ids IS NOT NULL OR text = '' AND size(ids) != 0").count() == 0
    assert bpe.round_trip(none).count() == 0


def test_language_model(spark, odd, none):
    got = brown.score(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in odd.collect())
    assert all((r["perplexity"] is None) == (r["n_words"] == 0) for r in got)
    assert brown.score(none).count() == 0


def test_stages_keep_the_columns(spark, odd, none):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (odd, none):
            out = stage(spark, table, "/root/testdata/sf0.001")
            assert out.columns == table.columns, name
            assert out.count() <= table.count()
    # The last stage adds the ids and the text they stand for; columns of these names are replaced.
    for table in (odd, none):
        out = corpus_pipeline.STAGES[-1][1](spark, table, "/root/testdata/sf0.001")
        keep = [c for c in table.columns if c not in ("ids", "decoded")]
        assert set(keep) < set(out.columns) and rows_of(out.select(*[f"`{c}`" for c in keep])) == rows_of(table.select(*[f"`{c}`" for c in keep]))
        assert out.where("NOT text <=> decoded").count() == 0
    assert set(CLASHES) <= set(odd.columns)
