"""Small corpora for the tests: made texts, and a table with everything that can be odd about a row."""

import random

CLASHES = "group_id kept bands rep node label bucket ids decoded shard position spans distance own m w start item_id a b x y h1 h2 leader block g d __nth __gone __b __p __rest __hash".split()


def words(rng, n, size=400):
    return [f"{'bcdfglmnprst'[k % 12]}{'aeiou'[k % 5]}{k}" for k in (rng.randrange(size) for _ in range(n))]


def text(rng, n, size=400):
    return " ".join(words(rng, n, size))


def messy(spark, extra=True, base=()):
    """Rows with nulls everywhere, blank, one-word and very long texts, repeated rows, a shared doc_id, clashing columns."""
    rng = random.Random(5)
    long = text(rng, 30_000, 5000)
    twin = text(rng, 90)
    rows = [
        (1, twin, "en", "s1", len(twin)), (2, twin, "en", "s1", len(twin)), (2, twin, "en", "s1", len(twin)), (3, "", "en", "s1", 0), (4, None, "en", "s1", None),
        (5, "  \n\t ", None, "s1", 5), (6, "word", "en", None, 4), (7, "word", "en", None, 4), (8, long, "de", "s2", len(long)), (None, twin, None, None, None),
        (9, "x " * 500, "en", "s1", 1000), (10, "héé ü 日本語 🎉 " * 9, "fr", "s3", 126), (11, text(rng, 70), "en", "s1", None), (11, text(rng, 60), "en", "s1", None), (12, "a\nb\n\nc", "", "", 6),
        *base,
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        rows = [(*r, *[None if (i + k) % 3 == 0 else f"e{i}" for k in range(len(CLASHES))]) for i, r in enumerate(rows)]
        schema += "".join(f", `{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema)


def empty(spark):
    return messy(spark).limit(0)
