import random

from pyspark.sql import functions as F

from sheetforge.llm import fingerprints, queries


def test_texts_without_white_space(spark):
    rng = random.Random(4)
    alphabets = ["".join(map(chr, range(0x4E00, 0x5200))), "".join(map(chr, range(0xE01, 0xE2F))), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "\U0001f600\U0001f601\U0001f602\U0001f603\U0001f604\U0001f605x"]
    rows = [(i, "".join(rng.choice(a) for _ in range(n))) for i, (a, n) in enumerate((a, n) for a in alphabets for n in (60, 2000))]
    rows.append((100, "one two three four five six seven"))  # fewer than 10 tokens
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = fingerprints.likeness(fingerprints.hashes(F.col("selected")), fingerprints.hashes(F.col("edited_selected")))
    for r in fingerprints.edited_pairs(docs).select("doc_id", "n_chars", near.alias("near")).collect():
        low, high = (0.6, 0.9) if r["n_chars"] == 2000 else (0.2, 0.95)
        assert low < r["near"] < high, r


def test_shared_code_points_share_a_hash(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        a, b, shared = ("".join(rng.choice("漢字仮名交文\U00020000bcd ") for _ in range(n)) for n in (rng.randint(0, 90), rng.randint(0, 90), fingerprints.CHARS + fingerprints.SPAN - 1))
        rows.append((i, a + shared + b, b + shared + a))
    df = spark.createDataFrame(rows, "i long, a string, b string")
    both = fingerprints.winnowed(fingerprints.winnowed(df, "a", "x"), "b", "y")
    assert all(r["n"] > 0 for r in both.select(F.size(F.array_intersect(fingerprints.hashes(F.col("x")), fingerprints.hashes(F.col("y")))).alias("n")).collect())


def plain(text, k=fingerprints.CHARS, window=fingerprints.SPAN):
    """[(position, hash)] by the definition: a hash for each run, the rightmost least of each window."""
    codes = [ord(c) + 1 for c in text] or [1]
    runs = [codes[i : i + k] for i in range(max(1, len(codes) - k + 1))]
    hashes = [sum(c * pow(fingerprints.BASE, j, fingerprints.MODULUS) for j, c in enumerate(run)) % fingerprints.MODULUS for run in runs]
    if len(hashes) < window:
        return list(enumerate(hashes))
    return sorted({(i + max(j for j in range(window) if hashes[i + j] == min(hashes[i : i + window])), min(hashes[i : i + window])) for i in range(len(hashes) - window + 1)})


def test_selection_equals_plain_version(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab\U0001f600\n") for _ in range(n)) for n in (0, 1, 9, 10, 11, 24, 25, 26, 300)]
    got = fingerprints.winnowed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string"), "t", "s").collect()
    for r in got:
        assert [((1 << 27) - 1 - (p & ((1 << 27) - 1)), p >> 27) for p in r["s"]] == plain(texts[r["i"]])
    for k in (1, 3, 8):
        got = fingerprints.winnowed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string"), "t", "s", k, 5).collect()
        assert all([((1 << 27) - 1 - (p & ((1 << 27) - 1)), p >> 27) for p in r["s"]] == plain(texts[r["i"]], k, 5) for r in got)


def test_edited_selection_is_that_of_the_whole_edited_text(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("abcd é漢") for _ in range(n))) for i, n in enumerate([0, 1, 5, 30, 39, 40, 52, 53, 54, 55, 60, 61, 80, 200, 1000])]
    rows.append((99, "very long " * 30_000))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit(1)).withColumn("start", F.lit(1))
    for r in fingerprints.edited_pairs(docs).collect():
        assert [((1 << 27) - 1 - (p & ((1 << 27) - 1)), p >> 27) for p in r["edited_selected"]] == plain(r["edited"]), r["n_chars"]


def test_likenesses_of_all_documents_against_plain_version(spark):
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    got = {r["doc_id"]: r for r in queries.op7_fingerprints(spark, "/root/testdata/sf0.001").collect()}

    def likeness(a, b):
        a, b = ({h for _, h in plain(t)} for t in (a, b))
        return 2 * len(a & b) / (len(a) + len(b))

    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert got[d]["near_edited"] == likeness(t, edited) and got[d]["near_next"] == likeness(t, after)


def test_a_filter_on_the_result_stays_small(spark):
    """Filters stay above the doubling steps: the plan grows with them and not with their powers."""
    from sheetforge.llm import queries

    rows = queries.op7_fingerprints(spark, "/root/testdata/sf0.001")
    some = rows.where("near_edited < 0.3")
    assert len(some._jdf.queryExecution().optimizedPlan().toString()) < 3 * len(rows._jdf.queryExecution().optimizedPlan().toString())
    assert some.count() == sum(r["near_edited"] < 0.3 for r in rows.select("near_edited").collect())
