"""The letter-pair index against going through all words."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sheetforge.functions import grams
from sheetforge.operators import fuzzy
from test_fuzzy import plain_ratio


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=12), st.lists(st.text("abcd", max_size=14), min_size=1, max_size=30), st.sampled_from([30, 60, 80, 85, 100]))
def test_every_word_that_reaches_the_ratio_is_a_candidate(text, words, cutoff):
    found = set(grams.PairIndex(tuple(words)).candidates(text, cutoff).tolist())
    assert {i for i, w in enumerate(words) if plain_ratio(w, text) >= cutoff} <= found


def test_near_words_are_candidates():
    r = random.Random(1)
    for _ in range(2_000):
        word = "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 25)))
        text = list("".join(r.choice("abcdefghij") for _ in range(r.randint(0, 8))) + word)
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(text))
            text[at : at + r.randint(0, 1)] = r.choice(["", "x", "a"])
            text = text or ["a"]
        text = "".join(text)
        if fuzzy.ratio(word, text) >= 85:
            assert grams.PairIndex((word,)).candidates(text, 85).tolist() == [0]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=10), st.lists(st.lists(st.text("abc", min_size=1, max_size=7), max_size=3), max_size=8), st.sampled_from([0, 85]))
def test_first_best_class(text, classes, above):
    best = (above, None)
    for c, names in enumerate(classes):
        for p, name in enumerate(names):
            if (score := plain_ratio(name, text)) > best[0] + 1e-9:
                best = (score, (c, p))
    got = fuzzy.best_class(text, classes, above)
    assert (got[:2] if got else None) == best[1]


def test_dictionary_of_50000_words(spark):
    r = random.Random(2)
    parts = ["stahl", "guss", "blech", "rohr", "niro", "zink", "alu", "kupfer", "messing", "bronze", "titan", "kunst", "holz", "glas"]
    words = sorted({"".join(r.choice(parts) for _ in range(r.randint(1, 3))) + str(r.randrange(10_000)) for _ in range(70_000)})[:50_000]
    assert len(words) == 50_000
    texts = []
    for _ in range(60):
        word = list(r.choice(words))
        word[r.randrange(len(word))] = "q"
        texts.append("Werkstoff " + "".join(word) + " v")
    texts += ["nothing of the kind", "", "abc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    count = (spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))
    dictionary = spark.createDataFrame(list(enumerate(words)), "word_id long, word string")
    got = {x["id"]: x["word_id"] for x in fuzzy.fuzzy_match(df, dictionary, count=count).collect()}
    pairs, aligned = count[0].value, count[1].value
    assert pairs == 61 * 50_000 and aligned < 0.02 * pairs
    for i in (0, 7, 60):  # whole scans of a few
        low = texts[i].lower()
        want = [j for j, w in enumerate(words) if fuzzy.could_reach(w, frozenset(low), 85) and fuzzy.ratio(w, low) >= 85]
        assert got[i] == (want[-1] if want else None)
    assert got[61] is None and got[62] is None
