import random

from sheetforge.llm import secrets


def test_short_and_odd_values_are_candidates(spark):
    texts = {
        1: ('password = "hunter2!x"', "hunter2!x"),
        2: ("api_key: a1b2c3d4e5f6", "a1b2c3d4e5f6"),
        3: ("see postgres://user:Tr0ub4dor&3@host/db", "Tr0ub4dor&3"),
        4: ("login user:p@ss#1%&@host.example now", "p@ss#1%&"),
        5: ("{'passphrase': 'four words, in all'}", "four words, in all"),
        6: ('my_service_long_password="q$1"', "q$1"),
        7: ("PASSWD=x, then", "x"),
        8: ("password : 'geh3im", "geh3im"),
        9: ('db_password := "a\\"b@c"', 'a\\"b@c'),
        10: ("get ?token=abcdefghijklmnop1234&user=me", "abcdefghijklmnop1234"),
        11: ('blob "QUJDREVGR0hJSktMTU5PUA=="', "QUJDREVGR0hJSktMTU5PUA=="),
    }
    found = secrets.find_candidates(spark.createDataFrame([(i, t, "s") for i, (t, _) in texts.items()], "doc_id long, text string, source string")).collect()
    for i, (text, value) in texts.items():
        mine = [r for r in found if r["doc"] == i]
        assert value in [r["candidate"] for r in mine], (text, mine)
    assert secrets.find_candidates(spark.createDataFrame([(1, "the author: a man, at 10:30, met me: x@y.example; a secret is kept", "s")], "doc_id long, text string, source string")).count() == 0


def test_short_values_reach_the_forest(spark):
    rng = random.Random(3)
    rows = []
    for i in range(100):
        word = "".join(rng.choice("abcdefgh12345!@#$%&") for _ in range(8)) + str(i)
        rows += [(2 * i, f'set password = "{word}" now', "s"), (2 * i + 1, f"card {rng.randrange(10**15, 10**16)} paid", "s")]
    out = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == 200
    assert all(r["is_secret"] == (r["doc"] % 2 == 0) for r in out)
