"""Many matches in one text, overlaps of entropy and base spans, and entropies of long strings."""

import random
import string

import brute
from brightloom.llm import secrets
from pyspark.sql import functions as F


def test_entropy_of_random_strings(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 5, 19, 20, 21, 60, 300) for letters in ("ab", string.hexdigits, string.ascii_letters + string.digits + "+/_-=")]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secrets.window_entropy(F.col("t"), 20).alias("e")).collect()
    for r in got:
        assert abs(r.e - max(brute.entropy(r.t[i : i + 20]) for i in range(max(1, len(r.t) - 19)))) < 1e-9


def test_thousands_of_matches_in_one_text(spark):
    rng = random.Random(6)
    key = lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32))
    parts = [rng.choice([f"token={key()}", key(), "deadbeef" * 3, "AKIA" + "A1B2C3D4E5F6G7H8", "é word", f"x/{key()}/deadbeefdeadbeef00"]) for _ in range(6_000)]
    text = " ".join(parts)
    r = secrets.scan(spark.createDataFrame([(text, 1)], "text string, q_text int"), F.col("text"), "q").first().q
    base = brute.secrets(text)
    assert r.base_spans == brute.digest(base, brute.SECRETS)
    free = [(s.start, s.end) for s in r.found if s.kind == "entropy"]
    taken = sorted((a, b) for _, a, b in base)
    assert free and all(b <= c or d <= a for a, b in free for c, d in taken[:500] + taken[-500:])
    alone = sum(p.isalnum() and len(p) == 32 and p.isascii() for p in parts)
    assert alone * 0.97 <= len(free) <= alone + parts.count("x/")
