"""Property checks against brute force on random, skewed inputs."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.operators import compare as C
from loomspark.operators.ranks import kth_smallest

rows_strategy = st.lists(
    st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b"]), st.integers(min_value=0, max_value=30)),
    min_size=1, max_size=120)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, frac=st.floats(min_value=0.0, max_value=0.999))
def test_kth_smallest_property(spark, rows, frac):
    df = spark.createDataFrame(rows, "g string, v int").repartition(3)
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    ks = {g: int(len(vs) * frac) + 1 for g, vs in groups.items()}
    kdf = spark.createDataFrame(list(ks.items()), "g string, _k long")
    got = {r["g"]: r["v"] for r in kth_smallest(df, ["g"], "v", kdf).collect()}
    assert got == {g: sorted(vs)[ks[g] - 1] for g, vs in groups.items()}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, extra=st.lists(st.tuples(st.sampled_from(["hot", "z"]), st.integers(0, 30)), max_size=3))
def test_compare_results_property(spark, rows, extra):
    a = spark.createDataFrame(rows, "g string, v int")
    same = C.compare_results(a, a.orderBy(F.rand(3))).first()
    assert same["status"] == "PASS"
    b = spark.createDataFrame(rows + extra, "g string, v int")
    r = C.compare_results(a, b).first()
    assert (r["status"] == "PASS") == (not extra)
    assert r["only_in_b"] == len(extra) and r["only_in_a"] == 0
