from pyspark.sql import types as T

from eventloom.governance.contracts import breaking, compatible, cycle, gate, lag_total


def schema(**f):
    return T.StructType([T.StructField(n, t) for n, t in f.items()])


def test_compatibility():
    s, i = T.StringType(), T.IntegerType()
    old = schema(a=s)
    assert compatible(old, schema(a=s, b=i), "BACKWARD", {"a"}, {"a"})
    assert not compatible(old, schema(a=s, b=i), "FULL", {"a"}, {"a"})
    assert not compatible(old, schema(a=s, b=i), "BACKWARD", {"a"}, {"a", "b"})
    assert not compatible(old, schema(a=i), "FORWARD", {"a"}, {"a"})
    # an optional field removed, a schema closed to others
    assert not compatible(schema(a=s, b=i), old, "BACKWARD", {"a"}, {"a"})
    assert not compatible(old, old, "BACKWARD", {"a"}, {"a"}, open_new=False) and compatible(old, old, "FORWARD", {"a"}, {"a"}, open_new=False)
    assert breaking(old, old, {"a"}, set()) == ["a: no longer required"]


def test_cycles_and_gate():
    assert cycle([("a", "b"), ("b", "c")]) is None
    assert cycle([("a", "b"), ("b", "c"), ("c", "b")]) == ["b", "c", "b"]
    assert gate(80, 100) and not gate(79, 100) and not gate(100, 100, 0.1, 0.0)


def test_lag():
    assert lag_total({"0": 10, "1": 5, "2": 3}, {"0": 4, "1": 9}) == 9 and lag_total({}, {}) == 0
