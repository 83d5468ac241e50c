import pytest

from strandline.operators.packed_values import Segmenter, clean_value, split_packed

CASES = [
    (None, []),
    ("", []),
    ("  ", []),
    ("NA", []),
    ("one", ["one"]),
    ("one, two", ["one", "two"]),
    ("one;two / three|four & five+six\tseven", ["one", "two", "three", "four", "five", "six", "seven"]),
    ("a | | b |  | a", ["a", "b", "a"]),
    ("NA; a ;NA", ["a"]),
    ('"a, b complex"; c', ["a, b complex", "c"]),
    ("'a; strain 7' / d'one", ["a; strain 7", "d'one"]),
    ('"x ""y"" clade", z', ['x "y" clade', "z"]),
    ('["a","o\'b","c"]', ["a", "o'b", "c"]),
    ("a (type 1, b); c", ["a (type 1, b)", "c"]),
    ("a (b (c, d), e), f", ["a (b (c, d), e)", "f"]),
    ("a (b, c", ["a (b", "c"]),
    ('"a, b', ['"a', "b"]),
    ("a-b.c subsp. d, e", ["a-b.c subsp. d", "e"]),
    ("o'a / o'b", ["o'a", "o'b"]),
]


@pytest.mark.parametrize("field,want", CASES)
@pytest.mark.parametrize("known", [[], ["one", "two", "a", "b", "c", "o'b"]])
def test_values(field, want, known):
    assert Segmenter(known).values(field) == want


def test_known_values_keep_their_marks():
    assert Segmenter([]).values("Acme, Inc;Foo") == ["Acme", "Inc", "Foo"]
    assert Segmenter(["Acme, Inc"]).values("Acme, Inc;Foo") == ["Acme, Inc", "Foo"]
    assert Segmenter(["Acme, Inc"]).values("Acme, Incorporated; xAcme, Inc") == ["Acme", "Incorporated", "xAcme", "Inc"]
    assert Segmenter(["a, b", "b, c, d"]).values("a, b, c, d") == ["a", "b, c, d"]  # the most letters
    assert Segmenter(["a, b", "c"]).values('"x, a, b"; a, b, c') == ["x, a, b", "a, b", "c"]


ROWS = [
    (1, '"Acme, Inc"; Foo'), (2, "Acme, Inc; Bar"), (3, "Foo"), (4, "Bar"), (5, '"Foo, Bar"'), (6, "Foo, Bar"),
    (7, "Baz (x; y) / Foo"), (8, "Baz (x; y)"), (9, "Bar; Acme,  Inc"),
]


@pytest.mark.parametrize("most", [0, 1, 2, 100])
def test_dictionary_from_the_column(spark, most):
    df = spark.createDataFrame(ROWS, "idx int, species string")
    got = {}
    for r in sorted(split_packed(df, "idx", "species", max_known=most).collect()):
        got.setdefault(r["id"], []).append(r["value"])
    assert got[1] == ["Acme, Inc", "Foo"] and got[2] == ["Acme, Inc", "Bar"]  # quoted once, so known
    assert got[5] == ["Foo, Bar"] and got[6] == ["Foo", "Bar"]  # both are known by themselves: a list
    assert got[7] == ["Baz (x; y)", "Foo"] and got[9] == ["Bar", "Acme", "Inc"]


def test_clean_value():
    assert clean_value(' "a" ') == "a"
    assert clean_value("'d'a'") == "d'a"
    assert clean_value('"a" x "b"') == '"a" x "b"'


def test_long_field():
    n = 20_000
    assert len(Segmenter(["v1"]).values(", ".join(f"v{i}" for i in range(n)))) == n


def test_frame(spark):
    rows = [(1, "a;b", "x"), (1, "a;b", "y"), (2, None, "z"), (3, "", "z"), (4, "a", "z"), (None, "c, d", "q")]
    df = spark.createDataFrame(rows, "idx int, species string, value string")  # `value` clashes with the result's column
    got = sorted((r["id"] if r["id"] is not None else -1, r["pos"], r["value"], r["n_values"]) for r in split_packed(df, "idx", "species").collect())
    assert got == [(-1, 1, "c", 2), (-1, 2, "d", 2), (1, 1, "a", 2), (1, 1, "a", 2), (1, 2, "b", 2), (1, 2, "b", 2), (4, 1, "a", 1)]
    assert split_packed(df.limit(0), "idx", "species").count() == 0
