import pytest

from lodeworks.llm import names as n

SAME = [
    ("Harborline Quistel Storage Solutions LLC", "HARBORLINE QUISTEL STORAGE SOLUTIONS L.L.C."),
    ("Harborline Quistel Storage Solutions LLC", "the harborline-quistel stor solns, limited liability company"),
    ("Harborline Quistel Storage Solutions LLC", "Storage Solutions, Quistel, Harborline LLC"),
    ("Harborline Quistel Storage Solutions LLC", "HarborlineQuistel Storage Solutions LLC"),
    ("Harborline Quistel Storage Solutions LLC", "HARBORLINEQUISTEL STORAGE SOLUTIONS LLC"),
    ("Harborline Quistel Storage Solutions LLC", "Harbo. Quistel Storage Solutions LLC"),
    ("Harborline Quistel Storage Solutions LLC", "Hrbrln Quistel SS LLC"),
    ("Harborline Quistel Storage Solutions LLC", "Harb0rline Qu1stel Storage Solutions LLC"),
    ("Harborline Quistel Storage Solutions LLC", "Harborilne Quístel LLC DBA Harborline Quistel Group"),
    ("William Kastrode", "Dr. Bill Kastrode"),
    ("William Kastrode", "KASTRODE, W.T."),
    ("William T. Kastrode", "WT Kastrode"),
    ("Isabella Gournel", "Gournel Bella"),
]
APART = [
    ("Harborline Quistel Storage Solutions LLC", "Harborline Quistel Data Systems LLC"),
    ("Harborline Quistel Storage Solutions LLC", "Harborline Mordane Storage Solutions LLC"),
    ("Harborline Quistel Storage Solutions LLC", "Harborline Quistel Storage Solutions Inc"),
    ("William Kastrode", "Margaret Kastrode"),
    ("William T. Kastrode", "William B. Kastrode"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_forms_agree(a, b):
    x, y = n.read_name(a), n.read_name(b)
    assert n.form_cost(x, y) is not None and n.form_cost(x, y) == n.form_cost(y, x)


@pytest.mark.parametrize("a,b", APART)
def test_forms_differ(a, b):
    assert n.form_cost(n.read_name(a), n.read_name(b)) is None


def test_nothing_to_read():
    assert [n.read_name(x) for x in (None, "", "  ", "!?")] == [None] * 4
    assert n.read_name("Inc") is not None and n.read_name("x" * 50_000) is not None


def test_edits():
    assert [n.osa(a, b) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "xbcd"), ("abc", "xyz"))] == [0, 1, 1, 2, 3]
    assert n.shortened("mgmt", "management") and n.shortened("rec", "records") and not n.shortened("rex", "records")


@pytest.mark.parametrize("crowd", [5_000, 1, 0])
def test_entities(spark, monkeypatch, crowd):
    """Finer keys find all but the initials, which crowds leave alone."""
    monkeypatch.setattr(n, "CROWD", crowd)
    people = ["William Kastrode", "Kastrode, W.T.", "bill kastrode", "Margaret Kastrode", "W. Kastrode "]
    firms = sorted({x for pair in SAME[:9] for x in pair})
    other = ["Harborline Quistel Data Systems Inc", "HARBORLINE QUISTEL DATA SYS INC", "Mordane Quistel Storage Solutions LLC"]
    if crowd < 5_000:
        people, firms = ["William Kastrode", "bill kastrode", "Margaret Kastrode"], [f for f in firms if "Bill" not in f]
    rows = [(x,) for x in [*people, *firms, *other] * 2 + [None, "", " ", "??"]]
    linked = n.entities(spark.createDataFrame(rows, "name string"))
    groups = {}
    for r in linked.collect():
        groups.setdefault(r.root, set()).add(r.name)
    assert set(map(frozenset, groups.values())) == {frozenset(people) - {"Margaret Kastrode"}, frozenset(["Margaret Kastrode"]), frozenset(firms), frozenset(other[:2]), frozenset(other[2:])}
    pairs = {(r.name_a, r.name_b) for r in n.same_entity_pairs(linked).collect()}
    assert pairs == {(a, b) for g in groups.values() for a in g for b in g if a < b}


def test_no_names(spark):
    assert n.entities(spark.createDataFrame([], "name string")).count() == 0
    assert n.same_entity_pairs(n.entities(spark.createDataFrame([(None,)], "name string"))).count() == 0


def test_a_form_that_fits_two_firms_stays_alone(spark):
    rows = [(x,) for x in ("Harborline Quistel Data Systems", "Harborline Quistel Computing", "Harborline Quistel")]
    assert len({r.root for r in n.entities(spark.createDataFrame(rows, "name string")).collect()}) == 3
