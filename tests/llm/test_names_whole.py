"""Linking of names that the two-token way leaves out."""

import pytest

from lodeworks.llm import names as n


def groups(spark, names):
    found = {}
    for r in n.entities(spark.createDataFrame([(x,) for x in names], "name string")).collect():
        found.setdefault(r.root, set()).add(r.name)
    return set(map(frozenset, found.values()))


def test_names_of_one_token(spark):
    same = [{"Boeing Co", "Boeing", "BOEING COMPANY"}, {"Palantir Inc", "PALANTIR INC.", "Palantr Inc"}, {"HARBORLINEQUISTEL LLC", "HARBORLINEQUISTL LLC", "HARBORLINEQUISTEL"}, {"HP Inc", "HP"}, {"Raytheon"}]
    assert groups(spark, set().union(*same)) == set(map(frozenset, same))


def test_run_together_names_meet_the_spaced_one(spark):
    same = {"Harborline Quistel LLC", "HARBORLINEQUISTEL LLC", "HARBORLINEQUISTL LLC"}
    assert groups(spark, same) == {frozenset(same)}


@pytest.mark.parametrize("other", ["Martin Lockheed Space Corp", "Space Lockheed Martin Corp", "Lockheed M. Space", "Lockhed Martin Space Co", "LOCKHEEDMARTINSPACE Corp", "Lockh. Space Martn"])
def test_forms_of_three_tokens_agree(other):
    x, y = n.read_name("Lockheed Martin Space"), n.read_name(other)
    assert n.form_cost(x, y) is not None and n.form_cost(x, y) == n.form_cost(y, x)


def test_forms_of_three_tokens_differ():
    x = n.read_name("Lockheed Martin Space Corp")
    assert all(n.form_cost(x, n.read_name(o)) is None for o in ("Lockheed Martin Catering Corp", "Lockheed Mordane Quistel Corp", "Lockheed Corp", "Lockheed Martin Space LLC"))
    assert n.form_cost(n.read_name("William Theodore Kastrode"), n.read_name("William B. Kastrode")) is None


def test_assignment():
    costs = [[4.0, 1.0, 3.0, 9.0], [2.0, 0.0, 5.0, 9.0], [3.0, 2.0, 2.0, 9.0]]
    assert sum(costs[i][j] for i, j in enumerate(n.assigned(costs))) == 5.0


def test_names_of_three_tokens(spark):
    same = [{"Lockheed Martin Space Corp", "Martin Lockheed Space Corp", "Space Lockheed Martn Corp", "Lockheed M. Space Corp", "LOCKHEEDMARTINSPACE CORP"}, {"Harborline Quistel Catering", "Quistel Harborlin Catering"}, {"Harborline Mordane Catering"}]
    assert groups(spark, set().union(*same)) == set(map(frozenset, same))


@pytest.mark.parametrize("crowd", [5_000, 2, 1, 0])
def test_crowds_lose_no_form(spark, monkeypatch, crowd):
    monkeypatch.setattr(n, "CROWD", crowd)
    same = [
        {"Ribraex Kidaick Archive Holdings LP", "R. Kidaick Archive Holdings LP", "Rbrx Kidaick AH LP", "Ribra Kidaick"},
        {"Rostrade Kidaick Data Systems Inc", "R. Kidaick Data Sys Inc"},
        {"Randune Kidaick Computing LLC", "Kidaick R. Computing"},
        {"William Kastrode", "Kastrode, W.T.", "bill kastrode", "W. Kastrode "},
        {"Margaret Kastrode"},
        {"Boeing Co", "Boeing"},
        {"Lockheed Martin Space Corp", "L. Space Martin Corp"},
    ]
    assert groups(spark, set().union(*same)) == set(map(frozenset, same))
