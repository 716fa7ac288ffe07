"""Values sought in units against Python's search of the whole text."""

import random

import pytest

from underlay.operators import sought

VALUES, UNITS = "file_id string, inside string, low string", "file_id string, inside string, unit_no long, text string"


def expected(values, units):
    texts = {}
    for f, i, n, t in sorted((u for u in units if u[3] is not None), key=lambda u: u[2]):
        texts.setdefault((f, i), []).append(t.lower())
    return {(f, i, v) for f, i, v in values if v and v in "\n".join(texts.get((f, i), [])) and (f, i) in texts}


@pytest.mark.parametrize("most", [sought.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("automaton", [sought.AUTOMATON_BYTES, 40])
def test_against_search(spark, monkeypatch, most, automaton):
    """Small alphabets make values end, cross and fill units; both ways of the values to the units, and several automata a file."""
    monkeypatch.setattr(sought, "AUTOMATON_BYTES", automaton)
    draw = random.Random(automaton + most)
    word = lambda signs, most: "".join(draw.choices(signs, k=draw.randrange(most)))
    values, units = [], []
    for f in map(str, range(25)):
        inside = draw.choice(["", "in.zip"])
        numbers = draw.sample(range(1000), 9)
        units += [(f, inside, n, word("aBb\n\U0001f600" if f < "2" else "ab", 6)) for n in numbers]
        values += [(f, inside, word("ab\n\n\U0001f600" if f < "2" else "ab\n", 9)) for _ in range(30)]
    units += [("0", "", 2000, None), ("alone", "", 0, "x")]
    values += [("0", "", None), ("nobody", "", "ab"), values[0], values[0]]
    want = expected(values, units)
    got = [tuple(r) for r in sought.present(spark.createDataFrame(values, VALUES), spark.createDataFrame(units, UNITS), most).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any("\n" in v for *_, v in want) and any("\n" not in v for *_, v in want)


def test_nothing(spark):
    none, one = spark.createDataFrame([], VALUES), spark.createDataFrame([("f", "", 0, "text")], UNITS)
    assert sought.present(none, one).count() == 0
    assert sought.present(spark.createDataFrame([("f", "", "text")], VALUES), spark.createDataFrame([], UNITS)).count() == 0


def test_no_text_is_shuffled(spark):
    """Exchanges of the plan carry numbers and values, not the units' text."""
    values = spark.createDataFrame([("f", "", "in text"), ("f", "", "cut\nin two")], VALUES)
    units = spark.createDataFrame([("f", "", 0, "It lies in Text, cut"), ("f", "", 1, "in two")], UNITS)
    df = sought.present(values, units)
    assert {r.low for r in df.collect()} == {"in text", "cut\nin two"}

    def exchanges(node):
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            below = [node.initialPlan()]
        mine = [[a.name() for a in (node.output().apply(i) for i in range(node.output().size()))]] if node.nodeName() == "Exchange" else []
        return mine + [x for c in below for x in exchanges(c)]

    shuffled = exchanges(df._jdf.queryExecution().executedPlan())
    assert shuffled and not any("text" in columns for columns in shuffled)
