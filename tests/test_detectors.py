"""The registry: what is read, and how often glyphs move; joins of boxes against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from underlay.operators import geometry as G
from underlay.operators import page_join as J
from underlay.plans import detectors as D
from underlay.plans.scan import findings_of
from underlay.sources.records import SCHEMAS

from .test_geometry import bar, glyphs


class Tables(dict):
    """Record tables that remember who was asked for."""

    def __init__(self, spark, **rows):
        super().__init__({name: spark.createDataFrame(rows.get(name, []), ddl) for name, ddl in SCHEMAS.items()})
        self.asked = []

    def __getitem__(self, name):
        self.asked.append(name)
        return super().__getitem__(name)

    def laid(self):
        self.asked.append("laid")
        return G.lay(super().__getitem__("glyphs"), super().__getitem__("shapes"))


def test_only_the_chosen_detectors_tables_are_read(spark):
    r = Tables(spark, units=[("f", "", 0, None, "a​b")])
    assert [x.detector for x in findings_of(r, only=["zero-width"]).collect()] == ["zero-width"] and r.asked == ["units"]
    r = Tables(spark)
    assert findings_of(r, only=["low-contrast-text", "invisible-text"]).count() == 0 and r.asked == ["laid"]
    r = Tables(spark)
    findings_of(r)
    assert len(r.asked) == len(set(r.asked)) and "glyphs" not in r.asked and {"laid", "units", "cells", "meta_fields"} <= set(r.asked)


def test_choosing(spark):
    assert [d.name for d in D.chosen(["comment", "comment"])] == ["comment"]
    assert not D.chosen(["unrendered-text"]) and [d.name for d in D.chosen(["unrendered-text"], ["ocr"])] == ["unrendered-text"]
    assert {d.name for d in D.REGISTRY.values()} - {d.name for d in D.chosen()} == {"unrendered-text", "unextractable-text", "unseen-words"}
    with pytest.raises(ValueError, match="no detector nonsense"):
        D.chosen(["nonsense"])
    with pytest.raises(ValueError, match="already"):
        D.register("comment", lambda: None)


def test_a_detector_can_be_added(spark):
    D.register("long-unit", lambda units: units.where("length(text) > 3").selectExpr("file_id", "'long-unit' AS detector"), "units")
    try:
        r = Tables(spark, units=[("f", "", 0, None, "abcd"), ("g", "", 0, None, "a")])
        assert [tuple(x) for x in findings_of(r, only=["long-unit"]).collect()] == [("f", "long-unit")]
    finally:
        del D.REGISTRY["long-unit"]


def _paths(node, above=()):
    kids = node.children()
    name = node.nodeName()
    if not kids.size():
        yield (*above, name, node.simpleString(200))
    for i in range(kids.size()):
        yield from _paths(kids.apply(i), (*above, name))


def test_glyphs_are_exchanged_once(spark, tmp_path):
    """By the plan: between the stored layout and any exchange above it rows have been aggregated, or swept to the ones found."""
    page = spark.createDataFrame([("f", "", 1, 0.0, 0.0, 600.0, 800.0)], SCHEMAS["pages"])
    g = spark.createDataFrame([*glyphs("the secret word"), *glyphs("hidden", mode=3, y=200, start=40)], SCHEMAS["glyphs"])
    s = spark.createDataFrame([bar(38, 102)], SCHEMAS["shapes"])
    assert G.lay(g, s)._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    stored = G.stored_layout(g, s, f"file://{tmp_path}/laid", 4)
    # Named apart from the plain table of glyphs: readings of a page are the one table here that is not the layout.
    ocr = spark.createDataFrame([("f", "", 1, 0, "x", 0.0, 100.0, 10.0, 110.0, 90.0)], "file_id string, inside string, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, conf double")
    outside, conf = {"ocr": ocr}, {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        names = [d.name for d in D.REGISTRY.values() if "laid" in d.inputs]
        assert len(names) == 7
        found = D.found(D.chosen(names, outside), {"laid": stored.table(), "pages": page}.__getitem__, outside)
        scans = [p for p in _paths(found._jdf.queryExecution().executedPlan()) if stored.name in p[-1]]
        assert len(scans) >= 7
        for path in scans:
            up = [x for x in reversed(path[:-2])]
            first = next((i for i, x in enumerate(up) if x == "Exchange"), len(up))
            assert any(x.endswith("Aggregate") or x == "MapInArrow" for x in up[:first]), path
        assert {(r.detector, r.machine_reads) for r in found.collect()} == {("covered-text", "secret"), ("invisible-text", "hidden"), ("unrendered-text", "the secret word")}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
        stored.drop()


def boxes(rows, **columns):
    """rows: page, x0, y0, x1, y1"""
    a = np.array(rows, float).reshape(-1, 5)
    order = np.argsort(a[:, 0], kind="stable")
    a = a[order]
    return J.Boxes(a[:, 0].astype(int), *a[:, 1:].T, pa.table({k: np.array(v)[order] for k, v in columns.items()}))


def made(rng, n, pages, wild):
    out = []
    for _ in range(n):
        x, y = rng.choice([rng.uniform(-20, 200), rng.choice([-1e12, 1e9, 0.0])] if wild else [rng.uniform(0, 100)]), rng.uniform(0, 100)
        w, h = rng.choice([0, 5, 10, 60, 1e12 if wild else 40]), rng.choice([0, 8, 30])
        out.append((rng.randrange(pages), x, y, x + w, y + h))
    return out


@pytest.mark.parametrize(("n", "m", "pages", "wild"), [(0, 5, 1, False), (40, 0, 2, False), (300, 60, 7, True), (1500, 300, 1, False), (700, 900, 40, True)])
def test_joins_of_boxes_against_all_pairs(n, m, pages, wild):
    rng = random.Random(n + m)
    g, s = made(rng, n, pages, wild), made(rng, m, pages, wild)
    a = boxes(g, ord=[rng.randrange(50) for _ in g])
    b = boxes(s, s_ord=[rng.randrange(50) for _ in s], shape_no=list(range(len(s))))
    box = lambda t, i: (t.x0[i], t.y0[i], t.x1[i], t.y1[i])
    area = lambda p: max(p[2] - p[0], 0) * max(p[3] - p[1], 0)
    cut = lambda p, q: (max(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), min(p[3], q[3]))
    for share in (0.55, 0.1):
        touch, later, top = set(), set(), []
        for i in range(n):
            p, best = box(a, i), None
            for j in range(m):
                if a.page[i] != b.page[j]:
                    continue
                q = box(b, j)
                c = cut(p, q)
                if c[2] > c[0] and c[3] > c[1]:
                    touch.add((i, j))
                over = (q[0] <= p[0] <= q[2] and q[1] <= p[1] <= q[3]) if area(p) <= 0 else area(c) >= area(p) * share
                if over and a.column("ord")[i] <= b.column("s_ord")[j]:
                    later.add((i, j))
                if b.column("s_ord")[j] < a.column("ord")[i] and area(c) >= area(p) * share:
                    rank = (b.column("s_ord")[j], -b.column("shape_no")[j])
                    best = max(best, (rank, j)) if best else (rank, j)
            top.append(best[1] if best else -1)
        assert set(zip(*(x.tolist() for x in J.pairs(J.touching)(a, b)))) == touch
        assert set(zip(*(x.tolist() for x in J.pairs(J.covered_later(share))(a, b)))) == later
        i, j = J.topmost(share)(a, b)
        assert i.tolist() == list(range(n)) and j.tolist() == top


def test_a_stack_of_shapes_costs_what_it_takes_to_cover(monkeypatch):
    """10,000 shapes over each other, and 100,000 glyphs drawn between them."""
    rng = np.random.default_rng(2)
    n, m = 100_000, 10_000
    x, y = rng.uniform(0, 590, n), rng.uniform(0, 790, n)
    a = J.Boxes(np.zeros(n, int), x, y, x + 5, y + 10, pa.table({"ord": rng.integers(0, m, n) * 2 + 1}))
    left = rng.uniform(-50, 0, m)
    b = J.Boxes(np.zeros(m, int), left, left, left + 700, left + 900, pa.table({"s_ord": np.arange(m) * 2, "shape_no": np.arange(m)}))
    cells, plain = [0], J._overlap

    def counted(p, i, q, j):
        cells[0] += len(i) * len(j)
        return plain(p, i, q, j)

    monkeypatch.setattr(J, "_overlap", counted)
    _, j = J.topmost(0.55)(a, b)
    assert (j == (a.column("ord") - 1) // 2).all() and cells[0] <= 2 * n * J.CHUNK


def test_whole_pages_whatever_the_batches():
    rows = [("f", "", p, i) for p in (1, 1, 1, 2, 3, 3, 3, 3, 4) for i in (0, 1)] + [("g", "", 4, 0), ("g", "x", 4, 0), ("g", "x", 4, 1)]
    table = pa.table({c: [r[k] for r in rows] for k, c in enumerate(["file_id", "inside", "page", "i"])})
    for size in (1, 2, 3, 5, 100):
        batches = [b for lo in range(0, len(rows), size) for b in table.slice(lo, size).combine_chunks().to_batches()]
        parts = list(J._whole_pages(iter([batches[0].slice(0, 0), *batches])))
        assert pa.concat_tables(parts).to_pylist() == table.to_pylist()
        seen = [{(r["file_id"], r["inside"], r["page"]) for r in p.to_pylist()} for p in parts]
        assert sum(map(len, seen)) == len(set().union(*seen))
