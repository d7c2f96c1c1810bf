"""Cases of the third round's findings that the tables of sf0.01 don't have."""

from folioscope.plans import catalogue
from tests.test_findings_r02 import line, lines, oracle  # noqa: F401


def test_panel_columns_of_boxes_without_a_page(spark, lines):  # noqa: F811
    """Texts without a page number have columns, and boxes without one widen none of them."""
    sf = lines([line(k, i, part) for k in (None, 1) for i, part in enumerate([1, 20, 32], 1)])
    got = sorted(map(tuple, catalogue.QUERIES["panel_columns"](spark, sf).collect()), key=str)
    assert got == sorted(oracle(sf, "panel_columns"), key=str)
    assert [r[2:4] for r in got if r[0] is None] == [(2.5, 11.5), (50.0, 59.0), (80.0, 89.0)] and len(got) > 3
