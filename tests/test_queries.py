"""Every query of the engine at the smallest size, against its SQL twin where there is one."""

import pytest

from locuspark.plans import registry
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    f, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql:
        assert difference(spark, con, SF, name, f, sql) is None
    else:
        assert f(spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nonredundant_over_the_whole_table(spark):
    """E7 has no SQL twin: every interval has a verdict, and it is that of the rule, one interval after the other."""
    from locuspark.plans.base import iv

    want = []
    for key in {r.seq for r in iv(spark, SF).select("seq").distinct().collect()}:
        kept = []
        for i, s, e in sorted((r.id, r.sta, r.end) for r in iv(spark, SF).where(f"seq = {key}").collect()):
            ratio, record, gone = 0, True, []
            for a, b in sorted(kept):
                if s > b or e < a or s > e:
                    continue
                size = b - a + 1
                if a <= s and b <= e:  # shares its left part: loses it, though it may hold the kept one from its start on
                    ratio, s = (b - s + 1) / size, b + 1
                elif a <= s:  # inside
                    ratio, record = (e - s + 1) / size, False
                elif e <= b:  # shares its right part
                    ratio, e = (e - a + 1) / size, a - 1
                else:  # holds
                    ratio = (e - s + 1) / size
                    gone.append((a, b))
                if ratio > 0.8:
                    break
            kept = [k for k in kept if k not in gone] + ([(s, e)] if record and s <= e else [])
            want.append((key, i, ratio <= 0.8))
    got = registry.queries()["E7_nonredundant"](spark, SF).collect()
    assert len(got) == len(want) == iv(spark, SF).count()
    assert sorted(map(tuple, got)) == sorted(want)
    assert registry.queries()["E7_target_coverage"](spark, SF).count() > 0
