"""The longest registered prefix, by the map-side joins and by the shuffle."""

import random

import pytest

from lakeshore.operators import ops


@pytest.fixture(scope="module")
def case(spark):
    rnd = random.Random(4)
    word = lambda n: "/" + "".join(rnd.choice("ab/") for _ in range(n))
    prefixes = sorted({word(rnd.randint(0, 6)) for _ in range(60)})
    table = [(p, f"app{i}") for i, p in enumerate(prefixes)]
    paths = [(i, word(rnd.randint(0, 9))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "zzz"), (1003, prefixes[-1])]
    rows = table + [(table[0][0], "zz"), (None, "none")]       # a repeated prefix: the smaller app; a null one: ignored
    want = {i: max(((len(p), a) for p, a in table if path is not None and path.startswith(p)), default=(0, "unknown"))[1]
            for i, path in paths}
    return (spark.createDataFrame(paths, "id long, path string").repartition(3),
            spark.createDataFrame(rows, "prefix string, app string"), want)


@pytest.mark.parametrize("bound", [ops.BROADCAST_PREFIXES, 0])
def test_longest_prefix(case, monkeypatch, bound):
    paths, prefixes, want = case
    monkeypatch.setattr(ops, "BROADCAST_PREFIXES", bound)
    out = ops.longest_prefix(paths, prefixes)
    assert out.columns == ["id", "path", "app"]
    assert {r.id: r.app for r in out.collect()} == want


def test_paths_stay_where_they_are(case, spark, tmp_path):
    paths, prefixes, _ = case
    paths.write.parquet(f"{tmp_path}/p")
    out = ops.longest_prefix(spark.read.parquet(f"{tmp_path}/p"), prefixes)
    plan = out._jdf.queryExecution().executedPlan().toString()
    probe = plan[plan.index("BroadcastHashJoin"):]
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    # The only shuffles are below the broadcasts of the prefix table.
    assert all("prefix" in line for line in probe.splitlines() if "Exchange hashpartitioning" in line)


def test_no_prefixes(spark, case):
    paths, prefixes, want = case
    got = ops.longest_prefix(paths, prefixes.limit(0)).collect()
    assert len(got) == len(want) and {r.app for r in got} == {"unknown"}
