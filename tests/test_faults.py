"""Cases that went wrong before: missing corners, non-finite boxes, NULL values, long gaps, workers without the package."""

import os
import subprocess
import sys

import numpy as np
import pytest

from freshet.operators import reduce, spatial, windows
from freshet.session import cut_lineage, job_scope


def test_a_cell_with_a_missing_corner_is_at_ground(spark):
    lf = spark.createDataFrame(
        [("a", 0, c, 10.0) for c in (1, 2, 3)] + [("a", 1, 1, 10.0), ("a", 1, 2, 10.0), ("a", 2, 1, 10.0), ("a", 2, 2, 10.0), ("a", 2, 3, float("nan"))],
        "run string, t int, cell_id int, value double",
    )
    weights = spark.createDataFrame([(7, c, 1 / 3) for c in (1, 2, 3)], "cell_id int, lf_cell_id int, w double")
    cells = spark.createDataFrame([(7, 4.0), (8, 5.0)], "cell_id int, elevation double")
    got = {(r["t"], r["cell_id"]): r["value"] for r in spatial.interpolate_surface(lf, weights, cells).collect()}
    assert got == {(0, 7): pytest.approx(10.0), (1, 7): 4.0, (2, 7): 4.0, (0, 8): 5.0, (1, 8): 5.0, (2, 8): 5.0}


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_nearest_refuses_boxes_without_a_place(spark, bad):
    boxes = "id int, x0 double, y0 double, x1 double, y1 double"
    left = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, bad, 0.0, 1.0, 1.0)], boxes.replace("id", "cell_id"))
    right = spark.createDataFrame([(5, 9.0, 9.0, 10.0, 10.0)], boxes.replace("id", "near_id"))
    with pytest.raises(ValueError, match="finite"):
        spatial.nearest(left, right)
    with pytest.raises(ValueError, match="finite"):
        spatial.nearest(right.withColumnRenamed("near_id", "cell_id"), left.withColumnRenamed("cell_id", "near_id"))


@pytest.mark.parametrize("method", ["primal", "dual"])
def test_null_values_count_as_absent(spark, method):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 4))
    x[3, 1] = x[5] = 0.0
    rows = [(i, j, None if x[i, j] == 0 and j % 2 else float("nan") if x[i, j] == 0 else float(x[i, j])) for i in range(12) for j in range(4)]
    df = spark.createDataFrame(rows, "t int, cell_id int, value double")
    got = [r["eigenvalue"] for r in reduce.principal_modes(df, ["t"], "cell_id", "value", method=method).eigen.orderBy("mode").collect()]
    want = np.sort(np.linalg.eigvalsh(np.cov(x, rowvar=False)))[::-1]
    np.testing.assert_allclose(got[:4], want, atol=1e-9)


def test_antecedent_index_over_many_chunks(spark):
    rng = np.random.default_rng(3)
    rain = np.where(rng.random(900) < 0.1, rng.random(900) * 1e12, 0.0)
    rain[40:] = 0.0
    df = spark.createDataFrame([("a", int(t), float(v)) for t, v in enumerate(rain)], "run string, t int, rain double")
    want, state = [], 0.0
    for v in rain:
        state = v + 0.9 * state
        want.append(state)
    got = [r["api"] for r in windows.api(df, 0.9, width=16).orderBy("t").collect()]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_tables_of_a_job_go_with_it(spark):
    with job_scope(spark):
        kept = cut_lineage(spark.range(5))
        path = kept.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_workers_get_the_package_from_another_directory(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from freshet.session import local_session\n"
        "from freshet.operators import spatial\n"
        "s = local_session(2, 2, '1g')\n"
        "from freshet.operators import gram\n"
        "import numpy as np\n"
        "rows = s.createDataFrame([([0, 1], [1.0, 2.0])], 'idx array<int>, val array<double>')\n"
        "print(gram.second_moments(rows, 2)[0].tolist())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.stdout.strip().endswith("[[1.0, 2.0], [2.0, 4.0]]"), done.stderr[-2000:]
