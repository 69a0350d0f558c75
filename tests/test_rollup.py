"""Trees compared by folder digests against the comparison of all files."""

import random

from plumewatch.operators import rollup
from plumewatch.operators.snapshots import tree_differences


def _both(spark, a, b):
    a, b = (spark.createDataFrame(list(t), "path string, hash string").repartition(3) for t in (a, b))
    rolled = [rollup.roll_up(t) for t in (a, b)]
    compared = rollup.compared_folders(*rolled)
    want = sorted(map(tuple, tree_differences(a, b).collect()), key=str)
    assert sorted(map(tuple, rollup.folder_differences(a, b, *rolled).collect()), key=str) == want
    return want, compared.count(), rollup.opened_files(a, compared).count()


def _tree(folders, files):
    return {f"m{i % 7}/s{i}/f{k}.py": f"h{i}-{k}" for i in range(folders) for k in range(files)}


def test_work_grows_with_the_difference(spark):
    """One edited, one missing and one extra file: as many rows are compared in a tree ten times as large."""
    seen = []
    for folders in (70, 700):
        a = _tree(folders, 6)
        b = dict(a)
        b["m3/s3/f1.py"], b["m3/s3/new/x.py"] = "edited", "n"
        del b["m5/s5/f0.py"]
        want, looked, files = _both(spark, a.items(), b.items())
        assert want == [("m3/s3/f1.py", "distinto"), ("m3/s3/new/x.py", "sobra"), ("m5/s5/f0.py", "falta")]
        # root, its children, those of two modules, and one new folder
        assert looked == 1 + 7 + 2 * folders // 7 + 1 and files == 12
        seen.append(files)
    assert seen[0] == seen[1]
    assert _both(spark, a.items(), a.items()) == ([], 1, 0)


def test_awkward_trees_equal_the_plain_comparison(spark):
    rnd = random.Random(3)
    names = ["a", "b", "", "a b", "ñ", "a.b", "c"]
    for _ in range(3):
        paths = ["/".join(rnd.choices(names, k=rnd.randrange(1, 6))) for _ in range(60)] + [None, "", "/", "a/"]
        trees = [[(p, rnd.choice(["1", "1", "1", "2", None])) for p in paths if rnd.random() < 0.9] for _ in (0, 1)]
        _both(spark, trees[0] + trees[0][:9], trees[1])
    _both(spark, [], [("a/b/c", "1")])
    _both(spark, [("a/b/c", "1"), ("a/b", "2")], [])
    assert _both(spark, [], []) == ([], 0, 0)


def test_moved_content_is_seen(spark):
    """The same hashes under other names, and a folder that became a file."""
    want, _, _ = _both(spark, [("x/a", "1"), ("x/b", "2"), ("y/z", "3")], [("x/a", "2"), ("x/b", "1"), ("y", "3")])
    assert want == [("x/a", "distinto"), ("x/b", "distinto"), ("y", "sobra"), ("y/z", "falta")]
