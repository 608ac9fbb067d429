"""The source tree reader, and table functions."""

import pytest

from weftgraph.functions import tables
from weftgraph.sources import tree


@pytest.fixture
def root(tmp_path):
    files = {
        ".gitignore": "*.log\n!keep.log\n/only_top.txt\nbuilt/\n# note\ndocs/**/draft.md\n[ab].tmp\n", "a.py": "print(1)\n", "x.log": "no", "keep.log": "yes", "only_top.txt": "no", "sub/only_top.txt": "yes",
        "built/out.js": "no", "sub/built/out.js": "no", "sub/.ignore": "own?.txt\n", "sub/own1.txt": "no", "sub/own12.txt": "yes", "own1.txt": "yes", "docs/x/y/draft.md": "no", "docs/draft.md": "no", "draft.md": "yes",
        "a.tmp": "no", "c.tmp": "yes", "node_modules/m.js": "no", "big.bin": "b" * 5000, "empty": "", "sub/ünï.txt": "yes",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (tmp_path / "odd").write_bytes(b"\xff\xfea")
    return tmp_path


def test_source_tree(spark, root):
    tree.register(spark)
    for path in (str(root), f"file://{root}"):
        df = spark.read.format("source_tree").option("maxBytes", 4000).option("budget", 20).load(path)
        got = {r.filePath: (r.size, r.content) for r in df.collect()}
        assert set(got) == {".gitignore", "a.py", "keep.log", "sub/only_top.txt", "sub/.ignore", "sub/own12.txt", "own1.txt", "draft.md", "c.tmp", "empty", "sub/ünï.txt", "odd"}
        assert got["a.py"] == (9, "print(1)\n") and got["empty"] == (0, "") and got["odd"] == (3, "��a")
        assert df.rdd.getNumPartitions() == len(tree.packed(tree.listed(path, 4000), 20)) > 3


def test_batches_keep_the_budget():
    files = [("a", 5), ("b", 6), ("c", 30), ("d", 1), ("e", 9), ("f", 1)]
    assert tree.packed(files, 10) == [["a"], ["b"], ["c"], ["d", "e"], ["f"]] and tree.packed([], 10) == []


def test_empty_tree(spark, tmp_path):
    tree.register(spark)
    assert spark.read.format("source_tree").load(str(tmp_path)).count() == 0


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "id int, t string").createOrReplaceTempView("texts")
    got = [tuple(r) for r in spark.sql("select id, c.* from texts, lateral weft_chunks(t, 4, 1) c order by id, chunk").collect()]
    assert got == [(1, 0, 0, 4), (1, 1, 3, 7), (1, 2, 6, 10), (2, 0, 0, 0)]
    assert [tuple(r) for r in spark.sql("select position, word from weft_words(' a  bc ')").collect()] == [(0, "a"), (1, "bc")]
    with pytest.raises(Exception, match="overlap"):
        spark.sql("select * from weft_chunks('abc', 2, 2)").collect()
    spark.createDataFrame([("x", 1.0), ("x", 5.0), ("x", None), ("y", 2.0), ("x", 20.0)], "k string, v double").createOrReplaceTempView("points")
    got = sorted(tuple(r) for r in spark.sql("select k, v, rank from weft_top(table(points) partition by k order by (v desc), 2)").collect())
    assert got == [("x", 5.0, 2), ("x", 20.0, 1), ("y", 2.0, 1)]
    got = {(r.k, r.v): r.session for r in spark.sql("select * from weft_sessions(table(points) partition by k order by (v), 'v', 10d)").collect()}
    assert got == {("x", None): 0, ("x", 1.0): 0, ("x", 5.0): 0, ("x", 20.0): 1, ("y", 2.0): 0}
