import pytest

from chronoscope.sources import text_formats as TX


def rows(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.noun_id, r.target), {}).setdefault(r.feature, {})[r.t] = r.x
    return {k: {f: [v[t] for t in range(len(v))] for f, v in fs.items()} for k, fs in out.items()}


ARFF = """% a comment
@relation 'odd name'

@ATTRIBUTE bag relational
  @attribute att0 numeric
  @attribute att1 numeric
@end bag
@attribute class {walking, 'stand still', "it's", 4}

@data
% one more
'1.0,?,3\\n4,5,NaN',walking
"1e3, -2 \\n.5", 'stand still'
 '7\\n8' , "it's"
'9\\n10',4
"""


def test_arff_of_another_writer(spark, tmp_path):
    (tmp_path / "a.arff").write_text(ARFF)
    assert TX.arff_header(spark, str(tmp_path)).labels == ("walking", "stand still", "it's", "4")
    assert rows(TX.read_arff_relational(spark, str(tmp_path))) == {
        (0, "walking"): {0: [1, 0, 3], 1: [4, 5, 0]}, (1, "stand still"): {0: [1000, -2], 1: [0.5]}, (2, "it's"): {0: [7], 1: [8]}, (3, "4"): {0: [9], 1: [10]}}


def test_undeclared_labels_and_broken_lines_are_errors(spark, tmp_path):
    for name, line in (("label", "'1\\n2',running"), ("line", "1,2,walking")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.arff").write_text(ARFF + line + "\n")
        with pytest.raises(Exception, match="not declared|not a relational line"):
            TX.read_arff_relational(spark, str(tmp_path / name)).collect()
    (tmp_path / "two").mkdir()
    for k in ("a", "b"):
        (tmp_path / "two" / k).write_text(f"@attribute c {{x, {k}}}\n@data\n'1',x\n")
    with pytest.raises(ValueError, match="several declarations"):
        TX.read_arff_relational(spark, str(tmp_path / "two"))


TS = """#comment
@problemName Odd
@timeStamps false
@univariate false
@equalLength false
@classLabel true a b:c x
@data
1,2,3:4,?,6:a
7:8,NaN:x
"""


def test_ts_of_another_writer(spark, tmp_path):
    (tmp_path / "a.ts").write_text(TS)
    assert rows(TX.read_ts(spark, str(tmp_path))) == {(0, "a"): {0: [1, 2, 3], 1: [4, 0, 6]}, (1, "x"): {0: [7], 1: [8, 0]}}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.ts").write_text("@timestamps true\n@classLabel true y\n@data\n(0,1.5),(2,?):(2000-01-01 10:00:00,3):y\n")
    assert rows(TX.read_ts(spark, str(tmp_path / "b"))) == {(0, "y"): {0: [1.5, 0], 1: [3]}}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.ts").write_text("@classLabel true y\n@data\n1:z\n")
    with pytest.raises(Exception, match="not declared"):
        TX.read_ts(spark, str(tmp_path / "c")).collect()


def test_positions_over_blocks_and_files(spark, tmp_path):
    """Many blocks per file, headers and comments in between: positions follow path and line."""
    for f in range(3):
        lines = ["@data"] + [x for i in range(400) for x in (["% c"] if i % 7 == 0 else []) + [f"'{1000 * f + i}',l"]]
        (tmp_path / f"part-{f}.arff").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        got = TX.read_arff_relational(spark, str(tmp_path)).select("noun_id", "x").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.noun_id: r.x for r in got} == {400 * f + i: 1000.0 * f + i for f in range(3) for i in range(400)}
