"""Refusals of labels, the order of passes, rewrites to a fixpoint, sources with errors, and independence of order."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corroba.operators import renaming, reports
from corroba.rules import labels
from corroba.sources import mapping, text

SCHEMA = "item int, attribute string, rule string, seq int, value string, candidates array<string>"


@pytest.mark.parametrize(
    ("row", "fault"),
    [
        ((1, "Body", "no/such", 0, None, None), "not in the registry"),
        ((1, "Body", "r8/kept-name", 0, None, None), "does not declare"),
        ((1, "ClassName", "core/structural-tie", 0, None, None), "has to give candidates"),
        ((1, "ClassName", "core/structural-tie", 0, None, []), "has to give candidates"),
        ((1, "ClassName", "r8/kept-name", 0, None, ["a"]), "only N rules"),
    ],
)
def test_bad_applications_are_errors(spark, row, fault):
    with pytest.raises(Exception, match=fault):
        labels.labels(spark.createDataFrame([row], SCHEMA)).collect()


def test_two_values_are_an_error_and_labels_compose(spark):
    rows = [(1, "MemberName", "r8/kept-name", 0, "x", None), (1, "MemberName", "r8/sigdb-method-name", 1, None, None)]
    assert [(r["class"], r.value, r.rules) for r in labels.labels(spark.createDataFrame(rows, SCHEMA)).collect()] == [("D", "x", ["r8/kept-name", "r8/sigdb-method-name"])]
    with pytest.raises(Exception, match="two values"):
        labels.labels(spark.createDataFrame([*rows, (1, "MemberName", "core/structural-name", 2, "y", None)], SCHEMA)).collect()


def test_registry_and_schedule(spark):
    assert len(labels.RULES) == 26 and list(labels.RULES) == sorted(labels.RULES)
    assert all(c in labels.CLASSES and a and set(a) <= set(labels.ATTRIBUTES) for c, a in labels.RULES.values())
    one = lambda rule: lambda tables, found: labels.applied(tables["t"], "item", "MemberName", rule)
    passes = [labels.Pass("b", "compose", one("compose/lib-key")), labels.Pass("z", "r8", one("r8/kept-name")), labels.Pass("a", "r8", one("r8/library-override-name"))]
    out = labels.run_passes(passes, {"t": spark.createDataFrame([(1,)], "item int")})
    assert [r.rule for r in out.orderBy("seq").collect()] == ["r8/library-override-name", "r8/kept-name", "compose/lib-key"]


def test_rewrites_stop_when_nothing_changes(spark):
    def halve(df):
        odd = df.where("n > 1")
        return df.withColumn("n", F.greatest(F.floor(F.col("n") / 2), F.lit(1))), odd.select(F.lit("halve").alias("rule"), F.col("item"), F.col("n").cast("string").alias("detail"))

    state, records = renaming.rewrite_rounds(spark.createDataFrame([(1, 4), (2, 1), (3, 100)], "item int, n long"), halve, [F.sum("n")])
    assert {r.item: r.n for r in state.collect()} == {1: 1, 2: 1, 3: 6}
    assert {r.item: (r.detail, r.round) for r in records.collect()} == {1: ("2", 1), 3: ("12", 3)}


def lines(spark, content):
    return spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(content.split("\n"))], "file string, line long, text string")


@pytest.mark.parametrize(
    ("content", "fault"),
    [
        ("a.B -> c", "line 1: class line must end"),
        ("a.B c:", "line 1: class line missing"),
        ("    int x -> y", "line 1: member line before any class"),
        ("a.B -> c:\n    int x", "line 2: member line missing"),
        ("a.B -> c:\n    5:1:void x() -> y", "line 2: minified range 5:1 is backwards"),
        ("a.B -> c:\n    1:2:int x -> y", "line 2: field mapping with a line range"),
    ],
)
def test_mapping_errors_have_line_numbers(spark, content, fault):
    with pytest.raises(Exception, match=fault):
        mapping.strict(mapping.read_mapping(lines(spark, content))).collect()


def test_mapping_prints_what_it_read(spark):
    content = "# compiler: x\n# {\"id\":\"m\"}\na.B -> c:\n# {\"id\":\"sourceFile\",\"fileName\":\"B.java\"}\n    int x -> y\n      # {\"id\":\"z\"}\n    1:2:void a.Q.run(int,a.B[]):7:8 -> r\n    1:2:a.B lone():9 -> r\nd.E -> f:\n    long[] p -> q"
    again = mapping.print_mapping(mapping.read_mapping(lines(spark, content))).orderBy("line").collect()
    assert "\n".join(r.text for r in again) == content
    stack = mapping.retrace(mapping.read_mapping(lines(spark, content)), spark.createDataFrame([("f", "c", "r", 2)], "file string, class string, obfuscated string, residual long"))
    assert [(r.depth, r.class_name, r.method, r.original) for r in stack.orderBy("depth").collect()] == [(0, "a.Q", "run", 8), (1, "a.B", "lone", 9)]


def test_packages(spark, tmp_path):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for name, body in (("META-INF/lib.version", "1.2.3"), ("META-INF/a/b.version", "9"), ("base/root/app.properties", "k=v"), ("x.proto", "message M { int32 a = 1; }"), ("big.properties", "x" * 5000)):
            z.writestr(name, body)
    (tmp_path / "a.zip").write_bytes(packed.getvalue())
    (tmp_path / "b.bin").write_bytes(b"no archive")
    files = text.load_packages(spark, str(tmp_path))
    got = {r.name: r.text for r in text.resources(text.members(files)).collect()}
    assert got == {"META-INF/lib.version": "1.2.3", "app.properties": "k=v", "x.proto": "message M { int32 a = 1; }"}
    with pytest.raises(Exception, match="defined twice"):
        text.one_definition(spark.createDataFrame([("A",), ("A",)], "class string"), "class").collect()


def test_settings_refuse_unknown_and_repeated_keys(spark):
    with pytest.raises(Exception, match="unknown key odd in line 2"):
        text.settings(lines(spark, "a = 1\nodd = 2"), "file", "line", "text", ["a"], []).collect()
    with pytest.raises(Exception, match="two values for a"):
        text.settings(lines(spark, "a = 1\na = 2"), "file", "line", "text", ["a"], []).collect()


@pytest.mark.parametrize("most", [10, 17, 100])
def test_files_are_few_contiguous_and_fit(spark, most):
    sizes = {i: 1 + i * 7 % 10 for i in range(40)}
    files = {r.key: r.file for r in reports.multi_file(spark.createDataFrame(list(sizes.items()), "key int, size long"), "key", "size", most).collect()}
    assert [files[i] for i in range(40)] == sorted(files.values())
    assert max(sum(sizes[i] for i in files if files[i] == f) for f in set(files.values())) <= most
    with pytest.raises(ValueError, match="is over"):
        reports.multi_file(spark.createDataFrame([(1, 50)], "key int, size long"), "key", "size", 10)


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_order_or_names(spark, parts):
    """The same graph under other node names and partitions: refinement gives the same labels, names follow the digests."""
    from corroba.operators import graphs

    edges = [(i, (i * 7 + 3) % 30) for i in range(30)] + [(i, i // 3) for i in range(30)]
    out = []
    for rename in (lambda x: x, lambda x: 1000 - 3 * x):
        e = spark.createDataFrame([(rename(a), rename(b)) for a, b in edges], "src int, dst int").distinct().repartition(parts)
        nodes = spark.createDataFrame([(rename(i),) for i in range(30)], "node int")
        found = {r.node: r.label for r in graphs.refine(nodes, e, 4, F.lit("n")).collect()}
        out.append([found[rename(i)] for i in range(30)])
    assert out[0] == out[1]
