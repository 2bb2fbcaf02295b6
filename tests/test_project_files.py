"""Project files with properties by element name, a name space, one artifact of two groups, and a dependency without a group."""

from corroba.sources import text

FILE = """<?xml version="1.0"?><project xmlns="http://maven.apache.org/POM/4.0.0"><groupId>g</groupId><artifactId>m</artifactId><version>1</version><!-- <dependencies/> -->
<properties><a.version>5</a.version><b.version>6</b.version></properties>
<dependencyManagement><dependencies><dependency><groupId>x</groupId><artifactId>n</artifactId><version>7</version></dependency><dependency><groupId>y</groupId><artifactId>n</artifactId><version>${b.version}</version></dependency></dependencies></dependencyManagement>
<dependencies><dependency><artifactId>alone</artifactId><version> 3 </version></dependency><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${a.version}</version></dependency>
<dependency><groupId>x</groupId><artifactId>n</artifactId></dependency><dependency><groupId>y</groupId><artifactId>n</artifactId></dependency>
<dependency><groupId>t</groupId><artifactId>a</artifactId><version>4</version><scope>test</scope></dependency><dependency><groupId>o</groupId><artifactId>p</artifactId><version>1</version><optional>true</optional></dependency></dependencies></project>"""


def test_every_dependency_is_read_on_its_own(spark):
    files = spark.createDataFrame([(FILE,), (None,), ("",), ("<project/>",), ("<other/>",)], "xml string")
    found = [("g", "m", "1", None, "alone", "3"), ("g", "m", "1", "g", "a", "5"), ("g", "m", "1", "x", "n", "7"), ("g", "m", "1", "y", "n", "6")]
    assert sorted(map(tuple, text.pom_requests(files).collect()), key=repr) == sorted(found, key=repr)


def test_a_file_is_parsed_once(spark, monkeypatch):
    calls, parse = [], text.ElementTree.fromstring
    monkeypatch.setattr(text.ElementTree, "fromstring", lambda x: calls.append(x) or parse(x))
    assert len(text.project_requests(FILE)) == 4 and len(calls) == 1
