"""Text sources: package files, markers, message definitions, configurations, module metadata, sectioned tables, dumps; and checks of stored databases."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corroba.sources.mapping import lenient

#: The greatest size of a small resource and of a message definition.
SMALL, DEFINITION = 4096, 512 * 1024


def input_order(name: Column) -> Column:
    """Sort key of program files: N of ``classesN.dex`` (1 without a number), others last, then the name."""
    n = F.regexp_extract(name, r"^(?:.*/)?classes([0-9]*)\.dex$", 1)
    return F.struct(F.when(~name.rlike(r"^(?:.*/)?classes[0-9]*\.dex$"), F.lit(1 << 40)).when(n == "", F.lit(1)).otherwise(n.try_cast("long")).cast("long").alias("n"), name.alias("name"))


def root_name(name: Column) -> Column:
    return F.regexp_replace(name, "^base/root/", "")


def is_resource(name: Column, size: Column) -> Column:
    """Small version files and root properties, and message definitions."""
    small = name.rlike(r"^META-INF/[^/]*\.version$") | name.rlike(r"^[^/]*\.properties$")
    return (small & (size <= SMALL)) | (name.endswith(".proto") & (size <= DEFINITION))


def load_packages(spark, path: str, glob: str = "*") -> DataFrame:
    """(file, name, size, content) of the files below ``path``; the names are relative to it. A file is one row, so packed archives of over 2 GB have to be unpacked first."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return rows.select(F.col("path").alias("file"), root_name(F.regexp_replace("path", f"^.*?{re.escape(path.rstrip('/'))}/", "")).alias("name"), F.col("length").alias("size"), "content")


def members(archives: DataFrame, content: str = "content") -> DataFrame:
    """(file, name, size, content): the files of zip archives, one row each; rows that are no zip give nothing."""

    def run(batches):
        import io
        import zipfile

        for batch in batches:
            out = []
            for file, data in zip(batch["file"], batch["data"], strict=True):
                if data is None or not bytes(data[:2]) == b"PK":
                    continue
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    out += [(file, re.sub("^base/root/", "", i.filename), i.file_size, z.read(i)) for i in z.infolist() if not i.is_dir()]
            yield pd.DataFrame(out, columns=["file", "name", "size", "content"])

    return archives.select("file", F.col(content).alias("data")).mapInPandas(run, "file string, name string, size bigint, content binary")


def resources(files: DataFrame) -> DataFrame:
    """(file, name, text) of the resources among files (file, name, size, content) whose content is text."""
    text = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.col("content").cast("string")
    return files.where(is_resource(F.col("name"), F.col("size"))).select("file", "name", text.alias("text")).where("text is not null")


@F.pandas_udf(T.LongType())
def adler32(data: pd.Series) -> pd.Series:
    """Adler-32 of binary values."""
    return data.map(lambda x: None if x is None else zlib.adler32(x))


def integrity(files: DataFrame, checksum: str, signature: str, body: str) -> DataFrame:
    """Files with ``adler_ok`` and ``sha1_ok`` (declared values against the body's) and the SHA-256."""
    return files.select("*", (adler32(F.col(body).cast("binary")) == F.col(checksum)).alias("adler_ok"), (F.sha1(F.col(body).cast("binary")) == F.lower(F.col(signature))).alias("sha1_ok"), F.sha2(F.col(body).cast("binary"), 256).alias("sha256"))


def one_definition(classes: DataFrame, key: str) -> DataFrame:
    """The classes of a program; an error where inputs define one twice."""
    n = F.count("*").over(Window.partitionBy(key))
    clash = F.raise_error(F.concat(F.lit("defined twice: "), F.col(key).cast("string"))).cast(classes.schema[key].dataType)
    return classes.withColumn("__n", n).withColumn(key, F.when(F.col("__n") > 1, clash).otherwise(F.col(key))).drop("__n")


def markers(strings: DataFrame, column: str) -> DataFrame:
    """(tool, json, version, min_api, mode, map_id): the distinct ``~~Tool{json}`` strings whose JSON is an object."""
    c = F.col(column)
    found = strings.where(c.startswith("~~")).select(F.regexp_extract(c, r"^~~([0-9a-zA-Z]+)\{", 1).alias("tool"), F.regexp_extract(c, r"^~~[0-9a-zA-Z]+(\{(?s:.*))$", 1).alias("json")).where("tool <> ''").distinct()
    found = found.where(F.try_parse_json("json").isNotNull() & F.col("json").startswith("{"))
    field = lambda k: F.get_json_object("json", f"$['{k}']")
    return found.select("tool", "json", field("version").alias("version"), field("min-api").try_cast("long").alias("min_api"), field("compilation-mode").alias("mode"), field("pg-map-id").alias("map_id"))


# Message definitions

_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|$)|(\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|[0-9A-Za-z_.]+|[^\s])", re.S)
#: Statements that are no fields; blocks whose statements are none.
_NO_FIELD, _NO_BLOCK = {"option", "reserved", "extensions", "syntax", "import"}, {"enum", "service", "extend"}
_MESSAGES = T.ArrayType(T.StructType([T.StructField("full_name", T.StringType()), T.StructField("name", T.StringType()), T.StructField("fields", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("number", T.LongType())])))]))


def proto_messages(text: str | None) -> list[dict]:
    """The messages of one definition file with their fields; those of a oneof belong to the message around it, those of enums, services and extensions to none."""
    words = [m[1] for m in _TOKEN.finditer(text or "") if m[1]]
    package, found, scopes, at = "", [], [], 0
    statement: list[str] = []
    while at < len(words):
        w = words[at]
        opens = words[at + 2 : at + 3] == ["{"]
        if not statement and not scopes and w == "package":
            package, at = (words[at + 1] if at + 1 < len(words) else ""), at + 2
        elif not statement and opens and w == "message":
            around = next((s["full_name"] for s in reversed(scopes) if s), package)
            found.append({"full_name": f"{around}.{words[at + 1]}" if around else words[at + 1], "name": words[at + 1], "fields": []})
            scopes.append(found[-1])
            at += 3
        elif not statement and opens and (w == "oneof" or w in _NO_BLOCK):
            scopes.append(next((s for s in reversed(scopes) if s), None) if w == "oneof" else None)
            at += 3
        elif w in "{};":
            if scopes and scopes[-1] and "=" in statement and statement[0] not in _NO_FIELD:
                equals = statement.index("=")
                if equals >= 2 and re.fullmatch(r"-?[0-9]+", "".join(statement[equals + 1 : equals + 2])):
                    scopes[-1]["fields"].append({"name": statement[equals - 1], "number": int(statement[equals + 1])})
            statement = []
            if w == "{":
                scopes.append(None)
            elif w == "}" and scopes:
                scopes.pop()
            at += 1
        else:
            statement.append(w)
            at += 1
    return found


@F.pandas_udf(_MESSAGES)
def _messages(text: pd.Series) -> pd.Series:
    return text.map(proto_messages)


def messages(files: DataFrame, text: str) -> DataFrame:
    """(other columns, full_name, name, fields): a row a message."""
    rows = files.withColumn("m", F.explode(_messages(F.col(text))))
    return rows.select(*(c for c in files.columns if c != text), "m.full_name", "m.name", "m.fields")


# Configurations


def settings(lines: DataFrame, file: str, line: str, text: str, known: list[str], repeated: list[str]) -> DataFrame:
    """(file, key, values): ``key = value`` lines; ``#`` starts a comment; an unknown key and a second value of a single one are errors."""
    rows = lines.select(F.col(file).alias("file"), F.col(line).alias("line"), F.trim(F.regexp_replace(text, "#.*$", "")).alias("t")).where("t <> ''")
    rows = rows.select("file", "line", F.trim(F.substring_index("t", "=", 1)).alias("key"), F.trim(F.regexp_extract("t", "^[^=]*=(.*)$", 1)).alias("value"))
    fail = F.raise_error(F.concat(F.lit("unknown key "), "key", F.lit(" in line "), F.col("line").cast("string"))).cast("string")
    rows = rows.withColumn("key", F.when(F.col("key").isin(known), F.col("key")).otherwise(fail))
    out = rows.groupBy("file", "key").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("v"))
    twice = F.raise_error(F.concat(F.lit("two values for "), "key")).cast("array<string>")
    return out.select("file", "key", F.when(~F.col("key").isin(repeated) & (F.size("v") > 1), twice).otherwise(F.transform("v", lambda x: x["value"])).alias("values"))


def catalog(lines: DataFrame, text: str, most: int = 64) -> DataFrame:
    """(place, kind, name, options) of ``kind name k=v ...`` lines, at most ``most``, else an error. lines: place, text."""
    words = F.split(F.trim(F.regexp_replace(text, "#.*$", "")), r"\s+")
    rows = lines.select("place", words.alias("w")).where("w[0] <> ''")
    rows = rows.select("place", F.col("w")[0].alias("kind"), F.col("w")[1].alias("name"), F.map_from_entries(F.transform(F.slice("w", 3, 1 << 20), lambda x: F.struct(F.substring_index(x, "=", 1), F.regexp_extract(x, "^[^=]*=(.*)$", 1)))).alias("options"))
    total = F.count("*").over(Window.partitionBy(F.lit(1)))  # a catalog has at most ``most`` lines
    fail = F.raise_error(F.lit(f"more than {most} entries")).cast("string")
    return rows.withColumn("kind", F.when(total > most, fail).otherwise(F.col("kind")))


def sections(lines: DataFrame, file: str, line: str, text: str) -> DataFrame:
    """(file, section, entry): the lines below each ``[section]`` line; comments and blank lines left out."""
    t = F.trim(F.col(text))
    before = Window.partitionBy(file).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    head = F.nullif(F.regexp_extract(t, r"^\[(.*)\]$", 1), F.lit(""))
    rows = lines.select(F.col(file).alias("file"), F.last_value(head, F.lit(True)).over(before).alias("section"), t.alias("entry"))
    return rows.where(~F.col("entry").rlike(r"^(\[.*\]|#.*|)$")).distinct()


# Module metadata


def module_requests(files: DataFrame, json: str) -> DataFrame:
    """(group, module, version, needs_group, needs, needs_version, constraint) of module metadata in JSON, over all variants."""
    each = "array<struct<group:string,module:string,version:struct<requires:string,strictly:string,prefers:string>>>"
    kind = f"component struct<group:string,module:string,version:string>, variants array<struct<name:string,dependencies:{each},dependencyConstraints:{each}>>"
    rows = files.select(F.from_json(lenient(F.col(json)), kind).alias("m")).select("m.component.*", F.explode("m.variants").alias("v"))
    asks = lambda c, flag: F.transform(F.coalesce(F.col(c), F.array().cast(each)), lambda d: F.struct(d["group"].alias("g"), d["module"].alias("n"), F.coalesce(d["version"]["strictly"], d["version"]["requires"], d["version"]["prefers"]).alias("v"), F.lit(flag).alias("c")))
    out = rows.withColumn("d", F.explode(F.concat(asks("v.dependencies", False), asks("v.dependencyConstraints", True))))
    return out.select("group", "module", "version", F.col("d.g").alias("needs_group"), F.col("d.n").alias("needs"), F.col("d.v").alias("needs_version"), F.col("d.c").alias("constraint")).distinct()


def project_requests(xml: str) -> list[tuple]:
    """What ``pom_requests`` says of one file."""
    root = ElementTree.fromstring(xml)
    for element in root.iter():
        if isinstance(element.tag, str):
            element.tag = element.tag.rpartition("}")[2]
    if root.tag != "project":
        return []
    said = lambda element, tag: "".join(x.itertext()).strip() if (x := element.find(tag)) is not None else None
    properties = {x.get("k", x.tag): "".join(x.itertext()).strip() for x in root.findall("properties/*")}
    managed = {(said(x, "groupId"), said(x, "artifactId")): said(x, "version") for x in root.findall("dependencyManagement/dependencies/dependency")}
    own = tuple(said(root, tag) or "" for tag in ("groupId", "artifactId", "version"))
    out = []
    for x in root.findall("dependencies/dependency"):
        key = said(x, "groupId"), said(x, "artifactId")
        if key[1] and said(x, "scope") != "test" and said(x, "optional") != "true":
            version = said(x, "version") or managed.get(key)
            name = re.fullmatch(r"\$\{(.*)\}", version or "")
            out.append((*own, *key, properties.get(name[1]) if name else version))
    return out


def pom_requests(poms: DataFrame, xml: str = "xml") -> DataFrame:
    """(group, module, version, needs_group, needs, needs_version) of project files: ``${name}`` replaced by the file's properties, missing versions by its managed ones; test and optional ones left out. A parent's properties and managed versions are the caller's to append. A file is parsed once."""
    columns = ["group", "module", "version", "needs_group", "needs", "needs_version"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for x in batch.column(0).to_pylist() if x for row in project_requests(x)]
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], pa.string()) for i in range(len(columns))], columns)

    return poms.select(xml).mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))


# Dumps


def dump_instructions(lines: DataFrame) -> DataFrame:
    """(file, class, method, proto, offset, op, operands): the instructions of a class dump in text. lines: file, line, text; the class and the method of a line are the last ones named before it."""
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    quoted = lambda head: F.nullif(F.regexp_extract("text", rf"^\s*{head}\s*: '(.*)'$", 1), F.lit(""))
    last = lambda c: F.last_value(c, F.lit(True)).over(before)
    rows = lines.select("file", "line", "text", last(quoted("Class descriptor")).alias("class"), last(quoted("name")).alias("method"), last(quoted("type")).alias("proto"))
    code = r"^[0-9a-f]+:[^|]*\|([0-9a-f]+): ([a-z0-9/-]+)\s?(.*)$"
    return rows.where(F.col("text").rlike(code)).select("file", "class", "method", "proto", F.conv(F.regexp_extract("text", code, 1), 16, 10).cast("int").alias("offset"), F.regexp_extract("text", code, 2).alias("op"), F.trim(F.regexp_replace(F.regexp_extract("text", code, 3), r"\s*//.*$", "")).alias("operands"))


# Stored databases


def violations(tables: dict[str, DataFrame], references: list[tuple[str, str, str, str]], unique: list[tuple[str, str]]) -> DataFrame:
    """(rule, n): rows that break a rule of a database; references: (table, column, table, column), unique: (table, column). Nulls refer to nothing."""
    out = None
    for a, x, b, y in references:
        lost = tables[a].where(F.col(x).isNotNull()).join(tables[b].select(F.col(y).alias("__y")).distinct(), F.col(x) == F.col("__y"), "left_anti")
        one = lost.agg(F.count("*").alias("n")).select(F.lit(f"{a}.{x} refers to {b}.{y}").alias("rule"), "n")
        out = one if out is None else out.union(one)
    for a, x in unique:
        twice = tables[a].groupBy(x).agg(F.count("*").alias("k")).where("k > 1")
        one = twice.agg(F.count("*").alias("n")).select(F.lit(f"{a}.{x} is unique").alias("rule"), "n")
        out = one if out is None else out.union(one)
    return out


def write_database(table: DataFrame, path: str, order: list[str], partitions: int) -> None:
    """Canonical files: rows sorted by ``order`` over ranges of it, so that equal rows give equal files of values."""
    table.repartitionByRange(partitions, *order).sortWithinPartitions(*order).write.parquet(path)
