"""The analyses over tables of instructions: a body at a time in the worker, many bodies a task.

Instructions are rows (method, idx, op, dst, args, targets, falls, handlers, lit),
``idx`` from 0 without gaps. A body is held by one worker while it is analysed and
so bounds its memory; bodies are dealt by their method, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroba.flow import graphs as G
from corroba.operators import graphs


def per_body(insns: DataFrame, schema: str, analyse: Callable[[list[G.Insn]], list[tuple]]) -> DataFrame:
    """(method, ...): the rows that ``analyse`` gives for each body."""
    kind = insns.schema["method"].dataType.simpleString()
    columns = ["method", *(c.strip().split(" ")[0] for c in schema.split(","))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        method, body, out = None, [], []

        def done() -> None:
            out.extend((method, *row) for row in analyse(body))

        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.method != method:
                    if body:
                        done()
                    method, body = r.method, []
                whole = lambda x: tuple(int(v) for v in x) if x is not None else ()
                body.append(G.Insn(r.op, None if pd.isna(r.dst) else int(r.dst), whole(r.args), whole(r.targets), bool(r.falls), whole(r.handlers), None if pd.isna(r.lit) else int(r.lit)))
            yield pd.DataFrame(out, columns=columns)
            out.clear()
        if body:
            done()
        yield pd.DataFrame(out, columns=columns)

    rows = insns.select("method", "idx", "op", "dst", "args", "targets", "falls", "handlers", "lit")
    return rows.repartition("method").sortWithinPartitions("method", "idx").mapInPandas(run, f"method {kind}, {schema}")


def control_flow(insns: DataFrame) -> DataFrame:
    """(method, block, to, kind)."""
    return per_body(insns, "block int, to int, kind string", G.block_edges)


def reachable(insns: DataFrame, stops: Callable[[G.Insn], bool] = lambda x: False) -> DataFrame:
    """(method, idx) that paths from the entry meet without entering an instruction that ``stops``."""
    return per_body(insns, "idx int", lambda body: [(i,) for i in sorted(G.reachable(body, 0, frozenset(i for i, x in enumerate(body) if stops(x))))])


def dominators(insns: DataFrame) -> DataFrame:
    """(method, idx, idom); the entry's is null."""
    return per_body(insns, "idx int, idom int", lambda body: list(G.dominators(body).items())).withColumn("idom", F.when(F.col("idx") != 0, F.col("idom")))


def uses(insns: DataFrame, params: int = 0) -> DataFrame:
    """(method, idx, reg, def): the definitions that reach each read; -1 is a parameter."""

    def analyse(body: list[G.Insn]) -> list[tuple]:
        states = G.reaching(body, params)
        return sorted({(i, r, d) for i, x in enumerate(body) for r in x.args for q, d in states[i] or () if q == r})

    return per_body(insns, "idx int, reg int, def int", analyse)


def live(insns: DataFrame) -> DataFrame:
    """(method, idx, reg): registers that are read later, before each instruction."""
    return per_body(insns, "idx int, reg int", lambda body: [(i, r) for i, s in enumerate(G.liveness(body)) for r in sorted(s)])


def kinds(insns: DataFrame) -> DataFrame:
    """(method, idx, reg, kind) before each instruction: constants are small, or zero if they are 0; sums are int; copies keep the kind."""

    def kind(x: G.Insn, state: dict) -> str | None:
        if x.op == "const":
            return "zero" if x.lit == 0 else "small"
        return state.get(x.args[0]) if x.op == "move" else "int" if x.op == "add" else None

    return per_body(insns, "idx int, reg int, kind string", lambda body: [(i, r, k) for i, s in enumerate(G.register_kinds(body, kind)) for r, k in sorted((s or {}).items())])


def known_constants(insns: DataFrame) -> DataFrame:
    """(method, idx, reg, values): reads whose every definition is a constant, through copies, with all values in order."""

    def analyse(body: list[G.Insn]) -> list[tuple]:
        out = []
        for i, x in enumerate(body):
            for r in dict.fromkeys(x.args):
                found = G.constants(body, i, r)
                if found:
                    out.append((i, r, sorted(found)))
        return out

    return per_body(insns, "idx int, reg int, values array<bigint>", analyse)


def register_state(insns: DataFrame, value: Column) -> DataFrame:
    """(method, idx, reg, value): straight-line state: ``value`` of the last instruction before that defines a register, for each read; null if that one has none. No exchange but one by method and register."""
    defs = insns.where("dst is not null").select("method", "idx", F.col("dst").alias("reg"), F.lit(1).alias("d"), value.alias("value"))
    reads = insns.select("method", "idx", F.explode(F.array_distinct("args")).alias("reg")).withColumn("d", F.lit(0)).withColumn("value", F.lit(None).cast(defs.schema["value"].dataType))
    before = Window.partitionBy("method", "reg").orderBy("idx", "d").rowsBetween(Window.unboundedPreceding, -1)
    both = defs.union(reads).withColumn("last", F.last_value(F.when(F.col("d") == 1, F.struct("value")), F.lit(True)).over(before))
    return both.where("d = 0").select("method", "idx", "reg", F.col("last.value").alias("value"))


def webs(insns: DataFrame, reads: DataFrame) -> DataFrame:
    """(method, def, web): definitions that meet in a read or are copied into each other; the web is the smallest. reads: of ``uses``."""
    name = lambda m, i: F.struct(m.alias("method"), i.alias("def"))
    same = reads.groupBy("method", "idx", "reg").agg(F.min("def").alias("head"))
    meet = reads.join(same, ["method", "idx", "reg"]).select(name(F.col("method"), F.col("def")).alias("a"), name(F.col("method"), F.col("head")).alias("b"))
    moves = insns.where("op = 'move'").select("method", "idx").join(reads, ["method", "idx"]).select(name(F.col("method"), F.col("idx")).alias("a"), name(F.col("method"), F.col("def")).alias("b"))
    nodes = insns.where("dst is not null").select(name(F.col("method"), F.col("idx")).alias("n")).union(reads.select(name(F.col("method"), F.col("def")))).distinct()
    found = graphs.components(nodes, "n", meet.union(moves), "a", "b")
    return found.select("node.method", "node.def", F.col("component.def").alias("web"))


#: Fixed values of the line program: the first special opcode, the least line step and how many there are.
FIRST_SPECIAL, LINE_BASE, LINE_RANGE = 0x0A, -4, 15


def line_positions(program: DataFrame, start: DataFrame) -> DataFrame:
    """(method, address, line): the positions that a debug line program emits, by running sums.

    program: method, idx, code, arg (of codes 1 and 2: advance the address, the
    line); special codes step both and emit. start: method, line.
    """
    special = F.col("code") >= FIRST_SPECIAL
    step = F.col("code") - FIRST_SPECIAL
    before = Window.partitionBy("method").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    address = F.when(special, F.floor(step / LINE_RANGE)).when(F.col("code") == 1, F.col("arg")).otherwise(0)
    line = F.when(special, LINE_BASE + step % LINE_RANGE).when(F.col("code") == 2, F.col("arg")).otherwise(0)
    rows = program.select("method", "idx", special.alias("emits"), F.sum(address).over(before).alias("address"), F.sum(line).over(before).alias("moved"))
    return rows.where("emits").join(start, "method").select("method", "address", (F.col("line") + F.col("moved")).alias("line"))
