"""Walks of any length through a graph of typed edges, described by an expression over edge names.

    part_of+                    one part_of or more
    works_at/part_of{1,3}       works_at, then one to three part_of
    (knows|^knows)*/lives_in    knows in either direction, any number of times, then lives_in
    ./part_of?                  any edge, then perhaps part_of

The expression becomes an automaton without empty moves: a state for each place of a name. Walks are then followed
a step at a time from (start, node, state) rows that are new, so cycles end and each such row is expanded once.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.shared import fresh, stash, told_apart, unstash

#: New rows of a step up to this many are broadcast to the edges, so that these stay where they are.
FRONT_ROWS = 100_000
#: Arcs and seeds a bucket of what was reached, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 50_000, 2000
#: Places of names that an expression may have once its counts are written out.
MOST_STATES = 1000

_TOKEN = re.compile(r"\s*(\^?\.|\^?[\w-]+|\{\s*\d+\s*(?:,\s*\d*\s*)?\}|[()|/*+?])")


class Automaton:
    """States 0 (the start) to n; `moves` is (state, edge, back, next), where edge None is any edge and back leads against it."""

    def __init__(self, expression: str):
        self._left, at, text = [], 0, expression.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read the expression at {text[at:]!r}")
            self._left.append(m[1])
            at = m.end()
        self._left.reverse()
        self.names: list[str] = []
        self._after: dict[int, set[int]] = {}
        empty, first, last = self._build(self._either())
        if self._left:
            raise ValueError(f"can't read the expression at {self._left[-1]!r}")
        self._after[0] = first
        self.accepting = sorted(last | ({0} if empty else set()))
        self.moves = sorted(((s, *self._name(n), n) for s, nexts in self._after.items() for n in nexts), key=lambda m: (m[0], m[3]))

    def _name(self, state: int) -> tuple[str | None, bool]:
        name = self.names[state - 1]
        bare = name.removeprefix("^")
        return (None if bare == "." else bare), name != bare

    # An expression as nested tuples: ("name", x), ("seq" or "or", a, b), ("times", a, least, most or None).

    def _take(self, *tokens: str) -> str | None:
        return self._left.pop() if self._left and self._left[-1] in tokens else None

    def _either(self) -> tuple:
        one = self._sequence()
        while self._take("|"):
            one = ("or", one, self._sequence())
        return one

    def _sequence(self) -> tuple:
        one = self._repeated()
        while self._take("/"):
            one = ("seq", one, self._repeated())
        return one

    def _repeated(self) -> tuple:
        if self._take("("):
            one = self._either()
            if not self._take(")"):
                raise ValueError("a bracket isn't closed")
        elif self._left and re.fullmatch(r"\^?(\.|[\w-]+)", self._left[-1]):
            one = ("name", self._left.pop())
        else:
            raise ValueError(f"a name is missing before {self._left[-1] if self._left else 'the end'!r}")
        while self._left and (self._left[-1] in "*+?" or self._left[-1].startswith("{")):
            sign = self._left.pop()
            counts = [c.strip() for c in sign.strip("{}").split(",")]
            least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(sign) or (int(counts[0]), int(counts[-1]) if counts[-1] else None)
            if most is not None and most < least:
                raise ValueError(f"{sign} counts down")
            one = ("times", one, least, most)
        return one

    def _build(self, e: tuple) -> tuple[bool, set[int], set[int]]:
        """(may be empty, first states, last states); what follows a state is noted in `_after`."""
        if e[0] == "name":
            self.names.append(e[1])
            if len(self.names) > MOST_STATES:
                raise ValueError(f"the expression has more than {MOST_STATES} names once its counts are written out")
            return False, {len(self.names)}, {len(self.names)}
        if e[0] == "or":
            a, b = self._build(e[1]), self._build(e[2])
            return a[0] or b[0], a[1] | b[1], a[2] | b[2]
        if e[0] == "seq":
            return self._joined(self._build(e[1]), self._build(e[2]))
        _, inner, least, most = e
        out = (True, set(), set())
        for _ in range(least if most is not None or not least else least - 1):
            out = self._joined(out, self._build(inner))
        if most is None:  # the last copy goes round
            again = self._build(inner)
            self._link(again[2], again[1])
            return self._joined(out, (again[0] or not least, again[1], again[2]))
        rest = (True, set(), set())
        for _ in range(most - least):  # x{0,2} is (x(x)?)?, built from its end
            one = self._joined(self._build(inner), rest)
            rest = (True, one[1], one[2])
        return self._joined(out, rest)

    def _joined(self, a: tuple, b: tuple) -> tuple[bool, set[int], set[int]]:
        self._link(a[2], b[1])
        return a[0] and b[0], a[1] | (b[1] if a[0] else set()), b[2] | (a[2] if b[0] else set())

    def _link(self, froms: set[int], tos: set[int]) -> None:
        for s in froms:
            self._after.setdefault(s, set()).update(tos)


def walks(expression: str, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(start, node, hops): the nodes that seeds (id) reach by walks that the expression describes, with the fewest edges.

    edges: src, edge, dst; rows with a null in any of them lead nowhere, rows that repeat count once, other columns are left
    alone. Nodes and edges may be visited again. A seed that is null is left out; one that no edge has is reached from itself
    if the expression may be empty. There are as many rounds as the longest of the shortest walks has edges; each reads the arcs and what was reached before
    and writes its new rows to the shared folder; a round whose rows are few is broadcast to the edges, else both are shuffled by node. What was
    reached is a table in buckets by its rows, so only a round's own steps are shuffled to it; its name is dropped at the end.
    """
    auto, spark = Automaton(expression), edges.sparkSession
    plain = edges.select("src", "edge", "dst").dropna()
    ways = {}  # (edge, back) -> the states that such an edge leads between
    for s, name, back, to in auto.moves:
        ways.setdefault((name, back), []).append((s, to))
    found = []
    for back in (False, True):
        wanted = [(name, pairs) for (name, b), pairs in ways.items() if b == back]
        if wanted:
            lists = [F.when(F.lit(True) if name is None else F.col("edge") == name, F.array(*(F.struct(F.lit(s).alias("state"), F.lit(to).alias("next")) for s, to in pairs))) for name, pairs in wanted]
            ends = ("dst", "src") if back else ("src", "dst")
            leads = plain if any(name is None for name, _ in wanted) else plain.where(F.col("edge").isin(*(name for name, _ in wanted)))
            leads = leads.select(F.col(ends[0]).alias("node"), F.col(ends[1]).alias("to"), F.explode(F.flatten(F.array_compact(F.array(*lists)))).alias("m"))
            found.append(leads.select("node", "m.state", "to", "m.next"))
    none = plain.where("false").select(F.col("src").alias("node"), F.lit(0).alias("state"), F.col("dst").alias("to"), F.lit(0).alias("next"))
    arcs = stash(told_apart(reduce(DataFrame.unionAll, found, none)), "arcs")
    start = told_apart(seeds.select(F.col("id").alias("start")).dropna()).select("start", F.col("start").alias("node"), F.lit(0).alias("state"))
    start = stash(start, "seeds")

    where, name, keys = fresh(spark, "walks"), f"quillstone_walks_{uuid.uuid4().hex}", ["start", "node", "state"]
    buckets = min(MOST_BUCKETS, (arcs.count() + start.count()) // BUCKET_ROWS + 1)

    def add(rows: DataFrame, hops: int) -> None:
        rows.withColumn("hops", F.lit(hops)).write.format("parquet").mode("append").partitionBy("hops").bucketBy(buckets, *keys).option("path", where).saveAsTable(name)

    form = start.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", hops int"
    hops = 0
    try:
        add(start.repartition(buckets, *keys), hops)
        while True:
            reached = spark.table(name)
            front = reached.where(F.col("hops") == hops).drop("hops")
            n = front.count()
            if not n:
                break
            step = arcs.join(F.broadcast(front) if n <= FRONT_ROWS else front, ["node", "state"]).select("start", F.col("to").alias("node"), F.col("next").alias("state"))
            hops += 1
            add(step.repartition(buckets, *keys).distinct().join(reached, keys, "left_anti"), hops)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # its files stay
    unstash(arcs, start)
    reached = spark.read.schema(form).parquet(where)
    return reached.where(F.col("state").isin(*auto.accepting)).repartition("start", "node").groupBy("start", "node").agg(F.min("hops").alias("hops"))
