"""CREATE, MERGE, SET, REMOVE and DELETE as plans that give a new graph.

Bindings are written down before a clause changes the graph, so what is created
keeps its ids and a lost executor repeats nothing. A change of properties is a
left join of the label's table with the bound ids, a deletion an anti-join;
only counts for the summary reach the driver.

Where several rows set the same property of one element, the greatest value
stays. Rows whose variable is null change nothing.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.cypher.compiler import Compiler, Env, Var
from loomgraph.plans.cypher.parser import UPDATES, Clause, CypherError, Path, parse
from loomgraph.plans.graph import EDGE_COLUMNS, VERTEX_COLUMNS, Graph, SchemaError
from loomgraph.plans.storage import materialise

EDGE_KEY = ("_src", "_dst", "_eid", "_tid")


def execute(graph: Graph, text: str, params: dict) -> tuple[Graph, DataFrame]:
    tree = parse(text)
    if not any(c.kind in UPDATES for part in tree["parts"] for c in part):
        return graph, Compiler(graph, params).query(tree)
    if len(tree["parts"]) > 1 or tree["mode"]:
        raise CypherError("a set operation, EXPLAIN or PROFILE cannot change the graph")
    return Writer(graph, params).run(tree["parts"][0])


class Writer(Compiler):
    def __init__(self, graph: Graph, params: dict):
        super().__init__(graph, params)
        self.counts = {"created vertices": 0, "created edges": 0, "set": 0, "deleted vertices": 0, "deleted edges": 0}
        self.done: set[str] = set()

    def run(self, clauses: list[Clause]) -> tuple[Graph, DataFrame]:
        df: DataFrame | None = None
        env: Env = {}
        for c in clauses:
            if c.kind == "match":
                df, env = self.match(df, env, c)
            elif c.kind == "unwind":
                df, env = self.unwind(df, env, c)
            elif c.kind == "call":
                df, env = self.call(df, env, c)
            elif c.kind in ("with", "return"):
                df, env = self.project(df, env, c)
                if c.kind == "return":
                    return self.graph, df
            else:
                self.done.add(c.kind)
                df = self.pinned(df if df is not None else self.one_row())
                df, env = getattr(self, c.kind)(df, env, c)
        return self.graph, self.graph.spark.createDataFrame([(self.summary(),)], "`<SUMMARY>` string")

    def summary(self) -> str:
        n, out = self.counts, []
        if self.done & {"create", "merge"}:
            out.append(f"created {n['created vertices']} vertices, created {n['created edges']} edges.")
        if "set" in self.done or n["set"]:
            out.append(f"set {n['set']} properties.")
        if "delete" in self.done:
            out.append(f"deleted {n['deleted vertices']} vertices, deleted {n['deleted edges']} edges.")
        return " ".join(out)

    def pinned(self, df: DataFrame) -> DataFrame:
        """``df`` written down under plain column names and read back under its own."""
        held = materialise(df.select(*(self.col(c).alias(f"c{i}") for i, c in enumerate(df.columns))), "bindings")
        return held.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)))

    # -- CREATE -------------------------------------------------------------
    def create(self, df: DataFrame, env: Env, c: Clause) -> tuple[DataFrame, Env]:
        for p in c.data["paths"]:
            df, env = self.create_path(df, env, p)
        return df, env

    def top_id(self) -> int:
        parts = [t.agg(F.max("_vid").alias("m")) for t in self.graph.vertices.values()]
        found = reduce(lambda a, b: a.union(b), parts).agg(F.max("m")).first()[0] if parts else None
        return -1 if found is None else found

    def create_path(self, df: DataFrame, env: Env, p: Path) -> tuple[DataFrame, Env]:
        nodes, made = [], 0
        fresh = [n for i, n in enumerate(p.parts) if i % 2 == 0 and not (n.var and n.var in env)]
        names = [n.var for n in fresh if n.var]
        if len(set(names)) < len(names):
            raise CypherError("a variable is created twice in one pattern")
        if any(len(r.types) != 1 or r.direction == "both" or r.hops is not None for r in p.parts[1::2]):
            raise CypherError("a created edge has one label and one direction")
        row, top, values = self.new("row"), self.top_id() + 1, env
        df = df.select("*", F.monotonically_increasing_id().alias(row))
        for n in p.parts[::2]:
            if n.var and n.var in env:
                if n.labels or n.props:
                    raise CypherError(f"{n.var} is already bound")
                nodes.append(env[n.var])
                continue
            if len(n.labels) != 1:
                raise CypherError("a created node has one label")
            label, name = n.labels[0], n.var or self.new("anon")
            table, given = self.graph.vertex(label), dict(n.props)
            self.known_properties(label, given)
            columns = {x: self.new(f"{name}.{x}") for x in [*table.columns, "_label"]}
            vid = (F.lit(top + made) + self.col(row) * len(fresh)).cast("long")
            filled = [self.filled(x, given, vid, label, table, values, df).alias(columns[x]) for x in columns]
            df, made = df.select("*", *filled), made + 1
            v = Var("node", columns["_vid"], columns, (label,))
            nodes.append(v)
            env = {**env, name: v}
        if made:
            df = self.pinned(df)
        for n, v in zip(p.parts[::2], nodes):
            if n in fresh:
                label = n.labels[0]
                new = df.select(*(self.col(v.props[x]).alias(x) for x in self.graph.vertex(label).columns))
                self.graph = self.graph.insert_vertices(label, new)
        if made:
            self.counts["created vertices"] += made * df.count()
        for i, r in enumerate(p.parts[1::2]):
            ends = (nodes[i], nodes[i + 1]) if r.direction == "out" else (nodes[i + 1], nodes[i])
            df, env = self.create_edge(df, env, r, *ends)
        return df, env

    def filled(self, name: str, given: dict, vid, label: str, table: DataFrame, env: Env, df: DataFrame):
        if name == "_vid":
            return vid
        if name == "_label":
            return F.lit(label)
        value = self.expr(given[name], env, df) if name in given else F.lit(None)
        return value.cast(table.schema[name].dataType)

    def known_properties(self, label: str, given: dict) -> None:
        for k in given:
            if k not in self.graph.properties(label):
                raise SchemaError(f"{label} has no property {k}")

    def create_edge(self, df: DataFrame, env: Env, r, src: Var, dst: Var) -> tuple[DataFrame, Env]:
        label, given, name = r.types[0], dict(r.props), r.var or self.new("anon")
        table = self.graph.edge(label)
        self.known_properties(label, given)
        held = self.graph.edge_labels.get(label)
        if held is not None and held.constraints and len(src.labels) == len(dst.labels) == 1 and (src.labels[0], dst.labels[0]) not in held.constraints:
            raise SchemaError(f"{label} does not go from {src.labels[0]} to {dst.labels[0]}")
        columns = {x: self.new(f"{name}.{x}") for x in [*table.columns, "_label", "_lid"]}
        a, b = self.col(src.column), self.col(dst.column)
        pairs = df.select(a.alias("_src"), b.alias("_dst")).distinct()
        last = table.join(pairs, ["_src", "_dst"], "left_semi").groupBy("_src", "_dst").agg(F.max("_eid").alias("m"))
        s, d, m = self.new("s"), self.new("d"), self.new("m")
        out = df.join(last.select(F.col("_src").alias(s), F.col("_dst").alias(d), F.col("m").alias(m)), (a == self.col(s)) & (b == self.col(d)), "left")
        place = F.row_number().over(Window.partitionBy(a, b).orderBy(F.lit(0)))
        own = {"_src": a, "_dst": b, "_eid": F.coalesce(self.col(m), F.lit(-1)) + place, "_tid": F.lit(0), "_label": F.lit(label), "_lid": F.lit(self.graph.edge_label_id(label))}
        kinds = {**{f.name: f.dataType for f in table.schema}, "_label": "string", "_lid": "int"}
        there = a.isNotNull() & b.isNotNull()
        filled = [F.when(there, own[x] if x in own else self.expr(given[x], env, df) if x in given else F.lit(None)).cast(kinds[x]).alias(columns[x]) for x in columns]
        df = self.pinned(out.select(*(self.col(x) for x in df.columns), *filled))
        rows = df.where(self.col(columns["_src"]).isNotNull()).select(*(self.col(columns[x]).alias(x) for x in table.columns))
        self.graph = self.graph.insert_edges(label, rows)
        self.counts["created edges"] += rows.count()
        return df, {**env, name: Var("edge", columns["_eid"], columns, (label,))}

    # -- MERGE --------------------------------------------------------------
    def merge(self, df: DataFrame, env: Env, c: Clause) -> tuple[DataFrame, Env]:
        """Rows whose pattern is not there create it once for each set of values; then all rows match."""
        p: Path = c.data["path"]
        parts = tuple(replace(x, var=x.var or self.new("anon")) for x in p.parts)
        p = replace(p, parts=parts)
        free = [x for x in parts if x.var not in env]
        if len(parts) > 1 and any(i % 2 == 0 and x in free for i, x in enumerate(parts)):
            raise CypherError("MERGE of a path needs its nodes bound; merge them first")
        row = self.new("row")
        df = self.pinned(df.select("*", F.monotonically_increasing_id().alias(row)))
        find = Clause("match", {"optional": False, "paths": [p], "where": None})
        found, scope = self.match(df, env, find)
        missing = df.join(found.select(self.col(row).alias("#found")).distinct(), self.col(row) == F.col("`#found`"), "left_anti")
        keys = [self.col(env[x.var].column) for x in parts if x.var in env]
        keys += [self.expr(e, env, df) for x in free for _, e in x.props]
        once = missing
        if keys:
            first = missing.groupBy(*(k.alias(f"k{i}") for i, k in enumerate(keys))).agg(F.min(self.col(row)).alias("#first"))
            once = missing.join(first.select("`#first`"), self.col(row) == F.col("`#first`"), "left_semi")
        else:
            once = missing.limit(1)
        before = self.graph
        made, own = self.create_path(self.pinned(once), env, p)
        if not c.data["created"] and not c.data["matched"]:
            out, scope = self.match(df, env, find)
            return out.drop(row), scope
        if c.data["created"]:
            self.assign(made, own, c.data["created"])
        if c.data["matched"]:
            after, self.graph = self.graph, before  # what was there before, with the values it had
            old, old_scope = self.match(df, env, find)
            old = self.pinned(old)
            self.graph = after
            self.assign(old, old_scope, c.data["matched"])
        out, scope = self.match(df, env, find)
        return out.drop(row), scope

    # -- SET, REMOVE --------------------------------------------------------
    def set(self, df: DataFrame, env: Env, c: Clause) -> tuple[DataFrame, Env]:
        return self.assign(df, env, c.data["items"])

    def settable(self, env: Env, name: str) -> Var:
        v = env.get(name)
        if v is None or v.kind not in ("node", "edge") or "_label" not in v.props:
            raise CypherError(f"{name} is not a node or an edge of a known label")
        return v

    def labels_of(self, v: Var) -> list[str]:
        return list(v.labels) or list(self.graph.vertices if v.kind == "node" else self.graph.edges)

    def assign(self, df: DataFrame, env: Env, items: list[tuple]) -> tuple[DataFrame, Env]:
        todo: dict[str, dict[str, object]] = {}
        for name, prop, e in items:
            v = self.settable(env, name)
            values = todo.setdefault(name, {})
            if prop is not None and prop != "=":
                values[prop] = self.expr(e, env, df)
                continue
            if e[0] not in ("map", "param"):
                raise CypherError("a map of properties is needed")
            pairs = [(k, self.expr(x, env, df)) for k, x in e[1]] if e[0] == "map" else [(k, self.literal(x)) for k, x in dict(self.constant(e)).items()]
            values.update(pairs)
        for name, values in todo.items():
            v = self.settable(env, name)
            able = [x for x in self.labels_of(v) if set(values) <= set(self.graph.properties(x))]
            if not able:
                raise SchemaError(f"{name} has no property {', '.join(values)}")
            if any((x, k) in self.graph.series for x in able for k in values):
                raise SchemaError("a series field is written by the series functions")
            kinds = {k: self.graph.vertices.get(x, self.graph.edges.get(x)).schema[k].dataType for x in able for k in values}
            marks = {k: self.new("set") for k in values}
            df = self.pinned(df.select("*", *(x.cast(kinds[k]).alias(marks[k]) for k, x in values.items())))
            self.counts["set"] += len(values) * df.where(self.col(v.column).isNotNull() & self.col(v.props["_label"]).isin(able)).count()
            key = VERTEX_COLUMNS if v.kind == "node" else EDGE_COLUMNS
            for label in able:
                mine = df.where(self.col(v.props["_label"]) == label)
                new = mine.groupBy(*(self.col(v.props[k]).alias(f"#{k}") for k in key)).agg(F.max(F.struct(*(self.col(marks[k]).alias(k) for k in values))).alias("#new"))
                self.store(label, v.kind, key, new, list(values))
            # The bindings see what is stored: the greatest value of each element.
            w = Window.partitionBy(*(self.col(v.props[k]) for k in (*key, "_label")))
            held = F.max(F.struct(*(self.col(marks[k]).alias(k) for k in values))).over(w)
            df = df.withColumn("#held", held)
            df = df.withColumns({v.props[k]: F.col("`#held`")[k] for k in values if k in v.props}).drop("#held", *marks.values())
        return df, env

    def store(self, label: str, kind: str, key: tuple, new: DataFrame, names: list[str]) -> None:
        where = "vertices" if kind == "node" else "edges"
        old = getattr(self.graph, where)[label]
        on = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"`#{k}`") for k in key))
        out = old.join(new, on, "left")
        hit = F.col(f"`#{key[0]}`").isNotNull()
        primary = self.graph.vertex_labels[label].primary if kind == "node" and label in self.graph.vertex_labels else None
        values = {n: F.when(hit, F.col("`#new`")[n]).otherwise(F.col(f"`{n}`")) for n in names}
        if primary in values and new.where(F.col("`#new`")[primary].isNull()).limit(1).count():
            raise SchemaError(f"{label}.{primary} cannot be null")
        out = out.withColumns(values).select(*(F.col(f"`{c}`") for c in old.columns))
        if primary in values and out.groupBy(f"`{primary}`").count().where("count > 1").limit(1).count():
            raise SchemaError(f"{label}.{primary} is not unique")
        self.graph = replace(self.graph, **{where: {**getattr(self.graph, where), label: out}})

    # -- DELETE -------------------------------------------------------------
    def delete(self, df: DataFrame, env: Env, c: Clause) -> tuple[DataFrame, Env]:
        """Edges first, then nodes with the edges at them; each is counted once."""
        bound = [self.settable(env, x) for x in c.data["vars"]]
        gone_edges = [(label, df.where(self.col(v.props["_label"]) == label).select(*(self.col(v.props[k]).alias(k) for k in EDGE_KEY))) for v in bound if v.kind == "edge" for label in self.labels_of(v)]
        nodes = [df.where(self.col(v.column).isNotNull()).select(self.col(v.column).alias("_vid"), self.col(v.props["_label"]).alias("_label")) for v in bound if v.kind == "node"]
        edges, vertices = dict(self.graph.edges), dict(self.graph.vertices)
        before = {k: v.count() for k, v in edges.items()}
        for label, keys in gone_edges:
            edges[label] = edges[label].join(keys.distinct(), list(EDGE_KEY), "left_anti").select(*edges[label].columns)
        if nodes:
            gone = self.pinned(reduce(lambda a, b: a.union(b), nodes).distinct())
            self.counts["deleted vertices"] += gone.count()
            ids = gone.select(F.col("_vid").alias("#gone"))
            for label, e in edges.items():
                for end in ("_src", "_dst"):
                    e = e.join(ids, F.col(end) == F.col("`#gone`"), "left_anti")
                edges[label] = e
            for label, t in vertices.items():
                vertices[label] = t.join(gone.where(F.col("_label") == label).select(F.col("_vid").alias("#gone")), F.col("_vid") == F.col("`#gone`"), "left_anti")
        self.graph = replace(self.graph, vertices=vertices, edges=edges)
        self.counts["deleted edges"] += sum(before[k] - e.count() for k, e in edges.items())
        return df, env
