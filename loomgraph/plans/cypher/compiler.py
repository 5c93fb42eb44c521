"""Syntax trees to DataFrame plans.

The state between clauses is a binding table: a DataFrame whose columns are the
fields of the variables in scope (``n.name`` is one flat column), so Catalyst
prunes what a query never reads. Expanding an edge is an equi-join; an optional
pattern is a left join of the whole pattern with its condition; a pattern used
as a predicate is a semi- or anti-join.

Choices where engines differ: equality treats two nulls as equal, in logic a
null counts as false, ``sum`` is a double and 0.0 of nothing, ``max`` and
``min`` of numbers are doubles, UNION keeps duplicates unless DISTINCT is said.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import series as series_functions
from loomgraph.functions.scalars import FUNCTIONS, cut, index, to_string
from loomgraph.operators import procedures
from loomgraph.plans.cypher.parser import UPDATES, Clause, CypherError, Node, Path, Rel
from loomgraph.plans.graph import SchemaError

#: Hops after which an unbounded pattern that still grows is an error.
MAX_HOPS = 128
AGGREGATES = frozenset("count sum avg max min collect percentilecont percentiledisc stdev stdevp variance variancep group_concat".split())

RANKS = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}


@dataclass
class Var:
    kind: str  # node, edge, edges, path or value
    column: str
    #: Property name to flat column, for nodes and edges.
    props: dict[str, str] = field(default_factory=dict)
    labels: tuple[str, ...] = ()


Env = dict[str, Var]


class Compiler:
    def __init__(self, graph, params: dict):
        self.graph, self.params, self.serial = graph, params, 0

    def new(self, base: str) -> str:
        self.serial += 1
        return f"{base}#{self.serial}"

    @staticmethod
    def col(name: str) -> Column:
        return F.col(f"`{name}`")

    # -- queries ------------------------------------------------------------
    def query(self, tree: dict) -> DataFrame:
        out = self.single(tree["parts"][0])
        for op, part in zip(tree["ops"], tree["parts"][1:]):
            more = self.single(part)
            if set(more.columns) != set(out.columns):
                raise CypherError("all parts of a set operation need the same column names")
            more = more.select(*(self.col(c) for c in out.columns))
            word, _, how = op.partition(" ")
            if word == "UNION":
                out = out.unionByName(more)
                out = out.distinct() if how == "DISTINCT" else out
            elif word == "INTERSECT":
                out = out.intersectAll(more) if how == "ALL" else out.intersect(more)
            else:
                out = out.exceptAll(more) if how == "ALL" else out.subtract(more)
        if tree["mode"]:
            plan = out._jdf.queryExecution().explainString(out.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            return out.sparkSession.createDataFrame([(plan,)], "plan string")
        return out

    def single(self, clauses: list[Clause]) -> DataFrame:
        df: DataFrame | None = None
        env: Env = {}
        for i, c in enumerate(clauses):
            if c.kind == "match":
                df, env = self.match(df, env, c)
            elif c.kind == "unwind":
                df, env = self.unwind(df, env, c)
            elif c.kind == "call":
                df, env = self.call(df, env, c)
                if i == len(clauses) - 1:
                    return df.select(*(self.col(v.column).alias(k) for k, v in env.items()))
            elif c.kind in UPDATES:
                raise CypherError(f"{c.kind.upper()} changes the graph; use Graph.execute")
            else:
                df, env = self.project(df, env, c)
                if c.kind == "return":
                    return df
        raise CypherError("a query ends with RETURN")

    def one_row(self) -> DataFrame:
        return self.graph.spark.range(1).select(F.lit(1).alias("#one"))

    def unwind(self, df: DataFrame | None, env: Env, c: Clause) -> tuple[DataFrame, Env]:
        df, name = (df if df is not None else self.one_row()), self.new(c.data["var"])
        out = df.select("*", F.explode(self.expr(c.data["expr"], env, df)).alias(name))
        return out, {**env, c.data["var"]: Var("value", name)}

    def call(self, df: DataFrame | None, env: Env, c: Clause) -> tuple[DataFrame, Env]:
        args = [self.constant(a) for a in c.data["args"]] if not env else c.data["args"]
        if env and not all(self.is_constant(a) for a in args):
            raise CypherError("procedure arguments after other clauses have to be constants")
        if env:
            args = [self.constant(a) for a in args]
        found = procedures.call(self.graph, c.data["name"], args)
        yields = c.data["yields"] or [(x, x) for x in found.columns]
        for name, _ in yields:
            if name not in found.columns:
                raise CypherError(f"{c.data['name']} yields no {name}")
        fresh = {alias: self.new(alias) for _, alias in yields}
        found = found.select(*(self.col(a).alias(fresh[b]) for a, b in yields))
        env = {**env, **{b: Var("value", fresh[b]) for _, b in yields}}
        df = found if df is None else df.crossJoin(found)
        if c.data["where"]:
            df = df.where(self.condition(c.data["where"], env, df))
        return df, env

    # -- patterns -----------------------------------------------------------
    def match(self, df: DataFrame | None, env: Env, c: Clause) -> tuple[DataFrame, Env]:
        paths, conditions = self.outer_props(c.data["paths"], c.data["where"])
        pattern, own, shared, where = self.pattern(paths, conditions, env)
        scope = {**env, **{k: v for k, v in own.items() if k not in env}}
        if df is None:
            df = pattern
            if c.data["optional"]:
                df = self.one_row().join(self.filtered(pattern, where, scope), F.lit(True), "left")
                where = None
        else:
            links = [self.same(env[k], own[k]) for k in shared]
            subquery = any(self.has_pattern(w) for w in where)
            if subquery and not c.data["optional"]:
                df = df.join(pattern, self.all_of(links), "inner") if links else df.crossJoin(pattern)
            else:
                on = [*links, *(self.condition(w, scope, None) for w in where)]
                how = "left" if c.data["optional"] else "inner"
                df = df.join(pattern, self.all_of(on), how) if on else (df.join(pattern, F.lit(True), "left") if how == "left" else df.crossJoin(pattern))
                where = None
        for w in where or []:
            df = self.apply_where(df, w, scope)
        return df, scope

    def outer_props(self, paths: list[Path], where: tuple | None) -> tuple[list[Path], tuple | None]:
        """Inline properties that read other variables become conditions."""
        out = []
        for p in paths:
            parts = []
            for x in p.parts:
                moved = [(k, e) for k, e in x.props if self.free(e)]
                if moved and getattr(x, "hops", None) is None:
                    x = replace(x, var=x.var or self.new("anon"), props=tuple(q for q in x.props if q not in moved))
                    for k, e in moved:
                        test = ("op", "=", ("prop", ("var", x.var), k), e)
                        where = test if where is None else ("op", "AND", where, test)
                parts.append(x)
            out.append(replace(p, parts=tuple(parts)))
        return out, where

    def filtered(self, df: DataFrame, where: list, env: Env) -> DataFrame:
        for w in where:
            df = self.apply_where(df, w, env)
        return df

    @staticmethod
    def all_of(conditions: list[Column]) -> Column:
        return reduce(lambda a, b: a & b, conditions)

    def same(self, a: Var, b: Var) -> Column:
        if a.kind == "edge":
            return self.all_of([self.col(a.props[k]) == self.col(b.props[k]) for k in ("_src", "_dst", "_lid", "_tid", "_eid")])
        return self.col(a.column) == self.col(b.column)

    def split_and(self, e: tuple | None) -> list[tuple]:
        if e is None:
            return []
        if e[0] == "op" and e[1] == "AND":
            return self.split_and(e[2]) + self.split_and(e[3])
        return [e]

    def pattern(self, paths: list[Path], where: tuple | None, env: Env) -> tuple[DataFrame, Env, list[str], list]:
        """The pattern on its own; conditions that only it is needed for are applied."""
        df: DataFrame | None = None
        own: Env = {}
        edges: list[tuple[str, tuple[str, ...], Var]] = []
        for p in paths:
            start = own.get(p.parts[0].var) if p.parts[0].var else None
            goes_on = start is not None and start.kind == "node"  # the path grows from a node already there
            part, names, found = self.path(p, env, start if goes_on else None, df if goes_on else None)
            if df is None or goes_on:
                if goes_on:
                    for k in names:
                        if k in own and k != p.parts[0].var:
                            part = part.where(self.same(own[k], names[k]))
                df = part
            else:
                links = [self.same(own[k], names[k]) for k in names if k in own]
                df = df.join(part, self.all_of(links)) if links else df.crossJoin(part)
            own = {**own, **{k: v for k, v in names.items() if k not in own}}
            if p.mode != "WALK":
                for kind, types, v in found:
                    for other_kind, other_types, o in edges:
                        if (set(types or self.graph.edges) & set(other_types or self.graph.edges)):
                            df = df.where(self.apart(kind, v, other_kind, o))
                    edges.append((kind, types, v))
        shared = [k for k in own if k in env]
        mine = {k: v for k, v in own.items() if k not in env}
        rest = []
        for w in self.split_and(where):
            if self.free(w) <= set(mine) and not self.has_pattern(w):
                df = df.where(self.condition(w, mine, df))
            else:
                rest.append(w)
        return df, own, shared, rest

    def uid(self, v: Var) -> Column:
        return F.concat_ws("_", *(self.col(v.props[k]).cast("string") for k in ("_src", "_dst", "_lid", "_tid", "_eid")))

    def apart(self, kind: str, a: Var, other: str, b: Var) -> Column:
        if kind == other == "edge":
            return ~self.all_of([self.col(a.props[k]) == self.col(b.props[k]) for k in ("_eid", "_src", "_dst", "_lid", "_tid")])
        if kind == "edges" and other == "edges":
            return ~F.arrays_overlap(self.uids(a), self.uids(b))
        many, one = (a, b) if kind == "edges" else (b, a)
        return ~F.array_contains(self.uids(many), self.uid(one))

    def uids(self, v: Var) -> Column:
        return F.transform(self.col(v.column), lambda e: e["_uid"])

    def scan(self, n: Node, var: str, env: Env) -> tuple[DataFrame, Var]:
        for label in n.labels:
            self.graph.vertex(label)
        outer = env.get(var)
        known = list(n.labels) or (list(outer.labels) if outer is not None else []) or list(self.graph.vertices)
        table = self.graph.all_vertices(known)
        names = {c: self.new(f"{var}.{c}") for c in table.columns}
        v = Var("node", names["_vid"], dict(names), tuple(known) if n.labels or outer is not None else ())
        df = table.select(*(F.col(f"`{c}`").alias(x) for c, x in names.items()))
        return self.narrow(df, n.props, n.where, var, v, n.labels), v

    def narrow(self, df: DataFrame, props: tuple, where: tuple | None, name: str, v: Var, labels: tuple) -> DataFrame:
        for k, e in props:
            if k not in v.props:
                raise SchemaError(f"{'|'.join(labels) or 'the graph'} has no property {k}")
            df = df.where(self.col(v.props[k]) == self.expr(e, {}, df))
        if where is not None:
            df = df.where(self.condition(where, {name: v}, df))
        return df

    def edge_table(self, r: Rel) -> tuple[DataFrame, list[str]]:
        for t in r.types:
            self.graph.edge(t)
        return self.graph.all_edges(list(r.types) or None), list(r.types)

    def path(self, p: Path, env: Env, start: Var | None = None, df: DataFrame | None = None) -> tuple[DataFrame, Env, list]:
        """Nodes and edges of one path, joined from left to right."""
        own: Env = {}
        found: list = []
        nodes: list[Var] = []
        parts: list[Var] = []
        first = p.parts[0]
        name = first.var or self.new("anon")
        if start is None:
            df, v = self.scan(first, name, env)
        else:
            v = start
            if first.labels:
                df = df.where(self.col(v.props["_label"]).isin(*first.labels))
            df = self.narrow(df, first.props, first.where, name, v, v.labels)
        nodes.append(v)
        own[name] = v
        at = v.column
        for i in range(1, len(p.parts), 2):
            r, n = p.parts[i], p.parts[i + 1]
            rname, nname = r.var or self.new("anon"), n.var or self.new("anon")
            if r.hops is None:
                df, rv, end = self.hop(df, at, r, rname, p)
                found.append(("edge", r.types, rv))
            else:
                df, rv, end = self.hops(df, at, r, rname, p)
                found.append(("edges", r.types, rv))
            if p.mode != "WALK":
                for kind, types, o in found[:-1]:
                    if set(types or self.graph.edges) & set(r.types or self.graph.edges):
                        df = df.where(self.apart(found[-1][0], rv, kind, o))
            own[rname] = rv
            parts.append(rv)
            repeated = own.get(nname)
            bare = n.var is None and not n.labels and not n.props and n.where is None
            if repeated is not None and repeated.kind == "node":
                df = df.where(self.col(end) == self.col(repeated.column))
                nv = repeated
            elif bare:
                nv = Var("node", end, {"_vid": end})
            else:
                side, nv = self.scan(n, nname, env)
                df = df.join(side, self.col(end) == self.col(nv.column))
                own[nname] = nv
            nodes.append(nv)
            at = nv.column
        if p.mode in ("ACYCLIC", "SIMPLE"):
            df = df.where(self.distinct_nodes(nodes, parts, p.mode))
        if p.var:
            column = self.new(p.var)
            df = df.select("*", self.path_value(nodes, parts).alias(column))
            own[p.var] = Var("path", column)
        return df, own, found

    def node_ids(self, nodes: list[Var], parts: list[Var]) -> Column:
        pieces = [F.array(self.col(nodes[0].column))]
        for rv, nv in zip(parts, nodes[1:]):
            pieces.append(F.array(self.col(nv.column)) if rv.kind == "edge" else F.transform(self.col(rv.column), lambda e: e["_to"]))
        return F.concat(*pieces)

    def distinct_nodes(self, nodes: list[Var], parts: list[Var], mode: str) -> Column:
        ids = self.node_ids(nodes, parts)
        free = F.size(F.array_distinct(ids)) == F.size(ids)
        if mode == "ACYCLIC":
            return free
        inner = F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))
        ring = (F.get(ids, F.lit(0)) == F.element_at(ids, -1)) & (F.size(F.array_distinct(inner)) == F.size(inner)) & (F.size(ids) > 1)
        return free | ring

    def path_value(self, nodes: list[Var], parts: list[Var]) -> Column:
        edges = [F.array(self.edge_struct(v)) if v.kind == "edge" else F.transform(self.col(v.column), lambda e: F.struct(e["_src"].alias("_src"), e["_dst"].alias("_dst"), e["_label"].alias("_label"), e["_uid"].alias("_uid"))) for v in parts]
        kind = "array<struct<_src:bigint,_dst:bigint,_label:string,_uid:string>>"
        return F.struct(self.node_ids(nodes, parts).alias("nodes"), (F.concat(*edges) if edges else F.array().cast(kind)).alias("relationships"))

    def edge_struct(self, v: Var) -> Column:
        return F.struct(*(self.col(v.props[k]).cast(t).alias(k) for k, t in (("_src", "bigint"), ("_dst", "bigint"), ("_label", "string"))), self.uid(v).alias("_uid"))

    def oriented(self, r: Rel, name: str) -> tuple[DataFrame, Var, str, str]:
        """Edges with a near and a far end; both orientations for undirected ones."""
        table, types = self.edge_table(r)
        names = {c: self.new(f"{name}.{c}") for c in table.columns}
        v = Var("edge", names["_eid"], names, tuple(types))
        near, far = self.new("near"), self.new("far")
        df = self.narrow(table.select(*(F.col(f"`{c}`").alias(x) for c, x in names.items())), r.props, r.where, name, v, r.types)
        src, dst = self.col(names["_src"]), self.col(names["_dst"])
        out = df.select("*", src.alias(near), dst.alias(far))
        back = df.select("*", dst.alias(near), src.alias(far))
        if r.direction == "out":
            return out, v, near, far
        if r.direction == "in":
            return back, v, near, far
        return out.union(back.where(src != dst)), v, near, far

    def hop(self, df: DataFrame, at: str, r: Rel, name: str, p: Path) -> tuple[DataFrame, Var, str]:
        side, v, near, far = self.oriented(r, name)
        return df.join(side, self.col(at) == self.col(near)).drop(near), v, far

    def hops(self, df: DataFrame, at: str, r: Rel, name: str, p: Path) -> tuple[DataFrame, Var, str]:
        """Bounded patterns are unrolled into joins; each depth grows the edge list."""
        low, high = r.hops
        column, end = self.new(name), self.new("end")
        side, v, near, far = self.oriented(Rel(None, r.types, r.props, r.where, r.direction), name)
        extra = [c for c in v.props if c not in ("_src", "_dst", "_eid", "_tid", "_lid", "_label")]
        item = F.struct(
            *(self.col(v.props[c]).alias(c) for c in ("_src", "_dst", "_label")), self.uid(v).alias("_uid"), self.col(far).alias("_to"), *(self.col(v.props[c]).alias(c) for c in extra)
        )
        step = side.select(self.col(near).alias("#near"), item.alias("#item"))
        kind = step.schema["#item"].dataType
        now = df.select("*", F.array().cast(T.ArrayType(kind)).alias(column), self.col(at).alias(end))
        out = now if low == 0 else None
        free = p.mode == "WALK"
        for k in range(1, (MAX_HOPS if high is None else high) + 1):
            grown = now.join(step, self.col(end) == F.col("`#near`"))
            if not free:
                grown = grown.where(~F.exists(self.col(column), lambda e: e["_uid"] == F.col("`#item`")["_uid"]))
            keep = [c for c in df.columns]
            now = grown.select(*(self.col(c) for c in keep), F.array_append(self.col(column), F.col("`#item`")).alias(column), F.col("`#item`")["_to"].alias(end))
            if high is None:  # written down, so the plan stays short and an empty depth ends it
                from loomgraph.plans.storage import materialise

                plain = {c: f"c{i}" for i, c in enumerate(now.columns)}
                held = materialise(now.select(*(self.col(c).alias(x) for c, x in plain.items())), "hops")
                now = held.select(*(F.col(x).alias(c) for c, x in plain.items()))
                if held.limit(1).count() == 0:
                    break
                if k == MAX_HOPS:
                    raise CypherError(f"an unbounded pattern still grows after {MAX_HOPS} hops; give it a bound")
            if k >= low:
                out = now if out is None else out.union(now)
        if out is None:
            out = now.limit(0)
        return out, Var("edges", column, {}, r.types), end

    # -- projection ---------------------------------------------------------
    def project(self, df: DataFrame | None, env: Env, c: Clause) -> tuple[DataFrame, Env]:
        d = c.data
        df = df if df is not None else self.one_row()
        items = [(("var", k), k) for k in env] if d["star"] else []
        items += d["items"]
        grouped = any(self.has_aggregate(e) for e, _ in items)
        last = c.kind == "return"
        if len({n for _, n in items}) < len(items):
            raise CypherError("two columns have the same name")
        if any(self.has_pattern(e) for e, _ in items):
            df, items = self.flags(df, env, items)
        order = d["order"]
        if grouped:
            df, after = self.aggregate(df, env, items)
        else:
            after, columns = {}, []
            for e, name in items:
                v = env.get(e[1]) if e[0] == "var" else None
                if v is not None and not last:
                    after[name] = v
                    columns += [x for x in {v.column, *v.props.values()} if x not in columns]
                else:
                    column = self.new(name)
                    after[name] = Var("value", column)
                    columns.append((self.expr(e, env, df), column))
            picked = [(x[0].alias(x[1]) if isinstance(x, tuple) else self.col(x)) for x in columns]
            hidden = []
            if order and not d["distinct"]:
                hidden = [x for x in df.columns if x not in {y if isinstance(y, str) else y[1] for y in columns}]
            df = df.select(*picked, *(self.col(x) for x in hidden))
        if d["distinct"]:
            df = df.distinct()
        scope = {**({} if grouped or d["distinct"] else env), **after}
        if order:
            keys = []
            for e, desc in order:
                text = next((n for x, n in items if x == e), None)
                column = self.expr(("var", text) if text is not None else e, scope, df)
                keys.append(column.desc_nulls_last() if desc else column.asc_nulls_first())
            df = df.orderBy(*keys)
        if d["skip"] is not None:
            df = df.offset(int(self.constant(d["skip"])))
        if d["limit"] is not None:
            df = df.limit(int(self.constant(d["limit"])))
        if last:
            return df.select(*(self.value(v).alias(n) for n, v in after.items())), after
        if d.get("where"):
            df = self.apply_where(df, d["where"], after)
        return df, after

    def value(self, v: Var) -> Column:
        if v.kind == "node":
            return F.when(self.col(v.column).isNotNull(), F.struct(*(self.col(x).alias(k) for k, x in v.props.items())))
        if v.kind == "edge":
            return F.when(self.col(v.column).isNotNull(), F.struct(*(self.col(x).alias(k) for k, x in v.props.items())))
        return self.col(v.column)

    def aggregate(self, df: DataFrame, env: Env, items: list) -> tuple[DataFrame, Env]:
        keys, wanted, after = [], [], {}
        calls: dict[tuple, str] = {}

        def lift(e: tuple) -> tuple:
            if not isinstance(e, tuple):
                return e
            if e and e[0] == "fn" and e[1] in AGGREGATES:
                if any(self.has_aggregate(a) for a in e[2]):
                    raise CypherError("an aggregate inside an aggregate")
                if e not in calls:
                    calls[e] = self.new("agg")
                return ("column", calls[e])
            return tuple(lift(x) if isinstance(x, tuple) else x for x in e)

        for e, name in items:
            column = self.new(name)
            if not self.has_aggregate(e):
                v = env.get(e[1]) if e[0] == "var" else None
                if v is not None and v.kind in ("node", "edge"):
                    keys += [self.col(x) for x in dict.fromkeys(v.props.values())]
                    after[name] = v
                else:
                    keys.append(self.expr(e, env, df).alias(column))
                    after[name] = Var("value", column)
            else:
                rest = lift(e)
                if self.free(rest):
                    raise CypherError(f"{', '.join(sorted(self.free(rest)))} has to be grouped by")
                wanted.append((rest, column))
                after[name] = Var("value", column)
        aggs = [self.agg(e, env, df).alias(x) for e, x in calls.items()]
        out = df.groupBy(*keys).agg(*aggs)
        return out.select("*", *(self.expr(e, {}, out).alias(x) for e, x in wanted)), after

    def agg(self, e: tuple, env: Env, df: DataFrame) -> Column:
        name, args, distinct = e[1], e[2], e[3]
        if name == "count" and args[0] == ("star",):
            return F.count(F.lit(1))
        if name == "count" and args[0][0] == "var" and env.get(args[0][1], Var("", "")).kind in ("node", "edge"):
            v = env[args[0][1]]
            x = self.col(v.column)
            if v.kind == "edge" and distinct:
                x = F.when(x.isNotNull(), self.uid(v))
        else:
            x = self.expr(args[0], env, df)
        if name == "count":
            return F.count_distinct(x) if distinct else F.count(x)
        if name == "collect":
            got = F.collect_list(x)
            return F.array_distinct(got) if distinct else got
        if name == "group_concat":
            return F.array_join(F.collect_list(x.cast("string")), ",")
        if name in ("max", "min"):
            kind = df.select(x.alias("x")).schema["x"].dataType
            x = x.cast("double") if isinstance(kind, T.NumericType) else x
            return F.max(x) if name == "max" else F.min(x)
        x = x.cast("double")
        if name == "sum":
            return F.coalesce(F.sum(x), F.lit(0.0))
        if name == "avg":
            return F.avg(x)
        if name.startswith("percentile"):
            p = float(self.constant(args[1]))
            if not 0 <= p <= 1:
                raise CypherError("a percentile lies between 0 and 1")
            if name == "percentilecont":
                return F.percentile(x, F.lit(p))
            held = F.sort_array(F.collect_list(x))
            return F.get(held, F.greatest(F.ceil(F.lit(p) * F.size(held)).cast("int") - 1, F.lit(0)))
        fn = {"stdev": F.stddev_samp, "stdevp": F.stddev_pop, "variance": F.var_samp, "variancep": F.var_pop}[name]
        return F.coalesce(fn(x), F.lit(0.0))

    # -- patterns as predicates --------------------------------------------
    def has_pattern(self, e: object) -> bool:
        """Something that takes a join of its own: a pattern or a read of a series."""
        if not isinstance(e, tuple) or not e:
            return False
        return e[0] in ("pattern", "pattern_comprehension") or self.is_series(e) or any(self.has_pattern(x) for x in e)

    def is_series(self, e: tuple) -> bool:
        if e[0] == "fn" and isinstance(e[1], str) and e[1].startswith(("series.", "series_")):
            return True
        return e[0] == "prop" and e[1][0] == "var" and any(f == e[2] for _, f in self.graph.series)

    def series(self, e: tuple, env: Env, df: DataFrame) -> tuple[DataFrame, str]:
        """``df`` with the value of a series function, joined by its element."""
        name = e[1][7:] if e[0] == "fn" else "summary"
        subject, args = (e[2][0], e[2][1:]) if e[0] == "fn" else (e[1], (("lit", e[2]),))
        v = env.get(subject[1]) if subject[0] == "var" else None
        if v is None or v.kind not in ("node", "edge"):
            raise CypherError("a series belongs to a node or an edge")
        wanted = str(self.constant(args[0]))
        tables = [t for (label, f), t in self.graph.series.items() if f == wanted and (not v.labels or label in v.labels)]
        if not tables:
            raise SchemaError(f"no series field {wanted}")
        table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
        rest = list(args[1:])
        if name == "summary":
            found, empty = series_functions.summary(table), None
        else:
            lead = [self.constant(rest.pop(0))] if name in ("sum", "mean", "min", "max") else []
            found, empty = series_functions.read(table, name, [*lead, *(self.expr(x, {}, df).cast("timestamp_ntz") for x in rest)])
        key, value = self.new("element"), self.new("series")
        found = found.select(F.col("element").alias(key), F.col("value").alias(value))
        own = self.col(v.column) if v.kind == "node" else self.uid(v)
        columns = df.columns
        held = self.col(value) if empty is None else F.coalesce(self.col(value), empty)
        out = df.join(found, own == self.col(key), "left").select(*(self.col(c) for c in columns), held.alias(value))
        return out, value

    def apply_where(self, df: DataFrame, e: tuple, env: Env) -> DataFrame:
        for w in self.split_and(e):
            negative = w[0] == "not" and w[1][0] == "pattern"
            if w[0] == "pattern" or negative:
                df = self.semi(df, w[1][1] if negative else w[1], env, "left_anti" if negative else "left_semi")
            elif self.has_pattern(w):
                more, items = self.flags(df, env, [(w, "#w")])
                df = more.where(self.condition(items[0][0], env, more)).select(*(self.col(c) for c in df.columns))
            else:
                df = df.where(self.condition(w, env, df))
        return df

    def semi(self, df: DataFrame, p: Path, env: Env, how: str) -> DataFrame:
        part, own, _ = self.path(p, env)
        shared = [k for k in own if k in env]
        if not shared:
            raise CypherError("a pattern predicate needs a variable from outside")
        return df.join(part, self.all_of([self.same(env[k], own[k]) for k in shared]), how)

    def flags(self, df: DataFrame, env: Env, items: list) -> tuple[DataFrame, list]:
        """Replace patterns inside expressions by columns."""
        made: dict[tuple, str] = {}

        def lift(e: tuple) -> tuple:
            nonlocal df
            if not isinstance(e, tuple):
                return e
            if e and self.is_series(e):
                if e not in made:
                    df, made[e] = self.series(e, env, df)
                return ("column", made[e])
            if e and e[0] in ("pattern", "pattern_comprehension"):
                if e not in made:
                    made[e] = self.new("flag")
                    part, own, _ = self.path(e[1], env)
                    shared = [k for k in own if k in env]
                    ids = [self.new("id") for _ in shared]
                    if e[0] == "pattern_comprehension":
                        scope = {**own}
                        if e[2]:
                            part = part.where(self.condition(e[2], scope, part))
                        side = part.groupBy(*(self.col(own[k].column).alias(x) for k, x in zip(shared, ids))).agg(F.collect_list(self.expr(e[3], scope, part)).alias(made[e]))
                    else:
                        side = part.select(*(self.col(own[k].column).alias(x) for k, x in zip(shared, ids))).distinct().withColumn(made[e], F.lit(True))
                    columns = df.columns
                    value = self.col(made[e])
                    if e[0] == "pattern_comprehension":
                        value = F.coalesce(value, F.array().cast(side.schema[made[e]].dataType)).alias(made[e])
                    df = df.join(side, self.all_of([self.col(env[k].column) == self.col(x) for k, x in zip(shared, ids)]), "left").select(*(self.col(c) for c in columns), value)
                return ("flag", made[e]) if e[0] == "pattern" else ("column", made[e])
            return tuple(lift(x) if isinstance(x, tuple) else x for x in e)

        lifted = [(lift(e), n) for e, n in items]
        return df, lifted

    # -- expressions --------------------------------------------------------
    def has_aggregate(self, e: object) -> bool:
        if isinstance(e, tuple) and e and e[0] == "window":
            return False
        return isinstance(e, tuple) and (len(e) > 2 and e[0] == "fn" and e[1] in AGGREGATES or any(self.has_aggregate(x) for x in e))

    def free(self, e: object, bound: frozenset = frozenset()) -> set[str]:
        if not isinstance(e, tuple) or not e:
            return set()
        if e[0] == "var":
            return set() if e[1] in bound else {e[1]}
        if e[0] in ("lit", "param", "column", "flag"):
            return set()
        if e[0] == "comprehension":
            inner = bound | {e[1]}
            return self.free(e[2], bound) | self.free(e[3], inner) | self.free(e[4], inner)
        if e[0] == "quantified":
            return self.free(e[3], bound) | self.free(e[4], bound | {e[2]})
        if e[0] == "pattern":
            return {x.var for x in e[1].parts if x.var}
        return set().union(*(self.free(x, bound) for x in e[1:])) if len(e) > 1 else set()

    def is_constant(self, e: tuple) -> bool:
        try:
            self.constant(e)
            return True
        except CypherError:
            return False

    def constant(self, e: tuple) -> object:
        kind = e[0]
        if kind == "lit":
            return e[1]
        if kind == "param":
            if e[1] not in self.params:
                raise CypherError(f"no parameter ${e[1]}")
            return self.params[e[1]]
        if kind == "neg":
            return -self.constant(e[1])
        if kind == "list":
            return [self.constant(x) for x in e[1]]
        if kind == "map":
            return {k: self.constant(x) for k, x in e[1]}
        raise CypherError("a constant is needed here")

    def condition(self, e: tuple, env: Env, df: DataFrame | None) -> Column:
        """For filters and joins, which drop a null by themselves: bare, so that scans can use it."""
        return self.expr(e, env, df).cast("boolean")

    def truth(self, e: tuple, env: Env, df: DataFrame | None) -> Column:
        return F.coalesce(self.expr(e, env, df).cast("boolean"), F.lit(False))

    def literal(self, x: object) -> Column:
        if isinstance(x, (list, tuple)):
            return F.array(*(self.literal(y) for y in x)) if x else F.array().cast("array<string>")
        if isinstance(x, dict):
            return F.struct(*(self.literal(v).alias(k) for k, v in x.items()))
        return F.lit(x)

    def kind(self, x: Column, df: DataFrame | None) -> T.DataType | None:
        if df is None:
            return None
        try:
            return df.select(x.alias("x")).schema["x"].dataType
        except Exception as e:  # lambda variables have no type outside their function
            if "UNRESOLVED" in str(e) or "lambda" in str(e).lower():
                return None
            raise

    def expr(self, e: tuple, env: Env, df: DataFrame | None) -> Column:
        kind = e[0]
        go = lambda x: self.expr(x, env, df)
        if kind == "lit":
            return F.lit(e[1])
        if kind == "param":
            return self.literal(self.constant(e))
        if kind == "column":
            return self.col(e[1])
        if kind == "flag":
            return self.col(e[1]).isNotNull()
        if kind == "var":
            v = env.get(e[1])
            if v is None:
                raise CypherError(f"no variable {e[1]}")
            return v if isinstance(v, Column) else self.value(v)
        if kind == "prop":
            return self.property(e, env, df)
        if kind == "not":
            return ~self.truth(e[1], env, df)
        if kind == "neg":
            return -go(e[1])
        if kind == "isnull":
            return go(e[1]).isNull()
        if kind == "haslabel":
            v = env.get(e[1][1])
            if not isinstance(v, Var) or "_label" not in v.props:
                raise CypherError("a label test needs a node or an edge")
            return self.col(v.props["_label"]).isin(*e[2])
        if kind == "list":
            return F.array(*(go(x) for x in e[1])) if e[1] else F.array().cast("array<string>")
        if kind == "map":
            return F.struct(*(go(x).alias(k) for k, x in e[1]))
        if kind == "index":
            return index(go(e[1]), go(e[2]))
        if kind == "slice":
            return cut(go(e[1]), go(e[2]) if e[2] else None, go(e[3]) if e[3] else None)
        if kind == "case":
            return self.case(e, env, df)
        if kind == "comprehension":
            _, var, source, where, out = e
            xs = go(source)
            if where:
                xs = F.filter(xs, lambda x: self.truth(where, {**env, var: x}, None))
            return F.transform(xs, lambda x: self.expr(out, {**env, var: x}, None)) if out else xs
        if kind == "quantified":
            _, name, var, source, where = e
            test = lambda x: self.truth(where, {**env, var: x}, None)
            xs = go(source)
            if name == "all":
                return F.forall(xs, test)
            if name == "single":
                return F.size(F.filter(xs, test)) == 1
            return F.exists(xs, test) if name == "any" else ~F.exists(xs, test)
        if kind == "op":
            return self.operator(e, env, df)
        if kind == "window":
            return self.window(e, env, df)
        if kind == "fn":
            return self.function(e, env, df)
        raise CypherError(f"cannot plan {kind}")

    def window(self, e: tuple, env: Env, df: DataFrame | None) -> Column:
        _, call, parts, orders = e
        keys = [self.expr(x, env, df) for _, x, _ in orders[1:]]
        by = [k.desc_nulls_last() if o[2] else k.asc_nulls_first() for k, o in zip(keys, orders[1:])]
        w = Window.partitionBy(*(self.expr(x, env, df) for x in parts[1:]))
        w = w.orderBy(*by) if by else w
        name = call[1]
        if name in RANKS:
            return RANKS[name]().over(w)
        if call[3] or name not in ("count", "sum", "avg", "max", "min", "collect"):
            raise CypherError(f"{name} is no window function")
        if name == "sum":
            return F.coalesce(F.sum(self.expr(call[2][0], env, df).cast("double")).over(w), F.lit(0.0))
        return self.agg(call, env, df).over(w)

    def case(self, e: tuple, env: Env, df: DataFrame | None) -> Column:
        _, subject, branches, other = e
        out = None
        for when, then in branches:
            test = self.expr(subject, env, df).eqNullSafe(self.expr(when, env, df)) if subject else self.truth(when, env, df)
            value = self.expr(then, env, df)
            out = F.when(test, value) if out is None else out.when(test, value)
        return out.otherwise(self.expr(other, env, df)) if other else out

    def property(self, e: tuple, env: Env, df: DataFrame | None) -> Column:
        base = e[1]
        v = env.get(base[1]) if base[0] == "var" else None
        if isinstance(v, Var) and v.kind in ("node", "edge"):
            if e[2] in v.props and not e[2].startswith("_"):
                return self.col(v.props[e[2]])
            return F.lit(None)
        return self.expr(base, env, df)[e[2]]

    def operator(self, e: tuple, env: Env, df: DataFrame | None) -> Column:
        _, op, left, right = e
        if op in ("AND", "OR", "XOR"):
            a, b = self.truth(left, env, df), self.truth(right, env, df)
            return a & b if op == "AND" else a | b if op == "OR" else a != b
        a, b = self.expr(left, env, df), self.expr(right, env, df)
        if op == "=":
            both = left != ("lit", None) and right != ("lit", None)
            return a.eqNullSafe(b) if not (both and (left[0] == "lit" or right[0] == "lit")) else F.coalesce(a == b, F.lit(False))
        if op == "<>":
            return ~a.eqNullSafe(b)
        if op in ("<", "<=", ">", ">="):
            return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        if op == "IN":
            if right[0] == "list":
                return a.isin(*[self.expr(x, env, df) for x in right[1]]) if right[1] else F.lit(False)
            return F.array_contains(b, a)
        if op == "STARTS":
            return a.startswith(b)
        if op == "ENDS":
            return a.endswith(b)
        if op == "CONTAINS":
            return a.contains(b)
        if op == "=~":
            return F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$")))
        if op == "+":
            ka, kb = self.kind(a, df), self.kind(b, df)
            if isinstance(ka, T.ArrayType) or isinstance(kb, T.ArrayType):
                xs = [x if isinstance(k, T.ArrayType) else F.array(x) for x, k in ((a, ka), (b, kb))]
                return F.concat(*xs)
            if isinstance(ka, T.StringType) or isinstance(kb, T.StringType):
                return F.concat(a.cast("string"), b.cast("string"))
            return a + b
        if op == "/":
            return a / b
        return {"-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b, "^": lambda: F.pow(a.cast("double"), b.cast("double"))}[op]()

    def function(self, e: tuple, env: Env, df: DataFrame | None) -> Column:
        _, name, args, _ = e
        v = env.get(args[0][1]) if args and args[0][0] == "var" else None
        v = v if isinstance(v, Var) else None
        if v is not None and v.kind in ("node", "edge"):
            if name == "id":
                return self.col(v.column)
            if name in ("label", "type"):
                return self.col(v.props["_label"])
            if name == "labels":
                return F.array(self.col(v.props["_label"]))
            if name == "euid":
                return self.uid(v)
            if name in ("startnode", "endnode"):
                return self.col(v.props["_src" if name == "startnode" else "_dst"])
            own = {k: x for k, x in v.props.items() if not k.startswith("_")}
            if name == "keys":
                return F.filter(F.array(*(F.when(self.col(x).isNotNull(), F.lit(k)) for k, x in own.items())), lambda k: k.isNotNull()) if own else F.array().cast("array<string>")
            if name == "properties":
                return F.to_json(F.struct(*(self.col(x).alias(k) for k, x in own.items()))) if own else F.lit("{}")
        if v is not None and v.kind == "path":
            p = self.col(v.column)
            if name == "nodes":
                return p["nodes"]
            if name == "relationships":
                return p["relationships"]
            if name == "length":
                return F.size(p["relationships"])
        if v is not None and v.kind == "edges" and name in ("size", "length"):
            return F.size(self.col(v.column))
        if name == "exists" and args:
            return self.expr(args[0], env, df).isNotNull()
        if name == "getmemberprop":
            return F.transform(self.expr(args[0], env, df), lambda x: x[self.constant(args[1])])
        if name in ("size", "reverse", "tostring", "tointeger", "toint"):
            x = self.expr(args[0], env, df)
            kind = self.kind(x, df)
            if name == "size":
                return F.length(x) if isinstance(kind, T.StringType) else F.size(x)
            if name == "reverse":
                return F.reverse(x)
            if name == "tostring":
                return to_string(x, kind)
            return x.cast("double").cast("bigint") if isinstance(kind, T.StringType) else x.cast("bigint")
        fn = FUNCTIONS.get(name)
        if fn is None:
            raise CypherError(f"no function {name}")
        return fn(*(self.expr(a, env, df) for a in args))
