"""Import graphs: cycles, entry depth, modules and neighbourhoods.

Graphs of at most LOCAL edges are walked in one task; larger ones by rounds of joins whose steps are written to the shared
folder.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestrata.functions.paths import basename, group_key
from lodestrata.operators.metrics import dominant
from lodestrata.storage import saved

LOCAL = 200_000


def _small(edges: DataFrame, limit: int | None) -> bool:
    limit = LOCAL if limit is None else limit
    return edges.limit(limit + 1).count() <= limit


def _strong(pairs) -> list[list]:
    """Strongly connected components of more than one node, without recursion."""
    after, before = defaultdict(list), defaultdict(list)
    for a, b in pairs:
        after[a].append(b)
        before[b].append(a)
    order, seen = [], set()
    for root in list(after):
        if root in seen:
            continue
        seen.add(root)
        path = [(root, iter(after[root]))]
        while path:
            node, rest = path[-1]
            for x in rest:
                if x not in seen:
                    seen.add(x)
                    path.append((x, iter(after[x] if x in after else ())))
                    break
            else:
                order.append(node)
                path.pop()
    out, done = [], set()
    for root in reversed(order):
        if root in done:
            continue
        done.add(root)
        group, todo = [], [root]
        while todo:
            node = todo.pop()
            group.append(node)
            for x in before[node] if node in before else ():
                if x not in done:
                    done.add(x)
                    todo.append(x)
        if len(group) > 1:
            out.append(sorted(group))
    return out


def find_cycles(edges: DataFrame, local: int | None = None) -> DataFrame:
    """(nodes, size): components of more than one node that reach each other, and a row for each edge to itself."""
    loops = edges.where("`from` = `to`").select(F.array("from").alias("nodes"), F.lit(1).cast("long").alias("size"))
    pairs = edges.where("`from` <> `to`").select(F.col("from").alias("a"), F.col("to").alias("b")).distinct()
    if _small(pairs, local):
        kind = edges.schema["from"].dataType.simpleString()

        def run(frames):
            rows = [x for f in frames for x in zip(f["a"], f["b"])]
            groups = _strong(rows)
            if groups:
                yield pd.DataFrame({"nodes": groups, "size": [len(g) for g in groups]})

        return loops.unionByName(pairs.coalesce(1).mapInPandas(run, f"nodes array<{kind}>, size long"))
    comp = strong_components(pairs, local)
    many = comp.groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("nodes"))
    return loops.unionByName(many.select("nodes", F.size("nodes").cast("long").alias("size")).where("size > 1"))


def strong_components(pairs: DataFrame, local: int | None = None) -> DataFrame:
    """(id, component) of nodes on rings, for pairs (a, b) of any number: chains made single edges, trimming, and of what is left
    weak components of at most `local` edges (LOCAL) each in one task; in larger ones colouring by the largest node that reaches
    each, and a walk back from each colour's root, until that many edges are left in all. A component is named by one of its nodes. Joins of the rounds are merged: small ones would
    be sent to the driver, each up to the size that Spark broadcasts, in every round."""
    left, levels = saved(pairs, "scc"), []
    out, kind = None, pairs.schema["a"].dataType.simpleString()

    def finish(frames):
        groups = _strong([x for f in frames for x in zip(f["a"], f["b"])])
        if groups:
            yield pd.DataFrame([(x, g[-1]) for g in groups for x in g], columns=["id", "component"])

    def finish_each(frames):
        # Rows come sorted by weak component; rest: those of the last one, which may go on.
        rest = []
        for f in frames:
            if len(f):
                last = f["weak"] == f["weak"].iloc[-1]
                ended = bool(rest) and rest[0]["weak"].iloc[0] != f["weak"].iloc[0]
                if ended or not last.all():
                    yield from finish([*rest, f[~last]])
                    rest = []
                rest.append(f[last])
        yield from finish(rest)

    while True:
        left, chains, rings = _shortened(left)
        levels.append(chains)
        out = rings if out is None else out.unionByName(rings)
        n = left.count()
        while True:  # a node without a way in or out is alone
            kept = left.join(left.select(F.col("b").alias("a")).distinct().hint("merge"), "a", "left_semi")
            kept = saved(kept.join(kept.select(F.col("a").alias("b")).distinct().hint("merge"), "b", "left_semi"), "scc")
            left, before, n = kept, n, kept.count()
            if n == before:
                break
        if left.isEmpty():
            break
        if _small(left, local):
            out = out.unionByName(left.coalesce(1).mapInPandas(finish, f"id {kind}, component {kind}"))
            break
        labels = _weak(left)
        parts = saved(left.join(labels.withColumnRenamed("id", "a").hint("merge"), "a"), "scc")
        large = parts.groupBy("weak").agg(F.count("*").alias("n")).where(F.col("n") > (LOCAL if local is None else local)).select("weak")
        each = parts.join(large.hint("merge"), "weak", "left_anti").repartition("weak").sortWithinPartitions("weak")
        out = out.unionByName(saved(each.mapInPandas(finish_each, f"id {kind}, component {kind}"), "scc"))
        left = saved(parts.join(large.hint("merge"), "weak", "left_semi").select("a", "b"), "scc")
        if left.isEmpty():
            break
        colour = saved(left.select(F.col("a").alias("id")).union(left.select("b")).distinct().withColumn("c", F.col("id")), "scc")
        while True:
            up = left.join(colour.withColumnRenamed("id", "a").hint("merge"), "a").groupBy(F.col("b").alias("id")).agg(F.max("c").alias("m"))
            new = saved(colour.join(up.hint("merge"), "id", "left").select("id", F.greatest("c", "m").alias("c"), (F.col("m") > F.col("c")).alias("moved")), "scc")
            colour = new.select("id", "c")
            if new.where("moved").isEmpty():
                break
        ca, cb = colour.select(F.col("id").alias("a"), F.col("c").alias("ca")), colour.select(F.col("id").alias("b"), F.col("c").alias("cb"))
        inside = saved(left.join(ca.hint("merge"), "a").join(cb.hint("merge"), "b").where("ca = cb").select("a", "b", F.col("ca").alias("c")), "scc")
        found = saved(colour.where("id = c"), "scc")
        front = found
        while True:
            front = inside.join(front.select(F.col("id").alias("b")).hint("merge"), "b", "left_semi").select(F.col("a").alias("id"), "c").distinct()
            front = saved(front.join(found.hint("merge"), "id", "left_anti"), "scc")
            if front.isEmpty():
                break
            found = saved(found.unionByName(front), "scc")
        many = found.groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
        out = out.unionByName(found.join(many.hint("merge"), "c", "left_semi").select("id", F.col("c").alias("component")))
        gone = found.select("id")
        left = saved(left.join(gone.withColumnRenamed("id", "a").hint("merge"), "a", "left_anti").join(gone.withColumnRenamed("id", "b").hint("merge"), "b", "left_anti"), "scc")
    for chains in reversed(levels):  # a chain is of its ends' component, if that is the same
        comp = saved(out, "components")
        of = lambda end: comp.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"))  # noqa: E731,B023
        ends = chains.join(of("head").hint("merge"), "head", "left").join(of("tail").hint("merge"), "tail", "left").withColumn("c", F.coalesce("c_head", "head")).where(F.col("c") == F.coalesce("c_tail", "tail"))
        alone = ends.where("c_head IS NULL").select(F.col("head").alias("id"), F.col("c").alias("component")).distinct()
        out = comp.unionByName(ends.select("id", F.col("c").alias("component"))).unionByName(alone)
    return out


def _weak(pairs: DataFrame) -> DataFrame:
    """(id, weak): nodes with the least node that ways in either direction lead to. In each round a node and what it hangs on take the least
    that a neighbour hangs on, then each hangs on what that hangs on: about as many rounds as the logarithm of the longest way."""
    both = saved(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "weak")
    state = saved(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("weak")), "weak")
    while True:
        near = both.join(state.select(F.col("id").alias("b"), "weak").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("weak").alias("m"))
        step = state.select("id", "weak").join(near.hint("merge"), "id").select("id", "weak", F.least("weak", "m").alias("m"))
        told = step.select("id", "m", F.col("weak").alias("was")).union(step.select("weak", "m", F.lit(None)))
        new = saved(told.groupBy("id").agg(F.min("m").alias("weak"), F.max("was").alias("was")), "weak")
        on = new.select(F.col("id").alias("weak"), F.col("weak").alias("next"))
        state = saved(new.join(on.hint("merge"), "weak").select("id", F.col("next").alias("weak"), (F.col("next") != F.col("was")).alias("moved")), "weak")
        if state.where("moved").isEmpty():
            return state.select("id", "weak")


def _shortened(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, chains, rings): pairs with each chain of nodes that have one way in and one way out as a single edge. chains:
    (id, head, tail) of the nodes taken out; rings: (id, component) of rings of such nodes only. Each round doubles how far
    the nodes see back, so a chain of n takes log(n) rounds."""
    ways = pairs.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("i"), F.min("a").alias("before")).join(pairs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("o"), F.min("b").alias("after")).hint("merge"), "id")
    plain = saved(ways.where("i = 1 AND o = 1").select("id", "before", "after"), "plain")
    ids = plain.select("id", F.lit(True).alias("p"))
    ends = plain.join(ids.withColumnRenamed("id", "before").withColumnRenamed("p", "pb").hint("merge"), "before", "left").join(ids.withColumnRenamed("id", "after").withColumnRenamed("p", "pa").hint("merge"), "after", "left")
    # to: the node that one hangs on so far; first: the last plain one before it; top: the greatest on the way.
    seen = saved(ends.select("id", F.col("before").alias("to"), F.col("id").alias("first"), F.col("id").alias("top"), F.col("pb").isNull().alias("done"), F.when(F.col("pa").isNull(), F.col("after")).alias("tail")), "seen")
    left = seen.count()
    while left > 0 and not seen.where("NOT done").isEmpty():
        on = seen.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("first").alias("first2"), F.col("top").alias("top2"), F.col("done").alias("done2"))
        far = seen.where("NOT done").join(on.hint("merge"), "to").select("id", F.col("to2").alias("to"), F.col("first2").alias("first"), F.greatest("top", "top2").alias("top"), F.col("done2").alias("done"), "tail")
        seen = saved(seen.where("done").unionByName(far), "seen")
        left //= 2
    tails = seen.where("done AND tail IS NOT NULL").select("first", F.col("to").alias("head"), "tail")
    chains = saved(seen.where("done").select("id", "first").join(tails.hint("merge"), "first").select("id", "head", "tail"), "chains")
    rings = saved(seen.where("NOT done").select("id", F.col("top").alias("component")), "rings")
    other = pairs.join(plain.select(F.col("id").alias("a")).hint("merge"), "a", "left_anti").join(plain.select(F.col("id").alias("b")).hint("merge"), "b", "left_anti").select("a", "b")
    short = tails.where("head <> tail").select(F.col("head").alias("a"), F.col("tail").alias("b"))
    return saved(other.unionByName(short).distinct(), "short"), chains, rings


def entry_depths(nodes: DataFrame, edges: DataFrame, local: int | None = None, most: int | None = None) -> DataFrame:
    """nodes with depth_from_entry: the largest, over entry points, of the shortest way from one; 0 where none leads. Ways of
    more than `most` steps don't count, if that is given."""
    pairs = edges.select(F.col("from").alias("a"), F.col("to").alias("b")).distinct()
    entries = nodes.where("is_entry_point").select("id")
    if _small(pairs, local) and _small(entries, 10_000 if local is None else local):
        roots = entries.select(F.col("id").alias("a"), F.lit(None).cast(nodes.schema["id"].dataType).alias("b"))

        def run(frames):
            after, starts, deep = defaultdict(list), [], {}
            for f in frames:
                for a, b in zip(f["a"], f["b"]):
                    starts.append(a) if pd.isna(b) else after[a].append(b)
            for s in starts:
                at, todo = {s: 0}, deque([s])
                while todo:
                    x = todo.popleft()
                    deep[x] = max(deep.get(x, 0), at[x])
                    for y in after.get(x, ()) if most is None or at[x] < most else ():
                        if y not in at:
                            at[y] = at[x] + 1
                            todo.append(y)
            if deep:
                yield pd.DataFrame({"id": list(deep), "depth_from_entry": list(deep.values())})

        depth = pairs.unionByName(roots).coalesce(1).mapInPandas(run, f"id {nodes.schema['id'].dataType.simpleString()}, depth_from_entry int")
    else:
        depth = _depths_by_words(entries, pairs, most)
    return nodes.drop("depth_from_entry").join(depth, "id", "left").fillna(0, ["depth_from_entry"])


def _depths_by_words(entries: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """(id, depth_from_entry): 64 entry points walk at once, a bit each of a word, so there are nodes x entries / 64 rows. A
    node's depth is the last round in which an entry came to it that hadn't been there."""
    part = saved(entries.distinct().withColumn("p", F.spark_partition_id()), "entries")
    n = F.row_number().over(W.partitionBy("p").orderBy("id")) - 1  # dense in each partition, so no task counts all
    place = (F.shiftleft(F.col("p").cast("long"), 40) + F.shiftright("n", 6)).alias("word")
    first = part.withColumn("n", n).select("id", place, F.expr("shiftleft(1L, n % 64)").alias("new"))
    state, round_ = saved(first.withColumn("seen", F.col("new")).withColumn("d", F.lit(0)), "depth"), 0
    while True:
        front, round_ = state.where("new <> 0").select("id", "word", "new"), round_ + 1
        if most is not None and round_ > most or front.isEmpty():
            return state.groupBy("id").agg(F.max("d").alias("depth_from_entry"))
        step = front.join(pairs, front.id == pairs.a).groupBy(F.col("b").alias("id"), "word").agg(F.bit_or("new").alias("got"))
        both = state.select("id", "word", "seen", "d").join(step, ["id", "word"], "full_outer").fillna(0, ["seen", "got", "d"])
        new = F.col("got").bitwiseAND(F.bitwise_not(F.col("seen")))
        state = saved(both.select("id", "word", new.alias("new"), F.col("seen").bitwiseOR(F.col("got")).alias("seen"), F.when(new != 0, round_).otherwise(F.col("d")).alias("d")), "depth")


def module_edges(edges: DataFrame, depth: int = 2) -> DataFrame:
    a, b = group_key(F.col("from"), depth), group_key(F.col("to"), depth)
    return edges.select(a.alias("source"), b.alias("target")).where("source <> target").groupBy("source", "target").agg(F.count("*").alias("weight"))


def module_graph(nodes: DataFrame, edges: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Modules (ids m0, m1 and on by name) and weighted edges between them."""
    keyed = nodes.withColumn("module", group_key(F.col("id"), depth))
    size = keyed.groupBy("module").agg(F.count("*").alias("file_count"), F.sum("loc").alias("loc"), F.bool_or("is_entry_point").alias("is_entry"))
    modules = size.join(dominant(keyed, ["module"], "language"), "module").withColumn("id", F.concat(F.lit("m"), F.row_number().over(W.orderBy("module")) - 1))  # modules are few
    return modules, module_edges(edges, depth)


def file_graph(nodes: DataFrame, edges: DataFrame, top: int = 60, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """The files of the highest degree, and the edges among them."""
    kept = nodes.orderBy((F.col("in_degree") + F.col("out_degree")).desc(), F.desc("loc"), "id").limit(top)
    ids = kept.select("id")
    among = edges.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")
    shown = kept.select("id", basename(F.col("id")).alias("label"), group_key(F.col("id"), depth).alias("sublabel"), "language", F.lit(1).alias("file_count"), "loc", F.col("is_entry_point").alias("is_entry"))
    return shown, among.select(F.col("from").alias("source"), F.col("to").alias("target"), F.lit(1).alias("weight"))


def directory_summary(nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    size = nodes.groupBy(group_key(F.col("id"), depth).alias("path")).agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    e = edges.select(group_key(F.col("from"), depth).alias("a"), group_key(F.col("to"), depth).alias("b"))
    out = e.groupBy(F.col("a").alias("path")).agg(F.count("*").alias("out_edges"), F.count_if(F.col("a") != F.col("b")).alias("cross_edges"))
    into = e.groupBy(F.col("b").alias("path")).agg(F.count("*").alias("in_edges"))
    return size.join(out, "path", "left").join(into, "path", "left").fillna(0).select("path", "files", "loc", "in_edges", "out_edges", "cross_edges")


def module_detail(nodes: DataFrame, edges: DataFrame, module: str, depth: int = 2) -> dict[str, DataFrame]:
    """Files of a module, and the modules that it is used by and that it uses."""
    w = module_edges(edges, depth)
    return {
        "files": nodes.where(group_key(F.col("id"), depth) == module).orderBy("id"),
        "incoming": w.where(F.col("target") == module).select(F.col("source").alias("module"), "weight").orderBy(F.desc("weight"), "module"),
        "outgoing": w.where(F.col("source") == module).select(F.col("target").alias("module"), "weight").orderBy(F.desc("weight"), "module"),
    }


def function_of_lines(lines: DataFrame, functions: DataFrame, keys: list[str], bucket: int = 256) -> DataFrame:
    """lines (file, line, keys) with in_function: the outermost function around the line. Joined by file and bucket of lines,
    so a long file doesn't pair all its lines with all its functions."""
    covered = F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.greatest("start_line", "end_line") / bucket))).alias("_b")
    f = functions.select(F.col("file").alias("_f"), F.col("name").alias("in_function"), "start_line", "end_line", covered)
    hit = lines.join(f, (lines.file == f._f) & (F.floor(lines.line / bucket) == f._b) & lines.line.between(f.start_line, f.end_line))
    best = hit.groupBy("file", "line", *keys).agg(F.min_by("in_function", F.struct("start_line", -F.col("end_line"))).alias("in_function"))
    return lines.join(best, ["file", "line", *keys], "left")


def file_dsm(file: str, nodes: DataFrame, edges: DataFrame, raw: DataFrame, functions: DataFrame) -> dict[str, DataFrame]:
    """What uses a file and what it uses, with the functions at both ends, and specifiers that didn't resolve."""
    own = edges.where((F.col("to") == file) | (F.col("from") == file))
    placed = function_of_lines(own.select(F.col("from").alias("file"), "line", "to"), functions, ["to"])
    externals = raw.where(F.col("from") == file).join(edges.where(F.col("from") == file).select("line"), "line", "left_anti")
    return {
        "node": nodes.where(F.col("id") == file),
        "inbound": placed.where(F.col("to") == file).select(F.col("file").alias("from"), "line", "in_function"),
        "outbound": placed.where(F.col("file") == file).select("to", "line", "in_function"),
        "externals": externals.select("to", "line", "kind"),
        "functions": functions.where(F.col("file") == file),
    }
