"""Symbol occurrences: call edges by containment, callers, callees, impact and traces.

Occurrences have a range and, for definitions, an enclosing range. A reference belongs to the tightest definition of its
document that encloses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.metrics import page
from lodestrata.storage import saved

#: Lines of a bucket: a definition is joined by the buckets that it covers instead of with every reference of a document.
BUCKET = 256
CAP = 200


def _at(line: str, char: str) -> Column:
    return F.struct(F.col(line), F.col(char))


def enclosing(occurrences: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Each reference with the tightest definition around it: (doc, ref, callee, start_line, caller)."""
    span = F.struct(F.col("enc_end_line") - F.col("enc_start_line"), F.col("enc_end_char") - F.col("enc_start_char"), "occ", "symbol")
    defs = occurrences.where("is_def AND enc_start_line IS NOT NULL").select(
        "doc", F.col("symbol").alias("caller"), span.alias("span"), "enc_start_line", "enc_start_char", "enc_end_line", "enc_end_char",
        F.explode(F.sequence(F.floor(F.col("enc_start_line") / bucket), F.floor(F.col("enc_end_line") / bucket))).alias("b"),
    )
    refs = occurrences.where("NOT is_def").select("doc", F.col("occ").alias("ref"), F.col("symbol").alias("callee"), "start_line", "start_char", "end_line", "end_char", F.floor(F.col("start_line") / bucket).alias("b"))
    inside = (_at("enc_start_line", "enc_start_char") <= _at("start_line", "start_char")) & (_at("enc_end_line", "enc_end_char") >= _at("end_line", "end_char"))
    return refs.join(defs, ["doc", "b"]).where(inside).groupBy("doc", "ref", "callee", "start_line").agg(F.min_by("caller", "span").alias("caller"))


def call_edges(placed: DataFrame) -> DataFrame:
    """(caller, callee, sites)."""
    return placed.groupBy("caller", "callee").agg(F.count("*").alias("sites"))


def callers(edges: DataFrame, symbol: str) -> DataFrame:
    return edges.where(F.col("callee") == symbol).select(F.col("caller").alias("symbol"), "sites").orderBy(F.desc("sites"), "symbol")


def contained(occurrences: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(caller, callee): every reference inside a definition's enclosing range, not just of the tightest; no self."""
    defs = occurrences.where("is_def AND enc_start_line IS NOT NULL").select(
        "doc", F.col("symbol").alias("caller"), "enc_start_line", "enc_start_char", "enc_end_line", "enc_end_char",
        F.explode(F.sequence(F.floor(F.col("enc_start_line") / bucket), F.floor(F.col("enc_end_line") / bucket))).alias("b"),
    )
    refs = occurrences.where("NOT is_def").select("doc", F.col("symbol").alias("callee"), "start_line", "start_char", "end_line", "end_char", F.floor(F.col("start_line") / bucket).alias("b"))
    inside = (_at("enc_start_line", "enc_start_char") <= _at("start_line", "start_char")) & (_at("enc_end_line", "enc_end_char") >= _at("end_line", "end_char"))
    return refs.join(defs, ["doc", "b"]).where(inside & (F.col("caller") != F.col("callee"))).select("caller", "callee").distinct()


def callees(occurrences: DataFrame, symbol: str) -> DataFrame:
    return contained(occurrences).where(F.col("caller") == symbol).select(F.col("callee").alias("symbol")).orderBy("symbol")


def top_symbols(occurrences: DataFrame, n: int = 50) -> DataFrame:
    return occurrences.groupBy("symbol").agg(F.count("*").alias("occurrences")).orderBy(F.desc("occurrences"), "symbol").limit(n)


def find_symbols(occurrences: DataFrame, symbols: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Symbols whose id or display name has the query in it, in any case."""
    q = F.lower(F.lit(query))
    n = occurrences.groupBy("symbol").agg(F.count("*").alias("occurrences"))
    named = n.join(info(symbols), "symbol", "left")
    return named.where(F.lower("symbol").contains(q) | F.coalesce(F.lower("display_name").contains(q), F.lit(False))).orderBy(F.desc("occurrences"), "symbol").limit(limit)


def info(symbols: DataFrame) -> DataFrame:
    """One row for each symbol: a document's before an external one."""
    return symbols.groupBy("symbol").agg(F.min_by(F.struct("display_name", "kind"), F.struct("external", "display_name")).alias("i")).select("symbol", "i.display_name", "i.kind")


def refs(occurrences: DataFrame, symbol: str) -> DataFrame:
    """References of a symbol by document."""
    place = F.struct("start_line", "start_char", "end_line", "end_char")
    return occurrences.where(~F.col("is_def") & (F.col("symbol") == symbol)).groupBy("doc").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(place)).alias("places")).orderBy("doc")


def file_summary(occurrences: DataFrame, doc: str) -> DataFrame:
    """One row: symbols defined, references made, occurrences elsewhere of what it defines, occurrences."""
    own = occurrences.where(F.col("doc") == doc)
    defined = own.where("is_def").select("symbol").distinct()
    incoming = occurrences.where(F.col("doc") != doc).join(defined, "symbol", "left_semi").agg(F.count("*").alias("incoming"))
    here = own.agg(F.count_distinct(F.when(F.col("is_def"), F.col("symbol"))).alias("definitions"), F.count_if(~F.col("is_def")).alias("outgoing"), F.count("*").alias("total"))
    return here.crossJoin(incoming)  # one row each


def file_summaries(occurrences: DataFrame) -> DataFrame:
    """The same for all documents at once."""
    here = occurrences.groupBy("doc").agg(F.count_distinct(F.when(F.col("is_def"), F.col("symbol"))).alias("definitions"), F.count_if(~F.col("is_def")).alias("outgoing"), F.count("*").alias("total"))
    defined = occurrences.where("is_def").select("doc", "symbol").distinct()
    each = occurrences.groupBy("symbol", F.col("doc").alias("at")).agg(F.count("*").alias("n"))
    ever = occurrences.groupBy("symbol").agg(F.count("*").alias("all"))
    own = each.withColumnRenamed("at", "doc").select("doc", "symbol", "n")
    incoming = defined.join(ever, "symbol").join(own, ["doc", "symbol"]).groupBy("doc").agg(F.sum(F.col("all") - F.col("n")).alias("incoming"))
    return here.join(incoming, "doc", "left").fillna(0, ["incoming"])


def walk(edges: DataFrame, symbol: str, backwards: bool, depth: int = 3, cap: int = CAP) -> dict:
    """Breadth-first closure from a symbol over call edges: nodes with depth, parent and call sites, at most cap.

    Each round filters the edges by the front, which has cap symbols at most; nothing else comes to the driver.
    """
    near, far = ("callee", "caller") if backwards else ("caller", "callee")
    seen, front, nodes, truncated = {symbol}, [symbol], [], False
    for d in range(1, depth + 1):
        if not front or truncated:
            break
        place = {s: i for i, s in enumerate(front)}
        found = edges.where(F.col(near).isin(front) & ~F.col(far).isin(list(seen))).groupBy(near, far).agg(F.sum("sites").alias("sites"))
        order = F.array_position(F.array(*map(F.lit, front)), F.col(near))
        first = found.groupBy(far).agg(F.min(F.struct(order.alias("o"), (-F.col("sites")).alias("n"), F.col(near).alias("parent"))).alias("m"))
        rows = first.orderBy("m.o", "m.n", far).limit(cap - len(nodes) + 1).collect()
        rows.sort(key=lambda r: (place[r.m.parent], r.m.n, r[far]))
        front = []
        for r in rows:
            if len(nodes) >= cap:
                truncated = True
                break
            seen.add(r[far])
            front.append(r[far])
            nodes.append({"symbol": r[far], "depth": d, "parent": r.m.parent, "sites": -r.m.n})
    return {"root": symbol, "nodes": nodes, "truncated": truncated}


def reach(edges: DataFrame, roots: DataFrame, backwards: bool, depth: int = 3) -> DataFrame:
    """(symbol, depth) of all that call edges reach from roots (symbol) in so many steps, the roots with 0: the walk without
    a cap, in rounds of joins."""
    near, far = ("callee", "caller") if backwards else ("caller", "callee")
    steps = edges.select(F.col(near).alias("symbol"), F.col(far).alias("to"))
    found = front = saved(roots.select("symbol", F.lit(0).alias("depth")).distinct(), "reach")
    for d in range(1, depth + 1):
        step = steps.join(front.select("symbol"), "symbol", "left_semi").select(F.col("to").alias("symbol"), F.lit(d).alias("depth")).distinct()
        front = saved(step.join(found, "symbol", "left_anti"), "reach")
        found = found.unionByName(front)
    return found


def defining(occurrences: DataFrame, names: DataFrame) -> DataFrame:
    """(doc): the documents that define any of the symbols."""
    return occurrences.where("is_def").join(names.select("symbol"), "symbol", "left_semi").select("doc").distinct()


def among(edges: DataFrame, names: DataFrame) -> DataFrame:
    """The call edges between any two of the symbols."""
    ends = names.select("symbol").distinct()
    return edges.join(ends.withColumnRenamed("symbol", "caller"), "caller", "left_semi").join(ends.withColumnRenamed("symbol", "callee"), "callee", "left_semi").select("caller", "callee", "sites")


def impact(edges: DataFrame, occurrences: DataFrame, symbol: str, depth: int = 3, cap: int = CAP) -> dict:
    """Transitive callers, and the documents that define them."""
    out = walk(edges, symbol, True, depth, cap)
    names = [n["symbol"] for n in out["nodes"]]
    out["files"] = [r.doc for r in occurrences.where(F.col("is_def") & F.col("symbol").isin(names)).select("doc").distinct().orderBy("doc").collect()] if names else []
    return out


def flow(edges: DataFrame, symbol: str, depth: int = 3, cap: int = CAP) -> dict:
    return walk(edges, symbol, False, depth, cap)


def trace(edges: DataFrame, symbol: str, direction: str = "both", hops: int = 3, cap: int = CAP) -> dict:
    """The root and what it reaches within 1 to 8 hops, and all call edges among these."""
    hops = max(1, min(8, hops))
    nodes = {symbol: 0}
    cut = False
    for back in ((True, False) if direction == "both" else (direction == "callers",)):
        w = walk(edges, symbol, back, hops, cap - 1)
        cut |= w["truncated"]
        for n in w["nodes"]:
            nodes.setdefault(n["symbol"], n["depth"])
    names = list(nodes)[:cap]
    among = edges.where(F.col("caller").isin(names) & F.col("callee").isin(names)).orderBy("caller", "callee").collect()
    return {"root": symbol, "nodes": [{"symbol": s, "depth": nodes[s]} for s in names], "edges": [r.asDict() for r in among], "truncated": cut or len(nodes) > cap}


def symbol_360(occurrences: DataFrame, edges: DataFrame, symbol: str, cap: int = CAP) -> dict:
    """Definitions, direct callers and direct callees, so many of each at most, with the numbers that there are."""
    definitions = page(occurrences.where(F.col("is_def") & (F.col("symbol") == symbol)).select("doc", "start_line", "start_char"), cap, "doc", "start_line")
    calling = page(callers(edges, symbol), cap, F.desc("sites"), "symbol")
    called = page(callees(occurrences, symbol), cap, "symbol")
    return {
        "definitions": definitions["rows"], "callers": calling["rows"], "callees": [r["symbol"] for r in called["rows"]],
        "n_definitions": definitions["total_count"], "n_callers": calling["total_count"], "n_callees": called["total_count"],
        "occurrences": occurrences.where(F.col("symbol") == symbol).count(),
    }


def symbol_of_function(occurrences: DataFrame, symbols: DataFrame, file: str, name: str) -> DataFrame:
    """Symbols that show a function's name and are defined in its file."""
    defined = occurrences.where(F.col("is_def") & (F.col("doc") == file)).select("symbol")
    return info(symbols).where(F.col("display_name") == name).join(defined, "symbol", "left_semi").orderBy("symbol")
