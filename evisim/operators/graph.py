"""Iterative operators over edge tables. A round is a join and an aggregate; `stage` cuts its lineage by a written table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from evisim.tables import written

Stage = Callable[[DataFrame], DataFrame]


checkpointed = written


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_out, n_in, n_neighbors (distinct, both directions, without itself)."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("n_neighbors"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.join(into, "node", "full_outer").join(both, "node", "left").select("node", zero("n_out"), zero("n_in"), zero("n_neighbors"))


def hint_propagation(edges: DataFrame, seeds: DataFrame, least: float = 0.70, decay: float = 0.3, floor: float = 0.15, weak: float = 0.50, cap: float = 0.60) -> DataFrame:
    """node, confidence, origin: callers of confident callees get hints of confidence * decay.

    A node without a name takes the best hint; one below `weak` is raised by half of it up to the cap. A second hop would be
    decay squared, which is below the floor for any confidence.
    """
    hints = edges.join(seeds.filter(F.col("confidence") >= least).select(F.col("node").alias("dst"), F.col("confidence").alias("c")), "dst")
    best = hints.groupBy(F.col("src").alias("h")).agg(F.max(F.col("c") * decay).alias("hint")).filter(F.col("hint") >= floor)
    joined = seeds.join(best, F.col("node") == F.col("h"), "full_outer")
    raised = (F.col("confidence") < weak) & F.col("hint").isNotNull()
    value = F.when(F.col("node").isNull(), F.col("hint")).when(raised, F.least(F.col("confidence") + 0.5 * F.col("hint"), F.lit(cap))).otherwise(F.col("confidence"))
    origin = F.when(F.col("node").isNull(), "caller").when(raised, "boosted").otherwise("seed")
    return joined.select(F.coalesce("node", "h").alias("node"), value.alias("confidence"), origin.alias("origin"))


def profile_propagation(edges: DataFrame, known: DataFrame, stage: Stage = checkpointed, base: float = 0.9, decay: float = 0.8, stop: float = 0.30, rounds: int = 10) -> DataFrame:
    """node, domain, confidence, round: unknown callers whose known callees mostly share a domain take it, round after round.

    A round's confidence is base * decay^round; rounds end below `stop`, without news, or when news is under 1 % of all.
    The commonest domain wins, ties by name.
    """
    known = stage(known.select("node", "domain", F.lit(1.0).alias("confidence"), F.lit(-1).alias("round")))
    e = edges.select("src", "dst").distinct()
    for r in range(rounds):
        confidence = base * decay**r
        if confidence < stop:
            break
        votes = e.join(known.select(F.col("node").alias("dst"), "domain"), "dst").groupBy("src", "domain").agg(F.count(F.lit(1)).alias("n"))
        first = Window.partitionBy("src").orderBy(F.desc("n"), "domain")
        won = votes.withColumn("rn", F.row_number().over(first)).filter("rn = 1")
        new = won.join(known.select(F.col("node").alias("src")), "src", "left_anti").select(F.col("src").alias("node"), "domain", F.lit(confidence).alias("confidence"), F.lit(r).alias("round"))
        before, known = known.count(), stage(known.unionByName(new))
        added = known.count() - before
        if added == 0 or added < 0.01 * (before + added):
            break
    return known


def closure_depth(edges: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """root, node, depth: the shortest distance, by breadth-first rounds up to `most`."""
    return _reach(edges, roots, most).groupBy("root", "node").agg(F.min("depth").alias("depth"))


def _reach(edges: DataFrame, roots: DataFrame, most: int, stage: Stage = checkpointed) -> DataFrame:
    seen = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    front = seen
    for d in range(1, most + 1):
        step = front.select("root", "node").join(edges.select(F.col("src").alias("node"), "dst"), "node").select("root", F.col("dst").alias("node")).distinct()
        front = stage(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def trace_paths(edges: DataFrame, roots: DataFrame, most: int, stage: Stage = checkpointed) -> DataFrame:
    """root, path, depth: all simple paths from the roots of up to `most` edges; a node doesn't come twice on a path."""
    front = roots.select(F.col("node").alias("root"), F.array("node").alias("path"), F.lit(0).alias("depth"))
    out = front
    for d in range(1, most + 1):
        e = edges.select("src", "dst").distinct()
        front = stage(front.join(e, F.element_at("path", -1) == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select("root", F.concat("path", F.array("dst")).alias("path"), F.lit(d).alias("depth")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def min_label_components(edges: DataFrame, stage: Stage = checkpointed) -> DataFrame:
    """node, component (smallest reachable node) of an undirected edge table.

    In a round every node chooses its smallest neighbour; of two that choose each other the smaller is a root, and there are no
    other cycles, so a round halves the nodes of a component at least. Pointers then jump, twice as far each time, until they are at a root, and
    edges go on between roots.
    """
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    home = stage(nodes.select("node", F.col("node").alias("root")))
    e = stage(edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    while not e.isEmpty():
        to = stage(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("n")).agg(F.min("b").alias("t")))
        back = to.select(F.col("n").alias("m"), F.col("t").alias("u"))
        to = stage(to.join(back, F.col("t") == F.col("m")).select("n", F.when((F.col("u") == F.col("n")) & (F.col("n") < F.col("t")), F.col("n")).otherwise(F.col("t")).alias("t")))
        while True:
            onward = to.filter("n <> t").select(F.col("n").alias("m"), F.col("t").alias("u"))
            jumped = stage(to.join(onward, F.col("t") == F.col("m"), "left").select("n", F.coalesce("u", "t").alias("t"), F.col("u").isNotNull().alias("moved")))
            to = jumped.drop("moved")
            if jumped.filter("moved").isEmpty():
                break
        home = stage(home.join(to, F.col("root") == F.col("n"), "left").select("node", F.coalesce("t", "root").alias("root")))
        x, y = to.select(F.col("n").alias("na"), F.col("t").alias("ta")), to.select(F.col("n").alias("nb"), F.col("t").alias("tb"))
        e = stage(e.join(x, F.col("a") == F.col("na")).join(y, F.col("b") == F.col("nb")).filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    low = home.groupBy("root").agg(F.min("node").alias("component")).withColumnRenamed("root", "r")
    return home.join(low, F.col("root") == F.col("r")).select("node", "component")


def strong_components(edges: DataFrame, stage: Stage = checkpointed) -> DataFrame:
    """node, scc (smallest node that it reaches and that reaches it).

    Rounds of colouring: the smallest name spreads forwards until it stands still, then backwards within its colour; what it
    reaches both ways is one component and goes.
    """
    e = stage(edges.filter("src <> dst").select("src", "dst").distinct())
    left = stage(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())
    done = None
    while not left.isEmpty():
        colour = stage(left.select("node", F.col("node").alias("c")))
        while True:
            low = e.join(colour.select(F.col("node").alias("src"), "c"), "src").groupBy(F.col("dst").alias("d")).agg(F.min("c").alias("m"))
            moved = stage(colour.join(low, F.col("node") == F.col("d"), "left").select("node", "c", F.least("c", F.coalesce("m", "c")).alias("new")))
            colour = moved.select("node", F.col("new").alias("c"))
            if moved.filter("c <> new").isEmpty():
                break
        cs, cd = colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), colour.select(F.col("node").alias("dst"), F.col("c").alias("cd"))
        inner = stage(e.join(cs, "src").join(cd, "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        got = stage(colour.filter("node = c"))
        front = got
        while True:
            back = inner.join(front.select(F.col("node").alias("dst"), F.col("c").alias("fc")), "dst").filter("c = fc").select(F.col("src").alias("node"), "c").distinct()
            front = stage(back.join(got.select("node"), "node", "left_anti"))
            if front.isEmpty():
                break
            got = stage(got.unionByName(front))
        done = got if done is None else done.unionByName(got)
        left = stage(left.join(got.select("node"), "node", "left_anti"))
        keep = left.select("node")
        e = stage(e.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return edges.select(F.col("src").alias("node"), F.col("src").alias("scc")).limit(0) if done is None else done.select("node", F.col("c").alias("scc"))


def longest_path(edges: DataFrame, stage: Stage = checkpointed, most: int = 1000) -> DataFrame:
    """node, depth: edges on the longest path that ends there, on an acyclic edge table; rounds end when nothing moves."""
    e = stage(edges.select("src", "dst").distinct())
    front = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    seen = front.select("node", F.lit(0).alias("depth"))
    for d in range(1, most + 1):  # a node is in the front of round d if a path of d edges ends there
        front = stage(front.select(F.col("node").alias("src")).join(e, "src").select(F.col("dst").alias("node")).distinct())
        if front.isEmpty():
            return seen.groupBy("node").agg(F.max("depth").alias("depth"))
        seen = seen.unionByName(front.select("node", F.lit(d).alias("depth")))
    raise ValueError("the edges have a cycle or a path beyond the limit")


def label_propagation(edges: DataFrame, stage: Stage = checkpointed, sweeps: int = 5) -> DataFrame:
    """node, label: synchronous sweeps; each node takes its neighbours' commonest label, ties to the smallest."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    labels = both.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("label"))
    for _ in range(sweeps):
        votes = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("src").orderBy(F.desc("n"), "label")
        labels = stage(votes.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(F.col("src").alias("node"), "label"))
    return labels


def writer_reader_edges(accesses: DataFrame, calls: DataFrame, hub: int = 500) -> DataFrame:
    """writer, reader, field, confidence of accesses(field, func, kind): shared callers and calls between the two raise it.

    Fields with more than `hub` accessors don't pair up: that is part of the definition, and bounds a field's pairs.
    No side is sent whole to the driver: a table of calls takes many times the size that its file is planned with.
    """
    a = accesses.select("field", "func", "kind").distinct()
    few = a.groupBy("field").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") <= hub).select("field")
    kind = lambda k: F.collect_set(F.when(F.col("kind") == k, F.col("func"))).alias(k)
    sides = a.join(few.hint("merge"), "field", "left_semi").groupBy("field").agg(kind("w"), kind("r"))
    pairs = sides.select("field", F.explode("w").alias("writer"), "r").select("field", "writer", F.explode("r").alias("reader")).filter("writer <> reader")
    e = calls.select("src", "dst").distinct()
    x, y = e.select(F.col("src").alias("p"), F.col("dst").alias("writer")), e.select(F.col("src").alias("p"), F.col("dst").alias("reader"))
    shared = pairs.select("writer", "reader").distinct().join(x.hint("merge"), "writer").join(y.hint("merge"), ["p", "reader"])
    flags = lambda df, *yes: df.select("writer", "reader", *[F.lit(c in yes).alias(c) for c in ("s", "wr", "rw")])
    known = flags(shared, "s").unionByName(flags(e.toDF("writer", "reader"), "wr")).unionByName(flags(e.toDF("reader", "writer"), "rw"))
    known = known.groupBy("writer", "reader").agg(*[F.max(c).alias(c) for c in ("s", "wr", "rw")])
    out = pairs.join(known.hint("merge"), ["writer", "reader"], "left")
    conf = 0.45 + F.when(F.col("s"), 0.15).otherwise(0.0) + F.when(F.col("wr"), 0.20).otherwise(0.0) + F.when(F.col("rw"), 0.10).otherwise(0.0)
    return out.select("writer", "reader", "field", F.least(conf, F.lit(1.0)).alias("confidence"))


def template_match(found: DataFrame, stages: DataFrame, part: float = 0.3, least: int = 2, share: float = 0.4) -> DataFrame:
    """entity, template, coverage, n_stages of found(entity, indicator) and stages(template, stage, indicator).

    A stage's score is min(1, hits / (part * indicators)); a template needs max(least, share * stages) stages with a hit.
    """
    sizes = stages.groupBy("template", "stage").agg(F.countDistinct("indicator").alias("n"))
    total = stages.groupBy("template").agg(F.countDistinct("stage").alias("total"))
    hits = found.distinct().join(stages.distinct(), "indicator").groupBy("entity", "template", "stage").agg(F.count(F.lit(1)).alias("h"))
    scored = hits.join(sizes, ["template", "stage"]).withColumn("score", F.least(F.lit(1.0), F.col("h") / (part * F.col("n"))))
    per = scored.groupBy("entity", "template").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n_stages")).join(total, "template")
    return per.filter(F.col("n_stages") >= F.greatest(F.lit(least), F.ceil(share * F.col("total")))).select("entity", "template", (F.col("s") / F.col("total")).alias("coverage"), "n_stages")


def wl_hash(nodes: DataFrame, edges: DataFrame, rounds: int = 3, stage: Stage = checkpointed) -> DataFrame:
    """graph, hash, n_nodes, n_edges of nodes(graph, node, label) and edges(graph, src, dst): a Weisfeiler-Lehman hash.

    A node's colour is the MD5 of its own, the sorted ones of its successors and of its predecessors; a graph's hash
    is that of its nodes' sorted colours. A round is two joins by graph and node, so graphs of any number run at once.
    """
    colours = nodes.select("graph", "node", F.md5(F.col("label").cast("string")).alias("c"))
    e = edges.join(nodes.select("graph", F.col("node").alias("src")), ["graph", "src"], "left_semi").join(nodes.select("graph", F.col("node").alias("dst")), ["graph", "dst"], "left_semi")
    near = lambda mine, other: e.join(colours.select("graph", F.col("node").alias(other), "c"), ["graph", other]).groupBy("graph", F.col(mine).alias("node")).agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias(mine))
    for _ in range(rounds):
        joined = colours.join(near("src", "dst"), ["graph", "node"], "left").join(near("dst", "src"), ["graph", "node"], "left")
        text = F.concat(F.col("c"), F.lit("|"), F.coalesce("src", F.lit("")), F.lit("|"), F.coalesce("dst", F.lit("")))
        colours = stage(joined.select("graph", "node", F.md5(text).alias("c")))
    n_edges = e.groupBy("graph").agg(F.count(F.lit(1)).alias("n_edges"))
    per = colours.groupBy("graph").agg(F.md5(F.array_join(F.array_sort(F.collect_list("c")), "|")).alias("hash"), F.count(F.lit(1)).alias("n_nodes"))
    return per.join(n_edges, "graph", "left").select("graph", "hash", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
