"""Near-duplicate embeddings by NN-descent.

A neighbour graph is started from windows over several random-hyperplane orders and refined: the neighbours of a
node, forward and reverse, are joined with each other and what beats a list's worst entry enters it.  A list whose
every entry is above the threshold is saturated; it is enlarged, and at ``LARGEST`` entries its node is compared
exactly with all vectors of its label, in blocks.  Recall is audited against brute force on samples of the linked, the
nearly linked and all other nodes, enlarged until ``SEEN`` of them have links; below ``RECALL`` another set of orders
and another descent follow, and after ``ATTEMPTS`` of them all nodes are compared exactly.  Edges at or above the
threshold are kept.

Equal vectors of a label are one class with its number of copies, so copies are never paired.  Lists and groups are
bounded by ``LARGEST``; reverse neighbours beyond a list's size wait for the lists they are on.  Windows are cut
from a range-partitioned order, so a large group of near copies spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wellpanel.llm.components import components
from wellpanel.llm.groups import pairs_within, whole_groups
from wellpanel.llm.storage import staged, table

THRESHOLD = 0.98
#: Entries of a list at first and at most.
NEIGHBOURS, LARGEST = 6, 96
ORDERS, PLANES, WINDOW = 6, 24, 128
ATTEMPTS = 3
#: A round that changes at most this share of the lists that hold links ends the descent.
SETTLED = 0.001
#: Audited nodes of each stratum at first, and how many with links the audit must see, if there are so many.
AUDITED, SEEN, RECALL = 256, 192, 0.99
#: An unlinked node with a cosine of this or more is nearly linked.
NEARLY = 0.9
BLOCK = 1024
#: Pairs of vectors that a task compares at once.
PAIRS_AT_ONCE = 1 << 15

NODE = "id long, label int, copies long, vec binary, codes array<long>"
PAIR = "a long, b long, sim double"


def _unit(packed: pd.Series) -> list[np.ndarray]:
    found = [np.frombuffer(v, np.float64) for v in packed]
    return [v / np.sqrt(v @ v) for v in found]


def _cosines(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Cosines of unit vectors; vectors of different lengths have none (-1)."""
    widths = {len(v) for v in left} | {len(v) for v in right}
    if len(widths) == 1:
        return np.stack(left) @ np.stack(right).T
    out = np.full((len(left), len(right)), -1.0)
    for width in widths:
        a = [i for i, v in enumerate(left) if len(v) == width]
        b = [i for i, v in enumerate(right) if len(v) == width]
        if a and b:
            out[np.ix_(a, b)] = np.stack([left[i] for i in a]) @ np.stack([right[i] for i in b]).T
    return out


def nodes(vectors: DataFrame, seed: int) -> DataFrame:
    """One row per class of equal vectors of a label: smallest id, copies, the vector and its place in each order."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    zero = ~F.exists("embedding", lambda c: c != 0)
    valid = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~bad).filter(~zero)
    classes = valid.select("vec_id", "label", "embedding").distinct().groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(PLANES, dtype=np.int64)[::-1]
        for batch in batches:
            vecs = [np.asarray(v, np.float64) for v in batch["embedding"]]
            codes = []
            for v in vecs:
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng([seed, len(v)]).standard_normal((ORDERS * PLANES, len(v)))
                codes.append(((planes[len(v)] @ v > 0).reshape(ORDERS, PLANES) @ weights).tolist())
            yield batch[["id", "label", "copies"]].assign(vec=[(v + 0.0).tobytes() for v in vecs], codes=codes)

    return classes.select("id", "label", "copies", "embedding").mapInPandas(place, NODE)


def _windows(keep: int):
    """Best neighbours within overlapping windows of following rows of one order and label."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs = batch[["turn", "label"]].to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero((runs[1:] != runs[:-1]).any(axis=1)) + 1, [len(batch)]))
            ids, found = batch["id"].to_numpy(), []
            unit = _unit(batch["vec"])
            for first, last in zip(cuts[:-1], cuts[1:]):
                for at in range(first, max(first + 1, last - WINDOW // 2), WINDOW // 2):
                    end = min(last, at + WINDOW)
                    sims = _cosines(unit[at:end], unit[at:end])
                    np.fill_diagonal(sims, -2)
                    k = min(keep, end - at - 1)
                    if k < 1:
                        continue
                    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                    rows = np.repeat(np.arange(end - at), k)
                    found.append((ids[at + rows], ids[at + best.ravel()], sims[rows, best.ravel()]))
            if found:
                a, b, s = (np.concatenate(x) for x in zip(*found))
                yield pd.DataFrame({"a": a, "b": b, "sim": s})

    return compare


def _lists(pairs: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(a, most, near, fresh): each node's best entries, how many it may hold, and which ids are new."""
    entries = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).select("a", "b", F.col("sim"))
    # a list never needs more than LARGEST of the offers; the limit is taken before the shuffle
    best = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    entries = entries.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= LARGEST)
    offered = entries.groupBy("a").agg(F.collect_list(F.struct("sim", "b")).alias("offered"))
    if before is None:
        joined = offered.select("a", "offered", F.lit(NEIGHBOURS).alias("most"), F.array().cast("array<struct<sim:double,b:bigint>>").alias("old"))
    else:
        joined = before.select("a", "most", F.col("near").alias("old")).join(offered, "a", "full").select(
            "a", F.coalesce("offered", F.array()).alias("offered"), F.coalesce("most", F.lit(NEIGHBOURS)).alias("most"), F.coalesce("old", F.array()).alias("old")
        )
    # a list that is full of links may grow
    full = (F.size("old") >= F.col("most")) & (F.get("old", F.col("most") - 1)["sim"] >= THRESHOLD)
    most = F.when(full, F.least(F.col("most") * 4, F.lit(LARGEST))).otherwise(F.col("most")).cast("int")
    ranked = F.sort_array(F.array_distinct(F.concat("old", "offered")), asc=False)
    return (
        joined.withColumn("most", most).withColumn("near", F.slice(ranked, 1, F.col("most")))
        .select("a", "most", "near", F.transform(F.array_except("near", "old"), lambda e: e["b"]).alias("fresh"))
    )


def _join_neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All pairs with a new member among one node's neighbours that beat the worst entry of either list."""
    for rows in whole_groups(batches, ["hub"]):
        rows = rows.drop_duplicates(["hub", "member"]).reset_index(drop=True)
        fresh, worst, ids = rows["fresh"].to_numpy(bool), rows["worst"].to_numpy(), rows["member"].to_numpy()
        unit = _unit(rows["vec"])
        width = np.array([len(v) for v in unit])
        table = np.zeros((len(unit), width.max(initial=0)))
        for k, v in enumerate(unit):
            table[k, : len(v)] = v
        found = []
        for a, b in pairs_within(rows, ["hub"], PAIRS_AT_ONCE):
            open_pair = (fresh[a] | fresh[b]) & (width[a] == width[b])
            a, b = a[open_pair], b[open_pair]
            sims = np.einsum("ij,ij->i", table[a], table[b])
            useful = sims > np.minimum(worst[a], worst[b])
            found.append((ids[a[useful]], ids[b[useful]], sims[useful]))
        a, b, s = (np.concatenate(x) for x in zip(*found))
        once = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1, return_index=True)[1]
        yield pd.DataFrame({"a": a[once], "b": b[once], "sim": s[once]})


def descend(graph: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs offered by one round of neighbours-of-neighbours joins."""
    forward = graph.select("a", "most", F.explode("near").alias("e"), "fresh").select("a", F.col("e.b").alias("b"), F.col("e.sim").alias("sim"), F.array_contains("fresh", F.col("e.b")).alias("fresh"), "most")
    # reverse entries of a node, as many as a list may hold: the nearest ones
    nearest = Window.partitionBy("b").orderBy(F.desc("sim"), "a")
    reverse = forward.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= F.col("most"))
    members = forward.select(F.col("a").alias("hub"), F.col("b").alias("member"), "fresh").unionAll(reverse.select(F.col("b").alias("hub"), F.col("a").alias("member"), "fresh"))
    active = members.groupBy("hub").agg(F.max("fresh").alias("any")).filter("any").select("hub")
    worst = graph.select(F.col("a").alias("member"), F.when(F.size("near") < F.col("most"), F.lit(-2.0)).otherwise(F.get("near", F.size("near") - 1)["sim"]).alias("worst"))
    vectors = known.select(F.col("id").alias("member"), "vec").join(worst, "member")
    told = members.join(active, "hub", "left_semi").join(vectors, "member")
    return told.repartition("hub").sortWithinPartitions("hub", "member", F.desc("fresh")).select("hub", "member", "fresh", "worst", "vec").mapInPandas(_join_neighbours, PAIR)


def build_graph(known: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Start from the hyperplane orders and descend until few of the lists that hold links change."""
    turns = known.select("id", "label", "vec", F.posexplode("codes").alias("turn", "code"))
    ordered = turns.repartitionByRange("turn", "label", "code", F.xxhash64("id")).sortWithinPartitions("turn", "label", "code", F.xxhash64("id"))
    pairs = ordered.select("turn", "label", "id", "vec").mapInPandas(_windows(NEIGHBOURS), PAIR)
    graph = staged(_lists(pairs, before), "graph")
    while True:  # lists only improve, so this ends
        graph = staged(_lists(descend(graph, known), graph), "graph")
        linked = (F.get("near", F.lit(0))["sim"] >= THRESHOLD) & ~F.coalesce(_saturated(), F.lit(False))
        total, changed = graph.agg(F.count_if(linked), F.count_if(linked & (F.size("fresh") > 0))).first()
        if changed <= SETTLED * total:
            return graph


def _saturated() -> Column:
    """A list that cannot grow and holds links only; its node is compared exactly, whatever else changes."""
    return (F.size("near") >= LARGEST) & (F.get("near", F.lit(LARGEST - 1))["sim"] >= THRESHOLD)


def links_of(graph: DataFrame) -> DataFrame:
    """Distinct links (a, b) in both directions that the lists hold."""
    held = graph.select("a", F.explode(F.filter("near", lambda e: e["sim"] >= THRESHOLD)).alias("e")).select("a", F.col("e.b").alias("b"))
    return held.unionAll(held.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def link_counts(known: DataFrame, links: DataFrame, checked: DataFrame, exact: DataFrame) -> DataFrame:
    """(a, linked): vectors linked with each node, from the lists or, for nodes in ``exact``, from their comparison."""
    listed = links.join(exact.withColumnRenamed("id", "a"), "a", "left_anti")
    sideways = checked.filter("kind = 1").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return (
        listed.unionAll(sideways).distinct().join(known.select(F.col("id").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("linked"))
        .unionAll(checked.filter("kind = 0").groupBy("a").agg(F.sum("b").alias("linked")))
    )


def audit(known: DataFrame, graph: DataFrame, counted: DataFrame, exact: DataFrame) -> float:
    """Estimated mean share of a linked node's links that was found; nodes compared exactly are left out.

    Linked, nearly linked and other nodes are drawn apart and weighted by their numbers, each node counting once.  If
    too few of those drawn have links, more are drawn, in the end all.
    """
    best = graph.select(F.col("a").alias("id"), F.get("near", F.lit(0))["sim"].alias("best"))
    left = known.select("id").join(exact.select("id"), "id", "left_anti").join(best, "id", "left").join(counted.withColumnRenamed("a", "id"), "id", "left")
    stratum = F.when(F.col("linked") > 0, 0).when(F.col("best") >= NEARLY, 1).otherwise(2)
    left = staged(left.select("id", F.coalesce("linked", F.lit(0)).alias("linked"), stratum.alias("stratum")), "audited")
    # three rows at most
    sizes = {r["stratum"]: r["count"] for r in left.groupBy("stratum").count().collect()}
    rows, place = AUDITED, F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 31))
    while True:
        drawn = F.lit(False)
        for s, n in sizes.items():
            drawn = drawn | ((F.col("stratum") == s) & (place < int((1 << 31) * min(1, rows / n))))
        sample = staged(left.filter(drawn), "sample")
        truth = compare_exactly(known, sample.select("id")).filter("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("true"))
        held = F.coalesce(F.sum(F.when(F.col("true") > 0, F.least(F.col("linked") / F.col("true"), F.lit(1.0)))), F.lit(0.0))
        seen = sample.join(truth, "id", "left").groupBy("stratum").agg(F.count("*").alias("n"), F.count("true").alias("true"), held.alias("held")).collect()
        if sum(r["true"] for r in seen) >= SEEN or rows >= max(sizes.values(), default=0):
            break
        rows *= 8
    weight = {r["stratum"]: sizes[r["stratum"]] / r["n"] for r in seen}
    true = sum(weight[r["stratum"]] * r["true"] for r in seen)
    return sum(weight[r["stratum"]] * r["held"] for r in seen) / true if true else 1.0


def _exact(rows: pd.DataFrame) -> pd.DataFrame:
    """One cell of the exact comparison: link counts of saturated nodes, their links to others, a spanning forest."""
    rows = rows.sort_values(["asked", "id"], kind="stable")
    asked = rows["asked"].to_numpy(bool)
    ids, copies, dense = rows["id"].to_numpy(), rows["copies"].to_numpy(), rows["dense"].to_numpy(bool)
    unit = _unit(rows["vec"])
    q, c = np.flatnonzero(asked), np.flatnonzero(~asked)
    if not len(q) or not len(c):
        return pd.DataFrame({"kind": [], "a": [], "b": []}).astype({"kind": "int32", "a": "int64", "b": "int64"})
    near = (_cosines([unit[i] for i in q], [unit[i] for i in c]) >= THRESHOLD) & (ids[q][:, None] != ids[c][None, :])
    counts = near @ copies[c]
    out = [(0, int(ids[q[i]]), int(counts[i])) for i in range(len(q)) if counts[i]]
    i, j = np.nonzero(near & ~dense[c][None, :])
    out += [(1, int(ids[q[x]]), int(ids[c[y]])) for x, y in zip(i, j)]
    joined = np.zeros(len(c), bool)  # spanning forest: grow each tree over unseen candidates
    waiting = set(range(len(q)))
    while waiting:
        front, reached = [waiting.pop()], np.zeros(len(c), bool)
        while front:
            x = front.pop()
            for y in np.flatnonzero(near[x] & ~reached):
                reached[y] = True
                out.append((2, int(ids[q[x]]), int(ids[c[y]])))
                for z in [z for z in np.flatnonzero(near[:, y]) if z in waiting]:
                    waiting.discard(z)
                    front.append(z)
                    out.append((2, int(ids[q[z]]), int(ids[c[y]])))
        joined |= reached
    return pd.DataFrame(out, columns=["kind", "a", "b"])


def compare_exactly(known: DataFrame, saturated: DataFrame) -> DataFrame:
    """(kind, a, b) of the saturated nodes against all nodes of their label: 0 counts, 1 links, 2 forest edges."""
    marked = known.join(saturated.withColumn("dense", F.lit(True)), "id", "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
    sizes = staged(marked.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("dense").cast("int")).alias("m")).filter("m > 0"), "dense")
    blocks, lines = F.ceil(F.col("n") / BLOCK).cast("int"), F.ceil(F.col("m") / BLOCK).cast("int")
    rows = marked.join(sizes.select("label", blocks.alias("blocks"), lines.alias("lines")), "label")
    own: Column = F.xxhash64("id", F.lit(3))
    columns = ["label", "i", "j", "asked", "id", "copies", "dense", "vec"]
    asked = rows.filter("dense").withColumns({"i": F.pmod(own, F.col("lines")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "asked": F.lit(True)})
    against = rows.withColumns({"j": F.pmod(own, F.col("blocks")).cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("lines") - 1)), "asked": F.lit(False)})
    return asked.select(columns).unionAll(against.select(columns)).groupBy("label", "i", "j").applyInPandas(_exact, "kind int, a long, b long")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Vectors with equal labels link at a double-precision cosine of at least THRESHOLD.  Vectors that are null, zero
    or hold null or non-finite components, and rows without a label, link with nothing.  Equal vectors are linked
    with each other; rows repeated whole count as one vector and get the same answer each.  A null id keeps its row,
    with a null component and ``kept`` true.  An empty table gives an empty result.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    graph = None
    for attempt in range(ATTEMPTS):
        known = staged(nodes(vectors, attempt), "nodes")
        graph = build_graph(known, graph)
        exact = staged(graph.filter(_saturated()).select(F.col("a").alias("id")), "saturated")
        links = staged(links_of(graph), "links")
        checked = staged(compare_exactly(known, exact), "exact")
        counted = staged(link_counts(known, links, checked, exact), "counted")
        if audit(known, graph, counted, exact) >= RECALL:
            break
    else:
        exact = known.select("id")
        checked = staged(compare_exactly(known, exact), "exact")
        counted = link_counts(known, links, checked, exact)
    linked = components(links.unionAll(checked.filter("kind > 0").select("a", "b")))
    classes = (
        known.select("id", "copies").join(counted.withColumnRenamed("a", "id"), "id", "left").join(linked.withColumnRenamed("node", "id"), "id", "left")
        .select("id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
        .filter("links > 0")
    )
    named = staged(known.join(classes, "id").select("label", "vec", "links", "component"), "named")
    packed = vectors.select("vec_id", "label", "embedding")
    rows = packed.mapInPandas(_packed, "vec_id long, label int, vec binary").join(named, ["label", "vec"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    links_here = F.when(F.col("vec_id").isNotNull(), F.col("links"))
    return rows.select("vec_id", F.coalesce(links_here, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as the bytes that name their class, with -0.0 as 0.0 as in grouping; invalid ones have no bytes of a class."""
    for batch in batches:
        packed = [None if v is None else (np.asarray(v, np.float64) + 0.0).tobytes() for v in batch["embedding"]]  # one zero
        yield batch[["vec_id", "label"]].assign(vec=packed, label=batch["label"].astype("Int32"), vec_id=batch["vec_id"].astype("Int64"))


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
c AS (SELECT a, count(*) AS n FROM l GROUP BY a),
reach AS (
  WITH RECURSIVE r(node, via) AS (SELECT DISTINCT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.via)
  SELECT node, min(via) AS component FROM r GROUP BY node)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, e.vec_id) AS component_id, coalesce(component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN reach ON node = e.vec_id
"""
