"""Impact propagation over the country -> sector -> stock graph.

Simple paths of at most ``max_hops`` edges are enumerated by bounded joins of
the frontier with the edge table.  Event types are only applied at the end (as
the activation of the first hop's channel), so the path table does not grow
with their number.  Path choice is deterministic: impact desc, fewer hops,
then path ascending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions import exprs as X
from tremor.session import materialize


def paths(edges: DataFrame, nodes: DataFrame, max_hops: int = 2) -> DataFrame:
    """(country, stock, channel, weight, path) of every simple path."""
    e = edges.select("src", "dst", F.col("channel").alias("edge_channel"), F.col("weight").alias("edge_weight"))
    countries = nodes.where("node_type = 'country'").select(F.col("name").alias("src"))
    stocks = nodes.where("node_type = 'stock'").select(F.col("name").alias("stock"))
    frontier = e.join(countries, "src").select(
        F.col("src").alias("country"), F.col("edge_channel").alias("channel"),
        F.col("edge_weight").alias("weight"), F.col("dst").alias("node"),
        F.array("src", "dst").alias("path"))
    reached = frontier
    for _ in range(max_hops - 1):
        frontier = (
            frontier.join(e, frontier["node"] == e["src"])
            .where(~F.array_contains("path", F.col("dst")))
            .select("country", "channel", (F.col("weight") * F.col("edge_weight")).alias("weight"),
                    F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")))
        reached = reached.unionByName(frontier)
    return (reached.join(stocks, reached["node"] == stocks["stock"])
            .select("country", "stock", "channel", "weight", "path"))


def strongest_paths(edges: DataFrame, nodes: DataFrame, max_hops: int) -> DataFrame:
    """(country, stock, channel, weight, path): of the simple paths of at most
    ``max_hops`` edges those that can be a strongest one, for edges of positive
    weight.

    Of two ways from a country to a node over the same first channel, the one
    that is no stronger and has visited all the other has, and more, can be
    left: whatever continues it continues the other as well.  So the frontier
    holds, per country, first channel and node, only ways that trade strength
    against freedom to go on, and it stays small where the number of simple
    paths explodes.  Equal sets of visited nodes keep the strongest way, then
    the smaller path.
    """
    e = edges.where("weight > 0").select("src", "dst", F.col("channel").alias("edge_channel"), F.col("weight").alias("edge_weight"))
    countries = nodes.where("node_type = 'country'").select(F.col("name").alias("src"))
    stocks = nodes.where("node_type = 'stock'").select(F.col("name").alias("stock"))
    key = ["country", "channel", "node"]

    def one_per_set(ways: DataFrame) -> DataFrame:
        best = F.min(F.struct((-F.col("weight")).alias("neg"), "path")).alias("b")
        return (ways.withColumn("visited", F.array_sort("path")).groupBy(*key, "visited").agg(best)
                .select(*key, "visited", (-F.col("b.neg")).alias("weight"), F.col("b.path").alias("path")))

    frontier = one_per_set(e.join(countries, "src").where("src <> dst").select(
        F.col("src").alias("country"), F.col("edge_channel").alias("channel"), F.col("edge_weight").alias("weight"),
        F.col("dst").alias("node"), F.array("src", "dst").alias("path")))
    kept = frontier = materialize(frontier, "ways")
    for _ in range(max_hops - 1):
        longer = (frontier.drop("visited").join(e, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
                  .select("country", "channel", (F.col("weight") * F.col("edge_weight")).alias("weight"), F.col("dst").alias("node"),
                          F.concat("path", F.array("dst")).alias("path")))
        longer = materialize(one_per_set(longer), "ways")
        # what came with fewer hops, and what came now with another set of as many nodes, which is no subset
        old = kept.select(*[F.col(c).alias(f"o_{c}") for c in (*key, "visited", "weight")])
        same = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in key]
        covers = (F.col("o_weight") >= F.col("weight")) & (F.size(F.array_except("o_visited", "visited")) == 0)
        frontier = materialize(longer.join(old, [*same, covers], "left_anti"), "ways")
        kept = kept.unionByName(frontier)
    return kept.join(stocks, F.col("node") == F.col("stock")).select("country", "stock", "channel", "weight", "path")


def _best(group: list[str], df: DataFrame) -> DataFrame:
    """Best path per group: one partial + final aggregate, no window."""
    return (df.groupBy(*group)
            .agg(F.min(F.struct((-F.col("imp")).alias("neg"), F.size("path").alias("hops"), "path")).alias("b"))
            .select(*group, (-F.col("b.neg")).alias("imp"), F.col("b.path").alias("path")))


def reach(edges: DataFrame, nodes: DataFrame, activation: DataFrame, max_hops: int = 2) -> DataFrame:
    """Best impact and path per (country, event_type, stock).

    Each country is traversed on its own visited set, so the impact of a set
    of countries is exactly the max over its members (:func:`corridor_reach`).
    Two hops are enumerated; more go over :func:`strongest_paths`.
    """
    p = paths(edges, nodes, max_hops) if max_hops <= 2 else strongest_paths(edges, nodes, max_hops)
    p = p.join(activation, "channel")
    scored = p.select("country", "event_type", "stock", "path",
                      (F.col("activation") * F.col("weight")).alias("imp"))
    return _best(["country", "event_type", "stock"], scored)


def corridor_reach(pairs: DataFrame, reach_table: DataFrame) -> DataFrame:
    """Best impact per (corridor_key, event_type, stock).

    ``pairs`` holds *distinct* (corridor_key, corridor, event_type): the graph
    is evaluated once per pair, not once per event or per cluster.
    """
    exploded = pairs.select("corridor_key", "event_type", F.explode("corridor").alias("country"))
    return _best(["corridor_key", "event_type", "stock"],
                 exploded.join(reach_table, ["country", "event_type"]))


def corridor_key(corridor: Column | str) -> Column:
    return F.array_join(X.col(corridor), "|")


def ranked_stocks(reach_table: DataFrame) -> DataFrame:
    """Affected stocks of each (country, event_type) with their rank, strongest
    first.  A group is as large as there are stocks."""
    w = Window.partitionBy("country", "event_type").orderBy(F.col("imp").desc(), "stock")
    return reach_table.withColumn("rank", F.row_number().over(w).cast("bigint"))


def bad_queries(queries: DataFrame, nodes: DataFrame, activation: DataFrame) -> DataFrame:
    """(country, event_type) asked for with an unknown type or a start that is
    not a country node; must be empty before a run."""
    types = activation.select("event_type").distinct().withColumn("known_type", F.lit(True))
    starts = nodes.where("node_type = 'country'").select(F.col("name").alias("country"), F.lit(True).alias("is_country"))
    return (queries.join(types, "event_type", "left").join(starts, "country", "left")
            .where(F.col("known_type").isNull() | F.col("is_country").isNull())
            .select("country", "event_type",
                    F.when(F.col("known_type").isNull(), "unknown event type").otherwise("not a country").alias("problem")))


def edges_by_pair(edges: DataFrame) -> DataFrame:
    """Parallel edges of each (src, dst) with their count."""
    return edges.groupBy("src", "dst").agg(
        F.count("*").alias("n_edges"),
        F.array_join(F.array_sort(F.collect_list(F.coalesce("channel", F.lit("-")))), "|").alias("channels"),
        F.max("weight").alias("max_weight"))


def simulate(scenarios: DataFrame, reach_table: DataFrame) -> DataFrame:
    """What-if batch.  ``scenarios``: (scenario_id, event_type, countries,
    severity, confidence); manual reliability 1.0."""
    s = scenarios.select("scenario_id", "event_type", "severity", "confidence",
                         F.explode(F.array_distinct("countries")).alias("country"))
    best = _best(["scenario_id", "severity", "confidence", "stock"],
                 s.join(reach_table, ["country", "event_type"]))
    return best.select("scenario_id", "stock", "imp", "path",
                       (F.col("severity") * F.col("confidence") * F.lit(1.0) * F.col("imp")).alias("contribution"))


def path_edges(path_rows: DataFrame, edges: DataFrame, keep: list[str]) -> DataFrame:
    """Explodes ``path`` into hops and joins every parallel edge of each hop."""
    hops = path_rows.select(
        *keep, F.posexplode(F.transform(
            F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0))),
            lambda d, i: F.struct(F.get("path", i).alias("src"), d.alias("dst")))).alias("hop", "e"))
    return (hops.select(*keep, "hop", "e.src", "e.dst")
            .join(edges, ["src", "dst"]))


def causal_edges(attribution: DataFrame, edges: DataFrame, keep: list[str]) -> DataFrame:
    """Distinct (src, dst, channel) edges under the attribution paths."""
    e = path_edges(attribution, edges, keep)
    return e.select(*keep, "src", "dst", "channel", "weight", X.clean_note("note").alias("note")).distinct()


def causal_nodes(attribution: DataFrame, nodes: DataFrame, keep: list[str], focus: str) -> DataFrame:
    n = attribution.select(*keep, F.explode("path").alias("name")).distinct()
    return n.join(nodes, "name").withColumn("is_focus", F.col("name") == F.col(focus))


def flow_links(path_rows: DataFrame, keep: list[str]) -> DataFrame:
    """origin -> middle -> destination of each path."""
    return path_rows.where(F.size("path") > 0).select(
        *keep, F.element_at("path", 1).alias("origin"),
        F.when(F.size("path") > 2, F.get("path", F.lit(1))).alias("mid"),
        F.element_at("path", -1).alias("dest"), "weight")


def grounding(event_reach: DataFrame, edges: DataFrame, limit: int = 3) -> DataFrame:
    """Per event, the single highest-impact stock and up to ``limit`` distinct
    notes along its path, in path order.

    ``event_reach``: (event_id, stock, imp, path).  Notes per path are bounded
    by hops x parallel edges, so the collected list is bounded too.
    """
    top = (event_reach.groupBy("event_id")
           .agg(F.min(F.struct((-F.col("imp")).alias("neg"), "stock", "path")).alias("b"))
           .select("event_id", F.col("b.stock").alias("stock"), F.col("b.path").alias("path")))
    e = path_edges(top, edges, ["event_id", "stock"])
    e = e.select("event_id", "stock", "hop", F.coalesce("channel", F.lit("")).alias("ch"), X.clean_note("note").alias("note"))
    firsts = e.where("note is not null").groupBy("event_id", "stock", "note").agg(F.min(F.struct("hop", "ch")).alias("at"))
    notes = firsts.groupBy("event_id", "stock").agg(F.array_sort(F.collect_list(F.struct("at", "note"))).alias("ns"))
    return notes.select("event_id", "stock", F.slice(F.transform("ns", lambda x: x["note"]), 1, limit).alias("notes"))


def tied_impacts(reach_table: DataFrame, digits: int = 12) -> DataFrame:
    """Event types for which two stocks share one impact (audit)."""
    return (reach_table.groupBy("country", "event_type", F.round("imp", digits).alias("imp"))
            .agg(F.count("*").alias("n_stocks")).where("n_stocks > 1"))
