"""Adapters: the engine's input tables as projections of the test tables.

Each adapter has a twin with the same rules in ``oracle.py``.  None collects,
limits or samples: work grows with the tables.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor import dims
from tremor.functions import exprs as X
from tremor.operators import features as FE
from tremor.operators import graph as G
from tremor.operators import labels as L
from tremor.operators import scoring as SC
from tremor.plans.jobs import Store
from tremor.session import materialize, shared_dir
from tremor.sources.store import Table

NATIONS = [f"NATION_{i}" for i in range(25)]
NATION_MAP = {n: n for n in NATIONS}
SEGMENT_CHANNEL = "5-LOW"
PRIORITY_CHANNEL = {"1-URGENT": "manufacturing", "2-HIGH": "demand", "3-MEDIUM": "policy", "4-NOT SPECIFIED": "supply"}
TYPE_MAP = {"error": "supply_chain_fab_disruption", "click": "geopolitical_military_tension",
            "signup": "corporate_strategic", "purchase": "macroeconomic_conditions"}
SOURCE_OF = ["gdelt_derived", "rule_based", "llm_assisted", "manual", "ollama_assisted"]
SCORES_FROM = "1996-01-01"

# Words that do occur in the test prose, added to the fixed lists.
EXTRA = {"trade_export_control": ["the", "le"], "geopolitical_military_tension": ["that", "que"],
         "natural_disaster": ["from", "des"], "corporate_strategic": ["and", "la"]}
DICTIONARY = L.Dictionary(
    event_types={t: kws + EXTRA.get(t, []) for t, kws in dims.EVENT_TYPE_KEYWORDS.items()},
    severity={5: dims.SEVERITY_KEYWORDS[5] + ["with"], 4: dims.SEVERITY_KEYWORDS[4] + ["for"],
              3: dims.SEVERITY_KEYWORDS[3] + ["une"], 2: dims.SEVERITY_KEYWORDS[2] + ["qui"],
              1: dims.SEVERITY_KEYWORDS[1] + ["der"]},
    countries={**dims.COUNTRY_ALIASES, "United States": dims.COUNTRY_ALIASES["United States"] + ["you"],
               "Taiwan": dims.COUNTRY_ALIASES["Taiwan"] + ["un"], "Russia": dims.COUNTRY_ALIASES["Russia"] + ["die"]},
    bare_token=("The", "United States"),
    companies=[*dims.COMPANY_ALIASES, ("NVDA", "have"), ("JPM", "pour"), ("XOM", "und")],
    sectors={**dims.SECTOR_KEYWORDS, "energy": dims.SECTOR_KEYWORDS["energy"] + ["this"],
             "financials": dims.SECTOR_KEYWORDS["financials"] + ["elle"]},
)
HEADLINE_CONFIRM = [*L.headline_tension_words(), "the", "que"]
HEADLINE_REJECT = [*dims.HEADLINE_REJECT, "and", "la"]


def day(s: str) -> Column:
    return F.lit(s).cast("date")


class Fixture:
    """Lazily built input tables over one test-data folder.

    What the batch job keeps as a table (graph, clusters, attribution, bars,
    features) is written once and read by every consumer.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # -- events -------------------------------------------------------------
    @cached_property
    def span(self) -> tuple[Column, Column]:
        """First and last event day; one row reaches the driver."""
        d = F.to_date("published_at")
        first, last = self.events.agg(F.min(d), F.max(d)).first()
        return F.lit(first).cast("date"), F.lit(last).cast("date")

    @cached_property
    def events(self) -> DataFrame:
        e = self.table("events")
        eid, user = F.col("event_id"), F.col("user_id")
        return e.select(
            eid.alias("eid"), eid.cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("published_at"),
            user.alias("user_id"), F.col("event_type").alias("raw_type"), "value",
            F.get_json_object("props", "$.k").cast("int").alias("k0"),
            (1 + eid % 4).cast("int").alias("quad"), (((eid * 37) % 201 - 100) / F.lit(10.0)).alias("goldstein"),
            F.concat(F.lit("NATION_"), (user % 25).cast("string")).alias("actor1"),
            F.concat(F.lit("NATION_"), ((user * 7) % 25).cast("string")).alias("actor2"))

    @cached_property
    def labels(self) -> DataFrame:
        """classified_events (with publish time and source carried along)."""
        eid = F.col("eid")
        score = F.col("k0") / F.lit(100.0)
        return self.events.select(
            "event_id", "eid", "published_at",
            F.get(F.array(*[F.lit(s) for s in SOURCE_OF]), (eid % 5).cast("int")).alias("label_source"),
            F.coalesce(X.lookup("raw_type", TYPE_MAP), F.lit(dims.UNCLASSIFIED)).alias("event_type"),
            X.severity_band(score).alias("severity"), score.alias("severity_score"),
            (F.lit(0.25) + F.lit(0.1) * (eid % 7)).alias("confidence"),
            F.when(eid % 3 != 0, F.col("goldstein") / 10.0).alias("polarity"),
            F.array_sort(F.array_distinct(F.array("actor1", "actor2"))).alias("countries"))

    @cached_property
    def raw(self) -> DataFrame:
        """raw_events: one row per event; titles only on every third."""
        eid = F.col("eid")
        return self.events.select(
            F.col("event_id").alias("id"), "eid",
            F.when(eid % 2 == 0, "rss").otherwise("gdelt").alias("source"), "published_at",
            F.when(eid % 3 == 0, F.concat(F.lit("headline "), F.col("event_id"))).alias("title"),
            F.concat(F.lit("body "), F.col("raw_type")).alias("text"),
            F.concat(F.lit("http://example.com/"), (eid % 997).cast("string")).alias("url"))

    @cached_property
    def ledger(self) -> DataFrame:
        eid = F.col("eid")
        v = F.when(eid % 2 == 0, dims.CONFIRMED).when(eid % 7 == 1, "reject_stage2")
        return self.events.select("event_id", v.alias("verdict")).where("verdict is not null")

    @cached_property
    def scorable(self) -> DataFrame:
        """Labels that may be scored: typed, gated, with publish time."""
        return L.scorable(self.labels.drop("published_at"), self.raw, self.ledger)

    # -- graph --------------------------------------------------------------
    @cached_property
    def revenue(self) -> DataFrame:
        li = self.table("lineitem").select("l_orderkey", "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("rev"))
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        c = self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        n = self.table("nation").select("n_nationkey", "n_name")
        p = self.table("part").select("p_partkey", "p_brand")
        j = (li.join(p, li["l_partkey"] == p["p_partkey"]).join(o, li["l_orderkey"] == o["o_orderkey"])
             .join(c, F.col("o_custkey") == c["c_custkey"]).join(n, F.col("c_nationkey") == n["n_nationkey"]))
        return (j.groupBy(F.col("n_name").alias("country"), F.col("p_brand").alias("stock"),
                          F.col("o_orderpriority").alias("pr"), F.col("c_mktsegment").alias("seg"))
                .agg(F.sum("rev").alias("rev")))

    @cached_property
    def edges(self) -> DataFrame:
        """Direct edges by channel, nation -> segment, segment -> brand; the
        first two are revenue shares / 10 so that a month does not saturate."""
        low = F.col("pr") == SEGMENT_CHANNEL
        edge = lambda s, d, ch, down: F.struct(s.alias("src"), d.alias("dst"), ch.alias("channel"), F.lit(down).alias("down"))
        c, b, g, none = F.col("country"), F.col("stock"), F.col("seg"), F.lit(None).cast("string")
        # One pass over the revenue: a low-priority row feeds two edges.
        pairs = F.when(low, F.array(edge(c, g, F.lit("sector_broad"), False), edge(g, b, none, True))).otherwise(
            F.array(edge(c, b, X.lookup("pr", PRIORITY_CHANNEL), False)))
        w = (self.revenue.select("rev", F.explode(pairs).alias("e")).groupBy("e.src", "e.dst", "e.channel", "e.down")
             .agg(F.sum("rev").cast("decimal(38,2)").alias("w")))
        # At most one row per (nation | segment, brand | segment, channel).
        total = F.sum("w").over(Window.partitionBy("dst", "channel", "down")).cast("double")
        top = F.max("w").over(Window.partitionBy("src", "down")).cast("double")
        share = F.col("w").cast("double") / total / F.lit(10.0)
        weight = F.when(F.col("down"), F.col("w").cast("double") / top).otherwise(share)
        shares = w.select("src", "dst", "channel", weight.alias("weight"))
        note = F.concat(F.lit("§"), F.col("src"), F.lit("-"), F.col("dst"), F.lit(": "), F.coalesce("channel", F.lit("beta")), F.lit(" share"))
        return materialize(shares.withColumn("note", note), "edges")

    @cached_property
    def nodes(self) -> DataFrame:
        n = self.table("nation").select(F.col("n_name").alias("name"), F.lit("country").alias("node_type"))
        s = self.table("customer").select(F.col("c_mktsegment").alias("name"), F.lit("sector").alias("node_type")).distinct()
        return n.unionByName(s).unionByName(self.stocks.select(F.col("ticker").alias("name"), F.lit("stock").alias("node_type")))

    @cached_property
    def stocks(self) -> DataFrame:
        return self.table("part").select(F.col("p_brand").alias("ticker")).distinct()

    @cached_property
    def activation(self) -> DataFrame:
        return dims.activation_df(self.spark)

    @cached_property
    def reach(self) -> DataFrame:
        return materialize(G.reach(self.edges, self.nodes, self.activation), "reach")

    # -- scores -------------------------------------------------------------
    @cached_property
    def clusters(self) -> DataFrame:
        return materialize(SC.build_clusters(self.scorable, NATIONS), "clusters")

    @cached_property
    def cluster_reach(self) -> DataFrame:
        return SC.cluster_reach(self.clusters, self.reach)

    @cached_property
    def contributions(self) -> DataFrame:
        return SC.spread_days(self.cluster_reach, *self.span)

    @cached_property
    def daily(self) -> DataFrame:
        return SC.daily_scores(self.contributions, self.stocks, *self.span)

    @cached_property
    def attribution(self) -> DataFrame:
        return materialize(SC.attribution(self.contributions), "attribution")

    @cached_property
    def catalog(self) -> DataFrame:
        t = self.raw.select(F.col("id").alias("event_id"), "title", "url")
        return SC.event_catalog(self.clusters).join(t, "event_id", "left")

    # -- stored tables ------------------------------------------------------
    @cached_property
    def store(self) -> Store:
        """The jobs' tables in a folder of their own, empty at first."""
        return Store(self.spark, f"{shared_dir(self.spark)}/store-{uuid.uuid4().hex}")

    @cached_property
    def stored_bars(self) -> Table:
        self.store.bars.insert_or_ignore(self.bars, ["volume"])
        return self.store.bars

    @cached_property
    def stored_scores(self) -> Table:
        self.store.scores.insert_or_replace(self.daily)
        return self.store.scores

    # -- prices -------------------------------------------------------------
    @cached_property
    def bars(self) -> DataFrame:
        li = self.table("lineitem")
        p = self.table("part").select("p_partkey", "p_brand")
        t = li.join(p, li["l_partkey"] == p["p_partkey"]).select(
            F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date"), "l_quantity",
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("key"))
        b = t.groupBy("ticker", "date").agg(
            F.min_by("price", "key").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", "key").alias("close"), F.sum("l_quantity").cast("bigint").alias("volume"))
        return materialize(b.select("ticker", "date", "open", "high", "low", "close", F.col("close").alias("adj_close"), "volume"), "bars")

    @cached_property
    def score_days(self) -> DataFrame:
        """Scores with gaps: exact, carried and uncovered days all occur."""
        d = F.col("date")
        return (self.bars.where((F.unix_date(d) % 5 != 0) & (d >= day(SCORES_FROM)))
                .select("ticker", "date", (F.dayofyear(d) / F.lit(366.0)).alias("score")))

    @cached_property
    def joined(self) -> DataFrame:
        return FE.asof_scores(FE.indicators(self.bars), self.score_days)

    @cached_property
    def features(self) -> DataFrame:
        return materialize(FE.assign_splits(FE.usable(self.joined)), "features")

    @cached_property
    def predictions(self) -> DataFrame:
        """Two variants: mean of the previous five returns, and the same plus
        the previous return weighted by the score."""
        w = FE.by_ticker()
        prev = F.avg("daily_return").over(w.rowsBetween(-5, -1))
        rows = self.features.select("ticker", F.col("date").alias("label_date"), "split", F.col("daily_return").alias("actual"),
                                    F.lag("daily_return").over(w).alias("prior"), F.lag("date").over(w).alias("prior_date"),
                                    prev.alias("p"), "score", "rn").where("rn > 5")
        v = F.explode(F.array(F.struct(F.lit("baseline").alias("variant"), F.col("p").alias("predicted")),
                              F.struct(F.lit("with_score").alias("variant"), (F.col("p") + (F.col("score") - 0.5) * F.col("prior")).alias("predicted"))))
        return rows.select("*", v.alias("v")).select("ticker", "label_date", "prior_date", "split", "actual", "prior", "v.variant", "v.predicted")

    @cached_property
    def path_steps(self) -> DataFrame:
        """Windows of 5 steps after one another; fold = window % 4."""
        r = self.features.select("ticker", "date", "daily_return", "rn")
        win = F.floor((F.col("rn") - 1) / 5).cast("bigint")
        return (r.withColumn("window_id", win).withColumn("step", ((F.col("rn") - 1) % 5 + 1).cast("int")).select("ticker", "date", "window_id", "step", (win % 4).cast("int").alias("fold_id"), F.col("daily_return").alias("actual")))

    @cached_property
    def samples(self) -> DataFrame:
        """20 sample paths per window: the actual scaled and shifted."""
        s = self.path_steps.withColumn("sample_id", F.explode(F.sequence(F.lit(1), F.lit(20))))
        wobble = (F.col("sample_id") - 10) / F.lit(40.0)
        shift = ((F.col("window_id") % 7) - 3) / F.lit(10.0)
        return s.withColumn("value", F.col("actual") * (F.lit(1.0) + wobble) + shift * F.lit(0.5) + wobble * F.lit(0.6))

    @cached_property
    def forecasts(self) -> DataFrame:
        """Two vintages per ticker: 30 steps from the last bar and from the
        bar date 40 days earlier."""
        last = self.bars.groupBy("ticker").agg(F.max("date").alias("last"), F.max_by("close", "date").alias("close"))
        v = last.withColumn("as_of_date", F.explode(F.array(F.col("last"), F.date_sub("last", 40))))
        v = v.withColumn("horizon_step", F.explode(F.sequence(F.lit(1), F.lit(30))))
        price = F.col("close") * (F.lit(1.0) + F.col("horizon_step") / F.lit(1000.0))
        return v.select("ticker", F.lit("with_score").alias("variant"), "as_of_date", "horizon_step",
                        F.date_add("as_of_date", F.col("horizon_step")).alias("target_date"), price.alias("point_price"),
                        (price * 0.9).alias("lo_price"), (price * 1.1).alias("hi_price"))

    # -- texts --------------------------------------------------------------
    @cached_property
    def docs(self) -> DataFrame:
        """Documents as (id, title, text): the title is the first line."""
        d = self.table("documents")
        return d.select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.substring_index("text", "\n", 1).alias("title"),
                        "text", "lang", "source")

    @cached_property
    def doc_labels(self) -> DataFrame:
        return L.label_by_rules(self.docs, DICTIONARY)

    @cached_property
    def judged(self) -> DataFrame:
        """Labelled documents with a rule's guess: gold and pred in 0/1."""
        d = self.table("documents").select("doc_id", "text", "lang", "n_chars")
        l = self.table("labels").select("doc_id", "quality", "toxic")
        guess = F.when(F.col("n_chars") % 3 == 0, "0").otherwise("1")
        return d.join(l, "doc_id").select("doc_id", "text", "lang", F.col("quality").cast("string").alias("gold"), guess.alias("pred"), "toxic")

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages")

    def coded_lines(self, width: int, place: int, added: int, url: int, daily: bool) -> DataFrame:
        """Events written as export lines; every 11th is one column short, so
        malformed lines, bad numbers, bad stamps and blanks all occur."""
        e, eid = self.events, F.col("eid")
        stamp = F.date_format("published_at", "yyyyMMdd" if daily else "yyyyMMddHHmmss")
        cells: dict[int, Column] = {
            0: F.col("event_id"), 1: F.date_format("published_at", "yyyyMMdd"), 5: F.lit("GOV"), 6: F.lit(" Name "),
            7: F.when(eid % 6 == 0, F.lit("")).otherwise(F.col("actor1")), 15: F.lit(""), 16: F.lit(""), 17: F.col("actor2"),
            25: F.lit("1"), 26: F.lit("190"), 27: F.lit("190"), 28: F.lit("19"), 29: F.col("quad").cast("string"),
            30: F.when(eid % 13 == 0, F.lit("n/a")).otherwise(F.format_string("%.1f", "goldstein")),
            31: F.concat(F.lit(" "), F.col("k0").cast("string"), F.lit(" ")), 32: F.lit("1"), 33: F.lit("2"), 34: F.lit("-1.5"),
            place: F.lit("US"), added: F.when(eid % 17 == 0, F.lit("soon")).otherwise(stamp),
            url: F.when(eid % 5 == 0, F.lit("BBC Monitoring")).otherwise(F.concat(F.lit("HTTP://Example.com/A/"), (eid % 97).cast("string"), F.lit("/#x"))),
        }
        full = F.array(*[cells.get(i, F.lit("")) for i in range(width)])
        line = F.array_join(F.when(eid % 11 == 0, F.slice(full, 1, width - 1)).otherwise(full), "\t")
        return e.select("eid", line.alias("value"), F.concat(F.lit("/in/"), F.date_format("published_at", "yyyyMMdd"), F.lit(".export.CSV")).alias("file"))
