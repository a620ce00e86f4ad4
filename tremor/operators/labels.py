"""Labelling: keyword rules, coded events, headline screen, model verdicts."""

from __future__ import annotations

from itertools import groupby
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor import dims
from tremor import schemas as S
from tremor.functions import exprs as X
from tremor.functions import text as TX
from tremor.functions.phrases import found_keywords

# Fixed values of the coded-event transform.
GOLDSTEIN_WEIGHT, MENTIONS_WEIGHT, MENTIONS_CAP = 0.65, 0.35, 20


@dataclass(frozen=True)
class Dictionary:
    """Word lists of the rule labeller (defaults: the fixed lists)."""

    event_types: dict[str, list[str]] = field(default_factory=lambda: dims.EVENT_TYPE_KEYWORDS)
    severity: dict[int, list[str]] = field(default_factory=lambda: dims.SEVERITY_KEYWORDS)
    countries: dict[str, list[str]] = field(default_factory=lambda: dims.COUNTRY_ALIASES)
    bare_token: tuple[str, str] | None = ("US", "United States")
    companies: list[tuple[str, str]] = field(default_factory=lambda: dims.COMPANY_ALIASES)
    ticker_sector: dict[str, str] = field(default_factory=lambda: dims.TICKER_SECTOR)
    sectors: dict[str, list[str]] = field(default_factory=lambda: dims.SECTOR_KEYWORDS)

    def all_keywords(self) -> list[str]:
        lists = [*self.event_types.values(), *self.severity.values(), *self.countries.values(), *self.sectors.values()]
        return [k for ks in lists for k in ks] + [alias for _, alias in self.companies]


def event_type_match(lowered: Column | str, d: Dictionary, found: Column | str | None = None) -> Column:
    """struct(n, ord, event_type, hits): most distinct keywords; the earlier
    category wins a tie; null when nothing matched."""
    found = [TX.hits(lowered, kws, found) for kws in d.event_types.values()]
    cats = F.array(*[
        F.struct(F.size(h).alias("n"), F.lit(-i).alias("ord"), F.lit(t).alias("event_type"), h.alias("hits"))
        for i, (t, h) in enumerate(zip(d.event_types, found))])
    return F.array_max(F.filter(cats, lambda c: c["n"] > 0))


def severity_match(lowered: Column | str, d: Dictionary, found: Column | str | None = None) -> Column:
    """First band, from 5 down to 1, with any keyword; null if none."""
    bands = sorted(d.severity, reverse=True)
    return F.coalesce(*[F.when(TX.any_hit(lowered, d.severity[b], found), F.lit(b)) for b in bands])


def match_countries(original: Column | str, lowered: Column | str, d: Dictionary,
                    found: Column | str | None = None) -> Column:
    names = []
    for name, aliases in d.countries.items():
        hit = TX.any_hit(lowered, aliases, found)
        if d.bare_token and d.bare_token[1] == name:
            hit = hit | TX.token_hit(original, d.bare_token[0])
        names.append(F.when(hit, F.lit(name)))
    return F.array_sort(F.array_compact(F.array(*names)))


def _by_ticker(d: Dictionary) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for ticker, alias in d.companies:
        out.setdefault(ticker, []).append(alias)
    return out


def match_companies(lowered: Column | str, d: Dictionary, found: Column | str | None = None) -> Column:
    hits = [F.when(TX.any_hit(lowered, als, found), F.lit(t)) for t, als in _by_ticker(d).items()]
    return F.array_sort(F.array_compact(F.array(*hits)))


def match_sector(lowered: Column | str, d: Dictionary, found: Column | str | None = None) -> Column:
    """A named company decides (first alias in listing order), else the first
    sector with a keyword hit.  Neighbouring aliases of one sector share a test."""
    runs = [(s, [a for _, a in run]) for s, run in groupby(d.companies, key=lambda c: d.ticker_sector[c[0]])]
    named = [F.when(TX.any_hit(lowered, als, found), F.lit(s)) for s, als in runs]
    worded = [F.when(TX.any_hit(lowered, kws, found), F.lit(s)) for s, kws in d.sectors.items()]
    return F.coalesce(*named, *worded)


def rule_confidence(n_hits: Column) -> Column:
    return F.round(F.least(F.lit(0.25) + F.lit(0.10) * n_hits, F.lit(0.85)), 4)


def label_by_rules(events: DataFrame, d: Dictionary | None = None, event_id: str = "id",
                   title: str = "title", text: str = "text", version: str = "rules-1") -> DataFrame:
    """Full rule label of each (title, text) row: a map-only projection."""
    d = d or Dictionary()
    rows = events.withColumn("_all", TX.combined_text(title, text))
    rows = rows.withColumn("_found", found_keywords("_all", d.all_keywords()))
    rows = rows.withColumn("_m", event_type_match("_all", d, "_found"))
    typed, n = F.col("_m").isNotNull(), F.col("_m.n")
    severity = F.when(~typed, F.lit(1)).otherwise(F.coalesce(severity_match("_all", d, "_found"), F.lit(2)))
    rows = rows.withColumn("_sev", severity)
    reasoning = (F.when(F.col("_all") == "", "no title/text available for keyword matching")
                 .when(~typed, "no event-type keyword matched title/text")
                 .otherwise(F.concat(F.lit("event_type keywords: "), F.array_join("_m.hits", ", "))))
    return rows.select(
        F.col(event_id).cast("string").alias("event_id"),
        F.lit(dims.RULE_SOURCE).alias("label_source"),
        F.coalesce(F.col("_m.event_type"), F.lit(dims.UNCLASSIFIED)).alias("event_type"),
        F.col("_sev").alias("severity"),
        X.severity_midpoint("_sev").alias("severity_score"),
        F.when(typed, rule_confidence(n)).otherwise(F.lit(0.0)).alias("confidence"),
        F.lit(None).cast("double").alias("polarity"),
        match_countries("_all", "_all", d, "_found").alias("countries"),
        match_sector("_all", d, "_found").alias("sector"),
        match_companies("_all", d, "_found").alias("companies"),
        reasoning.alias("reasoning"),
        F.lit(version).alias("labeler_version"))


# -- coded events -----------------------------------------------------------
def coded_columns(quad: Column, goldstein: Column, mentions: Column) -> dict[str, Column]:
    conflict = F.coalesce(quad.isin(3, 4), F.lit(False))
    g = F.coalesce(X.clip(-goldstein / 10.0, 0.0, 1.0), F.lit(0.0))
    m = X.clip(F.log1p(F.coalesce(mentions, F.lit(0)).cast("double")) / F.log1p(F.lit(float(MENTIONS_CAP))), 0.0, 1.0)
    score = F.round(X.clip(GOLDSTEIN_WEIGHT * g + MENTIONS_WEIGHT * m, 0.0, 1.0), 4)
    return {
        "event_type": F.when(conflict, dims.TENSION).otherwise(dims.UNCLASSIFIED),
        "severity": X.severity_band(score),
        "severity_score": score,
        "confidence": F.when(quad == 4, 0.55).when(quad == 3, 0.40).otherwise(0.15),
        "polarity": X.clip(goldstein / 10.0, -1.0, 1.0),
    }


def label_coded(events: DataFrame, event_id: Column, quad: Column, goldstein: Column, mentions: Column,
                countries: Column, keep: list[str] | None = None, version: str = "coded-1") -> DataFrame:
    """Label of coded events; polarity stays null when the scale is null."""
    c = coded_columns(quad, goldstein, mentions)
    return events.select(
        event_id.cast("string").alias("event_id"),
        F.lit(dims.CODED_SOURCE).alias("label_source"),
        *[v.alias(n) for n, v in c.items()],
        countries.alias("countries"),
        F.lit(None).cast("string").alias("sector"),
        F.array().cast("array<string>").alias("companies"),
        F.concat(F.lit("quad class "), F.coalesce(quad.cast("string"), F.lit("missing"))).alias("reasoning"),
        F.lit(version).alias("labeler_version"),
        *(keep or []))


# -- headline screen and model verdicts -------------------------------------
def headline_tension_words() -> list[str]:
    base = [k for k in dims.EVENT_TYPE_KEYWORDS[dims.TENSION] if k not in dims.HEADLINE_TOO_GENERIC]
    return base + dims.HEADLINE_EXTRA_TENSION


def screen_headlines(rows: DataFrame, title: str = "title", confirm: list[str] | None = None,
                     reject: list[str] | None = None, out: str = "screen") -> DataFrame:
    """Adds confirm / reject / uncertain: a hit in one list only decides."""
    confirm, reject = confirm or headline_tension_words(), reject or dims.HEADLINE_REJECT
    rows = rows.withColumn("_found", found_keywords(title, [*confirm, *reject]))
    rows = rows.withColumn("_geo", TX.any_hit(title, confirm, "_found")).withColumn("_rej", TX.any_hit(title, reject, "_found"))
    geo, rej = F.col("_geo"), F.col("_rej")
    return (rows.withColumn(out, F.when(geo & ~rej, "confirm").when(rej & ~geo, "reject").otherwise("uncertain"))
            .drop("_found", "_geo", "_rej"))


def fold_verdicts(answers: DataFrame, event_id: str = "event_id", answer: str = "answer",
                  version: str = "model-1") -> DataFrame:
    """Model answers (JSON text) as labels; unknown types and bad JSON drop
    out, i.e. they count as "no answer" and are asked again."""
    v = answers.select(F.col(event_id).cast("string").alias("event_id"),
                       F.from_json(answer, S.MODEL_VERDICT).alias("v"))
    v = v.where(F.col("v.event_type").isin(dims.EVENT_TYPES))
    score = X.tolerant_clip(F.col("v.severity_score").try_cast("double"), 0.5)
    # JSON integers only: "3.0" or "high" fall back to the score.
    given = F.when(F.col("v.severity").rlike("^-?[0-9]+$"), F.col("v.severity").try_cast("int"))
    derived = F.greatest(F.lit(1), F.least(F.lit(5), (F.bround(score * 4.0, 0) + 1).cast("int")))
    empty = F.array().cast("array<string>")
    return v.select(
        "event_id", F.lit(dims.MODEL_SOURCE).alias("label_source"),
        F.col("v.event_type").alias("event_type"),
        F.when(given.between(1, 5), given).otherwise(derived).alias("severity"),
        score.alias("severity_score"),
        X.tolerant_clip(F.col("v.confidence").try_cast("double"), 0.5).alias("confidence"),
        F.col("v.polarity").alias("polarity"),
        F.coalesce("v.countries", empty).alias("countries"), F.col("v.sector").alias("sector"),
        F.coalesce("v.companies", empty).alias("companies"), F.col("v.reasoning").alias("reasoning"),
        F.lit(version).alias("labeler_version"))


def accepted() -> Column:
    return (F.col("event_type") == dims.TENSION) & (F.col("confidence") >= dims.MIN_CONFIRM_CONFIDENCE)


def recheck_candidates(catalog: DataFrame, ledger: DataFrame, label_source: str = dims.CODED_SOURCE,
                       event_type: str = dims.TENSION) -> DataFrame:
    """Catalog rows of one source and type, with a title, not yet checked."""
    rows = catalog.where((F.col("label_source") == label_source) & (F.col("event_type") == event_type)
                         & F.col("title").isNotNull())
    return rows.select("event_id", "title").join(ledger.select("event_id"), "event_id", "left_anti")


def recheck(candidates: DataFrame, verdict_labels: DataFrame) -> DataFrame:
    """Outcome of each screened candidate (see :func:`screen_headlines`): reject_stage1, confirm_stage2, reject_stage2
    or null (no answer: left for the next run).

    From it: new labels = the verdict rows of confirm_stage2, labels to delete
    = any reject, ledger rows = any non-null outcome (:func:`recheck_outputs`).
    """
    v = verdict_labels.select("event_id", accepted().alias("ok"))
    j = candidates.join(v, "event_id", "left")
    return j.withColumn("verdict", F.when(F.col("screen") == "reject", "reject_stage1")
                        .when(F.col("ok"), dims.CONFIRMED)
                        .when(~F.col("ok"), "reject_stage2"))


def recheck_outputs(outcome: DataFrame, verdict_labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    new = verdict_labels.join(outcome.where(F.col("verdict") == dims.CONFIRMED).select("event_id"), "event_id", "left_semi")
    delete = outcome.where(F.col("verdict").startswith("reject")).select(
        "event_id", F.lit(dims.CODED_SOURCE).alias("label_source"))
    checked = outcome.where("verdict is not null").select("event_id", "verdict")
    return new, delete, checked


# -- incremental runs and checks --------------------------------------------
def unlabelled(raw: DataFrame, labels: DataFrame, source: str, label_source: str,
               ledger: DataFrame | None = None) -> DataFrame:
    """Rows of a source this labeller has not labelled; ids in the ledger stay
    out too, or deleted labels would come back."""
    done = labels.where(F.col("label_source") == label_source).select(F.col("event_id").alias("id"))
    rows = raw.where(F.col("source") == source).join(done, "id", "left_anti")
    if ledger is not None:
        rows = rows.join(ledger.select(F.col("event_id").alias("id")), "id", "left_anti")
    return rows


def label_problem() -> Column:
    return (F.when(~F.col("label_source").isin(dims.LABEL_SOURCES), "unknown label source")
            .when(~F.col("event_type").isin(dims.EVENT_TYPES), "unknown event type")
            .when(~F.col("severity").between(1, 5) | F.col("severity").isNull(), "severity out of range"))


def scorable(labels: DataFrame, raw: DataFrame, ledger: DataFrame | None, sources: list[str] | None = None,
             since: Column | None = None) -> DataFrame:
    """Typed labels with their publish time; coded tension rows count only if
    confirmed.  Without a ledger the gate is not applied."""
    rows = labels.where(F.col("event_type") != dims.UNCLASSIFIED)
    if sources:
        rows = rows.where(F.col("label_source").isin(sources))
    published = raw.select(F.col("id").alias("event_id"), "published_at")
    if since is not None:
        published = published.where(F.col("published_at") >= since)
    rows = rows.join(published, "event_id")
    if ledger is None:
        return rows
    # Same key as the join above, so the labels are not shuffled again.
    gated = (F.col("label_source") == dims.CODED_SOURCE) & (F.col("event_type") == dims.TENSION)
    confirmed = ledger.where(F.col("verdict") == dims.CONFIRMED).select("event_id", F.lit(True).alias("_confirmed"))
    return rows.join(confirmed, "event_id", "left").where(~gated | F.col("_confirmed").isNotNull()).drop("_confirmed")


def corpus_counts(labels: DataFrame) -> DataFrame:
    """Counts by source, type, severity and overall in one pass."""
    g = labels.groupingSets([["label_source"], ["event_type"], ["severity"], []],
                            "label_source", "event_type", "severity")
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < 0.3).alias("n_low_confidence"))


def review_sample(labels: DataFrame, raw: DataFrame, label_source: str, n: int, seed: int = 42) -> DataFrame:
    """Repeatable random sample: order by a salted hash, take n."""
    rows = labels.where(F.col("label_source") == label_source).join(
        raw.select(F.col("id").alias("event_id"), "title", "url", "source"), "event_id")
    return rows.orderBy(F.sha2(F.concat("event_id", F.lit(f"|{seed}")), 256)).limit(n)
