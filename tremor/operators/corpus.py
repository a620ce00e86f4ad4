"""Text corpus preparation and the event-type classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions import text as TX
from tremor.operators import ranks

PAD, UNK, MAX_VOCAB = 0, 1, 20_000


def vocabulary(train: DataFrame, text: str, max_size: int = MAX_VOCAB, min_freq: int = 1) -> DataFrame:
    """(token, count, token_id), by frequency then token; ids start at 2.

    Counting is a shuffled aggregate; the top-k limit then bounds the rows the
    single ordered window sees to the vocabulary cap.
    """
    counts = (train.select(F.explode(TX.tokenize(text)).alias("token")).groupBy("token")
              .agg(F.count("*").alias("count")).where(F.col("count") >= min_freq))
    top = counts.orderBy(F.col("count").desc(), "token").limit(max_size - 2)
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("count").desc(), "token")
    return top.withColumn("token_id", F.row_number().over(w) + 1)


def encode(docs: DataFrame, vocab: DataFrame, doc_id: str, text: str, max_len: int) -> DataFrame:
    """Token ids, truncated to ``max_len``, unknown -> 1, padded with 0.

    The vocabulary is capped, hence safe to broadcast; truncation happens
    before the explode, so a long document adds at most ``max_len`` rows.
    """
    toks = F.slice(TX.tokenize(text), 1, max_len)
    pos = docs.select(F.col(doc_id), F.posexplode_outer(toks).alias("pos", "token"))
    ids = pos.join(F.broadcast(vocab.select("token", "token_id")), "token", "left")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("token_id", F.lit(UNK)).alias("id")))
    seqs = ids.groupBy(doc_id).agg(F.array_sort(F.collect_list(item)).alias("s"))
    body = F.transform("s", lambda x: x["id"])
    return seqs.select(doc_id, F.concat(body, F.array_repeat(F.lit(PAD), F.lit(max_len) - F.size("s"))).alias("ids"))


def hash_key(id_col: Column, seed: int) -> Column:
    """60-bit repeatable random key."""
    digest = F.sha2(F.concat(id_col.cast("string"), F.lit(f"|{seed}")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def stratified_split(rows: DataFrame, id_col: str, label: str, val_frac: float = 0.15, seed: int = 42) -> DataFrame:
    """Per class round(val_frac * n) rows go to val (half to even), none when
    n < 2, never all.

    One class may hold most rows, so the cut is an exact order statistic of
    the hash key instead of a window over the class.
    """
    keyed = rows.withColumn("_h", hash_key(F.col(id_col), seed))
    n = F.col("n")
    n_val = F.when(n >= 2, F.least(F.bround(n * F.lit(val_frac), 0), n - 1)).otherwise(0)
    cut = ranks.order_statistic(keyed, [label], "_h", n_val, out="_cut").select(label, "_cut")
    return (keyed.join(cut, label).withColumn("split", F.when(F.col("_h") <= F.col("_cut"), "val").otherwise("train"))
            .drop("_h", "_cut"))


def class_support(rows: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    c = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("support"))
    return classes.select("label").join(c, "label", "left").na.fill(0, ["support"])


def class_weights(support: DataFrame) -> DataFrame:
    """Inverse frequency, scaled to sum to the number of classes; an empty
    class counts as one row."""
    inv = 1.0 / F.greatest(F.col("support"), F.lit(1))
    w = Window.partitionBy(F.lit(1))  # one row per class
    return support.withColumn("weight", inv / F.sum(inv).over(w) * F.count("*").over(w))


def training_pool(raw: DataFrame, labels: DataFrame, holdout: DataFrame, source: str, label_source: str) -> DataFrame:
    """Texts of a source with a label of a labeller, minus the holdout ids."""
    lab = labels.where(F.col("label_source") == label_source).select(F.col("event_id").alias("id"), "event_type")
    return (raw.where(F.col("source") == source).join(lab, "id").join(holdout.select("id"), "id", "left_anti")
            .select("id", TX.combined_text("title", "text").alias("text"), "event_type"))


def label_agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))


def hashed_counts(rows: DataFrame, text: str, out: str = "features", n_features: int = 1 << 16) -> DataFrame:
    """Hashed token counts of a text as a sparse vector: what the classifier
    reads.  A fit passes over its rows some twenty times, so store these once
    where the texts are long."""
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    tokens = RegexTokenizer(inputCol=text, outputCol="_tok", pattern="[a-z0-9']+", gaps=False).transform(rows)
    return HashingTF(inputCol="_tok", outputCol=out, numFeatures=n_features).transform(tokens).drop("_tok")


def fit_classifier(train: DataFrame, features: str, label: str, weight: str):
    """Class-weighted multinomial model over hashed token counts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer

    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep", stringOrderType="alphabetAsc"),
        LogisticRegression(featuresCol=features, labelCol="_y", weightCol=weight, maxIter=20, regParam=0.01),
    ]).fit(train)
