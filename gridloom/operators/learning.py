"""Classification of texts, feature preparation and clustering with Spark ML."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gridloom.functions.staging import materialize
from gridloom.operators.checks import CheckFailed, fail_if_any
from gridloom.operators.panelstats import classification_metrics
from gridloom.operators.ranges import running_total
from gridloom.operators.text_groups import char_ngrams

#: Grams that a model may hold: a weight per gram and class lies on the driver.
LARGEST = 1 << 22


@dataclass
class TextClassifier:
    model: LogisticRegressionModel
    labels: list[str]
    idf: DataFrame  # gram, slot, idf
    text_cols: list[str]


def _cut(grams: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, gram number, occurrences, grams) of a batch of rows with lists of grams, each gram of a row once."""
    sizes = grams.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = grams.flatten().dictionary_encode()
    many = max(1, len(coded.dictionary))
    key, tf = np.unique(np.repeat(np.arange(len(grams)), sizes) * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return key // many, key % many, tf, coded.dictionary


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that hold each gram, per batch, for rows of grams and the number of rows with that text."""
    for batch in batches:
        row, gram, _, grams = _cut(batch.column(0))
        held = np.bincount(gram, weights=batch.column(1).to_numpy(zero_copy_only=False)[row], minlength=len(grams))
        yield pa.RecordBatch.from_arrays([grams, pa.array(held.astype(np.int64))], names=["gram", "df"])


def _sparse(held, width: int):
    """Sorted and normed sparse vectors behind the other columns of a batch, in the layout of Spark's vectors; ``held`` is the broadcast vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, slots, idf = held.value
        kinds = [pa.field("type", pa.int8(), False), pa.field("size", pa.int32()), pa.field("indices", pa.list_(pa.field("element", pa.int32(), False))), pa.field("values", pa.list_(pa.field("element", pa.float64(), False)))]
        for batch in batches:
            n = len(batch)
            row, gram, tf, names = _cut(batch.column(batch.num_columns - 1))
            place = pc.index_in(names, value_set=grams).fill_null(-1).to_numpy(zero_copy_only=False)[gram] if len(names) else gram
            row, tf, place = row[place >= 0], tf[place >= 0], place[place >= 0]
            w, slot = (1 + np.log(tf)) * idf[place], slots[place]
            order = np.lexsort((slot, row))
            norm = np.sqrt(np.bincount(row, weights=w * w, minlength=n))
            w = (w / np.where(norm > 0, norm, 1.0)[row])[order]
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
            values = [pa.array(np.zeros(n), pa.int8()), pa.array(np.full(n, width), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(slot[order], pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(w))]
            values = [v.cast(k.type) for v, k in zip(values, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.StructArray.from_arrays(values, fields=kinds)], names=[*batch.schema.names[:-1], "features"])

    return work


def _vectors(df: DataFrame, idf: DataFrame, text: str, width: int) -> DataFrame:
    """``df`` with ``features``, made row by row; a row without known grams has an empty vector.

    The vocabulary (at most ``LARGEST`` grams) reaches the tasks as Arrow columns; no row is shuffled or joined.
    """
    from pyspark.ml.linalg import VectorUDT

    known = idf.select("gram", "slot", "idf").toArrow()
    columns = known.column("gram").combine_chunks(), known.column("slot").to_numpy(), known.column("idf").to_numpy()
    held = df.sparkSession.sparkContext.broadcast(columns)
    rows = df.select(*df.columns, char_ngrams(F.col(text)).alias("_grams"))
    return rows.mapInArrow(_sparse(held, width), StructType([*df.schema.fields, StructField("features", VectorUDT())]))


def _training(df: DataFrame, text: str, label: str, min_df: int) -> tuple[DataFrame, DataFrame, list, int]:
    """(distinct texts and labels with features, class number ``y`` and balanced weight ``wt`` of all their rows; vocabulary; classes; rows)."""
    texts = materialize(df.groupBy(F.col(text).alias("text"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")), "texts")
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # one row per class
    n = sum(sizes.values())
    counts = texts.select(char_ngrams(F.col("text")).alias("grams"), "n").mapInArrow(_holders, "gram string, df long")
    grams = materialize(counts.groupBy("gram").agg(F.sum("df").alias("df")).where(F.col("df") >= min_df).withColumn("one", F.lit(1)), "grams")
    idf = running_total(grams, "gram", "one", "place").select("gram", (F.col("place") - 1).cast("int").alias("slot"), (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    idf = materialize(idf, "idf")
    width = idf.count()
    if len(sizes) < 2 or not 0 < width <= LARGEST:
        raise CheckFailed(f"a classifier needs two classes and up to {LARGEST} grams: {len(sizes)} and {width}")
    labels = sorted(sizes, key=str)
    index = F.create_map(*[x for i, k in enumerate(labels) for x in (F.lit(k), F.lit(float(i)))])
    weight = F.create_map(*[x for k in labels for x in (F.lit(k), F.lit(n / (len(labels) * sizes[k])))])
    rows = _vectors(texts, idf, "text", width).select("features", index[F.col("label")].alias("y"), (weight[F.col("label")] * F.col("n")).alias("wt"))
    return materialize(rows, "train"), idf, labels, n


def fit_text_classifier(df: DataFrame, row_id: str, text: str, label: str, min_df: int = 2, c: float = 1.0, max_iter: int = 50, tol: float = 1e-6) -> TextClassifier:
    """Character n-grams, sublinear TF-IDF and a multinomial logistic regression with balanced class weights; exact vocabulary."""
    train, idf, labels, n = _training(df, text, label, min_df)
    lr = LogisticRegression(featuresCol="features", labelCol="y", weightCol="wt", family="multinomial", standardization=False, regParam=1.0 / (c * n), maxIter=max_iter, tol=tol)
    return TextClassifier(lr.fit(train), [str(x) for x in labels], idf, [text])


def optimality(clf: TextClassifier, df: DataFrame, row_id: str, text: str, label: str, min_df: int = 2, c: float = 1.0) -> DataFrame:
    """``(n_rows, n_classes, n_features, residual)``: the largest entry of the gradient of the penalised likelihood at the fit.

    Per class and gram the weighted errors times the features, averaged, plus the penalty must vanish, and per class the averaged errors.
    The residuals are added up as (class, gram) rows, never as a matrix.
    """
    train, _, labels, n = _training(df, text, label, min_df)
    scored = clf.model.transform(train).select("y", "wt", vector_to_array("probability").alias("p"), "features")
    errors = F.transform("p", lambda p, j: (p - F.when(F.col("y") == j, 1.0).otherwise(0.0)) * F.col("wt"))
    rows = scored.select(errors.alias("e"), F.unwrap_udt("features").alias("x"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = np.array(batch.column(0).to_pylist(), dtype=np.float64).reshape(len(batch), -1)
            x = batch.column(1)
            ids, values = x.field("indices"), x.field("values")
            row = np.repeat(np.arange(len(batch)), ids.value_lengths().to_numpy(zero_copy_only=False))
            slot, v = ids.flatten().to_numpy(), values.flatten().to_numpy()
            known, at = np.unique(slot, return_inverse=True)
            for j in range(e.shape[1]):
                sums = np.bincount(at, weights=e[row, j] * v, minlength=len(known))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known) + 1, j), pa.int32()), pa.array([*known.tolist(), -1], pa.int32()), pa.array([*sums.tolist(), float(e[:, j].sum())])], names=["j", "slot", "g"])

    total = train.agg(F.sum("wt")).first()[0]
    summed = rows.mapInArrow(products, "j int, slot int, g double").groupBy("j", "slot").agg((F.sum("g") / total).alias("g"))
    beta = clf.model.coefficientMatrix.toArray()
    # A row per gram: the weights of all classes.
    weights = df.sparkSession.createDataFrame([(int(m), beta[:, m].tolist()) for m in range(beta.shape[1])], "slot int, beta array<double>")
    penal = summed.join(weights, "slot", "left").withColumn("g", F.col("g") + F.coalesce(F.get("beta", F.col("j")), F.lit(0.0)) / (c * n))
    return penal.agg(F.lit(n).cast("long").alias("n_rows"), F.lit(len(labels)).alias("n_classes"), F.lit(beta.shape[1]).cast("long").alias("n_features"), F.max(F.abs("g")).alias("residual"))


def predict_labels(clf: TextClassifier, df: DataFrame, row_id: str, text: str, low: float = 0.5, taxonomy: DataFrame | None = None) -> DataFrame:
    """Label, confidence (largest probability), low-confidence flag and, with a taxonomy, the parent."""
    out = clf.model.transform(_vectors(df, clf.idf, text, clf.model.numFeatures))
    names = F.array(*[F.lit(x) for x in clf.labels])
    out = out.withColumn("pred_label", F.element_at(names, (F.col("prediction") + 1).cast("int"))).withColumn("confidence", F.array_max(vector_to_array("probability")))
    out = out.withColumn("low_confidence", F.col("confidence") < low).drop("features", "rawPrediction", "probability", "prediction")
    return out if taxonomy is None else out.join(taxonomy.select(F.col("child").alias("pred_label"), "parent"), "pred_label", "left")


def group_folds(df: DataFrame, group: str, label: str, k: int) -> DataFrame:
    """``(group, fold)``: whole groups, largest first, into the fold where the label counts stay most even."""
    counts = df.groupBy(group, label).count().collect()  # one row per group and class
    by_group: dict = {}
    for r in counts:
        by_group.setdefault(r[group], {})[r[label]] = r["count"]
    if len(by_group) < k:
        raise CheckFailed(f"{len(by_group)} groups for {k} folds")
    totals: list[dict] = [{} for _ in range(k)]
    rows = []
    for g, c in sorted(by_group.items(), key=lambda x: (-sum(x[1].values()), str(x[0]))):
        cost = [(sum((t.get(y, 0) + n) ** 2 - t.get(y, 0) ** 2 for y, n in c.items()), sum(t.values()), i) for i, t in enumerate(totals)]
        i = min(cost)[2]
        for y, n in c.items():
            totals[i][y] = totals[i].get(y, 0) + n
        rows.append((g, i))
    return df.sparkSession.createDataFrame(rows, f"`{group}` {dict(df.dtypes)[group]}, fold int")


def group_cv(df: DataFrame, row_id: str, text: str, label: str, group: str, k: int = 3, **kw) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold predictions, metrics)."""
    # One row per group, which the driver holds anyway; Spark knows no size of it and would send the rows instead.
    rows = df.join(F.broadcast(group_folds(df, group, label, k)), group)
    parts = None
    for fold in range(k):
        clf = fit_text_classifier(rows.where(F.col("fold") != fold), row_id, text, label, **kw)
        got = predict_labels(clf, rows.where(F.col("fold") == fold), row_id, text)
        parts = got if parts is None else parts.unionByName(got)
    out = materialize(parts.select(row_id, group, F.col(label).cast("string").alias(label), "fold", "pred_label", "confidence"), "cv")
    return out, classification_metrics(out, label, "pred_label")


def choose_best(results: Mapping[str, DataFrame]) -> str:
    """The variant of the best (macro F1, weighted F1), ties to the first name."""
    rows = {n: m.first() for n, m in results.items()}
    return min(rows, key=lambda n: (-rows[n]["macro_f1"], -rows[n]["weighted_f1"], n))


def save_model(clf: TextClassifier, path: str, metadata: Mapping[str, object] | None = None) -> None:
    """Model, vocabulary weights and metadata with a fingerprint of the vocabulary."""
    clf.model.write().overwrite().save(f"{path}/model")
    clf.idf.write.mode("overwrite").parquet(f"{path}/idf")
    meta = {"labels": clf.labels, "text_cols": clf.text_cols, "checksum": _checksum(clf.idf, clf.model), **(metadata or {})}
    clf.idf.sparkSession.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark, path: str) -> TextClassifier:
    """The saved classifier; a changed vocabulary or model raises."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    clf = TextClassifier(LogisticRegressionModel.load(f"{path}/model"), meta["labels"], spark.read.parquet(f"{path}/idf"), meta["text_cols"])
    if _checksum(clf.idf, clf.model) != meta["checksum"]:
        raise CheckFailed("the stored model does not match its checksum")
    return clf


def _checksum(idf: DataFrame, model: LogisticRegressionModel) -> str:
    total = idf.agg(F.sum(F.xxhash64("gram", "slot", F.bround("idf", 9)).cast("decimal(38,0)"))).first()[0]
    return f"{total}:{float(abs(model.coefficientMatrix.toArray()).sum()):.9e}"


def preprocessor(numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    """Median imputation and scaling of numbers; mode is the most frequent class, then one-hot coding."""
    imputed = [f"{c}_imp" for c in numeric]
    coded, hot = [f"{c}_idx" for c in categorical], [f"{c}_hot" for c in categorical]
    stages = []
    if numeric:
        stages += [Imputer(strategy="median", inputCols=list(numeric), outputCols=imputed), VectorAssembler(inputCols=imputed, outputCol="_num"), StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True)]
    if categorical:
        stages += [StringIndexer(inputCols=list(categorical), outputCols=coded, handleInvalid="keep"), OneHotEncoder(inputCols=coded, outputCols=hot)]
    stages.append(VectorAssembler(inputCols=(["_scaled"] if numeric else []) + hot, outputCol="features"))
    return Pipeline(stages=stages)


def fill_modes(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls of categorical columns by the most frequent value of the training rows."""
    modes = train.agg(*[F.mode(c).alias(c) for c in cols]).first()
    return df.fillna({c: modes[c] for c in cols if modes[c] is not None})


def compare_models(models: Mapping[str, object], df: DataFrame, label: str, row_id: str, k: int = 3, seed: int = 0) -> DataFrame:
    """Mean and deviation of the accuracy over k folds by the MD5 of ``seed:row_id``, per estimator."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string"))), 1, 8), 16, 10).cast("long")
    rows = materialize(df.withColumn("fold", F.pmod(drawn, F.lit(k))), "folds")
    out = []
    for name, estimator in models.items():
        for fold in range(k):
            fitted = estimator.fit(rows.where(F.col("fold") != fold))
            got = fitted.transform(rows.where(F.col("fold") == fold)).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
            out.append((name, fold, float(got)))
    return df.sparkSession.createDataFrame(out, "model string, fold int, accuracy double").groupBy("model").agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"))


def prediction_targets(df: DataFrame, years: Sequence[int], labelled: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("region", "year", "src_row")) -> DataFrame:
    """Rows of the years without a label, with their classification text."""
    from gridloom.operators.rows import build_text

    rows = df.where(F.col("year").isin(*years)).join(labelled.select(*keys), list(keys), "left_anti")
    return build_text(rows, cols, required=cols[:1])


@dataclass
class Partition:
    """A k-means solution: centres in the order of their coordinates, sizes, and the sum of squared distances."""

    k: int
    seed: int
    centres: list[list[float]]
    sizes: list[int]
    wcss: float


def _nearest(x: Column, centres: Column) -> Column:
    """``struct(d, j)`` of the nearest of an array of centres, the first of equally near ones."""
    far = lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    return F.array_min(F.transform(centres, lambda c, j: F.struct(far(c).alias("d"), j.alias("j"))))


def lloyd(rows: DataFrame, row_id: str, x: str, tries: Sequence[tuple[int, int]], max_rounds: int = 300, tol: float = 1e-12) -> list[Partition]:
    """A solution per (k, seed), all tries together: one scan of the table per round.

    A try starts from the k rows with the smallest MD5 of ``seed:row_id`` and ends when no centre moves by more than
    ``tol``.  A round adds up counts and sums per try and cluster; an empty cluster stays where it is.  The centres of
    all tries, which the driver holds, reach the rows as one row.
    """
    spark = rows.sparkSession
    most = {seed: max(k for k, s in tries if s == seed) for _, seed in tries}
    drawn = None
    for seed, k in most.items():
        order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string"))), F.col(row_id)]
        some = rows.orderBy(*order).limit(k).select(F.lit(seed).alias("seed"), order[0].alias("at"), F.col(row_id).alias("id"), F.col(x).alias("x"))
        drawn = some if drawn is None else drawn.unionByName(some)
    first: dict[int, list] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["seed"], r["at"], r["id"])):
        first.setdefault(r["seed"], []).append(list(r["x"]))
    if any(len(first[seed]) < k for k, seed in tries):
        raise CheckFailed("fewer rows than clusters")
    centres = {t: first[t[1]][: t[0]] for t in tries}
    dims, live, done = len(next(iter(centres.values()))[0]), list(tries), {}
    for _ in range(max_rounds):
        held = spark.createDataFrame([([centres[t] for t in live],)], "centres array<array<array<double>>>")
        near = F.transform("centres", lambda c, i: F.struct(i.alias("i"), _nearest(F.col(x), c).alias("n")))
        at = rows.select(x).crossJoin(F.broadcast(held)).select(x, F.explode(near).alias("t")).select(x, "t.i", "t.n.j", "t.n.d")
        sums = at.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d"), *[F.sum(F.col(x)[m]).alias(f"s{m}") for m in range(dims)]).collect()
        by = {(r["i"], r["j"]): r for r in sums}
        for i, t in enumerate(list(live)):
            new = [[by[i, j][f"s{m}"] / by[i, j]["n"] for m in range(dims)] if (i, j) in by else c for j, c in enumerate(centres[t])]
            still = max(abs(a - b) for c, e in zip(centres[t], new, strict=True) for a, b in zip(c, e, strict=True)) <= tol
            if still:
                order = sorted(range(t[0]), key=lambda j, c=centres[t]: c[j])
                sizes = [by[i, j]["n"] if (i, j) in by else 0 for j in range(t[0])]
                done[t] = Partition(t[0], t[1], [centres[t][j] for j in order], [sizes[j] for j in order], sum(r["d"] for (u, _), r in by.items() if u == i))
            centres[t] = new
        live = [t for t in live if t not in done]
        if not live:
            return [done[t] for t in tries]
    raise CheckFailed(f"k-means did not settle in {max_rounds} rounds")


def _scaled(df: DataFrame, row_id: str, cols: Sequence[str]) -> tuple[DataFrame, dict]:
    """The table with ``_x``, the columns standardised by the population deviation, and the statistics."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    if any(not stats[f"s_{c}"] for c in cols):
        raise CheckFailed("a column has no variance")
    fail_if_any(df.where(" or ".join(f"`{c}` is null" for c in cols)).select(row_id), "missing values")
    return materialize(df.withColumn("_x", F.array(*[(F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"] for c in cols])), "profiles"), stats.asDict()


def _best(found: Sequence[Partition]) -> Partition:
    """The smallest cost; tries that agree to nine digits count as equal, and the first seed wins."""
    return min(found, key=lambda p: (float(f"{p.wcss:.9e}"), p.seed))


def _labelled(scaled: DataFrame, p: Partition) -> DataFrame:
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in p.centres])
    return scaled.withColumn("cluster", _nearest(F.col("_x"), centres)["j"])


def kmeans_profiles(df: DataFrame, row_id: str, cols: Sequence[str], k: int, seeds: Sequence[int] = tuple(range(10))) -> tuple[DataFrame, DataFrame]:
    """(rows with ``cluster``, centres in original units with sizes); ids follow the first centre coordinate.

    Columns are standardised by the population deviation; of several seeds the smallest cost wins.
    """
    scaled, stats = _scaled(df, row_id, cols)
    p = _best(lloyd(scaled, row_id, "_x", [(k, s) for s in seeds]))
    rows = [(place, p.sizes[place], *[c[j] * stats[f"s_{n}"] + stats[f"m_{n}"] for j, n in enumerate(cols)], float(p.wcss)) for place, c in enumerate(p.centres)]
    kinds = "cluster int, size long, " + ", ".join(f"`{c}` double" for c in cols) + ", wcss double"
    return _labelled(scaled, p).drop("_x"), df.sparkSession.createDataFrame(rows, kinds)


def silhouette(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean silhouette by squared Euclidean distance, from cluster sums only (no pairs of rows)."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = df.withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in cols]))).withColumn("prediction", F.col(cluster).cast("double"))
    value = ClusteringEvaluator(predictionCol="prediction", featuresCol="features").evaluate(rows)
    return df.sparkSession.createDataFrame([(float(value),)], "silhouette double")


def elbow(df: DataFrame, row_id: str, cols: Sequence[str], kmax: int = 6, seeds: Sequence[int] = tuple(range(10))) -> DataFrame:
    """WCSS, silhouette (of standardised columns) and smallest cluster for 1 to kmax clusters; one cluster has no silhouette."""
    scaled, _ = _scaled(df, row_id, cols)
    found = lloyd(scaled, row_id, "_x", [(k, s) for k in range(1, kmax + 1) for s in (seeds if k > 1 else seeds[:1])])
    rows = []
    for k in range(1, kmax + 1):
        p = _best([f for f in found if f.k == k])
        out = _labelled(scaled, p).select("cluster", *[F.col("_x")[j].alias(c) for j, c in enumerate(cols)])
        rows.append((k, p.wcss, float(silhouette(out, cols).first()[0]) if k > 1 else None, min(p.sizes)))
    return df.sparkSession.createDataFrame(rows, "k int, wcss double, silhouette double, smallest long")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "PipelineModel")]
