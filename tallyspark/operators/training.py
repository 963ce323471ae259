"""Model fitting re-aimed on Spark ML (ML1-ML3, PSL4).

The source fine-tunes a transformer per fold on one GPU. Here the same
protocol — k-fold fit / out-of-fold predict, final fit, refit on labelled +
pseudo-labelled rows — runs a distributed text pipeline (tokenise -> hashed
term frequencies -> IDF -> multinomial logistic regression). Every fit is a
distributed Spark ML job; the fold loop only issues k jobs.

Term frequencies are computed once, on the shared scratch folder, and serve all fits; a fit reads
its rows through a mask on the fold. Document frequencies are of the training rows only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.labels import DEFAULT_CLASSES, classes_array, encode
from tallyspark.functions.text import TOKEN_PATTERN
from tallyspark.operators import metrics as M
from tallyspark.operators.pseudolabel import assemble, confidence_filter, unanimous
from tallyspark.operators.runlogs import best_epoch
from tallyspark.session import materialise, path_exists

FEATURES = 1 << 18
BLOCK_MB = 32.0   # of rows whose gradient is added at once
TASK_ROWS = 2048  # of a fit's task at least, where there are fewer tasks than cores: sending an array takes as long as some rows do


def term_frequencies(df: DataFrame, keep: Sequence[str], num_features: int = FEATURES) -> DataFrame:
    """(keep..., _tf): hashed term frequencies of ``post``, written once; texts aren't read again."""
    words = RegexTokenizer(inputCol="post", outputCol="_tokens", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    filled = df.select(*keep, F.coalesce("post", F.lit("")).alias("post"))
    return materialise(tf.transform(words.transform(filled)).select(*keep, "_tf"), "term-frequencies")


def fit_features(rows: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES, label_col: str = "label",
                 max_iter: int = 20, reg: float = 0.0) -> PipelineModel:
    """IDF and regression on rows of ``term_frequencies``.

    Each evaluation of the gradient sends one array of classes x features from every task, and adds
    one for every block of rows. So the rows come in at most as many tasks as there are cores, and
    in large blocks: what is sent doesn't grow with the rows.
    """
    steps = Pipeline(stages=[
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_y", family="multinomial", maxIter=max_iter, regParam=reg, maxBlockSizeInMB=BLOCK_MB)])
    rows = rows.withColumn("_y", encode(label_col, classes, strict=True).cast("double"))
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // TASK_ROWS + 1)
    return steps.fit(rows.coalesce(tasks))


def predict_features(model: PipelineModel, rows: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES,
                     keep: Sequence[str] = ("index",)) -> DataFrame:
    """-> keep..., predicted_label, probs ARRAY<DOUBLE> (class order).

    Classes that no training row has stand behind the fitted ones with probability 0.
    """
    out = model.transform(rows)
    probs = F.concat(vector_to_array(F.col("probability")), F.array_repeat(F.lit(0.0), len(classes)))
    return out.select(*keep, F.element_at(classes_array(classes), F.col("prediction").cast("int") + 1).alias("predicted_label"),
                      F.slice(probs, 1, len(classes)).alias("probs"))


def fit(df: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES, label_col: str = "label",
        max_iter: int = 20) -> PipelineModel:
    """Fit on texts. Give the model rows of ``term_frequencies`` (``predict`` does)."""
    return fit_features(term_frequencies(df, [label_col]), classes, label_col, max_iter)


def predict(model: PipelineModel, df: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES,
            keep: Sequence[str] = ("index",)) -> DataFrame:
    """-> keep..., predicted_label, probs ARRAY<DOUBLE> (class order)."""
    carried = [c for c in keep if c != "post"]
    rows = term_frequencies(df, carried)
    out = predict_features(model, rows, classes, carried)
    return out.join(df.select(carried[0], "post"), carried[0]).select(*keep, "predicted_label", "probs") if "post" in keep else out


def _folds(feats: DataFrame, k: int, fold_col: str, classes: Sequence[str], label_col: str, max_iter: int) -> DataFrame:
    parts = []
    for f in range(k):
        model = fit_features(feats.where(F.col(fold_col) != f), classes, label_col, max_iter)
        parts.append(predict_features(model, feats.where(F.col(fold_col) == f), classes, keep=("index", fold_col, label_col)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kfold_fit_predict(df: DataFrame, k: int = 5, fold_col: str = "fold", classes: Sequence[str] = DEFAULT_CLASSES,
                      label_col: str = "label", max_iter: int = 20) -> DataFrame:
    """Out-of-fold predictions: fit on folds != f, predict fold f, for every f (ML1)."""
    feats = term_frequencies(df, ["index", fold_col, label_col])
    return _folds(feats, k, fold_col, classes, label_col, max_iter)


def fold_metrics(oof: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES, fold_col: str = "fold", label_col: str = "label") -> DataFrame:
    """Accuracy and weighted precision, recall and F1 of each fold's own predictions (ML1)."""
    s = M.summary(oof, classes, label_col, "predicted_label", [fold_col])
    return s.select(fold_col, "n", "accuracy", "precision_weighted", "recall_weighted", "f1_weighted")


def kfold_log(df: DataFrame, iterations: Sequence[int] = (5, 10, 20), k: int = 5, fold_col: str = "fold",
              classes: Sequence[str] = DEFAULT_CLASSES, label_col: str = "label") -> DataFrame:
    """(run, epoch, eval_...): each fold's weighted metrics after so many iterations (ML1).

    Epochs are numbers of iterations, runs are folds: the table that ``runlogs.average_per_epoch``,
    ``best_per_fold`` and ``kfold_summary`` read. All fits share one table of features.
    """
    feats = term_frequencies(df, ["index", fold_col, label_col])
    rows = None
    for n in iterations:
        m = fold_metrics(_folds(feats, k, fold_col, classes, label_col, n), classes, fold_col, label_col)
        one = m.select(F.col(fold_col).alias("run"), F.lit(float(n)).alias("epoch"), F.lit(n).cast("long").alias("step"), F.col("accuracy").alias("eval_accuracy"),
                       *[F.col(f"{x}_weighted").alias(f"eval_{x}_weighted") for x in ("f1", "precision", "recall")])
        rows = one if rows is None else rows.unionByName(one)
    return materialise(rows, "kfold-log")


def best_iterations(log: DataFrame) -> int:
    """The number of iterations with the best mean F1 over the folds (the fewest of equals)."""
    avg = log.groupBy("epoch").agg(F.avg("eval_f1_weighted").alias("avg_eval_f1_weighted"))
    return int(best_epoch(avg, extra=()).first()["best_epoch"])


def fit_all(labeled: DataFrame, target: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES,
            label_col: str = "label", max_iter: int = 20) -> DataFrame:
    """Final fit on all labelled rows, then score ``target`` (ML2)."""
    return predict(fit(labeled, classes, label_col, max_iter), target, classes)


def fit_eval(train: DataFrame, validation: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES,
             label_col: str = "label", max_iter: int = 20) -> DataFrame:
    """Fit on (possibly pseudo-augmented) rows, predict an untouched validation set (ML3)."""
    return predict(fit(train, classes, label_col, max_iter), validation, classes, keep=("index", label_col))


def pseudo_rounds(labeled: DataFrame, unlabeled: DataFrame, rounds: int = 2, threshold: float = 0.9,
                  classes: Sequence[str] = DEFAULT_CLASSES, max_iter: int = 20) -> DataFrame:
    """Iterated pseudo-labelling by one model's confidence (PSL4): fit -> score unlabelled -> keep
    confident rows -> union with the labelled rows -> refit. Features of all rows are computed once;
    each round's training set is written to the shared scratch folder, so lineage stays
    short. Returns per-round sizes: (round, n_labeled, n_pseudo, n_train)."""
    base = term_frequencies(labeled, ["index", "label"])
    todo = term_frequencies(unlabeled, ["index"])
    train = base
    sizes = []
    for r in range(rounds):
        model = fit_features(train, classes, "label", max_iter)
        conf = confidence_filter(predict_features(model, todo, classes, keep=("index", "_tf")), threshold, "probs")
        tagged = materialise(assemble(base, conf, cols=("index", "_tf")), "round")
        sizes.append(_sizes(tagged).select(F.lit(r + 1).alias("round"), "*"))
        train = tagged.select("index", "_tf", "label")
    out = sizes[0]
    for s in sizes[1:]:
        out = out.unionByName(s)
    return out


def _sizes(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy().agg(F.count_if(F.col("source") == "labeled").alias("n_labeled"), F.count_if(F.col("source") == "pseudo").alias("n_pseudo"),
                                F.count(F.lit(1)).alias("n_train"))


#: Fits on rows (index, post, label) and gives the function that predicts: rows -> (index, predicted_label).
Trainer = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def run_rounds(labeled: DataFrame, unlabeled: DataFrame, trainers: Mapping[str, Trainer], path: str, rounds: int = 2) -> DataFrame:
    """Iterated pseudo-labelling by unanimity (PSL4): in each round all models are fitted on the
    round's training rows, the unlabelled rows that all of them label alike become pseudo-labelled
    rows, and these with the labelled rows are the next round's training rows.

    Round r writes ``<path>/train/round=r`` and then, as its mark of completion,
    ``<path>/sizes/round=r``. A call goes on after the last complete round that it finds, so it can be
    repeated after a crash, or with more ``rounds``. Returns (round, n_labeled, n_pseudo, n_train).
    """
    spark = labeled.sparkSession
    base = labeled.select("index", "post", "label")
    train = base
    for r in range(1, rounds + 1):
        rows, sizes = f"{path}/train/round={r}", f"{path}/sizes/round={r}"
        if not path_exists(spark, f"{sizes}/_SUCCESS"):
            found = None
            for name, trainer in trainers.items():
                one = trainer(train)(unlabeled.select("index", "post")).select(F.lit(name).alias("model"), "index", "predicted_label")
                found = one if found is None else found.unionByName(one)
            agreed = unanimous(materialise(found, "votes"), list(trainers), "index", first_model=next(iter(trainers)), key_is_digest=True)
            pseudo = unlabeled.select("index", "post").join(agreed.select("index", "predicted_label"), "index")
            assemble(base, pseudo).write.mode("overwrite").parquet(rows)
            _sizes(spark.read.parquet(rows)).write.mode("overwrite").parquet(sizes)
        train = spark.read.parquet(rows).select("index", "post", "label")
    return spark.read.parquet(f"{path}/sizes").where(F.col("round") <= rounds).select("round", "n_labeled", "n_pseudo", "n_train")


def regression_trainer(classes: Sequence[str] = DEFAULT_CLASSES, max_iter: int = 20, num_features: int = FEATURES, reg: float = 0.0) -> Trainer:
    """A text regression as a member of ``run_rounds``; members differ by features or regularisation."""
    def train(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
        model = fit_features(term_frequencies(rows, ["label"], num_features), classes, "label", max_iter, reg)
        return lambda df: predict_features(model, term_frequencies(df, ["index"], num_features), classes)
    return train


def length_majority_trainer(modulus: int) -> Trainer:
    """The most frequent label (the first by name of equals) of the training posts whose length leaves
    the same remainder: a model that SQL can fit too."""
    bucket = F.length("post") % modulus

    def train(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
        n = rows.groupBy(bucket.alias("_b"), "label").agg(F.count(F.lit(1)).alias("_n"))
        best = n.groupBy("_b").agg(F.min_by("label", F.struct(-F.col("_n"), F.col("label"))).alias("predicted_label"))
        return lambda df: df.select("index", bucket.alias("_b")).join(best, "_b", "left").select("index", "predicted_label")
    return train
