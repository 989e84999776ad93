"""
DuckDB oracle SQL. Every query reads the event table of ``sf_dir`` (or data
Spark derives from it) as a whole; nothing is sampled to make a check cheap
except where sampling is the operator itself (P1).

Fixed parameters of the registered queries (FIXTURES.md): M=2, D=4, k=5
folds, seed 42, prefix T=3, epsilon 1e-4. Training runs until every model has
converged or diverged (at most 10,000 iterations); the SQL of these keys is a
recursive CTE with the same stop test.

The tables that a query makes on its way are deleted when its result stands
(``WorkScope``).
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segstate import sqlcheck as Q
from segstate.functions.arrays import l1_normalize, matrix_normalize, row_stochastic
from segstate.functions.obs import emission_lookup, obs_length, obs_prefix, obs_to_str, parse_obs
from segstate.functions.params import em_converged, init_models
from segstate.operators import folds as FO
from segstate.operators.evaluate import confusion_counts, fold_metrics, predict, score_both
from segstate.operators.joins import attach_models
from segstate.operators.trace import kernel_long_form
from segstate.session import WorkScope, materialize, new_work_dir
from segstate.sources import blocks as BL
from segstate.sources import events as EV
from segstate.sources import store as ST
from segstate.spec import HsmmSpec, RunParams

SEED = 42
K_FOLDS = 5
T_PREFIX = 3
SAMPLE_FRACTION = 0.5
SPEC_USER = HsmmSpec(m=2, k=len(EV.USER_ALPHABET), d=4)
SPEC = HsmmSpec(m=2, k=len(EV.LABELLED_ALPHABET), d=4)
RUN = RunParams(spec=SPEC, folds=K_FOLDS, seed=SEED, t_prefix=T_PREFIX)
ROUND = 6
# block length of the keys that run users (some 70 symbols) through block edges
SHORT_BLOCK = 32


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, ROUND)


def r6sql(x: str) -> str:
    return f"round({x}, {ROUND})"


# ------------------------------------------------------------------ inputs

def d2(spark: SparkSession, sf: str) -> DataFrame:
    """D2 as a sequence table (blocks)."""
    return EV.labelled_sequences(spark, sf)


def d2_lines(spark: SparkSession, sf: str) -> DataFrame:
    """D2 with whole arrays, one text line per sequence (the CSV layout)."""
    return BL.arrays(d2(spark, sf))


def folded(spark: SparkSession, sf: str, with_row_ids: bool = False) -> DataFrame:
    """D2 with folds (K1) and, when asked, row ids (P3), stored once."""
    return materialize(FO.folded_sequences(d2(spark, sf), K_FOLDS, SEED, with_row_ids), "folded")


def folded_keys(spark: SparkSession, sf: str) -> DataFrame:
    """(workitem, cls, kfold) of D2, without symbols."""
    return FO.assign_folds(EV.labelled_keys(spark, sf), K_FOLDS, SEED)


def start_models(fld: DataFrame, spec: HsmmSpec = SPEC) -> DataFrame:
    """F11 start models of the (fold, class) pairs that the fold table holds."""
    return init_models(fld.select(F.col("kfold").alias("fold"), "cls").distinct(), spec, SEED)


def scores_start(spark: SparkSession, sf: str, t_prefix: int | None = None) -> DataFrame:
    fld = folded(spark, sf)
    return score_both(FO.validation_rows(fld), start_models(fld), SPEC, K_FOLDS, t_prefix)


D2_SQL = Q.labelled_sequences_sql()
FOLDED_SQL = (
    "SELECT workitem, cls, obs, "
    "row_number() OVER (PARTITION BY cls ORDER BY workitem) AS row_id, "
    f"CAST((row_number() OVER (PARTITION BY cls ORDER BY md5(concat_ws(':', {SEED}, 'fold', workitem)), "
    f"workitem) - 1) % {K_FOLDS} AS INTEGER) AS kfold FROM ({D2_SQL})"
)
MODELS_SQL = (f"SELECT fold, cls, {Q.init_model_sql(SPEC, SEED)} FROM "
              f"(SELECT DISTINCT kfold AS fold, cls FROM ({FOLDED_SQL}))")


def _score_sql(obs: str, tag: str) -> str:
    return Q.forward_sql(obs, f"{tag}.pi", f"{tag}.a", f"{tag}.b", f"{tag}.p", SPEC)


def scores_sql(t_prefix: int | None = None) -> str:
    obs = "f.obs" if t_prefix is None else Q.prefix_sql("f.obs", t_prefix)
    return (f"SELECT f.workitem, f.cls, f.kfold AS fold, {_score_sql(obs, 'm1')} AS score1, "
            f"{_score_sql(obs, 'm0')} AS score0 FROM ({FOLDED_SQL}) f "
            f"JOIN ({MODELS_SQL}) m1 ON m1.fold = f.kfold AND m1.cls = 1 "
            f"JOIN ({MODELS_SQL}) m0 ON m0.fold = f.kfold AND m0.cls = 0")


def long_model_sql(models_sql: str) -> str:
    """(fold, cls, param, i, j, value) of a DuckDB model table."""
    def mat(name):
        return (f"SELECT fold, cls, '{name}' AS param, CAST(i - 1 AS INTEGER) AS i, "
                f"CAST(j - 1 AS INTEGER) AS j, {name}[i][j] AS value FROM ({models_sql}) mm, "
                f"range(1, len({name}) + 1) ri(i), range(1, len({name}[1]) + 1) rj(j)")
    pi = (f"SELECT fold, cls, 'pi' AS param, CAST(i - 1 AS INTEGER) AS i, 0 AS j, pi[i] AS value "
          f"FROM ({models_sql}) mm, range(1, len(pi) + 1) ri(i)")
    return " UNION ALL ".join([pi, mat("a"), mat("b"), mat("p")])


# ------------------------------------------------------------ S1, S1b, P1

def q_user_sequences(spark, sf):
    s = BL.arrays(EV.user_sequences(spark, sf))
    return s.select("workitem", obs_to_str(F.col("obs")).alias("str_obs"), F.size("obs").alias("length"))


SQL_USER_SEQUENCES = (f"SELECT workitem, {Q.obs_str_sql('obs')} AS str_obs, "
                      f"CAST(len(obs) AS INTEGER) AS length FROM ({Q.user_sequences_sql()})")


def q_build_sequences(spark, sf):
    return d2_lines(spark, sf).select("workitem", "cls", obs_to_str(F.col("obs")).alias("str_obs"),
                                      F.size("obs").alias("length"))


SQL_BUILD_SEQUENCES = (f"SELECT workitem, cls, {Q.obs_str_sql('obs')} AS str_obs, "
                       f"CAST(len(obs) AS INTEGER) AS length FROM ({D2_SQL})")


def q_sequence_symbols(spark, sf):
    """S1b in blocks: every symbol with its place, without putting a sequence
    together. With this block length users cross block edges."""
    return BL.symbols(EV.user_sequences(spark, sf, SHORT_BLOCK)).select("workitem", "t", "sym")


SQL_SEQUENCE_SYMBOLS = (f"SELECT user_id AS workitem, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, "
                        f"{Q.symbol_sql(EV.USER_ALPHABET)} AS sym FROM events")


def q_source_sequences(spark, sf):
    """Write each class as a headerless CSV, read them back typed."""
    base = new_work_dir(spark, "raw")
    seqs = d2_lines(spark, sf)
    paths = {c: os.path.join(base, f"class{c}") for c in (0, 1)}
    for c, p in paths.items():
        ST.write_raw_sequences(seqs.where(F.col("cls") == c), p)
    back = ST.read_raw_sequences(spark, paths)
    return back.select("workitem", "cls", obs_to_str(F.col("obs")).alias("str_obs"),
                       F.size("obs").alias("length"))


def q_sample_sequences(spark, sf):
    return EV.hash_sample(EV.labelled_keys(spark, sf), SAMPLE_FRACTION, SEED).select("workitem", "cls")


SQL_SAMPLE_SEQUENCES = (f"SELECT workitem, cls FROM ({D2_SQL}) "
                        f"WHERE {Q.hash_sample_sql(SAMPLE_FRACTION, SEED)}")


# ------------------------------------------------------- P3-P6, K1, S2/S3

def q_class_counts(spark, sf):
    return FO.class_counts(EV.labelled_keys(spark, sf))


SQL_CLASS_COUNTS = f"SELECT cls, count(*) AS n FROM ({D2_SQL}) GROUP BY cls"


def q_row_ids(spark, sf):
    return FO.row_ids(EV.labelled_keys(spark, sf)).select("workitem", "cls", "row_id")


SQL_ROW_IDS = f"SELECT workitem, cls, row_id FROM ({FOLDED_SQL})"


def q_assign_folds(spark, sf):
    return folded_keys(spark, sf).select("workitem", "cls", "kfold")


SQL_ASSIGN_FOLDS = f"SELECT workitem, cls, kfold FROM ({FOLDED_SQL})"


def q_train_split(spark, sf):
    return FO.training_fanout(folded_keys(spark, sf), K_FOLDS).groupBy("fold", "cls").agg(F.count("*").alias("n"))


SQL_TRAIN_SPLIT = (f"SELECT f.fold, s.cls, count(*) AS n FROM ({FOLDED_SQL}) s, "
                   f"(SELECT CAST(range AS INTEGER) AS fold FROM range({K_FOLDS})) f "
                   f"WHERE s.kfold <> f.fold GROUP BY f.fold, s.cls")


def q_validation_split(spark, sf):
    return FO.validation_rows(folded_keys(spark, sf)).groupBy("fold", "cls").agg(F.count("*").alias("n"))


SQL_VALIDATION_SPLIT = f"SELECT kfold AS fold, cls, count(*) AS n FROM ({FOLDED_SQL}) GROUP BY kfold, cls"


def q_roundtrip_folds(spark, sf):
    path = os.path.join(new_work_dir(spark, "folds"), "folds")
    ST.write_folds(folded(spark, sf, with_row_ids=True), path)
    back = BL.arrays(ST.read_folds(spark, path), ["row_id", "kfold"])
    return back.select("workitem", "cls", obs_to_str(F.col("obs")).alias("str_obs"), "row_id", "kfold")


SQL_ROUNDTRIP_FOLDS = f"SELECT workitem, cls, {Q.obs_str_sql('obs')} AS str_obs, row_id, kfold FROM ({FOLDED_SQL})"


# ---------------------------------------------------------------- F1-F11

def q_parse_obs(spark, sf):
    raw = d2_lines(spark, sf).select("workitem", obs_to_str(F.col("obs")).alias("str_obs"))
    obs = parse_obs(F.col("str_obs"))
    return raw.select("workitem", F.size(obs).alias("t"),
                      F.aggregate(obs, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("obs_sum"),
                      obs_to_str(obs).alias("obs_text"))


SQL_PARSE_OBS = (f"SELECT workitem, CAST(len(obs) AS INTEGER) AS t, CAST(list_sum(obs) AS BIGINT) AS obs_sum, "
                 f"{Q.obs_str_sql('obs')} AS obs_text FROM ({D2_SQL})")


def q_obs_length(spark, sf):
    return (d2(spark, sf).groupBy("rid", "workitem").agg(F.sum(obs_length(F.col("obs"))).cast("int").alias("t"))
            .select("workitem", "t"))


SQL_OBS_LENGTH = f"SELECT workitem, CAST(len(obs) AS INTEGER) AS t FROM ({D2_SQL})"


def q_obs_prefix(spark, sf):
    """F3 of the blocks that begin before T, put together per sequence (at most
    T symbols)."""
    head = d2(spark, sf).where(F.col("t0") < T_PREFIX)
    pre = head.withColumn("obs", obs_prefix(F.col("obs"), F.lit(T_PREFIX) - F.col("t0").cast("int")))
    return BL.arrays(pre).select("workitem", obs_to_str(F.col("obs")).alias("prefix"), F.size("obs").alias("t"))


SQL_OBS_PREFIX = (f"SELECT workitem, {Q.obs_str_sql(Q.prefix_sql('obs', T_PREFIX))} AS prefix, "
                  f"CAST(least(len(obs), {T_PREFIX}) AS INTEGER) AS t FROM ({D2_SQL})")


def q_emission_lookup(spark, sf):
    """every held-out sequence under both models of its fold."""
    fld = folded(spark, sf)
    models = start_models(fld).select("fold", F.col("cls").alias("model"), "b")
    rows = FO.validation_rows(fld).select("workitem", "fold", "t0", "obs")
    j = attach_models(rows, models, ["fold"], SPEC, n_models=2 * K_FOLDS)
    e = j.select("workitem", F.col("model").alias("cls"), "t0", F.posexplode(emission_lookup(F.col("obs"), F.col("b"))).alias("at", "row"))
    return e.select("workitem", "cls", (F.col("t0") + F.col("at")).cast("int").alias("t"), F.posexplode("row").alias("j", "value")).select(
        "workitem", "cls", "t", "j", r6("value").alias("value"))


SQL_EMISSION_LOOKUP = (
    f"SELECT s.workitem, m.cls, CAST(t - 1 AS INTEGER) AS t, CAST(j - 1 AS INTEGER) AS j, "
    f"{r6sql('m.b[j][s.obs[t] + 1]')} AS value FROM ({FOLDED_SQL}) s JOIN ({MODELS_SQL}) m ON m.fold = s.kfold, "
    f"range(1, len(s.obs) + 1) rt(t), range(1, {SPEC.m} + 1) rj(j)")


def q_l1_normalize(spark, sf):
    """F5 on each sequence's symbol-count vector, summed over its blocks."""
    def held(v: int) -> Column:
        return F.sum(F.size(F.filter("obs", lambda o: o == v))).cast("double").alias(f"n{v}")
    counts = [held(v) for v in range(SPEC.k)]
    seqs = d2(spark, sf).groupBy("rid", "workitem").agg(*counts)
    n = seqs.select("workitem", l1_normalize(F.array(*[f"n{v}" for v in range(SPEC.k)])).alias("f"))
    return n.select("workitem", F.posexplode("f").alias("v", "value")).select(
        "workitem", "v", r6("value").alias("value"))


SQL_L1_NORMALIZE = (
    f"SELECT workitem, CAST(v AS INTEGER) AS v, {r6sql('cnt / sum(abs(cnt)) OVER (PARTITION BY workitem)')} "
    f"AS value FROM (SELECT s.workitem, v, CAST(len(list_filter(s.obs, lambda o: o = v)) AS DOUBLE) AS cnt "
    f"FROM ({D2_SQL}) s, range({SPEC.k}) rv(v))")


def _bigram_matrix(seqs: DataFrame) -> DataFrame:
    """Per class: K x K counts of consecutive symbol pairs (zeros included),
    those across block edges too."""
    pairs = seqs.select("cls", F.explode(F.arrays_zip(
        F.slice("obs", 1, F.greatest(F.size("obs") - 1, F.lit(0))),
        F.slice("obs", 2, F.greatest(F.size("obs") - 1, F.lit(0))))).alias("z"))
    edges = seqs.where("not whole").select("cls", "rid", "t0", F.element_at("obs", 1).alias("1"), F.element_at("obs", -1).alias("last"))
    edges = edges.withColumn("0", F.lag("last").over(Window.partitionBy("rid").orderBy("t0"))).where(F.col("0").isNotNull())
    pairs = pairs.unionByName(edges.select("cls", F.struct("0", "1").alias("z")))
    counts = pairs.groupBy("cls", F.col("z.0").alias("i"), F.col("z.1").alias("j")).count()
    cells = counts.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws(":", "i", "j"), F.col("count").cast("double")))).alias("mp"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(SPEC.k - 1)), lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(SPEC.k - 1)),
        lambda j: F.coalesce(F.col("mp")[F.concat_ws(":", i.cast("string"), j.cast("string"))], F.lit(0.0))))
    return cells.select("cls", grid.alias("mat"))


def _explode_matrix(df: DataFrame, col: str) -> DataFrame:
    rows = df.select("cls", F.posexplode(col).alias("i", "row"))
    return rows.select("cls", "i", F.posexplode("row").alias("j", "value")).select(
        "cls", "i", "j", r6("value").alias("value"))


def q_row_stochastic(spark, sf):
    m = _bigram_matrix(d2(spark, sf))
    return _explode_matrix(m.select("cls", row_stochastic(F.col("mat")).alias("mat")), "mat")


_BIGRAMS_SQL = (
    f"SELECT c.cls, i, j, coalesce(n, 0)::DOUBLE AS cnt FROM (SELECT DISTINCT cls FROM ({D2_SQL})) c "
    f"CROSS JOIN range({SPEC.k}) ri(i) CROSS JOIN range({SPEC.k}) rj(j) LEFT JOIN ("
    f"SELECT cls, obs[t] AS a, obs[t + 1] AS b, count(*) AS n FROM ({D2_SQL}) s, "
    f"range(1, len(s.obs)) rt(t) GROUP BY ALL) x ON x.cls = c.cls AND x.a = i AND x.b = j")
SQL_ROW_STOCHASTIC = (
    f"SELECT cls, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, "
    f"{r6sql('CASE WHEN sum(abs(cnt)) OVER w = 0 THEN cnt ELSE cnt / sum(abs(cnt)) OVER w END')} AS value "
    f"FROM ({_BIGRAMS_SQL}) WINDOW w AS (PARTITION BY cls, i)")


def q_matrix_normalize(spark, sf):
    m = _bigram_matrix(d2(spark, sf))
    return _explode_matrix(m.select("cls", matrix_normalize(F.col("mat")).alias("mat")), "mat")


SQL_MATRIX_NORMALIZE = (
    f"SELECT cls, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, "
    f"{r6sql('cnt * (1.0 / sum(cnt) OVER (PARTITION BY cls))')} AS value FROM ({_BIGRAMS_SQL})")


def q_init_params(spark, sf):
    """F11 for every (fold, class) of the fold table."""
    return ST.model_long(start_models(folded(spark, sf))).withColumn("value", r6("value"))


SQL_INIT_PARAMS = f"SELECT fold, cls, param, i, j, {r6sql('value')} AS value FROM ({long_model_sql(MODELS_SQL)})"


def _model_files(spark, sf) -> dict[int, str]:
    """Text files of the models after one EM step, by class."""
    base = new_work_dir(spark, "modelfiles")
    models = materialize(_em(spark, sf, 1), "models")
    paths = {c: os.path.join(base, f"class{c}") for c in (0, 1)}
    for c, path in paths.items():
        ST.write_model_file(models.where(F.col("cls") == c), path)
    return paths


def q_model_matrix_to_flat(spark, sf):
    """S6 write: the models after one EM step as text files with a header;
    checked through the column-major fields of their lines."""
    lines = ST.read_model_lines(spark, _model_files(spark, sf))
    parts = F.split(F.col("line"), ";")
    names = ["pi", "a", "b", "p"]
    fields = F.array(*[F.struct(F.lit(n).alias("param"), F.split(parts[4 + x], ",").alias("v"))
                       for x, n in enumerate(names)])
    ex = lines.select(parts[0].cast("int").alias("fold"), "cls", F.explode(fields).alias("f"))
    return ex.select("fold", "cls", F.col("f.param").alias("param"),
                     F.posexplode("f.v").alias("pos", "text")).select(
        "fold", "cls", "param", "pos", r6(F.col("text").cast("double")).alias("value"))


def q_model_flat_to_matrix(spark, sf):
    """S6 load: the model of each fold, read back from the text files."""
    back = ST.read_model_file(spark, _model_files(spark, sf), SPEC)
    return ST.model_long(back).withColumn("value", r6("value"))


def q_em_converged(spark, sf):
    """F9 between the scores of each held-out row under its two start models."""
    s = scores_start(spark, sf)
    return s.select("workitem", em_converged(F.col("score1"), F.col("score0"), 0.01).alias("converged"))


SQL_EM_CONVERGED = (
    "SELECT workitem, coalesce(abs(score1 - score0) / ((abs(score1) + abs(score0) + "
    f"{2.0 ** -52!r}) / 2) < 0.01, false) AS converged FROM ({scores_sql()})")


# ------------------------------------------------------------- R1-R3, V1-V5

def _user_scores(spark, sf, block: int) -> DataFrame:
    from segstate.operators.scoring import prefix_scores
    from segstate.functions.params import init_model_values
    mv = init_model_values(0, 1, SPEC_USER, SEED)
    params = {(0, 1): tuple(np.array(mv[x]) for x in ("pi", "a", "b", "p"))}
    users = EV.user_sequences(spark, sf, block).withColumn("fold", F.lit(0))
    return (prefix_scores(users, params, SPEC_USER, [None])
            .select(F.col("workitem").cast("bigint").alias("workitem"), r6("score1").alias("score")))


def q_sequence_score(spark, sf):
    """R3 on D1 (K=5) under the start model of (fold 0, class 1)."""
    return _user_scores(spark, sf, BL.BLOCK)


def q_sequence_score_blocks(spark, sf):
    """The same with sequences that are carried over block edges."""
    return _user_scores(spark, sf, SHORT_BLOCK)


SQL_SEQUENCE_SCORE = (
    f"SELECT s.workitem, {r6sql(Q.forward_sql('s.obs', 'm.pi', 'm.a', 'm.b', 'm.p', SPEC_USER))} AS score "
    f"FROM ({Q.user_sequences_sql()}) s, (SELECT {Q.init_model_sql(SPEC_USER, SEED, '0', '1')}) m")


def _by_model(scores: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("model"), r6(f"score{c}").alias("score")) for c in (1, 0)])
    return scores.select("workitem", "cls", "fold", F.explode(pairs).alias("x")).select("workitem", "cls", "fold", "x.*")


def _by_model_sql(scores: str) -> str:
    return " UNION ALL ".join(f"SELECT workitem, cls, fold, {c} AS model, {r6sql(f'score{c}')} AS score FROM ({scores})" for c in (1, 0))


def q_score_full(spark, sf):
    """V1: held-out rows under each start model of their fold."""
    return _by_model(scores_start(spark, sf))


SQL_SCORE_FULL = _by_model_sql(scores_sql())


def q_score_prefix(spark, sf):
    """V2: the same on the first T=3 symbols."""
    return _by_model(scores_start(spark, sf, T_PREFIX))


SQL_SCORE_PREFIX = _by_model_sql(scores_sql(T_PREFIX))


def q_score_both_models(spark, sf):
    s = scores_start(spark, sf)
    return s.select("workitem", "cls", "fold", r6("score1").alias("score1"), r6("score0").alias("score0"))


SQL_SCORE_BOTH = (f"SELECT workitem, cls, fold, {r6sql('score1')} AS score1, {r6sql('score0')} AS score0 "
                  f"FROM ({scores_sql()})")


def q_predict_class(spark, sf):
    s = scores_start(spark, sf)
    return s.select("workitem", "cls", "fold", predict(F.col("score1"), F.col("score0")).alias("predicted"))


SQL_PREDICT_CLASS = (f"SELECT workitem, cls, fold, CASE WHEN score1 > score0 THEN 1 ELSE 0 END AS predicted "
                     f"FROM ({scores_sql()})")


def q_confusion_counts(spark, sf):
    return confusion_counts(scores_start(spark, sf))


def _counts_sql(scores: str, keys: str = "fold") -> str:
    return (f"SELECT {keys}, count(*) AS n, "
            "CAST(sum(CASE WHEN cls = 1 AND score1 > score0 THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
            "CAST(sum(CASE WHEN cls = 0 AND score1 > score0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
            "CAST(sum(CASE WHEN cls = 1 AND NOT score1 > score0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
            "CAST(sum(CASE WHEN cls = 0 AND NOT score1 > score0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, "
            "CAST(sum(CASE WHEN isnan(score1) OR isnan(score0) THEN 1 ELSE 0 END) AS BIGINT) AS n_undefined "
            f"FROM ({scores}) GROUP BY {keys}")


SQL_CONFUSION_COUNTS = _counts_sql(scores_sql())


def q_fold_metrics(spark, sf):
    return fold_metrics(confusion_counts(scores_start(spark, sf)))


def _metrics_sql(counts: str) -> str:
    def div(a, b):
        return f"CASE WHEN ({b}) = 0 THEN 'nan'::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"
    acc = div("tp + tn", "tp + fp + fn + tn")
    return (f"SELECT *, {div('tp', 'tp + fn')} AS sensitivity, {div('tn', 'tn + fp')} AS specificity, "
            f"{acc} AS accuracy, 1.0 - {acc} AS error FROM ({counts})")


SQL_FOLD_METRICS = _metrics_sql(SQL_CONFUSION_COUNTS)


def q_roundtrip_scores(spark, sf):
    path = os.path.join(new_work_dir(spark, "scores"), "scores")
    ST.write_scores(scores_start(spark, sf), path)
    s = ST.read_scores(spark, path)
    return s.select("workitem", "cls", "fold", r6("score1").alias("score1"), r6("score0").alias("score0"))


def q_pending_folds(spark, sf):
    """Metrics of folds 0 and 1 are committed; the rest are pending."""
    path = os.path.join(new_work_dir(spark, "metrics"), "metrics")
    counts = confusion_counts(scores_start(spark, sf))
    ST.append_metrics(fold_metrics(counts).where(F.col("fold") < 2), path)
    all_folds = folded_keys(spark, sf).select(F.col("kfold").alias("fold")).distinct()
    return ST.pending_folds(spark, all_folds, path)


SQL_PENDING_FOLDS = f"SELECT DISTINCT kfold AS fold FROM ({FOLDED_SQL}) WHERE kfold >= 2"


# ------------------------------------------------- R1, R2, R4-R8 long form

def _trace(spark, sf, what: str) -> DataFrame:
    fld = folded(spark, sf)
    return kernel_long_form(FO.validation_rows(fld), start_models(fld), SPEC, what)


def _traced(what: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: _trace(spark, sf, what)


# --------------------------------------------------------- R9-R12, V6, V7

def q_e_step_stats(spark, sf):
    from segstate.operators.estep import e_step_stats_folded
    fld = folded(spark, sf)
    st = e_step_stats_folded(fld, start_models(fld), SPEC, K_FOLDS)
    return st.select("fold", "cls", "param", "i", "j", r6("value").alias("value"))


def q_e_step_blocks(spark, sf):
    """R9 on D1 with sequences that are carried over block edges."""
    from segstate.operators.estep import e_step_stats_folded
    fld = materialize(FO.folded_sequences(EV.user_sequences(spark, sf, SHORT_BLOCK), K_FOLDS, SEED), "folded")
    st = e_step_stats_folded(fld, start_models(fld, SPEC_USER), SPEC_USER, K_FOLDS)
    return st.select("fold", "cls", "param", "i", "j", r6("value").alias("value"))


def q_e_step_wide(spark, sf):
    """R9 with the emission matrices as cells that are joined by symbol, the form
    of models that do not travel with the tasks (P7)."""
    from segstate.operators.wide import wide_e_step
    fld = folded(spark, sf)
    st = wide_e_step(fld, start_models(fld), SPEC)
    return st.select("fold", "cls", "param", "i", "j", r6("value").alias("value"))


def q_attach_models(spark, sf):
    """The parameters of both models of its fold on every held-out sequence."""
    fld = folded(spark, sf)
    rows = FO.validation_rows(fld.where(F.col("t0") == 0))
    models = start_models(fld).select("fold", F.col("cls").alias("model"), "pi", "a", "b", "p")
    joined = attach_models(rows.select("workitem", "cls", "fold"), models, ["fold"], SPEC, n_models=2 * K_FOLDS)
    return joined.select("workitem", "cls", "fold", "model", *_params())


def q_m_step(spark, sf):
    from segstate.operators.estep import e_step_stats_folded
    from segstate.operators.mstep import m_step
    fld = folded(spark, sf)
    new = m_step(e_step_stats_folded(fld, start_models(fld), SPEC, K_FOLDS), SPEC)
    return ST.model_long(new).withColumn("value", r6("value"))


def _em(spark, sf, iterations: int) -> DataFrame:
    from segstate.plans.em import train_models
    work = new_work_dir(spark, "em")
    return train_models(folded(spark, sf), SPEC, K_FOLDS, SEED, work, RUN.epsilon, iterations)


def q_em_one_iteration(spark, sf):
    return ST.model_long(_em(spark, sf, 1)).withColumn("value", r6("value"))


def q_em_train(spark, sf):
    """The parameters of every model, trained to the end."""
    return ST.model_long(_em(spark, sf, RUN.max_iterations)).withColumn("value", r6("value"))


def q_em_train_converged(spark, sf):
    """How the training of every model ended, with its parameters."""
    m = _em(spark, sf, RUN.max_iterations)
    return m.select("fold", "cls", "iteration", "converged", "status", F.round("loglik", 3).alias("loglik"), *_params())


def _params() -> list[Column]:
    """The trained parameters, rounded."""
    return [F.transform("pi", r6).alias("pi"), *[F.transform(c, lambda row: F.transform(row, r6)).alias(c) for c in "abp"]]


def _resumed_trace(spark, sf) -> DataFrame:
    """Stop after 2 iterations, resume to the end from the trace."""
    from segstate.plans.em import read_trace, train_models
    work = new_work_dir(spark, "resume")
    fld = folded(spark, sf)
    train_models(fld, SPEC, K_FOLDS, SEED, work, RUN.epsilon, 2)
    train_models(fld, SPEC, K_FOLDS, SEED, work, RUN.epsilon, RUN.max_iterations)
    return read_trace(spark, work)


def q_trace_resume(spark, sf):
    return _resumed_trace(spark, sf).select("fold", "cls", "iteration", r6("loglik").alias("loglik"), "converged")


def q_trace_resume_converged(spark, sf):
    """The same with the status and the parameters of every iteration."""
    return _resumed_trace(spark, sf).select("fold", "cls", "iteration", F.round("loglik", 3).alias("loglik"), "converged", "status",
                                            *_params())


def q_cross_validate(spark, sf):
    """V6 with models trained to the end."""
    from segstate.plans.crossval import cross_validate
    return cross_validate(d2(spark, sf), RUN, new_work_dir(spark, "cv"))


def q_cross_validate_prefix(spark, sf):
    """V7 with models trained to the end."""
    from segstate.plans.crossval import cross_validate_prefix
    return cross_validate_prefix(d2(spark, sf), RUN, new_work_dir(spark, "cvp"), [1, 2, T_PREFIX])


def q_run_audit(spark, sf):
    """V3, Q18: the accounts of a whole run from text files."""
    from segstate.plans import audit
    from segstate.plans.jobs import cross_validation
    base, work = new_work_dir(spark, "raw"), new_work_dir(spark, "cv")
    seqs = d2_lines(spark, sf)
    paths = {c: os.path.join(base, f"class{c}") for c in (0, 1)}
    for c, p in paths.items():
        ST.write_raw_sequences(seqs.where(F.col("cls") == c), p)
    cross_validation(spark, paths[1], paths[0], RUN, work)
    return audit.read(spark, work).select("stage", "cls", F.coalesce("fold", F.lit(-1)).alias("fold"), "name", "n")


SQL_RUN_AUDIT = (
    f"WITH f AS ({FOLDED_SQL}) "
    "SELECT 'input' AS stage, cls, -1 AS fold, name, count(*) AS n FROM f, (VALUES ('read'), ('kept')) v(name) GROUP BY ALL "
    "UNION ALL SELECT 'input', cls, -1, 'repeated ids', count(*) - count(DISTINCT workitem) FROM f GROUP BY cls "
    "UNION ALL SELECT 'evaluated', cls, kfold, name, count(*) FROM f, (VALUES ('held out'), ('scored')) v(name) GROUP BY ALL")


def scoped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its work tables deleted when its result stands."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        with WorkScope(spark) as scope:
            return scope.result(fn(spark, sf))
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "em_train_converged": q_em_train_converged,
    "cross_validate_converged": q_cross_validate,
    "trace_resume_converged": q_trace_resume_converged,
    "cross_validate_prefix_converged": q_cross_validate_prefix,
    "user_sequences": q_user_sequences,
    "build_sequences": q_build_sequences,
    "source_sequences": q_source_sequences,
    "sample_sequences": q_sample_sequences,
    "class_counts": q_class_counts,
    "row_ids": q_row_ids,
    "assign_folds": q_assign_folds,
    "train_split": q_train_split,
    "validation_split": q_validation_split,
    "roundtrip_folds": q_roundtrip_folds,
    "parse_obs": q_parse_obs,
    "obs_length": q_obs_length,
    "obs_prefix": q_obs_prefix,
    "emission_lookup": q_emission_lookup,
    "l1_normalize": q_l1_normalize,
    "row_stochastic": q_row_stochastic,
    "matrix_normalize": q_matrix_normalize,
    "init_params": q_init_params,
    "model_matrix_to_flat": q_model_matrix_to_flat,
    "model_flat_to_matrix": q_model_flat_to_matrix,
    "em_converged": q_em_converged,
    "sequence_symbols": q_sequence_symbols,
    "sequence_score": q_sequence_score,
    "sequence_score_blocks": q_sequence_score_blocks,
    "score_full": q_score_full,
    "score_prefix": q_score_prefix,
    "score_both_models": q_score_both_models,
    "predict_class": q_predict_class,
    "confusion_counts": q_confusion_counts,
    "fold_metrics": q_fold_metrics,
    "roundtrip_scores": q_roundtrip_scores,
    "pending_folds": q_pending_folds,
    "segment_likelihood": _traced("segment_likelihood"),
    "forward_alpha": _traced("forward_alpha"),
    "backward_beta": _traced("backward_beta"),
    "duration_posterior": _traced("duration_posterior"),
    "transition_posterior": _traced("transition_posterior"),
    "state_occupancy": _traced("state_occupancy"),
    "estimate_transition": _traced("estimate_transition"),
    "estimate_emission": _traced("estimate_emission"),
    "estimate_duration": _traced("estimate_duration"),
    "estimate_initial": _traced("estimate_initial"),
    "e_step_stats": q_e_step_stats,
    "e_step_blocks": q_e_step_blocks,
    "e_step_wide": q_e_step_wide,
    "attach_models": q_attach_models,
    "m_step": q_m_step,
    "em_one_iteration": q_em_one_iteration,
    "em_train": q_em_train,
    "trace_resume": q_trace_resume,
    "cross_validate": q_cross_validate,
    "cross_validate_prefix": q_cross_validate_prefix,
    "run_audit": q_run_audit,
}
QUERIES = {name: scoped(fn) for name, fn in QUERIES.items()}

ORACLES: dict[str, str] = {
    "user_sequences": SQL_USER_SEQUENCES,
    "build_sequences": SQL_BUILD_SEQUENCES,
    "source_sequences": SQL_BUILD_SEQUENCES,
    "sample_sequences": SQL_SAMPLE_SEQUENCES,
    "class_counts": SQL_CLASS_COUNTS,
    "row_ids": SQL_ROW_IDS,
    "assign_folds": SQL_ASSIGN_FOLDS,
    "train_split": SQL_TRAIN_SPLIT,
    "validation_split": SQL_VALIDATION_SPLIT,
    "roundtrip_folds": SQL_ROUNDTRIP_FOLDS,
    "parse_obs": SQL_PARSE_OBS,
    "obs_length": SQL_OBS_LENGTH,
    "obs_prefix": SQL_OBS_PREFIX,
    "emission_lookup": SQL_EMISSION_LOOKUP,
    "l1_normalize": SQL_L1_NORMALIZE,
    "row_stochastic": SQL_ROW_STOCHASTIC,
    "matrix_normalize": SQL_MATRIX_NORMALIZE,
    "init_params": SQL_INIT_PARAMS,
    "em_converged": SQL_EM_CONVERGED,
    "sequence_symbols": SQL_SEQUENCE_SYMBOLS,
    "sequence_score": SQL_SEQUENCE_SCORE,
    "sequence_score_blocks": SQL_SEQUENCE_SCORE,
    "run_audit": SQL_RUN_AUDIT,
    "score_full": SQL_SCORE_FULL,
    "score_prefix": SQL_SCORE_PREFIX,
    "score_both_models": SQL_SCORE_BOTH,
    "predict_class": SQL_PREDICT_CLASS,
    "confusion_counts": SQL_CONFUSION_COUNTS,
    "fold_metrics": SQL_FOLD_METRICS,
    "roundtrip_scores": SQL_SCORE_BOTH,
    "pending_folds": SQL_PENDING_FOLDS,
}


# ------------------------------------------ oracles of the recursion keys

_TRACE_BASE = (f"SELECT f.workitem, m.cls, f.obs, m.pi, m.a, m.b, m.p FROM ({FOLDED_SQL}) f "
               f"JOIN ({MODELS_SQL}) m ON m.fold = f.kfold")
_LAYERS = Q.estep_layers_sql(_TRACE_BASE, SPEC)
# quantity -> (list column, axes, size of the t axis)
_TRACE_SHAPES = {
    "u": ("u", "tij", "len(x.obs)", SPEC.m, SPEC.d),
    "alpha": ("alpha", "ti", "len(x.obs)", SPEC.m, 1),
    "alpha_prime": ("ap", "ti", "len(x.obs) + 1", SPEC.m, 1),
    "scale": ("scale", "t", "len(x.obs)", 1, 1),
    "beta": ("beta", "ti", "len(x.obs)", SPEC.m, 1),
    "beta_prime": ("bp", "ti", "len(x.obs) + 1", SPEC.m, 1),
    "n": ("n", "tij", "len(x.obs)", SPEC.m, SPEC.d),
    "xi": ("xi", "tij", "len(x.obs)", SPEC.m, SPEC.m),
    "gamma": ("gamma", "ti", "len(x.obs)", SPEC.m, 1),
    "new_a": ("new_a", "ij", "1", SPEC.m, SPEC.m),
    "new_b": ("new_b", "ij", "1", SPEC.m, SPEC.k),
    "new_p": ("new_p", "ij", "1", SPEC.m, SPEC.d),
    "new_pi": ("new_pi", "i", "1", SPEC.m, 1),
}


def _trace_sql(names: list[str]) -> str:
    parts = []
    for name in names:
        col, axes, t_len, n_i, n_j = _TRACE_SHAPES[name]
        idx = {"t": "t", "i": "i", "j": "j"}
        access = "x." + col + "".join(f"[{idx[a]} + 1]" for a in axes)
        parts.append(
            f"SELECT x.workitem, x.cls, '{name}' AS param, "
            f"CAST({'t' if 't' in axes else 0} AS INTEGER) AS t, "
            f"CAST({'i' if 'i' in axes else 0} AS INTEGER) AS i, "
            f"CAST({'j' if 'j' in axes else 0} AS INTEGER) AS j, "
            f"{r6sql(access)} AS value FROM ({_LAYERS}) x, range({t_len}) rt(t), "
            f"range({n_i}) ri(i), range({n_j}) rj(j)")
    return " UNION ALL ".join(parts)


_ESTEP_BASE = (f"SELECT ff.fold, s.cls, s.obs, m.pi, m.a, m.b, m.p FROM ({FOLDED_SQL}) s "
               f"JOIN (SELECT CAST(range AS INTEGER) AS fold FROM range({K_FOLDS})) ff ON s.kfold <> ff.fold "
               f"JOIN ({MODELS_SQL}) m ON m.fold = ff.fold AND m.cls = s.cls")


def _estep_sums_sql(base: str = _ESTEP_BASE, spec: HsmmSpec = SPEC) -> str:
    """Sums of the estimates of every model over rows (fold, cls, obs, pi, a, b, p)."""
    layers = Q.estep_layers_sql(base, spec)
    scal = (f"SELECT fold, cls, 'loglik' AS param, 0 AS i, 0 AS j, sum(loglik) AS value FROM x GROUP BY ALL "
            f"UNION ALL SELECT fold, cls, 'n_seq', 0, 0, CAST(count(*) AS DOUBLE) FROM x GROUP BY ALL "
            f"UNION ALL SELECT fold, cls, 'n_undefined', 0, 0, "
            f"CAST(sum(CASE WHEN isfinite(loglik) THEN 0 ELSE 1 END) AS DOUBLE) FROM x GROUP BY ALL")
    mats = []
    for col, name, n_j in (("new_a", "a", spec.m), ("new_b", "b", spec.k), ("new_p", "p", spec.d)):
        mats.append(f"SELECT fold, cls, '{name}', CAST(i AS INTEGER), CAST(j AS INTEGER), "
                    f"sum({col}[i + 1][j + 1]) FROM x, range({spec.m}) ri(i), range({n_j}) rj(j) GROUP BY ALL")
    pi = (f"SELECT fold, cls, 'pi', CAST(i AS INTEGER), 0, sum(new_pi[i + 1]) "
          f"FROM x, range({spec.m}) ri(i) GROUP BY ALL")
    return f"WITH x AS ({layers}) " + " UNION ALL ".join([scal, pi] + mats)


_USER_FOLDED_SQL = (
    "SELECT workitem, 1 AS cls, obs, "
    f"CAST((row_number() OVER (ORDER BY md5(concat_ws(':', {SEED}, 'fold', workitem)), workitem) - 1) % {K_FOLDS} AS INTEGER) AS kfold "
    f"FROM ({Q.user_sequences_sql()})")
_USER_ESTEP_BASE = (
    f"SELECT ff.fold, s.cls, s.obs, m.pi, m.a, m.b, m.p FROM ({_USER_FOLDED_SQL}) s "
    f"JOIN (SELECT CAST(range AS INTEGER) AS fold FROM range({K_FOLDS})) ff ON s.kfold <> ff.fold "
    f"JOIN (SELECT fold, cls, {Q.init_model_sql(SPEC_USER, SEED)} FROM (SELECT CAST(f AS INTEGER) AS fold, 1 AS cls "
    f"FROM range({K_FOLDS}) rf(f))) m ON m.fold = ff.fold AND m.cls = s.cls")
ORACLES["e_step_blocks"] = (f"SELECT fold, cls, param, i, j, {r6sql('value')} AS value "
                            f"FROM ({_estep_sums_sql(_USER_ESTEP_BASE, SPEC_USER)})")
SQL_ESTEP_SUMS = _estep_sums_sql()
SQL_E_STEP_STATS = f"SELECT fold, cls, param, i, j, {r6sql('value')} AS value FROM ({SQL_ESTEP_SUMS})"
SQL_M_STEP = (
    "SELECT fold, cls, param, i, j, " + r6sql(
        "CASE WHEN param = 'p' THEN value * (1.0 / sum(value) OVER (PARTITION BY fold, cls, param)) "
        "WHEN param = 'pi' THEN CASE WHEN sum(abs(value)) OVER (PARTITION BY fold, cls, param) = 0 THEN value "
        "ELSE value / sum(abs(value)) OVER (PARTITION BY fold, cls, param) END "
        "ELSE CASE WHEN sum(abs(value)) OVER (PARTITION BY fold, cls, param, i) = 0 THEN value "
        "ELSE value / sum(abs(value)) OVER (PARTITION BY fold, cls, param, i) END END") +
    f" AS value FROM ({SQL_ESTEP_SUMS}) WHERE param IN ('pi', 'a', 'b', 'p')")

for _key, _names in {
    "segment_likelihood": ["u"],
    "forward_alpha": ["alpha", "alpha_prime", "scale"],
    "backward_beta": ["beta", "beta_prime"],
    "duration_posterior": ["n"],
    "transition_posterior": ["xi"],
    "state_occupancy": ["gamma"],
    "estimate_transition": ["new_a"],
    "estimate_emission": ["new_b"],
    "estimate_duration": ["new_p"],
    "estimate_initial": ["new_pi"],
}.items():
    ORACLES[_key] = _trace_sql(_names)
ORACLES["e_step_stats"] = ORACLES["e_step_wide"] = SQL_E_STEP_STATS
ORACLES["m_step"] = SQL_M_STEP
ORACLES["em_one_iteration"] = SQL_M_STEP
# the models that stand in the text files are those of one EM step
ORACLES["model_flat_to_matrix"] = SQL_M_STEP
ORACLES["model_matrix_to_flat"] = (
    f"SELECT fold, cls, param, CAST(CASE WHEN param = 'pi' THEN i ELSE j * {SPEC.m} + i END AS INTEGER) AS pos, "
    f"value FROM ({SQL_M_STEP})")


# ------------------------------------- EM, V6 and V7 as a recursive CTE in SQL

_NORM = ("CASE WHEN param = 'p' THEN value * (1.0 / sum(value) OVER (PARTITION BY fold, cls, param)) "
         "WHEN param = 'pi' THEN CASE WHEN sum(abs(value)) OVER (PARTITION BY fold, cls, param) = 0 THEN value "
         "ELSE value / sum(abs(value)) OVER (PARTITION BY fold, cls, param) END "
         "ELSE CASE WHEN sum(abs(value)) OVER (PARTITION BY fold, cls, param, i) = 0 THEN value "
         "ELSE value / sum(abs(value)) OVER (PARTITION BY fold, cls, param, i) END END")


def _model_from_sums(sums: str) -> str:
    norm = f"SELECT fold, cls, param, i, j, {_NORM} AS value FROM {sums} WHERE param IN ('pi', 'a', 'b', 'p')"
    rows = f"SELECT fold, cls, param, i, list(value ORDER BY j) AS r FROM ({norm}) GROUP BY ALL"
    mats = f"SELECT fold, cls, param, list(r ORDER BY i) AS mat FROM ({rows}) GROUP BY ALL"
    return (f"SELECT fold, cls, any_value(CASE WHEN param = 'pi' THEN list_transform(mat, lambda r_: r_[1]) END) AS pi, "
            f"any_value(CASE WHEN param = 'a' THEN mat END) AS a, any_value(CASE WHEN param = 'b' THEN mat END) AS b, "
            f"any_value(CASE WHEN param = 'p' THEN mat END) AS p, "
            f"any_value(ll.value) AS loglik FROM ({mats}) mm "
            f"JOIN (SELECT fold AS lf, cls AS lc, value FROM {sums} WHERE param = 'loglik') ll "
            f"ON ll.lf = mm.fold AND ll.lc = mm.cls GROUP BY fold, cls")


def _converged(cur: str, prev: str, eps: float) -> str:
    return (f"coalesce(abs({cur} - {prev}) / ((abs({cur}) + abs({prev}) + {2.0 ** -52!r}) / 2) "
            f"< {eps!r}, false)")


def em_sql(max_iterations: int, epsilon: float) -> str:
    """WITH-chain: the start models, ``em`` with a row per model and iteration,
    the trace and the final models. A step reads the models of the iteration before
    that are still running, so the recursion ends by itself."""
    base = ("SELECT t.fold, t.cls, t.obs, m.pi, m.a, m.b, s.p FROM train t JOIN em m ON m.fold = t.fold AND m.cls = t.cls "
            f"JOIN start s ON s.fold = t.fold AND s.cls = t.cls WHERE m.status = 'running' AND m.iteration < {max_iterations - 1}")
    undefined = ("isnan(n.loglik) OR list_bool_or(list_transform(n.pi, lambda v_: isnan(v_))) OR "
                 "list_bool_or(list_transform(flatten(n.a), lambda v_: isnan(v_))) OR "
                 "list_bool_or(list_transform(flatten(n.b), lambda v_: isnan(v_)))")
    conv = _converged("n.loglik", "m.loglik", epsilon)
    step = (f"WITH sums AS MATERIALIZED ({_estep_sums_sql(base)}), n AS ({_model_from_sums('sums')}) "
            f"SELECT n.fold, n.cls, m.iteration + 1 AS iteration, n.pi, n.a, n.b, n.p, n.loglik, "
            f"CASE WHEN {conv} THEN 'converged' WHEN {undefined} THEN 'diverged' ELSE 'running' END AS status "
            f"FROM n JOIN em m ON m.fold = n.fold AND m.cls = n.cls")
    ctes = [
        f"folded AS MATERIALIZED ({FOLDED_SQL})",
        f"start AS MATERIALIZED (SELECT fold, cls, {Q.init_model_sql(SPEC, SEED)} FROM "
        f"(SELECT CAST(f AS INTEGER) AS fold, CAST(c AS INTEGER) AS cls FROM range({K_FOLDS}) rf(f), range(2) rc(c)))",
        f"train AS MATERIALIZED (SELECT ff.fold, s.cls, s.obs FROM folded s JOIN (SELECT CAST(range AS INTEGER) AS fold "
        f"FROM range({K_FOLDS})) ff ON s.kfold <> ff.fold)",
        "em AS (SELECT fold, cls, -1 AS iteration, pi, a, b, p, '-inf'::DOUBLE AS loglik, 'running' AS status FROM start "
        f"UNION ALL SELECT * FROM ({step}))",
        "trace AS MATERIALIZED (SELECT *, status = 'converged' AS converged FROM em WHERE iteration >= 0)",
        "final AS MATERIALIZED (SELECT * FROM trace QUALIFY iteration = max(iteration) OVER (PARTITION BY fold, cls))",
    ]
    return "WITH RECURSIVE " + ", ".join(ctes) + " "


def _cv_scores_sql(t_prefix: int | None, models: str = "final") -> str:
    obs = "f.obs" if t_prefix is None else Q.prefix_sql("f.obs", t_prefix)
    return (f"SELECT f.workitem, f.cls, f.kfold AS fold, {_score_sql(obs, 'm1')} AS score1, "
            f"{_score_sql(obs, 'm0')} AS score0 FROM folded f "
            f"JOIN {models} m1 ON m1.fold = f.kfold AND m1.cls = 1 "
            f"JOIN {models} m0 ON m0.fold = f.kfold AND m0.cls = 0")


_EM = em_sql(RUN.max_iterations, RUN.epsilon)
_LL3 = "round(loglik, 3) AS loglik"
_PARAMS_SQL = ", ".join([f"list_transform(pi, lambda v_: {r6sql('v_')}) AS pi"] + [
    f"list_transform({c}, lambda r_: list_transform(r_, lambda v_: {r6sql('v_')})) AS {c}" for c in "abp"])
ORACLES["attach_models"] = (f"SELECT f.workitem, f.cls, f.kfold AS fold, m.cls AS model, {_PARAMS_SQL} "
                            f"FROM ({FOLDED_SQL}) f JOIN ({MODELS_SQL}) m ON m.fold = f.kfold")
ORACLES["em_train"] = _EM + (
    f"SELECT fold, cls, param, i, j, {r6sql('value')} AS value FROM ({long_model_sql('SELECT * FROM final')})")
ORACLES["em_train_converged"] = _EM + (
    f"SELECT fold, cls, iteration, converged, status, {_LL3}, {_PARAMS_SQL} FROM final")
ORACLES["trace_resume"] = _EM + (
    f"SELECT fold, cls, iteration, {r6sql('loglik')} AS loglik, converged FROM trace")
ORACLES["trace_resume_converged"] = _EM + (
    f"SELECT fold, cls, iteration, {_LL3}, converged, status, {_PARAMS_SQL} FROM trace")
ORACLES["cross_validate"] = ORACLES["cross_validate_converged"] = _EM + _metrics_sql(_counts_sql(_cv_scores_sql(None)))
ORACLES["cross_validate_prefix"] = ORACLES["cross_validate_prefix_converged"] = _EM + _metrics_sql(_counts_sql(" UNION ALL ".join(
    f"SELECT {t} AS t_prefix, * FROM ({_cv_scores_sql(t)})" for t in (1, 2, T_PREFIX)), "t_prefix, fold"))
